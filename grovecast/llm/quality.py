"""Quality rules with adaptive thresholds.

Every document gets word, symbol, line and repetition counts.  For each
measure, the distribution over the documents of a (language, source) group is
kept in a mergeable quantile sketch; the thresholds are fences derived from
the group's own quantiles, and they are joined back to the documents.

Sketch: a histogram over logarithmic bins (relative width ``GAMMA``), zero in a bin
of its own.  It is a plain ``(group, measure, bin) -> count`` table, so partial
aggregates merge by addition, exactly and in any order, a hot group costs one
row per bin and task, and its quantiles have a relative error of at most
``GAMMA - 1`` (word length: ``FINE - 1``).  The same sketch rows, summed over sources, give the language's
fences and summed over all, the corpus' fences: a group takes the most
specific level with at least ``min_rows`` documents that pass the base rules.

Fences, all from the group's own quantiles:

* word length: from the median, ``SPREAD`` times the distance to the 75 % quantile upwards and to the 25 %
  quantile downwards;
* shares (symbols, repeated lines, repeated words), which are 0 in most documents: the 80 % quantile
  and, beyond it, as much as some events weigh in the group's median document: ``EVENTS``
  symbols, lines or windows of repeated words, over the median of its characters, lines or words.

So a group of long words, of noisy word lengths, of short documents or of many repeats has wider fences
than another.  A document fails a measure beyond its fence; the fences are wide, an
ordinary document of its group stays.  A group of which junk is more than the quantiles
can bear does not set its own rules: its fence lies at most ``BOUND`` times the distance from the
middle of its language, for shares also from that of the corpus (word lengths differ by
language), and for shares never beyond ``MOST``.

Cases: a null text has no words and fails the base rule; null languages or
sources form groups of their own (null equals null); repeated rows count as
often as they stand; an empty table gives an empty result; extra columns are
passed through by :func:`filter_quality` and may have any names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovecast.llm.common import materialize, per_row

#: Base rules: fixed, as in the contract of the counts.
MIN_WORDS, REPEAT_PERCENT = 50, 50
#: relative width of a bin; that of the word length, of which small distances count, is finer
GAMMA, FINE = 1.02, 1.002
#: shares: measure -> (what it is a share of, size of one event, events, the most that its fence may be)
SHARES = {"symbol_ratio": ("word_chars", 1, 8, 0.5), "dup_line_ratio": ("n_lines", 1, 4, 0.7), "repeat_ratio": ("n_words", 6, 9, 0.4)}
MEASURES = ("word_length", *SHARES)
#: of these, quantiles are kept as well
SIZES = tuple(v[0] for v in SHARES.values())
#: least width of a fence, for groups whose quantiles coincide
LEAST = 0.05
SPREAD, BOUND, MIN_ROWS = 8.0, 2.0, 200
QUANTILES = (25, 50, 75, 80)

_NOT_SYMBOL = bytes(b for b in range(256) if chr(b) not in "#*$%&|<>")
_SPACE = bytes(range(9, 14)) + b" "
COUNTS = pa.schema([("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
                    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("n_lines", pa.int64())])


def repeat_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the text."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    v = len(number)
    if v < 2_000_000:
        grams = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
    else:  # the product would not fit: number the pairs first
        pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1]
        grams = pairs[:-1] * v + ids[2:]
    order = np.argsort(grams, kind="stable")
    s = grams[order]
    same = s[1:] == s[:-1]
    if not same.any():
        return 0
    twice = np.zeros(len(s), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = order[twice]
    hit = np.zeros(n, bool)
    hit[at] = hit[at + 1] = hit[at + 2] = True
    return int(hit.sum())


def text_counts(text: bytes | None) -> tuple[int, int, int, int, int, int]:
    """The counts of one UTF-8 text, in the order of ``COUNTS``."""
    if not text:
        return (0,) * 6
    words = text.split()  # bytes: exactly the ASCII white space \\x09-\\x0D and \\x20
    letters = np.frombuffer(text.translate(None, _SPACE), np.uint8)
    chars = int(((letters & 0xC0) != 0x80).sum())
    seen: set[bytes] = set()
    dup = lines = 0
    for line in text.split(b"\n"):
        if line and not line.isspace():
            lines += 1
            if line in seen:
                dup += 1
            else:
                seen.add(line)
    return len(words), chars, len(text.translate(None, _NOT_SYMBOL)), dup, repeat_words(words), lines


def with_counts(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ("doc_id", "lang", "source")) -> DataFrame:
    """``keep`` and the counts of every whole text."""
    src = docs.select(*[F.col(c) for c in keep], F.col(text_col).cast("binary").alias("_text"))
    kept = {f.name: f for f in src.schema.fields[:-1]}

    def counts(batch: pa.RecordBatch) -> dict:
        got = np.array([text_counts(t.as_py()) for t in batch.column(len(kept))], np.int64).reshape(-1, len(COUNTS))
        return {n: batch.column(i) for i, n in enumerate(kept)} | {f.name: pa.array(got[:, i]) for i, f in enumerate(COUNTS)}

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import LongType, StructField, StructType
    out = StructType([*kept.values(), *[StructField(f.name, LongType()) for f in COUNTS]])
    arrow = to_arrow_schema(out)
    return src.mapInArrow(per_row(counts, arrow), out)


def with_measures(counted: DataFrame) -> DataFrame:
    """Base verdict and the measures the fences apply to."""
    n = F.greatest(F.col("n_words"), F.lit(1)).cast("double")
    return counted.select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (F.col("word_chars") / n).alias("word_length"),
        (F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1)).cast("double")).alias("symbol_ratio"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)).cast("double")).alias("dup_line_ratio"),
        (F.col("n_repeat_words") / n).alias("repeat_ratio"))


def log_width(measure: Column) -> Column:
    return F.when(measure == "word_length", math.log(FINE)).otherwise(math.log(GAMMA))


def sketches(measured: DataFrame) -> DataFrame:
    """The mergeable sketches: (lang, source, measure, bin) -> n, of the documents
    that pass the base rules.  Bin null holds zeros."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("v")) for m in MEASURES + SIZES])).alias("x")
    v = F.col("x.v")
    bin_ = F.when(v > 0, F.ceil(F.log(v) / log_width(F.col("x.measure"))).cast("int"))
    return (measured.where(~F.col("base_failed")).select("lang", "source", one)
            .groupBy("lang", "source", F.col("x.measure").alias("measure"), bin_.alias("bin"))
            .agg(F.count(F.lit(1)).alias("n")))


def quantiles(sketch: DataFrame, group: list[str]) -> DataFrame:
    """rows and the ``QUANTILES`` (p25, ...) of every measure per group, read from its bins."""
    s = sketch.groupBy(*group, "measure", "bin").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*group, "measure")
    upto = F.sum("n").over(w.orderBy(F.col("bin").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    total = F.sum("n").over(w)
    value = F.when(F.col("bin").isNull(), F.lit(0.0)).otherwise(F.exp(log_width(F.col("measure")) * (F.col("bin") - 0.5)))
    s = s.select(*group, "measure", value.alias("v"), upto.alias("upto"), total.alias("total"))
    at = lambda q: F.min(F.when(F.col("upto") >= F.lit(q) * F.col("total"), F.col("v")))
    return s.groupBy(*group, "measure").agg(F.max("total").alias("rows"), *[at(q / 100).alias(f"p{q}") for q in QUANTILES])


def level(sketch: DataFrame, group: list[str], spread: float, bound: float, tag: str) -> DataFrame:
    """Per group and measure: rows, the fences (up, low) and the bounds that they are for narrower groups."""
    q = quantiles(sketch, group).groupBy(*group).agg(
        F.max("rows").alias("rows"), *[F.max(F.when(F.col("measure") == m, F.col(f"p{k}"))).alias(f"{m}_{k}") for m in MEASURES + SIZES for k in QUANTILES])
    at = lambda m, k: F.col(f"{m}_{k}")

    def row(m: str) -> Column:
        if m in SHARES:
            size, event, events, _ = SHARES[m]
            middle, up = at(m, 80), F.lit(float(event * events)) / F.greatest(at(size, 50), F.lit(1.0))
            low = low_bound = F.lit(None).cast("double")
        else:
            middle, up = at(m, 50), F.greatest(F.lit(spread) * (at(m, 75) - at(m, 50)), F.lit(LEAST))
            down = F.greatest(F.lit(spread) * (at(m, 50) - at(m, 25)), F.lit(LEAST))
            low, low_bound = middle - down, middle - F.lit(bound) * down
        return F.struct(F.lit(m).alias("measure"), (middle + up).alias("up"), (middle + F.lit(bound) * up).alias("up_bound"),
                        low.alias("low"), low_bound.alias("low_bound"))

    rows = q.select(*group, "rows", F.explode(F.array(*[row(m) for m in MEASURES])).alias("x")).select(*group, "rows", "x.*")
    return rows.select(*[F.col(c).alias(f"{tag}_{c}") for c in rows.columns])


def fences(sketch: DataFrame, spread: float = SPREAD, min_rows: int = MIN_ROWS, bound: float = BOUND) -> DataFrame:
    """One row per (lang, source) with an upper (``_fence``) and a lower (``_low``) fence
    per measure; null where a measure has none."""
    a, b, c = level(sketch, ["lang", "source"], spread, bound, "a"), level(sketch, ["lang"], spread, bound, "b"), level(sketch, [], spread, bound, "c")
    most = F.create_map(*[x for m, v in SHARES.items() for x in (F.lit(m), F.lit(v[3]))])[F.col("a_measure")]
    own = lambda x, y, z: F.when(F.col("a_rows") >= min_rows, x).when(F.col("b_rows") >= min_rows, y).otherwise(z)
    corpus = F.when(most.isNotNull(), F.least("c_up_bound", most))  # null: no bound (least skips nulls)
    best = (a.join(b, F.col("a_lang").eqNullSafe(F.col("b_lang")) & (F.col("a_measure") == F.col("b_measure")), "left")
            .join(c, F.col("a_measure") == F.col("c_measure"), "left")
            .select("a_lang", "a_source", "a_measure",
                    own(F.least("a_up", "b_up_bound", corpus), F.least("b_up", corpus), F.least(F.col("c_up"), most)).alias("fence"),
                    own(F.greatest("a_low", "b_low_bound"), F.col("b_low"), F.col("c_low")).alias("low")))
    return best.groupBy(F.col("a_lang").alias("f_lang"), F.col("a_source").alias("f_source")).agg(
        *[F.max(F.when(F.col("a_measure") == m, F.col(k))).alias(f"{m}_{k}") for m in MEASURES for k in ("fence", "low")])


def judge(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", lang_col: str = "lang",
          source_col: str = "source", spread: float = SPREAD, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, lang, source, the counts and measures, base_failed, failed (the
    measures beyond their fence) and kept.  The counts are written once: the
    sketches and the joined filter read them."""
    named = docs.select(F.col(id_col).alias("doc_id"), F.col(lang_col).alias("lang"),
                        F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    measured = with_measures(materialize(with_counts(named), "quality-counts"))
    f = fences(sketches(measured), spread, min_rows)
    out = measured.join(f, F.col("lang").eqNullSafe(F.col("f_lang")) & F.col("source").eqNullSafe(F.col("f_source")), "left")
    failed = F.array_compact(F.array(*[F.when((F.col(m) > F.col(f"{m}_fence")) | (F.col(m) < F.col(f"{m}_low")), F.lit(m)) for m in MEASURES]))
    out = out.withColumn("failed", F.when(F.col("base_failed"), F.array().cast("array<string>")).otherwise(failed))
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0)).drop(
        "f_lang", "f_source", *[f"{m}_{k}" for m in MEASURES for k in ("fence", "low")])
