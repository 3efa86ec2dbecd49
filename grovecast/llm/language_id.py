"""Language identification: averaged hashed subword embeddings, linear softmax.

A text is lower-cased (ASCII), everything but letters and non-ASCII bytes becomes
one space, and every byte 2-, 3- and 4-gram is hashed into ``BUCKETS`` rows of an
embedding table.  The text's vector is the mean of its rows, a linear layer and a
softmax give the language.  Both are trained together by stochastic gradient
descent in numpy.

The training sample is bounded by documented parameters: ``max_docs`` documents,
taken in turn from the languages in the order of a hash of the id, so that rare
languages are not crowded out.  Executors turn their whole texts, and a few short
stretches of them (so that short texts are learnt too), into bucket counts.  A
tenth of the sample is set aside for calibration: a temperature is fitted there,
and the rejection threshold is the score below which only ``reject_rate`` of its
correctly labelled texts fall, never above ``MAX_THRESHOLD``.

For prediction, embedding and linear layer are one table (bucket x language), since
the mean and the linear layer commute; it is broadcast (a fixed size).

Cases: a null text, or one without a letter, is ``und`` with score 0 and rejected;
rows with a null label are not learnt from; ids are bigint (others are cast, what is no number counts as
null) and may be null or repeat (a null id is never learnt from, of rows with one id and label the smallest
text is); without any labelled row every text is ``und``; an empty
table gives an empty result; only id, text and label are read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from grovecast.llm.common import fresh, hand_back, tidy

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
MAX_DOCS, EPOCHS, RATE = 3000, 6, 0.5
REJECT_RATE, MAX_THRESHOLD = 0.002, 0.5
SPARE = 1.5
UND = "und"
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes) -> bool:
    if _ASCII_LETTER.search(text):
        return True
    return any(c.isalpha() for c in text.decode("utf-8", "replace"))


def buckets(text: bytes) -> np.ndarray:
    """The bucket of every 2-, 3- and 4-gram of the text."""
    clean = b" " + b" ".join(text.translate(_LETTERS).split()) + b" "
    b = np.frombuffer(clean, np.uint8).astype(np.uint32)
    out, h = [], b
    for n in range(2, max(GRAMS) + 1):
        if len(b) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + b[n - 1:] + np.uint32(n)
        x = h * np.uint32(0x9E3779B1)
        out.append((x ^ (x >> np.uint32(15))) & np.uint32(BUCKETS - 1))
    return np.concatenate(out) if out else np.zeros(0, np.uint32)


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # bucket x language
    bias: np.ndarray
    temperature: float
    threshold: float

    def logits(self, text: bytes) -> np.ndarray:
        counts = np.bincount(buckets(text), minlength=BUCKETS)  # whole numbers: one way for every length
        return counts @ self.table / max(1, counts.sum()) + self.bias

    def predict(self, text: bytes | None) -> tuple[str, float]:
        if not text or not self.langs or not has_letter(text):
            return UND, 0.0
        p = softmax(self.logits(text) / self.temperature)
        k = int(p.argmax())
        return self.langs[k], float(min(1.0, p[k]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def sample(docs: DataFrame, learn: Column, max_docs: int) -> DataFrame:
    """At most ``max_docs`` labelled rows (id, lang, text): per language in the order
    of a hash of the id, the languages in turn.

    Only ids whose hash is low enough for the language's count are ranked: ``SPARE``
    times ``max_docs`` of them are expected, whatever the size of the language."""
    named = docs.where(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    h = F.xxhash64("doc_id")
    # the languages are taken in turn by name, so no later one can be chosen; a broadcast of at most max_docs rows
    counts = named.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy("lang").limit(max_docs)
    low = (h.cast("double") / 2.0 ** 64 + 0.5) * F.col("n") <= SPARE * max_docs
    turn = F.row_number().over(Window.partitionBy("lang").orderBy(h, "doc_id"))
    ids = named.select("doc_id", "lang").join(F.broadcast(counts), "lang").where(low).select("doc_id", "lang").distinct()
    chosen = (ids.select("doc_id", "lang", turn.alias("turn")).where(F.col("turn") <= max_docs)
              .orderBy("turn", "lang").limit(max_docs).select("doc_id", "lang"))
    # at most max_docs narrow rows: a broadcast of a bounded size; rows with one id and label count
    # once, copies meet in the map tasks already
    return named.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))


def training_rows(rows: DataFrame) -> list:
    """Bucket shares of the sampled texts, whole and three short stretches each, on the driver: at most
    6 bytes for each bucket of a text, so ``6 * BUCKETS * max_docs`` and a little for the stretches."""
    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out = []
                for doc, lang, text in zip(*[whole.slice(at, 64).column(i).to_pylist() for i in range(3)]):
                    raw = (text or "").encode()
                    if not raw or not has_letter(raw):
                        continue
                    words = raw.split()
                    rng = np.random.default_rng(abs(hash(doc)))
                    cuts = [(int(a), int(a + k)) for a, k in zip(rng.integers(0, len(words), 3), (2, 5, 12))] if len(words) > 12 else []
                    for part in [raw, *[b" ".join(words[a:b]) for a, b in cuts]]:
                        ids, n = np.unique(buckets(part), return_counts=True)
                        if len(ids):
                            out.append({"doc": doc, "lang": lang, "ids": ids.astype("<u2").tobytes(), "share": (n / n.sum()).astype("<f4").tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                        [("doc", pa.int64()), ("lang", pa.string()), ("ids", pa.binary()), ("share", pa.binary())]))

    return rows.mapInArrow(tidy(run), "doc long, lang string, ids binary, share binary").collect()


def train(rows: list, epochs: int = EPOCHS, rate: float = RATE, reject_rate: float = REJECT_RATE) -> Model:
    """Fit embedding and linear layer, then calibrate (see the module text)."""
    rows = sorted(rows, key=lambda r: (r["doc"], r["lang"], bytes(r["ids"]), bytes(r["share"])))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(7)
    x = [(np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["share"], "<f4")) for r in rows]
    y = np.array([langs.index(r["lang"]) for r in rows])
    docs = np.array([r["doc"] for r in rows])
    aside = (docs * 2654435761 % 2**32) % 10 == 0
    if aside.all() or not aside.any():
        aside[:] = False
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    lin, bias = rng.normal(0, 0.1, (DIM, len(langs))).astype(np.float32), np.zeros(len(langs), np.float32)
    learn = np.flatnonzero(~aside)
    steps = epochs * len(learn)
    done = 0
    for _ in range(epochs):
        for k in rng.permutation(learn):
            ids, w = x[k]
            lr = rate * (1 - done / steps)
            v = w @ emb[ids]
            g = softmax(v @ lin + bias)
            g[y[k]] -= 1
            back = lin @ g
            lin -= lr * np.outer(v, g)
            bias -= 0.1 * lr * g
            # a word's row moves with its share; scaled up, since shares are small
            emb[ids] -= (lr * np.minimum(1.0, 20 * w))[:, None] * back
            done += 1
    table = (emb @ lin).astype(np.float64)
    held = np.flatnonzero(aside) if aside.any() else learn
    z = np.array([x[k][1] @ table[x[k][0]] + bias for k in held])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(1e-12, softmax(z / t)[np.arange(len(held)), y[held]])).mean() for t in grid]
    t = float(grid[int(np.argmin(loss))])
    p = softmax(z / t)
    right = p.argmax(1) == y[held]
    threshold = min(MAX_THRESHOLD, float(np.quantile(p.max(1)[right], reject_rate))) if right.any() else 0.0
    return Model(langs, table, bias, t, threshold)


def fit(docs: DataFrame, learn: Column | None = None, max_docs: int = MAX_DOCS, id_col: str = "doc_id",
        text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of the rows where ``learn`` (over the columns doc_id,
    lang, text) holds."""
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    try:
        return train(training_rows(sample(named, F.lit(True) if learn is None else learn, max_docs)))
    finally:
        hand_back()  # the driver's memory for the sample


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected appended."""
    col = docs.columns.index(text_col)
    names = fresh(docs, "lang_pred", "score", "rejected")
    shared = docs.sparkSession.sparkContext.broadcast(
        (model.langs, model.table, model.bias, model.temperature, model.threshold))  # BUCKETS x languages floats

    def run(batches):
        m = Model(*shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                got = [m.predict(None if t is None else t.encode()) for t in part.column(col).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()),
                     pa.array([g[0] == UND or g[1] < m.threshold for g in got], pa.bool_())], names=[*part.schema.names, *names])

    kinds = (StringType(), DoubleType(), BooleanType())
    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, *[StructField(n, k) for n, k in zip(names, kinds)]]))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


__all__ = ["Model", "fit", "identify", "held_out", "train", "LongType"]
