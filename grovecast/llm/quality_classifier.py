"""Quality classifier: supervised subword embeddings, averaged, with a softmax output.

A text is its words (runs of anything but ASCII white space, case kept).  Its
features are the words, the pairs of neighbouring words and the 2-, 3- and 4-byte
grams of the text with single spaces, each hashed into one of ``BUCKETS`` rows of an
embedding table; a word that repeats its predecessor has a bucket of its own, whatever
the word.  The text's vector is the mean of its features' rows, a linear layer and a
softmax give the labels' probabilities.  Embedding and linear layer are trained
together by stochastic gradient descent in numpy.

The labels to learn from are bounded by documented parameters: at most ``max_docs``
labelled documents, taken in turn from the labels in the order of a hash of the id,
so that a rare label is not crowded out.  One text of each is turned into feature
counts by the executors and sent to the driver: at most ``max_docs * BUCKETS * 6`` bytes,
whatever the length of the texts.  A tenth is set aside for a temperature, by which
the probabilities are calibrated.

For scoring, embedding and linear layer are one table (bucket x label), since the mean
and the linear layer commute; it is broadcast (a fixed size).  A text's feature counts
are whole numbers, so its score does not depend on how it is read.

Cases: a null text counts as empty; an empty text is scored by the bias alone; rows without an
id, and labels that are null or whose id is in no document, are not learnt from; of
rows with one id the smallest text is learnt; an id with two different labels is learnt with
both; without any label every score is 0.5; an empty table gives an empty result; other columns are passed
through, output names that clash get a leading underscore.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType
from pyspark.sql.window import Window

from grovecast.llm.common import fresh, hand_back, tidy
from grovecast.llm.ngram_join import Powers, mix, word_hashes

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
MAX_DOCS, EPOCHS, RATE, SPARE, SLACK = 3000, 6, 0.5, 1.5, 0.003
POSITIVE = 1
REPEATED = 0  # bucket of a word that equals the one before it
_SLICE = 1 << 20


# -- features -----------------------------------------------------------------------
def feature_counts(text: bytes, powers: Powers) -> np.ndarray:
    """How often each bucket occurs among the features of a text."""
    total = np.zeros(BUCKETS, np.int64)
    words = word_hashes(text, powers)
    if not len(words):
        return total
    top = np.uint64(BUCKETS - 2)
    pair = mix(words[:-1] * np.uint64(3) + words[1:]) % top + np.uint64(1)
    pair[words[1:] == words[:-1]] = REPEATED
    parts = [(words % top + np.uint64(1)).astype(np.int32), pair.astype(np.int32)]
    clean = np.frombuffer(b" " + b" ".join(text.split()) + b" ", np.uint8)
    for at in range(0, len(clean), _SLICE):
        raw = h = clean[at:at + _SLICE + max(GRAMS) - 1].astype(np.uint32)
        for n in range(2, max(GRAMS) + 1):
            h = h[:-1] * np.uint32(0x01000193) + raw[n - 1:] + np.uint32(n)
            x = h[:_SLICE] * np.uint32(0x9E3779B1)
            parts.append(((x ^ (x >> np.uint32(15))) % np.uint32(BUCKETS - 2) + np.uint32(1)).view(np.int32))
        total += np.bincount(np.concatenate(parts), minlength=BUCKETS)
        parts = []
    return total


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


@dataclass
class Model:
    labels: list[int]
    table: np.ndarray  # bucket x label, float64
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        """Probability of every label for the feature counts of a text."""
        n = counts.sum()
        z = self.bias + (counts @ self.table / n if n else 0.0)
        return softmax(z / self.temperature)

    def score(self, text: bytes | None, powers: Powers, positive: int = POSITIVE) -> float:
        if positive not in self.labels:
            return 0.0 if self.labels else 0.5
        return float(self.probabilities(feature_counts(text or b"", powers))[self.labels.index(positive)])


# -- learning -------------------------------------------------------------------------
def sample(docs: DataFrame, labels: DataFrame, learn: Column, max_docs: int) -> DataFrame:
    """doc_id, label, text of at most ``max_docs`` labelled documents (see the module text).

    Only ids whose hash is low enough for the label's count are ranked, about ``SPARE``
    times ``max_docs`` of each label, and no text takes part before they are chosen."""
    named = labels.where(learn & F.col("doc_id").isNotNull() & F.col("label").isNotNull())
    h = F.xxhash64("doc_id")
    # one narrow row for each label; labels beyond max_docs could not be chosen
    sizes = named.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy("label").limit(max_docs)
    low = (h.cast("double") / 2.0 ** 64 + 0.5) * F.col("n") <= SPARE * max_docs
    turn = F.row_number().over(Window.partitionBy("label").orderBy(h, "doc_id"))
    ranked = (named.join(F.broadcast(sizes), "label").where(low).select("doc_id", "label").distinct()
              .join(docs.select("doc_id").where("doc_id is not null"), "doc_id", "left_semi"))
    chosen = (ranked.select("doc_id", "label", turn.alias("turn")).where(F.col("turn") <= max_docs)
              .orderBy("turn", "label").limit(max_docs).select("doc_id", "label"))
    # at most max_docs narrow rows: a broadcast of a bounded size; equal ids meet in one row, copies already in the map tasks
    return docs.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def training_rows(rows: DataFrame) -> list:
    """Feature counts of the sampled texts, on the driver (at most 6 bytes for each
    document and bucket)."""
    def run(batches):
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                out = []
                for doc, label, text in zip(*[whole.slice(at, 64).column(i).to_pylist() for i in range(3)]):
                    counts = feature_counts((text or "").encode(), powers)
                    ids = np.flatnonzero(counts)
                    if len(ids):
                        share = counts[ids] / counts.sum()
                        out.append({"doc": doc, "label": label, "ids": ids.astype("<u2").tobytes(), "share": share.astype("<f4").tobytes()})
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=pa.schema(
                        [("doc", pa.int64()), ("label", pa.int64()), ("ids", pa.binary()), ("share", pa.binary())]))

    return rows.mapInArrow(tidy(run), "doc long, label long, ids binary, share binary").collect()


def train(rows: list, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit embedding and linear layer, then the temperature (see the module text)."""
    rows = sorted(rows, key=lambda r: (r["doc"], r["label"]))
    labels = sorted({r["label"] for r in rows})
    if not labels:
        return Model([], np.zeros((BUCKETS, 0)), np.zeros(0), 1.0)
    rng = np.random.default_rng(11)
    x = [(np.frombuffer(r["ids"], "<u2"), np.frombuffer(r["share"], "<f4")) for r in rows]
    y = np.array([labels.index(r["label"]) for r in rows])
    aside = np.array([r["doc"] * 2654435761 % 2**32 % 10 == 0 for r in rows])
    if aside.all() or not aside.any():
        aside[:] = False
    emb = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32)
    lin, bias = rng.normal(0, 0.1, (DIM, len(labels))).astype(np.float32), np.zeros(len(labels), np.float32)
    learn = np.flatnonzero(~aside)
    steps, done = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for k in rng.permutation(learn):
            ids, share = x[k]
            lr = rate * (1 - done / steps)
            v = share @ emb[ids]
            g = softmax(v @ lin + bias)
            g[y[k]] -= 1
            back = lin @ g
            lin -= lr * np.outer(v, g)
            bias -= 0.1 * lr * g
            # shares are small: a row's step is scaled up, to at most the full step
            emb[ids] -= (lr * np.minimum(1.0, 20 * share))[:, None] * back
            done += 1
    table = (emb @ lin).astype(np.float64)
    held = np.flatnonzero(aside) if aside.any() else learn
    z = np.array([x[k][1] @ table[x[k][0]] + bias for k in held])
    grid = np.geomspace(0.05, 5, 60)
    loss = [-np.log(np.maximum(1e-12, softmax(z / t)[np.arange(len(held)), y[held]])).mean() for t in grid]
    # of temperatures that are as good, the highest: where all is told apart, the least sure
    best = max(t for t, x in zip(grid, loss) if x <= min(loss) + SLACK)
    return Model(labels, table, bias.astype(np.float64), float(best))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, max_docs: int = MAX_DOCS, id_col: str = "doc_id",
        text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded sample of the labels where ``learn`` (over the columns doc_id and label) holds."""
    named = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    marks = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).cast("bigint").alias("label"))
    try:
        return train(training_rows(sample(named, marks, F.lit(True) if learn is None else learn, max_docs)))
    finally:
        hand_back()  # the driver's memory for the sample


def classify(docs: DataFrame, model: Model, text_col: str = "text", positive: int = POSITIVE) -> DataFrame:
    """``docs`` with score appended: the probability of the label ``positive``."""
    col = docs.columns.index(text_col)
    name = fresh(docs, "score")[0]
    shared = docs.sparkSession.sparkContext.broadcast((model.labels, model.table, model.bias, model.temperature))

    def run(batches):
        m, powers = Model(*shared.value), Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                part = whole.slice(at, 512)
                got = [m.score(t.as_py().encode() if t.is_valid else None, powers, positive) for t in part.column(col)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(got, pa.float64())], names=[*part.schema.names, name])

    return docs.mapInArrow(tidy(run), StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learnt from: crc32 of the id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
