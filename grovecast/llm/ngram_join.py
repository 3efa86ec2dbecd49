"""N-gram Jaccard join by MinHash banding, and near-duplicate classes.

Texts are sets of shingles of ``n`` words (words are separated by ASCII white
space; a text of fewer words, but not none, is one shingle).  Two different texts
are linked if the Jaccard similarity of their sets is ``threshold`` or more.

1. Equal texts form one node (digest of the text); only nodes are compared.
2. Every text gets a MinHash signature, cut into bands.  Rows per band and number
   of bands follow from the wanted recall at the threshold (:func:`choose_bands`).
3. Nodes are exchanged by band hash.  Buckets with two nodes or more are
   candidates; buckets with the same nodes as another one are dropped.
4. A bucket is verified in cells.  A large bucket is salted: its nodes are dealt
   into blocks of about ``block`` nodes, and each pair of blocks is one cell, so no
   task holds more than two blocks.  Blocks are as large as a task's memory allows, since a
   bucket of ``g`` blocks sends each of its sets ``g`` times.  A cell streams in with the nodes' full sets;
   pairs are verified on those, each pair once, in the first band that both share.
   No pair leaves a cell: per node only its number of links and one representative
   of the nodes it hangs together with.
5. Classes are the connected components of the links, by label propagation with
   pointer jumping; each round is written to the shared folder.

Cases: texts without words (null, empty, white space) have no links and are a class
of their own (the document's id); equal ids are told apart by their texts; null
ids don't name a class unless all of it are null; repeated rows are copies of one
node; an empty table gives an empty result; only id and text are read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StructField, StructType

from grovecast.llm.common import fresh, materialize, tidy

SHINGLE, THRESHOLD, RECALL, MAX_HASHES = 5, 0.8, 0.9999, 128
#: a block of a bucket: at most about so many shingles (8 bytes each, some copies of that while a cell
#: is verified), or so many nodes where texts are short (a node is compared with all of its cell at once)
BLOCK_SIZE, BLOCK = 1 << 17, 1024
_BASE = 0x100000001B3 * 0x9E3779B1 % 2**64 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_SLICE = 50_000


def choose_bands(threshold: float = THRESHOLD, recall: float = RECALL, max_hashes: int = MAX_HASHES) -> tuple[int, int]:
    """(bands, rows): the most rows per band (fewest false candidates) for which a
    pair at the threshold shares a band with probability ``recall``, within
    ``max_hashes`` hashes."""
    best = None
    for rows in range(1, max_hashes + 1):
        p = threshold ** rows
        bands = 1 if p >= recall else math.ceil(math.log(1 - recall) / math.log1p(-p))
        if bands * rows <= max_hashes:
            best = (bands, rows)
    if best is None:
        raise ValueError("no banding reaches this recall")
    return best


# -- hashing ------------------------------------------------------------------------
def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base of the word hash and of its inverse, as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(_BASE, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(_INVERSE, k, 2**64))])


def word_hashes(text: bytes, powers: Powers) -> np.ndarray:
    words, out = text.split(), []
    for at in range(0, len(words), _SLICE):
        clean = b" ".join(words[at:at + _SLICE]) + b" "
        b = np.frombuffer(clean, np.uint8)
        powers.need(len(b) + 1)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers.up[:len(b)])])
        end = np.flatnonzero(b == 32)
        start = np.concatenate([[0], end[:-1] + 1])
        out.append(mix((total[end] - total[start]) * powers.down[start] + (end - start).astype(np.uint64)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingles(text: bytes, n: int, powers: Powers) -> np.ndarray:
    """The distinct shingles of a text as sorted hashes."""
    w = word_hashes(text, powers)
    if not len(w):
        return w
    size = min(n, len(w))
    h = np.full(len(w) - size + 1, size, np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + w[k:k + len(h)]
    return np.unique(mix(h))


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """Band hashes (one row per set; no set may be empty)."""
    rng = np.random.default_rng(2024)
    mult = rng.integers(0, 2**63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    flip = rng.integers(0, 2**64 - 1, bands * rows, dtype=np.uint64)
    out = np.zeros((len(sets), bands), np.uint64)
    at = 0
    while at < len(sets):
        to, size = at, 0
        while to < len(sets) and (to == at or size + len(sets[to]) <= 1 << 15):
            size += len(sets[to])
            to += 1
        x = np.concatenate(sets[at:to])
        first = np.concatenate([[0], np.cumsum([len(s) for s in sets[at:to]])[:-1]])
        for b in range(bands):
            h = np.full(to - at, b, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                h = mix(h) + np.minimum.reduceat((x ^ flip[k]) * mult[k], first)
            out[at:to, b] = mix(h)
        at = to
    return out


def text_key(text: Column) -> Column:
    """Equal texts have equal keys (128-bit digest)."""
    return F.unhex(F.md5(text.cast("binary")))


# -- Spark jobs ---------------------------------------------------------------------
def sketch(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key, bands (null for texts without words), size (of the set) per row."""
    src = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                      F.col(text_col).cast("binary").alias("_text"))

    def run(batches):
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t, n, powers) if t else np.zeros(0, np.uint64) for t in batch.column(2).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                sig = signatures([sets[i] for i in full], bands, rows).view(np.int64) if full else []
                col: list = [None] * len(sets)
                for i, s in zip(full, sig):
                    col[i] = s
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(col, pa.list_(pa.int64())),
                                                  pa.array([len(s) for s in sets], pa.int64())], names=["doc_id", "key", "bands", "size"])

    return src.mapInArrow(tidy(run), "doc_id long, key binary, bands array<long>, size long")


def candidate_cells(nodes: DataFrame, block: int, block_size: int = BLOCK_SIZE) -> DataFrame:
    """band, h, i, j, key: the cells of every bucket with two nodes or more.  A bucket's
    blocks hold about ``block`` nodes or ``block_size`` shingles, whichever are fewer nodes."""
    member = nodes.select("key", "size", F.posexplode("bands").alias("band", "h"))
    bucket = member.groupBy("band", "h").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("key")).alias("x"),
                                             F.bit_xor(F.xxhash64("key", F.lit(1))).alias("y")).where("n >= 2")
    # the same nodes in another band: one bucket, the first, is enough
    first = bucket.groupBy("n", "total", "x", "y").agg(F.min(F.struct("band", "h")).alias("b")).select("b.band", "b.h", "n", "total")
    rows = member.join(first, ["band", "h"])
    # more blocks than nodes would only be empty
    by_size = F.least(F.ceil(F.col("total") / F.lit(float(block_size))), F.col("n"))
    blocks = F.greatest(F.ceil(F.col("n") / F.lit(float(block))), by_size).cast("int")
    rows = rows.select("band", "h", "key", blocks.alias("g"), F.pmod(F.xxhash64("key", F.lit(2)), blocks).cast("int").alias("blk"))
    rows = rows.select("band", "h", "key", "blk", F.explode(F.sequence(F.lit(0), F.col("g") - 1)).alias("o"))
    return rows.select("band", "h", F.least("blk", "o").alias("i"), F.greatest("blk", "o").alias("j"), "blk", "key")


def node_sets(docs: DataFrame, keys: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """key, shingles (sorted hashes), bands (packed) for the given keys (key, doc_id of one copy).  The texts
    are exchanged by key and id at every size; the narrow keys are the hashed side, so texts are not sorted."""
    text = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), text_key(F.col(text_col)).alias("key"),
                       F.col(text_col).cast("binary").alias("_text"))
    k = keys.select(F.col("key").alias("_k"), F.col("doc_id").alias("_d"))
    one = (text.join(k.hint("shuffle_hash"), (F.col("key") == F.col("_k")) & F.col("doc_id").eqNullSafe(F.col("_d")))
           .select("key", "_text").dropDuplicates(["key"]))

    def run(batches):
        powers = Powers()
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                sets = [shingles(t, n, powers) for t in batch.column(1).to_pylist()]
                sig = signatures(sets, bands, rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.astype("<u8").tobytes() for s in sets], pa.binary()),
                                                  pa.array([s.tobytes() for s in sig], pa.binary())], names=["key", "shingles", "bands"])

    return one.mapInArrow(tidy(run), StructType([StructField(c, BinaryType()) for c in ("key", "shingles", "bands")]))


def verify_cell(band: int, i: int, j: int, rows: list[dict], threshold: float) -> list[tuple[bytes, int, bytes]]:
    """(key, links, representative) of the nodes with a link in one cell."""
    rows = sorted(rows, key=lambda r: r["key"])
    sets = [np.frombuffer(r["shingles"], "<u8") for r in rows]
    size = np.array([len(s) for s in sets])
    sig = np.array([np.frombuffer(r["bands"], "<u8") for r in rows])
    blk = np.array([r["blk"] for r in rows])
    n = len(rows)
    # postings: shingle -> nodes
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), size)
    term = np.unique(flat, return_inverse=True)[1]
    post = owner[np.argsort(term, kind="stable")]
    ptr = np.concatenate([[0], np.cumsum(np.bincount(term))])
    at = np.concatenate([[0], np.cumsum(size)])
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    links = np.zeros(n, np.int64)
    for a in range(n):
        other = np.arange(n) > a
        if i != j:
            other &= blk != blk[a]
        other &= np.minimum(size, size[a]) >= threshold * np.maximum(size, size[a]) - 1e-9
        # each pair in the first band it shares
        other &= sig[:, band] == sig[a, band]
        if band:
            other &= ~(sig[:, :band] == sig[a, :band]).any(1)
        if not other.any():
            continue
        t = term[at[a]:at[a + 1]]
        count = ptr[t + 1] - ptr[t]
        where = np.repeat(ptr[t] - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        both = np.bincount(post[where], minlength=n)
        near = np.flatnonzero(other & (both >= threshold * (size + size[a] - both) - 1e-9))
        links[a] += len(near)
        links[near] += 1
        for b in near.tolist():
            x, y = find(a), find(b)
            if x != y:
                root[max(x, y)] = min(x, y)
    return [(rows[k]["key"], int(links[k]), rows[find(k)]["key"]) for k in range(n) if links[k]]


def verify(cells: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """key, links, rep: links and one node hung together with, per cell and node."""
    cell = ["band", "h", "i", "j"]
    rows = (cells.join(sets, "key").select(*cell, "blk", "key", "shingles", "bands")
            .repartition(*cell).sortWithinPartitions(*cell))

    def run(batches):
        held, group = None, []

        def done():
            got = verify_cell(held[0], held[2], held[3], group, threshold)
            return pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.int64()),
                                               pa.array([g[2] for g in got], pa.binary())], names=["key", "links", "rep"])
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                me = (r["band"], r["h"], r["i"], r["j"])
                if me != held:
                    if group:
                        yield done()
                    held, group = me, []
                group.append(r)
        if group:
            yield done()

    return rows.mapInArrow(tidy(run), "key binary, links long, rep binary")


def components(edges: DataFrame) -> DataFrame:
    """key, label (the smallest key of its component) from edges (a, b)."""
    both = materialize(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        # the smallest label among the neighbours ...
        near = (both.join(labels.select(F.col("key").alias("b"), F.col("label").alias("l")), "b")
                .groupBy(F.col("a").alias("key")).agg(F.min("l").alias("l")))
        step = labels.join(near, "key").select("key", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        # ... and the label of that label: one row per label in use, so a label of very many
        # nodes is looked up once, and its nodes need not meet while the labels fit a broadcast
        step = materialize(step, "step")
        far = materialize(step.select("label").distinct().join(step.select(F.col("key").alias("label"), F.col("label").alias("far")), "label"), "far")
        nxt = materialize(step.join(far, "label").select("key", "old", F.least("label", "far").alias("label")), "labels")
        if not nxt.where(F.col("old") != F.col("label")).limit(1).count():
            return nxt.select("key", "label")
        labels = nxt.select("key", "label")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = SHINGLE,
                    threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per input row: doc_id, key (digest of its text, null without words),
    class_key, class_id (smallest id of its class), n_links (other texts at the
    threshold or above) and n_copies (rows with the same text)."""
    bands, rows = choose_bands(threshold, recall)
    sketches = materialize(sketch(docs, id_col, text_col, n, bands, rows), "sketches")
    nodes = (sketches.where(F.col("bands").isNotNull()).groupBy("key")
             .agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n_copies"), F.first("bands").alias("bands"), F.first("size").alias("size")))
    nodes = materialize(nodes, "nodes")
    cells = materialize(candidate_cells(nodes, block), "cells")
    keys = nodes.select("key", "doc_id").join(cells.select("key").distinct(), "key")
    links = materialize(verify(cells, node_sets(docs, materialize(keys, "candidates"), id_col, text_col, n, bands, rows), threshold), "links")
    linked = links.groupBy("key").agg(F.sum("links").alias("n_links"))
    edges = links.where(F.col("key") != F.col("rep")).select(F.col("key").alias("a"), F.col("rep").alias("b"))
    labels = components(edges)
    named = (nodes.select("key", "doc_id", "n_copies").join(labels, "key", "left").join(linked, "key", "left")
             .withColumn("label", F.coalesce("label", "key")))
    least = materialize(named.groupBy("label").agg(F.min("doc_id").alias("class_id")), "least")
    classes = named.join(least, "label").select(F.col("key").alias("_k"), F.col("label").alias("class_key"), "class_id",
                                                F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_copies")
    key = F.when(F.col("bands").isNotNull(), F.col("key"))
    return (sketches.select("doc_id", key.alias("key")).join(classes, F.col("key") == F.col("_k"), "left")
            .select("doc_id", "key", "class_key",
                    F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("n_copies", F.lit(1)).alias("n_copies")))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` (its own columns) with one document of each class: the one with the
    smallest id (of equal ids the smallest digest, of equal rows one).  Texts without words all stay."""
    found = materialize(near_duplicates(docs, id_col, text_col, **how).where(F.col("key").isNotNull()).select("doc_id", "key", "class_key"), "classes")
    # per (id, text) how many rows have it; of classes with several, the one that stays
    per = materialize(found.groupBy("class_key", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "members")
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    first = (per.groupBy("class_key").agg(F.min_by(F.struct("doc_id", "key"), row).alias("m"), F.count(F.lit(1)).alias("members"))
             .where("members > 1").select("class_key", F.col("m.doc_id").alias("first_id"), F.col("m.key").alias("first_key")))
    other = ~(F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")))
    d, k = fresh(docs, "_d", "_k")
    gone = per.join(materialize(first, "first"), "class_key").where(other).select(F.col("doc_id").alias(d), F.col("key").alias(k))
    gone = materialize(gone, "gone")
    same = (text_key(F.col(text_col)) == F.col(k)) & F.col(id_col).cast("bigint").eqNullSafe(F.col(d))
    gone_side = gone.hint("shuffle_hash")  # texts are exchanged at every size, and not sorted
    twice = per.where("n > 1").select(F.col("doc_id").alias(d), F.col("key").alias(k))
    if not twice.limit(1).count():
        return docs.join(gone_side, same, "left_anti")
    # repeated rows: only those are exchanged by id and text
    alone = docs.join(gone.unionByName(twice), same, "left_anti")
    out = gone.select(F.col(d).alias("gone_id"), F.col(k).alias("gone_key"))
    kept = twice.join(out, F.col(d).eqNullSafe(F.col("gone_id")) & (F.col(k) == F.col("gone_key")), "left_anti")
    return alone.unionByName(docs.join(kept, same, "left_semi").dropDuplicates([id_col, text_col]))
