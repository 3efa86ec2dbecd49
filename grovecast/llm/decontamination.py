"""Benchmark decontamination with a broadcast hash set of test n-grams.

Words are runs of digits, letters and non-ASCII characters after lower-casing A-Z.
A benchmark item gives one window per ``n`` consecutive words (an item of fewer
words, but not none, is one window).  The distinct windows are broadcast: the
words of the benchmark are numbered, a window is a sequence of numbers, and
its hash goes into a sorted array.  Documents are scanned once: their words are
looked up in the numbering, a rolling hash over the numbers is looked up in the
sorted array, and every hit is verified on the whole number sequence, so hash
collisions never count.

The broadcast has a stated bound: the benchmark is cut into parts of at most
``max_windows`` windows (a larger item too, its pieces overlap by ``n - 1`` words), each part is
broadcast and scanned for itself, and the hits of a document are merged.  One part is the
usual case; a benchmark beyond the bound takes more scans, not a larger broadcast.  A part is some
numpy arrays (about 20 bytes a window) and the numbering of its different words, of which there
are fewer than windows and words per window: at the bound under 200 MB where every word differs (tested).

Cases: null or wordless texts have no words and no hits; null or wordless items
have no windows; items with equal windows are all hit; repeated item ids count
once, a null item id is not counted as an item but its windows are hit; an
empty table on either side gives no hits; extra columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from grovecast.llm.common import binary_views, fresh, tidy

N, MAX_WINDOWS = 10, 1_000_000
_WORD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | memoryview | None) -> list[bytes]:
    return bytes(text).translate(_WORD).split() if text is not None else []


def window_hash(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of every ``n`` consecutive numbers."""
    x = (ids.astype(np.uint64) + np.uint64(1)) * _MULT
    x ^= x >> np.uint64(29)
    m = len(ids) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = h * np.uint64(0x100000001B3) + x[k:k + m]
    return h


class WindowSet:
    """The windows of some benchmark items, ready for scanning.  The items' words are one sequence of
    numbers; of each size of window the different ones are kept as hash, place in the sequence and the
    numbers of the items that have them, in the order of the hashes."""

    def __init__(self, items: list[tuple[object, bytes | None]], n: int):
        self.number: dict[bytes, int] = {}
        self.items, flat, starts = [], [], {}
        at = 0
        for k, (item, text) in enumerate(items):
            number = self.number
            ids = np.array([number.setdefault(w, len(number)) for w in words_of(text)], np.int32)
            self.items.append(item)
            if len(ids):
                size = min(n, len(ids))
                starts.setdefault(size, []).append((at, len(ids) - size + 1, k))
                flat.append(ids)
                at += len(ids)
        self.flat = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        self.tables = [(size, *self._table(size, runs)) for size, runs in sorted(starts.items())]

    def _table(self, size: int, runs: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        """Hash and first place of the different windows, where each one's items begin, and these."""
        place = np.concatenate([np.arange(a, a + k, dtype=np.int32) for a, k, _ in runs])
        owner = np.repeat(np.array([i for _, _, i in runs], np.int32), [k for _, k, _ in runs])
        h = window_hash(self.flat, size)[place]
        order = np.lexsort((owner, h))
        h, place, owner = h[order], place[order], owner[order]
        new = np.ones(len(h), bool)
        new[1:] = h[1:] != h[:-1]
        for k in range(size):  # equal hashes of different windows stay apart
            x = self.flat[place + k]
            new[1:] |= x[1:] != x[:-1]
        head = np.flatnonzero(new)
        return h[head], place[head], np.append(head, len(h)).astype(np.int32), owner

    def state(self) -> tuple:
        """Plain values, for a broadcast."""
        return list(self.number), self.items, self.flat, self.tables

    @classmethod
    def of(cls, state: tuple) -> WindowSet:
        new = cls([], 1)
        words, new.items, new.flat, new.tables = state
        new.number = {w: k for k, w in enumerate(words)}
        return new

    def scan(self, words: list[bytes]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items whose windows occur."""
        hit = np.zeros(len(words), bool)
        found: set = set()
        get = self.number.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        known = ids >= 0
        run = np.concatenate([[0], np.cumsum(known)])
        for size, hashes, places, first, owners in self.tables:
            if len(words) < size:
                continue
            at = np.flatnonzero(run[size:] - run[:-size] == size)  # all words known
            if not len(at):
                continue
            h = window_hash(ids, size)[at]
            lo = np.searchsorted(hashes, h, "left")
            hi = np.searchsorted(hashes, h, "right")
            seen: set[int] = set()
            for p, a, b in zip(at[lo < hi].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                for j in range(a, b):  # more than one only where hashes collide
                    if (ids[p:p + size] == self.flat[places[j]:places[j] + size]).all():
                        hit[p:p + size] = True
                        seen.add(j)
            for j in seen:
                found.update(self.items[k] for k in owners[first[j]:first[j + 1]].tolist())
        return hit, found


def _parts(benchmark: DataFrame, item_col: str, text_col: str, n: int, max_windows: int):
    """The items in parts of at most ``max_windows`` windows; a larger item in pieces of its words."""
    part, size = [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).cast("binary").alias("t"))
    for r in rows.toLocalIterator():
        for k, text in _pieces(bytes(r["t"]) if r["t"] is not None else None, n, max_windows):
            if part and size + k > max_windows:
                yield part
                part, size = [], 0
            part.append((r["i"], text))
            size += k
    if part:
        yield part


def _pieces(text: bytes | None, n: int, max_windows: int):
    """(windows, text) of an item, cut between windows where it has more than ``max_windows``."""
    words = words_of(text)
    k = len(words) - n + 1
    if k <= max_windows:
        yield max(k, 0) + 1, text
        return
    for at in range(0, k, max_windows):
        yield min(max_windows, k - at), b" ".join(words[at:at + max_windows + n - 1])


HITS = pa.schema([("n_words", pa.int64()), ("hits", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def scan_documents(docs: DataFrame, benchmark: DataFrame, n: int = N, max_windows: int = MAX_WINDOWS, id_col: str = "doc_id",
                   text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, hits (positions of the hit words, ascending)
    and items (sorted ids as strings)."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("_row"),
                      F.col(text_col).cast("binary").alias("_t"))
    id_type = src.schema["doc_id"].dataType

    def scanner(windows):
        def run(batches):
            table = WindowSet.of(windows.value)
            for batch in batches:
                n_words, hits, items = [], [], []
                for t in binary_views(batch.column(2)):
                    words = words_of(t)
                    hit, found = table.scan(words)
                    n_words.append(len(words))
                    hits.append(np.flatnonzero(hit).astype(np.int32))
                    items.append(sorted(x for x in found if x is not None))
                cols = [batch.column(0), batch.column(1), pa.array(n_words, pa.int64()),
                        pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "_row", *HITS.names])
        return run

    from pyspark.sql.types import (ArrayType, IntegerType, LongType, StringType, StructField, StructType)
    schema = StructType([StructField("doc_id", id_type), StructField("_row", LongType()), StructField("n_words", LongType()),
                         StructField("hits", ArrayType(IntegerType())), StructField("items", ArrayType(StringType()))])
    out, parts = None, 0
    for part in _parts(benchmark, item_col, item_text_col, n, max_windows):
        got = src.mapInArrow(tidy(scanner(spark.sparkContext.broadcast(WindowSet(part, n).state()))), schema)
        out, parts = got if out is None else out.unionByName(got), parts + 1
    if not parts:
        out = src.mapInArrow(tidy(scanner(spark.sparkContext.broadcast(WindowSet([], n).state()))), schema)
    if parts > 1:
        out = out.groupBy("_row").agg(
            F.min("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    return out.select("doc_id", "n_words", "hits", "items")


def items_digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, mode: str = "documents", max_windows: int = MAX_WINDOWS,
                  text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` (all columns) without what the benchmark's windows cover:
    ``mode="documents"`` drops a document with a hit, ``mode="spans"`` cuts the hit
    words (with what stands between words hit in a row) out of its text.  The parts of
    a large benchmark all scan the whole text; it is cut once, by the hits of all."""
    if mode not in ("documents", "spans"):
        raise ValueError(mode)
    spark = docs.sparkSession
    col = docs.columns.index(text_col)
    from pyspark.sql.types import BinaryType, StructField, StructType
    spans = mode == "spans"
    mark = fresh(docs, "_hit")[0]  # a bit per word, while the parts scan
    schema = StructType([*docs.schema.fields, StructField(mark, BinaryType())]) if spans else docs.schema
    out = docs.select("*", F.lit(None).cast("binary").alias(mark)) if spans else docs
    for part in _parts(benchmark, item_col, item_text_col, n, max_windows):
        windows = spark.sparkContext.broadcast(WindowSet(part, n).state())

        def run(batches, windows=windows):
            table = WindowSet.of(windows.value)
            for batch in batches:
                hits = [table.scan(words_of(t))[0] for t in binary_views(batch.column(col))]
                if not spans:
                    keep = [not h.any() for h in hits]
                    if any(keep):
                        yield batch.filter(pa.array(keep))
                    continue
                before = batch.column(batch.num_columns - 1).to_pylist()
                bits = [np.packbits(h | bits_of(b, len(h))).tobytes() for h, b in zip(hits, before)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(bits, pa.binary())], names=schema.names)

        out = out.mapInArrow(tidy(run), schema)
    if not spans:
        return out

    def cut_all(batches):
        for batch in batches:
            texts = []
            for t, b in zip(binary_views(batch.column(col)), batch.column(batch.num_columns - 1).to_pylist()):
                hit = bits_of(b, len(words_of(t)))
                texts.append(None if t is None else cut(bytes(t), hit) if hit.any() else bytes(t))
            kind = batch.schema.field(col).type
            fixed = pa.array(texts, pa.large_binary() if pa.types.is_large_string(kind) else pa.binary()).cast(kind)
            yield pa.RecordBatch.from_arrays([fixed if i == col else c for i, c in enumerate(batch.columns[:-1])],
                                             names=schema.names[:-1])

    return out.mapInArrow(tidy(cut_all), docs.schema)


def bits_of(bits: bytes | None, n: int) -> np.ndarray:
    """The first ``n`` bits as booleans (none set where there are no bits)."""
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool) if bits else np.zeros(n, bool)


def cut(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without the hit words."""
    is_word = np.frombuffer(text.translate(_WORD), np.uint8) != 32
    edge = np.diff(np.concatenate([[0], is_word.astype(np.int8), [0]]))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = np.ones(len(text), bool)
    d = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1)):
        keep[starts[a]:ends[b - 1]] = False
    return np.frombuffer(text, np.uint8)[keep].tobytes()
