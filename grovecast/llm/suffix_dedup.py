"""Removal of repeated passages with suffix arrays.

A byte of a text is removed where it is covered by a ``LENGTH``-byte string that
also starts in a document with a smaller id.  The method, as Spark jobs:

1. *Shards.*  Rows are packed into shards of about ``shard_bytes`` of text, each one
   compressed record batch with all input columns, written once.
2. *Anchors.*  Every ``LENGTH``-byte string has an anchor: the smallest hash of the
   ``GRAM``-byte strings inside it.  Equal strings have equal anchors, and neighbouring
   strings mostly share one, so a shard has few.  Each shard's distinct anchors go,
   sorted, to hash buckets, where binary search finds those that occur in other
   shards too; a bit per anchor goes back.  A string whose anchor occurs in one
   document only is unique and needs no more work.  The buckets also add up the bytes
   of each anchor's runs; an anchor of more than ``cell_bytes`` is hot.
3. *Suffix arrays.*  The rest (runs of strings with one anchor, equal runs of a shard
   once) go to cells by anchor, so that equal strings meet.  A cell's runs form
   shards of at most ``array_bytes``; for each, a suffix array is built by
   Larsson-Sadakane refinement (sort by 8 bytes, then refine only groups still
   tied, doubling the depth until no tie is left) and common prefixes are found in text
   order from Kasai's bound.  Neighbours with ``LENGTH`` bytes in common are one string;
   its smallest document id is known.  Equal runs of a cell are one entry: their smallest id settles
   all but the first at once (most repeats are of this kind), and the arrays find the strings that
   different runs share.
   The strings of a hot anchor go one by one to cells of their own, as many as its bytes
   need, by a hash of the whole string: equal strings meet, others spread.
4. *Merging.*  Where a cell has several suffix arrays, each one's sorted strings are
   looked up in the others by binary search, and the smallest id wins.
5. *Removal.*  Byte intervals go back to the shards, which cut their texts.

Hot data: a passage in a third of all documents is one run per shard and anchor,
whatever the number of its copies: a document that is not the run's first in its shard
loses it at once, and only the places in the first (all rows of its id) go to the
cell.  A short phrase with different text around it is a hot anchor, whose strings
spread.  Nothing is dropped or capped.  The number of buckets and cells follows
the input's bytes.  A hot anchor costs about ``LENGTH`` bytes per byte of text that its
strings start at, and one string's entry per shard stays in one cell.

Cases: a null text has no bytes; texts shorter than ``LENGTH`` lose nothing; equal ids
don't remove each other, null ids count as larger than all others; repeated rows
have equal ids, so they stay; an empty table gives an empty result; extra
columns are passed through, output names that clash get a leading underscore.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from grovecast.llm.common import fresh, input_bytes, materialize, tidy

LENGTH, GRAM = 50, 16
SHARD_BYTES, BUCKET_ANCHORS, CELL_BYTES, ARRAY_BYTES = 4 << 20, 1 << 20, 4 << 20, 2 << 20
BLOCK = 1 << 16
ROW_BYTES = 64  # what a row counts beside its text
NO_ID = np.iinfo(np.int64).max
_MULT, _MIX = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9)


# -- anchors --------------------------------------------------------------------
def anchors_of(data: np.ndarray, length: int) -> np.ndarray:
    """The anchor of the ``length``-byte string at every position that has one."""
    h, width = data.astype(np.uint64) + np.uint64(1), 1
    while width < GRAM:
        h = h[:-width] * np.uint64(pow(_MULT, width, 1 << 64)) + h[width:]
        width *= 2
    h ^= h >> np.uint64(31)
    h *= _MIX
    h ^= h >> np.uint64(29)
    span, have = length - GRAM + 1, 1
    while have * 2 <= span:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[:len(h) - (span - have)], h[span - have:]) if span > have else h


def runs(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of neighbouring strings of one document with one anchor:
    first position, number of strings, anchor, document.  ``ends``: where each
    document's bytes end in ``data``."""
    n, out = len(data) - length + 1, []
    for at in range(0, n, BLOCK):
        to = min(at + BLOCK, n)
        a = anchors_of(data[at:to + length - 1], length)
        pos = np.arange(at, to)
        doc = np.searchsorted(ends, pos, "right")
        inside = pos + length <= ends[doc]
        if not inside.any():
            continue
        pos, a, doc = pos[inside], a[inside], doc[inside]
        head = np.ones(len(pos), bool)
        head[1:] = (a[1:] != a[:-1]) | (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)
        first = np.flatnonzero(head)
        out.append((pos[first], np.diff(np.append(first, len(pos))), a[first], doc[first]))
    if not out:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    return tuple(np.concatenate(x) for x in zip(*out))


# -- suffix arrays ----------------------------------------------------------------
def words8(data: np.ndarray) -> np.ndarray:
    """The next 8 bytes at every position as one number (zeros after the end)."""
    pad = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    w = pad[:-1] << np.uint64(8) | pad[1:]
    w = w[:-2] << np.uint64(16) | w[2:]
    return (w[:-4] << np.uint64(32) | w[4:])[:len(data)]


def suffix_array(data: np.ndarray) -> np.ndarray:
    """All positions in the order of their suffixes (Larsson-Sadakane): sorted by
    8 bytes, then only groups that are still tied are sorted again, by the group of
    the position ``h`` further on, with ``h`` doubling until no tie is left."""
    n = len(data)
    w = words8(data)
    sa = np.argsort(w, kind="stable")
    new = np.ones(n, bool)  # where a group begins
    w = w[sa]
    new[1:] = w[1:] != w[:-1]
    del w
    group = np.empty(n, np.int64)
    group[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    at = np.flatnonzero(~(new & np.append(new[1:], True)))  # groups of two or more
    h = 8
    while len(at):
        p = sa[at]
        # a suffix that ends comes before all that go on, the shorter first
        after = np.where(p + h < n, n + group[np.minimum(p + h, n - 1)], n - p)
        key = group[p] * np.int64(2 * n + 1) + after
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[at] = p
        more = np.ones(len(at), bool)
        more[1:] = key[1:] != key[:-1]
        group[p] = np.maximum.accumulate(np.where(more, at, 0))
        at = at[~(more & np.append(more[1:], True))]
        h *= 2
    return sa


def common_prefixes(data: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """Bytes (``cap`` at most) that each suffix shares with its predecessor in ``sa``, by
    Kasai's bound: the prefix at a position is at least the one before it less 1.
    Positions advance in step, ``STRIDE`` apart."""
    stride, n = 16, len(data)
    pad = np.concatenate([data, np.zeros(cap + 16, np.uint8)])
    w = words8(pad)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n + 1, np.int64)  # the last entry stands for "no position before"
    for step in range(min(stride, n)):
        p = np.arange(step, n, stride)
        low = np.maximum(plcp[p - 1] - 1, 0) if step else np.zeros(len(p), np.int64)
        q = before[p]
        live = np.flatnonzero(q >= 0)
        got = np.where(q >= 0, low, 0)
        while len(live):
            a, b, k = p[live], q[live], got[live]
            diff = w[a + k] ^ w[b + k]
            same = leading_bytes(diff)
            room = np.minimum(n - np.maximum(a, b), cap) - k  # up to the text's end
            got[live] = k + np.minimum(same, room)
            live = live[(same == 8) & (room > 8)]
        plcp[p] = got
    return plcp[sa]


def leading_bytes(x: np.ndarray) -> np.ndarray:
    """Zero bytes at the high end of each number."""
    out = np.full(len(x), 8, np.int64)
    for k in range(7, -1, -1):
        out[(x >> np.uint64(8 * (7 - k))) & np.uint64(255) != 0] = k
    return out


class Strings:
    """The strings of some runs: one suffix array, and per string the smallest id."""

    def __init__(self, texts: list[bytes], ids: np.ndarray, length: int):
        self.length = length
        size = np.array([len(t) for t in texts], np.int64)
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        end = np.cumsum(size)
        self.start = end - size
        owner = np.repeat(np.arange(len(texts), dtype=np.int32), size)
        n = len(self.data)
        sa = suffix_array(self.data)
        group = np.cumsum(common_prefixes(self.data, sa, length) < length)
        whole = sa + length <= end[owner[sa]]  # strings that lie in one run
        self.pos, group = sa[whole], group[whole]
        del sa, whole
        new = np.ones(len(group), bool)
        new[1:] = group[1:] != group[:-1]
        self.first = np.flatnonzero(new)  # one entry per different string, sorted
        self.number = np.cumsum(new) - 1
        self.least = np.minimum.reduceat(ids[owner[self.pos]], self.first) if len(self.first) else np.zeros(0, np.int64)
        self.n = n

    def sorted_strings(self) -> np.ndarray:
        """The different strings in order, as fixed-width values (a last byte of 1
        keeps zero bytes at the end apart)."""
        if not len(self.first):
            return np.zeros(0, f"S{self.length + 1}")
        at = self.pos[self.first]
        wide = np.ones((len(at), self.length + 1), np.uint8)
        wide[:, :self.length] = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[at]
        return wide.reshape(-1).view(f"S{self.length + 1}")

    def least_by_position(self) -> np.ndarray:
        """Smallest id of the string at each position (NO_ID where none starts)."""
        out = np.full(self.n, NO_ID, np.int64)
        out[self.pos] = self.least[self.number]
        return out


def merge(parts: list[Strings]) -> None:
    """Smallest ids over several suffix arrays: each one's strings are looked up in
    the others by binary search."""
    tables = [p.sorted_strings() for p in parts]
    least = [p.least.copy() for p in parts]
    for i, mine in enumerate(tables):
        for j, other in enumerate(tables):
            if i == j or not len(mine) or not len(other):
                continue
            at = np.minimum(np.searchsorted(other, mine), len(other) - 1)
            same = other[at] == mine
            least[i][same] = np.minimum(least[i][same], parts[j].least[at[same]])
    for p, x in zip(parts, least):
        p.least = x


def lost_spans(texts: list[bytes], ids: np.ndarray, length: int, array_bytes: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per run that holds a string of a smaller id than its own: the spans (begin, end)
    of bytes that such strings cover."""
    parts, bounds, at = [], [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= array_bytes):
            size += len(texts[to])
            to += 1
        parts.append(Strings(texts[at:to], ids[at:to], length))
        bounds.append((at, to))
        at = to
    if len(parts) > 1:
        merge(parts)
    out = {}
    for p, (a, b) in zip(parts, bounds):
        size = np.array([len(t) for t in texts[a:b]], np.int64)
        hit = np.append(p.least_by_position() < np.repeat(ids[a:b], size), False)
        edge = np.diff(hit.astype(np.int8), prepend=0)
        edge[p.start] = hit[p.start]  # spans end where a run ends
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(hit[:-1] & ~hit[1:] | hit[:-1] & (edge[1:] == 1)) + 1
        owner = np.searchsorted(p.start, begin, "right") - 1
        begin, end = begin - p.start[owner], end - p.start[owner] + length - 1
        cut = np.flatnonzero(np.diff(owner, prepend=-1, append=-1)) if len(owner) else []
        for x, y in zip(cut, cut[1:]):
            out[a + int(owner[x])] = (begin[x:y], end[x:y])
    return out


# -- packing ----------------------------------------------------------------------
def shrink(x: bytes) -> bytes:
    return pa.compress(x, codec="zstd", asbytes=True)


def grow(x, size: int) -> bytes:
    return pa.decompress(x, size, codec="zstd", asbytes=True) if size else b""


def pack_batch(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def unpack_batch(data: bytes | pa.Buffer) -> pa.RecordBatch:
    with pa.ipc.open_stream(data) as r:
        return r.read_next_batch()


def shard_texts(batch: pa.RecordBatch, text: int, key: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array, where each ends, and the ids (null: NO_ID)."""
    ids = batch.column(key).cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
    col = batch.column(text).fill_null("").cast(pa.large_string()).cast(pa.large_binary())
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), ids
    offsets = np.frombuffer(col.buffers()[1], np.int64, len(col) + 1, 8 * col.offset)
    data = np.frombuffer(col.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets[1:] - offsets[0], ids


def run_bytes(data: bytes, first: np.ndarray, count: np.ndarray, which: np.ndarray, often: np.ndarray, length: int) -> np.ndarray:
    """Bytes of the different runs of each anchor (``which`` numbers a run's anchor, ``often``
    has its runs): 0 for an anchor with one run of usual size, ``2 * length`` at most."""
    out = np.zeros(len(often), np.int64)
    size = count + length - 1
    some = np.flatnonzero((often[which] > 1) | (size > 2 * length))
    seen: set[bytes] = set()
    for p, n, k in zip(first[some].tolist(), size[some].tolist(), which[some].tolist()):
        run = data[p:p + n]
        if run not in seen:
            seen.add(run)
            out[k] += n
    return out


def string_hash(words: np.ndarray, pos: np.ndarray, length: int) -> np.ndarray:
    """A hash of the whole string at each position; ``words``: see words8."""
    h = np.zeros(len(pos), np.uint64)
    for at in [*range(0, length - 8, 8), length - 8]:
        h = (h ^ words[pos + at]) * np.uint64(_MULT)
        h ^= h >> np.uint64(29)
    h *= _MIX
    return h ^ (h >> np.uint64(31))


# -- Spark jobs ---------------------------------------------------------------------
def shards_and_cells(docs: DataFrame, id_col: str, text_col: str, length: int, shard_bytes: int, cell_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """The shards, the rows for the cells (``CELLS``), and the number of the first cell of
    single strings.  Cells below 0 hold a shard's spans that are known to go."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be at least {2 * GRAM}")
    total = input_bytes(docs, text_col)
    n_buckets = max(1, round(total * 2 / (length - GRAM + 2) / BUCKET_ANCHORS))
    n_cells = max(1, -(-total // cell_bytes))
    text, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def to_shards(batches):
        from pyspark import TaskContext
        me, k, held, size = TaskContext.get().partitionId() << 32, 0, [], 0

        def shard():
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([pa.array([me + k], pa.int64()), pa.array([pack_batch(whole)], pa.binary())], names=["shard", "rows"])

        for batch in batches:
            ends = np.append(0, np.cumsum(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False) + ROW_BYTES))
            at = 0
            while at < batch.num_rows:  # the row that fills a shard is its last
                to = min(int(np.searchsorted(ends, ends[at] + shard_bytes - size)), batch.num_rows)
                held.append(batch.slice(at, to - at))
                size += int(ends[to] - ends[at])
                at = to
                if size >= shard_bytes:
                    yield shard()
                    k, held, size = k + 1, [], 0
        if held:
            yield shard()

    shards = materialize(docs.mapInArrow(tidy(to_shards), "shard long, rows binary"), "shards")

    def to_anchors(batches):
        for batch in batches:
            for shard, rows in zip(batch.column(0), batch.column(1)):
                shard = shard.as_py()
                data, ends, _ = shard_texts(unpack_batch(rows.as_buffer()), text, key)
                first, count, anchor, _ = runs(data, ends, length)
                a, which, often = np.unique(anchor, return_inverse=True, return_counts=True)
                heavy = run_bytes(data.tobytes(), first, count, which, often, length)
                bucket = ((a >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                a, bucket, heavy = a[order], bucket[order], heavy[order]
                cut = np.searchsorted(bucket, np.arange(n_buckets + 1))
                some = [b for b in range(n_buckets) if cut[b + 1] > cut[b]]
                if some:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(some, pa.int32()), pa.array([shard] * len(some), pa.int64()),
                         pa.array([a[cut[b]:cut[b + 1]].tobytes() for b in some], pa.binary()),
                         pa.array([pairs(np.where(heavy[cut[b]:cut[b + 1]] > 2 * length, heavy[cut[b]:cut[b + 1]], 0)) for b in some], pa.binary())],
                        names=["bucket", "shard", "anchors", "heavy"])

    def shared(table: pa.Table) -> pa.Table:
        """Which of each shard's anchors (sorted) other shards have too, and into how many
        cells the strings of its hot ones go."""
        lists = [np.frombuffer(x, np.uint64) for x in table.column("anchors").to_pylist()]
        size = [np.full(len(x), 2 * length, np.int64) for x in lists]
        for n, x in zip(size, table.column("heavy").to_pylist()):
            at, v = unpairs(x)
            n[at] = v
        every, size = np.concatenate(lists), np.concatenate(size)
        order = np.argsort(every, kind="stable")
        every, size = every[order], size[order]
        head = np.flatnonzero(np.append(True, every[1:] != every[:-1]))
        total = np.add.reduceat(size, head)
        twice = every[head[np.diff(np.append(head, len(every))) > 1]]
        hot = total > cell_bytes
        hot_anchor, n_parts = every[head[hot]], -(-total[hot] * (length // 2) // cell_bytes)
        bits, parts = [], []
        for a in lists:
            bits.append(np.packbits(mask_of(a, twice)).tobytes())
            k = np.zeros(len(a), np.int64)
            is_hot = mask_of(a, hot_anchor)
            k[is_hot] = n_parts[np.searchsorted(hot_anchor, a[is_hot])]
            parts.append(pairs(k))
        return pa.table({"shard": table.column("shard"), "bucket": table.column("bucket"),
                         "bits": pa.array(bits, pa.binary()), "hot": pa.array(parts, pa.binary())})

    anchors = shards.mapInArrow(tidy(to_anchors), "bucket int, shard long, anchors binary, heavy binary")
    marks = anchors.groupBy("bucket").applyInArrow(tidy(shared), "shard long, bucket int, bits binary, hot binary")

    def to_cells(rows: pa.Table, bits: pa.Table) -> pa.Table:
        out = {n: [] for n in CELL_NAMES}
        for shard, packed in zip(rows.column("shard"), rows.column("rows")):
            shard = shard.as_py()
            data, ends, ids = shard_texts(unpack_batch(packed.as_buffer()), text, key)
            first, count, anchor, doc = runs(data, ends, length)
            have = np.unique(anchor)
            bucket = ((have >> np.uint64(40)) % np.uint64(n_buckets)).astype(np.int64)
            seen, n_parts = np.zeros(len(have), bool), np.zeros(len(have), np.int64)
            for b, mask, hot in zip(*(bits.column(c).to_pylist() for c in ("bucket", "bits", "hot"))):
                at = np.flatnonzero(bucket == b)
                seen[at] = np.unpackbits(np.frombuffer(mask, np.uint8), count=len(at)).astype(bool)
                of, k = unpairs(hot)
                n_parts[at[of]] = k
            which = np.searchsorted(have, anchor)
            low, high = np.full(len(have), len(ids)), np.full(len(have), -1)
            np.minimum.at(low, which, doc)
            np.maximum.at(high, which, doc)
            go = np.flatnonzero((seen | (low < high))[which])  # anchors of several documents
            is_hot = n_parts[which[go]] > 0
            single, go = go[is_hot], go[~is_hot]
            n_single = count[single]
            cell = ((anchor[go] >> np.uint64(8)) % np.uint64(n_cells)).astype(np.int64)
            first, count, doc, anchor, parts = (np.append(x[go], np.repeat(x[single], n_single))
                                                for x in (first, count, doc, anchor, n_parts[which]))
            if len(single):  # a run of each string
                one = slice(len(go), None)
                first[one] += np.arange(n_single.sum()) - np.repeat(np.cumsum(n_single) - n_single, n_single)
                count[one] = 1
                part = string_hash(words8(data), first[one], length) % parts[one].astype(np.uint64)
                mixed = (anchor[one] ^ (part + np.uint64(1)) * np.uint64(_MULT)) * _MIX
                cell = np.append(cell, n_cells + (mixed >> np.uint64(2)).astype(np.int64))
            order = np.argsort(cell, kind="stable")
            first, count, doc, cell = first[order], count[order], doc[order], cell[order]
            cut = np.flatnonzero(np.diff(cell, prepend=-1, append=-1)) if len(cell) else []
            raw, gone = data.tobytes(), []
            for a, b in zip(cut, cut[1:]):
                number: dict[bytes, int] = {}
                seg = np.array([number.setdefault(raw[p:p + c + length - 1], len(number))
                                for p, c in zip(first[a:b].tolist(), count[a:b].tolist())], np.int64)
                texts = list(number)
                blob = b"".join(texts)
                pos, owner = first[a:b], ids[doc[a:b]]
                least = np.full(len(texts), NO_ID)
                np.minimum.at(least, seg, owner)
                later = owner > least[seg]  # they lose the whole run, whatever other shards hold
                gone.append(np.stack([pos[later], pos[later] + count[a:b][later] + length - 1]))
                occ = np.concatenate([x[~later] for x in (seg, pos, owner)]).astype("<i8").tobytes()
                for n, v in zip(CELL_NAMES, (int(cell[a]), shard, shrink(blob), len(blob), np.array([len(t) for t in texts], "<u4").tobytes(),
                                             shrink(occ), int((~later).sum()))):
                    out[n].append(v)
            spans = np.concatenate(gone, 1).astype("<u4") if gone else np.zeros((2, 0), "<u4")
            if spans.size:
                for n, v in zip(CELL_NAMES, (-1 - shard, shard, b"", 0, b"", shrink(spans.tobytes()), spans.shape[1])):
                    out[n].append(v)
        return pa.table([pa.array(out[f.name], f.type) for f in CELL_ARROW], schema=CELL_ARROW)

    return shards, shards.groupBy("shard").cogroup(marks.groupBy("shard")).applyInArrow(tidy(to_cells), CELLS), n_cells


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
                   shard_bytes: int = SHARD_BYTES, cell_bytes: int = CELL_BYTES, array_bytes: int = ARRAY_BYTES, whole_chars: bool = False) -> DataFrame:
    """``docs`` with kept (the remaining bytes), n_bytes, n_removed and n_spans appended.
    ``whole_chars``: a UTF-8 character that loses a byte goes as a whole."""
    shards, cells, n_cells = shards_and_cells(docs, id_col, text_col, length, shard_bytes, cell_bytes)
    text, key = docs.columns.index(text_col), docs.columns.index(id_col)

    def find(table: pa.Table) -> pa.Table:
        """Byte intervals to remove, per shard."""
        number: dict[bytes, int] = {}
        least: list[int] = []
        seen = []
        out = {"shard": [], "begin": [], "end": []}
        for k in range(table.num_rows):
            r = {c: table.column(c)[k].as_py() for c in table.schema.names}
            if r["cell"] < 0:
                spans = grow(r["places"], 8 * r["n_places"])
                for n, v in zip(out, (r["shard"], spans[:4 * r["n_places"]], spans[4 * r["n_places"]:])):
                    out[n].append(v)
                continue
            sizes = np.frombuffer(r["sizes"], "<u4").astype(np.int64)
            blob = grow(r["texts"], r["n_bytes"])
            ends = np.cumsum(sizes)
            mine = np.array([number.setdefault(blob[b - s:b], len(number)) for b, s in zip(ends.tolist(), sizes.tolist())], np.int64)
            seg, pos, ids = np.frombuffer(grow(r["places"], 24 * r["n_places"]), "<i8").reshape(3, -1)
            least += [NO_ID] * (len(number) - len(least))
            seen.append((r["shard"], mine[seg], pos, ids))
        low = np.array(least, np.int64)
        for _, seg, _, ids in seen:
            np.minimum.at(low, seg, ids)
        texts = list(number)
        size = np.array([len(t) for t in texts], np.int64)
        # of each run's smallest document; single strings hold no other
        spans = lost_spans(texts, low, length, array_bytes) if texts and table.column("cell")[0].as_py() < n_cells else {}
        losing = np.zeros(len(texts), bool)
        losing[list(spans)] = True
        for shard, seg, pos, ids in seen:
            later = ids > low[seg]
            begin, end = [pos[later]], [pos[later] + size[seg[later]]]
            for k in np.flatnonzero(~later & losing[seg]).tolist():
                a, b = spans[int(seg[k])]
                begin.append(pos[k] + a)
                end.append(pos[k] + b)
            begin, end = np.concatenate(begin), np.concatenate(end)
            if len(begin):
                out["shard"].append(shard)
                out["begin"].append(begin.astype("<u4").tobytes())
                out["end"].append(end.astype("<u4").tobytes())
        return pa.table({"shard": pa.array(out["shard"], pa.int64()), "begin": pa.array(out["begin"], pa.binary()),
                         "end": pa.array(out["end"], pa.binary())})

    found = cells.groupBy("cell").applyInArrow(tidy(find), "shard long, begin binary, end binary")
    names = fresh(docs, "kept", "n_bytes", "n_removed", "n_spans")
    schema = StructType([*docs.schema.fields, *[StructField(n, k) for n, k in zip(names, (BinaryType(), LongType(), LongType(), LongType()))]])

    def cut_texts(rows: pa.Table, spans: pa.Table) -> pa.Table:
        tables = []
        begin = np.frombuffer(b"".join(spans.column("begin").to_pylist()), "<u4")
        stop = np.frombuffer(b"".join(spans.column("end").to_pylist()), "<u4")
        for packed in rows.column("rows"):
            batch = unpack_batch(packed.as_buffer())
            data, ends, _ = shard_texts(batch, text, key)
            depth = np.bincount(begin, minlength=len(data) + 1) - np.bincount(stop, minlength=len(data) + 1)
            gone = np.cumsum(depth[:-1]) > 0
            if whole_chars and len(data):
                char = np.flatnonzero((data & 0xC0) != 0x80)
                gone = np.repeat(np.logical_or.reduceat(gone, char), np.diff(np.append(char, len(data))))
            kept, sizes, removed, n_spans = [], [], [], []
            for a, b in zip(np.append(0, ends[:-1]), ends):
                g = gone[a:b]
                k = int(g.sum())
                kept.append(data[a:b][~g].tobytes() if k else data[a:b].tobytes())
                sizes.append(int(b - a))
                removed.append(k)
                n_spans.append(int(g[0]) + int((g[1:] & ~g[:-1]).sum()) if k else 0)
            more = [pa.array(kept, pa.binary()), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64())]
            tables.append(pa.Table.from_arrays([*batch.columns, *more], names=schema.names))
        return pa.concat_tables(tables)

    return shards.groupBy("shard").cogroup(found.groupBy("shard")).applyInArrow(tidy(cut_texts), schema)


def mask_of(a: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which values of ``a`` are in the sorted ``twice``, by binary search."""
    hit = np.zeros(len(a), bool)
    at = np.searchsorted(twice, a)
    ok = at < len(twice)
    hit[ok] = twice[at[ok]] == a[ok]
    return hit


def pairs(values: np.ndarray) -> bytes:
    """Where the values above 0 are, and these."""
    at = np.flatnonzero(values > 0)
    return np.stack([at, values[at]]).astype("<i8").tobytes()


def unpairs(x: bytes) -> tuple[np.ndarray, np.ndarray]:
    at, values = np.frombuffer(x, "<i8").reshape(2, -1)
    return at, values


CELLS = "cell long, shard long, texts binary, n_bytes long, sizes binary, places binary, n_places long"
CELL_ARROW = pa.schema([("cell", pa.int64()), ("shard", pa.int64()), ("texts", pa.binary()), ("n_bytes", pa.int64()),
                        ("sizes", pa.binary()), ("places", pa.binary()), ("n_places", pa.int64())])
CELL_NAMES = CELL_ARROW.names


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, **how) -> DataFrame:
    """``docs`` (its own columns) with the repeated passages cut out of the texts; bytes
    of characters that were cut in two go too.  A text of which nothing is left is
    dropped; one that was empty before stays."""
    names = fresh(docs, "kept", "n_bytes", "n_removed", "n_spans")
    got = remove_repeats(docs, id_col, text_col, length, whole_chars=True, **how)
    text = F.when(F.col(names[2]) == 0, F.col(text_col)).otherwise(F.col(names[0]).cast("string"))
    got = got.where((F.col(names[2]) == 0) | (F.col(names[2]) < F.col(names[1])))
    return got.select(*[text.alias(c) if c == text_col else F.col(c) for c in docs.columns])
