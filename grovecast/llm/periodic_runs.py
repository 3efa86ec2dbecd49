"""Periodic runs of words: passages in which a phrase repeats itself again and again.

A run is a maximal stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal) that is at least ``max(MIN_WORDS, MIN_TURNS * q)`` words long and that no
neighbouring word extends.  Every text is one unit of work:

1. Words become numbers.  A run implies that some stretch of ``SEED`` words stands twice,
   so a text whose ``SEED``-word windows all differ (by a 64-bit hash: equal windows
   never differ in it) has none and is done.
2. *Suffix array* over the word numbers: positions are sorted by word, then only tied
   groups are refined by the group ``h`` words further on, with ``h`` doubling.  The ranks of each
   round are kept; common prefixes (LCP) of neighbours in the array are read from them,
   longest strides first.
3. *Descending Kruskal.*  The neighbours' LCPs are taken from the largest down, and each
   unites two classes of suffixes (union-find) whose positions are held in order.  When
   two classes meet at LCP ``l``, every two positions ``i < j`` that become neighbours in the
   united class agree on exactly ``l`` words.  With ``d = j - i``, a stretch of ``l + d`` words from ``i`` has
   period ``d``, and no smaller one, or another position of the class would lie between them.  It
   ends where ``i`` and ``j`` stop to agree, so if it is long enough and the word before can't
   extend it, it is a run.  Every run is found so: its first two turns are neighbours at the
   moment they meet.
   LCPs below ``SEED`` can't give a run and are not united.

Position classes are lists of sorted blocks, so uniting costs about the square root of a class
per position even for a text that is one word a million times.

Cases: a null text has no words; words are runs of anything but ASCII white space; runs may
overlap, each counts; equal ids and repeated rows are texts of their own; an empty table gives
an empty result; other columns are passed through, output names that clash get a leading
underscore.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from grovecast.llm.common import fresh, tidy

MIN_WORDS, MIN_TURNS = 6, 4
#: Least number of words that two turns of a run have in common: max(MIN_WORDS - q, (MIN_TURNS - 1) * q) over all q.
SEED = min(max(MIN_WORDS - q, (MIN_TURNS - 1) * q) for q in range(1, MIN_WORDS + 1))
BLOCK = 2048
_MULT = 0x9E3779B97F4A7C15


def word_numbers(words: list[bytes]) -> np.ndarray:
    number: dict[bytes, int] = {}
    return np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))


def may_repeat(ids: np.ndarray, size: int = SEED) -> bool:
    """Whether two windows of ``size`` words may be equal (never a false no)."""
    if len(ids) <= size:
        return False
    h = np.zeros(len(ids) - size + 1, np.uint64)
    x = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(_MULT)
    x ^= x >> np.uint64(29)
    for k in range(size):
        h = h * np.uint64(_MULT) + x[k:k + len(h)]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


# -- suffix array and common prefixes --------------------------------------------------
def suffix_order(ids: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Positions in the order of their suffixes, and the ranks of each round: equal ranks
    of round ``k`` mean ``2**k`` equal words (a position too near the end for them is alone)."""
    n = len(ids)
    sa = np.argsort(ids, kind="stable")
    key = ids[sa]
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ranks = [rank.astype(np.int32)]
    at = np.flatnonzero(~(new & np.append(new[1:], True)))
    h = 1
    while len(at):
        p = sa[at]
        after = np.where(p + h < n, n + rank[np.minimum(p + h, n - 1)], n - p)  # the end comes first, the shorter before
        key = rank[p] * np.int64(2 * n + 1) + after
        order = np.argsort(key, kind="stable")
        p, key = p[order], key[order]
        sa[at] = p
        new = np.ones(len(at), bool)
        new[1:] = key[1:] != key[:-1]
        rank[p] = np.maximum.accumulate(np.where(new, at, 0))
        ranks.append(rank.astype(np.int32))
        at = at[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, ranks


def common_prefixes(a: np.ndarray, b: np.ndarray, ranks: list[np.ndarray]) -> np.ndarray:
    """Equal words from each two positions on, the longest strides first."""
    n = len(ranks[0])
    a, b, got = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    for k in range(len(ranks) - 1, -1, -1):
        inside = np.maximum(a, b) < n
        same = np.flatnonzero(inside)[ranks[k][a[inside]] == ranks[k][b[inside]]]
        got[same] += 1 << k
        a[same] += 1 << k
        b[same] += 1 << k
    return got


# -- ordered classes of positions --------------------------------------------------------
class Positions:
    """A sorted set of positions in blocks."""

    __slots__ = ("blocks", "last", "size")

    def __init__(self, position: int):
        self.blocks, self.last, self.size = [[position]], [position], 1

    def around(self, x: int) -> tuple[int, int]:
        """The neighbours of a position that is not in the set (-1: none)."""
        k = bisect_left(self.last, x)
        if k == len(self.last):
            return self.last[-1], -1
        block = self.blocks[k]
        i = bisect_left(block, x)
        return (block[i - 1] if i else self.last[k - 1] if k else -1), block[i]

    def add(self, x: int) -> None:
        k = min(bisect_left(self.last, x), len(self.last) - 1)
        block = self.blocks[k]
        insort(block, x)
        self.size += 1
        if len(block) > BLOCK:
            half = len(block) // 2
            self.blocks[k:k + 1] = [block[:half], block[half:]]
            self.last[k:k + 1] = [block[half - 1], block[-1]]
        else:
            self.last[k] = block[-1]

    def __iter__(self):
        for block in self.blocks:
            yield from block


def unite(large: Positions, small: Positions) -> list[tuple[int, int]]:
    """Put ``small`` into ``large``; the pairs that become neighbours, one of each set."""
    met, members = [], list(small)
    for k, x in enumerate(members):
        low, high = large.around(x)
        if low >= 0 and (k == 0 or members[k - 1] < low):
            met.append((low, x))
        if high >= 0 and (k + 1 == len(members) or members[k + 1] > high):
            met.append((x, high))
    for x in members:
        large.add(x)
    return met


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start, then period."""
    if not may_repeat(ids):
        return []
    sa, ranks = suffix_order(ids)
    lcp = common_prefixes(sa[:-1], sa[1:], ranks)
    some = np.flatnonzero(lcp >= SEED)
    some = some[np.argsort(-lcp[some], kind="stable")]
    root: dict[int, int] = {}
    members: dict[int, Positions] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    word, out = ids.tolist(), []
    for a, b, size in zip(sa[some].tolist(), sa[some + 1].tolist(), lcp[some].tolist()):
        a, b = find(a), find(b)
        x, y = members.pop(a, None) or Positions(a), members.pop(b, None) or Positions(b)
        if x.size < y.size:
            a, b, x, y = b, a, y, x
        root[b] = a
        members[a] = x
        for i, j in unite(x, y):
            d = j - i
            if size >= (MIN_TURNS - 1) * d and size + d >= MIN_WORDS and (i == 0 or word[i - 1] != word[j - 1]):
                out.append((i, size + d, d))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first turn."""
    if not runs:
        return words
    n = len(words)
    depth = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(depth[:n]) == 0).tolist()]


# -- Spark job -----------------------------------------------------------------------------
RUN = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])


def find_runs(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with n_words, runs (by start, then period) and collapsed (the words outside of
    repeated turns, one space between them) appended; without the text if not ``keep_text``."""
    from pyspark.sql.pandas.types import to_arrow_type
    col = docs.columns.index(text_col)
    names = fresh(docs, "n_words", "runs", "collapsed")
    stay = [i for i in range(len(docs.columns)) if keep_text or i != col]
    kinds = (LongType(), ArrayType(RUN), StringType())
    schema = StructType([*[docs.schema.fields[i] for i in stay], *[StructField(n, k) for n, k in zip(names, kinds)]])

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                part = whole.slice(at, 256)
                n, found, left = [], [], []
                for t in part.column(col):
                    words = t.as_py().encode().split() if t.is_valid else []  # bytes: exactly the ASCII white space
                    got = runs_of(word_numbers(words))
                    n.append(len(words))
                    found.append([dict(zip(("start", "length", "period"), r)) for r in got])
                    left.append(b" ".join(collapsed(words, got)))
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(i) for i in stay], pa.array(n, pa.int64()), pa.array(found, to_arrow_type(kinds[1])),
                     pa.array(left, pa.binary()).cast(pa.string())], names=schema.names)

    return docs.mapInArrow(tidy(run), schema)


def longest_exponent(runs: Column) -> Column:
    """The run with the greatest length / period (exactly compared; ties: smallest start, then
    period), null without runs.  ``runs`` is in order, so the first of equals stays."""
    def better(best: Column, run: Column) -> Column:
        return F.when(run["length"] * best["period"] > best["length"] * run["period"], run).otherwise(best)
    return F.aggregate(runs, F.get(runs, F.lit(0)), better)


def with_planted_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` where the texts of a tenth of the ids (by crc32) end in a repeated phrase; the
    other texts, and those of null ids, stay as they are."""
    h = F.crc32(F.col(id_col).cast("string").cast("binary"))
    words, = fresh(docs, "words")
    some = docs.withColumn(words, F.when(h % 10 == 0, F.filter(F.split(text_col, r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    n, g = F.size(words).cast("bigint"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    moved = F.transform(F.sequence(F.lit(0).cast("bigint"), n - 1),
                        lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")))
    text = F.when(n > 0, F.array_join(moved, " ")).otherwise(F.col(text_col))
    return some.withColumn(text_col, text).drop(words)
