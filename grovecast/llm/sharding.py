"""Sharding into files of near equal size by histogram sort (native).

Rows are ordered by a key, and the key space is cut at splitters so that every
shard holds about the same number of bytes.  The splitters are found without
sorting: each round counts, in one aggregate over a narrow key table, the
exact bytes in the cells between candidate boundaries (key prefixes); cells
that hold a wanted splitter and are larger than the tolerance, and cells too
large for one task, get finer candidates in the next round.  Then the rows are
exchanged once.

The key is a 96-digit hex string: MD5 of the text, the id, and a row number that
is fixed when the key table is written.  Equal texts are therefore neighbours; a
group of equal texts is cut only where it is larger than the tolerance (a hot
group may hold a third of all rows).  A cell that shares a long prefix jumps
straight to the first digit in which its keys differ.

What the driver reads per round is bounded by the parameters: at most
``16 ** FIRST`` cells first, then ``16 ** STEP`` children of at most
``n_shards - 1`` splitter cells and ``4 * n_shards`` cells heavy by bytes or by rows.

Cases: a null text has no bytes and sorts as the empty text; a null id sorts
before all ids; repeated rows are told apart by the row number; an empty table
gives an empty result.  Input columns other than the id are not read unless
named in ``carry``.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate
from os.path import commonprefix

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grovecast.llm.common import materialize

FIRST, STEP = 3, 2
HEX = 16


def _hex(c: Column) -> Column:
    return F.lpad(F.hex(c), HEX, "0")


def key_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_overhead: int = 8,
              carry: tuple[str, ...] = ()) -> DataFrame:
    """One narrow row per document: id, size, text_crc32, key (and ``carry``)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + F.lit(row_overhead)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("_hash"),
        F.monotonically_increasing_id().alias("_row"),
        *[F.col(c).alias(f"carry_{c}") for c in carry])
    ordered_id = F.coalesce(F.col("doc_id").cast("bigint").bitwiseXOR(F.lit(-(2**63))), F.lit(0).cast("bigint"))
    key = F.concat(F.upper("_hash"), F.when(F.col("doc_id").isNull(), "0").otherwise("1"),
                   _hex(ordered_id), _hex(F.col("_row")))
    return rows.select("doc_id", "size", "text_crc32", key.alias("key"), *[f"carry_{c}" for c in carry])


def _cell(refined: list[dict[str, int]]) -> Column:
    """A row's cell: the key prefix of the deepest round that refined it."""
    cell = F.substring("key", 1, FIRST)
    for level in refined:
        nxt = cell
        for width in sorted(set(level.values())):
            names = [p for p, w in level.items() if w == width]
            nxt = F.when(cell.isin(names), F.substring("key", 1, width)).otherwise(nxt)
        cell = nxt
    return cell


def find_splitters(keys: DataFrame, n_shards: int, tolerance: float) -> tuple[list[str], list[dict[str, int]]]:
    """Key boundaries between the shards, and the cells refined in each round."""
    def count(df: DataFrame, cell: Column) -> dict[str, tuple[int, int, str, str]]:
        got = df.groupBy(cell.alias("c")).agg(F.sum("size"), F.count(F.lit(1)), F.min("key"), F.max("key"))
        return {r[0]: (r[1], r[2], r[3], r[4]) for r in got.collect()}

    cells = count(keys, _cell([]))
    total, n_rows = sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
    goals = [total * i / n_shards for i in range(1, n_shards)]
    refined: list[dict[str, int]] = []
    while True:
        names = sorted(cells)
        edges = list(accumulate(cells[n][0] for n in names))
        holders = {names[min(bisect_left(edges, g), len(names) - 1)] for g in goals} if names else set()
        limit = tolerance * total / n_shards
        level = {}
        for n in names:
            size, rows, low, high = cells[n]
            large = size > total / (2 * n_shards) or rows > n_rows / (2 * n_shards)
            if rows > 1 and (large or n in holders and size > limit):
                level[n] = len(commonprefix([low, high])) + STEP
        if not level:
            break
        inside = keys.where(_cell(refined).isin(list(level)))
        refined.append(level)
        finer = count(inside, _cell(refined))
        cells = {n: c for n, c in cells.items() if n not in level} | finer
    # a splitter is the edge of a cell that lies nearest to its goal
    starts = [0, *edges[:-1]] if names else []
    splitters = []
    for g in goals if names else []:
        i = min(bisect_left(edges, g), len(names) - 1)
        if g - starts[i] > edges[i] - g:
            i += 1
        splitters.append(names[i] if i < len(names) else "~")
    return splitters, refined


def histogram_shards(docs: DataFrame, n_shards: int, id_col: str = "doc_id", text_col: str = "text",
                     row_overhead: int = 8, tolerance: float = 0.01, carry: tuple[str, ...] = ()) -> DataFrame:
    """Columns doc_id, size, text_crc32, shard, slot (and ``carry_*``): slots
    number the rows of a shard in key order without gaps."""
    keys = materialize(key_table(docs, id_col, text_col, row_overhead, carry), "shard-keys")
    splitters, refined = find_splitters(keys, n_shards, tolerance)
    shard = sum((F.col("key") >= F.lit(s)).cast("int") for s in splitters) if splitters else F.lit(0)
    placed = keys.select("*", shard.alias("shard"), _cell(refined).alias("cell"))
    # slots: rows are numbered per cell, cells are offset by what lies before them in their shard
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (placed.groupBy("shard", "cell").agg(F.count(F.lit(1)).alias("n"))
               .select("shard", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    inside = Window.partitionBy("shard", "cell").orderBy("key")
    return (placed.withColumn("rank", F.row_number().over(inside))
            .join(offsets, ["shard", "cell"])
            .select("doc_id", "size", "text_crc32", F.col("shard").cast("int").alias("shard"),
                    (F.col("offset") + F.col("rank") - 1).cast("bigint").alias("slot"),
                    *[c for c in keys.columns if c.startswith("carry_")]))


def write_shards(sharded: DataFrame, path: str) -> None:
    """Write the placed rows, one folder per shard."""
    sharded.write.partitionBy("shard").parquet(path)
