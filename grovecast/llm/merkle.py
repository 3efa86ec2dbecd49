"""Merkle manifest of a dataset: a hash tree per group, one over the groups, and a proof per row.

A row's leaf is H of its fields (see :func:`leaf`).  In a group (a ``source``) leaves ascend by
id; ``ARITY`` consecutive nodes at a time become their H until one is left, the subroot.  The
subroots, in the order of their groups, give the root the same way.  H is SHA-256
over the concatenated lowercase hex digests.  The tree is built without sorting rows:

1. *Bitmaps.*  Every task turns its rows' ids into compressed bitmaps: per group and chunk of
   ``2**CHUNK`` ids, the low bits as a sorted array or, if they are many, as a bit set, and
   the ids that occur more than once.  They are merged per (group, chunk).
2. *Directories.*  A merged bitmap gets a popcount directory (set bits before each 64-bit word).
   The chunks' totals are summed in digits of ``DIGIT`` bits, so that no task adds up more
   than ``2**DIGIT`` narrow rows, whatever the ids: each chunk knows how many leaves of its group come before it.
3. *Rank queries.*  Rows meet their chunk's bitmap; chunk base, directory and a masked
   popcount give a row's coordinate.  Ids that occur more than once (known from the bitmaps)
   are ranked among themselves by the same index over the leading 64 bits of their leaves;
   equal rows are counted and dealt out.
4. *Slot arrays.*  Coordinate ``p`` belongs to slot ``p % WIDTH`` of block ``p // WIDTH``
   (``WIDTH = ARITY**LEVELS``).  A block's rows are scattered into its slots and ``LEVELS`` levels of
   the tree are reduced at once; the blocks' nodes are the next round's leaves.
5. *Proofs.*  From the root down, every block hands each slot the siblings on its way up.

A hot group is many chunks and blocks; a hot id is pre-aggregated into a count.  The number of
rounds is the logarithm of the largest group, the only figure that the driver receives.

Cases: ids are bigint (others are refused); null fields count as ``-``; a null group comes first, null
ids come before all others of their group, equal ids are ordered by leaf, and rows of which
all fields are equal are leaves of their own; an empty text is a text; an empty table gives an
empty result; only the fields and the carried columns are read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from grovecast.llm.common import materialize, tidy
from grovecast.llm.suffix_dedup import pack_batch, unpack_batch

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
ARITY, LEVELS = 3, 7
WIDTH = ARITY ** LEVELS
#: bits of a chunk; the bits above it in digits
CHUNK, DIGITS, DIGIT = 12, 3, 18
SET_BYTES = 1 << CHUNK - 3
ARRAY_MOST = SET_BYTES // 2 - 1  # an array is always shorter than a bit set, which tells them apart
FLUSH = 1 << 20


# -- hashing ------------------------------------------------------------------------
def leaf(*values: Column) -> Column:
    """Digest of a row's fields: each is ``-`` if null, else its UTF-8 byte count, ``:`` and its text."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def parent(children: list[str]) -> str:
    return hashlib.sha256("".join(children).encode()).hexdigest()


def levels_of(nodes: list[str], depth: int | None) -> list[list[str]]:
    """The nodes and the levels above them: ``depth`` of these, or (None) until one node is left."""
    out = [nodes]
    while len(out) <= depth if depth is not None else len(out[-1]) > 1:
        low = out[-1]
        out.append([parent(low[i:i + ARITY]) for i in range(0, len(low), ARITY)])
    return out


def steps_of(level: list[str]) -> list[bytes]:
    """For each node of a level, its step of a proof: place in the run, number of siblings, their digests."""
    out = []
    for at in range(0, len(level), ARITY):
        run = [bytes.fromhex(x) for x in level[at:at + ARITY]]
        out += [bytes((k, len(run) - 1)) + b"".join(run[:k] + run[k + 1:]) for k in range(len(run))]
    return out


def siblings(proof: bytes) -> list[tuple[int, list[str]]]:
    """The steps of a proof, from the leaf up: (place in the run, digests of the siblings)."""
    out, at = [], 0
    while at < len(proof):
        k, n = proof[at], proof[at + 1]
        out.append((k, [proof[at + 2 + 32 * i:at + 34 + 32 * i].hex() for i in range(n)]))
        at += 2 + 32 * n
    return out


def fold(digest: str, proof: bytes) -> str:
    """The root that a leaf and its proof lead to."""
    for k, others in siblings(proof):
        digest = parent([*others[:k], digest, *others[k:]])
    return digest


# -- bitmaps ------------------------------------------------------------------------
def compress(low: np.ndarray) -> bytes:
    """Distinct low bits as a sorted array or, if they are many, as a bit set."""
    if len(low) <= ARRAY_MOST:
        return np.unique(low).astype("<u2").tobytes()
    bits = np.zeros(1 << CHUNK, np.uint8)
    bits[low] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def expand(packed: bytes) -> np.ndarray:
    """The numbers of a compressed bitmap."""
    if len(packed) < SET_BYTES:
        return np.frombuffer(packed, "<u2").astype(np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(packed, np.uint8), bitorder="little"))


class Index:
    """A chunk's bitmap with its popcount directory; ``more`` holds the ids that occur more
    than once, as pairs (low bits, times less one)."""

    def __init__(self, packed: bytes, more: bytes):
        bits = np.zeros(1 << CHUNK, np.uint8)
        bits[expand(packed)] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.directory = np.cumsum(np.bitwise_count(self.words).astype(np.int64)) - np.bitwise_count(self.words)
        self.low, self.extra = np.frombuffer(more, "<i8").reshape(2, -1)
        self.before = np.append(0, np.cumsum(self.extra))

    def rank(self, low: np.ndarray) -> np.ndarray:
        """How many leaves of the chunk come before these ids."""
        mask = (np.uint64(1) << (low & 63).astype(np.uint64)) - np.uint64(1)
        bits = self.directory[low >> 6] + np.bitwise_count(self.words[low >> 6] & mask)
        return bits + self.before[np.searchsorted(self.low, low)]


def bitmaps(rows: DataFrame, group: list[str]) -> DataFrame:
    """group, chunk, packed, more, n: one row per group and chunk of ``rows`` (group, chunk, low)."""
    kinds = [rows.schema[c] for c in group]
    schema = StructType([*kinds, StructField("chunk", LongType()), StructField("packed", BinaryType()),
                         StructField("more", BinaryType()), StructField("n", LongType())])
    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(schema)
    keys = [*group, "chunk"]

    def row(held: list, count: np.ndarray) -> list:
        low = np.flatnonzero(count)
        twice = low[count[low] > 1]
        return [*held, compress(low), np.stack([twice, count[twice] - 1]).astype("<i8").tobytes(), int(count.sum())]

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), arrow)], schema=arrow)

    def partial(batches):
        held, size = [], 0

        def flush():
            got = pa.Table.from_batches(held).group_by(keys).aggregate([("low", "list")])
            out = []
            for *key, low in zip(*[got.column(c).to_pylist() for c in keys], got.column("low_list").combine_chunks()):
                some, times = np.unique(np.asarray(low.values), return_counts=True)
                more = np.stack([some[times > 1], times[times > 1] - 1]).astype("<i8").tobytes()
                out.append([*key, compress(some), more, int(times.sum())])
                if len(out) == 4096:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
        if held:
            yield from flush()

    def merge(part: pa.Table) -> pa.Table:
        count = np.zeros(1 << CHUNK, np.int64)
        for packed, more in zip(part.column("packed"), part.column("more")):
            count[expand(packed.as_py())] += 1
            low, extra = np.frombuffer(more.as_py(), "<i8").reshape(2, -1)
            count[low] += extra
        return pa.Table.from_batches([batch_of([row([part.column(c)[0].as_py() for c in keys], count)])])

    return (rows.select(*keys, "low").mapInArrow(tidy(partial), schema)
            .groupBy(*keys).applyInArrow(tidy(merge), schema))


def joined(left: DataFrame, right: DataFrame, cols: list[str], how: str = "inner") -> DataFrame:
    """A join in which null equals null; the columns of the right side but its keys."""
    names = {c: f"_r_{c}" for c in cols}
    other = right.select(*[F.col(c).alias(names.get(c, c)) for c in right.columns])
    on = F.lit(True)
    for c in cols:
        on = on & F.col(c).eqNullSafe(F.col(names[c]))
    return left.join(other, on, how).drop(*names.values())


def bases(counts: DataFrame, group: list[str], digits: int = DIGITS) -> DataFrame:
    """group, chunk, base: the sum of n over the chunks of the group before this one (group, chunk, n).
    A window holds the chunks of one parent, ``2**DIGIT`` rows at most."""
    if not digits:
        return counts.select(*group, "chunk", F.lit(0).cast("bigint").alias("base"))
    up = counts.withColumn("up", F.shiftright("chunk", DIGIT))
    before = F.sum("n").over(Window.partitionBy(*group, "up").orderBy(F.col("chunk").asc_nulls_first())
                             .rowsBetween(Window.unboundedPreceding, -1))
    parents = up.groupBy(*group, "up").agg(F.sum("n").alias("n"))
    if digits == 1:  # ids of one sign and the null ids are a parent each
        above = F.sum("n").over(Window.partitionBy(*group).orderBy(F.col("up").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1))
        parents = parents.select(*group, "up", F.coalesce(above, F.lit(0)).alias("base"))
    else:
        parents = bases(parents.withColumnRenamed("up", "chunk"), group, digits - 1).withColumnRenamed("chunk", "up")
    inner = up.select(*group, "up", "chunk", F.coalesce(before, F.lit(0)).alias("inner"))
    return joined(inner, parents, [*group, "up"]).select(*group, "chunk", (F.col("base") + F.col("inner")).alias("base"))


def ranked(rows: DataFrame, group: list[str], key: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Coordinates of ``rows`` within their group by ``key`` (bigint, null first):

    (rows whose key is alone, with pos; the keys that several rows share, with pos and n;
    the group's totals).  ``pos`` counts all rows of smaller keys."""
    rows = rows.withColumns({"chunk": F.shiftright(key, CHUNK), "low": F.coalesce(F.col(key).bitwiseAND(F.lit((1 << CHUNK) - 1)), F.lit(0).cast("bigint"))})
    packed = materialize(bitmaps(rows, group), "bitmaps")
    index = materialize(joined(packed, bases(packed.select(*group, "chunk", "n"), group), [*group, "chunk"]), "index")
    kinds = [rows.schema[c] for c in group]
    from pyspark.sql.pandas.types import to_arrow_schema
    shared = StructType([*kinds, StructField(key, LongType()), StructField("pos", LongType()), StructField("n", LongType())])
    arrow = to_arrow_schema(shared)

    def several(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                at = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                ids = Index(at["packed"], at["more"])
                k = len(ids.low)
                if k:
                    own = ids.low + (at["chunk"] << CHUNK) if at["chunk"] is not None else [None] * k
                    yield pa.RecordBatch.from_arrays([*[pa.array([at[c]] * k, arrow.field(c).type) for c in group], pa.array(own, pa.int64()),
                                                      pa.array(at["base"] + ids.rank(ids.low)), pa.array(ids.extra + 1)], schema=arrow)

    # octet_length of no pair is 0: usually no chunk is read here
    tied = materialize(index.where(F.octet_length("more") > 0).mapInArrow(tidy(several), shared), "tied")
    alone = joined(rows, tied.select(*group, key), [*group, key], "left_anti")
    out = StructType([*[f for f in rows.schema.fields if f.name not in ("chunk", "low")], StructField("pos", LongType())])

    def look_up(part: pa.Table, chunk: pa.Table) -> pa.Table:
        low = part.column("low").to_numpy()
        pos = np.zeros(0, np.int64)
        if chunk.num_rows and len(low):
            pos = chunk.column("base")[0].as_py() + Index(chunk.column("packed")[0].as_py(), chunk.column("more")[0].as_py()).rank(low)
        return part.select(out.names[:-1]).append_column("pos", pa.array(pos, pa.int64()))

    keys = [*group, "chunk"]
    single = alone.groupBy(*keys).cogroup(index.groupBy(*keys)).applyInArrow(tidy(look_up), out)
    return single, tied, index.groupBy(*group).agg(F.sum("n").alias("total"))


def coordinates(leaves: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``leaves`` (grp, id, leaf, ...) with pos, and grp, total."""
    single, tied, totals = ranked(leaves, ["grp"], "id")
    cols = leaves.columns
    if tied.limit(1).count():
        # rows of equal ids: by the leading bits of their leaves
        own = joined(leaves, tied.select("grp", "id", F.col("pos").alias("_first")), ["grp", "id"])
        own = own.withColumn("_lead", F.expr("cast(conv(left(leaf, 15), 16, 10) as bigint)"))
        some, equal, _ = ranked(own, ["grp", "id"], "_lead")
        single = single.unionByName(some.withColumn("pos", F.col("pos") + F.col("_first")).select(*cols, "pos"))
        if equal.limit(1).count():
            # equal leaves are equal rows: counted, then dealt out
            rest = joined(own, equal.select("grp", "id", "_lead", F.col("pos").alias("_from")), ["grp", "id", "_lead"])
            per = rest.groupBy(*cols, "_first", "_from", "_lead").agg(F.count(F.lit(1)).alias("_n"))
            before = F.sum("_n").over(Window.partitionBy("grp", "id", "_lead").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1))
            start = F.col("_first") + F.col("_from") + F.coalesce(before, F.lit(0))
            dealt = per.withColumn("_at", start).withColumn("pos", F.explode(F.sequence(F.col("_at"), F.col("_at") + F.col("_n") - 1)))
            single = single.unionByName(dealt.select(*cols, "pos"))
    return single, totals


def numbered(values: DataFrame, col: str) -> DataFrame:
    """``values`` (distinct) with g: 0, 1, ... in ascending order, null first.  Ranges are numbered on their
    own and shifted by the ranges before them, so no task needs all values."""
    order = F.col(col).asc_nulls_first()
    m = materialize(values.repartitionByRange(order).sortWithinPartitions(order).withColumn("_m", F.monotonically_increasing_id()), "groups")
    part = F.shiftright("_m", 33)
    per = m.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_k"))
    start = F.coalesce(F.sum("_k").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return (m.withColumn("_part", part).join(per.select("_part", start.alias("_start")), "_part")
            .withColumn("g", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_part", "_start"))


# -- slot arrays ----------------------------------------------------------------------
BLOCKS = StructType([StructField("g", LongType()), StructField("block", LongType()), StructField("total", LongType()),
                     StructField("nodes", BinaryType()), StructField("rows", BinaryType()), StructField("node", StringType())])


def hexes(nodes: bytes) -> list[str]:
    text = nodes.hex()
    return [text[i:i + 64] for i in range(0, len(text), 64)]


def blocks_of(nodes: DataFrame) -> DataFrame:
    """One row per block of ``nodes`` (g, total, pos, digest, other columns): its digests and other columns
    by slot, and the node that the block becomes."""
    rest = [c for c in nodes.columns if c not in ("g", "total", "pos", "digest")]

    def fill(part: pa.Table) -> pa.Table:
        pos, total = part.column("pos").to_numpy(), part.column("total")[0].as_py()
        block = int(pos[0]) // WIDTH
        slot = np.empty(len(pos), np.int64)
        slot[pos - block * WIDTH] = np.arange(len(pos))  # a slot's row
        raw = np.frombuffer(bytes.fromhex("".join(part.column("digest").to_pylist())), np.uint8).reshape(-1, 32)[slot]
        other = part.select(rest).take(pa.array(slot)).combine_chunks().to_batches() if rest else []
        top = levels_of(hexes(raw.tobytes()), LEVELS if total > WIDTH else None)[-1][0]
        return pa.table({"g": pa.array([part.column("g")[0].as_py()], pa.int64()), "block": pa.array([block], pa.int64()), "total": pa.array([total], pa.int64()),
                         "nodes": pa.array([raw.tobytes()], pa.binary()), "rows": pa.array([pack_batch(other[0]) if other else None], pa.binary()),
                         "node": pa.array([top], pa.string())})

    named = nodes.withColumn("_block", F.expr(f"pos div {WIDTH}"))
    return named.groupBy("g", "_block").applyInArrow(without(fill, "_block"), BLOCKS)


def without(fn, drop: str):
    def run(part: pa.Table) -> pa.Table:
        return fn(part.drop_columns([drop]))
    return tidy(run)


def build(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The rounds of blocks over ``nodes``; ``most``: the largest total."""
    rounds = [materialize(blocks_of(nodes), "blocks")]
    while most > WIDTH:
        most = -(-most // WIDTH)
        low = rounds[-1].where(F.col("total") > WIDTH)
        rounds.append(materialize(blocks_of(low.select("g", F.expr(f"(total + {WIDTH - 1}) div {WIDTH}").alias("total"), F.col("block").alias("pos"),
                                                       F.col("node").alias("digest"))), "blocks"))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """g, node: the root of each tree."""
    out = None
    for r in rounds:
        done = r.where(F.col("total") <= WIDTH).select("g", "node")
        out = done if out is None else out.unionByName(done)
    return out


ABOVE = StructType([StructField("g", LongType()), StructField("block", LongType()), StructField("above", BinaryType())])


def steps_in(nodes: bytes, total: int) -> list[bytes]:
    """The proof of each slot of a block up to the block's node."""
    levels = levels_of(hexes(nodes), LEVELS if total > WIDTH else None)[:-1]
    steps = [steps_of(level) for level in levels]
    return [b"".join([s[k // ARITY ** i] for i, s in enumerate(steps)]) for k in range(len(nodes) // 32)]


def descend(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """The blocks of the first round with ``above``, the proof of the block's node; ``above`` (g, above):
    the proofs of the trees' roots."""
    way = None
    for k in range(len(rounds) - 1, -1, -1):
        done = rounds[k].where(F.col("total") <= WIDTH).select("g", "block").join(above, "g")
        way = done if way is None else way.unionByName(done)
        here = rounds[k].join(way, ["g", "block"])
        if not k:
            return here

        def down(batches):
            for batch in batches:
                for g, block, total, nodes, up in zip(*[batch.column(c) for c in ("g", "block", "total", "nodes", "above")]):
                    up, first = up.as_py(), block.as_py() * WIDTH
                    steps = [s + up for s in steps_in(nodes.as_py(), total.as_py())]
                    yield pa.RecordBatch.from_arrays([pa.array([g.as_py()] * len(steps), pa.int64()), pa.array(range(first, first + len(steps)), pa.int64()),
                                                      pa.array(steps, pa.binary())], names=ABOVE.names)
        way = here.mapInArrow(tidy(down), ABOVE)
    return way


def proofs(blocks: DataFrame, kept: StructType) -> DataFrame:
    """The rows of blocks (with ``above``) and their proofs: ``kept``, leaf, proof, and the other columns of ``blocks``."""
    own = [c for c in blocks.columns if c not in (*BLOCKS.names, "above")]
    schema = StructType([*kept.fields, StructField("leaf", StringType()), StructField("proof", BinaryType()), *[blocks.schema[c] for c in own]])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                at = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                rows, k = unpack_batch(at["rows"]), len(at["nodes"]) // 32
                yield pa.RecordBatch.from_arrays(
                    [*[rows.column(f.name) for f in kept.fields], pa.array(hexes(at["nodes"])), pa.array([s + at["above"] for s in steps_in(at["nodes"], at["total"])], pa.binary()),
                     *[pa.array([at[c]] * k) for c in own]], names=schema.names)

    return blocks.mapInArrow(tidy(run), schema)


# -- the manifest -----------------------------------------------------------------------
def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "source",
             carry: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: the id, the group, leaf, proof (see :func:`siblings`), subroot, root, and
    ``carry``: further columns by name, computed from ``docs``."""
    if docs.schema[id_col].dataType != LongType():
        raise TypeError(f"{id_col} must be bigint")
    spark = docs.sparkSession
    carry = carry or {}
    leaves = materialize(docs.select(F.col(id_col).alias("id"), F.col(group_col).alias("grp"), leaf(*[F.col(f) for f in fields]).alias("leaf"),
                                     *[c.alias(f"c_{n}") for n, c in carry.items()]), "leaves")
    single, totals = coordinates(leaves)
    groups = materialize(numbered(totals, "grp"), "totals")
    figures = groups.agg(F.coalesce(F.max("total"), F.lit(0)).alias("most"), F.count(F.lit(1)).alias("n")).first()
    kept = [f"c_{n}" for n in carry]
    nodes = joined(single, groups, ["grp"]).select("g", "total", "pos", F.col("leaf").alias("digest"), "id", "grp", *kept)
    rounds = build(nodes, figures["most"])
    subroots = roots(rounds)
    upper = build(subroots.select(F.lit(0).cast("bigint").alias("g"), F.lit(figures["n"]).cast("bigint").alias("total"), F.col("g").alias("pos"),
                                  F.col("node").alias("digest"), F.col("g").alias("tree")), figures["n"])
    top = roots(upper).first()  # one digest
    start = spark.createDataFrame([(0, b"")], "g bigint, above binary")
    # one proof per group: from its subroot to the root
    tops = proofs(descend(upper, start), StructType([StructField("tree", LongType())]))
    tops = tops.select(F.col("tree").alias("g"), F.col("proof").alias("above"), F.col("leaf").alias("subroot"))
    tops = materialize(tops.withColumn("root", F.lit(top and top["node"]).cast("string")), "tops")
    below = descend(rounds, tops.select("g", "above")).join(tops.select("g", "subroot", "root"), "g")
    kinds = StructType([StructField("id", LongType()), StructField("grp", docs.schema[group_col].dataType), *[leaves.schema[c] for c in kept]])
    return proofs(below, kinds).select(F.col("id").alias(id_col), F.col("grp").alias(group_col), "leaf", "proof", "subroot", "root",
                                       *[F.col(f"c_{n}").alias(n) for n in carry])


def verify(rows: DataFrame, leaf_col: str = "leaf", proof_col: str = "proof") -> DataFrame:
    """``rows`` with proof_sha256 (digest of the siblings' digests, from the leaf up) and folded_root
    (what the leaf and the proof lead to) appended."""
    schema = StructType([*rows.schema.fields, StructField("proof_sha256", StringType()), StructField("folded_root", StringType())])
    a, b = rows.columns.index(leaf_col), rows.columns.index(proof_col)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                part = whole.slice(at, 2048)
                digest, folded = [], []
                for own, proof in zip(part.column(a).to_pylist(), part.column(b).to_pylist()):
                    digest.append(parent([x for _, others in siblings(proof) for x in others]))
                    folded.append(fold(own, proof))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(digest, pa.string()), pa.array(folded, pa.string())], names=schema.names)

    return rows.mapInArrow(tidy(run), schema)
