"""Token-id files: canonical length-limited Huffman coding in blocks.

Documents are encoded with a public tokenizer, an end id is appended, and the ids
of all documents are counted.  From the global counts (one row per id of the
vocabulary, a fixed bound) the driver makes code lengths of at most ``MAX_BITS``
with package-merge and canonical codes, which need no more than the lengths.

File format: a Parquet table of blocks in ascending id order.  A block is
self-contained: ``doc_ids``, ``n_tokens`` and ``n_bytes`` per document, ``marks`` (checkpoints:
the bit offset, from the document's first byte, of every ``MARK``-th id), and the
``payload`` (each document starts on a byte).  ``part`` and ``block`` give the order.  A
second, small table holds the code lengths.  Blocks close at ``BLOCK_TOKENS`` ids; a
longer document has a block to itself.

Reading decodes blocks independently.  Inside a block, all checkpoints are
decoded in step: each step looks up the next ``MAX_BITS`` bits of every lane in one
table that gives the id and its length.

Cases: a null text counts as empty (only the end id); null document ids come
first, equal document ids are ordered by number and hash of their ids; an empty table gives no
blocks and an empty result; extra columns are not read.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StructField, StructType
from pyspark.sql.window import Window

from grovecast.llm.bpe import byte_alphabet
from grovecast.llm.common import broadcast_text, tidy, tokenizer_json, worker_memory
from grovecast.session import ensure_checkpoint_dir
from grovecast.sources.fixtures import remove_at_exit

MAX_BITS, MARK, BLOCK_TOKENS, MEMORY = 16, 256, 1 << 18, 800_000
#: Characters that normalization only lower-cases (no combining mark can follow).
_PLAIN = re.compile("[\t-\r -~\xa1-\xff]*")
#: The word pattern of the file: fixed value.
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same pattern where only plain characters in lower case occur, the most frequent kinds first.
_LETTER, _NUMBER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
_PIECE = re.compile(rf"[{_LETTER}]+|[{_NUMBER}]|'(?:s|t|re|ve|m|ll|d)|[^\s{_LETTER}{_NUMBER}]+")


class _Known(dict):
    """Word or piece -> ids; an unknown one is encoded on its first use.  Beyond ``most`` the older half
    goes, but for those that were used since: they move to the newer half when they are met."""

    def __init__(self, encode, most: int):
        super().__init__()
        self.encode, self.half, self.old = encode, max(1, most // 2), {}

    def __missing__(self, key: str) -> bytes:
        ids = self.old.get(key)
        if ids is None:
            ids = self.encode(key)
        if len(self) >= self.half:
            self.old = dict(self)
            self.clear()
        self[key] = ids
        return ids


class WordEncoder:
    """Ids of a tokenizer whose words never cross white space: each distinct word, and each piece of the
    word pattern in it, is encoded once, bounded memories keep their ids (``width``: see id_width)."""

    def __init__(self, text: str, memory: int = MEMORY, width: str = "<u4"):
        import json

        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(text)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.width = width
        self.pack = struct.Struct("<H" if width == "<u2" else "<I").pack
        self.known, self.pieces = _Known(self._word, memory), _Known(self._piece, memory // 2)
        conf = json.loads(text)
        self.special = [t["content"] for t in conf.get("added_tokens") or []]
        kinds = [n["type"] for n in (conf.get("normalizer") or {}).get("normalizers", [])]
        pre = [p.get("pattern", {}).get("Regex") for p in (conf.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: whether this is the file that the short way below is right for
        self.short_way = kinds == ["NFC", "Replace", "Lowercase"] and pre[:1] == [_WORD]
        self.letter = {b: c for c, b in byte_alphabet().items()}

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned integers."""
        if not text:
            return b""
        if not self.short_way or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.width).tobytes()
        return b"".join(map(self.known.__getitem__, text.lower().split()))

    def _word(self, word: str) -> bytes:
        if word.isalpha():
            return self.pieces[word]
        return b"".join(map(self.pieces.__getitem__, _PIECE.findall(word)))

    def _piece(self, piece: str) -> bytes:
        if not piece.isascii():  # bytes stand for themselves or for another character
            piece = piece.encode().decode("latin-1").translate(self.letter)
        got = self.lib.model.tokenize(piece)
        return self.pack(got[0].id) if len(got) == 1 else b"".join([self.pack(t.id) for t in got])


# -- Huffman code -------------------------------------------------------------
def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Length-limited Huffman lengths by package-merge (0 for ids that don't occur)."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    n = len(used)
    if n <= 2:
        lengths[used] = 1
        return lengths
    bits = max(max_bits, int(n - 1).bit_length())
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    is_leaf, row = [], leaves
    for _ in range(bits):
        # a level: the leaves and the pairs of the level below, by weight
        if is_leaf:
            pairs = row[:len(row) // 2 * 2].reshape(-1, 2).sum(1)
            both = np.concatenate([leaves, pairs])
            at = np.argsort(both, kind="stable")
            row, flag = both[at], at < n
        else:
            flag = np.ones(n, bool)
        is_leaf.append(flag)
    take, depth = 2 * n - 2, np.zeros(n, np.uint8)
    for flag in reversed(is_leaf):
        leaf = int(flag[:take].sum())
        depth[:leaf] += 1
        take = 2 * (take - leaf)
    lengths[order] = depth
    return lengths


def canonical_codes(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of (length, id)."""
    codes = np.zeros(len(lengths), np.uint32)
    code = prev = 0
    for i in np.lexsort((np.arange(len(lengths)), lengths)):
        n = int(lengths[i])
        if n:
            code <<= n - prev
            codes[i], prev = code, n
            code += 1
    return codes


def decode_table(lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Next bits -> id, and -> code length."""
    bits = int(lengths.max(initial=1))
    ids, lens = np.zeros(1 << bits, np.uint32), np.ones(1 << bits, np.uint8)
    for i in np.flatnonzero(lengths):
        a = int(codes[i]) << (bits - int(lengths[i]))
        b = a + (1 << (bits - int(lengths[i])))
        ids[a:b], lens[a:b] = i, lengths[i]
    return ids, lens, bits


def pack(ids: np.ndarray, count: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """The bits of documents of ``count`` ids each, every document on a byte of its own: the bytes, how many
    of them each document has, the bit offset of every MARK-th id from its document's
    first byte, and how many of these each document has."""
    n = lengths[ids].astype(np.int64)
    end = np.concatenate([[0], np.cumsum(n)])
    first = np.cumsum(count) - count
    bits = end[first + count] - end[first]
    size = (bits + 7) // 8
    base = np.cumsum(size) - size
    start = end[:-1] - np.repeat(end[first], count)  # from the document's first bit
    marks = -(-count // MARK)
    nth = np.arange(int(marks.sum())) - np.repeat(np.cumsum(marks) - marks, marks)
    at = start[np.repeat(first, marks) + nth * MARK]
    total = int(size.sum())
    out = np.zeros(total + 4, np.uint8)
    if len(ids):
        byte = np.repeat(base, count) + (start >> 3)
        word = codes[ids].astype(np.uint32) << (32 - n - (start & 7)).astype(np.uint32)
        head = np.flatnonzero(np.append(True, byte[1:] != byte[:-1]))  # ids that begin in one byte
        word, byte = np.bitwise_or.reduceat(word, head), byte[head]
        for k in range(4):
            out[byte + k] |= (word >> np.uint32(24 - 8 * k)).astype(np.uint8)
    return out[:total].tobytes(), size, at, marks


def unpack(payload: bytes, at: np.ndarray, count: np.ndarray, table) -> np.ndarray:
    """Ids of the lanes that begin at bit ``at`` and hold ``count`` ids, in lane order."""
    syms, lens, bits = table
    data = np.concatenate([np.frombuffer(payload, np.uint8), np.zeros(4, np.uint8)]).astype(np.uint32)
    word = (data[:-3] << np.uint32(24)) | (data[1:-2] << np.uint32(16)) | (data[2:-1] << np.uint32(8)) | data[3:]
    order = np.argsort(-count, kind="stable")
    pos, left = at[order].astype(np.int64), count[order]
    first = (np.cumsum(count) - count)[order]
    out = np.zeros(int(count.sum()), np.uint32)
    mask, high = np.uint32((1 << bits) - 1), np.int64(32 - bits)
    for step in range(int(left[0]) if len(left) else 0):
        live = int(np.searchsorted(-left, -step, "left"))  # lanes with more than ``step`` ids
        p = pos[:live]
        code = (word[p >> 3] >> (high - (p & 7)).astype(np.uint32)) & mask
        out[first[:live] + step] = syms[code]
        pos[:live] = p + lens[code]
    return out


# -- Spark jobs ---------------------------------------------------------------
def token_rows(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (little-endian, two bytes where the vocabulary allows, else four); after the documents
    of a task, one row with counts: how often each id occurs in them (``<i8`` by id), without a document."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("_text"))
    model = broadcast_text(spark, tokenizer_json(tokenizer_path))
    width = id_width(tokenizer_path, end_id)

    def run(batches):
        memory = worker_memory()
        if memory.get("word_file") != (model.value, width):
            memory |= {"word_file": (model.value, width), "word_encoder": WordEncoder(model.value, width=width)}
        enc = memory["word_encoder"]
        end, counts, kind = np.array([end_id], width).tobytes(), np.zeros(0, np.int64), None
        for whole in batches:
            kind = whole.column(0).type
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [enc.encode(t) + end if t else end for t in batch.column(1).to_pylist()]
                got = np.bincount(np.frombuffer(b"".join(ids), width), minlength=len(counts))
                got[:len(counts)] += counts
                counts = got
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary()), pa.nulls(len(ids), pa.binary())], names=["doc_id", "ids", "counts"])
        if kind is not None:
            yield pa.RecordBatch.from_arrays([pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.array([counts.astype("<i8").tobytes()], pa.binary())],
                                             names=["doc_id", "ids", "counts"])

    return src.mapInArrow(tidy(run), StructType([src.schema["doc_id"], StructField("ids", BinaryType()), StructField("counts", BinaryType())]))


def new_store(spark: SparkSession) -> str:
    """A new folder for a store below the shared checkpoint folder, removed when the application ends."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-store-{uuid.uuid4().hex[:12]}"
    remove_at_exit(spark, path)
    return path


def id_width(tokenizer_path: str, end_id: int) -> str:
    from tokenizers import Tokenizer
    size = max(Tokenizer.from_file(tokenizer_path).get_vocab_size(with_added_tokens=True), end_id + 1)
    return "<u2" if size <= 1 << 16 else "<u4"


def id_counts(rows: DataFrame) -> np.ndarray:
    """Global counts by id from the tasks' counts; the driver receives one row per id that occurs."""
    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0):
                got = np.frombuffer(x.as_py(), "<i8")
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), np.int64)])
                total[:len(got)] += got
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["id", "n"])

    got = (rows.where("counts is not null").select("counts").mapInArrow(tidy(run), "id long, n long")
           .groupBy("id").agg(F.sum("n").alias("n")).collect())
    counts = np.zeros(max((r["id"] for r in got), default=-1) + 1, np.int64)
    for r in got:
        counts[r["id"]] = r["n"]
    return counts


BLOCK = StructType([StructField("part", IntegerType()), StructField("block", IntegerType()),
                    StructField("doc_ids", ArrayType(LongType())), StructField("n_tokens", ArrayType(LongType())),
                    StructField("n_bytes", ArrayType(LongType())), StructField("marks", ArrayType(LongType())),
                    StructField("payload", BinaryType())])


def write_store(docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id",
                text_col: str = "text") -> None:
    """Encode ``docs`` and write ``path/blocks`` and ``path/lengths`` (see the module text)."""
    spark = docs.sparkSession
    width = id_width(tokenizer_path, end_id)
    # the ids are read after their counts are known: written once, so nothing is encoded again
    # beside them the keys of the order: finding the ranges reads these alone
    (token_rows(docs, tokenizer_path, end_id, id_col, text_col)
     .select(F.col("doc_id").cast("bigint"), "ids", F.length("ids").alias("n"), F.xxhash64("ids").alias("h"), "counts")
     .write.option("compression", "zstd").parquet(f"{path}/ids"))
    written = spark.read.parquet(f"{path}/ids")
    tokens = written.where("ids is not null")
    lengths = code_lengths(id_counts(written))
    (spark.createDataFrame([(lengths.tobytes(),)], "lengths binary").coalesce(1)
     .write.parquet(f"{path}/lengths"))
    code = spark.sparkContext.broadcast((lengths, canonical_codes(lengths)))  # bounded by the vocabulary

    # equal document ids may be many: a hash of the ids lets the ranges cut between them
    first = F.col("doc_id").asc_nulls_first()
    ordered = (tokens.repartitionByRange(first, F.col("n"), F.col("h"))
               .sortWithinPartitions(first, "n", "h", "ids").select("doc_id", "ids"))

    def blocks(batches):
        from pyspark import TaskContext
        me, k = TaskContext.get().partitionId(), 0
        docs, ids, count, total = [], [], [], 0

        def row():
            lens, codes = code.value
            n = np.array(count, np.int64)
            bits, size, marks, _ = pack(np.frombuffer(b"".join(ids), width), n, lens, codes)
            return pa.RecordBatch.from_pylist([{"part": me, "block": k, "doc_ids": docs, "n_tokens": n, "n_bytes": size,
                                                "marks": marks, "payload": bits}], schema=arrow)
        for batch in batches:
            for doc, x in zip(*[batch.column(c) for c in (0, 1)]):
                x = x.as_py()
                m = len(x) // np.dtype(width).itemsize
                if docs and total + m > BLOCK_TOKENS:
                    yield row()
                    k += 1
                    docs, ids, count, total = [], [], [], 0
                docs.append(doc.as_py())
                ids.append(x)
                count.append(m)
                total += m
        if docs:
            yield row()

    from pyspark.sql.pandas.types import to_arrow_schema
    arrow = to_arrow_schema(BLOCK)
    ordered.mapInArrow(tidy(blocks), BLOCK).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a store: doc_id, start (ids of all documents before), n_tokens
    and ids (little-endian unsigned 32-bit), decoded block by block."""
    lengths = np.frombuffer(spark.read.parquet(f"{path}/lengths").first()["lengths"], np.uint8)
    code = spark.sparkContext.broadcast(lengths)
    stored = spark.read.schema(BLOCK).parquet(f"{path}/blocks")
    # ids before a block: parts first (one row each), then the blocks of a part
    size = stored.select("part", "block", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = (size.groupBy("part").agg(F.sum("n").alias("n"))
             .select("part", before(Window.orderBy("part")).alias("part_start")))
    index = (size.select("part", "block", before(Window.partitionBy("part").orderBy("block")).alias("block_start"))
             .join(parts, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base")))

    def run(batches):
        table = decode_table(code.value, canonical_codes(code.value))
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r] for n in batch.schema.names}
                n = np.array(row["n_tokens"].as_py(), np.int64)
                byte = np.array(row["n_bytes"].as_py(), np.int64)
                lanes = -(-n // MARK)
                doc = np.repeat(np.arange(len(n)), lanes)
                nth = np.arange(len(doc)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
                at = np.array(row["marks"].as_py(), np.int64) + 8 * (np.cumsum(byte) - byte)[doc]
                ids = unpack(row["payload"].as_py(), at, np.minimum(MARK, n[doc] - nth * MARK), table).astype("<u4")
                end = np.cumsum(n)
                raw = [ids[a:b].tobytes() for a, b in zip(end - n, end)]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"].as_py()] * k, pa.int32()), pa.array([row["block"].as_py()] * k, pa.int32()),
                     pa.array(row["doc_ids"].as_py(), pa.int64()), pa.array(end - n, pa.int64()), pa.array(n, pa.int64()),
                     pa.array(raw, pa.binary()), pa.array([zlib.crc32(x) for x in raw], pa.int64())],
                    names=["part", "block", "doc_id", "inside", "n_tokens", "ids", "ids_crc32"])

    rows = stored.mapInArrow(tidy(run), "part int, block int, doc_id long, inside long, n_tokens long, ids binary, ids_crc32 long")
    return (rows.join(index, ["part", "block"])
            .select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids", "ids_crc32"))
