"""BPE encoding and decoding of whole texts with a public tokenizer file.

Ids are those of the ``tokenizers`` library, also for its special tokens.  Texts are
cut where the byte-level pattern always cuts (before white space that follows
something else), and the library encodes each distinct piece once per worker: a
bounded memory of pieces keeps their ids.

Long unsplit text (a piece of more than ``leaf`` characters, such as a blob without
spaces) is encoded by tree concatenation.  Its parts are encoded in one parallel
batch of the library and joined pairwise, level by level.  At each join, a window
around the cut is encoded again, and grows until it shares a token (same place,
same id) with the left side and one with the right side; then the left ids up
to the shared token, the window's ids between, and the right ids from there on
are the ids of the whole.  That is exact: BPE inside a piece is determined by
which neighbours can stand together, and every pair of neighbours in the result
is one that the library itself produced side by side.  A window that reaches
both ends is simply the whole text, so the growth always ends.

Cases: a null text counts as empty and has no ids; empty texts have no ids and
decode to the empty text; very long texts are handled in pieces; repeated rows
and null ids are kept as they are; extra columns are kept by ``encode_documents`` only
if named in ``keep``; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from grovecast.llm.common import broadcast_text, tidy, tokenizer_json, worker_memory

LEAF, WINDOW, MEMORY = 4096, 64, 400_000
#: White space of the pattern's ``\s`` (Unicode White_Space): fixed values.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_CHUNK = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
_WS_SPACE = re.compile(f"[{_WS}] ")


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the rest are
    numbered from U+0100 in order."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file (given as its JSON text)."""

    def __init__(self, text: str, leaf: int = LEAF, memory: int = MEMORY):
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_str(text)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.leaf, self.memory = leaf, memory
        conf = json.loads(text)
        added = conf.get("added_tokens") or []
        self.special = {t["content"]: t["id"] for t in added}
        pre = conf.get("pre_tokenizer") or {}
        plain = all(not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in added)
        #: whether texts may be cut before white space (byte-level with its pattern, no normalizer)
        self.cuttable = (plain and conf.get("normalizer") is None and pre.get("type") == "ByteLevel"
                         and pre.get("use_regex") and not pre.get("add_prefix_space"))
        alphabet = byte_alphabet()
        size = self.lib.get_vocab_size(with_added_tokens=True)
        self.bytes_of: list[bytes] = [b""] * size
        for token, i in self.lib.get_vocab(with_added_tokens=False).items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self._split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    # -- encoding -----------------------------------------------------------
    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if not self.cuttable:
            return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if self._split_special is not None and any(s in text for s in self.special):
            parts = self._split_special.split(text)  # leftmost, longest; odd parts are special
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if i % 2 else self._ordinary(p)
                            for i, p in enumerate(parts))
        return self._ordinary(text)

    def _ordinary(self, text: str) -> bytes:
        if not text:
            return b""
        if "  " in text or _WS_SPACE.search(text):
            pieces = _CHUNK.findall(text)
        else:  # every space follows something else: cut before each
            pieces = text.split(" ")
            pieces[1:] = [" " + p for p in pieces[1:]]
        known = self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            pass
        if len(known) > self.memory:
            known.clear()
        new = list({p for p in pieces if p not in known})
        short = [p for p in new if len(p) <= self.leaf]
        got = {p: np.array(e.ids, "<u4").tobytes() for p, e in zip(short, self._batch(short))}
        long = {p: self.tree(p).astype("<u4").tobytes() for p in new if len(p) > self.leaf}
        known.update(got)
        return b"".join([long[p] if p in long else known[p] for p in pieces])

    def _batch(self, texts: list[str], parallel: bool = False) -> list:
        """Encoded by the library, in its threads only where that pays: each thread has
        memory of its own, and the pieces of common texts are far too short."""
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if parallel else "false"
        return self.lib.encode_batch_fast(texts, add_special_tokens=False)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.int64) for e in self._batch(texts, parallel=len(texts) > 1)]

    def tree(self, text: str) -> np.ndarray:
        """Ids of a long text without certain cuts, by tree concatenation."""
        n = -(-len(text) // self.leaf)
        cuts = [len(text) * i // n for i in range(n + 1)]
        parts = [text[a:b] for a, b in zip(cuts, cuts[1:])]
        nodes = list(zip([p.encode() for p in parts], self._ids(parts)))
        while len(nodes) > 1:
            joined = [self._join(*nodes[i], *nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = joined + nodes[len(nodes) // 2 * 2:]
        return nodes[0][1]

    def _join(self, left: bytes, a: np.ndarray, right: bytes, b: np.ndarray) -> tuple[bytes, np.ndarray]:
        text, cut = left + right, len(left)
        a_end, b_end = np.cumsum(self.lengths[a]), cut + np.cumsum(self.lengths[b])
        a_start, b_start = a_end - self.lengths[a], b_end - self.lengths[b]
        starts_char = lambda p: p >= len(text) or (text[p] & 0xC0) != 0x80 and text[p] != 0x27
        width = WINDOW
        while True:
            lo, hi = int(np.searchsorted(a_start, cut - width, "right")) - 1, int(np.searchsorted(b_end, cut + width))
            while lo > 0 and not starts_char(int(a_start[lo])):
                lo -= 1
            while hi < len(b) and not starts_char(int(b_end[hi])):
                hi += 1
            at = int(a_start[lo]) if lo > 0 else 0
            to = int(b_end[hi]) if hi < len(b) else len(text)
            w = self._ids([text[at:to].decode()])[0]
            w_end = at + np.cumsum(self.lengths[w])
            w_start = w_end - self.lengths[w]
            # the last token shared with the left side, the first shared with the right
            i = j = None
            if at == 0:
                i = (0, 0)
            else:
                _, x, y = np.intersect1d(a_start[lo:], w_start, return_indices=True)
                same = (a[lo:][x] == w[y]) & (w_end[y] <= cut)
                if same.any():
                    k = int(np.flatnonzero(same)[-1])
                    i = (lo + int(x[k]) + 1, int(y[k]) + 1)
            if to == len(text):
                j = (len(b), len(w))
            else:
                _, x, y = np.intersect1d(b_start[:hi + 1], w_start, return_indices=True)
                same = (b[:hi + 1][x] == w[y]) & (w_start[y] >= cut)
                if same.any():
                    k = int(np.flatnonzero(same)[0])
                    j = (int(x[k]), int(y[k]))
            if i and j:
                return text, np.concatenate([a[:i[0]], w[i[1]:j[1]], b[j[0]:]])
            width *= 2

    # -- decoding -----------------------------------------------------------
    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text; bytes that form no character are replaced."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode()


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",),
                     decode: bool = False, leaf: int = LEAF, memory: int = MEMORY, resident: bool = True) -> DataFrame:
    """``keep``, n_tokens, ids (little-endian unsigned 32-bit) and, if ``decode``,
    decoded (UTF-8 bytes of the text decoded from those ids).  ``memory``: distinct
    pieces whose ids a worker keeps; ``resident``: whether its encoder outlives the task
    (less work), or leaves its memory to the stages that follow."""
    spark = docs.sparkSession
    src = docs.select(*keep, docs[text_col].alias("_text"))
    model = broadcast_text(spark, tokenizer_json(tokenizer_path))
    fields = [*src.schema.fields[:-1], StructField("n_tokens", LongType()), StructField("ids", BinaryType())]
    fields += [StructField("decoded", BinaryType())] * decode
    width = len(keep)

    def run(batches):
        held = worker_memory() if resident else {}
        if held.get("codec_file") != (model.value, leaf, memory):
            held |= {"codec_file": (model.value, leaf, memory), "codec": Codec(model.value, leaf, memory)}
        codec = held["codec"]
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                ids = [codec.encode(t) if t else b"" for t in batch.column(width).to_pylist()]
                cols = [*batch.columns[:width], pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    cols.append(pa.array([codec.decode(x) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in fields])

    return src.mapInArrow(tidy(run), StructType(fields))
