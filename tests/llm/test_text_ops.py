"""Language ID, BPE, quality, token store and decontamination against brute force."""
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from grovecast.llm import bpe, decontamination, language_id, quality, token_store
from grovecast.llm.common import tokenizer_json
from grovecast.llm.queries import QUERIES

SF, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
LIB, LIB_WORD = Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


def u32(ids):
    return np.array(ids, "<u4").tobytes()


def sha(b):
    return hashlib.sha256(b).hexdigest()


# -- BPE ----------------------------------------------------------------------------
def brute_bpe(text):
    ids = LIB.encode(text or "", add_special_tokens=False).ids
    return len(ids), sha(u32(ids)), sha(LIB.decode(ids, skip_special_tokens=False).encode())


def test_bpe_query(spark, docs_rows):
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op6_bpe"](spark, SF).collect()}
    assert got == {d: brute_bpe(t) for d, t, _ in docs_rows}


def test_bpe_edges(spark, edge_docs, no_docs):
    got = bpe.encode_documents(edge_docs, BYTE, decode=True).collect()
    want = Counter((r["doc_id"], brute_bpe(r["text"])) for r in edge_docs.collect())
    assert Counter((r["doc_id"], (r["n_tokens"], sha(r["ids"]), sha(r["decoded"]))) for r in got) == want
    assert bpe.encode_documents(no_docs, BYTE).count() == 0


@pytest.fixture(scope="module")
def small_leaf():
    return bpe.Codec(tokenizer_json(BYTE), leaf=24)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(list("abcthe  '!sd123\n\t\x1c  éü日本🙂") + ["ing", "'re", "  ", "aaaa", "<|endoftext|>"]), max_size=40).map("".join))
def test_bpe_matches_library(small_leaf, text):
    assert small_leaf.encode(text) == u32(LIB.encode(text, add_special_tokens=False).ids)


@pytest.mark.parametrize("alphabet", ["ab", "the", "aeiou", "0123456789", "!?'-", " ", "日本語", "é", "abc'1!", "\n "])
def test_tree_concatenation(alphabet):
    """Long unsplit text, cut into many small leaves."""
    rng = random.Random(alphabet)
    codec = bpe.Codec(tokenizer_json(BYTE), leaf=50)
    for n in (51, 400, 3000):
        text = "".join(rng.choice(alphabet) for _ in range(n))
        assert codec.tree(text).tolist() == LIB.encode(text, add_special_tokens=False).ids
        text = alphabet * (n // len(alphabet))
        if len(text) > 50:
            assert codec.tree(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


# -- token store --------------------------------------------------------------------
def brute_store(rows):
    out, start = [], 0
    for d, t in rows:
        ids = LIB_WORD.encode(t or "", add_special_tokens=False).ids + [2]
        out.append((d, start, len(ids), zlib.crc32(u32(ids))))
        start += len(ids)
    return out


def test_store_query(spark, docs_rows):
    got = sorted(tuple(r) for r in QUERIES["op8_token_store"](spark, SF).collect())
    assert got == brute_store([(d, t) for d, t, _ in sorted(docs_rows)])


def test_store_edges(spark, edge_docs, no_docs, tmp_path):
    token_store.write_store(edge_docs, f"file://{tmp_path}/s", WORD, 2)
    got = token_store.read_store(spark, f"file://{tmp_path}/s").collect()
    one = lambda t: (u32(LIB_WORD.encode(t or "", add_special_tokens=False).ids + [2]))
    assert Counter((r["doc_id"], bytes(r["ids"]), r["ids_crc32"]) for r in got) == Counter(
        (r["doc_id"], one(r["text"]), zlib.crc32(one(r["text"]))) for r in edge_docs.collect())
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order[0] is None and order[1:] == sorted(order[1:])
    token_store.write_store(no_docs, f"file://{tmp_path}/e", WORD, 2)
    assert token_store.read_store(spark, f"file://{tmp_path}/e").count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=2000), st.integers(9, 16))
def test_huffman_round_trip(values, limit):
    ids = np.array(values)
    counts = np.bincount(ids) ** 4
    lengths = token_store.code_lengths(counts, limit)
    used = lengths[lengths > 0].astype(int)
    assert used.max() <= limit and sum(2.0 ** -used) <= 1
    codes = token_store.canonical_codes(lengths)
    cuts = np.array([0, len(ids) // 3, len(ids) // 3, len(ids) // 2, len(ids)])  # documents, one of them empty
    count = np.diff(cuts)
    bits, size, at, marks = token_store.pack(ids, count, lengths, codes)
    assert marks.tolist() == [-(-int(c) // token_store.MARK) for c in count] and sum(size) == len(bits)
    table, lane, byte = token_store.decode_table(lengths, codes), 0, 0
    for a, b, k, m in zip(cuts, cuts[1:], size, marks):  # each document by itself
        n = np.minimum(token_store.MARK, (b - a) - np.arange(m) * token_store.MARK)
        assert token_store.unpack(bits[byte:byte + k], at[lane:lane + m], n, table).tolist() == values[a:b]
        lane, byte = lane + m, byte + k


def test_known_words_keep_what_is_used():
    seen = []
    known = token_store._Known(lambda p: seen.append(p) or p.encode(), 8)
    for k in range(40):
        assert known["often"] == b"often" and known[f"once{k}"] == f"once{k}".encode()
    assert seen.count("often") == 1 and len(seen) == 41 and len(known) + len(known.old) <= 9


def test_plain_pieces_are_the_pattern():
    import regex
    plain = [chr(c) for c in range(256) if token_store._PLAIN.fullmatch(chr(c))]
    rng = random.Random(3)
    for _ in range(3000):
        t = "".join(rng.choice(plain + ["'s", "'re", "'ll", "don't", " "]) for _ in range(rng.randrange(30))).lower()
        assert token_store._PIECE.findall(t) == regex.findall(token_store._WORD, t)


def test_huffman_is_optimal_without_limit():
    import heapq
    rng = np.random.default_rng(1)
    counts = rng.integers(1, 1000, 200)
    heap, total = list(counts.tolist()), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        total += s
        heapq.heappush(heap, s)
    assert int((token_store.code_lengths(counts, 30).astype(int) * counts).sum()) == total


def test_word_encoder_matches_library():
    enc = token_store.WordEncoder(tokenizer_json(WORD))
    assert enc.short_way
    for t in ["It's THE  Ünïted 12 states!\n'Tis 've <|endoftext|> x", "é́ İ Σς \x1c   z", "ß ª º µ × ÷ \xad\xb2\xbd", "a\x85b"]:
        assert enc.encode(t) == u32(LIB_WORD.encode(t, add_special_tokens=False).ids)


# -- quality ------------------------------------------------------------------------
def brute_quality(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    grams = Counter(tuple(words[i:i + 3]) for i in range(len(words) - 2))
    hit = {i + k for i in range(len(words) - 2) if grams[tuple(words[i:i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit), n < 50 or 100 * len(hit) > 50 * n)


def test_quality_query(spark):
    rows = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, SF_MID).collect()}
    assert {k: tuple(r)[1:7] for k, r in got.items()} == {k: brute_quality(r["text"]) for k, r in rows.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got.values())
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect()}
    good = [k for k, q in labels.items() if q == 1 and not got[k]["base_failed"]]
    assert np.mean([got[k]["kept"] for k in good]) >= 0.99


def test_quality_sketch_quantiles(spark):
    """Quantiles from the sketch are within its relative error of the exact ones."""
    rng = np.random.default_rng(3)
    v = np.exp(rng.normal(0, 1, 5000))
    df = spark.createDataFrame([("en", "s", float(x), 0.0, 0.0, 0.0, 9, 9, 9, False) for x in v],
                               "lang string, source string, word_length double, symbol_ratio double, dup_line_ratio double, repeat_ratio double, "
                               "word_chars long, n_lines long, n_words long, base_failed boolean")
    q = {r["measure"]: r for r in quality.quantiles(quality.sketches(df), ["lang", "source"]).collect()}
    exact = np.quantile(v, [0.5, 0.8], method="inverted_cdf")
    assert q["word_length"]["p50"] == pytest.approx(exact[0], rel=quality.FINE - 1)
    assert q["word_length"]["p80"] == pytest.approx(exact[1], rel=quality.FINE - 1)
    assert q["symbol_ratio"]["p80"] == 0.0


def brute_fences(v):
    """(up, twice as far up, low, twice as far down) per measure from the exact quantiles of a group's rows: the
    four measures, characters, lines and words."""
    p = lambda x, q: sorted(x)[max(0, -(-len(x) * q // 100) - 1)]
    length, symbols, dup, rep, chars, lines, words = zip(*v)
    mid = p(length, 50)
    up, down = max(8 * (p(length, 75) - mid), 0.05), max(8 * (mid - p(length, 25)), 0.05)
    out = [(mid + up, mid + 2 * up, mid - down, mid - 2 * down)]
    for x, event in ((symbols, 8 / p(chars, 50)), (dup, 4 / p(lines, 50)), (rep, 54 / p(words, 50))):
        out.append((p(x, 80) + event, p(x, 80) + 2 * event, -1.0, -1.0))
    return out


def brute_verdicts(measured, min_rows=200):
    """doc_id -> (failed measures, True if a measure is too near its fence for the sketch's error).
    ``measured``: doc_id -> (lang, source, measures), of documents that pass the base rules."""
    names, most = ["word_length", "symbol_ratio", "dup_line_ratio", "repeat_ratio"], [9e9, 0.5, 0.7, 0.4]
    levels = {}
    for lang, source, v in measured.values():
        for key in ((lang, source), (lang,), ()):
            levels.setdefault(key, []).append(v)
    fence = {k: (len(v), brute_fences(v)) for k, v in levels.items()}
    out = {}
    for doc, (lang, source, v) in measured.items():
        own, lng, all_ = fence[lang, source], fence[lang,], fence[()]
        failed, near = [], False
        for k, m in enumerate(names):
            a, b, c = own[1][k], lng[1][k], all_[1][k]
            wide = c[1] if k else 9e9  # lengths differ by language
            if own[0] >= min_rows:
                high, low = min(a[0], b[1], wide, most[k]), max(a[2], b[3])
            elif lng[0] >= min_rows:
                high, low = min(b[0], wide, most[k]), b[2]
            else:
                high, low = min(c[0], most[k]), c[2]
            if v[k] > high or v[k] < low:
                failed.append(m)
            # a quantile is off by 2 %, that of the word length by 0.2 %, of which the distance is taken 8 times
            near |= abs(v[k] - high) < 0.04 * high or low > 0 and abs(v[k] - low) < 0.04 * low
        out[doc] = (failed, near)
    return out


def brute_measures(text):
    n, chars, symbols, dup, hit, base = brute_quality(text)
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    return base, (chars / max(n, 1), symbols / max(chars, 1), dup / max(lines, 1), hit / max(n, 1), chars, lines, n)


def test_quality_kept_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").collect()
    got = {r["doc_id"]: r for r in QUERIES["op7_quality_rules"](spark, SF_MID).collect()}
    measured = {r["doc_id"]: (r["lang"], r["source"], m[1]) for r in docs if not (m := brute_measures(r["text"]))[0]}
    want = brute_verdicts(measured)
    sure = [d for d, (_, near) in want.items() if not near]
    assert len(sure) > 0.9 * len(want)
    assert {d: list(got[d]["failed"]) for d in sure} == {d: want[d][0] for d in sure}
    assert all(got[d]["kept"] == (d in want and not got[d]["failed"]) for d in got)
    bad = [r["doc_id"] for r in spark.read.parquet(f"{SF_MID}/labels.parquet").where("quality = 0").collect()]
    assert len(bad) > 50 and not any(got[d]["kept"] for d in bad)
    assert not any(got[d]["kept"] for d, (_, _, v) in measured.items() if v[1] > 0.1)


def test_quality_fences_follow_the_groups(spark):
    """Fences differ from group to group, few lie on a constant, and a group's noise moves its own."""
    measured = quality.with_measures(quality.with_counts(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")))
    sketch = quality.sketches(measured).cache()
    rows = quality.fences(sketch, min_rows=60).collect()
    constants = {v[3] for v in quality.SHARES.values()}
    for m in quality.MEASURES:
        found = [r[f"{m}_fence"] for r in rows]
        assert len(set(found)) >= 3 and sum(x in constants for x in found) < len(found) / 3
    rng = np.random.default_rng(4)
    kinds = ("lang string, source string, word_length double, symbol_ratio double, dup_line_ratio double, repeat_ratio double, "
             "word_chars long, n_lines long, n_words long, base_failed boolean")
    v, rep = rng.normal(0, 0.1, 600), rng.exponential(0.02, 600)

    def fence(noise, words):
        own = [("en", "a", 5 + noise * float(x), 0.0, 0.0, noise * float(y), 5 * words, 9, words, False) for x, y in zip(v, rep)]
        rest = [("en", "b", 5 + float(x), 0.0, 0.0, float(y), 1500, 9, 300, False) for x, y in zip(v, rep)]
        got = quality.fences(quality.sketches(spark.createDataFrame(own + rest, kinds)))
        return got.where("f_source = 'a'").first()
    one, two, short = fence(1.0, 300), fence(1.8, 300), fence(1.0, 200)
    assert two["word_length_fence"] > one["word_length_fence"] + 0.2 and two["word_length_low"] < one["word_length_low"] - 0.2
    assert two["repeat_ratio_fence"] > one["repeat_ratio_fence"] + 0.015
    assert short["symbol_ratio_fence"] > 1.3 * one["symbol_ratio_fence"] and short["repeat_ratio_fence"] > one["repeat_ratio_fence"]


def test_quality_group_of_junk_sets_no_rules(spark):
    """A group with more junk than a quarter, and a group of short or long words."""
    def doc(i, size):
        return " ".join(f"{(i * 1009 + k) % 100000:0{size}d}" for k in range(60))
    rows = [(i, doc(i, 5), "en", "clean") for i in range(600)]
    rows += [(1000 + i, doc(i, 5) if i % 10 < 6 else doc(i, 5).replace(" ", "$$ "), "en", "junk") for i in range(300)]
    rows += [(2000 + i, doc(i, 9), "fi", "long") for i in range(300)]  # a language's words may be long
    rows += [(3000, " ".join("abcdefghij"[k % 10] for k in range(30)) + " " + " ".join(f"{k}" for k in range(40)), "fi", "long")]
    got = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert {d for d, r in got.items() if not r["kept"]} == {1000 + i for i in range(300) if i % 10 >= 6} | {3000}


def test_quality_edges(spark, edge_docs, no_docs):
    got = quality.judge(edge_docs).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_repeat_words"], r["base_failed"]) for r in got) == Counter(
        (r["doc_id"], *(brute_quality(r["text"])[i] for i in (0, 4, 5))) for r in edge_docs.collect())
    assert quality.judge(no_docs).count() == 0


# -- decontamination ----------------------------------------------------------------
def brute_windows(items, n=10):
    out = {}
    for i, t in items:
        w = brute_words(t)
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            out.setdefault(tuple(w[k:k + size]), set()).add(i)
    return out


def brute_words(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)


def brute_scan(text, windows):
    w = brute_words(text)
    hit, items = set(), set()
    for size in {len(x) for x in windows}:
        for k in range(len(w) - size + 1):
            if (g := tuple(w[k:k + size])) in windows:
                hit |= set(range(k, k + size))
                items |= windows[g]
    ids = sorted(str(i) for i in items if i is not None)
    return len(w), len(hit), len(ids), sha(",".join(ids).encode()), bool(hit)


def test_decontamination_query(spark):
    windows = brute_windows([tuple(r) for r in spark.read.parquet(f"{SF_MID}/benchmark.parquet").select("item_id", "text").collect()])
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet").collect()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op10_decontamination"](spark, SF_MID).collect()}
    assert got == {r["doc_id"]: brute_scan(r["text"], windows) for r in docs}
    assert 0 < sum(r[-1] for r in got.values()) < len(got)


def test_spans_do_not_depend_on_the_parts(spark):
    words = [f"w{i}" for i in range(40)]
    items = [(1, " ".join(words[5:16])), (2, " ".join(words[12:25])), (3, " ".join(words[:5] + words[25:32]))]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "Nothing here."), (3, None)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    cut = lambda n: {r["doc_id"]: r["text"] for r in decontamination.decontaminate(docs, bench, mode="spans", max_windows=n).collect()}
    want = {1: " ".join(words[:5]) + "  " + " ".join(words[25:]), 2: "Nothing here.", 3: None}
    assert cut(1) == cut(2_000_000) == want


def test_decontamination_edges(spark, edge_docs, no_docs):
    items = [(1, "The same TEXT, of five words and more the same text"), (1, "the same text"), (None, "tie of ids"), (2, ""), (3, None),
             (4, "...")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = brute_windows(items)
    for bound in (2_000_000, 2):  # one part, and many
        got = decontamination.scan_documents(edge_docs, bench, max_windows=bound).select(
            "doc_id", "n_words", F.size("hits"), F.size("items"), F.sha2(F.array_join("items", ","), 256)).collect()
        assert Counter(tuple(r) for r in got) == Counter((r["doc_id"], *brute_scan(r["text"], windows)[:4]) for r in edge_docs.collect())
    assert decontamination.scan_documents(no_docs, bench).count() == 0
    assert decontamination.scan_documents(edge_docs, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    kept = decontamination.decontaminate(edge_docs, bench)
    assert kept.columns == edge_docs.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter(r["doc_id"] for r in edge_docs.collect() if not brute_scan(r["text"], windows)[-1])
    cut = {r["text"] for r in decontamination.decontaminate(edge_docs, bench, mode="spans").collect() if r["doc_id"] == 7}
    assert "a  with another text" in cut


# -- language id --------------------------------------------------------------------
def test_language_query(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()}
    got = QUERIES["op5_language_id"](spark, SF_MID).collect()
    assert len(got) == len(truth)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) >= 0.98
    assert np.mean([r["rejected"] for r in got]) <= 0.01


def test_language_edges(spark, edge_docs, no_docs):
    model = language_id.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    got = language_id.identify(edge_docs, model)
    assert got.columns == [*edge_docs.columns, "lang_pred", "_score", "rejected"]
    pred = {(r["doc_id"], r["text"]): (r["lang_pred"], r["rejected"]) for r in got.collect()}
    for k in ((3, None), (4, ""), (5, " \n\t "), (6, "1234 !!! ???")):
        assert pred[k] == ("und", True)
    assert all(v[0] != "und" for k, v in pred.items() if k[1] and re.search("[a-z]", k[1]))
    assert language_id.identify(no_docs, model).count() == 0
    none = language_id.fit(no_docs)
    assert {r["lang_pred"] for r in language_id.identify(edge_docs, none).collect()} == {"und"}


def test_language_sample_is_bounded(spark):
    docs = spark.read.parquet(f"{SF_MID}/documents.parquet")
    rows = language_id.sample(docs, F.lit(True), 40).collect()
    assert len(rows) == 40 and set(Counter(r["lang"] for r in rows).values()) == {10}


def test_windows_at_the_bound():
    """A part at ``max_windows`` of words that all differ stays within the stated size."""
    import pickle
    import tracemalloc
    n = decontamination.MAX_WINDOWS // 10
    text = b" ".join(b"w%d" % i for i in range(n + 9))
    tracemalloc.start()
    windows = decontamination.WindowSet([("item", text)], 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(windows.tables[0][1]) == n and 10 * peak < 1_500_000_000
    assert 10 * len(pickle.dumps(windows.state())) < 200_000_000
    hit, items = windows.scan(decontamination.words_of(b"x " + text[:2000].rpartition(b" ")[0] + b" y"))
    assert items == {"item"} and not hit[0] and not hit[-1] and hit[1:-1].all()


def test_an_item_larger_than_a_part(spark):
    """Items cut into pieces give the hits of the whole."""
    rng = random.Random(8)
    item = " ".join(f"i{rng.randrange(50)}" for _ in range(400))
    docs = spark.createDataFrame([(k, " ".join(item.split()[a:a + 37]) + " and more") for k, a in enumerate(range(0, 360, 9))], "doc_id long, text string")
    bench = spark.createDataFrame([("big", item), ("small", "one two three")], "item_id string, text string")
    got = lambda n: sorted((r["doc_id"], r["hits"], r["items"]) for r in decontamination.scan_documents(docs, bench, max_windows=n).collect())
    assert got(50) == got(10_000) and all(len(h) >= 37 for _, h, _ in got(50))


def test_language_sample_of_long_texts_is_bounded(spark):
    """Thousands of long labelled texts: the driver receives at most 6 bytes per bucket of each."""
    text = " ".join(f"word{i * 7919 % 100003}x" for i in range(3000))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit(text), F.col("id")).alias("text"), (F.col("id") % 3).cast("string").alias("lang"))
    docs = docs.unionByName(docs.where("doc_id < 50"))  # repeated rows
    rows = language_id.training_rows(language_id.sample(docs, F.lit(True), 3000))
    assert len({r["doc"] for r in rows}) == 3000 and len(rows) == 4 * 3000
    assert max(len(r["ids"]) + len(r["share"]) for r in rows) <= 6 * language_id.BUCKETS


def test_language_prediction_by_hand(spark):
    """Prediction and score from the fitted table, n-gram by n-gram."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    clean = lambda raw: b" " + b" ".join(bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in raw).split()) + b" "
    checked = 0
    for doc, r in got.items():
        raw = (r["text"] or "").encode()
        if not raw or len(raw) > 3000 or not language_id.has_letter(raw):
            continue
        c, z, k = clean(raw), np.array(model.bias, np.float64), 0
        total = np.zeros(len(model.langs))
        for i in range(len(c)):
            h = c[i]
            for n in (2, 3, 4):
                if i + n > len(c):
                    break
                h = (h * 0x01000193 + c[i + n - 1] + n) % 2**32
                x = h * 0x9E3779B1 % 2**32
                total += model.table[(x ^ x >> 15) & language_id.BUCKETS - 1]
                k += 1
        z = (z + total / max(1, k)) / model.temperature
        e = np.exp(z - z.max())
        assert r["lang_pred"] == model.langs[int(e.argmax())] and r["score"] == pytest.approx(e.max() / e.sum(), abs=1e-6)
        checked += 1
    assert checked > 50
