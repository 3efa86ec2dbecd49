"""Suffix-array dedup, n-gram join and the pipeline against brute force."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from grovecast.llm import bpe, decontamination, language_id, ngram_join, suffix_dedup
from grovecast.llm.queries import QUERIES

SF, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sha(b):
    return hashlib.sha256(b).hexdigest()


# -- suffix arrays ------------------------------------------------------------------
def brute_repeats(rows, length=50):
    """Per row: removed mask, by the first document of every string."""
    least = {}
    key = lambda d: (d is None, d or 0)
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i:i + length]
            if s not in least or key(d) < least[s]:
                least[s] = key(d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if least[b[i:i + length]] < key(d):
                gone[i:i + length] = True
        edge = np.diff(np.concatenate([[0], gone.astype(int)]))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((d, len(b), int(gone.sum()), int((edge == 1).sum()), sha(kept)))
    return out


def digest(df):
    return [tuple(r) for r in df.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()]


def test_suffix_query(spark, docs_rows):
    want = Counter(brute_repeats([(d, t) for d, t, _ in docs_rows]))
    assert Counter(tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, SF).collect()) == want
    assert sum(x[2] for x in want) > 0


def test_suffix_query_mid(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF_MID}/documents.parquet").collect()]
    assert Counter(tuple(r) for r in QUERIES["op1_suffix_dedup"](spark, SF_MID).collect()) == Counter(brute_repeats(rows))


@pytest.mark.parametrize("shard,cell,array", [(2000, 3000, 500), (300, 1 << 20, 2000), (1 << 20, 100, 1 << 20)])
def test_suffix_many_shards(spark, docs_rows, shard, cell, array):
    """Small shards, cells and arrays: merging across all of them."""
    rows = [(d, (t or "")[:3000]) for d, t, _ in docs_rows[:60]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = suffix_dedup.remove_repeats(df, shard_bytes=shard, cell_bytes=cell, array_bytes=array)
    assert Counter(digest(got)) == Counter(brute_repeats(rows))


def test_suffix_hot_and_periodic(spark):
    rng = random.Random(5)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(i, "".join(rng.choice("xyz ") for _ in range(rng.randint(0, 90))) + passage * (i % 3 == 0) + "q" * rng.randint(0, 120)) for i in range(90)]
    rows += [(500, "ab" * 400), (501, "ba" * 300), (502, "\x00" * 120), (503, "\x00" * 60 + "é" * 60), (504, passage + "\x00" * 70), (504, passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for how in ({}, {"shard_bytes": 700, "cell_bytes": 900, "array_bytes": 300}):
        assert Counter(digest(suffix_dedup.remove_repeats(df, **how))) == Counter(brute_repeats(rows))


def test_suffix_hot_anchor_spreads(spark):
    """A phrase shorter than a string, with different text around it in every document, and
    a passage in a third of them: no cell holds much more than its bytes, nothing is lost."""
    rng = random.Random(8)
    words = lambda n: "".join(rng.choice("abcdefghijklmnop ") for _ in range(n))
    phrase, passage = words(46), words(200)
    rows = [(i, words(60) + phrase + words(60) + passage * (i % 3 == 0)) for i in range(400)]
    rows += [(1000 + i, words(9) + rows[i][1][40:120] + words(9)) for i in range(0, 400, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    how = {"shard_bytes": 8000, "cell_bytes": 6000}
    _, cells, single = suffix_dedup.shards_and_cells(df, "doc_id", "text", 50, **how)
    held = cells.where("cell >= 0").groupBy("cell").agg(F.sum(F.col("n_bytes") + 24 * F.col("n_places")).alias("b")).collect()
    assert any(r["cell"] >= single for r in held) and max(r["b"] for r in held) < 4 * 6000
    # a run's places: those in its first document of the shard
    n_docs = cells.where("cell >= 0").agg(F.max(F.col("n_places") / (F.length("sizes") / 4))).first()[0]
    assert n_docs == 1
    want = Counter(brute_repeats(rows))
    assert sum(x[2] for x in want) > 0
    assert Counter(digest(suffix_dedup.remove_repeats(df, **how, array_bytes=2000))) == want


def test_suffix_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = suffix_dedup.remove_repeats(edge_docs)
    assert got.columns == [*edge_docs.columns, "kept", "n_bytes", "n_removed", "n_spans"]
    assert Counter(digest(got)) == Counter(brute_repeats(rows))
    assert suffix_dedup.remove_repeats(no_docs).count() == 0
    clash = edge_docs.withColumnRenamed("score", "kept")
    assert "_kept" in suffix_dedup.remove_repeats(clash).columns


def test_deduplicate_keeps_valid_text(spark):
    base = "ü" * 40 + " the middle part of it all " + "日本語" * 20
    rows = [(1, base), (2, "é" + base[1:] + " and more"), (3, base), (4, ""), (5, None)]
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[1] == base and 3 not in out and out[4] == "" and out[5] is None
    assert out[2].startswith("é") and out[2].endswith(" and more") and "�" not in out[2]


def test_deduplicate_keeps_replacement_characters(spark):
    """Only what a repeat covers goes: U+FFFD of the input stays, also where a cut splits a character."""
    base = "the passage that both of these documents hold, and more of it " + "日"
    rows = [(1, base), (2, "one \ufffd before " + base[:-1] + "旧 after \ufffd two")]  # 日 and 旧 share two bytes
    assert base[-1].encode()[:2] == "旧".encode()[:2]
    out = {r["doc_id"]: r["text"] for r in suffix_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {1: base, 2: "one \ufffd before" + " after \ufffd two"} or out == {1: base, 2: "one \ufffd before " + " after \ufffd two"}


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=300) | st.lists(st.sampled_from([0, 0, 1, 97]), max_size=300).map(bytes) | st.integers(1, 300).map(lambda n: b"ab" * n))
def test_suffix_array_and_prefixes(data):
    if not data:
        return
    arr = np.frombuffer(data, np.uint8)
    sa = suffix_dedup.suffix_array(arr)
    assert sa.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    lcp = suffix_dedup.common_prefixes(arr, sa, 50)
    for i in range(1, len(sa)):
        a, b = data[sa[i - 1]:sa[i - 1] + 50], data[sa[i]:sa[i] + 50]
        assert lcp[i] == next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


# -- n-gram join ----------------------------------------------------------------------
def brute_sets(texts):
    out = {}
    for t in texts:
        w = (t or "").encode().split()
        size = min(5, len(w))
        if size:
            out[t] = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
    return out


def brute_join(rows, threshold=0.8):
    """(doc_id, class_id, n_links, n_copies) of all rows."""
    sets, links, copies = brute_sets({t for _, t in rows}), defaultdict(set), Counter(t for _, t in rows)
    post = defaultdict(list)
    for t, s in sets.items():
        for g in s:
            post[g].append(t)
    for t, s in sets.items():
        both = Counter(o for g in s for o in post[g] if o != t)
        for o, n in both.items():
            if n * 10 >= 8 * (len(s) + len(sets[o]) - n):
                links[t].add(o)
    label = {}
    for t in sets:
        if t not in label:
            stack, label[t] = [t], t
            while stack:
                for o in links[stack.pop()]:
                    if o not in label:
                        label[o] = t
                        stack.append(o)
    least = {}
    for d, t in rows:
        if t in sets and d is not None:
            least[label[t]] = min(least.get(label[t], d), d)
    return Counter((d, least.get(label[t]), len(links[t]), copies[t]) if t in sets else (d, d, 0, 1) for d, t in rows)


@pytest.mark.parametrize("sf", [SF, SF_MID])
def test_join_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute_join(rows)
    assert Counter(tuple(r) for r in QUERIES["op2_ngram_join"](spark, sf).collect()) == want
    if sf == SF_MID:
        assert any(x[2] for x in want)


def test_join_hot_group(spark):
    """A group of near copies far larger than a block, and a large group of copies."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(60)]
    rows = []
    for i in range(150):
        t = list(base)
        for k in rng.sample(range(60), rng.choice([0, 1, 1, 2])):
            t[k] = rng.choice(words)
        rows.append((i, " ".join(t)))
    rows += [(1000 + i, "one text copied very often in this table") for i in range(100)]
    rows += [(2000 + i, " ".join(rng.choice(words) for _ in range(30))) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    cols = ["doc_id", "class_id", "n_links", "n_copies"]
    for block in (16, 256):
        got = Counter(tuple(r) for r in ngram_join.near_duplicates(df, block=block).select(*cols).collect())
        assert got == brute_join(rows)


def test_join_cells_are_cut_by_size(spark):
    """Few but long texts in one bucket: cells hold few of them, and every pair meets."""
    rows = [(f"k{i}".encode(), [7, i], 100) for i in range(200)]
    nodes = spark.createDataFrame(rows, "key binary, bands array<long>, size long")
    cells = ngram_join.candidate_cells(nodes, 256, block_size=1000).groupBy("i", "j").agg(F.collect_list("key").alias("k")).collect()
    assert max(100 * len(c["k"]) for c in cells) <= 5 * 1000
    met = {(bytes(a), bytes(b)) for c in cells for a in c["k"] for b in c["k"] if a < b}
    assert len(met) == 200 * 199 // 2


def test_join_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = ngram_join.near_duplicates(edge_docs).select("doc_id", "class_id", "n_links", "n_copies")
    assert Counter(tuple(r) for r in got.collect()) == brute_join(rows)
    assert ngram_join.near_duplicates(no_docs).count() == 0
    clash = edge_docs.withColumnRenamed("score", "_k")
    kept = ngram_join.keep_one(clash)
    assert kept.columns == clash.columns
    texts = Counter(r["text"] for r in kept.collect())
    assert texts == Counter({t: 1 for _, t in rows}) and ngram_join.keep_one(no_docs).count() == 0


def test_components_of_a_long_chain(spark):
    n = 70
    edges = spark.createDataFrame([(f"{(i * 37) % n:03d}".encode(), f"{((i + 1) * 37) % n:03d}".encode()) for i in range(n - 1)]
                                  + [(b"900", b"901")], "a binary, b binary")
    got = {bytes(r["key"]): bytes(r["label"]) for r in ngram_join.components(edges).collect()}
    assert len(got) == n + 2 and {v for k, v in got.items() if k < b"900"} == {b"000"} and got[b"901"] == b"900"


def test_band_choice():
    bands, rows = ngram_join.choose_bands(0.8, 0.9999, 128)
    assert 1 - (1 - 0.8 ** rows) ** bands >= 0.9999 and bands * rows <= 128


# -- pipeline -------------------------------------------------------------------------
def test_pipeline_stages(spark, tmp_path):
    """Each stage, written and read again, against brute force on its own input."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    for name, stage in corpus_pipeline.STAGES:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        after = out.collect()
        seen[name] = (len(before), len(after))
        if name != "token_ids":
            assert out.columns == columns
        if name == "language":
            model = language_id.fit(docs)
            ok = {d for d, t in before if t and model.predict(t.encode())[0] != "und" and model.predict(t.encode())[1] >= model.threshold}
            assert {r["doc_id"] for r in after} == ok and len(ok) >= 0.98 * len(before)
        elif name == "near_duplicates":
            classes = {c for _, c, _, _ in brute_join(before)}
            assert sorted(r["doc_id"] for r in after) == sorted(classes)
        elif name == "repeated_passages":
            want = {d: (n, gone) for d, n, gone, _, _ in brute_repeats(before)}
            assert {r["doc_id"] for r in after} == {d for d, (n, gone) in want.items() if not n or gone < n}
            text = dict(before)
            assert all(r["text"] == text[r["doc_id"]] for r in after if want[r["doc_id"]][1] == 0)
            assert all(len(r["text"].encode()) <= want[r["doc_id"]][0] - want[r["doc_id"]][1] and r["n_chars"] == len(r["text"]) for r in after)
        elif name == "decontaminated":
            windows = decontamination.WindowSet([(r["item_id"], r["text"].encode()) for r in bench], 10)
            assert {r["doc_id"] for r in after} == {d for d, t in before if not windows.scan(decontamination.words_of(t.encode()))[0].any()}
        else:
            codec = bpe.Codec(bpe.tokenizer_json(corpus_pipeline.public_tokenizers.path(corpus_pipeline.TOKENIZER)))
            ids = {d: codec.lib.encode(t, add_special_tokens=False).ids for d, t in before}
            assert {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in after} == ids
            assert all(r["decoded_sha256"] == sha(t.encode()) for (_, t), r in zip(sorted(before), sorted(after, key=lambda r: r["doc_id"])))
        docs = out
    assert seen["near_duplicates"][0] > seen["near_duplicates"][1] > 0


def test_pipeline_run(spark):
    from __spark_entry__ import queries
    assert "pipeline" in queries()
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and all(r["n_tokens"] * 4 == len(r["ids"]) for r in rows)


def test_pipeline_edges(spark, edge_docs, no_docs):
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, edge_docs, SF)
        assert out.count() <= edge_docs.count()
        if name != "token_ids":
            assert out.columns == edge_docs.columns
        assert stage(spark, no_docs, SF).count() == 0
