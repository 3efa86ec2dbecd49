"""Quality classifier, Merkle manifest and periodic runs against plain re-computations."""
import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from grovecast.llm import merkle, periodic_runs, quality_classifier
from grovecast.llm.ngram_join import Powers
from grovecast.llm.queries import QUERIES
from grovecast.llm.sql import SQL

SF, SF_MID = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# -- quality classifier -----------------------------------------------------------------
@pytest.fixture(scope="module")
def quality_model(spark):
    return quality_classifier.fit(spark.read.parquet(f"{SF_MID}/documents.parquet"), spark.read.parquet(f"{SF_MID}/labels.parquet"),
                                  learn=~quality_classifier.held_out())


def test_quality_query_on_held_out(spark):
    got = {r["doc_id"]: r for r in QUERIES["op11_quality_classifier"](spark, SF_MID).collect()}
    docs = {r["doc_id"] for r in spark.read.parquet(f"{SF_MID}/documents.parquet").select("doc_id").collect()}
    assert set(got) == docs
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for d, r in got.items())
    held = [(got[r["doc_id"]], r["quality"]) for r in spark.read.parquet(f"{SF_MID}/labels.parquet").collect() if got[r["doc_id"]]["held_out"]]
    good, bad = [r["predicted"] for r, q in held if q == 1], [r["predicted"] for r, q in held if q == 0]
    assert len(good) > 40 and len(bad) > 10
    assert sum(good) / len(good) >= 0.98 and sum(bad) / len(bad) <= 0.1


def test_quality_never_learns_held_out_labels(spark, quality_model):
    """Turned labels of the held-out fold change nothing."""
    labels = spark.read.parquet(f"{SF_MID}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality_classifier.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    other = quality_classifier.fit(spark.read.parquet(f"{SF_MID}/documents.parquet"), turned, learn=~quality_classifier.held_out())
    assert np.array_equal(other.table, quality_model.table) and other.temperature == quality_model.temperature


def test_quality_score_by_hand(quality_model, docs_rows):
    """Scores from features counted one by one."""
    top, powers = quality_classifier.BUCKETS - 2, Powers()

    def features(raw):
        from grovecast.llm.ngram_join import mix, word_hashes
        words = [int(word_hashes(w, powers)[0]) for w in raw.split()]
        out = [w % top + 1 for w in words]
        for a, b in zip(words, words[1:]):
            h = int(mix(np.array([(3 * a + b) % 2**64], np.uint64))[0])
            out.append(quality_classifier.REPEATED if a == b else h % top + 1)
        clean = b" " + b" ".join(raw.split()) + b" "
        for i in range(len(clean) if words else 0):
            h = clean[i]
            for n in (2, 3, 4):
                if i + n > len(clean):
                    break
                h = (h * 0x01000193 + clean[i + n - 1] + n) % 2**32
                x = h * 0x9E3779B1 % 2**32
                out.append((x ^ x >> 15) % top + 1)
        return Counter(out)

    for _, text, _ in [r for r in docs_rows if r[1]][:25]:
        raw = text.encode()[:3000].decode("utf-8", "ignore").encode()
        want = features(raw)
        counts = quality_classifier.feature_counts(raw, powers)
        assert {int(k): int(counts[k]) for k in np.flatnonzero(counts)} == dict(want)
        z = [b + sum(n * quality_model.table[k][i] for k, n in want.items()) / sum(want.values()) for i, b in enumerate(quality_model.bias)]
        e = [np.exp((x - max(z)) / quality_model.temperature) for x in z]
        assert quality_model.score(raw, powers) == pytest.approx(e[quality_model.labels.index(1)] / sum(e), abs=1e-9)


def test_quality_long_text_in_slices(monkeypatch):
    text = b"some words && more words && " * 400
    whole = quality_classifier.feature_counts(text, Powers())
    monkeypatch.setattr(quality_classifier, "_SLICE", 1000)
    assert np.array_equal(quality_classifier.feature_counts(text, Powers()), whole)


def test_quality_edges(spark, edge_docs, no_docs, quality_model):
    got = quality_classifier.classify(edge_docs, quality_model)
    assert got.columns == [*edge_docs.columns, "_score"]  # the input has a score already
    rows = got.collect()
    assert len(rows) == edge_docs.count() and all(0 <= r["_score"] <= 1 for r in rows)
    bias = quality_model.score(None, Powers())
    assert {r["_score"] for r in rows if not (r["text"] or "").split()} == {bias}
    assert quality_classifier.classify(no_docs, quality_model).count() == 0
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None), (99, 0), (2, 0), (2, 0)], "doc_id long, quality int")
    few = quality_classifier.fit(edge_docs, labels)
    assert few.labels == [0, 1]  # an id with both labels is learnt with both
    none = quality_classifier.fit(edge_docs, labels.limit(0))
    assert {r["_score"] for r in quality_classifier.classify(edge_docs, none).collect()} == {0.5}
    assert quality_classifier.fit(no_docs, labels).labels == []


# -- Merkle manifest --------------------------------------------------------------------------
def brute_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([sha("".join(low[i:i + 3])) for i in range(0, len(low), 3)])
    return levels


def brute_path(levels, at):
    out = []
    for low in levels[:-1]:
        s = at // 3 * 3
        out.append((low[s:at], low[at + 1:s + 3]))
        at //= 3
    return out


def brute_manifest(rows):
    """rows: tuples in the order of merkle.FIELDS; (doc_id, leaf, subroot, root, proof digest, folded, verified)."""
    h = lambda r: sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in r))
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((h(r), r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {}
    for g in order:
        groups[g].sort(key=lambda x: (x[1][0] is not None, x[1][0] or 0, x[0]))
        trees[g] = brute_tree([x[0] for x in groups[g]])
    top = brute_tree([trees[g][-1][0] for g in order])
    out = []
    for k, g in enumerate(order):
        for at, (own, r) in enumerate(groups[g]):
            path = brute_path(trees[g], at) + brute_path(top, k)
            odd = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None
            node = h((*r[:4], r[4].replace("\n", ""))) if odd else own
            for left, right in path:
                node = sha("".join([*left, node, *right]))
            out.append((r[0], own, trees[g][-1][0], top[-1][0], sha("".join(x for a, b in path for x in a + b)), node, node == top[-1][0]))
    return Counter(out)


def as_counter(df):
    return Counter(tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in df.collect())


def through_operator(docs):
    odd = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    fields = [F.col(c) for c in merkle.FIELDS[:-1]]
    got = merkle.manifest(docs, carry={"tampered": F.when(odd, merkle.leaf(*fields, F.translate("text", "\n", "")))})
    got = merkle.verify(got.withColumn("suspect", F.coalesce("tampered", "leaf")), "suspect")
    return got.withColumn("verified", F.col("folded_root") == F.col("root"))


def test_merkle_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select(*merkle.FIELDS).collect()]
    assert as_counter(QUERIES["op12_merkle_manifest"](spark, SF)) == brute_manifest(rows)


@pytest.fixture(scope="module")
def small_blocks():
    """Three levels to a block: several rounds on few rows."""
    keep = merkle.LEVELS, merkle.WIDTH
    merkle.LEVELS, merkle.WIDTH = 2, 9
    yield
    merkle.LEVELS, merkle.WIDTH = keep


def test_merkle_edges(spark, small_blocks):
    """Many rounds, a hot source, null ids and sources, ids that repeat, equal rows, negative and huge ids."""
    rng = random.Random(5)
    ids = [*range(100), *[2**40 + 7 * i for i in range(40)], *[-5 - 70_000 * i for i in range(30)], 2**63 - 1, -2**63]
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None, "", "é"]), rng.choice(["en", None]), rng.choice([None, 5]), rng.choice(["a\nb", "", None, "x"])) for i in ids]
    rows += [(None, "hot", "en", k % 3, f"t{k}\n") for k in range(20)] + [(50, "hot", "en", k, "t") for k in range(25)]
    rows += [(7, "hot", "en", 1, "same\n")] * 30 + [(None, None, None, None, None)] * 3 + [(1, "alone", "de", 1, "z\n")]
    rows += [(i, f"s{i}", "en", 1, "one of many sources") for i in range(40)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf int, pos int")
    assert as_counter(through_operator(docs)) == brute_manifest(rows)


def test_merkle_empty_and_single(spark, no_docs):
    docs = spark.createDataFrame([(1, "a", "en", 1, "x\n")], "doc_id long, source string, lang string, n_chars long, text string")
    assert as_counter(through_operator(docs)) == brute_manifest([(1, "a", "en", 1, "x\n")])
    assert through_operator(docs.limit(0)).count() == 0
    with pytest.raises(TypeError):
        merkle.manifest(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_bitmap_forms_and_ranks():
    rng = np.random.default_rng(1)
    most = 1 << merkle.CHUNK
    for n in (0, 1, 100, merkle.ARRAY_MOST, merkle.ARRAY_MOST + 1, most // 2, most):
        low = np.sort(rng.permutation(most)[:n])
        packed = merkle.compress(low)
        assert len(packed) <= merkle.SET_BYTES and merkle.expand(packed).tolist() == low.tolist()
        index = merkle.Index(packed, np.stack([low[::7], np.full(len(low[::7]), 2)]).astype("<i8").tobytes())
        want = np.arange(n) + 2 * np.searchsorted(low[::7], low)
        assert index.rank(low).tolist() == want.tolist()


def test_merkle_oracle(spark):
    import duckdb
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    got = con.sql(SQL["op12_merkle_manifest"])
    rows = Counter(tuple(dict(zip(got.columns, r))[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in got.fetchall())
    assert rows == as_counter(QUERIES["op12_merkle_manifest"](spark, SF))


# -- periodic runs ------------------------------------------------------------------------------
def brute_runs(w):
    out = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                out.setdefault((i, j - i + q), q)  # the smallest period of the stretch
            i = max(j, i + 1)
    return sorted(((a, n, q) for (a, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_collapsed(words, runs):
    return [w for i, w in enumerate(words) if not any(a + q <= i < a + n for a, n, q in runs)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.integers(0, 60), st.integers(1, 12))
def test_runs_match_brute_force(word, a, p):
    for w in (word, [word[min(i, a + (i - a) % p)] if i >= a and word else word[i] for i in range(len(word))]):
        assert periodic_runs.runs_of(np.array(w, np.int64)) == brute_runs(w)


def test_runs_with_small_position_blocks(monkeypatch):
    monkeypatch.setattr(periodic_runs, "BLOCK", 4)
    rng = random.Random(9)
    for _ in range(60):
        w = [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(250))]
        assert periodic_runs.runs_of(np.array(w, np.int64)) == brute_runs(w)


def planted(doc, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(str(doc).encode()), len(words)
    if h % 10 == 0 and n and doc is not None:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def runs_row(doc, words):
    runs = brute_runs(words)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    return (doc, len(runs), *top, sha(lines), hashlib.sha256(b" ".join(brute_collapsed(words, runs))).hexdigest())


def test_runs_query(spark, docs_rows):
    got = Counter(tuple(r) for r in QUERIES["op13_periodic_runs"](spark, SF).collect())
    want = Counter(runs_row(d, planted(d, t)) for d, t, _ in docs_rows if len((t or "").split()) <= 6000)
    long = {d for d, t, _ in docs_rows if len((t or "").split()) > 6000}
    assert Counter({k: v for k, v in got.items() if k[0] not in long}) == want
    assert sum(r[1] > 0 for r in want) >= 5 and sum(got.values()) == len(docs_rows)


def test_runs_edges(spark, edge_docs, no_docs):
    more = spark.createDataFrame([(20, "a b " * 5 + "c", None, None, 0, 0), (21, "same " * 6, None, None, 0, 0), (22, "same " * 5, None, None, 0, 0),
                                  (23, "a\xa0b\x85 " * 7, None, None, 0, 0)], edge_docs.schema)
    docs = edge_docs.unionByName(more).withColumn("runs", F.lit("taken"))
    got = periodic_runs.find_runs(docs)
    assert got.columns == [*docs.columns, "n_words", "_runs", "collapsed"]
    for r in got.collect():
        words = (r["text"] or "").encode().split()
        assert r["n_words"] == len(words)
        if len(words) < 10_000:
            runs = brute_runs(words)
            assert [tuple(x) for x in r["_runs"]] == runs and r["collapsed"].encode() == b" ".join(brute_collapsed(words, runs))
        if r["doc_id"] == 20:
            assert [tuple(x) for x in r["_runs"]] == [(0, 10, 2)] and r["collapsed"] == "a b c"
        if r["doc_id"] in (21, 23):
            assert [tuple(x)[2] for x in r["_runs"]] == [1]
        if r["doc_id"] == 22:
            assert not r["_runs"]
    assert periodic_runs.find_runs(no_docs).count() == 0


def test_runs_of_a_very_long_text():
    words = [b"x"] * 200_000
    assert periodic_runs.runs_of(periodic_runs.word_numbers(words)) == [(0, 200_000, 1)]
