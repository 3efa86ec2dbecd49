"""Chat formatting, URL filters and sharding against brute force."""
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import pytest

from grovecast.llm import chat, sharding, url_filter
from grovecast.llm.queries import QUERIES, RULES

SF = "/root/testdata/sf0.001"
NATIVE = re.compile("Python|Pandas|Arrow")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def esc(s):
    return s.replace("&", "&amp;").replace("<", "&lt;").replace("[", "&lb;").replace("]", "&rb;")


def brute_chat(rows):
    conv = defaultdict(list)
    for c, t, r, x in rows:
        conv[c].append((t, r, x))
    out = {}
    for c, turns in conv.items():
        turns = [(r or "", x or "") for _, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1] is not None, t[1] or "", t[2] is not None, t[2] or ""))]
        loss = "".join(x for r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss),
                  sum(4 + len(esc(r)) + 1 + len(esc(x)) + 4 for r, x in turns))
    return out


def test_chat_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op3_chat_formatting"](spark, SF).collect()}
    assert got == brute_chat(rows)


def test_chat_is_native(spark):
    plan = QUERIES["op3_chat_formatting"](spark, SF)._jdf.queryExecution().toString()
    assert not NATIVE.search(plan)


def test_chat_edges(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (1, 2, "assistant", "<s>[user]x]</s>&lt;[INST]"),
            (None, 1, "assistant", "n\nü日本"), (2, 1, "a]b\n<", ""), (3, 5, "assistant", None), (4, 0, "assistant", "y" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.format_chat(chat.events_from_rows(df))).collect()}
    assert got == brute_chat(rows)
    assert chat.digests(chat.format_chat(chat.events_from_rows(df.limit(0)))).count() == 0


def test_chat_events(spark):
    ev = [(1, 1, "m1", "delta", "user", "Hel"), (1, 2, "m1", "delta", "user", "lo"), (1, 3, "m2", "delta", "assistant", "bad"),
          (1, 4, "m2", "regenerate", "assistant", None), (1, 5, "m2", "delta", None, "go"), (1, 6, "m2", "delta", None, "od"),
          (1, 7, "m1", "edit", "user", "Hi"), (1, 8, "m3", None, "user", "x")]
    df = spark.createDataFrame(ev, "conv_id long, seq long, message_id string, event string, role string, text string")
    one = chat.format_chat(df).first()
    assert one["formatted"] == "<s>[user]Hi</s><s>[assistant]good</s><s>[user]x</s>"
    assert [one["formatted"][s["start"]:s["start"] + s["len"]] for s in one["spans"]] == ["Hi", "good", "x"]
    assert [s["loss"] for s in one["spans"]] == [False, True, False]


# -- URL filters ----------------------------------------------------------------
def brute_url(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = max(((h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)),
               key=lambda x: len(x[0]), default=(None, None))
    return host, path, *best


def brute_templates(urls):
    """The method over a list of urls: verdict per (host, shape)."""
    def shape(path):
        return "/".join("{h}" if re.search(r"^[0-9a-fA-F-]{16,}$", s) else re.sub("[0-9]+", "{n}", s) for s in path.split("/") if s)
    n, bad, good = Counter(), Counter(), Counter()
    for u in urls:
        h, p, _, v = brute_url(u)
        k = (h, shape(p))
        n[k] += 1
        bad[k] += v == "block"
        good[k] += v == "allow"
    child, stat = defaultdict(Counter), defaultdict(lambda: [0, 0, 0])
    for k in n:
        seg = k[1].split("/")
        for d, s in enumerate(seg):
            node = (k[0], tuple(seg[:d]), s)
            child[node][seg[d + 1] if d + 1 < len(seg) else ""] += n[k]
            for i, x in enumerate((n[k], bad[k], good[k])):
                stat[node][i] += x
    at = defaultdict(list)
    for node in stat:
        at[node[:2]].append(node)
    name = {}
    for nodes in at.values():
        pool, (pn, pb, pg) = Counter(), map(sum, zip(*[stat[x] for x in nodes]))
        for x in nodes:
            pool.update(child[x])
        for x in nodes:
            cos = sum(v * pool[c] for c, v in child[x].items()) / math.sqrt(sum(v * v for v in child[x].values()) * sum(v * v for v in pool.values()))
            _, b, g = stat[x]
            share = pb / (pb + pg) if pb + pg else None
            pure = b + g == 0 or abs(b / (b + g) - share) <= url_filter.Z * math.sqrt(max(share * (1 - share), .01) / (b + g))
            name[x] = ("*" if len(nodes) >= url_filter.MIN_CHILDREN and pn <= url_filter.RARE * len(nodes) else
                       "+" if len(nodes) > 1 and cos >= url_filter.COSINE and pure else x[2])
    rate = lambda b, g, prior: (b + url_filter.SMOOTH * prior) / (b + g + url_filter.SMOOTH)
    total = rate(sum(bad.values()), sum(good.values()), .5)
    sb, sg, tn, tb, tg, tp = Counter(), Counter(), Counter(), Counter(), Counter(), Counter()
    for k in n:
        sb[k[1]] += bad[k]
        sg[k[1]] += good[k]
    template = {}
    for k in n:
        seg = k[1].split("/")
        template[k] = (k[0], "/".join(name[(k[0], tuple(seg[:d]), s)] for d, s in enumerate(seg)))
        t = template[k]
        tn[t] += n[k]
        tb[t] += bad[k]
        tg[t] += good[k]
        tp[t] += rate(sb[k[1]], sg[k[1]], total) * n[k]
    labels = sum(bad.values()) + sum(good.values())
    out = {}
    for u in urls:
        h, p, rule, v = brute_url(u)
        t = template[(h, shape(p))]
        out[u] = (h, p, rule, v or ("block" if labels and round(rate(tb[t], tg[t], tp[t] / tn[t]), 9) > .5 else "allow"))
    return out


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_url_query(spark, sf):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url").collect()}
    want = brute_templates(list(urls.values()))
    df = QUERIES["op4_url_filters"](spark, sf)
    assert not NATIVE.search(df._jdf.queryExecution().toString())
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in df.collect()}
    assert got == {k: want[u] for k, u in urls.items()}


def test_url_edges(spark):
    urls = [None, "", "nothing", "http://", "://A.B/x", "http://X.Example.ORG?q=/es/", "http://example.org/es/a#b", "http://notexample.org/es/",
            "http://org/", "http://a.com/de/1", "http://a.com/de/1", "http://a.com/" + "s/" * 500, "http://b.net/de/7",
            "http://c.net/0123456789abcdef0", *[f"http://slug.net/post/word{chr(97 + i)}{chr(98 + i)}" for i in range(25)]]
    df = spark.createDataFrame([(i if i else None, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    want = brute_templates(urls)
    got = Counter((r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, RULES).collect())
    assert got == Counter(want[u] for u in urls)
    t = {r["template"] for r in url_filter.judge(df, RULES).collect() if r["host"] == "slug.net"}
    assert t == {"post/*"}
    assert url_filter.judge(df.limit(0), RULES).count() == 0


# -- sharding ---------------------------------------------------------------------
def check_shards(rows, texts, n):
    assert len(rows) == len(texts)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (d, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for d, t in texts)
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(n))
    goal, largest = sum(size.values()) / n, max(r["size"] for r in rows)
    assert all(abs(size[i] - goal) <= largest + 0.02 * goal for i in range(n))


def test_shard_query(spark, docs_rows):
    df = QUERIES["op9_sharding"](spark, SF)
    assert not NATIVE.search(df._jdf.queryExecution().toString())
    rows = df.collect()
    assert {r["law"] for r in rows} == {"bytes"}
    check_shards(rows, [(d, t) for d, t, _ in docs_rows], 24)


def test_shard_hot_group(spark):
    """A third of all rows are one text, and two thirds of those one repeated row."""
    rows = [(i, "hot " * 30) for i in range(300)] + [(7, "hot " * 30)] * 600 + [(i, f"text {i} " * 20) for i in range(1000, 2800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sharding.histogram_shards(df, 24).collect()
    check_shards(got, rows, 24)
    where = defaultdict(set)  # smaller groups stay whole
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert sorted(map(len, where.values()))[-2] == 1


def test_shard_cells_of_tiny_texts(spark):
    """A third of all rows without a text are few bytes, but no cell of one task."""
    rows = [(i, None if i % 3 == 0 else f"{i} " * 400) for i in range(1500)]
    keys = sharding.key_table(spark.createDataFrame(rows, "doc_id long, text string")).cache()
    refined = sharding.find_splitters(keys, 6, 0.01)[1]
    assert keys.groupBy(sharding._cell(refined).alias("c")).count().agg({"count": "max"}).first()[0] <= 1500 / 12


def test_shard_edges(spark, edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    got = sharding.histogram_shards(edge_docs, 3, carry=("n_tokens",)).collect()
    check_shards(got, rows, 3)
    assert "carry_n_tokens" in got[0].asDict()
    assert sharding.histogram_shards(no_docs, 3).count() == 0
