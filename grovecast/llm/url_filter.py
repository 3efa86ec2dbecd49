"""URL filters: rules, and a tree of path templates judged by labelled purity (native).

A url's host and path are taken by fixed rules (:func:`host_and_path`).  Rules
(verdict, host, path) fit a host with all its subdomains and paths that start
with the rule's; the longest wins.  Where no rule fits, the template decides:

1. *Shapes.*  A path's non-empty segments are generalised one by one: runs of digits
   become ``{n}``, long hex strings ``{h}``.  Urls are counted by (host, shape path)
   before anything is exchanged, so a host with a third of all urls is a few rows.
2. *Wildcards.*  In the tree of a host, where the children of a node are many
   (``MIN_CHILDREN``) and mostly rare (at most ``RARE`` urls each on average), the segment
   is variable: it becomes ``*``.
3. *Merging.*  A child is compared with the pool of its siblings: cosine of what
   follows them, and the share of labelled urls that are bad (within ``Z`` standard
   errors).  Children like the pool become one branch ``+``; the others stay.
   Comparing with the pool is linear in the number of children.
4. *Purity.*  A template of a host is rejected where its smoothed share of bad labels
   is above one half.  It is smoothed towards the share of the same shapes over all
   hosts, which is smoothed towards the share over all labels.

Labels: 1 bad, 0 good, null none.  :func:`judge` labels a url by the rule that fits it.

Cases: a null url, or one without ``://``, has empty host and path and is judged as the
empty path of the empty host; an empty table gives an empty result; equal urls
get equal verdicts; a path may have any number of segments (the work per url is
quadratic only in those); extra columns are not read; without any label all
templates are allowed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grovecast.llm.common import materialize

MIN_CHILDREN, RARE, COSINE, Z, SMOOTH = 20, 3.0, 0.9, 2.0, 4.0
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _UPPER.lower())
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule (host and path as one string) that fits, and its verdict."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def shape_path(path: Column) -> Column:
    """The path with its segments generalised one by one, e.g. ``/en/{n}.html``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    shape = lambda s: F.when(s.rlike("^[0-9a-fA-F-]{16,}$"), "{h}").otherwise(
        F.regexp_replace(s, "[0-9]+", "{n}"))
    return F.array_join(F.transform(segments, shape), "/")


def _nodes(urls: DataFrame) -> DataFrame:
    """One row per (host, shape path, depth): the segment, what it hangs on, what follows."""
    seg = F.split("shape", "/")
    got = urls.select("*", seg.alias("seg")).select("*", F.posexplode("seg").alias("depth", "segment"))
    return got.select("host", "shape", "n", "bad", "good", "depth", "segment",
                      F.xxhash64(F.slice("seg", 1, F.col("depth"))).alias("parent"),
                      F.coalesce(F.get("seg", F.col("depth") + 1), F.lit("")).alias("child"))


def learn_templates(urls: DataFrame) -> DataFrame:
    """``urls``: host, shape, n, bad, good (one row per host and shape path).  Returns
    host, shape, template, n, bad, good."""
    nodes = _nodes(urls)
    here, node = ["host", "parent", "depth"], ["host", "parent", "depth", "segment"]
    after = nodes.groupBy(*node, "child").agg(*[F.sum(c).alias(c) for c in ("n", "bad", "good")])
    each = after.groupBy(*node).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"), F.sum("good").alias("good"),
                                    F.sum(F.col("n").cast("double") ** 2).alias("norm"))
    pool = each.groupBy(*here).agg(F.count(F.lit(1)).alias("children"), F.sum("n").alias("pool_n"),
                                   F.sum("bad").alias("pool_bad"), F.sum("good").alias("pool_good"))
    pooled = after.groupBy(*here, "child").agg(F.sum("n").cast("double").alias("pn"))
    pool_norm = pooled.groupBy(*here).agg(F.sum(F.col("pn") ** 2).alias("pool_norm"))
    like = (after.join(pooled, [*here, "child"]).groupBy(*node)
            .agg(F.sum(F.col("n") * F.col("pn")).alias("dot")))
    labelled, pool_labelled = F.col("bad") + F.col("good"), F.col("pool_bad") + F.col("pool_good")
    share, pool_share = F.try_divide("bad", labelled), F.try_divide("pool_bad", pool_labelled)
    error = F.sqrt(F.greatest(pool_share * (1 - pool_share), F.lit(0.01)) / labelled)
    pure = (labelled == 0) | (F.abs(share - pool_share) <= F.lit(Z) * error)
    cosine = F.col("dot") / F.sqrt(F.col("norm") * F.col("pool_norm"))
    variable = (F.col("children") >= MIN_CHILDREN) & (F.col("pool_n") <= RARE * F.col("children"))
    name = (F.when(variable, "*").when((F.col("children") > 1) & (cosine >= COSINE) & pure, "+")
            .otherwise(F.col("segment")))
    named = (each.join(like, node).join(pool, here).join(pool_norm, here).select(*node, name.alias("name")))
    whole = (nodes.select(*node, "shape").join(named, node).groupBy("host", "shape")
             .agg(F.sort_array(F.collect_list(F.struct("depth", "name"))).alias("t"))
             .select("host", "shape", F.array_join(F.transform("t", lambda x: x["name"]), "/").alias("template")))
    return urls.join(whole, ["host", "shape"])


def template_verdicts(templates: DataFrame, bad: int, good: int) -> DataFrame:
    """host, shape, template, bad_share, verdict of every learnt shape path; ``bad`` and
    ``good``: labels over all urls."""
    rate = lambda bad, good, prior: (bad + F.lit(SMOOTH) * prior) / (bad + good + F.lit(SMOOTH))
    overall = (bad + SMOOTH * 0.5) / (bad + good + SMOOTH)
    shapes = (templates.groupBy("shape").agg(F.sum("bad").alias("b"), F.sum("good").alias("g"))
              .select("shape", rate(F.col("b"), F.col("g"), F.lit(overall)).alias("shape_rate")))
    per = (templates.join(shapes, "shape").groupBy("host", "template")
           .agg(F.sum("bad").alias("b"), F.sum("good").alias("g"),
                (F.sum(F.col("shape_rate") * F.col("n")) / F.sum("n")).alias("prior")))
    share = rate(F.col("b"), F.col("g"), F.col("prior"))
    per = per.select("host", "template", share.alias("bad_share"),
                     F.when(F.lit(bad + good > 0) & (F.round(share, 9) > 0.5), "block").otherwise("allow").alias("verdict"))
    return templates.select("host", "shape", "template").join(per, ["host", "template"])


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share for every url."""
    url = F.col(url_col).cast("string")
    host, path = host_and_path(url)
    named = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    named = named.select("*", rule.alias("rule"), says.alias("says"), shape_path(F.col("path")).alias("shape"))
    urls = named.groupBy("host", "shape").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("says") == "block").alias("bad"),
        F.count_if(F.col("says") == "allow").alias("good"))
    # the counts are read along several branches: written once
    urls = materialize(urls, "url-counts")
    labels = urls.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).first()
    # likewise the templates, of which the verdicts are made
    templates = materialize(learn_templates(urls), "templates")
    learnt = template_verdicts(templates, labels["bad"] or 0, labels["good"] or 0)
    # urls without host and path (null, no url) are one row of the templates: it is read here, so
    # they need not meet on one key
    none = learnt.where("host = '' and shape = ''").select("verdict", "template", "bad_share").first()
    empty = (F.col("host") == "") & (F.col("shape") == "")
    named = named.withColumn("_host", F.when(~empty, F.col("host")))
    got = named.join(learnt.withColumnRenamed("host", "_host"), ["_host", "shape"], "left")
    for c in ("verdict", "template", "bad_share"):
        own = F.lit(none[c] if none else None).cast(got.schema[c].dataType)
        got = got.withColumn(c, F.when(empty, own).otherwise(F.col(c)))
    return (got.select("page_id", "host", "path", "rule", F.coalesce("says", "verdict").alias("verdict"), "template", "bad_share"))
