"""URL filter by a path-template tree, with DataFrame functions only.

Explicit rules judge the urls they fit and label them for the rest.  Per host,
paths form a tree by segments, with digits generalised.  All counts are of
different urls (host and path), so a url crawled often tells no more than once.
Going down from the host, a branch whose labelled block rate differs from its
parent's (z test, on ``least_labels`` labels at least) keeps its segment; the
others beside it merge, into a wildcard ``*`` where the position varies and ``~``
where it doesn't.  A position varies where its segments count as ``most_children``
equally frequent ones or more (one by the sum of squared shares, which does not
depend on how many pages were seen).  Each level smooths a template's block rate by
its parent's, and templates with purity of ``threshold`` or more are rejected.

The tree is followed, a round per level, until no template with a label holds two
different paths: below that there is nothing to tell apart, and what follows is
``**``.  So a path of any depth is judged, and rounds end at the deepest place where
labelled paths still differ.

A url that is null or has no ``://`` has an empty host and path and falls under
the template of that host.  Repeated rows are judged alike; other columns are not
read.  Pages meet tree and labels only as counts per distinct template, and the
last join's large side is split by AQE where a host is hot.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from carelake.llm.common import dropped, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


#: Fixed values.
RULES = (Rule("allow", "org", "/"), Rule("block", "example.org", "/es/"), Rule("block", "example.org", "/en/1"),
         Rule("allow", "com", "/fr/"), Rule("block", "com", "/de/"))


@dataclass(frozen=True)
class Tree:
    most_children: int = 8
    least_labels: int = 5
    z: float = 1.96
    smoothing: float = 4.0
    threshold: float = 0.5
    prior: float = 0.5


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    """All after the first ``://``."""
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")


def fitting(host: Column, path: Column, rules: tuple[Rule, ...]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits, else null."""
    name = verdict = F.lit(None).cast("string")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | host.endswith("." + r.host)) & path.startswith(r.path)
        name, verdict = F.when(fits, r.name).otherwise(name), F.when(fits, r.verdict).otherwise(verdict)
    return name, verdict


def segments(path: Column) -> Column:
    """The segments with digits generalised."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.regexp_replace(x, "[0-9]+", "#"))


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, tree: Tree = Tree(), page_id: str = "page_id", url: str = "url") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, template, purity."""
    read = pages.select(F.col(page_id).alias("page_id"), host_of(F.coalesce(F.col(url), F.lit(""))).alias("host"),
                        path_of(F.coalesce(F.col(url), F.lit(""))).alias("path"))
    rule, ruled = fitting(F.col("host"), F.col("path"), rules)
    marked = read.select("*", rule.alias("rule"), ruled.alias("ruled"), segments(F.col("path")).alias("parts"))
    urls = marked.select("host", "path", "ruled", "parts").distinct()  # verdict and segments follow from host and path
    shapes = stored(urls.groupBy("host", "parts").agg(
        F.count(F.lit(1)).alias("n"), F.count("ruled").alias("labelled"), F.count(F.when(F.col("ruled") == "block", 1)).alias("blocked")), "url-shapes")
    # A host can hold a third of the pages: no other join or grouping sees pages.
    return (marked.join(templates(shapes, tree), ["host", "parts"], "left")
            .select("page_id", "host", "path", "rule",
                    F.coalesce("ruled", F.when(F.col("purity") >= tree.threshold, "block").otherwise("allow")).alias("verdict"),
                    "template", "purity"))


def templates(shapes: DataFrame, tree: Tree) -> DataFrame:
    """host and parts of each shape with its merged template and that template's purity."""
    smooth = lambda parent: (F.col("b") + tree.smoothing * parent) / (F.col("l") + tree.smoothing)
    sums = (F.sum("labelled").alias("l"), F.sum("blocked").alias("b"))
    total = shapes.agg(*sums).select(smooth(F.lit(tree.prior)).alias("p")).first()["p"]
    more = (F.col("l") > 0) & (F.col("shapes") > 1)
    hosts = shapes.groupBy("host").agg(*sums, F.count(F.lit(1)).alias("shapes")).select("host", smooth(F.lit(total)).alias("p"), more.alias("open"))
    at = stored(shapes.join(hosts, "host").withColumn("template", F.lit("")), "url-level")
    done, level, node = [], 0, ["host", "template"]
    while True:
        ended = F.concat("template", F.when(F.size("parts") > level, "/**").otherwise(""))
        done.append(at.where("NOT open").select("host", "parts", ended.alias("template"), F.col("p").alias("purity")))
        rows = at.where("open").withColumn("segment", F.coalesce(F.get("parts", F.lit(level)), F.lit("")))
        if rows.isEmpty():
            break
        branches = stored(rows.groupBy(*node, "segment").agg(F.sum("n").alias("n"), *sums, F.count(F.lit(1)).alias("shapes"), F.min("p").alias("q")), "url-branches")
        nodes = branches.groupBy(*node).agg((F.sum("n") * F.sum("n") >= tree.most_children * F.sum(F.col("n") * F.col("n"))).alias("varies"))
        differs = (F.col("l") >= tree.least_labels) & (
            F.abs(F.col("b") - F.col("l") * F.col("q")) > tree.z * F.sqrt(F.col("l") * F.col("q") * (1 - F.col("q"))))
        named = stored(branches.join(nodes, node).withColumn(
            "name", F.when((F.col("segment") == "") | differs, F.col("segment")).when(F.col("varies"), "*").otherwise("~")), "url-named")
        pooled = (named.groupBy(*node, "name").agg(F.sum("l").alias("l"), F.sum("b").alias("b"), F.sum("shapes").alias("shapes"), F.min("q").alias("q"))
                  .select(*node, "name", smooth(F.col("q")).alias("p"), (more & (F.col("name") != "")).alias("open")))
        one = named.select(*node, "segment", "name").join(pooled, [*node, "name"])
        at = stored(rows.drop("p", "open").join(one, [*node, "segment"]).select(
            "host", "parts", "n", "labelled", "blocked", "p", "open",
            F.when(F.col("name") == "", F.col("template")).otherwise(F.concat("template", F.lit("/"), "name")).alias("template")), "url-level")
        dropped(branches, named)
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out
