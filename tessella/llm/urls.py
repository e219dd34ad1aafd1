"""URL filters: host and path rules, and beyond them a tree of path templates per host judged by smoothed labelled purity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm._common import dropped, saved

#: Rules of op10's contract: verdict, host, path.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Levels of the tree that are generalised one after the other (all deeper ones are at once), and children that a node may have
#: before they are one wildcard.
DEPTH, CHILDREN = 4, 24
#: A template is rejected at a smoothed share of blocked labels from PURITY on. Its smoothing adds STRENGTH labels of the same
#: template's share on all hosts, which itself is smoothed by as many of the share PRIOR.
PURITY, PRIOR, STRENGTH = 0.8, 0.1, 4.0
#: Sibling branches merge if their smoothed shares differ by fewer standard errors than this.
ALIKE = 1.0


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty where the url is null or has no `://`."""
    url = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def ruled(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits; nulls without one. Rules are few, so they are one expression."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        found = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def segments(path: Column) -> Column:
    """The path's segments with their variable parts as wildcards: digit runs, long hex and ids are {n} and {id}."""
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    kind = lambda s: F.when(s.rlike(r"^[0-9A-Fa-f-]*[0-9][0-9A-Fa-f-]*$") & (F.length(s) >= 12), "{id}").otherwise(F.regexp_replace(s, r"[0-9]+", "{n}"))
    return F.transform(parts, kind)


def _purity(labelled: Column, blocked: Column, prior=PRIOR) -> Column:
    return (blocked + prior * STRENGTH) / (labelled + STRENGTH)


def _spread(labelled: Column, blocked: Column) -> Column:
    """The variance of a smoothed share."""
    share = _purity(labelled, blocked)
    return share * (1 - share) / (labelled + STRENGTH)


def _wild(d: int):
    return lambda s, i: F.when(i == d, "{*}").otherwise(s)


def _generalised(tree: DataFrame) -> DataFrame:
    """`tree` with shape: its segments, of which those of nodes with more than CHILDREN children are the wildcard {*}."""
    tree = tree.withColumn("shape", F.col("segments"))
    for d in range(DEPTH):
        above = F.slice("shape", 1, d) if d else F.array().cast("array<string>")
        here = F.get("shape", F.lit(d))
        names = tree.where(F.size("shape") > d).groupBy("host", above.alias("above")).agg(F.countDistinct(here).alias("children")).where(F.col("children") > CHILDREN)
        wide = names.select(F.col("host").alias("h"), F.col("above").alias("a"), F.lit(True).alias("wide"))
        tree = tree.join(wide, (F.col("host") == F.col("h")) & (above == F.col("a")), "left")
        tree = tree.withColumn("shape", F.when(F.col("wide") & (F.size("shape") > d), F.transform("shape", _wild(d))).otherwise(F.col("shape"))).drop("h", "a", "wide")
    deep = tree.where(F.size("shape") > DEPTH).select("host", "shape", F.explode(F.sequence(F.lit(DEPTH), F.size("shape") - 1)).alias("d"))
    deep = deep.select("host", "shape", "d", F.slice("shape", F.lit(1), F.col("d")).alias("above"), F.get("shape", F.col("d")).alias("here"))
    wide = deep.groupBy("host", "above").agg(F.countDistinct("here").alias("children")).where(F.col("children") > CHILDREN).select("host", "above")
    found = deep.join(wide, ["host", "above"]).groupBy("host", "shape").agg(F.collect_set("d").alias("wide")).select(F.col("host").alias("h"), F.col("shape").alias("s"), "wide")
    tree = tree.join(found, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s")), "left")
    shape = F.when(F.col("wide").isNotNull(), F.transform("shape", lambda s, i: F.when(F.array_contains("wide", i), "{*}").otherwise(s))).otherwise(F.col("shape"))
    return tree.withColumn("shape", shape).drop("h", "s", "wide")


def _branches(siblings: Column) -> Column:
    """The siblings with labelled and blocked of their branch. In order of share, one joins the branch before it while its share
    and that of the whole branch differ by at most ALIKE standard errors. (CHILDREN bounds their number.)"""
    kind = "array<struct<shape:array<string>,labelled:bigint,blocked:bigint,branch:int>>"
    start = F.struct(F.lit(0).alias("branch"), F.lit(0).cast("long").alias("labelled"), F.lit(0).cast("long").alias("blocked"), F.from_json(F.lit("[]"), kind).alias("out"))

    def step(a, x):
        gap = F.abs(x["share"] - _purity(a["labelled"], a["blocked"]))
        apart = (F.size(a["out"]) > 0) & (gap > ALIKE * F.sqrt(_spread(x["labelled"], x["blocked"]) + _spread(a["labelled"], a["blocked"])))
        branch = a["branch"] + apart.cast("int")
        member = F.struct(x["shape"].alias("shape"), x["labelled"].alias("labelled"), x["blocked"].alias("blocked"), branch.alias("branch"))
        before = lambda n: F.when(apart, F.lit(0).cast("long")).otherwise(a[n])
        return F.struct(branch.alias("branch"), (before("labelled") + x["labelled"]).alias("labelled"), (before("blocked") + x["blocked"]).alias("blocked"), F.concat(a["out"], F.array(member)).alias("out"))

    out = F.aggregate(siblings, start, step, lambda a: a["out"])
    pooled = lambda x, n: F.aggregate(F.filter(out, lambda y: y["branch"] == x["branch"]), F.lit(0).cast("long"), lambda s, y: s + y[n])
    return F.transform(out, lambda x: F.struct(x["shape"].alias("shape"), pooled(x, "labelled").alias("labelled"), pooled(x, "blocked").alias("blocked")))


def template_tree(pages: DataFrame) -> DataFrame:
    """host, segments, purity of each template: `pages` has host, segments and label (1 to reject, 0 to keep, null).

    1. A node with more than CHILDREN children has variable ones: they become the wildcard {*}, level by level from the
       root, so that what lies below them is pooled; below DEPTH levels all at once, on the names as they stand.
    2. Siblings whose counts are statistically alike, and below which the tree has as many levels, merge (see
       _branches). Unlabelled branches don't merge with labelled ones.
    3. A template's purity is its branch's share of blocked labels, smoothed by the same template's share on all hosts:
       where a host has no labels of its own, that share decides.
    Rows are one per distinct host and path shape after the first aggregate; a host with a third of all pages is
    pre-aggregated like any other, no page is collected.
    """
    tree = pages.groupBy("host", "segments").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("blocked"))
    tree = saved(_generalised(tree), "url-shapes")
    nodes = tree.groupBy("host", "shape").agg(F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    everywhere = nodes.groupBy("shape").agg(_purity(F.sum("labelled"), F.sum("blocked")).alias("common"))
    parent = F.when(F.size("shape") > 0, F.slice("shape", 1, F.size("shape") - 1)).otherwise(F.col("shape"))
    one = F.struct(_purity(F.col("labelled"), F.col("blocked")).alias("share"), "shape", "labelled", "blocked")
    siblings = nodes.groupBy("host", parent.alias("parent"), F.size("shape").alias("levels"), (F.col("labelled") > 0).alias("known")).agg(F.sort_array(F.collect_list(one)).alias("siblings"))
    judged = siblings.select("host", F.explode(_branches(F.col("siblings"))).alias("b")).select("host", "b.*").join(everywhere, "shape")
    judged = judged.select(F.col("host").alias("h"), F.col("shape").alias("s"), _purity(F.col("labelled"), F.col("blocked"), F.col("common")).alias("purity"))
    out = saved(tree.join(judged, (F.col("host") == F.col("h")) & (F.col("shape") == F.col("s"))).select("host", "segments", "purity"), "url-tree")
    dropped(tree)
    return out


def filter_urls(pages: DataFrame, rules=RULES, label: Column | None = None) -> DataFrame:
    """All columns of `pages` (url) with host, path, rule and verdict.

    A rule's verdict holds where one fits. Elsewhere the tree of templates judges; its labels are `label` (1 to reject,
    0 to keep, null unknown; any column of `pages`) or, by default, the verdicts of the rules on the pages they fit.
    A null url, or one without `://`, has an empty host and path: a template without segments of a host of its own.
    Repeated urls count as often as they occur. Columns named host, path, rule or verdict are replaced.
    """
    host, path = host_and_path(F.col("url"))
    rows = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host, "path": path})
    rows = rows.withColumn("_ruled", ruled(F.col("host"), F.col("path"), rules)).withColumn("_segments", segments(F.col("path")))
    by_rule = F.when(F.col("_ruled.verdict") == "block", 1).when(F.col("_ruled.verdict") == "allow", 0)
    slim = rows.select("host", F.col("_segments").alias("segments"), (by_rule if label is None else label).cast("int").alias("label"))
    # Only templates to reject are looked up; as a written table they are broadcast if small, else Spark splits skewed keys.
    tree = template_tree(slim)
    bad = saved(tree.where(F.col("purity") >= PURITY).select(F.col("host").alias("_h"), F.col("segments").alias("_s"), F.lit(True).alias("_bad")), "url-rejected")
    dropped(tree)
    rows = rows.join(bad, (F.col("host") == F.col("_h")) & (F.col("_segments") == F.col("_s")), "left")
    verdict = F.coalesce(F.col("_ruled.verdict"), F.when(F.col("_bad"), "block"), F.lit("allow"))
    return rows.withColumns({"rule": F.col("_ruled.rule"), "verdict": verdict}).drop("_ruled", "_segments", "_h", "_s", "_bad")


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages).select("page_id", "host", "path", "rule", "verdict")
