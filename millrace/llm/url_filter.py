"""URL filtering by rules and by a tree of path templates for each host.

Rules (host suffix and path prefix, the longest wins) judge what they fit, and label it. Elsewhere a tree
of path templates decides: below each host, variable path segments become wildcards (digits by shape,
others by their number of values), sibling branches are merged where neither the shape of what lies
below them nor their labelled share of blocked pages differs, and a template is rejected if its
share of blocked pages, smoothed towards its parent's, reaches one half.

The tree takes in whole paths. It is built level by level; segments that all pages of a node share are one edge,
and a node whose pages all have the same rest of the path is a leaf, so there are as many levels as paths have
forks, not segments.

DataFrame operations only. The tree is built from counts of templates, so a host with a third of all
pages is as many rows as it has templates.

A null url, or one without `://`, has an empty host and path, no rule, and is allowed. A null page_id is
judged like others; repeated rows count each. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import checkpoint

MANY_VALUES = 32  # a segment with more values than this ...
RARE_VALUE = 4  # ... of fewer pages each than this, on average, is a variable one
SMOOTHING = 4.0
PRIOR = 0.25  # share of blocked pages on a host without labels
REJECT = 0.5
Z_DIFFERENT = 1.96
SHAPE_DIFFERENT = 0.5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """The host, A-Z lower-cased, and the path, up to ? or #."""
    known = url.contains("://")
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(known, lowered).otherwise(""), F.when(known, path).otherwise("")


def rule_column(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The longest rule that fits, as a struct of rule and verdict; rules are (verdict, host/path)."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule in sorted(rules, key=lambda r: len(r[1])):
        of, slash, prefix = rule.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + prefix)
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def _segments(path: Column) -> Column:
    """The path's segments with digits generalised."""
    return F.split(F.regexp_replace(F.regexp_replace(path, "^/", ""), "[0-9]+", "#"), "/", -1)


def template_tree(labelled: DataFrame) -> DataFrame:
    """host, template and purity for rows of host, template (array of segments), n, labels, blocked."""
    labelled = checkpoint(labelled)
    nodes = labelled.groupBy("host").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b"))
    nodes = nodes.select("host", F.lit("").alias("key"), _smoothed("b", "l", F.lit(PRIOR)).alias("purity"))
    rows = labelled.select("host", "template", "n", "labels", "blocked", F.lit("").alias("key"), F.col("template").alias("left"))
    done = None
    while True:
        # nodes whose rows have one and the same rest are leaves; what the least and the greatest rest share, all share
        forks = rows.groupBy("host", "key").agg(F.min("left").alias("lo"), F.max("left").alias("hi")).filter("lo <> hi")
        same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
        forks = checkpoint(forks.select("host", "key", F.array_position(same, False).cast("int").alias("at")))
        judged = rows.join(nodes, ["host", "key"])
        leaves = checkpoint(judged.join(forks, ["host", "key"], "left_anti").select("host", "template", "key", "purity"))
        done = leaves if done is None else done.unionByName(leaves)
        if forks.isEmpty():
            return done
        rows = rows.join(forks, ["host", "key"]).withColumn("seg", F.coalesce(F.get("left", F.col("at") - 1), F.lit("")))
        rows = rows.withColumn("left", F.slice("left", F.col("at") + 1, F.size("left"))).drop("at")
        rows = rows.withColumn("tail", F.xxhash64("left"))
        branch = rows.groupBy("host", "key", "seg").agg(F.sum("n").alias("n"), F.sum("labels").alias("l"), F.sum("blocked").alias("b"))
        parent = branch.groupBy("host", "key").agg(F.count("*").alias("values"), F.sum("n").alias("pn"), F.sum("l").alias("pl"), F.sum("b").alias("pb"))
        shape = rows.groupBy("host", "key", "seg", "tail").agg(F.sum("n").alias("tn"))
        whole = shape.groupBy("host", "key", "tail").agg(F.sum("tn").alias("wn"))
        both = branch.join(parent, ["host", "key"])
        # total variation between the tails of a branch and of all its siblings
        far = shape.join(whole, ["host", "key", "tail"]).join(both.select("host", "key", "seg", "n", "pn"), ["host", "key", "seg"])
        far = far.groupBy("host", "key", "seg").agg(
            (0.5 * (F.sum(F.abs(F.col("tn") / F.col("n") - F.col("wn") / F.col("pn"))) + 1 - F.sum(F.col("wn") / F.col("pn")))).alias("far")
        )
        pooled = F.col("pb") / F.col("pl")
        spread = F.sqrt(pooled * (1 - pooled) * (1 / F.col("l") + 1 / F.col("pl")))
        differs = F.when((F.col("l") == 0) | (F.col("pl") == 0), F.lit(False)).otherwise(F.abs(F.col("b") / F.col("l") - pooled) > Z_DIFFERENT * spread + 1e-9)
        variable = (F.col("values") > MANY_VALUES) & (F.col("pn") / F.col("values") < RARE_VALUE)
        merged = F.when(differs | (F.col("far") > SHAPE_DIFFERENT), F.when(variable, F.lit("*")).otherwise(F.col("seg"))).otherwise(F.lit("~"))
        named = both.join(far, ["host", "key", "seg"]).select("host", "key", "seg", F.concat("key", F.lit("/"), merged).alias("below"))
        rows = rows.join(named, ["host", "key", "seg"])
        step = rows.groupBy("host", "key", "below").agg(F.sum("labels").alias("l"), F.sum("blocked").alias("b"))
        nodes = step.join(nodes, ["host", "key"]).select("host", F.col("below").alias("key"), _smoothed("b", "l", F.col("purity")).alias("purity"))
        # the next level reads both several times
        nodes = checkpoint(nodes)
        rows = checkpoint(rows.select("host", "template", "n", "labels", "blocked", F.col("below").alias("key"), "left"))


def _smoothed(blocked: str, labels: str, towards: Column) -> Column:
    return (F.col(blocked) + SMOOTHING * towards) / (F.col(labels) + SMOOTHING)


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and purity (null where a rule decides) of every page."""
    host, path = host_and_path(F.coalesce("url", F.lit("")))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", rule_column(F.col("host"), F.col("path"), rules)).withColumn("template", _segments(F.col("path")))
    counts = rows.filter("host <> ''").groupBy("host", "template").agg(
        F.count("*").alias("n"), F.count("fit").alias("labels"), F.sum(F.when(F.col("fit.verdict") == "block", 1).otherwise(0)).alias("blocked")
    )
    tree = template_tree(counts).select("host", "template", "purity")
    open_rows = rows.filter("fit is null and host <> ''").join(tree, ["host", "template"], "left")
    method = F.when(F.col("purity") >= REJECT, F.lit("block")).otherwise(F.lit("allow"))
    out = ["page_id", "host", "path"]
    judged = open_rows.select(*out, F.lit(None).cast("string").alias("rule"), method.alias("verdict"), "purity")
    ruled = rows.filter("fit is not null or host = ''").select(*out, "fit.rule", F.coalesce("fit.verdict", F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("purity"))
    return judged.unionByName(ruled)
