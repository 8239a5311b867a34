"""From intent texts to plans of capabilities."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Intent patterns in the order in which they are tried, case-insensitive, from the text's start;
# the second group is the entity.
INTENT_PATTERNS: tuple[tuple[str, str], ...] = (
    ("fetch", r"^(get|fetch|retrieve|list|show)\s+(\w+)"),
    ("create", r"^(create|add|insert|new)\s+(\w+)"),
    ("update", r"^(update|modify|edit|change)\s+(\w+)"),
    ("delete", r"^(delete|remove|drop)\s+(\w+)"),
    ("analyze", r"^(analyze|analyse|examine|inspect)\s+(\w+)"),
    ("transform", r"^(transform|convert|map)\s+(\w+)"),
    ("aggregate", r"^(aggregate|sum|count|average|total)\s+(\w+)"),
    ("format", r"^(format|render|output)\s+(\w+)"),
    ("validate", r"^(validate|check|verify)\s+(\w+)"),
    ("compute", r"^(compute|calculate|run)\s+(\w+)"),
)
# The shorter list of patterns of the simple planner.
SIMPLE_PATTERNS: tuple[tuple[str, str], ...] = (
    ("fetch", r"^(get|fetch|retrieve|list)\s+(\w+)"),
    ("create", r"^(create|add|insert)\s+(\w+)"),
    ("update", r"^(update|modify|edit)\s+(\w+)"),
    ("delete", r"^(delete|remove)\s+(\w+)"),
    ("analyze", r"^(analyze|analyse)\s+(\w+)"),
    ("search", r"^(search|find)\s+(\w+)"),
    ("recommend", r"^(recommend|suggest)\s+(\w+)"),
)
# The default path of each kind of intent.
DEFAULT_PATHS: dict[str, tuple[str, ...]] = {
    "fetch": ("auth.validate", "data.fetch", "format.json"),
    "create": ("auth.validate", "validate.input", "data.create", "format.json"),
    "update": ("auth.validate", "validate.input", "data.update", "format.json"),
    "delete": ("auth.validate", "data.delete", "format.json"),
    "analyze": ("auth.validate", "data.fetch", "analytics.compute", "format.json"),
    "transform": ("auth.validate", "transform.apply", "format.json"),
    "aggregate": ("auth.validate", "data.fetch", "analytics.aggregate", "format.json"),
    "format": ("format.apply",),
    "validate": ("validate.input",),
    "compute": ("auth.validate", "compute.execute", "format.json"),
    "search": ("auth.validate", "search.execute", "format.json"),
    "recommend": ("auth.validate", "data.fetch", "recommend.compute", "format.json"),
}
KNOWN_CONFIDENCE, UNKNOWN_CONFIDENCE = 0.9, 0.1


def parse_intent(text: Column, patterns: Sequence[tuple[str, str]] = INTENT_PATTERNS) -> Column:
    """A struct of kind, entity and confidence, by the first pattern that fits."""
    t = F.trim(text)
    found = F.struct(F.lit("unknown").alias("kind"), F.lit(None).cast("string").alias("entity"), F.lit(UNKNOWN_CONFIDENCE).alias("confidence"))
    for kind, pattern in reversed(patterns):
        full = "(?i)" + pattern
        found = F.when(t.rlike(full), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(t, full, 2).alias("entity"), F.lit(KNOWN_CONFIDENCE).alias("confidence"))).otherwise(found)
    return found


def plan_by_keywords(text: Column, keywords: Sequence[tuple[str, Sequence[str]]], fallback: Sequence[str] = ()) -> Column:
    """Capabilities of the keywords that a text contains, longest keyword first, each once; else the fallback.

    The list of keywords is part of the plan, so every row is judged by itself.
    """
    ordered = sorted(keywords, key=lambda k: -len(k[0]))
    low = F.lower(text)
    parts = [F.when(low.contains(word), F.array(*[F.lit(c) for c in caps])).otherwise(F.array().cast("array<string>")) for word, caps in ordered]
    plan = F.array_distinct(F.concat(*parts))
    return F.when(F.size(plan) > 0, plan).otherwise(F.array(*[F.lit(c) for c in fallback]).cast("array<string>"))


def plan_path(kind: Column, paths: Mapping[str, Sequence[str]], registered: Sequence[str]) -> Column:
    """The default path of an intent's kind, without capabilities that nothing is registered for; empty for unknown kinds."""
    known = set(registered)
    out = F.array().cast("array<string>")
    for k, path in paths.items():
        out = F.when(kind == k, F.array(*[F.lit(c) for c in path if c in known]).cast("array<string>")).otherwise(out)
    return out


def adaptive_confidence(plans: DataFrame, stats: DataFrame, path: str) -> DataFrame:
    """Plans' confidence times their path's success rate, where it is known, and the latency to expect."""
    out = plans.join(stats.select(path, "success_rate", "avg_latency"), path, "left")
    return out.withColumn("confidence", F.col("confidence") * F.coalesce("success_rate", F.lit(1.0))).withColumnRenamed("avg_latency", "expected_latency")


def structured_intent(text: Column) -> Column:
    """A struct of kind, entity and confidence from a JSON object; kind unknown and confidence 1 where it has none, null for what is no object."""
    got = F.from_json(text, "kind string, entity string, confidence double")
    return F.when(got.isNotNull(), F.struct(F.coalesce(got["kind"], F.lit("unknown")).alias("kind"), got["entity"].alias("entity"), F.coalesce(got["confidence"], F.lit(1.0)).alias("confidence")))


def learn_paths(runs: DataFrame, intent: str, path: str, success: str, confidence: Column, seq: str) -> DataFrame:
    """The path that each intent has learned: that of its last success whose plan was not certain."""
    good = runs.filter(F.col(success) & (confidence < 1.0))
    return good.groupBy(intent).agg(F.max_by(path, seq).alias("learned_path"))
