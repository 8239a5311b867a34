"""Routing: capabilities as functions over DataFrames, and the hop loop that applies them.

An envelope row has id, next (the capability to run), state (map of strings), error and terminated.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

MAX_HOPS = 100
Transform = Callable[[DataFrame], DataFrame]


def enrich(state: Column, new: Column) -> Column:
    """A state map with new entries over it; of equal keys the new one counts."""
    kept = F.map_filter(state, lambda k, _: ~F.map_contains_key(new, k))
    return F.map_concat(kept, new)


def validate(rows: DataFrame, rules: Sequence[tuple[Column, str]]) -> DataFrame:
    """errors (the messages of the rules that don't hold, in order), passed, and the joined error."""
    errors = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for ok, message in rules]), lambda e: e.isNotNull())
    out = rows.withColumn("errors", errors).withColumn("validation_passed", F.size("errors") == 0)
    return out.withColumn("error", F.when(~F.col("validation_passed"), F.concat(F.lit("Validation failed: "), F.concat_ws(", ", "errors"))))


def resolve(requests: DataFrame, aliases: DataFrame, capability: str = "capability") -> DataFrame:
    """The capability that a name stands for: its alias's target (one level), else itself."""
    named = aliases.select(F.col("alias").alias(capability), "target").dropDuplicates([capability])
    return requests.join(named, capability, "left").withColumn("resolved", F.coalesce("target", capability)).drop("target")


def run_hops(envelopes: DataFrame, catalog: Mapping[str, Transform], max_hops: int = MAX_HOPS, checkpoint: Callable[[DataFrame], DataFrame] | None = None, continue_on_error: bool = True) -> DataFrame:
    """Apply each row's next capability, again and again, until none is left or the bound is reached.

    A hop is one transform of each capability over the rows that are at it. Rows still on their way after
    the bound are terminated with an error; so are rows whose capability is unknown, and rows that a hop gave an error, unless
    they go on in spite of it (continue_on_error). `checkpoint` cuts the lineage; it is called after every hop, as plans grow.
    """
    checkpoint = checkpoint or cut
    columns = envelopes.columns
    rows, done = envelopes, []
    for _ in range(max_hops):
        known = F.col("next").isin(list(catalog))
        live = F.col("next").isNotNull() & ~F.col("terminated")
        done.append(rows.filter(~live).select(columns))
        lost = rows.filter(live & ~known).withColumn("error", F.concat(F.lit("no node for "), "next")).withColumn("terminated", F.lit(True)).withColumn("next", F.lit(None).cast("string"))
        done.append(lost.select(columns))
        going = rows.filter(live & known)
        step = None
        for name, transform in catalog.items():
            part = transform(going.filter(F.col("next") == name)).select(columns)
            if not continue_on_error:
                failed = F.col("error").isNotNull()
                part = part.withColumn("terminated", F.col("terminated") | failed).withColumn("next", F.when(~failed, F.col("next")))
            step = part if step is None else step.unionByName(part)
        if step is None:
            break
        rows = checkpoint(step)
        if rows.isEmpty():
            break
    else:
        live = F.col("next").isNotNull() & ~F.col("terminated")
        rows = rows.withColumn("error", F.when(live, F.lit(f"hop bound {max_hops} reached")).otherwise(F.col("error"))).withColumn("terminated", F.col("terminated") | live)
        done.append(rows.select(columns))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def fuse(path: Sequence[str], catalog: Mapping[str, Transform]) -> Transform:
    """A chain that is known beforehand as one plan, which the optimizer can collapse into one projection."""

    def run(rows: DataFrame) -> DataFrame:
        for name in path:
            rows = rows.transform(catalog[name])
        return rows

    return run


def merge_branches(rows: DataFrame, node: str, branches: Mapping[str, Callable[[DataFrame], Column]], condition: Mapping[str, Column] | None = None) -> DataFrame:
    """node and a map of branch name to its result; branches whose condition doesn't hold or that fail (null) are left out."""
    entries = []
    for name, branch in branches.items():
        result = branch(rows)
        allowed = (condition or {}).get(name)
        entries.append(F.struct(F.lit(name).alias("key"), (F.when(allowed, result) if allowed is not None else result).alias("value")))
    kept = F.filter(F.array(*entries), lambda e: e["value"].isNotNull())
    return rows.select(node, F.map_from_entries(kept).alias("merged_branches"))


# The demo's routes.
DEMO_ROUTES = (("/users", "users.list"), ("/models", "models.list"), ("/analytics", "analytics.compute"))
NOT_FOUND = "response.not_found"


def route_by_prefix(path: Column, routes: Sequence[tuple[str, str]] = DEMO_ROUTES) -> Column:
    """The capability of the first prefix that a path has; that of unknown routes for none."""
    out = F.lit(NOT_FOUND)
    for prefix, capability in reversed(routes):
        out = F.when(path.startswith(prefix), F.lit(capability)).otherwise(out)
    return out


def respond(capability: Column, authenticated: Column, body: Column) -> Column:
    """A struct of status and body: 404 for no route, 401 without authentication, else 200."""
    return (
        F.when(capability == NOT_FOUND, F.struct(F.lit(404).alias("status"), F.lit("not found").alias("body")))
        .when(~authenticated, F.struct(F.lit(401).alias("status"), F.lit("unauthorized").alias("body")))
        .otherwise(F.struct(F.lit(200).alias("status"), body.alias("body")))
    )


def health(probes: DataFrame, by: str, name: str, ok: str, required: Sequence[str]) -> DataFrame:
    """Per group the names that are reachable and whether all required ones are."""
    each = probes.groupBy(by, name).agg(F.max(F.col(ok).cast("int")).alias("ok"))
    reachable = F.array_sort(F.collect_set(F.when(F.col("ok") == 1, F.col(name))))
    return each.groupBy(by).agg(F.concat_ws(",", reachable).alias("reachable"), (F.sum(F.when(F.col(name).isin(*required), F.col("ok")).otherwise(0)) == len(required)).alias("useful"))


def next_of_plan(capabilities: Column, index: Column) -> Column:
    """The capability after a plan's cursor; null at the end."""
    return F.try_element_at(capabilities, index + 2)


def resume_at(next_capability: Column, history: Column) -> Column:
    """Where an envelope goes on: its next capability, else the last one of its history."""
    return F.coalesce(next_capability, F.try_element_at(history, F.lit(-1)))


def session_of(auth: DataFrame, second: DataFrame, by: str) -> DataFrame:
    """Two probes of a session joined: authenticated, the user, whether the second service is ready, and both."""
    a = auth.select(by, F.col("ok").alias("authenticated"), "user")
    b = second.select(by, F.col("ok").alias("second_ready"))
    out = a.join(b, by, "full_outer").na.fill(False, ["authenticated", "second_ready"])
    return out.withColumn("useful", F.col("authenticated") & F.col("second_ready"))


def succeeded(terminated: Column, error: Column) -> Column:
    """An envelope succeeded if it was not terminated, or has no error."""
    return ~terminated | error.isNull()
