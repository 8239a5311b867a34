"""One query for each operator over the tables, and the same in SQL.

Events stand for requests: the type is the capability, props the input, value the latency in milliseconds,
and an `error` is a failure. Conversations stand for lineages: a turn's parent is the turn before.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import keys
from millrace.operators import change, documents, evolution, features, lineage, memo, placement, planning, resilience, routing, similarity, stats, swarm
from millrace.session import shared_path
from millrace.sources import requests
from millrace.streaming import topics

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their lookup key, success and time."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("lookup_key", keys.lookup_key(F.col("event_type"), F.col("props"))).withColumn("success", F.col("event_type") != "error")


def r6(c, name: str):
    return F.round(c, 6).alias(name)


CALLS = "calls AS (SELECT *, event_type || ':' || substr(sha256(event_type || '|' || props), 1, 16) AS lookup_key, event_type <> 'error' AS success FROM events)"
PATHS = "paths AS (SELECT *, event_type || '->' || lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS path FROM events), runs AS (SELECT *, event_type <> 'error' AS success FROM paths WHERE path IS NOT NULL)"


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls with the path of two steps that they begin."""
    c = calls(spark, sf_dir)
    after = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return c.withColumn("path", F.concat_ws("->", "event_type", after)).withColumn("after", after).filter("after is not null").drop("after")


# ---- memoisation


@query(f"""WITH {CALLS}, k AS (SELECT event_type, lookup_key, count(*) AS n FROM calls GROUP BY ALL)
SELECT event_type, count(*) AS unique_computations, CAST(sum(n - 1) AS BIGINT) AS total_reuses, round(sum(n - 1) / count(*), 6) AS dedup_ratio, round(sum(n - 1) / sum(n), 6) AS hit_ratio FROM k GROUP BY 1""")
def memo_dedup_stats(spark, sf_dir):
    out = memo.dedup_stats(calls(spark, sf_dir), "event_type", "lookup_key")
    return out.select("event_type", "unique_computations", "total_reuses", r6("dedup_ratio", "dedup_ratio"), r6("hit_ratio", "hit_ratio"))


@query("""WITH k AS (SELECT lang, sha256('v1:' || text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL)
SELECT lang, count(*) AS unique_computations, CAST(sum(n - 1) AS BIGINT) AS total_reuses, round(sum(n - 1) / count(*), 6) AS dedup_ratio, round(sum(n - 1) / sum(n), 6) AS hit_ratio FROM k GROUP BY 1""")
def memo_doc_content_dedup(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").filter("text is not null").select("lang", memo.stage_hash(F.col("text")).alias("h"))
    out = memo.dedup_stats(docs, "lang", "h")
    return out.select("lang", "unique_computations", "total_reuses", r6("dedup_ratio", "dedup_ratio"), r6("hit_ratio", "hit_ratio"))


@query(f"""WITH {CALLS} SELECT event_id, row_number() OVER (PARTITION BY lookup_key ORDER BY ts, event_id) > 1 AS hit FROM calls""")
def memo_lookup_hit_miss(spark, sf_dir):
    return memo.hit_or_miss(calls(spark, sf_dir), "lookup_key", ["ts", "event_id"]).select("event_id", "hit")


@query(f"""WITH {CALLS}, l AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY lookup_key ORDER BY ts, event_id) AS age FROM calls)
SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN age < CASE WHEN NOT success THEN 7200 WHEN event_type = 'view' THEN 43200 ELSE 86400 END * CAST(1000000 AS BIGINT) THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM l GROUP BY 1""")
def memo_ttl_expiry(spark, sf_dir):
    c = calls(spark, sf_dir)
    ttl = F.when(~F.col("success"), F.lit(7200)).when(F.col("event_type") == "view", F.lit(43200)).otherwise(F.lit(86400))
    hit = memo.hit_within_ttl(c, "lookup_key", ["ts", "event_id"], "ts", ttl)
    return hit.groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("long")).alias("hits"))


@query(f"""WITH {CALLS}, l AS (SELECT lookup_key, max(event_id) AS event_id FROM calls GROUP BY 1)
SELECT lookup_key, event_id FROM l ORDER BY event_id DESC, lookup_key LIMIT 100""")
def memo_lru_survivors(spark, sf_dir):
    return memo.lru_survivors(calls(spark, sf_dir), "lookup_key", ["event_id"], 100).select("lookup_key", "event_id")


@query(f"""WITH {CALLS} SELECT event_id, count(*) OVER w AS execution_count, round(avg(value) OVER w + 1e-9, 6) AS avg_latency_ms FROM calls WINDOW w AS (PARTITION BY lookup_key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def memo_running_latency(spark, sf_dir):
    out = memo.running_latency(calls(spark, sf_dir), "lookup_key", ["ts", "event_id"], "value")
    return out.select("event_id", "execution_count", r6(F.col("avg_latency_ms") + 1e-9, "avg_latency_ms"))


@query(f"""WITH {CALLS} SELECT lookup_key, count(*) AS execution_count, round(avg(value), 6) AS avg_latency_ms, max_by(event_id, event_id) AS output FROM calls GROUP BY 1""")
def memo_register(spark, sf_dir):
    out = memo.register(calls(spark, sf_dir), "lookup_key", "event_id", "value", "event_id")
    return out.select("lookup_key", "execution_count", r6("avg_latency_ms", "avg_latency_ms"), "output")


@query(f"""WITH {CALLS} SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS result FROM calls""")
def memo_single_flight(spark, sf_dir):
    """Each distinct computation runs once and its result goes to all calls of its key."""
    c = calls(spark, sf_dir).select("event_id", "lookup_key", "props")
    double = lambda rows: rows.withColumn("result", F.get_json_object("props", "$.k").cast("long") * 2)
    return memo.compute_once(c, "lookup_key", ["props"], double).select("event_id", "result")


@query("""SELECT l_orderkey AS run_id, l_linenumber AS line, o_orderdate AS completed_at, p_name AS artifact FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey JOIN customer ON o_custkey = c_custkey
WHERE o_orderstatus = 'F' AND p_size > 25 AND c_mktsegment = 'BUILDING' ORDER BY o_orderdate DESC NULLS LAST, l_orderkey, l_partkey, l_linenumber LIMIT 64""")
def stage_memo_join(spark, sf_dir):
    """Orders are runs, their lines the outputs, parts the artifacts; the customer's segment is the input asked for."""
    o, li, p, c = (table(spark, sf_dir, t) for t in ("orders", "lineitem", "part", "customer"))
    inputs = o.join(c.filter("c_mktsegment = 'BUILDING'"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("run_id"), F.lit("s").alias("stage_name"))
    outputs = li.select(F.col("l_orderkey").alias("run_id"), F.lit("s").alias("stage_name"), F.col("l_partkey").alias("artifact_id"), F.col("l_linenumber").alias("line"))
    artifacts = p.select(F.col("p_partkey").alias("artifact_id"), (F.col("p_size") <= 25).alias("deleted"), F.col("p_name").alias("artifact"))
    stages = o.select(F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("open").alias("status"), F.col("o_orderdate").alias("completed_at"))
    return memo.stage_lookup(inputs, outputs, artifacts, stages).select("run_id", "line", "completed_at", "artifact")


@query("""SELECT l_orderkey AS run_id, l_linenumber AS stage, min_by(l_partkey, l_extendedprice * 1000000 + l_partkey) AS artifact FROM lineitem GROUP BY ALL""")
def stage_memo_record(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("stage"), F.col("l_partkey").alias("artifact"), (F.col("l_extendedprice") * 1000000 + F.col("l_partkey")).alias("seq"))
    return memo.stage_record(li.filter("artifact % 2 = 0"), li.filter("artifact % 2 = 1"), ["run_id", "stage"], "seq").select("run_id", "stage", "artifact")


# ---- routing


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS a, (CAST(json_extract(props, '$.k') AS BIGINT) + 1) * 3 AS b FROM events""")
def route_chain_two_hop(spark, sf_dir):
    """A path known beforehand: seed + 1, then times 3, in one projection."""
    catalog = {"a": lambda d: d.withColumn("a", F.col("seed") + 1), "b": lambda d: d.withColumn("b", F.col("a") * 3)}
    e = table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("seed"))
    return e.transform(routing.fuse(["a", "b"], catalog)).select("event_id", "a", "b")


@query("""WITH p AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[^:]*://[^/]*', ''), '^/(en|de|fr|es)/.*$', CASE WHEN url LIKE '%/en/%' THEN '/users' WHEN url LIKE '%/de/%' THEN '/models' WHEN url LIKE '%/fr/%' THEN '/analytics' ELSE '/other' END) AS path FROM pages)
SELECT page_id, CASE WHEN starts_with(path, '/users') THEN 'users.list' WHEN starts_with(path, '/models') THEN 'models.list' WHEN starts_with(path, '/analytics') THEN 'analytics.compute' ELSE 'response.not_found' END AS capability,
CASE WHEN path = '/users' OR path = '/models' OR path = '/analytics' THEN CASE WHEN page_id % 3 = 0 THEN 401 ELSE 200 END ELSE 404 END AS status FROM p""")
def route_case_prefix(spark, sf_dir):
    u = F.col("url")
    p = F.when(u.contains("/en/"), "/users").when(u.contains("/de/"), "/models").when(u.contains("/fr/"), "/analytics").otherwise("/other")
    d = table(spark, sf_dir, "pages").select("page_id", routing.route_by_prefix(p).alias("capability"))
    return d.select("page_id", "capability", routing.respond(F.col("capability"), F.col("page_id") % 3 != 0, F.lit("ok"))["status"].alias("status"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'page.view' WHEN 'click' THEN 'page.click' ELSE event_type END AS resolved FROM events""")
def route_alias_resolve(spark, sf_dir):
    aliases = spark.createDataFrame([("view", "page.view"), ("click", "page.click")], "alias string, target string")
    return routing.resolve(table(spark, sf_dir, "events"), aliases, "event_type").select("event_id", "resolved")


@query("""SELECT event_id % 20 AS steps, count(*) AS n, event_id % 20 > 8 AS terminated, min(least(event_id % 20, 8)) AS hops FROM events GROUP BY ALL""")
def route_hop_bound(spark, sf_dir):
    """Rows that route to themselves so many times; the bound ends those that would go on."""
    e = table(spark, sf_dir, "events")
    start = e.select("event_id", (F.col("event_id") % 20).alias("steps"), F.lit(0).cast("long").alias("hops"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("terminated"))
    start = start.withColumn("next", F.when(F.col("steps") > 0, "loop"))
    loop = lambda d: d.withColumn("hops", F.col("hops") + 1).withColumn("next", F.when(F.col("hops") < F.col("steps"), "loop"))
    out = routing.run_hops(start, {"loop": loop}, 8)
    return out.groupBy("steps", "terminated").agg(F.count("*").alias("n"), F.min("hops").alias("hops")).select("steps", "n", "terminated", "hops")


@query("""SELECT event_id, m AS mode, CASE WHEN event_type = 'error' AND m = 'stop' THEN 1 ELSE 2 END AS hops, event_type = 'error' AND m = 'stop' AS terminated FROM events, (SELECT unnest(['stop', 'go on']) AS m)""")
def route_continue_on_error(spark, sf_dir):
    """Two hops, the first of which fails for errors: with and without going on."""
    start = table(spark, sf_dir, "events").select("event_id", "event_type", F.lit(0).alias("hops"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("terminated"), F.lit("first").alias("next"))
    hop = lambda d: d.withColumn("hops", F.col("hops") + 1)
    catalog = {
        "first": lambda d: hop(d).withColumn("error", F.when(F.col("event_type") == "error", "failed")).withColumn("next", F.lit("second")),
        "second": lambda d: hop(d).withColumn("next", F.lit(None).cast("string")),
    }
    runs = [routing.run_hops(start, catalog, continue_on_error=go).select("event_id", F.lit(mode).alias("mode"), "hops", "terminated") for mode, go in (("stop", False), ("go on", True))]
    return runs[0].unionByName(runs[1])


@query("""SELECT event_id, CAST(round(value * 2, 4) AS VARCHAR) AS double, CASE WHEN event_type <> 'error' THEN event_type END AS named FROM events""")
def branch_merge(spark, sf_dir):
    """Two branches of every request, merged by name; a failed branch is left out."""
    e = table(spark, sf_dir, "events")
    branches = {"double": lambda d: F.round(d["value"] * 2, 4).cast("string"), "named": lambda d: d["event_type"]}
    out = routing.merge_branches(e, "event_id", branches, {"named": F.col("event_type") != "error"})
    return out.select("event_id", F.try_element_at("merged_branches", F.lit("double")).alias("double"), F.try_element_at("merged_branches", F.lit("named")).alias("named"))


@query("""WITH e AS (SELECT c_custkey, list_filter([CASE WHEN c_acctbal < 0 THEN 'negative balance' END, CASE WHEN c_nationkey > 20 THEN 'unknown nation' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'closed segment' END], lambda x: x IS NOT NULL) AS errors FROM customer)
SELECT c_custkey, len(errors) = 0 AS validation_passed, CASE WHEN len(errors) > 0 THEN 'Validation failed: ' || array_to_string(errors, ', ') END AS error FROM e""")
def validate_errors(spark, sf_dir):
    rules = [(F.col("c_acctbal") >= 0, "negative balance"), (F.col("c_nationkey") <= 20, "unknown nation"), (F.col("c_mktsegment") != "MACHINERY", "closed segment")]
    return routing.validate(table(spark, sf_dir, "customer"), rules).select("c_custkey", "validation_passed", "error")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'done' ELSE o_orderstatus END AS status, o_orderpriority AS priority FROM orders""")
def enrich_state_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    state = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"))
    new = F.when(F.col("o_orderstatus") == "F", F.create_map(F.lit("status"), F.lit("done"))).otherwise(F.create_map().cast("map<string,string>"))
    out = o.select("o_orderkey", routing.enrich(state, new).alias("s"))
    return out.select("o_orderkey", F.col("s")["status"].alias("status"), F.col("s")["priority"].alias("priority"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) * 2 AS result FROM events""")
def bench_double(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", (F.get_json_object("props", "$.k").cast("long") * 2).alias("result"))


@query("""WITH p AS (SELECT user_id, event_type, max(CASE WHEN value > 60 THEN 1 ELSE 0 END) AS ok FROM events GROUP BY ALL)
SELECT user_id, coalesce(string_agg(CASE WHEN ok = 1 THEN event_type END, ',' ORDER BY event_type), '') AS reachable, sum(CASE WHEN event_type IN ('view', 'click') THEN ok ELSE 0 END) = 2 AS useful FROM p GROUP BY 1""")
def health_aggregate(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("ok", F.col("value") > 60)
    return routing.health(e, "user_id", "event_type", "ok", ["view", "click"])


# ---- statistics


@query("""WITH s AS (SELECT event_type, list(value ORDER BY value) AS v, avg(value) AS a, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1)
SELECT event_type, v[CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) + 1] AS p95, v[CAST(round_even(0.99 * (n - 1), 0) AS BIGINT) + 1] AS p99, round(a, 6) AS avg, n AS count FROM s""")
def latency_percentiles(spark, sf_dir):
    out = stats.latency_percentiles(table(spark, sf_dir, "events"), "event_type", "value")
    return out.select("event_type", "p95", "p99", r6("avg", "avg"), "count")


@query(f"""WITH {CALLS}, h AS (SELECT *, row_number() OVER (PARTITION BY lookup_key ORDER BY ts, event_id) > 1 AS hit FROM calls)
SELECT round(avg(CAST(hit AS INT)), 6) AS warm_rate, round(avg(CAST(success AS INT)), 6) AS useful_rate, CAST(sum(CAST(hit AS INT)) AS BIGINT) AS downstream_saved FROM h""")
def usefulness_stats(spark, sf_dir):
    h = memo.hit_or_miss(calls(spark, sf_dir), "lookup_key", ["ts", "event_id"])
    out = stats.usefulness(h, F.col("hit"), F.col("success"))
    return out.select(r6("warm_rate", "warm_rate"), r6("useful_rate", "useful_rate"), "downstream_saved")


@query(f"""WITH {PATHS}, p AS (SELECT user_id % 10 AS intent, path, count(*) AS n, sum(CAST(success AS INT)) AS s, sum(value) AS l FROM runs GROUP BY ALL)
SELECT intent, CAST(sum(n) AS BIGINT) AS executions, CAST(sum(s) AS BIGINT) AS successes, round(sum(l) / sum(n), 6) AS avg_latency, round(sum(s) / sum(n), 6) AS success_rate, first(path ORDER BY n DESC, path) AS common_path FROM p GROUP BY 1""")
def execution_patterns(spark, sf_dir):
    r = runs(spark, sf_dir).withColumn("intent", F.col("user_id") % 10)
    out = stats.execution_patterns(r, "intent", "path", "success", "value")
    return out.select("intent", "executions", "successes", r6("avg_latency", "avg_latency"), r6("success_rate", "success_rate"), "common_path")


@query(f"""WITH {PATHS} SELECT path, count(*) AS executions, round(avg(value), 6) AS avg_latency, round(avg(CAST(success AS INT)), 6) AS success_rate FROM runs GROUP BY 1""")
def pipeline_perf_report(spark, sf_dir):
    out = stats.performance_report(runs(spark, sf_dir), "path", "success", "value")
    return out.select("path", "executions", r6("avg_latency", "avg_latency"), r6("success_rate", "success_rate"))


@query("""SELECT event_id, round(avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) + 1e-9, 6) AS rolling_avg FROM events""")
def rolling_last100(spark, sf_dir):
    out = stats.rolling_mean(table(spark, sf_dir, "events"), "event_type", ["ts", "event_id"], "value")
    return out.select("event_id", r6(F.col("rolling_avg") + 1e-9, "rolling_avg"))


@query("""SELECT doc_id // 5 AS request, CAST(sum(quality) AS BIGINT) AS yes, count(*) AS votes, sum(quality) * 2 > count(*) AS decision, sum(quality) IN (0, count(*)) AS unanimous FROM labels GROUP BY 1""")
def collective_decision(spark, sf_dir):
    v = table(spark, sf_dir, "labels").withColumn("request", F.floor(F.col("doc_id") / 5))
    return stats.majority(v, "request", "quality")


@query("""SELECT doc_id // 5 AS request, round(avg(0.3 + 0.6 * quality - 0.2 * toxic), 6) AS average, round(max(0.3 + 0.6 * quality - 0.2 * toxic), 6) AS highest, max(doc_id) AS union_value, first(doc_id ORDER BY round(0.3 + 0.6 * quality - 0.2 * toxic, 6) DESC, doc_id) AS highest_value FROM labels GROUP BY 1""")
def confidence_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").withColumn("request", F.floor(F.col("doc_id") / 5)).withColumn("confidence", F.round(0.3 + 0.6 * F.col("quality") - 0.2 * F.col("toxic"), 6))
    out = stats.merge_confidence(rows, "request", "doc_id", "confidence", "doc_id")
    return out.select("request", r6("average", "average"), r6("highest", "highest"), "union_value", "highest_value")


@query("""SELECT user_id, count(*) AS requests, round(sum(value), 4) AS compute, count(*) < 60 AS within_quota FROM events GROUP BY 1""")
def tenant_usage_quota(spark, sf_dir):
    out = stats.tenant_usage(table(spark, sf_dir, "events"), "user_id", "value", 60)
    return out.select("user_id", "requests", F.round("compute", 4).alias("compute"), "within_quota")


@query("""WITH b AS (SELECT unnest([0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0]) AS b UNION ALL SELECT CAST('inf' AS DOUBLE))
SELECT event_type, CASE WHEN isinf(b) THEN '+Inf' ELSE CAST(b AS DOUBLE)::VARCHAR END AS le, count(*) FILTER (WHERE value / 10 <= b) AS n FROM events CROSS JOIN b WHERE value IS NOT NULL GROUP BY ALL""")
def histogram_buckets(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("seconds", F.col("value") / 10)
    return stats.histogram(e, "event_type", "seconds", stats.PIPELINE_BUCKETS)


# ---- swarm


@query("""SELECT CAST(l_orderkey % 8 AS INT) AS part, sum(l_quantity) AS partition_result, count(*) AS items FROM lineitem GROUP BY 1""")
def swarm_sum_partition(spark, sf_dir):
    return swarm.map_reduce(table(spark, sf_dir, "lineitem"), (F.col("l_orderkey") % 8).cast("int"), "l_quantity")


@query("""SELECT event_id, CAST((row_number() OVER (ORDER BY event_id) - 1) % 4 AS INT) AS part FROM events""")
def swarm_round_robin(spark, sf_dir):
    return swarm.round_robin(table(spark, sf_dir, "events").select("event_id"), "event_id", 4).select("event_id", "part")


@query("""SELECT event_id, CAST(('0x' || md5(props || CAST(event_id AS VARCHAR)))::UHUGEINT % 7 AS INT) AS part FROM events""")
def swarm_hash_partition(spark, sf_dir):
    return swarm.hash_partition(table(spark, sf_dir, "events"), F.concat("props", F.col("event_id").cast("string")), 7).select("event_id", "part")


@query("""SELECT count(*) AS worker_count, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS error_count, round(avg(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END), 6) AS error_rate FROM events""")
def swarm_error_rate(spark, sf_dir):
    out = swarm.error_rate(table(spark, sf_dir, "events"), F.col("event_type") == "error")
    return out.select("worker_count", "error_count", r6("error_rate", "error_rate"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN round(value * 2, 6) END AS result, CASE WHEN event_type = 'error' THEN 'failed item' END AS error FROM events""")
def swarm_guarded_map(spark, sf_dir):
    def double(pdf):
        failed = pdf["event_type"] == "error"
        if failed.any():
            raise swarm.FailedItems(failed.map({True: "failed item", False: None}))
        return (pdf["value"] * 2).round(6)

    e = table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return swarm.guarded_map(e, double, "event_id long, event_type string, value double, result double, error string").select("event_id", "result", "error")


# ---- placement


@query("""SELECT user_id, first(event_type ORDER BY value, event_id) AS winner, min(value) AS duration FROM events WHERE event_type <> 'error' AND value <= 5000 GROUP BY 1""")
def time_split_winner(spark, sf_dir):
    return placement.first_success(calls(spark, sf_dir), "user_id", "value", "success", "event_type", "event_id").select("user_id", "winner", "duration")


@query("""WITH k AS (SELECT s_suppkey % 20 AS request, n_regionkey AS cluster, CASE WHEN s_acctbal > 3000 THEN 1.0 ELSE 0.5 END AS w FROM supplier JOIN nation ON s_nationkey = n_nationkey), s AS (SELECT request, cluster, sum(w) AS score FROM k GROUP BY ALL)
SELECT request, first(cluster ORDER BY score DESC, cluster) AS best_cluster, CAST(max(score) AS DOUBLE) AS score FROM s GROUP BY 1""")
def gravity_best_cluster(spark, sf_dir):
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    rows = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select((F.col("s_suppkey") % 20).alias("request"), F.col("n_regionkey").alias("cluster"), F.when(F.col("s_acctbal") > 3000, "data").otherwise("capability").alias("kind"))
    return placement.best_cluster(rows, "request", "cluster")


def _cost_sql(score: str) -> str:
    return f"""WITH n AS (SELECT s_nationkey, s_suppkey, avg(l_quantity) AS latency, avg(l_discount) AS cost, 1 - avg(l_tax) AS reliability FROM supplier JOIN lineitem ON s_suppkey = l_suppkey GROUP BY ALL), s AS (SELECT *, round({score}, 6) AS score FROM n)
SELECT s_nationkey, first(s_suppkey ORDER BY score, s_suppkey) AS node, min(score) AS score FROM s GROUP BY 1"""


def _cost(spark, sf_dir, mode):
    s, li = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "lineitem")
    facts = li.groupBy("l_suppkey").agg(F.avg("l_quantity").alias("latency"), F.avg("l_discount").alias("cost"), (1 - F.avg("l_tax")).alias("reliability"))
    nodes = s.join(facts, F.col("s_suppkey") == F.col("l_suppkey"))
    scored = nodes.withColumn("latency", F.round(placement.cost_score(mode), 6))
    return placement.select_by_cost(scored, "s_nationkey", "s_suppkey", "fastest")


@query(_cost_sql("latency"))
def cost_select_fastest(spark, sf_dir):
    return _cost(spark, sf_dir, "fastest")


@query(_cost_sql("cost"))
def cost_select_cheapest(spark, sf_dir):
    return _cost(spark, sf_dir, "cheapest")


@query(_cost_sql("latency * 0.4 + cost * 100 * 0.3 + (1 - reliability) * 100 * 0.3"))
def cost_select_balanced(spark, sf_dir):
    return _cost(spark, sf_dir, "balanced")


@query("""WITH m AS (SELECT event_id, user_id, event_type AS to_node, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_node FROM events) SELECT event_id, user_id, from_node, to_node FROM m WHERE from_node <> to_node""")
def migration_log(spark, sf_dir):
    return placement.migration_log(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], "event_type").select("event_id", "user_id", "from_node", "to_node")


# ---- lineage and knowledge

NODES_SQL = "nodes AS (SELECT conv_id || ':' || turn AS node, CASE WHEN turn > 0 THEN conv_id || ':' || (turn - 1) END AS parent, conv_id, turn FROM conversations)"


def nodes(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    name = lambda t: F.concat_ws(":", F.col("conv_id").cast("string"), t.cast("string"))
    return c.select(name(F.col("turn")).alias("node"), F.when(F.col("turn") > 0, name(F.col("turn") - 1)).alias("parent"), "conv_id", "turn")


@query(f"""WITH RECURSIVE {NODES_SQL}, d AS (SELECT node, node AS root, 0 AS depth FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM nodes p WHERE p.node = n.parent) UNION ALL SELECT n.node, d.root, d.depth + 1 FROM nodes n JOIN d ON n.parent = d.node) SELECT node, root, CAST(depth AS BIGINT) AS depth FROM d""")
def lineage_root_path(spark, sf_dir):
    return lineage.roots(nodes(spark, sf_dir).dropDuplicates(["node"]), "node", "parent")


@query(f"""WITH RECURSIVE {NODES_SQL}, c AS (SELECT node, node AS a, 0 AS distance FROM nodes UNION ALL SELECT c.node, p.node, c.distance + 1 FROM c JOIN nodes n ON n.node = c.a JOIN nodes p ON p.node = n.parent) SELECT a AS node, count(*) AS descendants, max(distance) AS height FROM c WHERE distance > 0 GROUP BY 1""")
def lineage_descendants(spark, sf_dir):
    return lineage.descendants(nodes(spark, sf_dir), "node", "parent")


@query(f"""WITH RECURSIVE {NODES_SQL}, c AS (SELECT node, node AS ancestor, 0 AS distance FROM nodes UNION ALL SELECT c.node, p.node, c.distance + 1 FROM c JOIN nodes n ON n.node = c.ancestor JOIN nodes p ON p.node = n.parent) SELECT node, ancestor, distance FROM c""")
def memory_ancestry(spark, sf_dir):
    return lineage.ancestors(nodes(spark, sf_dir), "node", "parent")


@query("""SELECT d.doc_id AS child, d.source AS key, round((0.3 + 0.5 * quality) * 0.9, 6) AS confidence FROM documents d JOIN labels l ON l.doc_id = d.doc_id // 2 WHERE 0.3 + 0.5 * quality > 0.5""")
def spawn_child_inherit(spark, sf_dir):
    d, la = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    atoms = la.select("doc_id", (0.3 + 0.5 * F.col("quality")).alias("confidence"))
    children = d.select(F.col("doc_id").alias("child"), F.floor(F.col("doc_id") / 2).alias("parent"), F.col("source").alias("key"))
    return lineage.spawn(children.select("parent").distinct(), children, atoms, "doc_id").select("child", "key", r6("confidence", "confidence"))


@query("""SELECT conv_id, turn, CASE WHEN turn = 0 THEN 0.95 WHEN 0.95 * pow(0.9, turn - 1) > 0.5 THEN round(0.95 * pow(0.9, turn), 6) END AS confidence FROM conversations""")
def knowledge_decay_generations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", r6(lineage.decayed(F.lit(0.95), F.col("turn")), "confidence"))


@query("""SELECT event_id, round(value / 500 * 0.8, 6) AS confidence FROM events WHERE value / 500 > 0.3""")
def inherit_from_low_threshold(spark, sf_dir):
    atoms = table(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 500)
    return lineage.inherit(atoms, lineage.INHERIT_LEAST, lineage.INHERIT_FACTOR).select("event_id", r6("confidence", "confidence"))


@query("""SELECT user_id, event_type AS key, max_by(props, event_id) AS value, max(value) AS confidence, min_by(event_id, event_id) AS source FROM events GROUP BY 1, 2""")
def knowledge_upsert(spark, sf_dir):
    atoms = table(spark, sf_dir, "events").select("user_id", F.col("event_type").alias("key"), F.col("props").alias("value"), F.col("value").alias("confidence"), F.col("event_id").alias("source"), "event_id")
    return lineage.upsert(atoms, "user_id", "key", "event_id")


@query("""SELECT event_id, round(value / 200, 6) AS confidence FROM events WHERE event_type = 'click' AND value / 200 >= 0.5""")
def knowledge_query(spark, sf_dir):
    atoms = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("key"), (F.col("value") / 200).alias("confidence"))
    return lineage.query(atoms, "click").select("event_id", r6("confidence", "confidence"))


EDGES = [("auth", "fetch"), ("fetch", "filter"), ("fetch", "aggregate"), ("filter", "format"), ("aggregate", "format"), ("format", "respond"), ("auth", "respond")]
EDGES_SQL = ", ".join(str(e) for e in EDGES)


@query(f"""WITH RECURSIVE e(src, dst) AS (VALUES {EDGES_SQL}), r AS (SELECT src AS start, src AS node, 0 AS distance, src AS path FROM e WHERE src = 'auth' UNION SELECT r.start, e.dst, r.distance + 1, r.path || '->' || e.dst FROM r JOIN e ON r.node = e.src WHERE r.distance < 10), d AS (SELECT start, node, min(distance) AS distance FROM r GROUP BY ALL)
SELECT d.start, d.node, d.distance, min(r.path) AS path FROM d JOIN r USING (start, node, distance) GROUP BY ALL""")
def capability_reachability(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    return lineage.reachable(edges, spark.createDataFrame([("auth",)], "start string"))


# ---- similarity


STATE = "list_sort(['s' || (doc_id % 5), 'n' || (n_chars % 3), 'src'])"


@query(f"""WITH d AS (SELECT doc_id AS id, lang AS intent, {STATE} AS keys FROM documents WHERE doc_id < 100000), s AS (SELECT q.id, c.id AS similar_id, 0.5 + 0.3 * len(list_intersect(q.keys, c.keys)) / len(list_distinct(q.keys || c.keys)) AS score FROM d q JOIN d c ON q.intent = c.intent AND q.id <> c.id WHERE q.id % 100 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 9) DESC, similar_id) AS rank FROM s)
SELECT id, CAST(rank AS INT) AS rank, similar_id, round(score, 6) AS score FROM r WHERE rank <= 5""".replace(" WHERE doc_id < 100000", ""))
def similar_topk_state_keys(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    own = F.array(F.concat(F.lit("s"), (F.col("doc_id") % 5).cast("string")), F.concat(F.lit("n"), (F.col("n_chars") % 3).cast("string")), F.lit("src"))
    rows = d.select(F.col("doc_id").alias("id"), F.col("lang").alias("intent"), own.alias("keys"))
    out = similarity.similar_by_state(rows, rows.filter("id % 100 = 0"))
    return out.select("id", "rank", "similar_id", r6("score", "score"))


@query("""WITH d AS (SELECT event_id AS id, event_type AS intent, CAST(user_id % 30 AS VARCHAR) AS hash, ['c' || (event_id % 4), 'c' || (user_id % 3 + 2)] AS path FROM events), q AS (SELECT * FROM d WHERE id % 100 = 0),
s AS (SELECT q.id, c.id AS similar_id, round(least(1.0, 0.4 * CAST(q.intent = c.intent AS INT) + 0.4 * CAST(q.hash = c.hash AS INT) + 0.1 * len(list_filter(q.path, lambda x: list_contains(c.path, x))) / len(q.path)), 9) AS score FROM q JOIN d c ON q.id <> c.id), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, similar_id) AS rank FROM s WHERE score > 0)
SELECT id, CAST(rank AS INT) AS rank, similar_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def similar_weighted_index(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    path = F.array(F.concat(F.lit("c"), (F.col("event_id") % 4).cast("string")), F.concat(F.lit("c"), (F.col("user_id") % 3 + 2).cast("string")))
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("intent"), (F.col("user_id") % 30).cast("string").alias("hash"), path.alias("path"))
    out = similarity.similar_weighted(rows, rows.filter("id % 100 = 0"))
    return out.select("id", "rank", "similar_id", r6("score", "score"))


@query(None)
def intent_jaccard(spark, sf_dir):
    """Documents' word sets, of whole texts, that are nearly the same; a set's key is the SHA-256 of its words."""
    out = similarity.similar_word_sets(table(spark, sf_dir, "documents"))
    return out.select("key_a", "key_b", r6("similarity", "similarity"))


# ---- planning

KEYWORDS = [("the", ["fetch"]), ("ing", ["filter"]), ("tion", ["aggregate", "format"]), ("worthless", ["moderate"])]


@query("""WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN contains(t, 'worthless') OR contains(t, 'tion') OR contains(t, 'the') OR contains(t, 'ing') THEN concat_ws(',', CASE WHEN contains(t, 'worthless') THEN 'moderate' END, CASE WHEN contains(t, 'tion') THEN 'aggregate,format' END, CASE WHEN contains(t, 'the') THEN 'fetch' END, CASE WHEN contains(t, 'ing') THEN 'filter' END) ELSE 'fallback' END AS plan FROM d""")
def plan_keywords(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", F.array_join(planning.plan_by_keywords(F.col("text"), KEYWORDS, ["fallback"]), ",").alias("plan"))


_KIND_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){pattern}') THEN '{kind}'" for kind, pattern in planning.INTENT_PATTERNS) + " ELSE 'unknown' END"
_ENTITY_SQL = "CASE " + " ".join(f"WHEN regexp_matches(text, '(?i){pattern}') THEN regexp_extract(text, '(?i){pattern}', 2)" for _, pattern in planning.INTENT_PATTERNS) + " END"


def turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")


@query(f"""SELECT conv_id, turn, {_KIND_SQL} AS kind, {_ENTITY_SQL} AS entity, CASE WHEN {_KIND_SQL} = 'unknown' THEN 0.1 ELSE 0.9 END::DOUBLE AS confidence FROM conversations""")
def intent_parse_regex(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", planning.parse_intent(F.col("text")).alias("p")).select("conv_id", "turn", "p.kind", "p.entity", "p.confidence")


@query(f"""WITH k AS (SELECT conv_id, turn, {_KIND_SQL} AS kind FROM conversations) SELECT conv_id, turn, CASE kind WHEN 'format' THEN 'format.apply' WHEN 'validate' THEN 'validate.input' WHEN 'fetch' THEN 'auth.validate,data.fetch' WHEN 'create' THEN 'auth.validate,validate.input' WHEN 'update' THEN 'auth.validate,validate.input'
WHEN 'analyze' THEN 'auth.validate,data.fetch' WHEN 'aggregate' THEN 'auth.validate,data.fetch' WHEN 'delete' THEN 'auth.validate' WHEN 'transform' THEN 'auth.validate' WHEN 'compute' THEN 'auth.validate' ELSE '' END AS path FROM k""")
def plan_default_paths(spark, sf_dir):
    kind = planning.parse_intent(F.col("text"))["kind"]
    known = ["auth.validate", "data.fetch", "validate.input", "format.apply"]
    return turns(spark, sf_dir).select("conv_id", "turn", F.array_join(planning.plan_path(kind, planning.DEFAULT_PATHS, known), ",").alias("path"))


@query("""SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN 'unknown' ELSE event_type END AS kind, CASE WHEN event_id % 7 = 0 THEN NULL ELSE props END AS entity, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 2 = 0 THEN 0.25 ELSE 1.0 END::DOUBLE AS confidence FROM events""")
def structured_intent(spark, sf_dir):
    """Intents given as JSON objects; fields may be missing, and some are no objects."""
    kind = F.when(F.col("event_id") % 7 != 1, F.col("event_type"))
    given = F.to_json(F.struct(kind.alias("kind"), F.col("props").alias("entity"), F.when(F.col("event_id") % 2 == 0, 0.25).alias("confidence")))
    out = planning.structured_intent(F.when(F.col("event_id") % 7 != 0, given))
    return table(spark, sf_dir, "events").select("event_id", out.alias("i")).select("event_id", "i.kind", "i.entity", "i.confidence")


@query(f"""WITH {PATHS} SELECT user_id, max_by(path, event_id) AS learned_path FROM runs WHERE success AND value < 100 GROUP BY 1""")
def learned_paths(spark, sf_dir):
    return planning.learn_paths(runs(spark, sf_dir), "user_id", "path", "success", F.when(F.col("value") < 100, 0.9).otherwise(1.0), "event_id")


@query(f"""WITH {PATHS} SELECT path, round(0.9 * avg(CAST(success AS INT)), 6) AS confidence, round(avg(value), 6) AS expected_latency FROM runs GROUP BY 1""")
def adaptive_planner(spark, sf_dir):
    """A plan for each path that was ever taken."""
    r = runs(spark, sf_dir)
    plans = r.select("path").distinct().withColumn("confidence", F.lit(0.9))
    out = planning.adaptive_confidence(plans, evolution.path_stats(r, "path", "success", "value"), "path")
    return out.select("path", r6("confidence", "confidence"), r6("expected_latency", "expected_latency"))


# ---- evolution

VALID_GENES = ["view", "click", "signup", "purchase"]


@query(f"""WITH {PATHS}, s AS (SELECT event_type, path, round(avg(CAST(success AS INT)) * 1000 / (avg(value) + 100), 9) AS score, min(event_id) AS seq FROM runs GROUP BY ALL)
SELECT event_type, first(path ORDER BY score DESC, seq) AS best_path, round(max(score), 6) AS score FROM s GROUP BY 1""")
def evolve_best_pipeline(spark, sf_dir):
    r = runs(spark, sf_dir)
    candidates = r.groupBy("event_type", "path").agg(F.min("event_id").alias("seq"))
    out = evolution.best_pipeline(candidates, evolution.path_stats(r, "path", "success", "value"), "event_type", "path", "seq")
    return out.select("event_type", "best_path", r6("score", "score"))


@query(f"""WITH {PATHS} SELECT path, count(*) AS executions, round(avg(CAST(success AS INT)), 6) AS success_rate, round(avg(value), 6) AS avg_latency, round(first(0.7 * CAST(success AS INT) + 0.3 * greatest(0, 1 - value / 10000) ORDER BY event_id), 6) AS fitness FROM runs GROUP BY 1""")
def genome_fitness_best(spark, sf_dir):
    out = evolution.genomes(runs(spark, sf_dir), "path", "event_id", "success", "value")
    return out.select("path", "executions", r6("success_rate", "success_rate"), r6("avg_latency", "avg_latency"), r6("fitness", "fitness"))


@query(f"""WITH {PATHS}, s AS (SELECT user_id, path, avg(CAST(success AS INT)) AS rate, avg(value) AS lat FROM runs GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rate DESC, lat, path) AS n FROM s) SELECT user_id, path, round(rate, 6) AS success_rate, round(lat, 6) AS avg_latency FROM r WHERE n = 1""")
def history_best_path(spark, sf_dir):
    out = evolution.history_best(runs(spark, sf_dir), "user_id", "path", "success", "value")
    return out.select("user_id", "path", r6("success_rate", "success_rate"), r6("avg_latency", "avg_latency"))


@query("""WITH g AS (SELECT user_id, count(DISTINCT event_type) AS d, count(*) AS n, max(CAST(event_type = 'error' AS INT)) AS bad FROM events GROUP BY 1) SELECT user_id, round(CASE WHEN bad = 1 THEN 0 ELSE 0.5 END + 0.5 * d / n, 6) AS fitness FROM g""")
def gene_fitness(spark, sf_dir):
    """Fitness of all events of each user."""
    out = evolution.gene_fitness_by(table(spark, sf_dir, "events"), "user_id", "event_type", VALID_GENES)
    return out.select("user_id", r6("fitness", "fitness"))


@query(f"""WITH {PATHS}, g AS (SELECT path, count(*) AS e, round(avg(CAST(success AS INT)), 6) AS s, round(avg(value), 6) AS l, round(first(0.7 * CAST(success AS INT) + 0.3 * greatest(0, 1 - value / 10000) ORDER BY event_id), 6) AS f FROM runs GROUP BY 1)
SELECT count(*) AS genomes, CAST(sum(e) AS BIGINT) AS executions, round(avg(s), 5) AS mean_success_rate, round(avg(l), 5) AS mean_latency, max(f) AS best_fitness FROM g""")
def dna_statistics(spark, sf_dir):
    g = genome_fitness_best(spark, sf_dir)
    out = evolution.totals(g)
    return out.select("genomes", "executions", F.round("mean_success_rate", 5).alias("mean_success_rate"), F.round("mean_latency", 5).alias("mean_latency"), "best_fitness")


GENOMES = f"""genomes AS (SELECT event_id, list_filter([event_type, lead(event_type, 1) OVER w, lead(event_type, 2) OVER w, lead(event_type, 3) OVER w], lambda x: x IS NOT NULL) AS genes, {VALID_GENES} AS pool FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


def _draw(salt: str, *of: str) -> str:
    """SQL of the number in [0, 1) that variation draws."""
    return f"(('0x' || substr(md5(concat_ws('|', '{salt}', {', '.join(of)})), 25))::BIGINT / 4294967296e0)"


def _genomes(spark, sf_dir):
    """The path of up to four capabilities that each event begins."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    steps = [F.col("event_type"), *[F.lead("event_type", k).over(w) for k in (1, 2, 3)]]
    return table(spark, sf_dir, "events").select("event_id", F.filter(F.array(*steps), lambda g: g.isNotNull()).alias("genes"), F.array(*[F.lit(g) for g in VALID_GENES]).alias("pool"))


@query(f"""WITH {GENOMES}, p AS (SELECT *, floor({_draw('at', 'event_id')} * (len(genes) + 1))::INT AS a, pool[floor({_draw('what', 'event_id')} * len(pool))::INT + 1] AS x, floor({_draw('del', 'event_id')} * len(genes))::INT AS d FROM genomes)
SELECT event_id, array_to_string(genes, ',') AS genome, array_to_string(list_transform(range(0, len(genes)), lambda i: CASE WHEN {_draw('mutate', 'event_id', 'i')} < 0.1e0 THEN pool[floor({_draw('gene', 'event_id', 'i')} * len(pool))::INT + 1] ELSE genes[i + 1] END), ',') AS replaced,
array_to_string(genes[1:a] || [x] || genes[a + 1:], ',') AS inserted, array_to_string(CASE WHEN len(genes) <= 1 THEN genes ELSE genes[1:d] || genes[d + 2:] END, ',') AS deleted FROM p""")
def genome_mutate(spark, sf_dir):
    """Replacement, insertion and deletion of genes in every genome, drawn from a hash of its id."""
    g, p, s = F.col("genes"), F.col("pool"), F.col("event_id")
    varied = {"genome": g, "replaced": evolution.mutate(g, p, s), "inserted": evolution.insert_gene(g, p, s), "deleted": evolution.delete_gene(g, s)}
    return _genomes(spark, sf_dir).select("event_id", *[F.array_join(v, ",").alias(name) for name, v in varied.items()])


@query(f"""WITH {GENOMES}, b AS (SELECT a.event_id, a.genes, o.genes AS other, least(len(a.genes), len(o.genes)) AS n FROM genomes a JOIN genomes o ON o.event_id = a.event_id + 1), c AS (SELECT *, floor({_draw('cut', 'event_id')} * n)::INT AS cut FROM b)
SELECT event_id, array_to_string(CASE WHEN {_draw('cross', 'event_id')} < 0.7e0 AND n > 1 THEN genes[1:cut] || other[cut + 1:] ELSE genes END, ',') AS child,
array_to_string(list_filter(list_transform(range(0, greatest(len(genes), len(other))), lambda i: CASE WHEN {_draw('side', 'event_id', 'i')} < 0.5e0 THEN genes[i + 1] ELSE other[i + 1] END), lambda x: x IS NOT NULL), ',') AS uniform FROM c""")
def genome_crossover(spark, sf_dir):
    """Children of every genome and that of the next id."""
    a = _genomes(spark, sf_dir).select("event_id", "genes")
    both = a.join(a.select((F.col("event_id") - 1).alias("event_id"), F.col("genes").alias("other")), "event_id")
    g, o, s = F.col("genes"), F.col("other"), F.col("event_id")
    return both.select("event_id", F.array_join(evolution.crossover(g, o, s), ",").alias("child"), F.array_join(evolution.uniform_crossover(g, o, s), ",").alias("uniform"))


@query(f"""WITH i AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS place, event_id, value FROM events), d AS (SELECT r AS round, floor({_draw('draw', 'r', 'k')} * (SELECT count(*) FROM events))::BIGINT AS place FROM range(20) a(r), range(1, 4) b(k))
SELECT d.round, first(event_id ORDER BY value DESC, event_id) AS winner FROM d JOIN i USING (place) GROUP BY 1""")
def tournament(spark, sf_dir):
    return evolution.tournament(table(spark, sf_dir, "events").select("event_id", "value"), "event_id", "value", 20)


# ---- features, tenants, confidence


@query("""WITH b AS (SELECT c_custkey, ('0x' || md5('checkout:' || c_custkey))::UHUGEINT % 100 AS m FROM customer) SELECT c_custkey, CASE WHEN m < 50 THEN 'control' WHEN m < 80 THEN 'blue' ELSE 'green' END AS variant FROM b""")
def feature_variant_bucket(spark, sf_dir):
    """A variant by cumulative shares of 50, 30 and 20 percent."""
    out = features.variant("checkout", F.col("c_custkey"), [("control", 50), ("blue", 30), ("green", 20)])
    return table(spark, sf_dir, "customer").select("c_custkey", out.alias("variant"))


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_nationkey % 2 = 0 WHEN c_mktsegment = 'MACHINERY' THEN FALSE ELSE TRUE END AS enabled FROM customer""")
def feature_enabled_override(spark, sf_dir):
    """A tenant's override, false where its table has the tenant but no value; else the flag itself."""
    c = table(spark, sf_dir, "customer")
    override = c.filter("c_mktsegment in ('BUILDING', 'MACHINERY')").select("c_custkey", F.when(F.col("c_mktsegment") == "BUILDING", F.col("c_nationkey") % 2 == 0).alias("own"), F.lit(True).alias("listed"))
    return c.join(override, "c_custkey", "left").select("c_custkey", features.enabled(F.lit(True), F.col("listed"), F.col("own")).alias("enabled"))


@query("""SELECT c_custkey, c_nationkey < 5 OR c_mktsegment = 'BUILDING' AS access FROM customer""")
def tenant_access(spark, sf_dir):
    """An empty list of allowed capabilities allows all."""
    allowed = F.when(F.col("c_nationkey") < 5, F.array().cast("array<string>")).otherwise(F.array("c_mktsegment"))
    return table(spark, sf_dir, "customer").select("c_custkey", features.has_access(allowed, "BUILDING").alias("access"))


@query("""SELECT d.doc_id, round(0.5 * (CASE WHEN l.doc_id IS NOT NULL THEN 1.0 ELSE 2.0 / 3 END) + 0.5 * ((CASE WHEN d.text <> '' THEN 1 ELSE 0 END + CASE WHEN d.lang = 'en' THEN 1 ELSE 0 END + CASE WHEN l.quality = 1 THEN 1 ELSE 0 END) / 3.0), 6) AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def heuristic_confidence(spark, sf_dir):
    """Half for the share of expected keys that are there, half for the share of values that say something."""
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    out = features.heuristic_confidence([F.lit(True), F.lit(True), F.col("quality").isNotNull()], [F.col("text") != "", F.col("lang") == "en", F.col("quality") == 1])
    return d.select("doc_id", r6(out, "confidence"))


@query("""WITH c AS (SELECT doc_id, 0.5 + 0.2 * quality + 0.15 * (1 - toxic) AS c FROM labels) SELECT doc_id, round(c, 6) AS confidence, CASE WHEN round(c, 6) >= 0.9 THEN 'final' WHEN round(c, 6) >= 0.7 THEN 'partial' ELSE 'wait' END AS gate FROM c""")
def partial_gate(spark, sf_dir):
    c = F.round(features.estimate_confidence(F.col("quality") == 1, F.col("toxic") == 0), 6)
    return table(spark, sf_dir, "labels").select("doc_id", c.alias("confidence"), features.gate(c).alias("gate"))


@query("""SELECT doc_id, round(len(list_filter(range(1, 65), lambda i: substr(sha256(text), i, 1) = substr(sha256(lang), i, 1))) / 64, 6) AS similarity FROM documents WHERE text IS NOT NULL""")
def hash_similarity(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    return d.select("doc_id", r6(keys.equal_digits(F.sha2("text", 256), F.sha2("lang", 256)), "similarity"))


# ---- change


def _states(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    state = F.map_filter(F.create_map(F.lit("role"), F.col("role"), F.lit("size"), (F.length("text") % 3).cast("string"), F.lit("odd"), F.when(F.col("turn") % 2 == 1, "y")), lambda _, v: v.isNotNull())
    return c.select("conv_id", "turn", state.alias("state"))


@query("""WITH s AS (SELECT conv_id, turn, role, CAST(length(text) % 3 AS VARCHAR) AS size, turn % 2 = 1 AS odd FROM conversations), l AS (SELECT *, lag(role) OVER w AS r0, lag(size) OVER w AS s0, lag(odd) OVER w AS o0, lag(turn) OVER w AS t0 FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, CASE WHEN t0 IS NULL THEN 2 ELSE 0 END + CASE WHEN odd AND NOT coalesce(o0, FALSE) THEN 1 ELSE 0 END AS added, CASE WHEN NOT odd AND coalesce(o0, FALSE) THEN 'odd' ELSE '' END AS removed, CASE WHEN t0 IS NOT NULL AND role <> r0 THEN 1 ELSE 0 END + CASE WHEN t0 IS NOT NULL AND size <> s0 THEN 1 ELSE 0 END AS modified FROM l""")
def state_diff(spark, sf_dir):
    out = change.step_diffs(_states(spark, sf_dir), "conv_id", "turn", "state")
    return out.select("conv_id", "turn", F.size("step.added").alias("added"), F.array_join("step.removed", ",").alias("removed"), F.size("step.modified").alias("modified"))


@query("""WITH l AS (SELECT event_id, user_id, event_type, props AS new, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events) SELECT event_id, user_id, event_type, old, new FROM l WHERE old IS DISTINCT FROM new""")
def mutation_timeline(spark, sf_dir):
    out = change.mutations(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "props")
    return out.select("event_id", "user_id", "event_type", "old", "new")


@query("""WITH l AS (SELECT user_id, event_type, props AS new, lag(props) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS old FROM events) SELECT user_id, count(DISTINCT event_type) AS keys, count(*) AS changes FROM l WHERE old IS DISTINCT FROM new GROUP BY 1""")
def mutation_keys(spark, sf_dir):
    changes = change.mutations(table(spark, sf_dir, "events"), ["user_id", "event_type"], ["ts", "event_id"], "props")
    return change.mutation_keys(changes, "user_id", "event_type")


@query("""WITH f AS (SELECT conv_id, min(turn) AS cut FROM conversations WHERE role = 'assistant' GROUP BY 1) SELECT c.conv_id, turn, role FROM conversations c JOIN f ON c.conv_id = f.conv_id WHERE turn < cut""")
def replay_truncate(spark, sf_dir):
    return change.replay_from(table(spark, sf_dir, "conversations"), "conv_id", "turn", F.col("role") == "assistant").select("conv_id", "turn", "role")


@query("""SELECT 'fork_' || substr(sha256(conv_id || ':' || turn), 1, 12) AS node, conv_id || ':' || turn AS parent_id, 'forked' AS role FROM conversations""")
def fork_patch(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn("state", F.create_map(F.lit("role"), F.lit("any")))
    out = change.fork(n, "node", "state", F.create_map(F.lit("role"), F.lit("forked")))
    return out.select("node", "parent_id", F.col("state")["role"].alias("role"))


@query("""SELECT user_id, event_type, max_by(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY 1, 2""")
def snapshot_restore(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "props", "event_id")
    return change.snapshots(rows, "event_type", "user_id", "event_id").select("user_id", "event_type", "props", "event_id")


@query("""SELECT event_id FROM events WHERE user_id IN (1, 2, 3) AND event_type IN ('click', 'error')""")
def watcher_filter(spark, sf_dir):
    return change.watch(table(spark, sf_dir, "events"), [1, 2, 3], ["click", "error"], "user_id", "event_type").select("event_id")


@query("""SELECT page_id, '***REDACTED***' AS token, CASE WHEN url LIKE 'https%' THEN '***REDACTED***' ELSE NULL END AS password, url FROM pages""")
def log_redact(spark, sf_dir):
    fields = F.map_from_arrays(F.array(F.lit("Token"), F.lit("password"), F.lit("url")), F.array(F.lit("t"), F.lit("p"), F.col("url")))
    d = table(spark, sf_dir, "pages").select("page_id", change.redact(fields).alias("f"), F.col("url").startswith("https").alias("s"))
    return d.select("page_id", F.col("f")["Token"].alias("token"), F.when(F.col("s"), F.col("f")["password"]).alias("password"), F.col("f")["url"].alias("url"))


# ---- resilience


_IN_TURN = "e AS (SELECT event_id, user_id, epoch_us(ts) / 1e6 AS t, event_type <> 'error' AS ok, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events), u AS (SELECT DISTINCT user_id FROM events)"


@query(f"""WITH RECURSIVE {_IN_TURN}, f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, NULL::VARCHAR AS verdict, 0 AS n, NULL::DOUBLE AS since FROM u UNION ALL
SELECT user_id, k, event_id, CASE WHEN held THEN 'rejected' ELSE 'allowed' END, CASE WHEN held THEN n WHEN ok THEN greatest(0, m - 1) ELSE m + 1 END, CASE WHEN held THEN since WHEN NOT ok AND m >= 1 THEN t END
FROM (SELECT e.*, f.n, f.since, coalesce(e.t - f.since < 86400, FALSE) AS held, CASE WHEN f.since IS NULL THEN f.n ELSE 1 END AS m FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)) SELECT event_id, verdict FROM f WHERE k > 0""")
def circuit_breaker(spark, sf_dir):
    """Verdicts for each user's calls, a fold; in SQL a recursion over each user's first, second and further calls."""
    c = calls(spark, sf_dir).select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "success").withColumn("at", F.col("us") / 1e6)
    out = resilience.circuit_breaker(c, "user_id", ["us", "event_id"], "at", "success", failures=2, open_s=86400.0)
    return out.select("event_id", "verdict")


@query(f"""WITH RECURSIVE {_IN_TURN}, f AS (SELECT user_id, 0::BIGINT AS k, NULL::BIGINT AS event_id, FALSE AS granted, 2e0 AS tokens, NULL::DOUBLE AS t FROM u UNION ALL
SELECT user_id, k, event_id, have >= 1, CASE WHEN have >= 1 THEN have - 1 ELSE have END, t
FROM (SELECT e.*, CASE WHEN f.t IS NULL THEN 2e0 ELSE least(2e0, f.tokens + (e.t - f.t) * (1e0 / 43200)) END AS have FROM f JOIN e ON e.user_id = f.user_id AND e.k = f.k + 1)) SELECT event_id, granted FROM f WHERE k > 0""")
def token_bucket(spark, sf_dir):
    c = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us")).withColumn("at", F.col("us") / 1e6)
    return resilience.token_bucket(c, "user_id", ["us", "event_id"], "at", rate=1 / 43200, burst=2.0).select("event_id", "granted")


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'done' WHEN event_id % 4 + 1 >= 3 THEN 'dead' WHEN event_id % 4 = 0 THEN 'retry in 1.0 s' ELSE 'retry in 2.0 s' END AS action FROM events""")
def retry_plan(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", resilience.retry_plan(F.col("event_id") % 4 + 1, F.col("event_type") != "error").alias("action"))


# ---- documents


@query("""SELECT doc_id, CASE WHEN isnan(q) OR isinf(q) THEN 'qualityScore must be finite' WHEN q < 0 OR q > 1 THEN 'qualityScore must be between 0 and 1' WHEN doc_id % 5 = 0 THEN 'chunk ids must be unique' WHEN doc_id % 5 = 1 THEN 'chunk index must equal its position' WHEN doc_id % 5 = 2 THEN 'chunk needs text or storage' END AS error
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN CAST('nan' AS DOUBLE) WHEN doc_id % 7 = 1 THEN 1.5 ELSE n_chars / 1000000.0 END AS q FROM documents)""")
def doc_validate_rules(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    q = F.when(F.col("doc_id") % 7 == 0, float("nan")).when(F.col("doc_id") % 7 == 1, 1.5).otherwise(F.col("n_chars") / 1000000.0)
    n = F.col("doc_id") % 5
    chunk = lambda name, at, text: F.struct(name.alias("chunkId"), at.alias("index"), text.alias("text"), F.lit(None).cast("string").alias("storage"))
    chunks = F.array(
        chunk(F.lit("c0"), F.lit(0), F.lit("x")), chunk(F.when(n == 0, "c0").otherwise("c1"), F.when(n == 1, 5).otherwise(1), F.when(n != 2, "y"))
    )
    rows = d.select("doc_id", q.alias("q"), chunks.alias("chunks"))
    return rows.select("doc_id", documents.first_error(documents.score_rules(F.col("q")) + documents.chunk_rules(F.col("chunks"))).alias("error"))


@query("""SELECT page_id, CASE WHEN page_id % 3 = 0 THEN url WHEN page_id % 3 = 1 THEN 's3://pages/' || page_id ELSE CAST(page_id AS VARCHAR) END AS storage_key FROM pages""")
def doc_storage_key(spark, sf_dir):
    m, key = F.col("page_id") % 3, F.col("page_id").cast("string")
    out = documents.storage_key(F.when(m == 0, F.col("url")), F.when(m == 1, "s3"), F.lit("pages"), key)
    return table(spark, sf_dir, "pages").select("page_id", out.alias("storage_key"))


_KEY_SQL = "sha256(concat_ws('|', CASE WHEN lang IS NULL THEN '-' ELSE '=' || lang END, '=' || sha256(text)))"


@query(f"""SELECT doc_id, {_KEY_SQL} AS idempotency_key, 'docop_' || substr({_KEY_SQL}, 1, 24) AS operation_id FROM documents WHERE text IS NOT NULL""")
def doc_idempotency(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    key = documents.idempotency_key(F.col("lang"), F.sha2("text", 256))
    return d.select("doc_id", key.alias("idempotency_key"), documents.operation_id(key).alias("operation_id"))


_CLAIM_SQL = "a AS (SELECT doc_id, sha256(coalesce(text, '')) AS k, source AS f FROM documents), o AS (SELECT k, min(doc_id) AS owner, first(f ORDER BY doc_id) AS f0 FROM a GROUP BY 1), c AS (SELECT a.doc_id, o.owner, a.k, a.f, CASE WHEN a.doc_id = o.owner THEN 'owner' WHEN a.f = o.f0 THEN 'duplicate' ELSE 'conflict' END AS role FROM a JOIN o USING (k))"


def _claims(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"), F.col("source").alias("f"))
    return documents.claim(d, "k", "f", "doc_id")


@query(f"WITH {_CLAIM_SQL} SELECT doc_id, owner, role FROM c")
def doc_claim_owner(spark, sf_dir):
    return _claims(spark, sf_dir).select("doc_id", "owner", "role")


@query(f"WITH {_CLAIM_SQL} SELECT doc_id, k || ':conflict:' || substr(sha256(f), 1, 24) AS conflict_id FROM c WHERE role = 'conflict'")
def doc_conflicts(spark, sf_dir):
    return _claims(spark, sf_dir).filter("role = 'conflict'").select("doc_id", documents.conflict_id(F.col("k"), F.sha2("f", 256)).alias("conflict_id"))


@query("""SELECT d.doc_id, md5(CASE WHEN d.doc_id % 2 = 0 THEN d.text ELSE p.html END) AS content_md5, CASE WHEN d.doc_id % 2 = 0 THEN NULL WHEN d.doc_id % 5 = 0 THEN 'INVALID_STORAGE_REFERENCE' WHEN p.page_id IS NULL THEN 'STORAGE_CONTENT_NOT_FOUND' END AS error_code FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id AND d.doc_id % 2 = 1 AND d.doc_id % 5 <> 0 WHERE d.text IS NOT NULL""")
def doc_chunk_resolve(spark, sf_dir):
    d = table(spark, sf_dir, "documents").filter("text is not null")
    even, ref = F.col("doc_id") % 2 == 0, F.when((F.col("doc_id") % 2 == 1) & (F.col("doc_id") % 5 != 0), F.concat(F.lit("page://"), F.col("doc_id").cast("string")))
    chunks = d.select("doc_id", F.when(even, F.col("text")).alias("inline"), ref.alias("ref"))
    storage = table(spark, sf_dir, "pages").select(F.concat(F.lit("page://"), F.col("page_id").cast("string")).alias("ref"), F.col("html").cast("binary").alias("data"))
    out = documents.resolve_chunks(chunks, storage, "ref", "inline", "data")
    return out.select("doc_id", F.md5(F.col("content").cast("binary")).alias("content_md5"), "error_code")


@query("""SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN 'vector must be finite' WHEN vec_id % 10 = 1 THEN 'dimensions differ' WHEN vec_id % 10 = 2 THEN 'vector must not be empty' END AS error FROM embeddings""")
def doc_vector_validate(spark, sf_dir):
    v, n = F.col("embedding"), F.col("vec_id") % 10
    broken = F.when(n == 0, F.array_append(F.slice(v, 1, 63), F.lit(float("nan")).cast("float"))).when(n == 1, F.slice(v, 1, 3)).when(n == 2, F.array().cast("array<float>")).otherwise(v)
    return table(spark, sf_dir, "embeddings").select("vec_id", documents.vector_errors(broken, 64).alias("error"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'embedding=fulfilled,summary=unsupported' ELSE 'embedding=fulfilled' END AS artifacts FROM documents""")
def doc_artifact_status(spark, sf_dir):
    one = lambda t: F.struct(F.lit(t).alias("artifactType"))
    asked = F.when(F.col("doc_id") % 2 == 0, F.array(one("embedding"), one("summary"))).otherwise(F.array(one("embedding")))
    out = F.transform(documents.artifacts(asked), lambda a: F.concat_ws("=", a["artifactType"], a["status"]))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(out, ",").alias("artifacts"))


@query("""SELECT doc_id, CAST(length(text) AS DOUBLE) AS size, 2 AS dimensions FROM documents WHERE text IS NOT NULL""")
def doc_vectorize(spark, sf_dir):
    """A vectorizer as a function over batches of texts; here, constant and length."""
    d = table(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.col("text").alias("content"))
    out = documents.vectorize(d, lambda s: s.map(lambda t: [1.0, float(len(t))]))
    return out.select("doc_id", F.col("vector")[1].alias("size"), F.size("vector").alias("dimensions"))


def _operations(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("op"), F.col("event_id").cast("string")).alias("operation_id"), F.lit("processing").alias("status"), F.lit("t").alias("token"), (F.col("event_id") % 4 + 1).alias("attempt"), F.lit(None).cast("string").alias("outbox"),
        F.lit(None).cast("string").alias("outbox_topic"), F.col("ts").alias("lease_until"), F.col("ts").alias("updated_at"),
    )


def _outcomes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    code = F.when(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 0, "VECTORIZER_ERROR").otherwise("VALIDATION_ERROR"))
    return e.select(F.concat(F.lit("op"), F.col("event_id").cast("string")).alias("operation_id"), F.when(F.col("event_id") % 9 == 0, "old").otherwise("t").alias("token"), (F.col("event_type") != "error").alias("ok"), code.alias("error_code"), F.col("ts").alias("at"))


_STATUS_SQL = "CASE WHEN event_id % 9 = 0 THEN 'processing' WHEN event_type <> 'error' THEN 'succeeded' WHEN event_id % 2 = 1 THEN 'terminal_failure' WHEN event_id % 4 + 1 < 3 THEN 'retryable_failure' ELSE 'dead_lettered' END"


@query(f"SELECT 'op' || event_id AS operation_id, {_STATUS_SQL} AS status, event_id % 9 = 0 AS stale FROM events")
def doc_finish_fenced(spark, sf_dir):
    return documents.finish(_operations(spark, sf_dir), _outcomes(spark, sf_dir)).select("operation_id", "status", "stale")


@query(f"WITH o AS (SELECT 'op' || event_id AS operation_id, {_STATUS_SQL} AS status, ts FROM events) SELECT operation_id, CASE WHEN status = 'succeeded' THEN 'document.artifacts' ELSE 'pipeline.dead-letter' END AS outbox_topic FROM o WHERE status NOT IN ('processing', 'retryable_failure') ORDER BY ts, operation_id LIMIT 100")
def outbox_pending(spark, sf_dir):
    done = documents.finish(_operations(spark, sf_dir), _outcomes(spark, sf_dir))
    return documents.pending_outbox(done).select("operation_id", "outbox_topic")


@query(f"SELECT 'op' || event_id AS operation_id, CASE WHEN {_STATUS_SQL} = 'succeeded' THEN 'publish_ack' WHEN {_STATUS_SQL} = 'retryable_failure' THEN 'retry' ELSE 'dead_letter' END AS action FROM events")
def message_policy(spark, sf_dir):
    done = documents.finish(_operations(spark, sf_dir), _outcomes(spark, sf_dir))
    return done.select("operation_id", documents.message_action(F.col("status"), F.col("attempt")).alias("action"))


@query("""SELECT 'op' || event_id AS operation_id, event_id % 4 + 2 AS attempt FROM events WHERE ts <= TIMESTAMP '2024-01-10 00:00:00'""")
def doc_reclaim(spark, sf_dir):
    now = F.to_timestamp(F.lit("2024-01-10 00:00:00")).cast("timestamp_ntz")
    return documents.reclaim(_operations(spark, sf_dir), now).select("operation_id", "attempt")


# ---- streams


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'training-jobs' WHEN 'click' THEN 'pipeline.dead-letter' ELSE 'platform-events' END AS topic FROM events""")
def topic_routing(spark, sf_dir):
    kind = F.when(F.col("event_type") == "view", " TRAIN ").when(F.col("event_type") == "click", "dead_letter").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", topics.topic_of(kind).alias("topic"))


@query("""SELECT event_type, count(DISTINCT props) AS distinct_keys FROM events GROUP BY 1""")
def stream_dedup_keys(spark, sf_dir):
    """A bounded stream over the events' file: duplicates dropped by key, one count for each type kept in a table in memory."""
    import uuid

    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    # a file source reads folders: the file is named by a filter on its folder
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")
    name = f"dedup_{uuid.uuid4().hex}"
    # keys are forgotten once the watermark is past them, which the whole of this bounded stream stays within
    timed = stream.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "3650 days")
    counted = timed.dropDuplicatesWithinWatermark(["event_type", "props"]).groupBy("event_type").agg(F.count("*").alias("distinct_keys"))
    counted.writeStream.format("memory").queryName(name).outputMode("complete").trigger(availableNow=True).option("checkpointLocation", shared_path(spark, name)).start().awaitTermination()
    return spark.table(name)


@query("""SELECT event_type, count(*) AS n, CAST(sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) AS BIGINT) AS acks FROM events GROUP BY 1""")
def stream_settle(spark, sf_dir):
    m = table(spark, sf_dir, "events").withColumn("attempt", F.lit(1))
    out = topics.settle(m, F.col("event_type") != "error")
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.sum((F.col("outcome") == "ack").cast("long")).alias("acks"))


# ---- further operators


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'b' WHEN 1 THEN 'c' END AS next, CASE WHEN event_id % 2 = 0 THEN 'given' ELSE event_type END AS resumed FROM events""")
def plan_cursor_and_resume(spark, sf_dir):
    plan = F.array(*[F.lit(c) for c in "abc"])
    given = F.when(F.col("event_id") % 2 == 0, "given")
    return table(spark, sf_dir, "events").select("event_id", routing.next_of_plan(plan, (F.col("event_id") % 4).cast("int")).alias("next"), routing.resume_at(given, F.array(F.lit("first"), F.col("event_type"))).alias("resumed"))


@query("""WITH p AS (SELECT user_id, max(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) = 1 AS sa, max(CASE WHEN event_type = 'signup' AND value > 100 THEN 1 ELSE 0 END) = 1 AS a, max(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) = 1 AS sv, max(CASE WHEN event_type = 'view' AND value > 100 THEN 1 ELSE 0 END) = 1 AS l FROM events GROUP BY 1) SELECT user_id, sa AND a AS authenticated, sv AND l AS second_ready, sa AND a AND sv AND l AS useful FROM p WHERE sa OR sv""")
def session_build(spark, sf_dir):
    e = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max(F.col("value") > 100).alias("ok"))
    auth = e.filter("event_type = 'signup'").withColumn("user", F.col("user_id").cast("string"))
    return routing.session_of(auth, e.filter("event_type = 'view'"), "user_id").select("user_id", "authenticated", "second_ready", "useful")


@query("""SELECT event_id, event_type <> 'error' OR event_id % 2 = 0 AS ok FROM events""")
def success_rule(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", routing.succeeded(F.col("event_type") == "error", F.when(F.col("event_id") % 2 == 1, "e")).alias("ok"))


@query("""SELECT o_orderkey, b AS branch, ['fetch', 'filter', 'format', 'respond'][b + 1] AS branch_capability FROM orders, (SELECT unnest([0, 1, 2, 3]) AS b)""")
def time_split_branches(spark, sf_dir):
    caps = F.array(*[F.lit(c) for c in ("fetch", "filter", "format", "respond", "fifth")])
    return placement.split_branches(table(spark, sf_dir, "orders").select("o_orderkey"), caps)


@query("""SELECT 'swarm_worker_' || i AS worker_id, CAST(i AS INT) AS worker, 'bench' AS capability FROM range(8) t(i)""")
def swarm_workers(spark, sf_dir):
    return swarm.workers(spark, "bench", 8)


@query("""SELECT CAST(event_id % 50 AS INT) AS part, event_id, CAST(event_id AS VARCHAR) AS data FROM events WHERE event_type <> 'error'""")
def swarm_collect(spark, sf_dir):
    """The successful values of all events, a row each, in order within their part."""
    e = table(spark, sf_dir, "events").select((F.col("event_id") % 50).cast("int").alias("part"), "event_id", F.col("event_id").cast("string").alias("data"), "event_type")
    return swarm.collected_rows(e, "part", "event_id", "data", F.col("event_type") != "error")


@query("""SELECT CAST(event_id % 50 AS INT) AS part, count(*) AS items, CAST(sum(CAST(event_type <> 'error' AS INT)) AS BIGINT) AS done, min(event_id) AS first_item, max(event_id) AS last_item, min(CAST(event_type <> 'error' AS INT)) = 1 AS finished FROM events GROUP BY 1""")
def swarm_status(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("part", (F.col("event_id") % 50).cast("int"))
    return swarm.status(e, "part", "event_id", F.col("event_type") != "error")


@query("""SELECT event_id, round(value * CASE event_type WHEN 'view' THEN 2.0 WHEN 'click' THEN 3.0 ELSE 1.0 END, 6) AS weighted FROM events""")
def swarm_shared_state(spark, sf_dir):
    """Items weighted by a mapping that all workers of the call see."""
    weigh = lambda rows, shared: rows[["event_id"]].assign(weighted=(rows["value"] * rows["event_type"].map(lambda t: shared.get(t, 1.0))).round(6))
    return swarm.shared_map(table(spark, sf_dir, "events").select("event_id", "event_type", "value"), weigh, {"view": 2.0, "click": 3.0}, "event_id long, weighted double")


@query(f"""WITH e(src, dst) AS (VALUES {EDGES_SQL}) SELECT DISTINCT src AS node, dst AS neighbour FROM e""")
def capability_neighbours(spark, sf_dir):
    edges = spark.createDataFrame(EDGES, "src string, dst string")
    return lineage.neighbours(edges, edges.select(F.col("src").alias("node")).distinct(), "node")


@query(ORACLE_SQL["similar_topk_state_keys"].split("SELECT id, CAST(rank")[0] + " SELECT r.id, r.similar_id, round((0.3 + 0.5 * quality) * 0.8, 6) AS confidence FROM r JOIN labels ON doc_id = similar_id WHERE rank = 1 AND 0.3 + 0.5 * quality > 0.3")
def inherit_from_similar(spark, sf_dir):
    ranked = similar_topk_state_keys(spark, sf_dir)
    atoms = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("owner"), (0.3 + 0.5 * F.col("quality")).alias("confidence"))
    out = lineage.inherit_from_best(ranked, atoms, "owner")
    return out.select("id", F.col("owner").alias("similar_id"), r6("confidence", "confidence"))


@query("""SELECT conv_id, turn, role AS trace_id, 'm' || conv_id AS message_id FROM conversations""")
def doc_kept_headers(spark, sf_dir):
    headers = F.create_map(F.lit("traceId"), F.col("role"), F.lit("cookie"), F.lit("x"))
    c = table(spark, sf_dir, "conversations").withColumn("h", documents.kept_headers(headers, F.concat(F.lit("m"), F.col("conv_id").cast("string"))))
    return c.select("conv_id", "turn", F.col("h")["traceId"].alias("trace_id"), F.col("h")["messageId"].alias("message_id"))


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN lang ELSE source END AS value, CASE WHEN doc_id % 3 = 0 AND lang <> source THEN 'root and nested values differ' END AS error FROM documents""")
def doc_alias_agreement(spark, sf_dir):
    out = documents.agreed(F.when(F.col("doc_id") % 3 == 0, F.col("lang")), F.col("source"))
    return table(spark, sf_dir, "documents").select("doc_id", out["value"].alias("value"), out["error"].alias("error"))


@query("""SELECT event_id, CASE WHEN event_type <> 'error' THEN 'document.vectorized' ELSE 'document.failed' END AS type, CASE WHEN event_type = 'error' THEN 'VALIDATION_ERROR' END AS error_code FROM events""")
def doc_result_message(spark, sf_dir):
    bad = F.col("event_type") == "error"
    out = documents.result_message(F.col("event_id").cast("string"), F.when(bad, "terminal_failure").otherwise("succeeded"), F.when(bad, "VALIDATION_ERROR"))
    return table(spark, sf_dir, "events").select("event_id", out["type"].alias("type"), out["errorCode"].alias("error_code"))


@query("""WITH a AS (SELECT CAST(count(*) AS BIGINT) AS executions, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors, count(DISTINCT event_type || props) AS unique_computations, max(value) AS slowest FROM events) SELECT *, executions - unique_computations AS reuses FROM a""")
def engine_metrics(spark, sf_dir):
    c = calls(spark, sf_dir)
    per = c.groupBy("lookup_key").agg(F.count("*").alias("n"), F.sum((~F.col("success")).cast("long")).alias("e"), F.max("value").alias("m"))
    out = per.agg(F.sum("n").alias("executions"), F.sum("e").alias("errors"), F.count("*").alias("unique_computations"), F.max("m").alias("slowest"))
    return out.withColumn("reuses", F.col("executions") - F.col("unique_computations"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%red%' OR p_name LIKE '%blue%' THEN TRUE ELSE FALSE END AS tagged FROM part""")
def capability_by_tag(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", features.has_tag(F.split("p_name", " "), ["red", "blue"]).alias("tagged"))


@query("""SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS status, max(o_orderkey) AS version FROM orders GROUP BY 1""")
def kv_latest(spark, sf_dir):
    """An upsert is an append; the table is its log's last row for each key."""
    log = table(spark, sf_dir, "orders").select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("version"))
    return documents.latest(log, "o_custkey", "version").select("o_custkey", "status", "version")


@query("""SELECT c_custkey FROM customer WHERE starts_with(c_name, 'Customer#00000001')""")
def kv_prefix_scan(spark, sf_dir):
    return table(spark, sf_dir, "customer").filter(F.col("c_name").startswith("Customer#00000001")).select("c_custkey")


@query("""SELECT conv_id, turn, CASE WHEN regexp_matches(text, '(?i)^(get|fetch|retrieve|list)\\s+\\w+') THEN 'fetch' WHEN regexp_matches(text, '(?i)^(create|add|insert)\\s+\\w+') THEN 'create' WHEN regexp_matches(text, '(?i)^(update|modify|edit)\\s+\\w+') THEN 'update' WHEN regexp_matches(text, '(?i)^(delete|remove)\\s+\\w+') THEN 'delete' WHEN regexp_matches(text, '(?i)^(analyze|analyse)\\s+\\w+') THEN 'analyze' WHEN regexp_matches(text, '(?i)^(search|find)\\s+\\w+') THEN 'search' WHEN regexp_matches(text, '(?i)^(recommend|suggest)\\s+\\w+') THEN 'recommend' ELSE 'unknown' END AS kind FROM conversations""")
def plan_simple_patterns(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", planning.parse_intent(F.col("text"), planning.SIMPLE_PATTERNS)["kind"].alias("kind"))


# ---- persisted requests and results


@query("""SELECT event_id AS id, 'hib_' || substr(sha256(CAST(event_id AS VARCHAR)), 1, 12) AS hib_id, event_type AS intent, props AS input, event_id % 3 <> 0 AS woken, CASE WHEN event_id % 3 <> 0 THEN props END AS state FROM events""")
def persist_hibernate_wake(spark, sf_dir):
    """All requests written, listed, and two of three woken again."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.col("event_id").alias("id"), F.col("event_type").alias("intent"), F.col("props").alias("input"), F.col("props").alias("state"), F.lit("idle").alias("lifecycle"), F.lit(None).cast("long").alias("parent_id"))
    path = shared_path(spark, "hibernated")
    ids = requests.hibernate(rows, path)
    woken = requests.wake(spark, path, ids.filter("id % 3 <> 0")).select("hib_id", "state", F.lit(True).alias("woken"))
    every = requests.list_hibernated(spark, path).join(ids, "hib_id").join(rows.select("id", "intent", "input"), "id")
    return every.join(woken, "hib_id", "left").select("id", "hib_id", "intent", "input", F.coalesce("woken", F.lit(False)).alias("woken"), "state")


@query(f"""WITH {CALLS}, l AS (SELECT lookup_key AS key, max_by(value, (ts, event_id)) AS v, max(ts) AS t FROM calls WHERE ts <= TIMESTAMP '2024-01-20 00:00:00' GROUP BY 1)
SELECT key, v AS output, (epoch_us(t + INTERVAL 7 DAY) - epoch_us(TIMESTAMP '2024-01-20 00:00:00')) // 1000000 AS ttl_left_s FROM l WHERE t + INTERVAL 7 DAY > TIMESTAMP '2024-01-20 00:00:00'""")
def memo_persist_hydrate(spark, sf_dir):
    """Results written to the second level, and what it remembers at a later time."""
    path = shared_path(spark, "memo")
    c = calls(spark, sf_dir).groupBy("lookup_key", "ts").agg(F.max_by("value", "event_id").alias("value"))  # of equal times the last
    memo.persist(c, path, "lookup_key", "value", F.col("ts"), F.lit(7 * 86400))
    out = memo.hydrate(spark, path, F.to_timestamp(F.lit("2024-01-20 00:00:00")))
    return out.select("key", F.col("output").cast("double").alias("output"), "ttl_left_s")


@query(ORACLE_SQL["similar_topk_state_keys"].split("SELECT id, CAST(rank")[0] + """ , b AS (SELECT id, min_by(similar_id, rank) AS owner FROM r WHERE rank <= 5 AND round(score, 6) >= 0.7 GROUP BY 1) SELECT b.id, owner, 'n' || (n_chars % 3) || ',s' || (doc_id % 5) AS keys, source AS path FROM b JOIN documents ON doc_id = owner""")
def inherit_state_keys(spark, sf_dir):
    """What state keys, and by which path, a request takes from the most similar one."""
    d = table(spark, sf_dir, "documents")
    one = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    state = F.create_map(one("s", F.col("doc_id") % 5), F.lit("x"), one("n", F.col("n_chars") % 3), F.lit("y"))
    states = d.select(F.col("doc_id").alias("owner"), state.alias("state"), F.col("source").alias("path"))
    out = lineage.inherited_keys(similar_topk_state_keys(spark, sf_dir), states, "owner", "state", "path")
    return out.select("id", "owner", F.array_join("keys", ",").alias("keys"), "path")


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'result count differs' WHEN 1 THEN 'chunk ids differ' WHEN 2 THEN 'vector must be finite' WHEN 3 THEN 'vector must not be empty' WHEN 4 THEN 'dimensions differ' END AS error FROM documents""")
def doc_result_check(spark, sf_dir):
    """A vectorizer's answers to two chunks a document, most of them wrong in one way."""
    n = F.col("doc_id") % 6
    ids = F.array(F.lit("c0"), F.lit("c1"))
    answered = F.when(n == 0, F.array(F.lit("c0"))).when(n == 1, F.array(F.lit("c1"), F.lit("c0"))).otherwise(ids)
    good = F.array(F.lit(0.5), F.lit(1.5))
    second = F.when(n == 2, F.array(F.lit(0.5), F.lit(float("nan")))).when(n == 3, F.array().cast("array<double>")).when(n == 4, F.array(F.lit(1.0))).otherwise(good)
    vectors = F.when(n == 0, F.array(good)).otherwise(F.array(good, second))
    return table(spark, sf_dir, "documents").select("doc_id", documents.result_errors(ids, answered, vectors).alias("error"))


@query(f"WITH o AS (SELECT 'op' || event_id AS operation_id, {_STATUS_SQL} AS status, event_id FROM events) SELECT operation_id, CASE WHEN status IN ('processing', 'retryable_failure') THEN NULL WHEN event_id % 2 = 0 THEN 'PUBLISHED' ELSE 'PENDING' END AS outbox FROM o")
def outbox_drain(spark, sf_dir):
    """Half of the operations were sent; of these the pending ones are published."""
    done = documents.finish(_operations(spark, sf_dir), _outcomes(spark, sf_dir)).drop("stale")
    sent = table(spark, sf_dir, "events").filter("event_id % 2 = 0").select(F.concat(F.lit("op"), F.col("event_id").cast("string")).alias("operation_id"))
    return documents.mark_published(done, sent).select("operation_id", "outbox")
