import pytest
from pyspark.sql import functions as F

from millrace.functions import keys
from millrace.operators import evolution, lineage, memo, resilience, stats


def test_negative_ttl_is_short(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("s", True)], "c string, ok boolean")
    got = [r.t for r in rows.select(memo.ttl_for(F.col("c"), F.col("ok"), {"s": 15}).alias("t")).collect()]
    assert got == [30, 3, 15]


def test_lookup_and_restore(spark):
    calls = spark.createDataFrame([(1, "a"), (2, "b")], "id int, k string")
    memos = spark.createDataFrame([("a", "out", 10)], "k string, state string, expires_at int")
    hit = memo.lookup(calls, memos, "k", F.lit(5))
    got = {r.id: (r.state, r.from_shared) for r in memo.restore(hit, spark.createDataFrame([("b", "new")], "k string, state string"), "k", "state").collect()}
    assert got == {1: ("out", True), 2: ("new", False)}
    assert memo.lookup(calls, memos, "k", F.lit(10)).filter("state is not null").count() == 0


def test_cycle_is_an_error(spark):
    with pytest.raises(ValueError):
        lineage.roots(spark.createDataFrame([("a", "b"), ("b", "a")], "n string, p string"), "n", "p", max_rounds=3).count()


def test_circuit_opens_and_recovers(spark):
    rows = [("k", float(t), ok) for t, ok in [(0, False), (1, False), (2, True), (70, True), (71, False)]]
    df = spark.createDataFrame(rows, "k string, t double, ok boolean")
    got = [r.verdict for r in resilience.circuit_breaker(df, "k", ["t"], "t", "ok", failures=2, open_s=60).orderBy("t").collect()]
    assert got == ["allowed", "allowed", "rejected", "allowed", "allowed"]


def test_bucket_refills(spark):
    df = spark.createDataFrame([("k", t) for t in (0.0, 0.1, 0.2, 5.0)], "k string, t double")
    assert [r.granted for r in resilience.token_bucket(df, "k", ["t"], "t", rate=0.5, burst=2).orderBy("t").collect()] == [True, True, False, True]


def test_variation_keeps_genes(spark):
    g = spark.range(50).select("id", F.array(*[F.lit(c) for c in "abcd"]).alias("g"), F.array(F.lit("x"), F.lit("y")).alias("p"))
    r = g.select(evolution.insert_gene(F.col("g"), F.col("p"), F.col("id")).alias("i"), evolution.delete_gene(F.col("g"), F.col("id")).alias("d"), evolution.crossover(F.col("g"), F.col("p"), F.col("id")).alias("c")).collect()
    assert all(len(x.i) == 5 and len(x.d) == 3 and set(x.c) <= set("abcdxy") for x in r)


def test_small_percentile_is_nearest_rank(spark):
    got = spark.range(1).select(stats.small_percentile(F.array(*[F.lit(float(i)) for i in range(10)]), 0.95).alias("p")).first().p
    assert got == 9.0


def test_md5_mod(spark):
    import hashlib

    want = int(hashlib.md5(b"f:8").hexdigest(), 16) % 100
    assert spark.range(1).select(keys.md5_mod(F.lit("f:8"), 100).alias("m")).first().m == want


def test_long_chain_has_all_ancestors(spark):
    chain = spark.range(300).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    got = lineage.ancestors(chain, "id", "p")
    assert sorted((r.node, r.ancestor, r.distance) for r in got.collect()) == [(i, j, i - j) for i in range(300) for j in range(i + 1)]
    below = lineage.descendants(chain, "id", "p")
    assert sorted((r.node, r.descendants, r.height) for r in below.collect()) == [(i, 299 - i, 299 - i) for i in range(299)]
    assert lineage.ancestors(chain, "id", "p", max_depth=2).count() == 300 + 299 + 298


def test_cycle_of_ancestors_is_an_error(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "n string, p string")
    for found in (lineage.ancestors, lineage.descendants):
        with pytest.raises(ValueError):
            found(ring, "n", "p").count()


def test_similar_word_sets_of_whole_texts(spark, tmp_path, monkeypatch):
    import hashlib
    import itertools
    import random

    from millrace import queries
    from millrace.operators import similarity

    monkeypatch.setattr(similarity, "BLOCK", 3)
    rnd = random.Random(9)
    pool = [f"w{i}" for i in range(60)]
    texts = [" ".join(rnd.sample(pool, 30)) for _ in range(12)]
    texts += [" ".join(rnd.sample(t.split(), 28) + rnd.sample(pool, 2)) for t in texts for _ in range(3)]
    opening = " ".join(f"o{i}" for i in range(12))
    texts += [opening + " " + " ".join(pool[:25]), opening + " " + " ".join(pool[30:55]), None, "", "common " * 40]
    spark.createDataFrame([(t,) for t in texts], "text string").write.parquet(str(tmp_path / "documents.parquet"))
    sets = {hashlib.sha256(" ".join(sorted(w)).encode()).hexdigest(): w for t in texts if t for w in [set(t.split())] if w}
    want = {(a, b): round(len(sets[a] & sets[b]) / len(sets[a] | sets[b]), 6) for a, b in itertools.combinations(sorted(sets), 2)}
    want = {k: v for k, v in want.items() if v > 0.7}
    got = {(r.key_a, r.key_b): r.similarity for r in queries.intent_jaccard(spark, str(tmp_path)).collect()}
    assert got == want and len(want) > 20


def test_similar_word_sets_ship_less_than_the_texts(spark, small):
    """All that the join shuffles is a share of the texts, not each word with its key and each candidate with its words."""
    from millrace import queries

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = written()
    assert queries.intent_jaccard(spark, small).collect()
    assert written() - before < spark.read.parquet(f"{small}/documents.parquet").agg(F.sum(F.octet_length("text"))).first()[0]


def test_similar_word_sets_of_all_sizes_in_many_blocks_and_parts(spark, monkeypatch):
    import hashlib
    import itertools
    import random

    from millrace.operators import similarity

    for name, value in {"BLOCK": 7, "PAIRS": 9, "CHUNK": 50, "HELD": 20, "GROUP_WORDS": 300}.items():
        monkeypatch.setattr(similarity, name, value)
    rnd = random.Random(4)
    sets = [frozenset(rnd.sample(range(90), rnd.randint(1, 70))) for _ in range(60)]
    for s in sets[:40]:
        for k in range(1, 8):  # smaller, larger and other ones
            kept = rnd.sample(sorted(s), max(1, len(s) - rnd.randint(0, k)))
            sets.append(frozenset(kept) | frozenset(rnd.sample(range(90), rnd.randint(0, 8 - k))))
    words = {hashlib.sha256(" ".join(w).encode()).hexdigest(): set(w) for s in sets for w in [sorted(f"w{x}" for x in s)]}
    sets += rnd.sample(sets, 50)
    for threshold, copies in ((0.7, 0), (0.45, 1000)):
        monkeypatch.setattr(similarity, "COPIES", copies)
        want = {(a, b): len(words[a] & words[b]) / len(words[a] | words[b]) for a, b in itertools.combinations(sorted(words), 2)}
        want = {k: v for k, v in want.items() if v > threshold}
        texts = spark.createDataFrame([(" ".join(f"W{x}" for x in rnd.sample(sorted(s), len(s))),) for s in sets], "text string")
        got = similarity.similar_word_sets(texts, threshold=threshold).collect()
        assert {(r.key_a, r.key_b): r.similarity for r in got} == want and len(got) == len(want) > 400


def test_similar_word_sets_send_pairs_of_near_copies_packed(spark):
    """Pairs of a large group of near copies are sent a few times in few bytes, not as a row for each pair and group of cells."""
    import random

    from millrace.operators import similarity

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rnd = random.Random(3)
    texts = [(" ".join([*rnd.sample([f"w{x}" for x in range(60)], 57), *(f"u{k}x{x}" for x in range(3))]),) for k in range(500)]
    before = written()
    assert similarity.similar_word_sets(spark.createDataFrame(texts, "text string")).count() == 500 * 499 // 2
    sent = written() - before
    assert sent < 500 * 499 // 2 * 16, sent


def test_similar_word_sets_shuffle_words_of_members_only(spark):
    """Sets without a similar one are told apart by their keys, and their words stay where they are."""
    import random

    from millrace.operators import similarity

    def written():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty()
        stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    rnd = random.Random(5)
    texts = [" ".join(f"{rnd.getrandbits(800):x}" for _ in range(40)) for _ in range(1000)] + ["a b c d e f g", "a b c d e f"]
    before = written()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables too large to send
    try:
        assert similarity.similar_word_sets(spark.createDataFrame([(t,) for t in texts], "text string")).count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = written() - before
    assert sent < 1000 * 40 * 100 // 2, sent  # half of the words, two digits a byte


def test_guarded_map_takes_few_calls_if_failures_are_named(spark, small):
    """A fifth of the items fails; the function counts its calls in a column."""
    import pandas as pd

    from millrace.operators import swarm

    rows = spark.range(0, 5000, 1, 1).withColumn("v", F.col("id").cast("double"))
    for named in (True, False):
        calls = []

        def double(pdf, named=named, calls=calls):
            calls.append(len(pdf))
            bad = pdf["id"] % 5 == 0
            if bad.any():
                raise swarm.FailedItems(bad.map({True: "bad", False: None})) if named else ValueError("bad")
            return pd.Series(len(calls), pdf.index, dtype=float)

        got = swarm.guarded_map(rows, double, "id long, v double, result double, error string").orderBy("id").collect()
        assert [r.id for r in got] == list(range(5000))
        assert all((r.error, r.result is None) == (("bad", True) if r.id % 5 == 0 else (None, False)) for r in got)
        assert not named or max(r.result or 0 for r in got) <= 2


def test_queries_over_all_rows_equal_brute_force(spark, small):
    from collections import Counter, defaultdict

    from millrace import queries

    events = spark.read.parquet(f"{small}/events.parquet").select("event_id", "user_id", "event_type").collect()
    genes = defaultdict(list)
    for e in events:
        genes[e.user_id].append(e.event_type)
    got = {r.user_id: r.fitness for r in queries.gene_fitness(spark, small).collect()}
    assert got == {u: pytest.approx(0.5 * ("error" not in g) + 0.5 * len(set(g)) / len(g), abs=2e-6) for u, g in genes.items()}
    hops = {(r.steps, r.terminated, r.hops): r.n for r in queries.route_hop_bound(spark, small).collect()}
    assert hops == Counter((e.event_id % 20, e.event_id % 20 > 8, min(e.event_id % 20, 8)) for e in events)
    rows = [(r.part, r.event_id, r.data) for r in queries.swarm_collect(spark, small).collect()]
    assert rows == sorted((e.event_id % 50, e.event_id, str(e.event_id)) for e in events if e.event_type != "error")
    turns = spark.read.parquet(f"{small}/conversations.parquet").count()
    for q in (queries.intent_parse_regex, queries.plan_default_paths, queries.plan_simple_patterns):
        assert q(spark, small).count() == turns


def test_deep_and_wide_lineage(spark):
    chain = spark.range(1000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    got = {r.node: (r.root, r.depth) for r in lineage.roots(chain, "id", "p").collect()}
    assert got == {i: (0, i) for i in range(1000)}
    many = spark.range(300_000).select("id", F.when(F.col("id") % 10 > 0, F.col("id") - 1).alias("p"))
    assert lineage.ancestors(many, "id", "p").count() == 30_000 * 55
    line = spark.range(150).select(F.col("id").cast("string").alias("src"), (F.col("id") + 1).cast("string").alias("dst")).filter("src < 40 or src > 140")
    far = lineage.reachable(line.limit(40), spark.createDataFrame([("0",)], "start string"))
    assert far.agg(F.max("distance")).first()[0] >= 1


def test_percentiles_of_odd_values(spark):
    import math
    import random

    rnd = random.Random(3)
    values = [("a", rnd.choice([-1, 1]) * rnd.random() * 10 ** rnd.randrange(-8, 8)) for _ in range(999)] + [("b", 0.0)] * 5 + [("c", v) for v in (float("inf"), -float("inf"), 1e-300, 1.0)] + [("d", None), ("e", 7.0)]
    got = {r.k: (r.p50, r.p95, r["count"]) for r in stats.latency_percentiles(spark.createDataFrame(values, "k string, v double"), "k", "v", (0.5, 0.95)).collect()}
    for k in "abce":
        own = sorted(v for g, v in values if g == k)
        at = lambda p: own[round(p * (len(own) - 1))]
        assert got[k] == (at(0.5), at(0.95), len(own)), k
    assert "d" not in got and not math.isnan(got["a"][0])


def test_folds_equal_brute_force(spark, small):
    """Circuit breaker and token bucket over all events, by plain loops."""
    from millrace import queries

    events = sorted(((r.user_id, r.ts, r.event_id, r.event_type) for r in spark.read.parquet(f"{small}/events.parquet").collect()))
    verdict, granted, state, bucket = {}, {}, {}, {}
    for user, ts, event, kind in events:
        now = ts.timestamp()
        s = state.setdefault(user, {"n": 0, "open": None})
        if s["open"] is not None and now - s["open"] < 86400:
            verdict[event] = "rejected"
        else:
            if s["open"] is not None:
                s["open"], s["n"] = None, 1
            verdict[event] = "allowed"
            s["n"] = s["n"] + 1 if kind == "error" else max(0, s["n"] - 1)
            if s["n"] >= 2:
                s["open"] = now
        tokens, at = bucket.get(user, (2.0, now))
        tokens = min(2.0, tokens + (now - at) / 43200)
        granted[event] = tokens >= 1
        bucket[user] = (tokens - 1 if granted[event] else tokens, now)
    got = {r.event_id: r.verdict for r in queries.circuit_breaker(spark, small).collect()}
    assert got == verdict
    assert {r.event_id: r.granted for r in queries.token_bucket(spark, small).collect()} == granted


def test_calls_without_a_key_share_one_state(spark):
    df = spark.createDataFrame([(k, float(t)) for k in (None, 1) for t in range(4)], "k long, t double")
    got = resilience.token_bucket(df, "k", ["t"], "t", rate=0.01, burst=2).orderBy("t").collect()
    assert [r.granted for r in got] == [True] * 4 + [False] * 4


def test_draws_are_even(spark):
    drawn = spark.range(4000).select(F.floor(evolution._unit("at", F.col("id")) * 4).alias("d")).groupBy("d").count().collect()
    assert sorted(r.d for r in drawn) == [0, 1, 2, 3] and all(880 < r["count"] < 1120 for r in drawn)
