import random

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import near_duplicates as nd
from tests.llm import cases


def brute(rows, threshold=0.8):
    sets = {}
    for i, (_, text) in enumerate(rows):
        w = (text or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    links = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    label = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in links:
            for b in links[a]:
                if label[b] != label[a]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {rows[i][0]: (rows[min(k for k in label if label[k] == label[i])][0], len(links[i])) for i in sets}


def test_equals_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.links(docs).collect()}
    assert got == brute(rows)


def test_blocks_count_each_pair_once(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    monkeypatch.setattr(nd, "NODE_BLOCK", 3)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for k in range(30):  # a chain of near copies, each pair of neighbours well above the threshold
        w = list(base)
        w[3 * k] = f"edit{k}"
        rows.append((k, " ".join(w)))
    docs = cases.documents(spark, rows)
    assert {r.doc_id: (r.class_id, r.n_links) for r in nd.links(docs).collect()} == brute(rows)


def test_odd_cases(spark):
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.links(cases.documents(spark)).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == 1 and got[1][1] == 2
    assert got[4] == (4, 0) and got[5] == (5, 0) and got[6] == (6, 0)
    assert got[7][0] == got[8][0] == 7 and got[7][1] == 2  # the repeated row counts
    assert nd.links(cases.empty(spark)).count() == 0
    assert nd.links(cases.nulls(spark)).count() == 0


def test_keep_one_keeps_columns_and_clean_rows(spark):
    docs = cases.documents(spark)
    kept = nd.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 in ids and 2 not in ids and 3 not in ids and None in ids and {4, 5, 6, 9, 10, 11} <= set(ids)


def test_recall_near_the_threshold(spark):
    """Pairs of texts right above the threshold: exact links by brute force, nearly all found."""
    rnd = random.Random(1)
    rows = []
    for k in range(120):
        w = [f"p{k}w{rnd.randrange(10**6)}" for _ in range(200)]
        v = list(w)
        for at in rnd.sample(range(5, 195), 4):  # some 20 of 196 shingles differ: a similarity of about 0.81
            v[at] = f"e{rnd.randrange(10**6)}"
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(v))]
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.links(cases.documents(spark, rows)).collect()}
    want = brute(rows)
    linked = [i for i in want if want[i][1]]
    assert len(linked) > 100 and sum(got[i] == want[i] for i in linked) >= 0.98 * len(linked)
    assert all(got[i] == want[i] for i in want if not want[i][1])


def test_prefixes_shorten_until_the_recall_is_reached():
    none = np.zeros(129)
    alike, unlike = none.copy(), none.copy()
    alike[126], unlike[104] = 1e6, 1e6
    worst = nd.next_depth(none, nd.DEPTH)
    assert nd.chance(0.8, worst) >= nd.TARGET_RECALL > nd.chance(0.8, worst + 1)
    assert nd.next_depth(alike, nd.DEPTH) == 0  # nearly equal pairs are all found by whole labels
    assert nd.next_depth(unlike, nd.DEPTH) < nd.DEPTH and nd.next_depth(unlike, worst) == 0
    assert abs(nd.recall(unlike, 8, 8) - nd.chance(104 / 128, 8)) < 1e-3


def test_rows_meet_at_their_longest_prefix():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1000, nd.TREES * nd.DEPTH)
    sig = np.array([base] * 6).astype(np.uint16)
    for i in range(1, 6):
        sig[i, rng.integers(8, 128, 10)] = i  # near all others
    sig[5, 8:] = 9  # shares the label alone
    sig[4, 6] = 77  # shares six values of the label
    rep = np.array([5, 3, 9, 1, 7, 2])
    got = nd.descend(sig[:, :8], sig, rep, rep, 4, 80)
    assert len(got) == 4 and {x for a, b, _ in got for x in (a, b)} == {5, 3, 9, 1, 7}
    assert nd.descend(sig[:, :8], sig, rep, rep, 7, 80) and 7 not in {x for a, b, _ in nd.descend(sig[:, :8], sig, rep, rep, 7, 80) for x in (a, b)}
    assert nd.descend(sig[:, :8], sig, rep, np.ones(6, int), 4, 80) == []  # one cluster already


def test_hot_class_is_exact_with_pivots(spark, monkeypatch):
    """A class far above a block: texts near the pivot, texts at its edge, and copies."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    monkeypatch.setattr(nd, "NODE_BLOCK", 8)
    rnd = random.Random(4)
    base = [f"w{i}" for i in range(240)]
    rows = []
    for k in range(70):
        w = list(base)
        for at in rnd.sample(range(5, 235), (0, 1, 2, 4, 5)[k % 5]):
            w[at] = f"e{k}_{at}"
        rows.append((k, " ".join(w)))
    rows += [(100 + k, rows[k][1]) for k in range(10)]
    assert {r.doc_id: (r.class_id, r.n_links) for r in nd.links(cases.documents(spark, rows)).collect()} == brute(rows)


def test_other_as_a_column_name(spark):
    docs = cases.documents(spark).withColumn("other", F.lit(1)).withColumn("__other", F.lit(2))
    assert nd.keep_one(docs).columns == docs.columns


def test_jobs_are_few(spark, small):
    """The driver plans every job and keeps its plan: no step is planned twice, and without large groups there are none for them."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    scheduler = spark.sparkContext._jsc.sc().dagScheduler()
    before = scheduler.numTotalJobs()
    assert nd.links(docs).count() == docs.count()
    jobs = scheduler.numTotalJobs() - before
    assert jobs <= 110, jobs


def test_texts_are_shuffled_once(spark, monkeypatch):
    """Several steps read the texts of candidate classes; all texts are read twice (signatures, members) and shuffled once, large classes or not."""
    monkeypatch.setattr(nd, "BLOCK", 16)
    rnd = random.Random(6)
    rows = []
    for k in range(300):
        w = [f"w{i}" if k < 60 else f"v{k}_{i}" for i in range(60)]
        w[k % 60] = f"e{rnd.randrange(10**6)}"
        rows.append((k, " ".join(w)))
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    docs = cases.documents(spark, rows).select("doc_id", "text").mapInArrow(count, "doc_id long, text string")
    got = {r.doc_id: (r.class_id, r.n_links) for r in nd.links(docs).collect()}
    assert got == brute(rows)
    assert seen.value == 2 * len(rows), seen.value
