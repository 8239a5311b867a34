"""Jaccard self-join on word shingles with a MinHash LSH forest and exact verification.

Words are what white space separates; a shingle is five words in a row (all words, where there are
fewer). Two documents are linked if the Jaccard similarity of their shingle sets is 0.8 or more.

Equal word sequences are folded into one representative. Its signature is cut into a label of DEPTH values for
each tree. In every tree, representatives whose labels start alike meet below one node of the tree's prefix
trie; a node's rows are sorted by label, and two rows are compared by their whole signatures at the
longest prefix that they share, longer prefixes first, unless they are joined by then.

The forest starts with whole labels. How alike the pairs are that were found says which share of all pairs
at the threshold or above was found (a pair at depth d is found with a chance of 1 - (1 - s ** d) ** TREES), and how
many would be with shorter prefixes; the next round takes the longest prefixes that reach the target recall, and
takes up only nodes that hold rows of different clusters. Rounds end at the target, at the latest at the depth where pairs
right at the threshold are found with that chance. What comparisons join is a candidate class; within it,
shingle sets are verified exactly.

Large nodes and classes: a node's rows are first compared with one of them, the pivot, and a class's texts likewise, by
their exact distance. Jaccard distance is a metric, so texts within half the distance allowed from the pivot are linked to each other for
certain and are only counted. The others are dealt as pairs of blocks that each hold at least one of them, so
no task holds more than two blocks, and texts that are near their pivot are sent once.

Null and empty texts and texts of white space have no shingle: class of their own, no link.
Rows with a null id are dropped by `links` (they can't be named). Repeated ids with different texts
are compared as separate texts that share one node: their links add up, and they share a class.
Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm._common import checkpoint
from millrace.llm._text import mix
from millrace.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
DEPTH = 8  # values in a label
TARGET_RECALL = 0.9995  # of pairs at the threshold or above, as estimated from those found
SLACK = 0.22  # signatures that agree in a share of THRESHOLD - SLACK are candidates: six standard deviations
BLOCK = 256  # texts of a class that are verified at once with those of another block
NODE_BLOCK = 1024  # signatures of a node that are compared at once with those of another block

_seeds = np.random.default_rng(7)
_A = _seeds.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64) | np.uint64(1)
_B = _seeds.integers(1, 2**63, TREES * DEPTH, dtype=np.uint64)


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """That a pair of this similarity shares a prefix of this depth in some tree."""
    return 1 - (1 - similarity**depth) ** TREES


def recall(found: np.ndarray, depth: int, at: int, threshold: float = THRESHOLD) -> float:
    """The share of all pairs that prefixes of length `at` would find, estimated from pairs that were found at `depth`.

    found: number of them by how many of their signatures' values agree. One more pair right at the threshold is taken
    to exist, so that no pair found says nothing for long prefixes.
    """
    s = np.arange(len(found)) / (len(found) - 1)
    there = np.where(s >= threshold, found / np.maximum(chance(s, depth), 1e-9), 0)
    return float(((there * chance(s, at)).sum() + chance(threshold, at)) / (there.sum() + 1))


def next_depth(found: np.ndarray, depth: int, target: float = TARGET_RECALL, threshold: float = THRESHOLD) -> int:
    """The longest shorter prefix that reaches the target recall by what was found at `depth`; 0 if depth has reached it itself."""
    if recall(found, depth, depth, threshold) >= target or chance(threshold, depth) >= target:
        return 0
    for at in range(depth - 1, 1, -1):
        if recall(found, depth, at, threshold) >= target or chance(threshold, at) >= target:
            return at
    return 1


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of each text; where each text's words start (len + 1)."""
    words = [t.split() for t in texts]
    counts = np.array([len(x) for x in words], np.int64)
    flat = pa.array([w for x in words for w in x], pa.string()).dictionary_encode()
    distinct = pd.util.hash_array(np.array(flat.dictionary.to_pylist(), object), categorize=False) if len(flat) else np.zeros(0, np.uint64)
    return distinct[flat.indices.to_numpy()] if len(flat) else distinct, np.r_[0, np.cumsum(counts)]


def shingles(texts: list[str]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    h, at = _word_hashes(texts)
    r = np.uint64(0x9E3779B97F4A7C15)
    for i, j in zip(at[:-1], at[1:], strict=True):
        own = h[i:j]
        n = min(SHINGLE, len(own))
        if not n:
            yield np.zeros(0, np.uint64)
            continue
        s = np.zeros(len(own) - n + 1, np.uint64)
        for k in range(n):
            s = mix(s * r + own[k : k + len(s)])
        yield np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minimum values of a set."""
    low = np.full(len(_A), np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(s), 512):  # bounds the memory for long texts
        h = mix(s[lo : lo + 512, None] * _A + _B)
        np.minimum(low, h.min(0), out=low)
    return low


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 500):
            part = batch.slice(lo, 500)
            texts = part["text"].to_pylist()
            h, at = _word_hashes(texts)
            out: dict[str, list] = {"h1": [], "h2": [], "words": [], "sig": []}
            for i, s in enumerate(shingles(texts)):
                own = h[at[i] : at[i + 1]]
                order = np.arange(1, len(own) + 1, dtype=np.uint64)
                out["h1"].append(int(mix((mix(own) * (order * np.uint64(2) + np.uint64(1))).sum(dtype=np.uint64)).view(np.int64)))
                out["h2"].append(int(mix((mix(own ^ np.uint64(0x5851F42D4C957F2D)) * mix(order)).sum(dtype=np.uint64)).view(np.int64)))
                out["words"].append(len(own))
                # 16 well-mixed bits of each minimum; the minimum itself is small for long texts
                out["sig"].append((mix(signature(s)) >> np.uint64(48)).astype(">u2").tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], part["form"], *(pa.array(out[k], pa.int64()) for k in ("h1", "h2", "words")), pa.array(out["sig"], pa.binary())], names=["doc_id", "form", "h1", "h2", "words", "sig"]
            )


_NONE = pa.table({"rep": pa.array([], pa.int64()), "form": pa.array([], pa.int64()), "class": pa.array([], pa.int64()), "copies": pa.array([], pa.int64()), "near": pa.array([], pa.bool_())})


def _values(sigs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(sigs), ">u2").astype(np.uint16).reshape(len(sigs), TREES * DEPTH)


def descend(label: np.ndarray, sig: np.ndarray, rep: np.ndarray, group: np.ndarray, depth: int, least: int) -> list[tuple[int, int, int]]:
    """What joins the groups of a node's rows: pairs of groups and how many values of the two rows agree.

    The rows' trie below the node is gone through from whole labels to prefixes of length `depth`; each pair
    of rows meets at the longest prefix it shares, and only while the two are not joined.
    """
    order = np.lexsort((rep, *label.T[::-1]))
    label, sig, group = label[order], sig[order], group[order]
    names, of = np.unique(group, return_inverse=True)
    found: list[tuple[int, int, int]] = []
    # how many values each row's label shares with the one before
    differs = label[1:] != label[:-1]
    shared = np.where(differs.any(1), differs.argmax(1), label.shape[1])
    inner = np.arange(len(label))  # the run of the next longer prefix that each row is in
    for d in range(label.shape[1], depth - 1, -1):
        outer = np.r_[0, np.cumsum(shared < d)]
        cut = np.r_[0, np.flatnonzero(np.diff(outer)) + 1, len(outer)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if (of[i:j] == of[i]).all():
                continue
            for x in range(i, j):
                others = i + np.flatnonzero((of[i:j] != of[x]) & (inner[i:j] != inner[x]))
                if not len(others):
                    continue
                agree = (sig[others] == sig[x]).sum(1)
                near = agree >= least
                for y, n in sorted(zip(others[near].tolist(), agree[near].tolist(), strict=True), key=lambda p: -p[1]):
                    if of[y] != of[x]:
                        found.append((int(group[x]), int(group[y]), int(n)))
                        of[of == of[y]] = of[x]
        inner = outer
    return found


def _join_nodes(batches: Iterator[pd.DataFrame], depth: int, least: int) -> Iterator[pd.DataFrame]:
    """Edges between the clusters that each node's comparisons join. Rows of a node come one after another."""
    held: pd.DataFrame | None = None

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        tree, rep, cluster = (rows[c].to_numpy() for c in ("tree", "rep", "cluster"))
        sig = _values(rows["sig"].tolist())
        node = rows[["node", "p", "q"]].to_numpy()
        cut = np.r_[0, np.flatnonzero((node[1:] != node[:-1]).any(1)) + 1, len(rows)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if j - i == 2:
                agree = int((sig[i] == sig[i + 1]).sum())
                if agree >= least and cluster[i] != cluster[i + 1]:
                    out.append((int(cluster[i]), int(cluster[i + 1]), agree))
                continue
            label = sig[i:j, tree[i] * DEPTH : (tree[i] + 1) * DEPTH]
            out += descend(label, sig[i:j], rep[i:j], cluster[i:j], depth, least)
        return pd.DataFrame(out, columns=["a", "b", "agree"], dtype=np.int64)

    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        last = held[["node", "p", "q"]].iloc[-1]
        open_rows = ((held["node"] == last["node"]) & (held["p"] == last["p"]) & (held["q"] == last["q"])).to_numpy()
        whole = held[~open_rows]
        held = held[open_rows].reset_index(drop=True)
        if len(whole):
            yield solve(whole.reset_index(drop=True))
    if held is not None and len(held):
        yield solve(held)


def _verify(batches: Iterator[pd.DataFrame], threshold: float) -> Iterator[pd.DataFrame]:
    """Links of each representative within a pair of blocks, weighted by copies; and the links' star edges."""

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["rep", "form"])
        p, q = int(rows["p"].iloc[0]), int(rows["q"].iloc[0])
        sets = list(shingles(rows["text"].tolist()))
        rep, copies, block = rows["rep"].to_numpy(), rows["copies"].to_numpy(), rows["block"].to_numpy()
        size = np.array([len(s) for s in sets])
        distinct, back = np.unique(np.concatenate(sets), return_inverse=True)
        if len(distinct) == 0:
            return pd.DataFrame({"rep": [], "links": [], "other": []})
        often = np.bincount(back) > 1  # a shingle of one text meets nothing
        column = np.cumsum(often) - 1
        at = np.r_[0, np.cumsum(size)]
        common = np.zeros((len(sets), len(sets)), np.float32)
        owner = np.repeat(np.arange(len(sets)), size)
        keep = often[back]
        owner, back = owner[keep], column[back[keep]]
        order = np.argsort(back, kind="stable")
        owner, back = owner[order], back[order]
        for lo in range(0, int(back[-1]) + 1 if len(back) else 0, 4096):  # columns in slices: bounded memory
            i, j = np.searchsorted(back, [lo, lo + 4096])
            part = np.zeros((len(sets), 4096), np.float32)
            part[owner[i:j], back[i:j] - lo] = 1
            common += part @ part.T
        union = size[:, None] + size[None, :] - common
        linked = common >= threshold * union - 1e-6
        linked &= (size > 0)[:, None] & (size > 0)[None, :]
        np.fill_diagonal(linked, False)
        if p != q:  # pairs within a block are counted where p == q
            linked &= block[:, None] != block[None, :]
        links = linked @ copies
        # one edge for each newly reached text suffices
        other = np.where(linked.any(1), rep[linked.argmax(1)], rep)
        rows_a, rows_b, rows_n = [rep], [other], [links]
        seen = np.zeros(len(sets), bool)
        for start in range(len(sets)):
            if seen[start]:
                continue
            seen[start] = True
            queue = [start]
            while queue:
                x = queue.pop()
                new = np.flatnonzero(linked[x] & ~seen)
                if len(new):
                    seen[new] = True
                    queue.extend(new.tolist())
                    rows_a.append(rep[new])
                    rows_b.append(np.full(len(new), rep[x]))
                    rows_n.append(np.zeros(len(new), np.int64))
        return pd.DataFrame({"rep": np.concatenate(rows_a), "links": np.concatenate(rows_n).astype(np.int64), "other": np.concatenate(rows_b)})

    held: pd.DataFrame | None = None
    key = ["class", "p", "q"]
    for batch in batches:
        held = batch if held is None else pd.concat([held, batch], ignore_index=True)
        values = held[key].to_numpy()
        cut = np.r_[0, np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1, len(held)]
        for i, j in zip(cut[:-2], cut[1:-1], strict=True):
            yield solve(held.iloc[i:j])
        held = held.iloc[cut[-2] :].reset_index(drop=True)
    if held is not None and len(held):
        yield solve(held)


def _dealt(rows: DataFrame, of: str, block: int) -> DataFrame:
    """Each row once for every pair of blocks (p <= q) that its block is in, but for pairs of blocks of near rows.

    rows have near (whether a row is settled with all other near ones), and near_n and far_n of its group; groups within a block are one pair.
    """
    one = F.col("near_n") + F.col("far_n") <= block
    near = F.when(one, F.lit(0)).otherwise(F.ceil(F.col("near_n") / block)).cast("int")
    far = F.when(one, F.lit(1)).otherwise(F.ceil(F.col("far_n") / block)).cast("int")
    number = F.xxhash64(F.lit(3), F.col(of))
    own = F.when(one, F.lit(0)).when(F.col("near"), F.pmod(number, near)).otherwise(near + F.pmod(number, far))
    rows = rows.filter("far_n > 0").withColumn("block", own.cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.when(F.col("near") & ~one, near).otherwise(F.lit(0)), near + far - 1)))
    return rows.withColumn("p", F.least("block", "other")).withColumn("q", F.greatest("block", "other")).drop("other", "near", "near_n", "far_n")


def _by_pivot(big: DataFrame, sigs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """Rows of large nodes, by whether they are near their node's pivot, of nodes that hold others; and what the pivots join."""
    big = big.join(sigs, "rep").join(sigs.select(F.col("rep").alias("pivot"), F.col("sig").alias("pivot_sig")), "pivot")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            agree = (_values(batch["sig"].to_pylist()) == _values(batch["pivot_sig"].to_pylist())).sum(1)
            names = ["node", "tree", "rep", "cluster", "pivot"]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), pa.array(agree, pa.int64())], names=[*names, "agree"])

    big = checkpoint(big.dropDuplicates(["node", "rep"]).mapInArrow(compare, "node long, tree int, rep long, cluster long, pivot long, agree long"))
    big = big.withColumn("near", F.col("agree") >= least)
    heads = big.filter("rep = pivot").select("node", F.col("cluster").alias("head"))
    certain = big.filter("near and rep <> pivot").join(heads, "node").filter("cluster <> head").select(F.col("cluster").alias("a"), F.col("head").alias("b"), "agree")
    counts = big.groupBy("node").agg(F.sum(F.col("near").cast("long")).alias("near_n"), F.sum((~F.col("near")).cast("long")).alias("far_n"))
    return big.join(counts.filter("far_n > 0"), "node"), certain


def _meet(reps: DataFrame, clusters: DataFrame | None, depth: int, least: int, width: int) -> DataFrame:
    """a, b and agree: what rows that share a prefix of this depth in some tree join, between the clusters known so far."""
    known = reps.select("rep", "sig")
    if clusters is None:
        known = known.withColumn("cluster", F.col("rep"))
    else:
        known = known.join(clusters.select(F.col("node").alias("rep"), F.col("component").alias("cluster")), "rep", "left").withColumn("cluster", F.coalesce("cluster", "rep"))
    prefixes = F.array(*[F.xxhash64(F.lit(t), F.substring("sig", 2 * DEPTH * t + 1, 2 * depth)) for t in range(TREES)])
    nodes = known.select("rep", "cluster", F.posexplode(prefixes).alias("tree", "node"))
    sizes = nodes.groupBy("node").agg(F.count("*").alias("size"), F.min("cluster").alias("lo"), F.max("cluster").alias("hi"), F.min("rep").alias("pivot"))
    shared = checkpoint(nodes.join(sizes.filter("lo <> hi").drop("lo", "hi"), "node"))
    sigs = reps.select("rep", "sig")

    small = shared.filter(F.col("size") <= NODE_BLOCK).select("node", "tree", "rep", "cluster", F.lit(False).alias("near"), F.lit(0).cast("long").alias("near_n"), F.col("size").alias("far_n"))
    if shared.filter(F.col("size") > NODE_BLOCK).isEmpty():
        rows, certain = small, None
    else:
        rest, certain = _by_pivot(shared.filter(F.col("size") > NODE_BLOCK), sigs, least)
        rows = small.unionByName(rest.select(*small.columns))

    going = _dealt(rows, "rep", NODE_BLOCK).join(sigs, "rep").repartition(width, "node", "p", "q").sortWithinPartitions("node", "p", "q")
    joined = going.select("node", "tree", "p", "q", "rep", "cluster", "sig").mapInPandas(lambda b: _join_nodes(b, depth, least), "a long, b long, agree long")
    if certain is not None:
        joined = joined.unionByName(certain)
    return joined.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("agree").alias("agree"))


def candidate_classes(reps: DataFrame, target: float = TARGET_RECALL) -> DataFrame:
    """node and component of every representative (rep, sig) that the forest joins to another one; rounds with ever shorter prefixes."""
    width = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = TREES * DEPTH
    least = math.ceil((THRESHOLD - SLACK) * values)
    found = np.zeros(values + 1)
    clusters, depth = None, DEPTH
    while True:
        met = checkpoint(_meet(reps, clusters, depth, least, width))
        for row in met.groupBy("agree").count().collect():  # at most TREES * DEPTH rows
            found[row["agree"]] += row["count"]
        new = components(met)
        if clusters is None:
            clusters = new
        else:  # met has clusters' names
            above = new.select(F.col("node").alias("component"), F.col("component").alias("higher"))
            known = clusters.select("node").union(met.select("a")).union(met.select("b")).distinct()
            clusters = known.join(clusters, "node", "left").withColumn("component", F.coalesce("component", "node")).join(above, "component", "left")
            clusters = checkpoint(clusters.select("node", F.coalesce("higher", "component").alias("component")))
        depth = next_depth(found, depth, target)
        if not depth:
            return clusters


def _near_pivot(left: pa.Table, right: pa.Table) -> pa.Table:
    """Which texts of a class's chunk are within half the distance that the threshold allows of the class's pivot, exactly."""
    texts = [*left["text"].to_pylist(), right["pivot_text"][0].as_py()]
    *sets, pivot = shingles(texts)
    near = []
    for s in sets:
        common = len(np.intersect1d(s, pivot, assume_unique=True))
        union = len(s) + len(pivot) - common
        near.append(2 * (union - common) <= (1 - THRESHOLD) * union - 1e-9)
    return pa.table({**{c: left[c] for c in ("rep", "form", "class", "copies")}, "near": pa.array(near, pa.bool_())})


def _near_pivots(big: DataFrame) -> DataFrame:
    """Texts of large classes, by whether they are near their class's pivot, with counts of both kinds and the near ones' copies."""
    chunks = F.ceil(F.col("size") / BLOCK).cast("int")
    dealt = big.withColumn("chunk", F.pmod(F.xxhash64(F.lit(4), "rep"), chunks).cast("int"))
    pivots = big.filter("rep = class").select(F.col("class").alias("pivot_class"), F.col("text").alias("pivot_text"), F.explode(F.sequence(F.lit(0), chunks - 1)).alias("pivot_chunk"))
    near = dealt.select("class", "chunk", "rep", "form", "copies", "text").groupBy("class", "chunk").cogroup(pivots.groupBy("pivot_class", "pivot_chunk"))
    near = checkpoint(near.applyInArrow(lambda x, y: _near_pivot(x, y) if x.num_rows else _NONE, "rep long, form long, class long, copies long, near boolean"))
    counts = near.groupBy("class").agg(F.sum(F.col("near").cast("long")).alias("near_n"), F.sum((~F.col("near")).cast("long")).alias("far_n"), F.sum(F.when(F.col("near"), F.col("copies"))).alias("near_copies"))
    return near.join(counts, "class")


def links(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (smallest id that links lead to) and n_links (documents it is linked to) of every document."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null").withColumn("form", F.xxhash64("text"))
    signed = checkpoint(texts.mapInArrow(_signed, "doc_id long, form long, h1 long, h2 long, words long, sig binary"))
    same = ["h1", "h2", "words"]
    reps = signed.filter("words > 0").groupBy(*same).agg(F.min("doc_id").alias("rep"), F.min_by("form", "doc_id").alias("form"), F.count("*").alias("copies"), F.first("sig").alias("sig"))
    reps = checkpoint(reps)
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    candidates = candidate_classes(reps)

    members = candidates.join(candidates.groupBy("component").agg(F.count("*").alias("size")), "component")
    members = checkpoint(members.select(F.col("node").alias("rep"), F.col("component").alias("class"), "size").join(reps.select("rep", "form", "copies"), "rep"))
    # all texts are shuffled once, those of members are kept: the steps below read them several times
    own = checkpoint(members.join(texts.withColumnRenamed("doc_id", "rep").dropDuplicates(["rep", "form"]), ["rep", "form"]))

    rows, certain = own.filter(F.col("size") <= BLOCK).select("class", "rep", "form", "copies", "text", F.lit(False).alias("near"), F.lit(0).cast("long").alias("near_n"), F.col("size").alias("far_n")), None
    if not members.filter(F.col("size") > BLOCK).isEmpty():
        big = own.filter(F.col("size") > BLOCK)
        near = _near_pivots(big)
        certain = near.filter("near").select("rep", (F.col("near_copies") - F.col("copies")).alias("links"), F.col("class").alias("other"))
        rest = near.filter("far_n > 0").join(big.select("rep", "form", "text"), ["rep", "form"])
        rows = rows.unionByName(rest.select(*rows.columns))
    blocks = _dealt(rows, "rep", BLOCK).repartition(width, "class", "p", "q").sortWithinPartitions("class", "p", "q")
    found = blocks.select("class", "p", "q", "block", "rep", "form", "copies", "text").mapInPandas(lambda b: _verify(b, THRESHOLD), "rep long, links long, other long")
    found = checkpoint(found if certain is None else found.unionByName(certain))

    classes = components(found.filter("rep <> other").select(F.col("rep").alias("a"), F.col("other").alias("b")))
    counted = found.groupBy("rep").agg(F.sum("links").alias("links"))
    reps = reps.select(*same, "rep", "copies").join(counted, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    per_text = reps.select(*same, F.coalesce("component", "rep").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = signed.select("doc_id", *same).join(per_text, same, "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents, all their columns, without those that another one of their class stands for (the smallest id).

    Rows with a null id are kept; repeated rows of the kept id are kept too.
    """
    other = "other"
    while other in docs.columns:
        other += "_"
    drop = links(docs).filter("class_id <> doc_id").select(F.col("doc_id").alias(other)).distinct()
    return docs.join(drop, F.col("doc_id") == F.col(other), "left_anti")
