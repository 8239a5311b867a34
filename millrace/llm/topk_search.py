"""Exact top-k inner-product search with a ball tree on each shard.

Vectors are turned into integers; shards of them are packed, and each query block meets each shard once.
In a shard, a query visits the tree's nodes in the order of their upper bound (centre's product plus norm
times radius) and stops at the first node that can't reach its current kth score. That score is
shared: a first round over each block's own shard sets it, and a task that serves several shards, one after
the other, carries each block's scores on to the next; a shard whose root can't reach them is not searched,
and its tree is built once a task. Shards keep k candidates a query, merged by a window.

Scores are exact integers: in floating point where all products and sums stay below 2 ** 53, in 64-bit
integers below 2 ** 63, beyond that in integers of any size. What does not fit a long is returned as the
nearest long, in the order of the exact scores within a shard.

Vectors that are null, or hold a null or non-finite component, take no part, nor do rows with a null id.
Repeated ids are candidates each, but for the query's own id. Vectors of another length than the query's
are no candidates. Ties go to the smaller id. Other columns are ignored. Empty tables give an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm._common import checkpoint

SHARD_ROWS = 4096
BLOCK_ROWS = 4096
LEAF = 64
FOUND = "query_id long, vec_id long, score long"


class BallTree:
    """Nodes of centre, radius and children over rows of integers; leaves of at most LEAF rows."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.exact, self.ids = rows[order], ids[order]
        self.rows = self.exact.astype(np.float64)
        self.largest = float(np.abs(self.rows).max(initial=0))
        self.centre: list[np.ndarray] = []
        self.radius: list[float] = []
        self.child: list[tuple[int, int] | None] = []
        self.members: list[np.ndarray | None] = []
        self._grow(np.arange(len(ids)))
        self.centres, self.radii = np.array(self.centre), np.array(self.radius)
        self.norms = np.sqrt((self.centres**2).sum(1))

    def _grow(self, some: np.ndarray) -> int:
        todo = [(some, -1, 0)]
        root = len(self.centre)
        while todo:
            some, parent, side = todo.pop()
            x = self.rows[some]
            c = x.mean(0)
            d = ((x - c) ** 2).sum(1)
            me = len(self.centre)
            self.centre.append(c)
            self.radius.append(float(np.sqrt(d.max())) * (1 + 1e-9) + 1e-6)
            self.members.append(some if len(some) <= LEAF or d.max() == 0 else None)
            self.child.append(None)
            if parent >= 0:
                pair = list(self.child[parent] or (0, 0))
                pair[side] = me
                self.child[parent] = tuple(pair)
            if self.members[me] is None:
                far = x[d.argmax()]
                other = x[((x - far) ** 2).sum(1).argmax()]
                by = np.argsort(x @ (other - far), kind="stable")
                half = len(some) // 2
                todo += [(some[np.sort(by[:half])], me, 0), (some[np.sort(by[half:])], me, 1)]
        return root

    def scores(self, members: np.ndarray, q: np.ndarray, most: float) -> np.ndarray:
        """Exact products; most: a bound of any of them and of their partial sums."""
        if most < 2**53:
            return (self.rows[members] @ q.astype(np.float64)).astype(np.int64)
        if most < 2**62:
            return self.exact[members] @ q
        return self.exact[members].astype(object) @ q.astype(object)

    def search(self, q: np.ndarray, own: int, k: int, least: float) -> tuple[list[tuple[int, int]], float]:
        """Rows (score, id) that may be among the k best, given that scores below `least` are not; the kth score."""
        real = q.astype(np.float64)
        norm = np.sqrt(real @ real)
        # the slack covers rounding, whose size goes with the norms
        bounds = self.centres @ real + self.radii * norm * (1 + 1e-9) + self.norms * norm * 1e-12 + 1e-6
        most = self.largest * float(np.abs(real).max(initial=0)) * max(1, len(q))
        heap = [(-bounds[0], 0)]
        best: list[tuple[int, int]] = []  # min-heap of (score, -id)
        while heap:
            bound, node = heapq.heappop(heap)
            kth = best[0][0] if len(best) == k else least
            if -bound < max(kth, least):
                break
            members = self.members[node]
            if members is None:
                for x in self.child[node]:
                    if bounds[x] >= max(kth, least):
                        heapq.heappush(heap, (-bounds[x], x))
                continue
            scores = self.scores(members, q, most)
            for i in np.flatnonzero(scores >= max(kth, least)).tolist():
                vec_id = int(self.ids[members[i]])
                if vec_id == own:
                    continue
                entry = (int(scores[i]), -vec_id)
                if len(best) < k:
                    heapq.heappush(best, entry)
                elif entry > best[0]:
                    heapq.heapreplace(best, entry)
        return [(s, -v) for s, v in best], max(least, best[0][0]) if len(best) == k else least


def quantised(vectors: DataFrame, factor: int = 1024) -> DataFrame:
    """vec_id and v (integers) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0) & finite)
    return rows.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * factor).cast("long")).alias("v"))


def _packed(rows: DataFrame, number: str, per: int, n: int) -> DataFrame:
    """Rows dealt into packs of about `per` by a hash of the id: ids and integers, dim apart, as bytes."""
    packs = max(1, -(-n // per))
    keyed = rows.select("vec_id", "v", F.size("v").alias("dim"), F.pmod(F.xxhash64(F.lit(9), "vec_id"), F.lit(packs)).cast("int").alias(number))

    def pack(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        values = np.stack(pdf["v"].to_numpy()).astype("<i8")
        return pd.DataFrame({number: [key[0]], "dim": [key[1]], "ids": [pdf["vec_id"].to_numpy().astype("<i8").tobytes()], "rows": [values.tobytes()]})

    return keyed.groupBy(number, "dim").applyInPandas(pack, f"{number} int, dim int, ids binary, rows binary")


def _matrix(pack) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(pack.ids, "<i8")
    return ids, np.frombuffer(pack.rows, "<i8").reshape(len(ids), -1)


def _unpacked(kth: bytes) -> Iterator[float]:
    """Scores as they were written: integers of any size, or -inf where there are fewer than k."""
    return (-np.inf if x == "-inf" else int(x) for x in kth.decode().split())


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score: each query's k best candidates of `vectors`, both with vec_id and v."""
    spark = vectors.sparkSession
    vectors, queries = checkpoint(vectors), checkpoint(queries)
    shards = checkpoint(_packed(vectors, "shard", shard_rows, vectors.count()))
    blocks = checkpoint(_packed(queries, "block", block_rows, queries.count())).select("block", "dim", F.col("ids").alias("q_ids"), F.col("rows").alias("q_rows"))
    n_blocks = (blocks.agg(F.max("block")).first()[0] or 0) + 1
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))).join(blocks, ["block", "dim"])

    def block_of(pair) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(pair.q_ids, "<i8"), np.frombuffer(pair.q_rows, "<i8").reshape(-1, pair.dim)

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = (None, None)
        kth: dict[tuple[int, int], list] = {}  # of each block that this task has met
        for batch in batches:
            for pair in batch.itertuples(index=False):
                if tree[0] != (pair.shard, pair.dim):
                    ids, rows = _matrix(pair)
                    tree = ((pair.shard, pair.dim), BallTree(rows, ids))
                q_ids, q_rows = block_of(pair)
                least = kth.setdefault((pair.block, pair.dim), list(_unpacked(pair.kth)) if pair.kth is not None else [-np.inf] * len(q_ids))
                out = []
                for i, own in enumerate(q_ids.tolist()):
                    found, least[i] = tree[1].search(q_rows[i], own, k, least[i])
                    out += [(own, v, min(max(x, -(2**63)), 2**63 - 1)) for x, v in found]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"], dtype=np.int64)

    def kth_scores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for pair in batch.itertuples(index=False):
                ids, rows = _matrix(pair)
                tree = BallTree(rows, ids)
                found = [tree.search(q, own, k, -np.inf)[1] for own, q in zip(*(x.tolist() if x.ndim == 1 else x for x in block_of(pair)), strict=True)]
                yield pd.DataFrame({"block": [pair.block], "dim": [pair.dim], "kth": [" ".join(map(str, found)).encode()]})

    shard_of = F.pmod(F.col("block"), F.lit(max(1, shards.select("shard").distinct().count())))
    seeds = pairs.filter(F.col("shard") == shard_of).repartition(width, "block", "dim").mapInPandas(kth_scores, "block int, dim int, kth binary")
    seeds = checkpoint(seeds)
    going = pairs.join(seeds, ["block", "dim"], "left").repartition(width, "shard").sortWithinPartitions("shard", "dim", "block")
    found = going.mapInPandas(search, FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
