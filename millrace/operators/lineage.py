"""Lineage over parent links, and knowledge that children inherit with less confidence.

Chains are followed by joins that double their reach each round: after k rounds every node knows its
ancestor 2 ** k steps away, so a chain of length n takes log2(n) joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.session import cut

CHILD_LEAST, CHILD_FACTOR = 0.5, 0.9
INHERIT_LEAST, INHERIT_FACTOR = 0.3, 0.8


def roots(nodes: DataFrame, node: str, parent: str, max_rounds: int = 32, checkpoint: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """node, root and depth; a parent that is no node ends the chain. Cycles are an error.

    Every round ends in a table, so the plan of the next one does not contain it.
    """
    known = nodes.select(F.col(node).alias("__known"))
    links = nodes.join(known, F.col(parent) == F.col("__known"), "left").select(F.col(node).alias("node"), F.col("__known").alias("up"))
    state = links.select("node", F.coalesce("up", "node").alias("root"), F.col("up").isNotNull().cast("long").alias("depth"), F.col("up").isNull().alias("done"))
    state = checkpoint(state)
    finished = state.filter("done")
    for _ in range(max_rounds):
        going = state.filter(~F.col("done"))
        if going.isEmpty():
            return finished.select("node", "root", "depth")
        above = state.select(F.col("node").alias("root"), F.col("root").alias("root2"), F.col("depth").alias("depth2"), F.col("done").alias("done2"))
        step = going.join(above, "root").select("node", F.col("root2").alias("root"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("done2").alias("done"))
        state = checkpoint(step.unionByName(finished.select(*step.columns)))
        finished = state.filter("done")
    raise ValueError("parent links form a cycle, or a chain is longer than 2 ** max_rounds")


def _jumps(nodes: DataFrame, node: str, parent: str, checkpoint: Callable[[DataFrame], DataFrame]) -> Iterator[tuple[int, DataFrame]]:
    """1, 2, 4 and so on with links (below, up) over so many steps, as long as there are any. Cycles are an error."""
    known = nodes.select(F.col(node).alias("up"))
    jump = checkpoint(nodes.select(F.col(node).alias("below"), F.col(parent).alias("up")).join(known, "up"))
    most, step = nodes.count(), 1
    while not jump.isEmpty():
        if step >= most:
            raise ValueError("parent links form a cycle")
        yield step, jump
        above = jump.select(F.col("below").alias("up"), F.col("up").alias("up2"))
        jump, step = checkpoint(jump.join(above, "up").select("below", F.col("up2").alias("up"))), 2 * step


def ancestors(nodes: DataFrame, node: str, parent: str, max_depth: int | None = None, checkpoint: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """Pairs of a node and each of its ancestors with their distance; the node itself at 0.

    All of them, unless max_depth is given. Each round doubles the distance that is reached.
    """
    pairs = nodes.select(F.col(node).alias("node"), F.col(node).alias("ancestor"), F.lit(0).alias("distance"))
    for step, jump in _jumps(nodes, node, parent, checkpoint):
        if max_depth is not None and step > max_depth:
            break
        far = pairs.join(jump, F.col("ancestor") == F.col("below")).select("node", F.col("up").alias("ancestor"), (F.col("distance") + step).alias("distance"))
        pairs = checkpoint(pairs.unionByName(far))
    return pairs if max_depth is None else pairs.filter(F.col("distance") <= max_depth)


def descendants(nodes: DataFrame, node: str, parent: str, max_depth: int | None = None, checkpoint: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """How many descendants each node has (itself not counted) and how far the farthest is; nodes without any are left out.

    Counts of the nearer descendants are added up over doubling links, so no pairs are made unless max_depth is given.
    """
    if max_depth is not None:
        pairs = ancestors(nodes, node, parent, max_depth, checkpoint).filter("distance > 0")
        return pairs.groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"), F.max("distance").alias("height"))
    own = nodes.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("own"))
    state = own.select("node", F.col("own").alias("n"), F.lit(0).alias("height"))  # of each node and what is nearer than step
    for step, jump in _jumps(nodes, node, parent, checkpoint):
        far = jump.join(state, F.col("below") == F.col("node")).select(F.col("up").alias("node"), "n", (F.col("height") + step).alias("height"))
        state = checkpoint(state.unionByName(far).groupBy("node").agg(F.sum("n").alias("n"), F.max("height").alias("height")))
    return state.join(own, "node").filter("height > 0").select("node", (F.col("n") - F.col("own")).alias("descendants"), "height")


def inherit(atoms: DataFrame, least: float, factor: float) -> DataFrame:
    """The atoms that pass on: confidence above `least`, times `factor`."""
    return atoms.filter(F.col("confidence") > least).withColumn("confidence", F.col("confidence") * factor)


def spawn(parents: DataFrame, children: DataFrame, atoms: DataFrame, owner: str) -> DataFrame:
    """What each child (child, parent) inherits of its parent's atoms (owner, key, value, confidence)."""
    return children.join(inherit(atoms, CHILD_LEAST, CHILD_FACTOR).withColumnRenamed(owner, "parent"), "parent")


def decayed(confidence: Column, generations: Column, least: float = CHILD_LEAST, factor: float = CHILD_FACTOR) -> Column:
    """Confidence after so many generations; null once a parent's was not above `least`."""
    before = confidence * F.pow(F.lit(factor), generations - 1)
    return F.when(generations == 0, confidence).when(before > least, confidence * F.pow(F.lit(factor), generations))


def upsert(atoms: DataFrame, owner: str, key: str, seq: str) -> DataFrame:
    """Of each owner's key: the last value, the highest confidence, and the first source."""
    return atoms.groupBy(owner, key).agg(F.max_by("value", seq).alias("value"), F.max("confidence").alias("confidence"), F.min_by("source", seq).alias("source"))


def query(atoms: DataFrame, key: str, least: float = 0.5) -> DataFrame:
    """Atoms of a key that are certain enough."""
    return atoms.filter((F.col("key") == key) & (F.col("confidence") >= least))


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int | None = None, checkpoint: Callable[[DataFrame], DataFrame] = cut) -> DataFrame:
    """start, node, distance and path of every capability that a start leads to by the shortest way.

    A breadth-first round a step, each ending in a table; a node is taken up once for each start, by the smallest path, so the
    rounds end by themselves. max_depth, if given, bounds the distance.
    """
    seen = starts.select(F.col("start"), F.col("start").alias("node"), F.lit(0).alias("distance"), F.col("start").alias("path"))
    frontier = seen
    d = 0
    while max_depth is None or d < max_depth:
        d += 1
        step = frontier.join(edges, F.col("node") == F.col("src")).select("start", F.col("dst").alias("node"), F.lit(d).alias("distance"), F.concat_ws("->", "path", "dst").alias("path"))
        new = step.join(seen.select("start", "node"), ["start", "node"], "left_anti").groupBy("start", "node", "distance").agg(F.min("path").alias("path"))
        frontier = checkpoint(new)
        if frontier.isEmpty():
            break
        seen = checkpoint(seen.unionByName(frontier))
    return seen


def neighbours(edges: DataFrame, nodes: DataFrame, node: str) -> DataFrame:
    """The nodes that edges (src, dst) lead to from each node."""
    return nodes.join(edges, F.col(node) == F.col("src")).select(node, F.col("dst").alias("neighbour")).distinct()


def inherit_from_best(ranked: DataFrame, atoms: DataFrame, owner: str) -> DataFrame:
    """What each query (id, rank, similar_id) inherits from the most similar one."""
    best = ranked.filter("rank = 1").select("id", F.col("similar_id").alias(owner))
    return best.join(inherit(atoms, INHERIT_LEAST, INHERIT_FACTOR), owner)


def inherited_keys(ranked: DataFrame, states: DataFrame, owner: str, state: str, path: str, least: float = 0.7) -> DataFrame:
    """For each query (id, rank, similar_id, score) the most similar one that is similar enough, its state's keys and its path."""
    best = select_for_inheritance(ranked, least).groupBy("id").agg(F.min_by("similar_id", "rank").alias(owner))
    return best.join(states, owner).select("id", owner, F.array_sort(F.map_keys(state)).alias("keys"), path)


def select_for_inheritance(ranked: DataFrame, least: float = 0.7) -> DataFrame:
    """The candidates that are similar enough to inherit from, ranked anew among themselves (they keep their order)."""
    return ranked.filter(F.col("score") >= least)
