"""Scores of pipelines from their history, and variation of paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

UNSEEN, DAMPING_MS = 0.5, 100
MUTATION_RATE, CROSSOVER_RATE, TOURNAMENT = 0.1, 0.7, 3


def path_stats(runs: DataFrame, path: str, success: str, latency: str) -> DataFrame:
    """Counters of each path."""
    return runs.groupBy(path).agg(F.count("*").alias("runs"), F.avg(F.col(success).cast("double")).alias("success_rate"), F.avg(latency).alias("avg_latency"))


def evolve_score(success_rate: Column, avg_latency: Column) -> Column:
    """What a path is worth: fast and successful; an unseen one is worth the middle."""
    return F.when(success_rate.isNull(), UNSEEN).otherwise(success_rate * 1000 / (avg_latency + DAMPING_MS))


def best_pipeline(candidates: DataFrame, stats: DataFrame, by: str, path: str, seq: str) -> DataFrame:
    """Of each group's candidate paths the best; the first of equals."""
    scored = candidates.join(stats, path, "left").withColumn("score", F.round(evolve_score(F.col("success_rate"), F.col("avg_latency")), 9))
    best = scored.groupBy(by).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(seq).alias("q"), F.col(path).alias("p"))).alias("b"))
    return best.select(by, F.col("b.p").alias("best_path"), (-F.col("b.s")).alias("score"))


def fitness(success_rate: Column, avg_latency: Column) -> Column:
    """0.7 for success, 0.3 for speed on a scale of ten seconds."""
    return success_rate * 0.7 + 0.3 * F.greatest(F.lit(0.0), 1 - avg_latency / 10_000)


def genomes(runs: DataFrame, path: str, seq: str, success: str, latency: str) -> DataFrame:
    """Each path's averages, and the fitness it had at its first run."""
    return runs.groupBy(path).agg(
        F.count("*").alias("executions"), F.avg(F.col(success).cast("double")).alias("success_rate"), F.avg(latency).alias("avg_latency"),
        F.min_by(fitness(F.col(success).cast("double"), F.col(latency)), seq).alias("fitness"), F.min(seq).alias("first_seen"),
    )


def history_best(runs: DataFrame, by: str, path: str, success: str, latency: str) -> DataFrame:
    """Each group's path of the highest success rate, then the least latency, then the smaller name."""
    stats = runs.groupBy(by, path).agg(F.avg(F.col(success).cast("double")).alias("success_rate"), F.avg(latency).alias("avg_latency"))
    order = Window.partitionBy(by).orderBy(F.col("success_rate").desc(), "avg_latency", path)
    return stats.withColumn("r", F.row_number().over(order)).filter("r = 1").drop("r")


def gene_fitness(genes: Column, valid: Column) -> Column:
    """0.5 if all genes are valid, and the share of distinct ones."""
    return F.when(F.forall(genes, lambda g: F.array_contains(valid, g)), 0.5).otherwise(0.0) + F.when(F.size(genes) > 0, 0.5 * F.size(F.array_distinct(genes)) / F.size(genes)).otherwise(0.0)


def gene_fitness_by(rows: DataFrame, owner: str, gene: str, valid: list[str]) -> DataFrame:
    """gene_fitness of each owner's genes, a row each; by counts, so that no history is gathered."""
    n, bad = F.count(gene), F.max((~F.col(gene).isin(valid)).cast("int"))
    fitness = F.when(F.coalesce(bad, F.lit(0)) == 0, 0.5).otherwise(0.0) + F.when(n > 0, 0.5 * F.count_distinct(gene) / n).otherwise(0.0)
    return rows.groupBy(owner).agg(fitness.alias("fitness"))


def _unit(salt: str, *cols: Column) -> Column:
    """A number in [0, 1) from the MD5 of salt and row: variation is repeatable, survives retries and is the same in SQL."""
    digest = F.md5(F.concat_ws("|", F.lit(salt), *[c.cast("string") for c in cols]).cast("binary"))
    return F.conv(F.substring(digest, 25, 8), 16, 10).cast("long") / float(1 << 32)


def mutate(genes: Column, pool: Column, seed: Column, rate: float = MUTATION_RATE) -> Column:
    """Each gene replaced by one of the pool at the rate; places are drawn from the seed."""
    return F.transform(
        genes, lambda g, i: F.when(_unit("mutate", seed, i) < rate, F.element_at(pool, (F.floor(_unit("gene", seed, i) * F.size(pool)) + 1).cast("int"))).otherwise(g)
    )


def insert_gene(genes: Column, pool: Column, seed: Column) -> Column:
    at = (F.floor(_unit("at", seed) * (F.size(genes) + 1)) + 1).cast("int")
    return F.array_insert(genes, at, F.element_at(pool, (F.floor(_unit("what", seed) * F.size(pool)) + 1).cast("int")))


def delete_gene(genes: Column, seed: Column) -> Column:
    """One gene removed; a path of one gene stays."""
    at = F.floor(_unit("del", seed) * F.size(genes))
    return F.when(F.size(genes) <= 1, genes).otherwise(F.filter(genes, lambda _, i: i != at))


def crossover(a: Column, b: Column, seed: Column, rate: float = CROSSOVER_RATE) -> Column:
    """At the rate, a up to a drawn point and b from there on; else a."""
    n = F.least(F.size(a), F.size(b))
    cut = (F.floor(_unit("cut", seed) * n)).cast("int")
    child = F.concat(F.slice(a, F.lit(1), cut), F.slice(b, cut + 1, F.greatest(F.size(b) - cut, F.lit(0))))
    return F.when((_unit("cross", seed) < rate) & (n > 1), child).otherwise(a)


def uniform_crossover(a: Column, b: Column, seed: Column) -> Column:
    """Each place from a or b."""
    pairs = F.arrays_zip(a.alias("a"), b.alias("b"))
    return F.filter(F.transform(pairs, lambda p, i: F.when(_unit("side", seed, i) < 0.5, p["a"]).otherwise(p["b"])), lambda x: x.isNotNull())


def tournament(population: DataFrame, individual: str, score: str, rounds: int, size: int = TOURNAMENT) -> DataFrame:
    """The best of `size` drawn individuals in each round.

    Draws are by rank of a hash over a dense number of the individuals.
    """
    from millrace.operators.swarm import dense_index

    numbered = dense_index(population, individual)
    n = F.broadcast(numbered.agg(F.count("*").alias("n")))  # one row
    draws = population.sparkSession.range(rounds).select(F.col("id").alias("round"), F.explode(F.sequence(F.lit(1), F.lit(size))).alias("draw")).join(n)
    draws = draws.filter("n > 0").withColumn("index", F.floor(_unit("draw", F.col("round"), F.col("draw")) * F.col("n")))
    return draws.join(numbered, "index").groupBy("round").agg(F.max_by(individual, F.struct(F.col(score), -F.col(individual))).alias("winner"))


def totals(genes: DataFrame) -> DataFrame:
    """Over all genomes (executions, success_rate, avg_latency, fitness): their number, executions, means and the best fitness."""
    return genes.agg(F.count("*").alias("genomes"), F.sum("executions").alias("executions"), F.avg("success_rate").alias("mean_success_rate"), F.avg("avg_latency").alias("mean_latency"), F.max("fitness").alias("best_fitness"))
