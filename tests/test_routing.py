import pytest
from pyspark.sql import functions as F

from millrace.operators import routing
from millrace.plans.catalog import App, Catalog


def cut(df):
    return df.checkpoint()


def test_self_loop_stops_at_the_bound(spark):
    app = App(spark, max_hops=5)
    app.catalog.node("loop", then="loop")(lambda rows: rows.withColumn("state", routing.enrich(F.col("state"), F.create_map(F.lit("n"), (F.coalesce(F.col("state")["n"], F.lit("0")).cast("int") + 1).cast("string")))))
    out = app.execute(app.start(spark.range(3), "loop")).collect()
    assert [(r.terminated, r.state["n"]) for r in out] == [(True, "5")] * 3
    assert all("bound 5" in r.error for r in out)


def test_unknown_capability_ends_with_an_error(spark):
    app = App(spark)
    out = app.execute(app.start(spark.range(1), "nowhere")).first()
    assert out.terminated and out.error == "no node for nowhere"


def test_two_hops_by_loop_and_by_fused_path(spark):
    app = App(spark)

    @app.catalog.enrich("a", then="b")
    def _a(rows):
        return F.create_map(F.lit("a"), (F.col("state")["seed"].cast("int") + 1).cast("string"))

    @app.catalog.enrich("b")
    def _b(rows):
        return F.create_map(F.lit("b"), (F.col("state")["a"].cast("int") * 3).cast("string"))

    start = app.start(spark.range(2).withColumn("state", F.create_map(F.lit("seed"), F.lit("10"))), "a")
    for out in (app.execute(start), app.execute_path(start, ["a", "b"])):
        assert {(r.state["a"], r.state["b"]) for r in out.collect()} == {("11", "33")}


def test_validation_terminates_rows(spark):
    app = App(spark)

    @app.catalog.validate("check")
    def _check(rows):
        return [(F.col("id") > 0, "id must be positive"), (F.col("id") < 2, "id must be small")]

    got = {r.id: (r.terminated, r.error) for r in app.execute(app.start(spark.range(3), "check")).collect()}
    assert got == {0: (True, "Validation failed: id must be positive"), 1: (False, None), 2: (True, "Validation failed: id must be small")}


def test_catalog_names_aliases_tags_hooks(spark):
    c = Catalog()
    c.register("x", lambda d: d, tags=["io"])
    c.alias("y", "x")
    assert c.has("y") and c.names() == ["x"] and c.tagged("io") == ["x"] and c.resolve("y") is c.nodes["x"]
    seen = []
    c.hook("before_node", lambda name, rows: seen.append(name))
    c.hook("before_node", lambda name, rows: 1 / 0)
    c.table()["y"](spark.range(1))
    assert seen == ["y"]
    with pytest.raises(ValueError):
        c.register("", lambda d: d)
    c.unregister("x")
    assert not c.has("y")
