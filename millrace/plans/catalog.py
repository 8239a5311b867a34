"""Capabilities by name, and an application that runs envelopes through them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import routing

Hook = Callable[[str, DataFrame], None]


class Catalog:
    """Functions from DataFrame to DataFrame under names and aliases."""

    def __init__(self) -> None:
        self.nodes: dict[str, routing.Transform] = {}
        self.aliases: dict[str, str] = {}
        self.tags: dict[str, set[str]] = {}
        self.hooks: dict[str, list[Hook]] = {}

    def register(self, name: str, transform: routing.Transform, tags: Sequence[str] = ()) -> None:
        """The last registration of a name counts."""
        if not name:
            raise ValueError("a capability needs a name")
        self.nodes[name] = transform
        self.tags[name] = set(tags)

    def unregister(self, name: str) -> None:
        self.nodes.pop(name, None)
        self.tags.pop(name, None)

    def alias(self, alias: str, name: str) -> None:
        self.aliases[alias] = name

    def resolve(self, name: str) -> routing.Transform:
        return self.nodes[self.aliases.get(name, name)]

    def has(self, name: str) -> bool:
        return self.aliases.get(name, name) in self.nodes

    def names(self) -> list[str]:
        return sorted(self.nodes)

    def tagged(self, tag: str) -> list[str]:
        return sorted(n for n, t in self.tags.items() if tag in t)

    def node(self, name: str, then: str | None = None, tags: Sequence[str] = ()):
        """Decorator: a function over rows that are at `name`; they go on to `then`, or stop."""

        def wrap(fn: routing.Transform) -> routing.Transform:
            self.register(name, lambda rows: fn(rows).withColumn("next", F.lit(then).cast("string")), tags)
            return fn

        return wrap

    def enrich(self, name: str, then: str | None = None):
        """Decorator: a function that gives a map column, laid over the state."""

        def wrap(fn: Callable[[DataFrame], Column]) -> Callable[[DataFrame], Column]:
            self.node(name, then)(lambda rows: rows.withColumn("state", routing.enrich(F.col("state"), fn(rows))))
            return fn

        return wrap

    def validate(self, name: str, then: str | None = None):
        """Decorator: a function that gives rules; rows that break one are terminated with an error."""

        def wrap(fn: Callable[[DataFrame], Sequence[tuple[Column, str]]]):
            def run(rows: DataFrame) -> DataFrame:
                checked = routing.validate(rows.drop("error"), fn(rows))
                return checked.withColumn("terminated", ~F.col("validation_passed")).drop("errors", "validation_passed")

            self.node(name, then)(run)
            return fn

        return wrap

    def hook(self, event: str, callback: Hook) -> None:
        self.hooks.setdefault(event, []).append(callback)

    def table(self) -> dict[str, routing.Transform]:
        """All names and aliases with their functions, hooks around them."""

        def hooked(name: str, fn: routing.Transform) -> routing.Transform:
            def run(rows: DataFrame) -> DataFrame:
                self._call("before_node", name, rows)
                out = fn(rows)
                self._call("after_node", name, out)
                return out

            return run if self.hooks else fn

        every = dict(self.nodes) | {a: self.nodes[n] for a, n in self.aliases.items() if n in self.nodes}
        return {name: hooked(name, fn) for name, fn in every.items()}

    def _call(self, event: str, name: str, rows: DataFrame) -> None:
        for callback in self.hooks.get(event, []):
            try:
                callback(name, rows)
            except Exception:  # a hook's failure is not the pipeline's
                continue


class App:
    """A catalog with a way to start requests and run them."""

    def __init__(self, spark: SparkSession, max_hops: int = routing.MAX_HOPS):
        self.spark, self.catalog, self.max_hops = spark, Catalog(), max_hops

    def start(self, requests: DataFrame, at: str, node: str = "id") -> DataFrame:
        """Envelopes of requests (with a state map, or an empty one) that are at a capability."""
        state = F.col("state") if "state" in requests.columns else F.create_map().cast("map<string,string>")
        return requests.select(F.col(node).alias("id"), state.alias("state"), F.lit(at).alias("next"), F.lit(None).cast("string").alias("error"), F.lit(False).alias("terminated"))

    def execute(self, envelopes: DataFrame, checkpoint=None) -> DataFrame:
        return routing.run_hops(envelopes, self.catalog.table(), self.max_hops, checkpoint)

    def execute_path(self, envelopes: DataFrame, path: Sequence[str]) -> DataFrame:
        """A path known beforehand, as one plan without a loop."""
        return envelopes.transform(routing.fuse(path, self.catalog.table()))
