"""Circuit breaker, token bucket and retries as folds over each key's calls in order.

Calls are sorted within partitions and the fold's state is carried from batch to batch, so a key's calls
are never held together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAILURES, OPEN_S = 5, 60.0
RATE, BURST = 100.0, 10.0
ATTEMPTS, BACKOFF = 3, 2.0


def _fold(calls: DataFrame, key: str, order: list[str], start: Callable[[], dict], step: Callable[[dict, object], object], column: str, kind: str) -> DataFrame:
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in calls.schema.fields) + f", {column} {kind}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, state = object(), start()
        for batch in batches:
            out = []
            own = batch[key].astype(object).where(batch[key].notna(), None)  # null is one key, NaN would differ from itself
            for name, row in zip(own, batch.itertuples(index=False), strict=True):
                if name != current:
                    current, state = name, start()
                out.append(step(state, row))
            yield batch.assign(**{column: out})

    return calls.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def circuit_breaker(calls: DataFrame, key: str, order: list[str], ts: str, success: str, failures: int = FAILURES, open_s: float = OPEN_S) -> DataFrame:
    """Each call's verdict: allowed, or rejected while the key's circuit is open.

    ts is a number of seconds. The circuit opens at so many failures, a success takes one off; after open_s
    one call is tried: it closes the circuit or opens it anew.
    """

    def step(s: dict, row) -> str:
        now = getattr(row, ts)
        if s["open_at"] is not None:
            if now - s["open_at"] < open_s:
                return "rejected"
            s["open_at"], s["n"] = None, failures - 1  # half open: one failure opens it again
        if getattr(row, success):
            s["n"] = max(0, s["n"] - 1)
        else:
            s["n"] += 1
            if s["n"] >= failures:
                s["open_at"] = now
        return "allowed"

    return _fold(calls, key, order, lambda: {"n": 0, "open_at": None}, step, "verdict", "string")


def token_bucket(calls: DataFrame, key: str, order: list[str], ts: str, rate: float = RATE, burst: float = BURST) -> DataFrame:
    """Whether each call gets a token of its key's bucket, refilled at `rate` a second up to `burst`."""

    def step(s: dict, row) -> bool:
        now = getattr(row, ts)
        s["tokens"] = min(burst, s["tokens"] + (now - s["at"]) * rate) if s["at"] is not None else burst
        s["at"] = now
        if s["tokens"] >= 1:
            s["tokens"] -= 1
            return True
        return False

    return _fold(calls, key, order, lambda: {"tokens": burst, "at": None}, step, "granted", "boolean")


def retry_plan(attempt: Column, success: Column, attempts: int = ATTEMPTS, base_s: float = 1.0) -> Column:
    """done, dead, or the seconds until the next attempt."""
    return F.when(success, F.lit("done")).when(attempt >= attempts, F.lit("dead")).otherwise(F.concat(F.lit("retry in "), (base_s * F.pow(F.lit(BACKOFF), attempt - 1)).cast("string"), F.lit(" s")))
