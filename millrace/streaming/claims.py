"""Claims of operations on a stream: the first message of a key owns it, others are duplicates or conflicts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUTPUT = "key string, message_id string, role string, attempt int"
STATE = "fingerprint string, attempt int, lease_until long, forget_at long"


def claim_stream(messages: DataFrame, lease_s: int = 300, keep_s: int = 86_400, delay: str = "1 minute", ts: str = "ts") -> DataFrame:
    """key, message_id, role and attempt of each message (key, message_id, fingerprint and an event time).

    An owner's lease runs lease_s from its message; the next message after that, with the same fingerprint, owns the key
    anew, with one more attempt. A key is forgotten keep_s after its last claim, once the watermark is past that, so
    state is bounded. Both go by event time.
    """

    def claim(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        fingerprint, attempt, lease_until, forget_at = state.get if state.exists else (None, 0, 0, 0)
        out = []
        rows = pd.concat(list(batches)).sort_values([ts, "message_id"])
        for message_id, given, at in zip(rows["message_id"], rows["fingerprint"], rows[ts], strict=True):
            now = int(at.timestamp() * 1000)
            if fingerprint is not None and given != fingerprint:
                role = "conflict"
            elif attempt and now < lease_until:
                role = "duplicate"
            else:
                role, fingerprint, attempt = "owner", given, attempt + 1
                lease_until, forget_at = now + 1000 * lease_s, now + 1000 * max(lease_s, keep_s)
            out.append((key[0], message_id, role, attempt))
        state.update((fingerprint, attempt, lease_until, forget_at))
        state.setTimeoutTimestamp(max(forget_at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["key", "message_id", "role", "attempt"])

    timed = messages.withWatermark(ts, delay)
    return timed.groupBy("key").applyInPandasWithState(claim, OUTPUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
