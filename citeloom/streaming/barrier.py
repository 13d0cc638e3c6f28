"""Co-citation groups that are released once all their members have come, and a chain of what was written."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RELEASED = "group_id string, members array<string>, n int, released string"
_HELD = "members array<string>, size int, latest long"


def _collect(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    held, size, latest = state.get if state.exists else ([], 0, 0)
    held = list(held)
    for frame in frames:
        if frame.empty:  # a timeout comes without rows
            continue
        held += frame["citation_id"].tolist()
        size = max(size, int(frame["group_size"].max()))
        latest = max(latest, int(frame["ts"].max().timestamp() * 1000))
    members = sorted(set(held))
    whole = size > 0 and len(members) >= size
    if whole or state.hasTimedOut:
        if state.exists:
            state.remove()
        how = "whole" if whole else "timeout"
        yield pd.DataFrame({"group_id": [key[0]], "members": [members], "n": [len(members)], "released": [how]})
        return
    state.update((members, size, latest))
    state.setTimeoutTimestamp(max(latest, state.getCurrentWatermarkMs()) + 1)


def whole_groups(members: DataFrame, *, late: str = "1 hour") -> DataFrame:
    """Groups of a stream (group_id, citation_id, group_size, ts), each once all its members are there.

    A group that is not whole when the watermark has passed by ``late`` is
    released as it is, marked ``timeout``; the state of a released group goes.
    A group's state has only its members' ids.
    """
    marked = members.withWatermark("ts", late).select("group_id", "citation_id", "group_size", "ts")
    return marked.groupBy("group_id").applyInPandasWithState(_collect, RELEASED, _HELD, "append", GroupStateTimeout.EventTimeTimeout)


def resumable(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """Start a query that goes on from its checkpoint; a batch that is run again gets the same number, so ``write`` can replace it."""
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def chain_state(links: DataFrame, written: DataFrame) -> DataFrame:
    """Whether a chain of digests (place, link) still fits what was written (place, sha256): ok, torn, mismatch or unchained.

    Link i is the SHA-256 of link i-1 and row i's digest, the first of an empty
    text; each link is checked against its predecessor, so the check is a join,
    not a walk.
    """
    before = links.select((F.col("place") + 1).alias("place"), F.col("link").alias("before"))
    first = F.coalesce("before", F.when(F.col("place") == 0, F.lit("")))
    both = written.join(links, "place", "full_outer").join(before, "place", "left")
    state = (
        F.when(F.col("sha256").isNull(), "torn").when(F.col("link").isNull(), "unchained").when(F.sha2(F.concat(first, F.col("sha256")), 256).eqNullSafe(F.col("link")), "ok").otherwise("mismatch")
    )
    return both.select("place", state.alias("state"))
