"""Waiting for stages on a stream of status events: each run ends, runs out of time by event time, or still waits."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL, TIMED_OUT, WAITING = "terminal", "timed_out", "waiting"
_NEVER = 1 << 62


def stage_waits(events: DataFrame, run: str, status: str, time: str, *, ends: Sequence[str], seconds: int, late: str = "10 seconds", keep_seconds: int = 86_400, buckets: int = 512) -> DataFrame:
    """(run, wait_status, at) of a stream of events, in append mode: one row when a run ends or runs out of time.

    A run begins with its first event. It is terminal by the first event whose status is in `ends` up to `seconds` after that; it has timed out once an event of it or the
    watermark (`late` behind the latest event of all runs) is past that time. The state of a run is when it began and whether it is told; told
    states expire `keep_seconds` after the deadline (a run has no events later than that), so that state grows with runs that are open or lately ended, not with all. Events later than the watermark, without
    run or time, are left out; a null status is one that ends nothing.

    Runs are kept in `buckets` by their hash, so that Python is called once a bucket and reckons with all its runs at once; the number belongs to
    the checkpoint of a stream and must stay as long as that."""
    limit, keep = seconds * 1000, keep_seconds * 1000
    kind = events.schema[run].dataType.simpleString()

    def step(key: tuple[Any], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        runs, began, told, due = state.get if state.exists else ([], [], [], [])
        known = pd.DataFrame({"began": np.array(began, "int64"), "told": np.array(told, bool), "due": np.array(due, "int64")}, index=pd.Index(list(runs), dtype=object))
        now, sums = state.getCurrentWatermarkMs(), None
        for frame in () if state.hasTimedOut else frames:  # sums of a frame only: a run may have any number of events
            own = frame.assign(ended=frame["ms"].where(frame["ends"], _NEVER)).groupby("run").agg(first=("ms", "min"), last=("ms", "max"), ended=("ended", "min"))
            own.index = pd.Index(own.index.tolist(), dtype=object)
            sums = own if sums is None else pd.concat([sums, own]).groupby(level=0).agg({"first": "min", "last": "max", "ended": "min"})
        # A run without events whose time has come is told, or forgotten where it was told.
        idle = known["due"] < now
        if sums is not None:
            idle &= ~known.index.isin(sums.index)
        known, out = known[~idle | ~known["told"]], []
        late_ones = known.index[idle.reindex(known.index)]
        known.loc[late_ones, "told"] = True
        known.loc[late_ones, "due"] = (known.loc[late_ones, "began"] + limit + keep).clip(lower=now + 1)
        out.append(pd.DataFrame({"run": late_ones, "wait_status": TIMED_OUT, "ms": known.loc[late_ones, "began"].to_numpy() + limit}))
        if sums is not None:
            was_told = known["told"].reindex(sums.index, fill_value=False).astype(bool)
            sums["began"] = known["began"].reindex(sums.index, fill_value=_NEVER).clip(upper=sums["first"]).astype("int64")
            open_ = sums[~was_told]
            deadline = open_["began"] + limit
            ended = open_["ended"] <= deadline
            found = ended | (open_["last"] > deadline) | (now >= deadline)
            rows = pd.DataFrame({"began": open_["began"], "told": found, "due": (deadline + keep).where(found, deadline).clip(lower=now + 1)})
            others = known.drop(open_.index, errors="ignore")
            known = pd.concat([x for x in (others, rows) if len(x)]) if len(others) or len(rows) else rows
            out.append(pd.DataFrame({"run": open_.index, "wait_status": ended.map({True: TERMINAL, False: TIMED_OUT}), "ms": open_["ended"].where(ended, deadline)})[found.to_numpy()])
        if len(known):
            state.update((known.index.tolist(), known["began"].tolist(), known["told"].tolist(), known["due"].tolist()))
            state.setTimeoutTimestamp(max(now + 1, int(known["due"].min())))
        elif state.exists:
            state.remove()
        for rows in out:
            if len(rows):
                yield rows

    known = events.filter(F.col(run).isNotNull() & F.col(time).isNotNull()).withWatermark(time, late)
    rows = known.select(F.col(run).alias("run"), F.col(time).alias("__at"), F.unix_millis(time).alias("ms"), F.coalesce(F.col(status).isin(*ends), F.lit(False)).alias("ends"), F.pmod(F.xxhash64(run), F.lit(buckets)).alias("bucket"))
    kept = f"runs array<{kind}>, began array<long>, told array<boolean>, due array<long>"
    out = rows.groupBy("bucket").applyInPandasWithState(step, f"run {kind}, wait_status string, ms long", kept, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.col("run").alias(run), "wait_status", F.timestamp_millis("ms").alias("at"))


def with_waiting(told: DataFrame, events: DataFrame, run: str) -> DataFrame:
    """The rows told so far and one for each run of the events that still waits."""
    open_ = events.filter(F.col(run).isNotNull()).select(run).distinct().join(told.select(run), run, "left_anti")
    return told.unionByName(open_.select(run, F.lit(WAITING).alias("wait_status"), F.lit(None).cast("timestamp").alias("at")))
