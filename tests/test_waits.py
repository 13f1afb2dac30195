"""Stage waits on a stream against the same rules over all events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from folioframe.streaming import waits

START = datetime(2024, 1, 1)


def told_by_hand(events, seconds, late):
    """(run, status, second) of each run once all events are read."""
    known = [(r, s, t) for r, s, t in events if r is not None and t is not None]
    water, out = max(t for *_, t in known) - late, []
    for run in {r for r, *_ in known}:
        own = [(t, s) for r, s, t in known if r == run]
        deadline = min(own)[0] + seconds
        ended = min((t for t, s in own if s in ("done", "failed")), default=None)
        if ended is not None and ended <= deadline:
            out.append((run, "terminal", ended))
        elif max(t for t, _ in own) > deadline or water >= deadline:
            out.append((run, "timed_out", deadline))
        else:
            out.append((run, "waiting", None))
    return sorted(out)


def test_waits_over_restarts(spark, tmp_path):
    gen = random.Random(16)
    events = []
    for run in range(30):
        began = gen.randrange(0, 900)
        events += [(run, gen.choice(["queued", "running", None]), began + gen.randrange(0, 100)) for _ in range(gen.randint(1, 5))]
        if gen.random() < 0.6:
            events.append((run, gen.choice(["done", "failed"]), began + gen.choice([40, 99, 160])))
    events += [(None, "done", 5), (50, "done", None), (51, "done", 7), (52, "running", 1000)]
    schema, told = "run long, status string, at timestamp", str(tmp_path / "told")
    rows = lambda part: spark.createDataFrame([(r, s, None if t is None else START + timedelta(seconds=t)) for r, s, t in part], schema)
    for low, high in ((-1, 300), (300, 600), (600, 2000)):  # each part by a new query from the checkpoint of the one before
        rows([x for x in events if low < (x[2] or 0) <= high]).write.mode("append").parquet(str(tmp_path / "in"))
        stream = waits.stage_waits(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "run", "status", "at", ends=["done", "failed"], seconds=100, late="20 seconds", keep_seconds=3600)
        stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    found = waits.with_waiting(spark.read.schema("run long, wait_status string, at timestamp").parquet(told), rows([x for x in events if x[2] is not None]), "run")
    got = sorted((r.run, r.wait_status, None if r.at is None else round((r.at - START).total_seconds())) for r in found.selectExpr("run", "wait_status", "cast(at AS timestamp_ntz) AS at").collect())
    want = told_by_hand(events, 100, 20)
    assert got == want and {w[1] for w in want} == {"terminal", "timed_out", "waiting"}


def test_runs_of_one_bucket_are_told_together(spark, tmp_path):
    """Text ids, more events than one frame holds, and fewer calls of Python than runs."""
    events = [(f"r{k:04d}", "done" if k % 3 == 0 and n == 4 else "running", k + 30 * n) for k in range(500) for n in range(5)] + [("last", "running", 5000)]
    schema, calls = "run string, status string, at timestamp", spark.sparkContext.accumulator(0)
    spark.createDataFrame([(r, s, START + timedelta(seconds=t)) for r, s, t in events], schema).write.parquet(str(tmp_path / "in"))

    def counted(function):
        def step(*given):
            calls.add(1)
            yield from function(*given)

        return step

    read = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    grouped = type(read.groupBy("run"))
    apply = grouped.applyInPandasWithState
    try:
        grouped.applyInPandasWithState = lambda self, f, *how: apply(self, counted(f), *how)
        stream = waits.stage_waits(read, "run", "status", "at", ends=["done"], seconds=125, buckets=3)
    finally:
        grouped.applyInPandasWithState = apply
    told = str(tmp_path / "told")
    stream.writeStream.format("parquet").option("path", told).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    got = sorted((r.run, r.wait_status, round((r.at - START).total_seconds())) for r in spark.read.schema("run string, wait_status string, at timestamp").parquet(told).selectExpr("run", "wait_status", "cast(at AS timestamp_ntz) AS at").collect())
    assert got == [x for x in told_by_hand([(r, s, t) for r, s, t in events], 125, 10) if x[1] != "waiting"] and len(got) == 500
    assert calls.value <= 12
