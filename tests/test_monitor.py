import datetime as dt
import json
import os
import time

import pytest
from pyspark.sql import functions as F

from riskframe.operators.models import LinearModel
from riskframe.plans import analytics_catalog
from riskframe.streaming import monitor

MODEL = LinearModel(("a", "b"), (0.5, -1.0), 0.2)
START = dt.datetime(2024, 3, 1)


def request(i, hours, **features):
    at = START + dt.timedelta(hours=hours)
    return {"request_id": f"r{i}", "at": at.isoformat(), "client_id": f"c{i % 5}", "features": {k: str(v) for k, v in features.items()}}


def put(folder, name, rows):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{name}.json", "w") as f:
        f.write("\n".join(map(json.dumps, rows)))
    time.sleep(0.05)


def rows_of(df):
    return {r.window_start: (r.requests, r.valid, r.positive, pytest.approx(r.score_sum), list(r.score_counts), [tuple(x) for x in r.inputs]) for r in df.collect()}


def test_late_repeated_and_restarted_input_equals_the_batch(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "checkpoint"))
    day = [request(i, i / 2, a=i % 7, b=(i % 4) / 2) for i in range(96)]
    day[5]["features"] = {"a": "x", "b": "1"}
    day[6]["features"] = {}
    put(source, "0", day[:30])
    put(source, "1", day[40:60] + day[10:20])  # repeats of what was answered
    run = lambda: monitor.monitor_stream(spark, MODEL, source, out, 0.5, checkpoint, delay="12 hours", size="6 hours", files=1)
    run()
    first = spark.read.parquet(out).count()
    put(source, "2", day[36:40] + day[60:70])  # late, but within the delay
    run()
    put(source, "3", day[70:] + day[60:65])
    put(source, "4", [request(1000, 500, a=1, b=1)])
    put(source, "5", [request(1001, 1.0, a=1, b=1), request(1002, 501, a=1, b=1)])  # the first is too late
    run()
    seen = day[:30] + day[36:]
    batch = spark.createDataFrame(
        [(r["request_id"], dt.datetime.fromisoformat(r["at"]), r["client_id"], r["features"]) for r in seen + seen[:20]], monitor.TIMED_REQUEST
    )
    want = rows_of(monitor.monitor(batch, MODEL, 0.5, size="6 hours"))
    got = rows_of(spark.read.parquet(out))
    assert 0 < first < len(got) and got == want
    assert sum(w[0] for w in want.values()) == 90 and sum(w[1] for w in want.values()) == 88
    run()
    assert spark.read.parquet(out).count() == len(got)


def test_counts_of_a_window(spark):
    rows = [("1", START, "c", {"a": "1", "b": "0"}), ("2", START, "c", {"a": "-9", "b": "0"}), ("3", START, "c", {"a": "2"}), ("1", START, "c", {"a": "1", "b": "0"})]
    row = monitor.monitor(spark.createDataFrame(rows, monitor.TIMED_REQUEST), MODEL, 0.5).first()
    assert (row.requests, row.valid, row.positive, sum(row.score_counts)) == (3, 2, 1, 2)
    assert [tuple(x) for x in row.inputs] == [("a", 3, -6.0, 86.0), ("b", 2, 0.0, 0.0)]
    empty = monitor.monitor(spark.createDataFrame([], monitor.TIMED_REQUEST), MODEL, 0.5)
    assert empty.collect() == []


def test_score_shift(spark):
    df = spark.createDataFrame([([10, 20, 70], [20, 20, 60], [0, 0, 0])], "r array<bigint>, c array<bigint>, z array<bigint>")
    row = df.select(monitor.score_shift(F.col("r"), F.col("c")).alias("x"), monitor.score_shift(F.col("r"), F.col("r")).alias("y"), monitor.score_shift(F.col("r"), F.col("z")).alias("z")).first()
    import math

    assert row.x == pytest.approx(0.1 * math.log(2) - 0.1 * math.log(6 / 7)) and row.y == 0 and row.z == 0


def test_batches_of_the_query_do_not_grow_with_the_files(spark, sf_dir, monkeypatch):
    queries, run, given = [], monitor.monitor_stream, analytics_catalog.requests
    monkeypatch.setattr(monitor, "monitor_stream", lambda *a, **b: queries.append(run(*a, **b)))
    monkeypatch.setattr(analytics_catalog, "requests", lambda *a: given(*a).repartition(6))
    rows = analytics_catalog.score_monitor(spark, sf_dir).collect()
    assert len(rows) == 20 and sum(r["requests"] for r in rows) == given(spark, sf_dir).count()
    assert sum(p["numInputRows"] > 0 for p in queries[0].recentProgress) <= 7
