"""Streams that are run to their end, against the batch form and a plain fold."""

import datetime as dt
import random

import pytest

from lodestrata.streaming import jobs as stream_jobs
from lodestrata.streaming.rate_limit import IDLE_SECONDS, admit, admit_stream

BEGIN = dt.datetime(2026, 1, 1)
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, STORE)
    yield spark
    spark.conf.set(key, old)


def run(spark, tmp_path, batches, schema, made):
    """Each batch is a file and a micro-batch; the stream ends when all are read."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in{k}")
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"in{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k:03}.parquet")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    query = made(source).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/check").trigger(availableNow=True).start()
    assert query.awaitTermination(200)
    state = query.lastProgress.stateOperators[0].numRowsTotal
    return spark.read.parquet(f"file://{tmp_path}/out").collect(), state


def test_the_bucket_of_a_stream_equals_the_batch(rocks, tmp_path):
    rng = random.Random(5)
    times, at = [], 0.0
    for _ in range(120):
        at += rng.choice([0, 1, 4, 15])
        times.append(at)
    rows = [(k, rng.choice("abc"), BEGIN + dt.timedelta(seconds=t)) for k, t in enumerate(times)]
    rows.append((500, "a", BEGIN + dt.timedelta(seconds=at + 2 * IDLE_SECONDS)))  # b and c are idle by then
    rows.append((501, "a", BEGIN + dt.timedelta(seconds=at + 2 * IDLE_SECONDS + 30)))
    schema = "request_id long, key string, at timestamp"
    got, state = run(rocks, tmp_path, [rows[:40], rows[40:80], rows[80:120], rows[120:121], rows[121:]], schema, lambda s: admit_stream(s, 6))
    want = admit(rocks.createDataFrame(rows, schema), 6).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and any(not r["allowed"] for r in want)
    assert state <= 3  # the state of a alone, with its timer


def test_jobs_move_on_end_and_fall_silent(rocks, tmp_path):
    event = lambda k, job, stage, status, s: (k, job, stage, status, BEGIN + dt.timedelta(seconds=s))
    batches = [
        [event(1, 1, "cloning", "running", 0), event(2, 1, "cloning", "completed", 5), event(3, 2, "cloning", "running", 1), event(4, 3, "parsing", "running", 2)],
        [event(5, 1, "scoring", "running", 20), event(6, 1, "parsing", "running", 21), event(7, 2, "analyzing", "failed", 22)],
        [event(8, 1, "completed", "completed", 40), event(9, 2, "scoring", "running", 41)],
        [event(10, 4, "cloning", "running", 500)], [event(11, 4, "parsing", "running", 540)],
    ]
    got, _ = run(rocks, tmp_path, batches, "event_id long, job_id long, stage string, status string, at timestamp", lambda s: stream_jobs.job_states(s, 100.0))
    of = lambda job: [(r["status"], r["current_stage"], r["progress"], r["message"]) for r in sorted(got, key=lambda r: r["at"]) if r["job_id"] == job]
    assert of(1) == [("cloning", "cloning", 10, None), ("parsing", "parsing", 80, None), ("completed", "parsing", 100, None)]
    assert sorted(of(2), key=str) == sorted([("cloning", "cloning", 10, None), ("failed", "analyzing", 10, "analyzing failed"), ("failed", "analyzing", 10, None)], key=str)
    assert of(3) == [("parsing", "parsing", 25, None), ("failed", "parsing", 25, "stale while parsing")]
    assert of(4)[0] == ("cloning", "cloning", 10, None) and of(4)[-1][0] == "parsing"
