"""Retries of a stream: Python is called per bucket of jobs, and each job comes out as if it were alone."""

import pytest
from pyspark.sql import functions as F

from sheaf.operators.attempts import classify
from sheaf.streaming.attempts import retry_stream

HOUR = 3600


def run(spark, path, parts, key_type="string", **options):
    """What is said of attempts (job, number, second, status), given in parts, one run for each."""
    schema = f"job {key_type}, number long, at timestamp, status int"
    for rows in parts:
        made = spark.createDataFrame(rows, f"job {key_type}, number long, s long, status int")
        made.select("job", "number", F.timestamp_seconds("s").alias("at"), "status").coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = retry_stream(classify(spark.readStream.schema(schema).parquet(f"{path}/in")), "job", "number", "at", "1 hour", **options)
        stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start(f"{path}/out").awaitTermination()
    out = spark.read.parquet(f"{path}/out").select("job", "state", "attempts", "outcome", "status", F.unix_seconds("last_at"), F.unix_seconds("due_at"))
    return sorted((tuple(r) for r in out.collect()), key=repr)


def clock(spark_job, at):
    return (spark_job, 0, at, 200)


def test_jobs_of_one_bucket(spark, tmp_path):
    """A job closed by ok is not opened by a later attempt, a due one goes on, and a failed one fails once, all in one bucket."""
    first = [("ok", 1, 10, 200), ("due", 1, 20, 500), ("bad", 1, 30, 500), ("bad", 2, 40, None), ("bad", 3, 50, 404), (None, 1, 60, 500), clock("z", 10 * HOUR)]
    later = [("ok", 2, 20 * HOUR, 500), ("due", 2, 20 * HOUR, 200), ("bad", 4, 20 * HOUR, 200), clock("z", 40 * HOUR)]
    said = run(spark, str(tmp_path), [first, later, [clock("y", 60 * HOUR)]], buckets=1)
    by_job = {}
    for job, *rest in said:
        by_job.setdefault(job, []).append(tuple(rest))
    assert by_job["ok"] == [("done", 1, "ok", 200, 10, None)]
    assert by_job["bad"] == [("failed", 3, "http_error", 404, 50, None)]
    assert [r[:5] for r in by_job["due"]] == [("done", 2, "ok", 200, 20 * HOUR), ("due", 1, "http_error", 500, 20)]
    assert [r[:2] for r in by_job[None]] == [("due", 1)]


@pytest.mark.parametrize(("key_type", "key"), [("long", 2**60 + 1), ("binary", bytes([255, 0, 7]))])
def test_keys_keep_their_type(spark, tmp_path, key_type, key):
    end = (2 if key_type == "long" else b"z", 0, 50 * HOUR, 200)
    said = run(spark, str(tmp_path), [[(key, 1, 10, 200)], [end]], key_type)
    assert [bytes(r[0]) if key_type == "binary" else r[0] for r in said] == [key]


def test_calls_do_not_grow_with_jobs(spark):
    """The groups that Python is called for are the buckets: as many of them for a hundred times the jobs."""
    stream = spark.readStream.format("rate").load().select(
        F.col("value").cast("string").alias("job"), F.lit(1).alias("number"), F.col("timestamp").alias("at"), F.lit(500).alias("status"))
    plan = retry_stream(classify(stream), "job", "number", "at", "1 hour")._jdf.queryExecution().analyzed().toString()
    assert "TransformWithStateInPySpark" in plan and "bucket" in plan and "MapGroups" not in plan
