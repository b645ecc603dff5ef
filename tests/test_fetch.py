import pytest
from pyspark.sql import functions as F

from sheaf.operators import attempts, requests
from sheaf.schema import TASK
from sheaf.session import scratch
from sheaf.streaming.attempts import resolve_stream


def tasks(spark, *rows):
    full = [(j, u, m, {}, p, "") for j, u, m, p in rows]
    return requests.build_requests(spark.createDataFrame(full, TASK))


def test_params_go_before_the_fragment(spark):
    got = {r.job_id: r for r in tasks(
        spark, ("a", "http://h/p", "get", {"b": "2", "a": "x y&"}), ("b", "http://h/p?q=1#f", "", {"a": "1"}),
        ("c", "http://h/p#f?", "HEAD", {"a": "1"}), ("d", "http://h/p", "PUT", {"a": "1"}), ("e", "http://h", "TRACE", {}),
        ("f", "http://h/p?", "options", {"a": "1"}), ("g", "http://h/p#f", "GET", {})).collect()}
    assert got["a"].request_url == "http://h/p?a=x+y%26&b=2" and got["a"].http_method == "GET"
    assert got["b"].request_url == "http://h/p?q=1&a=1#f"
    assert got["c"].request_url == "http://h/p?a=1#f?"
    assert got["d"].request_url == "http://h/p" and got["d"].request_body == ""
    assert got["e"].request_url is None and got["e"].request_error == "Unsupported HTTP method."
    assert got["f"].request_url == "http://h/p?a=1"
    assert got["g"].request_url == "http://h/p#f"


def test_attempts_and_a_second_run(spark):
    def session():
        def send(request, timeout):
            assert timeout == 10
            if "down" in request["request_url"]:
                raise ConnectionError
            return (404, b"") if "gone" in request["request_url"] else (200, b"ok")

        return send

    asked = tasks(spark, ("a", "http://h/a", "GET", {}), ("b", "http://h/down", "GET", {}), ("c", "http://h/gone", "GET", {}),
                  ("d", "http://h", "TRACE", {}))
    made = requests.fetch(asked, session, wait=0)
    rows = made.collect()
    assert sorted((r.job_id, r.attempt) for r in rows) == [("a", 1)] + [(j, n) for j in "bc" for n in (1, 2, 3)]
    again = requests.fetch(asked, session, attempts_so_far=spark.createDataFrame(rows, made.schema), wait=0)
    assert again.count() == 0
    resolved = attempts.resolve_attempts(attempts.classify(spark.createDataFrame(rows, made.schema)), "job_id", "attempt")
    assert {r.job_id: (r.state, r.outcome) for r in resolved.collect()} == {
        "a": ("done", "ok"), "b": ("failed", "transport_error"), "c": ("failed", "http_error")}


def test_only_the_first_three_attempts_count(spark):
    rows = [("a", i, 200 if i == 4 else 503) for i in range(1, 6)] + [("b", 1, 503), ("c", 1, None), ("c", 2, 200)]
    df = attempts.classify(spark.createDataFrame(rows, "job string, attempt int, status int"))
    got = {r.job: (r.state, r.attempt) for r in attempts.resolve_attempts(df, "job", "attempt").collect()}
    assert got == {"a": ("failed", 3), "b": ("open", 1), "c": ("done", 2)}


def test_retries_wait_two_seconds(spark):
    df = spark.createDataFrame([("a", "2024-01-01 00:00:00", 503), ("b", "2024-01-01 00:00:09", None), ("c", "2024-01-01", 200)],
                               "job string, at string, status int").withColumn("at", F.col("at").cast("timestamp"))
    seen = attempts.classify(df)
    due = attempts.due_retries(seen, "job", "at", F.lit("2024-01-01 00:00:10").cast("timestamp"))
    assert [(r.job, str(r.due_at)) for r in due.collect()] == [("a", "2024-01-01 00:00:02")]


def test_on_error(spark):
    df = spark.createDataFrame([("x", None), ("y", "boom")], "result string, error string")
    assert [r.result for r in requests.on_error(df, "result", "error", "null").collect()] == ["x", None]
    with pytest.raises(Exception, match="boom"):
        requests.on_error(df, "result", "error", "raise").collect()


def test_streamed_outcomes_equal_the_batch(spark):
    rows = [("a", 1, 503, 0), ("a", 2, 200, 4), ("b", 1, None, 0), ("b", 2, 404, 12), ("b", 3, 503, 24), ("b", 4, 200, 30),
            ("c", 1, 503, 3), ("d", 1, 200, 9)]
    df = spark.createDataFrame(rows, "job string, attempt int, status int, at int").withColumn(
        "at", F.timestamp_seconds(F.col("at") + 1704067200))
    late = df.filter("job = 'd'").withColumn("job", F.lit("later")).withColumn("at", F.col("at") + F.expr("interval 1 day"))
    path = scratch(spark, "attempts")
    df.repartition(2).write.parquet(f"{path}/log")
    late.write.mode("append").parquet(f"{path}/log")
    read = spark.readStream.schema(df.schema).parquet(f"{path}/log")
    made = resolve_stream(attempts.classify(read), "job", "attempt", "at", "1 minute", "1 minute")
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(
        f"{path}/out").awaitTermination()
    cols = ["job", "state", "outcome", "status"]
    batch = attempts.resolve_attempts(attempts.classify(df), "job", "attempt").select(*cols)
    got = spark.read.parquet(f"{path}/out").select(*cols)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
