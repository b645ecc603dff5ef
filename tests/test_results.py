import random

import pytest
from pyspark.sql import functions as F

from sheaf.operators import changes, objects
from sheaf.operators.requests import latest_captures
from sheaf.plans import collect, results
from sheaf.plans.checks_results import task_log
from sheaf.schema import OBJECT
from sheaf.session import scratch
from sheaf.sources import log as logs
from sheaf.sources import commits, objectstore
from sheaf.streaming.collect import raw_objects, run_stream, settled_results
from sheaf.streaming.depth import change_stream


def test_ensure_table(spark):
    path = scratch(spark, "t")
    objectstore.ensure_table(spark, path, OBJECT)
    objectstore.ensure_table(spark, path, OBJECT)
    assert spark.read.schema(OBJECT).parquet(path).count() == 0
    with pytest.raises(Exception, match="already exists"):
        objectstore.ensure_table(spark, path, OBJECT, strict=True)


def test_puts_and_removals(spark):
    path = scratch(spark, "o")

    def put(*rows):
        objectstore.put_objects(spark, path, spark.createDataFrame(
            rows, "object_key string, content binary, content_type string, seq long"))

    def there():
        return {r.object_key: (bytes(r.content), r.content_type, r.length) for r in objectstore.live_objects(spark, path).collect()}

    assert there() == {}
    put(("anon/2024/01/01/a/data.json", b"1", "t", 1), ("anon/2024/01/02/b/data.json", b"2", "t", 1))
    put(("anon/2024/01/01/a/data.json", b"3", "t", 1), ("anon/2024/01/01/a/data.json", b"4", "u", 2), ("bare", b"5", "t", 1))
    all_three = {"anon/2024/01/01/a/data.json": (b"4", "u", 1), "anon/2024/01/02/b/data.json": (b"2", "t", 1), "bare": (b"5", "t", 1)}
    assert there() == all_three
    objectstore.remove_objects(spark, path, spark.createDataFrame([("bare",), ("never",)], "object_key string"))
    assert there() == {k: v for k, v in all_three.items() if k != "bare"}
    objectstore.compact_objects(spark, path)
    put(("bare", b"6", "t", 0))
    assert there() == {**all_three, "bare": (b"6", "t", 1)}


def test_of_two_foldings_one_is_made(spark):
    path, schema = scratch(spark, "o"), OBJECT
    objectstore.put_objects(spark, path, spark.createDataFrame([("a", b"1", "t", 1)], "object_key string, content binary, content_type string, seq long"))
    found = commits.live(spark, path)
    rows, names = commits.current(spark, path, schema, "object_key", ["seq"]), [c.name for c in found.commits]
    listed = lambda kept: kept.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min("object_key").alias("lo"))
    commits.fold(spark, path, rows.write, schema, listed, names, found.commits[-1].at)
    with pytest.raises(RuntimeError, match="another folding"):
        commits.fold(spark, path, rows.write, schema, listed, names, found.commits[-1].at)
    assert objectstore.live_objects(spark, path).count() == 1


def test_preview(spark):
    rows = [("a", "é".encode() * 300), ("b", b"a" + "é".encode() * 300), ("c", b""), ("d", b"\xff\x00")]
    got = {r.object_key: r.preview for r in objects.preview(spark.createDataFrame(rows, "object_key string, content binary")).collect()}
    assert got["a"] == "é" * 250 and got["c"] == "" and got["d"] == "FF00"
    assert got["b"] == (b"a" + "é".encode() * 300)[:500].hex().upper()


def test_missing_objects_are_empty(spark):
    there = spark.createDataFrame([("a", b"1")], "object_key string, content binary")
    asked = spark.createDataFrame([("a",), ("b",), ("a",)], "object_key string")
    assert {r.object_key: bytes(r.content) for r in objects.get_objects(asked, there).collect()} == {"a": b"1", "b": b""}


def test_files_as_objects(spark):
    path = scratch(spark, "f")
    spark.range(3).write.json(f"{path}/a/b")
    names = objectstore.read_files(spark, path, with_content=False)
    assert names.filter("path like '%json'").count() >= 1 and "content" not in names.columns


def test_poll(spark):
    done = spark.createDataFrame([("a", "k/a", 1.0), ("b", "k/b", 1.0)], "job_id string, object_key string, score double")
    stored = spark.createDataFrame([("k/a", b"x")], "object_key string, content binary")
    asked = spark.createDataFrame([("a",), ("b",), ("c",), ("a",)], "job_id string")
    got = {r.job_id: (r.available, r.message, r.content and bytes(r.content)) for r in results.poll(asked, done, stored).collect()}
    assert got == {"a": (True, None, b"x"), "b": (True, None, None), "c": (False, "Results not yet available", None)}


def fold(base, log, next_id):
    """The changes one by one."""
    table, status = dict(base), {}
    for seq, op, i, name, text, price in log:
        if op == "POST":
            table[next_id] = (name, text or "", price)
            status[seq] = (next_id, 201)
            next_id += 1
            continue
        status[seq] = (i, 200 if i in table else 404)
        if i not in table:
            continue
        if op == "DELETE":
            del table[i]
        elif op == "PUT":
            table[i] = (name, text or "", price)
        else:
            table[i] = (name, table[i][1] if text is None else text, price)
    return table, status


CHANGE = "seq long, op string, id long, name string, description string, price double"


def random_log(rng, n, start=0):
    ops = ["POST", "PUT", "PUT", "PATCH", "PATCH", "DELETE"]
    return [(start + s, rng.choice(ops), 3 if rng.random() < 0.3 else rng.randrange(0, 40), f"n{start + s}",
             rng.choice([None, f"d{start + s}"]), float(s)) for s in range(n)]


@pytest.mark.parametrize("seed", range(4))
def test_changes_equal_a_fold_and_go_in_halves(spark, seed):
    rng = random.Random(seed)
    base = {i: (f"b{i}", "x", 0.0) for i in range(10) if i != 7}
    log = random_log(rng, 120)
    rows = spark.createDataFrame([(i, *v) for i, v in base.items()], "id long, name string, description string, price double")
    table, statuses = changes.apply_changes(rows, spark.createDataFrame(log, CHANGE))
    want, status = fold(base, log, 10)
    assert {r.id: (r.name, r.description, r.price) for r in table.collect()} == want
    assert {r.seq: (r.id, r.status) for r in statuses.collect()} == status
    first, _ = changes.apply_changes(rows, spark.createDataFrame(log[:60], CHANGE))
    made = sum(c[1] == "POST" for c in log[:60])
    second, _ = changes.apply_changes(first, spark.createDataFrame(log[60:], CHANGE), next_id=10 + made)
    assert {r.id: (r.name, r.description, r.price) for r in second.collect()} == want


def test_ids_start_at_zero(spark):
    empty = spark.createDataFrame([], "id long, name string, description string, price double")
    posts = spark.createDataFrame([(5, "POST", None, "a", None, 1.0), (9, "POST", None, "b", "d", 2.0)], CHANGE)
    table, statuses = changes.apply_changes(empty, posts)
    assert sorted((r.id, r.name, r.description) for r in table.collect()) == [(0, "a", ""), (1, "b", "d")]
    assert {r.status for r in statuses.collect()} == {201}
    got = changes.get_items(table, spark.createDataFrame([(1,), (4,)], "id long"))
    assert {r.id: r.status for r in got.collect()} == {1: 200, 4: 404}


def test_rejected_entries_are_kept_apart(spark):
    rows = [("scrape.input.api", "k", b"some_message_bytes", 0, 1, "2024-01-01"), ("scrape.input.api", "k", None, 0, 2, "2024-01-01")]
    log = spark.createDataFrame(rows, "topic string, key string, value binary, partition int, offset long, timestamp string").withColumn(
        "key", F.col("key").cast("binary")).withColumn("timestamp", F.col("timestamp").cast("timestamp"))
    tasks, rejected = collect.tasks_of(log, "scrape-all")
    assert tasks.count() == 0 and [r.offset for r in rejected.collect()] == [1]


def test_stream_equals_batch_and_a_second_run_adds_nothing(spark, fx):
    path = scratch(spark, "stream")
    whole = task_log(fx)
    half = whole.agg(F.expr("percentile_approx(offset, 0.5)")).first()[0]
    latest_captures(fx.table("pages")).write.parquet(f"{path}/captures")
    pages = spark.read.parquet(f"{path}/captures")

    def run():
        run_stream(spark, f"{path}/log", pages, f"{path}/out", "30 days", available_now=True)
        return spark.read.parquet(f"{path}/out/records")

    logs.produce(whole.filter(F.col("offset") <= half), f"{path}/log")
    assert 0 < run().count()
    logs.produce(whole.filter(F.col("offset") > half), f"{path}/log")
    records = run()
    once = records.count()
    assert run().count() == once == records.select("job_id").distinct().count()
    fields = ["job_id", "url", "scrape_type", "object_key", *collect.PAGE_RECORD]
    live = settled_results(records, logs.read_log(spark, f"{path}/log")).select(*fields)
    made = collect.run_batch(whole, fx.table("pages"))
    batch = made.outcomes.filter("outcome = 'ok'").select(*fields)
    assert live.exceptAll(batch).count() == 0 and batch.exceptAll(live).count() == 0
    assert spark.read.parquet(f"{path}/out/pages").count() == pages.count()
    stored = settled_results(spark.read.parquet(f"{path}/out/raw"), logs.read_log(spark, f"{path}/log"))
    got, there = (x.select("object_key", F.md5("content").alias("digest")) for x in (raw_objects(stored, pages), made.objects))
    assert got.exceptAll(there).count() == 0 and there.exceptAll(got).count() == 0


def test_streamed_queue_changes(spark, fx):
    path = scratch(spark, "depth")
    log = fx.view("fx_stream").select("channel", F.col("ts").cast("timestamp").alias("ts"))
    log.repartition(3).write.parquet(f"{path}/log")
    log.filter("channel = 'scrape.input.api'").withColumnRenamed("ts", "acked_at").write.parquet(f"{path}/acks")

    def read(kind, name):
        return spark.readStream.schema(f"channel string, {name} timestamp").parquet(f"{path}/{kind}")

    made = change_stream(read("log", "ts"), read("acks", "acked_at"), "1 hour")
    made.writeStream.format("parquet").option("checkpointLocation", f"{path}/c").trigger(availableNow=True).start(
        f"{path}/out").awaitTermination()
    got = spark.read.parquet(f"{path}/out").groupBy("channel").agg(F.sum("change").alias("n"), F.max("window_start").alias("w"))
    by = {r.channel: r.n for r in got.collect()}
    assert by["scrape.input.api"] == 0 and by["scrape.input.browser.html"] > 0
