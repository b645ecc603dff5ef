import pytest
from pyspark.sql import functions as F

from sheaf.functions.ranking import first_n, ranked
from sheaf.functions.skew import hot_keys, lookup
from sheaf.operators import groups, zset
from sheaf.schema import TOPICS
from sheaf.session import scratch
from sheaf.sources import log as logs


def test_queue_gives_back_what_was_put(spark):
    path = scratch(spark, "queue")
    item = '{"task_id": "abc", "url": "https://example.com"}'
    df = spark.createDataFrame([("q", item, 1), ("q", "later", 2), ("other", "x", 3)], "queue string, item string, seq long")
    logs.append_queue(logs.enqueue(df, F.col("queue"), F.col("item"), F.col("seq")), path)
    read = spark.read.parquet(path)
    assert [r["item"] for r in groups.dequeue(read.filter("queue = 'q'"), 1).collect()] == [item]
    assert groups.dequeue(read.filter("queue = 'empty'"), 1).count() == 0


@pytest.mark.parametrize("key, value, topic", [
    ("job1", "do something", TOPICS["API"]), ("", "v", TOPICS["HTML"]), (None, "", TOPICS["WEBDRIVER"])])
def test_produce(spark, key, value, topic):
    path = scratch(spark, "log")
    df = spark.createDataFrame([(topic, key, value, 0)], "topic string, k string, v string, o long")
    made = logs.entries(df, F.col("topic"), F.col("k"), F.col("v").cast("binary"), F.col("o"), F.current_timestamp())
    logs.produce(made, path)
    got = logs.read_log(spark, path, [topic]).first()
    assert (got.key is None) == (key is None) and bytes(got.value) == value.encode()


def test_bad_topic_is_refused(spark):
    df = spark.createDataFrame([("INVALID_TOPIC", 0)], "topic string, o long")
    made = logs.entries(df, F.col("topic"), F.lit("k"), F.lit(b"v"), F.col("o"), F.current_timestamp())
    with pytest.raises(Exception, match="unknown topic"):
        made.collect()


def test_unread_topics_are_pruned(spark, fx):
    path = scratch(spark, "log")
    made = logs.entries(fx.view("fx_stream"), F.col("channel"), F.lit(None).cast("string"), F.col("payload").cast("binary"),
                        F.col("msg_id"), F.col("ts"))
    logs.produce(made, path)
    read = groups.profile(logs.read_log(spark, path), "scrape-api", "topic")
    assert "PartitionFilters: [isnotnull(topic" in read._jdf.queryExecution().toString()


def test_cancel_only_counts_when_later(spark):
    rows = [("a", 1, False), ("a", 5, True), ("b", 2, True), ("b", 3, False), ("c", 1, False), ("c", 2, True), ("c", 3, False)]
    log = spark.createDataFrame(rows, "job_id string, seq long, tombstone boolean")
    live = {r.job_id for r in groups.live_tasks(log, F.col("tombstone")).collect()}
    tasks = groups.dedup_tasks(log.filter("not tombstone"))
    assert live == {r.job_id for r in groups.cancel(tasks, log.filter("tombstone")).collect()} == {"b"}


def test_stream_read_and_ack(spark):
    log = spark.createDataFrame([("test:stream", 1, "xyz")], "channel string, msg_id long, payload string")
    none = spark.createDataFrame([], "grp string, channel string, msg_id long")
    assert groups.read_group(log, none, "workers", 1).first().payload == "xyz"
    got = spark.createDataFrame([("workers", "test:stream", 1)], "grp string, channel string, msg_id long")
    assert groups.read_group(log, got, "workers", 1).count() == 0
    assert groups.pending(got, none).count() == 1 and groups.pending(got, got).count() == 0


def test_registering_twice_keeps_the_position(spark):
    one = spark.createDataFrame([("s", "workers", 7, 0)], "channel string, grp string, position long, created_seq long")
    two = one.withColumn("position", F.lit(0).cast("long")).withColumn("created_seq", F.lit(1).cast("long"))
    assert [r.position for r in groups.register_groups(one, two).collect()] == [7]


def test_reclaimed_entries_without_data_are_acked_only(spark):
    log = spark.createDataFrame([("c", 1, "x"), ("c", 2, None)], "channel string, msg_id long, payload string")
    waiting = spark.createDataFrame([("g", "c", i, "old", "2024-01-01 00:00:00") for i in (1, 2)],
                                    "grp string, channel string, msg_id long, consumer string, delivered_at string")
    now = F.lit("2024-01-01 00:01:00").cast("timestamp")
    claimed, acks, returned = groups.reclaim(waiting, log, "new", now)
    assert claimed.count() == acks.count() == 2
    assert [(r.msg_id, r.consumer) for r in returned.collect()] == [(1, "new")]
    assert groups.reclaim(waiting, log, "new", now, min_idle_seconds=61)[0].count() == 0


def skewed(spark, n=20_000):
    """One key with a third of all rows, the others small."""
    key = F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 500))
    return spark.range(n).select(key.alias("k"), F.xxhash64("id").alias("o"), F.col("id").alias("v"))


def test_distributed_rank_equals_a_window(spark):
    df = skewed(spark)
    w = groups.Window.partitionBy("k").orderBy("o")
    plain = df.withColumn("r", F.row_number().over(w).cast("long") - 1)
    placed = ranked(df, ["k"], [F.col("o")], "r", partitions=7)
    assert placed.select("k", "v", "r").exceptAll(plain.select("k", "v", "r")).count() == 0
    assert placed.count() == df.count()


def test_a_hot_key_is_cut_into_many_partitions(spark):
    df = skewed(spark).filter("k = 'hot'")
    placed = ranked(df, ["k"], [F.col("o")], "r", size_into="n", partitions=7)
    assert placed.agg(F.max("r"), F.countDistinct("r"), F.max("n")).first() == (df.count() - 1, df.count(), df.count())


def test_first_n_beyond_the_group_limit(spark):
    df = skewed(spark)
    many = first_n(df, ["k"], [F.col("o")], 2000)
    w = groups.Window.partitionBy("k").orderBy("o")
    plain = df.withColumn("r", F.row_number().over(w)).filter("r <= 2000").drop("r")
    assert many.exceptAll(plain).count() == 0 and many.count() == plain.count()


def test_lookup_of_a_hot_key(spark):
    df = skewed(spark)
    assert "hot" in hot_keys(df, "k") and len(hot_keys(df, "k")) < 1000
    right = df.select("k").distinct().filter("k <> 'k1'").withColumn("x", F.length("k"))
    salted = lookup(df, right, "k", spread_by="v", check_above=0)
    plain = df.join(right, "k", "left")
    assert salted.select(*plain.columns).exceptAll(plain).count() == 0 and salted.count() == plain.count()


def test_sorted_set(spark):
    member = '{"task_id": "abc", "result": "s3://bucket/result.json"}'
    one = spark.createDataFrame([("s", member, 100.0, 1)], "set_name string, member string, score double, seq long")
    assert [r.member for r in zset.zrange(zset.zadd(None, one)).collect()] == [member]
    two = spark.createDataFrame([("s", "old", 1.0, 1), ("s", "new", 2.0, 2), ("s", "old", 0.5, 3)], one.schema)
    got = zset.zrange(zset.zadd(zset.zadd(None, one), two), desc=True).orderBy("rank").collect()
    assert [r.member for r in got] == [member, "new", "old"] and got[2].score == 0.5
    left = zset.zremove(zset.zadd(None, one), one.select("set_name", "member"))
    assert left.count() == 0
    unscored = zset.zadd(None, one.withColumn("score", F.lit(None).cast("double"))).first()
    assert unscored.score > 1.7e9


@pytest.mark.parametrize("start, stop", [(0, -1), (0, 0), (2, 5), (-3, -1), (-3, -2), (5, -3), (-100, 2), (4, 2), (50, 60), (-1, -5)])
@pytest.mark.parametrize("desc", [False, True])
def test_ranges_equal_list_slices(spark, start, stop, desc):
    rows = [("s", f"m{i}", float(i % 4), i) for i in range(12)]
    df = spark.createDataFrame(rows, "set_name string, member string, score double, seq long")
    order = [m for _, m in sorted(((r[2], r[1]) for r in rows), reverse=desc)]
    low = max(start + 12, 0) if start < 0 else start
    high = stop + 12 if stop < 0 else stop
    got = zset.zrange(zset.zadd(None, df), start, stop, desc).orderBy("rank").collect()
    assert [r.member for r in got] == order[low:high + 1]
    assert [r["rank"] for r in got] == list(range(12))[low:high + 1]
