"""Plans that must hold at scale, with automatic broadcasts off so that only checked hints count."""

import os

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sheaf.functions import ranking
from sheaf.operators import extract, groups, html, objects, requests, zset
from sheaf.plans import collect, items, results
from sheaf.plans.catalog import QUERIES
from sheaf.plans.checks_results import _store, task_log
from sheaf.session import few_rows, row_bytes, scratch
from sheaf.sources import log as logs
from sheaf.sources import commits, objectstore
from sheaf.streaming.collect import raw_results


@pytest.fixture(autouse=True)
def no_automatic_broadcast(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def above_scan(text, column):
    """Whether rows with the column go through an exchange by hash."""
    return [line for line in text.split("\n") if "Exchange hash" in line and column in line]


def test_records_need_no_shuffle(fx):
    text = plan(extract.extract_records(html.parse_html(fx.table("pages")), collect.PAGE_RECORD))
    assert "Exchange hash" not in text and text.count("ArrowEvalPython") == 1
    assert "ReadSchema: struct<page_id:bigint,html:string>" in text


def test_element_text_needs_no_shuffle(fx):
    assert "Exchange hash" not in plan(html.find_all(html.parse_html(fx.table("pages")), "p"))


def test_a_chain_is_one_shuffle(fx):
    assert plan(html.select(html.parse_html(fx.table("pages")), "nav li a")).count("Exchange hash") == 1


def test_first_n_is_cut_per_task(fx):
    text = plan(zset.zrange(zset.zadd(None, fx.view("fx_scores")), 0, 9))
    assert text.count("WindowGroupLimit") == 2


def test_poll_moves_no_contents(fx):
    text = plan(results.poll(fx.view("fx_tasks"), fx.view("fx_completions"), fx.objects()))
    assert not above_scan(text, "object_key") and "BroadcastHashJoin" in text


def test_get_moves_no_contents(fx):
    there = fx.objects()
    text = plan(objects.get_objects(there.select("object_key"), there.withColumn("object_key", F.concat("object_key", F.lit("")))))
    assert "BroadcastHashJoin" in text


def test_group_reads_fetch_payloads_by_broadcast_ids(fx):
    log = fx.view("fx_stream")
    text = plan(groups.read_group(log, fx.view("fx_deliveries"), "scrape-all", 3))
    assert "BroadcastHashJoin" in text and "Exchange hash" not in text


def test_picked_rows_are_bounded_in_the_scan(spark, fx, tmp_path):
    fx.view("fx_stream").write.partitionBy("channel").parquet(f"{tmp_path}/log")
    log = spark.read.parquet(f"{tmp_path}/log")
    text = groups.dequeue(log, 3, "channel", "msg_id")._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    scan = [line for line in text.split("\n") if "PushedFilters" in line and "msg_id" in line]
    folders = [line for line in text.split("\n") if "PartitionFilters" in line and "channel" in line]
    assert any("GreaterThanOrEqual(msg_id" in line for line in scan) and folders


def test_bounds_of_picked_rows(spark):
    rows = spark.createDataFrame([(None, 1), ("a", 5), ("a", 9), ("b", 2)], "k string, n long")
    assert rows.filter(ranking.bounds(rows, "k", "n")).count() == 4
    assert rows.filter(ranking.bounds(rows.filter("k = 'a'"), "k", "n")).count() == 2
    assert rows.filter(ranking.bounds(rows.limit(0), "k", "n")).count() == 0
    many = spark.range(300).select(F.col("id").cast("string").alias("k"), F.col("id").alias("n"))
    assert many.filter(ranking.bounds(many.filter("n >= 100"), "k", "n")).count() == 200


def test_upserts_combine_before_the_shuffle(fx):
    text = plan(groups.live_tasks(fx.view("fx_log"), F.col("tombstone")))
    assert "partial_min_by" in text and text.count("Exchange hash") == 1
    assert "partial_max_by" in plan(zset.zadd(None, fx.view("fx_scores")))


def test_large_sides_are_not_broadcast(spark):
    assert "Broadcast" not in plan(spark.range(10).join(few_rows(spark.range(300_000)), "id"))


WRITERS = (
    "collect_stream", "collect_late", "collect_catch_up", "dedup_streamed", "put_objects", "removed_objects", "results", "results_twice",
    "store_get", "store_list", "store_poll", "store_late_write", "store_compacted", "store_grown", "store_two_writers", "results_moved_day", "zrange_stored", "zrange_stored_desc",
    "stream_retries", "depth_stream", "dedup_late", "collect_two_streams",
    "items_all", "items_incremental", "items_incremental_status", "items_get_stored", "log_from_offsets", "collect_from", "search_kept")


@pytest.fixture(scope="module")
def store(spark, fx):
    return _store(fx)


OBJECTS = "object_key string, content binary, content_type string, seq long"


def files_below(path):
    return {os.path.relpath(os.path.join(d, f), path) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet") and "_ranges" not in d}


@pytest.fixture(scope="module")
def folded(spark):
    """A store of 4000 objects in several files sorted by key, and a later put of two."""
    path = scratch(spark, "objects")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    objectstore.put_objects(spark, path, spark.range(4000).selectExpr(
        "format_string('k%05d', id) as object_key", "cast(repeat(cast(id as string), 50) as binary) as content", "'t' as content_type", "0L as seq"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    objectstore.compact_objects(spark, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    objectstore.put_objects(spark, path, spark.createDataFrame([("k00007", b"new", "t", 1), ("other", b"x", "t", 1)], OBJECTS))
    return path


def test_a_put_writes_its_own_rows_alone(spark, folded):
    before = {f: os.stat(os.path.join(folded, f)).st_mtime_ns for f in files_below(folded)}
    row = spark.createDataFrame([("k00001", b"y", "t", 3)], OBJECTS).coalesce(1)
    objectstore.put_objects(spark, folded, row)
    after = {f: os.stat(os.path.join(folded, f)).st_mtime_ns for f in files_below(folded)}
    assert before.items() <= after.items() and len(after) == len(before) + 1
    source = plan(row)
    assert "Exchange" not in source
    objectstore.remove_objects(spark, folded, row)
    objectstore.put_objects(spark, folded, row)


def test_a_get_opens_only_files_that_may_hold_its_keys(spark, folded):
    found = commits.live(spark, folded)
    ranges = {r["file"]: (r["lo"], r["hi"]) for r in commits.key_ranges(spark, folded, found, objectstore.OBJECT, "object_key").collect()}
    assert len(ranges) > 2
    keys = ["k00007", "k00009", "k00010", "none"]
    may = {f for f, (lo, hi) in ranges.items() if any(lo <= k <= hi for k in keys)}
    assert may and len(may) < len(ranges)
    asked = spark.createDataFrame([(k,) for k in keys], "object_key string")
    opened = {"/".join(f.split("/")[-2:]) for f in objectstore.stored_of(spark, folded, asked).inputFiles()}
    assert {f for f in opened if f in ranges} == may
    got = {r["object_key"]: bytes(r["content"]) for r in objectstore.get_stored(spark, folded, asked).collect()}
    assert got == {"k00007": b"new", "k00009": b"9" * 50, "k00010": b"10" * 50, "none": b""}
    assert "PushedFilters: [In(object_key" in plan(objectstore.stored_of(spark, folded, asked))


def test_many_keys_and_few_give_the_same(spark, folded, monkeypatch):
    asked = spark.range(0, 4200, 70).selectExpr("format_string('k%05d', id) as object_key")
    few = {tuple(r) for r in objectstore.get_stored(spark, folded, asked).collect()}
    monkeypatch.setattr(commits, "MOST_LISTED", 3)
    assert few == {tuple(r) for r in objectstore.get_stored(spark, folded, asked).collect()}


def test_folding_rewrites_only_files_with_changed_keys(spark, folded):
    before = commits.live(spark, folded)
    ranges = {r["file"]: (r["lo"], r["hi"]) for r in commits.key_ranges(spark, folded, before, objectstore.OBJECT, "object_key").collect()}
    objectstore.compact_objects(spark, folded)
    after = commits.live(spark, folded)
    kept = {r["file"] for r in commits.key_ranges(spark, folded, after, objectstore.OBJECT, "object_key").collect()}
    changed = {f for f, (lo, hi) in ranges.items() if any(lo <= k <= hi for k in ("k00001", "k00007"))}
    assert set(ranges) - kept == changed and not after.of(commits.PUT) and not after.of(commits.REMOVAL)
    n = objectstore.live_objects(spark, folded).select("object_key")
    assert n.count() == n.distinct().count() == 4001
    assert commits.compact(spark, folded, objectstore.OBJECT, "object_key", ["seq"]) is None
    gone = commits.vacuum(spark, folded, older_than=0)
    assert gone and commits.vacuum(spark, folded, older_than=0) == [] and objectstore.live_objects(spark, folded).count() == 4001


def test_a_listing_reads_no_contents(spark, store):
    text = plan(objectstore.list_stored(spark, store, "team/"))
    assert "content:binary" not in text and "StringStartsWith(object_key,team/)" in text


def test_captures_are_not_sorted_or_shuffled_with_their_contents(fx):
    text = plan(requests.latest_captures(fx.table("pages"), fx.tasks()))
    assert "max_by" not in text and not [line for line in text.split("\n") if "Exchange" in line and "html" in line]


def test_no_stream_carries_html(spark, fx, tmp_path):
    logs.produce(task_log(fx), f"{tmp_path}/log")
    jobs = raw_results(spark, f"{tmp_path}/log", fx.table("pages"), "1 day")
    text = jobs._jdf.queryExecution().analyzed().toString()
    assert "Join LeftOuter" in text
    assert all("Relation" in line for line in text.split("\n") if "html#" in line)


def test_counting_for_a_broadcast_moves_one_row_per_task(spark):
    df = spark.range(1000)
    text = plan(df.agg(F.count("*"), F.sum(row_bytes(df))))
    assert "partial_count" in text and "Limit" not in text


def test_latest_position_leaves_the_log_where_it_is(fx):
    at = fx.view("fx_stream").groupBy("channel").agg(F.max("msg_id").alias("position"))
    text = plan(groups.start_at(fx.view("fx_stream"), "latest", at))
    assert not [line for line in text.split("\n") if "Exchange hash" in line and "payload" in line]


@pytest.mark.parametrize("name", list(QUERIES))
def test_no_query_uses_a_cross_join_or_one_partition(spark, name):
    if name in WRITERS:
        pytest.skip("writes tables; its parts are covered by others")
    text = plan(QUERIES[name](spark, DATA))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition"):
        assert bad not in text


def test_applying_changes_leaves_the_stored_table_where_it_is(spark):
    path = scratch(spark, "items")
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    items.store_items(spark.range(4000).selectExpr("id", "concat('n', id) as name", "'' as description", "1.0 as price"), path)
    items.compact_items(spark, path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    before = files_below(path)
    ids = spark.createDataFrame([(5,), (9,), (9999,)], "id long")
    picked = commits.picked(spark, path, items.ITEM, "id", [], ids)
    assert "Exchange" not in plan(picked) and 1 <= len(picked.inputFiles()) < len(before)
    changes_ = spark.createDataFrame([(1, 5, "DELETE", None, None, None), (2, 9, "PATCH", "new", None, 2.0), (3, None, "POST", "made", None, 3.0)],
                                     "seq long, id long, op string, name string, description string, price double")
    told = {(r["seq"], r["id"], r["status"]) for r in items.apply_stored(spark, path, changes_, 4000).collect()}
    assert told == {(1, 5, 200), (2, 9, 200), (3, 4000, 201)} and before <= files_below(path)
    got = {r["id"]: (r["name"], r["price"]) for r in items.stored_items(spark, path).filter("id in (4, 5, 9, 4000)").collect()}
    assert got == {4: ("n4", 1.0), 9: ("new", 2.0), 4000: ("made", 3.0)}


def test_only_entries_behind_the_positions_are_read(spark, fx, tmp_path):
    logs.produce(task_log(fx), f"{tmp_path}/log")
    text = plan(logs.read_log(spark, f"{tmp_path}/log", after={"scrape.input.api": {0: 10}}))
    assert "GreaterThan(offset,10)" in text


def test_kept_tasks_are_not_decoded_again(spark, fx):
    kept = zset.with_tasks(spark.createDataFrame([(b"x", 1)], "member binary, score long"))
    assert "ArrowEval" in plan(kept)
    again = spark.createDataFrame(kept.collect(), kept.schema)
    assert "ArrowEval" not in plan(zset.search(again, fx.tasks()))


def test_contents_of_very_many_captures_are_moved_once(spark, fx, monkeypatch):
    monkeypatch.setattr("sheaf.session.FEW_ROWS", 0)
    text = plan(requests.fetch_captured(fx.tasks().drop("page_id"), fx.table("pages")))
    moved = [line for line in text.split("\n") if "Exchange" in line]
    assert "Broadcast" not in text and moved
    scans = [line for line in text.split("\n") if "FileScan" in line and "html:string" in line]
    assert len(scans) == 1
