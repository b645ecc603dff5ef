"""The same way continuously: file log to outcomes to records, exactly once per job.

Streaming queries, each with its own checkpoint and a Parquet sink. The sink's own log
makes a repeated micro-batch harmless, and the second query reads the first one's sink. Pages are parsed once, ahead
of the streams, and only their ids and records meet the jobs: no stream carries HTML.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.skew import CHECK_ABOVE_BYTES, lookup
from sheaf.operators.attempts import OK, TRANSPORT_ERROR
from sheaf.operators.codec import decode
from sheaf.operators.extract import Field, extract_pages
from sheaf.operators.groups import profile_channels
from sheaf.operators.objects import object_keys
from sheaf.plans.collect import PAGE_RECORD, WIDER, log_order, with_requests
from sheaf.session import few_rows, settled_ids
from sheaf.sources.log import read_log
from sheaf.sources.objectstore import ensure_table

RAW = ("job_id string, topic string, partition int, offset long, timestamp timestamp, scrape_type string, url string, "
       "outcome string, object_key string, page_id long")


def dedup_stream(tasks: DataFrame, at: str, delay: str | None, key: str = "job_id") -> DataFrame:
    """First copy of each job. Without a ``delay`` it is exact: all ids stay in the state store, on disk and behind Bloom filters with RocksDB
    (``session.tune`` sets it), however late a copy comes. With one, state is kept for ``delay`` of event time, which must cover the
    longest redelivery; copies later than that are dropped and counted by the query's metrics."""
    if delay is None:
        return tasks.dropDuplicates([key])
    return tasks.withWatermark(at, delay).dropDuplicatesWithinWatermark([key])


def raw_results(spark: SparkSession, log_path: str, pages: DataFrame, delay: str, name: str = "scrape-all") -> DataFrame:
    """Streaming raw results of a profile, one row per job with its outcome. ``pages`` is static, one row per URL.

    A job with an unsupported method or without a captured page gets its outcome without a result; ``catch_up``
    takes such jobs up again.

    Cancels are not looked at here: a tombstone may come after its task was done. They count
    when results are read, by ``settled_results``. Every micro-batch is joined to the urls and ids of all
    ``pages``, so a large table of captures calls for long triggers; ``raw_objects`` brings contents in.
    """
    topics = profile_channels(name)
    read = decode(read_log(spark, log_path, topics, stream=True).filter(F.col("value").isNotNull()))
    tasks = dedup_stream(read.filter(F.col("error").isNull()).drop("cancel", "error"), "timestamp", delay)
    found = with_requests(tasks).join(pages.select("url", F.col("page_id").cast("long").alias("page_id")), "url", "left")
    outcome = (F.when(F.col("request_error").isNotNull(), F.col("request_error"))
               .when(F.col("page_id").isNull(), TRANSPORT_ERROR).otherwise(OK))
    keyed = object_keys(found.withColumn("outcome", outcome), "timestamp", filename="data.html")
    done = F.col("outcome") == OK
    return keyed.select(
        "job_id", "topic", "partition", "offset", "timestamp", "scrape_type", "url", "outcome",
        F.when(done, F.col("object_key")).alias("object_key"), F.when(done, F.col("page_id")).alias("page_id"))


CAPTURE = "page_id long, url string, html string, captured_at timestamp"
RAW_CAPTURED = RAW + ", captured_at timestamp"


def captured_results(spark: SparkSession, log_path: str, captures: DataFrame, delay: str, before: str, after: str, name: str = "scrape-all") -> DataFrame:
    """Streaming raw results from two streams: a profile's tasks, and captures (page_id, url, captured_at) as they are made.

    A task meets the captures of its url made up to ``before`` ahead of it and ``after`` behind it, so state is bounded to these times and
    ``delay``. One that comes later completes its job; a job without any gets a transport error once the time is over. A job with several
    captures has a row for each: ``latest_results`` keeps the latest.
    """
    read = decode(read_log(spark, log_path, profile_channels(name), stream=True).filter(F.col("value").isNotNull()))
    # at last the event time, and the watermark with it, is what the first copy of a job has
    tasks = dedup_stream(read.filter(F.col("error").isNull()).drop("cancel", "error").withWatermark("timestamp", delay), "timestamp", None)
    made = captures.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("captured_url"), F.col("captured_at")).withWatermark("captured_at", delay)
    near = F.expr(f"url = captured_url and request_error is null and captured_at >= timestamp - interval {before} and captured_at <= timestamp + interval {after}")
    found = with_requests(tasks).join(made, near, "leftOuter")
    outcome = (F.when(F.col("request_error").isNotNull(), F.col("request_error"))
               .when(F.col("page_id").isNull(), TRANSPORT_ERROR).otherwise(OK))
    keyed = object_keys(found.withColumn("outcome", outcome), "timestamp", filename="data.html")
    done = F.col("outcome") == OK
    return keyed.select(
        "job_id", "topic", "partition", "offset", "timestamp", "scrape_type", "url", "outcome",
        F.when(done, F.col("object_key")).alias("object_key"), "page_id", "captured_at")


def latest_results(raw: DataFrame) -> DataFrame:
    """One row per job: that of the latest capture."""
    rest = [c for c in raw.columns if c != "job_id"]
    latest = F.struct(F.col("captured_at").isNotNull(), "captured_at", "page_id")
    return raw.groupBy("job_id").agg(F.max_by(F.struct(*rest), latest).alias("row")).select("job_id", "row.*")


def run_two_streams(spark: SparkSession, log_path: str, captures_path: str, out: str, delay: str, before: str, after: str,
                    name: str = "scrape-all", spec: dict[str, Field] = PAGE_RECORD, available_now: bool = False) -> list:
    """Starts the queries for raw results (``raw``), rejected entries and the records of captured pages (``pages``, each capture parsed once)
    over a log and a folder of captures that both grow."""
    captures = spark.readStream.schema(CAPTURE).parquet(captures_path)
    parsed = extract_pages(captures, spec, keep=("captured_at",))

    def start(df: DataFrame, kind: str):
        writer = df.writeStream.format("parquet").option("checkpointLocation", f"{out}/_checkpoints/{kind}")
        writer = writer.trigger(availableNow=True) if available_now else writer
        return writer.queryName(f"{name}-captured-{kind}").start(f"{out}/{kind}")

    started = [start(captured_results(spark, log_path, captures, delay, before, after, name), "raw"),
               start(parsed, "pages"), start(rejected_entries(spark, log_path, name), "rejected")]
    for query in started if available_now else ():
        query.awaitTermination()
    return started


def captured_records(raw: DataFrame, parsed: DataFrame) -> DataFrame:
    """The latest results of jobs, with the records of their pages. Of a capture parsed twice one record counts."""
    once = parsed.dropDuplicates(["page_id", "captured_at"]).withColumnRenamed("page_id", "p")
    return latest_results(raw).join(
        once.withColumnRenamed("captured_at", "c"), (F.col("page_id") == F.col("p")) & (F.col("captured_at") == F.col("c")), "left").drop("p", "c")


def raw_objects(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Stored objects (object_key, content, content_type, seq) of the ``ok`` results: each with its page's content."""
    asked = raw.filter(F.col("outcome") == OK).select("job_id", "object_key", "timestamp", "page_id")
    found = lookup(asked, pages.select("page_id", "html"), "page_id", "job_id", CHECK_ABOVE_BYTES // WIDER)
    return found.select(
        "object_key", F.col("html").cast("binary").alias("content"), F.lit("text/html").alias("content_type"),
        F.unix_micros("timestamp").alias("seq"))


def page_records(spark: SparkSession, pages: DataFrame, spec: dict[str, Field], path: str) -> DataFrame:
    """Records of all pages, kept below ``path``; pages that are there from an earlier run are not parsed again."""
    def records(of: DataFrame) -> DataFrame:
        return extract_pages(of, spec).withColumn("page_id", F.col("page_id").cast("long"))

    schema = records(pages).schema
    ensure_table(spark, path, schema)
    there = spark.read.schema(schema).parquet(path)
    if not there.isEmpty():
        new = settled_ids(pages.select("page_id").join(there.select("page_id"), "page_id", "left_anti"))
        pages = pages.join(few_rows(new), "page_id", "left_semi")
    records(pages).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def rejected_entries(spark: SparkSession, log_path: str, name: str = "scrape-all") -> DataFrame:
    """Streaming entries of a profile whose bytes are no task message."""
    read = decode(read_log(spark, log_path, profile_channels(name), stream=True).filter(F.col("value").isNotNull()))
    return read.filter(F.col("error").isNotNull()).select(
        "topic", "partition", "offset", "timestamp", "key", "value", "error")


def run_stream(spark: SparkSession, log_path: str, pages: DataFrame, out: str, delay: str,
               name: str = "scrape-all", spec: dict[str, Field] = PAGE_RECORD, available_now: bool = False) -> list:
    """Starts the queries for raw results, records and rejected entries, once the pages (url, page_id, html) are parsed;
    with ``available_now`` they stop when the log has been read."""
    parsed = page_records(spark, pages, spec, f"{out}/pages")

    def start(df: DataFrame, kind: str):
        writer = df.writeStream.format("parquet").option("checkpointLocation", f"{out}/_checkpoints/{kind}")
        writer = writer.trigger(availableNow=True) if available_now else writer
        return writer.queryName(f"{name}-{kind}").start(f"{out}/{kind}")

    first = start(raw_results(spark, log_path, pages, delay, name), "raw")
    if available_now:
        first.awaitTermination()
    raw = spark.readStream.schema(RAW).parquet(f"{out}/raw").filter(F.col("outcome") == OK)
    second = start(raw.join(parsed, "page_id").drop("page_id"), "records")
    third = start(rejected_entries(spark, log_path, name), "rejected")
    if available_now:
        second.awaitTermination()
        third.awaitTermination()
    return [first, second, third]


def settled_results(records: DataFrame, log: DataFrame) -> DataFrame:
    """Records, or outcomes, of jobs that no later tombstone in the log cancels (read when results are asked for)."""
    cancels = log.filter(F.col("value").isNull()).groupBy(F.col("key").cast("string").alias("job_id")).agg(
        F.max(log_order()).alias("_cancelled"))
    later = (F.col("r.job_id") == F.col("c.job_id")) & (F.col("c._cancelled") > F.col("r._at"))
    return records.withColumn("_at", log_order()).alias("r").join(cancels.alias("c"), later, "left_anti").drop("_at")
