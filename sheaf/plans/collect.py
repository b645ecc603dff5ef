"""The whole way of a batch: log entries to stored results and completion events."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.functions.skew import CHECK_ABOVE_BYTES, lookup
from sheaf.operators.attempts import OK, TRANSPORT_ERROR, classify, failed_queue, resolve_attempts
from sheaf.operators.codec import decode
from sheaf.operators.extract import Field, extract_pages
from sheaf.operators.groups import live_tasks, profile
from sheaf.operators.groups import profile_channels as profile_topics
from sheaf.operators.objects import object_keys
from sheaf.operators.requests import build_requests, fetch, latest_ids, pages_of
from sheaf.plans.results import completions
from sheaf.schema import RETRY_WAIT_SECONDS, TOPICS
from sheaf.session import few_rows, settled
from sheaf.sources.log import Positions, positions, read_log

#: How much wider a page is than the row that asks for it, at the least.
WIDER = 256
PAGE_RECORD = {
    "title": Field("title"),
    "heading": Field("h1"),
    "lang": Field("html", attr="lang"),
    "first_link": Field("a", attr="href"),
    "links": Field("a", count=True),
}


@dataclass
class Collected:
    """Outputs of a batch, to be written by the caller."""

    outcomes: DataFrame
    objects: DataFrame
    records: DataFrame
    completions: DataFrame
    rejected: DataFrame


def type_of(topic: Column) -> Column:
    out = F.lit(None).cast("string")
    for scrape_type, name in TOPICS.items():
        out = F.when(topic == name, scrape_type).otherwise(out)
    return out


def log_order() -> Column:
    """When an entry came. Offsets count within a partition only, so entries are ordered by time first."""
    return F.struct("timestamp", "topic", "partition", "offset")


def tasks_of(log: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected) of a profile: decoded, first copy per job, cancelled ones left out."""
    read = decode(profile(log, name, "topic"))
    rejected = read.filter(F.col("error").isNotNull())
    entries = read.filter(F.col("error").isNull()).withColumn(
        "job_id", F.when(F.col("cancel"), F.col("key").cast("string")).otherwise(F.col("job_id"))
    ).withColumn("_at", log_order()).select(
        "job_id", "topic", "offset", "timestamp", "url", "method", "headers", "params", "body", "cancel", "_at")
    return (live_tasks(entries, F.col("cancel"), "_at").drop("cancel", "_at"),
            rejected.select("topic", "partition", "offset", "timestamp", "key", "value", "error"))


def with_requests(tasks: DataFrame) -> DataFrame:
    """Tasks with their requests. Pages are always read with GET; only API tasks have a choice,
    so only they can have an unsupported method."""
    typed = tasks.withColumn("scrape_type", type_of(F.col("topic")))
    method = F.when(F.col("scrape_type") == "API", F.col("method")).otherwise("GET")
    return build_requests(typed.withColumn("method", method))


def run_batch(log: DataFrame, captures: DataFrame, name: str = "scrape-all",
              spec: dict[str, Field] = PAGE_RECORD, finished: DataFrame | None = None,
              hot_above: int = CHECK_ABOVE_BYTES) -> Collected:
    """Reads, decodes, deduplicates, resolves, parses and announces a batch of tasks.

    Every entry ends in one place: a job's outcome, ``rejected`` (undecodable bytes), a cancel or a copy. Jobs
    of ``finished`` (job_id), such as the ``ok`` ones of earlier runs, are left out.

    Each page is parsed once and where it is, however many tasks ask for it, and the records (not the pages)
    are then brought to the tasks. Contents are moved once at the most, for the objects. URLs that very many tasks ask for are looked for among more than ``hot_above`` bytes of
    tasks, and spread. Tasks and records are kept in the shared folder: several
    outputs use them, and neither the log nor the pages should be gone through again for each.
    """
    tasks, rejected = tasks_of(log, name)
    if finished is not None:
        tasks = tasks.join(finished.select("job_id").distinct(), "job_id", "left_anti")
    requests = settled(with_requests(tasks))
    latest = latest_ids(captures, requests)
    pages = pages_of(captures, latest)
    per_page = settled(extract_pages(pages, spec).join(few_rows(latest), "page_id"))
    seen = lookup(requests, per_page, "url", "job_id", hot_above)
    outcome = (F.when(F.col("request_error").isNotNull(), F.col("request_error"))
               .when(F.col("page_id").isNull(), TRANSPORT_ERROR).otherwise(OK))
    keyed = object_keys(seen.withColumn("outcome", outcome), "timestamp", filename="data.html")
    done = F.col("outcome") == OK
    outcomes = keyed.select(
        "job_id", "scrape_type", "url", "outcome", F.when(done, F.col("object_key")).alias("object_key"),
        F.col("timestamp").alias("finished_at"), *[F.when(done, F.col(f)).alias(f) for f in spec])
    stored = outcomes.filter(done)
    asked = seen.filter(F.col("request_error").isNull() & F.col("page_id").isNotNull()).select("job_id", "timestamp", "page_id")
    content = lookup(asked, pages, "page_id", "job_id", check_above=hot_above // WIDER).filter(F.col("html").isNotNull())
    objects = object_keys(content, "timestamp", filename="data.html").select(
        "object_key", F.col("html").cast("binary").alias("content"), F.lit("text/html").alias("content_type"),
        F.unix_micros("timestamp").alias("seq"))
    records = stored.select("job_id", "scrape_type", F.to_date("finished_at").alias("day"), "url", *spec)
    return Collected(outcomes, objects, records, completions(stored, "finished_at"), rejected)


def collect_from(spark: SparkSession, log_path: str, captures: DataFrame, after: Positions | None = None, finished: DataFrame | None = None,
                 name: str = "scrape-all", spec: dict[str, Field] = PAGE_RECORD) -> tuple[Collected, Positions]:
    """A batch over the entries behind some positions, and the positions reached, from which the next batch goes on.

    Nothing before ``after`` is decoded or read. The positions are taken first, and what comes into the log meanwhile is left to the next
    batch. ``finished`` has the jobs (job_id) of earlier batches: a copy of one of them that came late is not run again. A cancel of a job that
    an earlier batch ran counts when results are read, as with streams.
    """
    log = read_log(spark, log_path, profile_topics(name), after=after)
    reached = positions(log, after)
    last = F.lit(False)
    for topic, of in reached.items():
        for partition, offset in of.items():
            last = last | ((F.col("topic") == topic) & (F.col("partition") == partition) & (F.col("offset") <= offset))
    return run_batch(log.filter(last), captures, name, spec, finished), reached


def catch_up(log: DataFrame, outcomes: DataFrame, captures: DataFrame, name: str = "scrape-all",
             spec: dict[str, Field] = PAGE_RECORD) -> Collected:
    """A batch over every live job of the log that has no ``ok`` among ``outcomes`` (job_id, outcome).

    For jobs whose page was captured late, and for those a stream dropped as later than its watermark.
    """
    return run_batch(log, captures, name, spec, outcomes.filter(F.col("outcome") == OK))


@dataclass
class Fetched:
    """Outputs of a batch that calls out, to be written by the caller: ``attempts`` are those of this run."""

    outcomes: DataFrame
    attempts: DataFrame
    objects: DataFrame
    failed: DataFrame
    rejected: DataFrame


def run_fetched(log: DataFrame, open_session: Callable, attempts_so_far: DataFrame | None = None, name: str = "scrape-all",
                wait: float = RETRY_WAIT_SECONDS) -> Fetched:
    """A batch whose responses come from the caller's function (see ``fetch``) and not from captures.

    Every live job gets an outcome with its number of ``attempts``: that of its first success, else of its last attempt.
    Append ``attempts`` to a table and give that table (job_id, attempt, attempted_at, status) to the next run, which
    goes on with the jobs that have attempts left. Response contents go to ``objects`` alone.
    """
    tasks, rejected = tasks_of(log, name)
    requests = settled(with_requests(tasks))
    made = settled(fetch(requests, open_session, attempts_so_far, wait=wait))
    narrow = ["job_id", "attempt", "attempted_at", "status"]
    known = made.select(*narrow)
    if attempts_so_far is not None:
        known = known.unionByName(attempts_so_far.select(*narrow))
    judged = classify(known)
    best = resolve_attempts(judged, "job_id", "attempt").select("job_id", "outcome", "attempts")
    ended = requests.select("job_id", "scrape_type", "url", "timestamp", "request_error").join(best, "job_id", "left")
    keyed = object_keys(ended, "timestamp", filename="data.html")
    outcome = F.coalesce("request_error", "outcome", F.lit(TRANSPORT_ERROR))
    outcomes = keyed.select(
        "job_id", "scrape_type", "url", outcome.alias("outcome"), F.coalesce("attempts", F.lit(0).cast("long")).alias("attempts"),
        F.when(F.col("outcome") == OK, F.col("object_key")).alias("object_key"))
    contents = classify(made).filter(F.col("outcome") == OK).select("job_id", "content")
    objects = outcomes.filter(F.col("object_key").isNotNull()).join(contents, "job_id").join(
        requests.select("job_id", F.unix_micros("timestamp").alias("seq")), "job_id").select(
        "object_key", "content", F.lit("text/html").alias("content_type"), "seq")
    return Fetched(outcomes, made, objects, failed_queue(judged, "job_id", "attempted_at"), rejected)
