"""Requests from tasks, captured responses, and runs of a caller's fetch function."""

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.functions.skew import lookup
from sheaf.functions.urls import host, with_params
from sheaf.operators.attempts import OK, attempt_class
from sheaf.schema import BODY_METHODS, MAX_ATTEMPTS, QUERY_METHODS, RETRY_WAIT_SECONDS, TIMEOUT_SECONDS
from sheaf.session import few_rows, range_parts, settled_ids

HELD_BYTES = 16 << 20
UNSUPPORTED = "Unsupported HTTP method."
ATTEMPTS = (
    "job_id string, attempt int, attempted_at timestamp, status int, error string, content binary"
)


def build_requests(tasks: DataFrame) -> DataFrame:
    """Adds ``http_method``, ``request_url``, ``request_body`` and ``request_error``.

    The method is upper-cased and empty means GET. GET, OPTIONS and HEAD carry the params in
    the URL; POST, PUT, DELETE and PATCH carry the body as JSON; others are an error.
    """
    method = F.coalesce(F.nullif(F.upper("method"), F.lit("")), F.lit("GET"))
    m = F.col("http_method")
    return tasks.withColumn("http_method", method).select(
        "*",
        F.when(m.isin(QUERY_METHODS), with_params(F.col("url"), F.col("params")))
        .when(m.isin(BODY_METHODS), F.col("url")).alias("request_url"),
        F.when(m.isin(BODY_METHODS), F.col("body")).alias("request_body"),
        F.when(~m.isin(QUERY_METHODS + BODY_METHODS), UNSUPPORTED).alias("request_error"),
    )


def fetch(
    requests: DataFrame,
    open_session: Callable[[], Callable[[dict, float], tuple[int, bytes]]],
    attempts_so_far: DataFrame | None = None,
    partitions: int | None = None,
    wait: float = RETRY_WAIT_SECONDS,
    limit: float = TIMEOUT_SECONDS,
) -> DataFrame:
    """One row per attempt of every request, made by the caller's function.

    ``open_session`` runs once per partition and gives ``send(request, timeout) -> (status,
    body)``, which raises when there is no response. Rows are dealt out by job id, so a busy
    host does not fill one task, and sorted by host inside a partition for connection reuse.
    Failed rows of a batch wait together: attempt 2 starts ``wait`` seconds after attempt 1
    ended, whatever their number. Append the result to an attempts table and pass that table
    back as ``attempts_so_far``: a later run skips finished jobs, and goes on from the attempts that
    the others have had. Rows leave a task in parts bounded by bytes.
    """
    todo = requests.filter(F.col("request_error").isNull())
    if attempts_so_far is not None:
        before = attempts_so_far.groupBy("job_id").agg(
            F.max(attempt_class(F.col("status")) == OK).alias("ok"), F.max("attempt").alias("made"))
        todo = todo.drop("ok", "made").join(before, "job_id", "left").filter(
            F.col("made").isNull() | ~F.col("ok") & (F.col("made") < MAX_ATTEMPTS))
    else:
        todo = todo.withColumn("made", F.lit(0))
    n = partitions or max(todo.sparkSession.sparkContext.defaultParallelism, range_parts(requests))
    dealt = todo.select("job_id", F.coalesce("made", F.lit(0)).cast("int").alias("made"), "http_method", "request_url", "headers", "request_body",
                        F.coalesce(host(F.col("url")), F.lit("")).alias("host")
                        ).repartition(n, "job_id").sortWithinPartitions("host")

    def framed(rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["job_id", "attempt", "attempted_at", "status", "error", "content"])
        return out.astype({"status": "Int32"})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        send = open_session()
        for batch in batches:
            left = batch.to_dict("records")
            while left:
                rows, failed, held = [], [], 0
                for r in left:
                    status, error, content = None, None, None
                    try:
                        status, content = send(r, limit)
                    except Exception as e:  # whatever the caller's transport raises
                        error = type(e).__name__
                    r["made"] += 1
                    if (status is None or 400 <= status <= 599) and r["made"] < MAX_ATTEMPTS:
                        failed.append(r)
                    rows.append((r["job_id"], r["made"], pd.Timestamp.now(tz="UTC"), status, error, content))
                    held += len(content or b"")
                    if held > HELD_BYTES:
                        yield framed(rows)
                        rows, held = [], 0
                if rows:
                    yield framed(rows)
                left = failed
                if left:
                    time.sleep(wait)

    return dealt.mapInPandas(run, ATTEMPTS)


def latest_ids(captures: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """(url, page_id): the latest capture per URL, with ``urls`` only of those; found from these two columns alone, and settled."""
    if urls is not None:
        captures = captures.join(few_rows(settled_ids(urls.select("url").distinct())), "url", "left_semi")
    return settled_ids(captures.groupBy("url").agg(F.max("page_id").alias("page_id")))


def pages_of(captures: DataFrame, latest: DataFrame) -> DataFrame:
    """(page_id, html) of the captures in place: those of ``latest`` if these are few, which a broadcast tells, else all of them, as moving
    contents to sort out the rest would cost more than to carry it on to the next join by id."""
    few = few_rows(latest.select("page_id"))
    pages = captures.select("page_id", "html")
    return pages if few.sameSemantics(latest.select("page_id")) else pages.join(few, "page_id", "left_semi")


def latest_captures(captures: DataFrame, urls: DataFrame | None = None) -> DataFrame:
    """The latest capture per URL; with ``urls`` only of those.

    The few asked ids are broadcast to the captures, so contents are read once and neither sorted nor shuffled. Page ids are unique.
    """
    return captures.select("url", "page_id", "html").join(few_rows(latest_ids(captures, urls)), ["url", "page_id"])


def fetch_captured(tasks: DataFrame, captures: DataFrame) -> DataFrame:
    """Tasks with the latest capture of their URL (``page_id``, ``html``), null where there is none.

    Tasks are brought to the ids of their captures first, without contents; these are then met by id, in one join. A URL that very
    many tasks ask for is spread over many tasks by ``lookup``.
    """
    latest = latest_ids(captures, tasks)
    named = lookup(tasks, latest, "url", spread_by="job_id")
    found = lookup(named, pages_of(captures, latest), "page_id", spread_by="job_id")
    return found.select(*tasks.columns, "page_id", "html")


def response_json(df: DataFrame, col: str = "body") -> tuple[DataFrame, DataFrame]:
    """(parsed, rejected): bodies as variant ``doc``; those that are no JSON are rejected."""
    read = df.withColumn("doc", F.try_parse_json(col))
    return read.filter(F.col("doc").isNotNull()), read.filter(F.col("doc").isNull()).drop("doc")


def on_error(df: DataFrame, result: str, error: str, mode: str) -> DataFrame:
    """``raise`` fails the job on the first row with an error; ``null`` keeps the row with a null result."""
    failed = F.col(error).isNotNull()
    if mode == "raise":
        kept = F.when(failed, F.raise_error(F.col(error)).cast(df.schema[result].dataType)).otherwise(F.col(result))
    elif mode == "null":
        kept = F.when(~failed, F.col(result))
    else:
        raise ValueError(f"unknown mode: {mode}")
    return df.withColumn(result, kept)
