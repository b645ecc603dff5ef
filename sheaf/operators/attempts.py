"""The attempt log: classes, outcomes, retries that are due, failed jobs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.ranking import first_n
from sheaf.schema import MAX_ATTEMPTS, RETRY_WAIT_SECONDS

OK, HTTP_ERROR, TRANSPORT_ERROR, BAD_JSON = "ok", "http_error", "transport_error", "bad_json"


def attempt_class(status: Column, json_body: Column | None = None) -> Column:
    """No status is a transport error, 400 to 599 an HTTP error, and (where a JSON answer is
    expected in ``json_body``) text that is no JSON is an error as well. All but ok may be retried."""
    out = F.when(status.isNull(), TRANSPORT_ERROR).when(status.between(400, 599), HTTP_ERROR)
    if json_body is not None:
        out = out.when(F.try_parse_json(json_body).isNull(), BAD_JSON)
    return out.otherwise(OK)


def classify(attempts: DataFrame, json_body: str | None = None) -> DataFrame:
    body = F.col(json_body) if json_body else None
    outcome = attempt_class(F.col("status"), body)
    return attempts.withColumn("outcome", outcome).withColumn("retryable", F.col("outcome") != OK)


def resolve_attempts(classified: DataFrame, key: str, order: str, maximum: int = MAX_ATTEMPTS) -> DataFrame:
    """One row per job: its first ok among the first ``maximum`` attempts, else its last error.

    The first attempts are picked per map task ahead of the shuffle, so a job with very many
    attempts sends only ``maximum`` rows per task.
    """
    counted = first_n(classified, [key], [F.col(order)], maximum)
    rest = [c for c in classified.columns if c not in (key, "retryable")]
    per_job = counted.groupBy(key).agg(
        F.min_by(F.struct(*rest), F.when(F.col("outcome") == OK, F.col(order))).alias("_ok"),
        F.max_by(F.struct(*rest), order).alias("_last"),
        F.count("*").alias("attempts"),
    )
    picked = F.coalesce("_ok", "_last")
    state = F.when(F.col("_ok").isNotNull(), "done").when(F.col("attempts") >= maximum, "failed").otherwise("open")
    return per_job.select(key, "attempts", state.alias("state"), *[picked[c].alias(c) for c in rest])


def _per_job(classified: DataFrame, key: str, at: str) -> DataFrame:
    return classified.groupBy(key).agg(
        F.count("*").alias("attempts"),
        F.max(at).alias("last_at"),
        F.max((F.col("outcome") == OK).cast("int")).alias("_ok"),
    ).filter(F.col("_ok") == 0).drop("_ok")


def due_retries(classified: DataFrame, key: str, at: str, now: Column,
                maximum: int = MAX_ATTEMPTS, wait: int = RETRY_WAIT_SECONDS) -> DataFrame:
    """Jobs without success and with attempts left, once the fixed wait is over."""
    due = _per_job(classified, key, at).filter(F.col("attempts") < maximum).withColumn(
        "due_at", F.col("last_at") + F.make_dt_interval(secs=F.lit(wait)))
    return due.filter(F.col("due_at") <= now)


def failed_queue(classified: DataFrame, key: str, at: str, maximum: int = MAX_ATTEMPTS) -> DataFrame:
    """Jobs that used up their attempts without success."""
    return _per_job(classified, key, at).filter(F.col("attempts") >= maximum)
