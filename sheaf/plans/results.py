"""Stored results, completion events and polling."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.schema import NOT_READY
from sheaf.session import few_rows, settled_ids
from sheaf.sources import commits
from sheaf.sources.objectstore import stored_of


def results_by_kind(raw: DataFrame, structured: DataFrame) -> DataFrame:
    """Both kinds of results as one listing (job_id, scrape_type, day, kind)."""
    cols = ["job_id", "scrape_type", "day"]
    return raw.select(*cols, F.lit("raw").alias("kind")).unionByName(
        structured.select(*cols, F.lit("structured").alias("kind")))


def store_results(raw: DataFrame, structured: DataFrame, path: str) -> None:
    """Puts both kinds into their tables; a job stored again replaces its row, whatever scrape type and day that one had.

    Each is appended as a commit of its own, so what is stored is neither read nor rewritten.
    """
    for kind, rows in (("raw", raw), ("structured", structured)):
        commits.append(rows, f"{path}/{kind}")


def read_results(like: DataFrame, path: str, kind: str) -> DataFrame:
    """The stored results of a kind, one row per job, with the columns of ``like``."""
    return commits.current(like.sparkSession, f"{path}/{kind}", like.schema, "job_id")


def compact_results(like: DataFrame, path: str, kind: str) -> None:
    commits.compact(like.sparkSession, f"{path}/{kind}", like.schema, "job_id")


def completions(results: DataFrame, finished: str, earlier: DataFrame | None = None) -> DataFrame:
    """One event per finished job: where its result is, scored by time; the last write counts, also over the
    ``earlier`` events (job_id, object_key, score)."""
    score = F.unix_timestamp(F.col(finished).cast("timestamp")).cast("double")
    events = results.select("job_id", "object_key", score.alias("score"))
    if earlier is not None:
        events = events.unionByName(earlier.select("job_id", "object_key", F.col("score").cast("double").alias("score")))
    return events.groupBy("job_id").agg(F.max_by("object_key", "score").alias("object_key"), F.max("score").alias("score"))


def poll(job_ids: DataFrame, completions: DataFrame, objects: DataFrame) -> DataFrame:
    """Each asked job with ``available``, ``message``, ``object_key`` and ``content``.

    A short list of ids is broadcast to the completions, and the hits (at most one per
    asked id) to the objects, so neither table is shuffled for it.
    """
    asked, hits = _hits(job_ids, completions)
    return _answer(asked, hits, objects)


def poll_stored(job_ids: DataFrame, completions: DataFrame, path: str) -> DataFrame:
    """``poll`` against the object store at ``path``: of it only the hits are read."""
    asked, hits = _hits(job_ids, completions)
    return _answer(asked, hits, stored_of(job_ids.sparkSession, path, hits))


def _hits(job_ids: DataFrame, completions: DataFrame) -> tuple[DataFrame, DataFrame]:
    asked = settled_ids(job_ids.select("job_id").distinct())
    return asked, settled_ids(completions.select("job_id", "object_key").join(few_rows(asked), "job_id"))


def _answer(asked: DataFrame, hits: DataFrame, objects: DataFrame) -> DataFrame:
    found = objects.select("object_key", "content").join(few_rows(hits), "object_key").select("job_id", "content")
    return asked.join(hits, "job_id", "left").join(found, "job_id", "left").select(
        "job_id", F.col("object_key").isNotNull().alias("available"),
        F.when(F.col("object_key").isNull(), NOT_READY).alias("message"), "object_key", "content")
