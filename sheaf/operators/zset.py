"""Sorted sets: (set_name, member, score), one row per member."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.ranking import group_limit, ranked
from sheaf.operators.codec import decode
from sheaf.schema import TASK
from sheaf.session import few_rows, settled_ids

TASK_FIELDS = TASK.fieldNames()


def zadd(current: DataFrame | None, writes: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert by member text; the last write gives the score, a null score means now."""
    now = F.unix_micros(F.current_timestamp()) / 1e6
    rows = writes.select("set_name", "member", F.coalesce("score", now).alias("score"), order)
    if current is not None:
        kept = current.select("set_name", "member", "score", F.lit(-1).cast("long").alias(order))
        rows = rows.unionByName(kept)
    return rows.groupBy("set_name", "member").agg(F.max_by("score", order).alias("score"))


def zrange(df: DataFrame, start: int = 0, stop: int = -1, desc: bool = False) -> DataFrame:
    """Members with ``rank`` from ``start`` to ``stop`` inclusive; negative ones count from the end.

    Ties go by member bytes; ``desc`` is the exact reverse. A range close to one end reads
    only that many rows per set. Any other range uses the distributed rank, which cuts a set
    of any size into many tasks.
    """
    up = [F.col("score"), F.col("member")]
    down = [F.col("score").desc(), F.col("member").desc()]
    order, reverse = (down, up) if desc else (up, down)
    near = group_limit(df.sparkSession)
    if 0 <= start and 0 <= stop < near:
        return _top(df, order, stop).filter(F.col("rank") >= start)
    if -near <= start < 0 and stop < 0:
        size = df.groupBy("set_name").agg(F.count("*").alias("_size"))
        tail = _top(df, reverse, -1 - start).filter(F.col("rank") >= -1 - stop).join(size, "set_name")
        return tail.withColumn("rank", F.col("_size") - 1 - F.col("rank")).drop("_size")
    placed = ranked(df, ["set_name"], order, "rank", size_into="_size")
    low = F.lit(start) if start >= 0 else F.col("_size") + start
    high = F.lit(stop) if stop >= 0 else F.col("_size") + stop
    return placed.filter(F.col("rank").between(low, high)).drop("_size")


def _top(df: DataFrame, order: list, last: int) -> DataFrame:
    w = Window.partitionBy("set_name").orderBy(*order)
    numbered = df.withColumn("_row", F.row_number().over(w)).filter(F.col("_row") <= last + 1)
    return numbered.withColumn("rank", F.col("_row").cast("long") - 1).drop("_row")


def zremove(current: DataFrame, removes: DataFrame) -> DataFrame:
    """The set without the given members; members it does not have are ignored."""
    return current.join(removes.select("set_name", "member"), ["set_name", "member"], "left_anti")


def with_tasks(members: DataFrame, value: str = "member") -> DataFrame:
    """Members with the task they hold (job_id, url, method, headers, params, body), decoded once, when they are added; undecodable ones
    have nulls. Kept with them, it spares each search the decoding."""
    read = decode(members, value)
    good = ~F.col("cancel") & F.col("error").isNull()
    return read.select(*members.columns, *[F.when(good, F.col(f)).alias(f) for f in TASK_FIELDS])


def search(members: DataFrame, job_ids: DataFrame, value: str = "member") -> DataFrame:
    """For each asked job id the first member, in rank order, that decodes to it; else null.

    Members (binary task messages with a score) are decoded once for all ids, unless they were ``with_tasks``; undecodable
    ones are skipped. A short list of ids is broadcast, so only its members are shuffled.
    """
    asked = settled_ids(job_ids.select("job_id").distinct())
    if "job_id" not in members.columns:
        members = with_tasks(members.select(value, "score"), value)
    read = members.filter(F.col("job_id").isNotNull())
    wanted = few_rows(asked)
    if wanted is not asked:
        read = read.join(wanted, "job_id", "left_semi")
    first = read.groupBy("job_id").agg(
        F.min_by(F.struct("url", "method", "headers", "params", "body", "score"), F.struct("score", value)).alias("hit"))
    return asked.join(first, "job_id", "left").select("job_id", F.col("hit").isNotNull().alias("found"), "hit.*")
