"""Logs and consumer groups: start positions, profiles, deduplication, delivery, depth."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.ranking import fetched, first_n, first_rows
from sheaf.schema import PROFILES, RECLAIM_COUNT, TOPICS
from sheaf.session import few_rows, settled_ids


def start_at(log: DataFrame, position: str | int | dict[str, int] = "earliest",
             groups: DataFrame | None = None, order: str = "msg_id") -> DataFrame:
    """Entries a group reads: all (``earliest``), those after its creation (``latest``, by the
    ``position`` per channel in ``groups``), or those after explicit positions."""
    if position == "earliest":
        return log
    if position == "latest":
        after = groups.groupBy("channel").agg(F.max("position").alias("_position"))
        placed = log.join(few_rows(after), "channel", "left")  # a position per channel: the log stays where it is
        return placed.filter(F.col(order) > F.coalesce("_position", F.lit(-1))).drop("_position")
    if isinstance(position, int):
        return log.filter(F.col(order) > position)
    after = F.lit(False)
    for channel, at in position.items():
        after = after | ((F.col("channel") == channel) & (F.col(order) > at))
    return log.filter(after | ~F.col("channel").isin(list(position)))


def profile_channels(name: str) -> list[str]:
    return [TOPICS[t] for t in PROFILES[name]]


def profile(log: DataFrame, name: str, col: str = "channel") -> DataFrame:
    """The entries a worker profile reads; a log partitioned by ``col`` is pruned to its folders."""
    return log.filter(F.col(col).isin(profile_channels(name)))


def profile_of(channel: Column) -> Column:
    """Names of all profiles that read a channel."""
    readers = [F.when(channel.isin(profile_channels(p)), F.lit(p)) for p in PROFILES]
    return F.array_compact(F.array(*readers))


def union_paths(*paths: DataFrame) -> DataFrame:
    """Tasks of several ingest paths as one table."""
    out = paths[0]
    for p in paths[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def dedup_tasks(df: DataFrame, order: str = "seq", key: str = "job_id") -> DataFrame:
    """One row per job, the first seen. Copies are reduced before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(key, "_row.*")


def cancel(tasks: DataFrame, tombstones: DataFrame, order: str = "seq") -> DataFrame:
    """Tasks without a later tombstone. Expects one row per job: see ``live_tasks`` for raw logs."""
    last = tombstones.groupBy("job_id").agg(F.max(order).alias("_cancelled"))
    later = (F.col("t.job_id") == F.col("c.job_id")) & (F.col("c._cancelled") > F.col(f"t.{order}"))
    return tasks.alias("t").join(last.alias("c"), later, "left_anti")


def live_tasks(log: DataFrame, tombstone: Column, order: str = "seq", key: str = "job_id") -> DataFrame:
    """First copy of every job that no later tombstone cancels, in one aggregation.

    Copies and tombstones of a job are reduced per map task, so neither a job delivered very
    often nor a join on the job id can overload a task.
    """
    rest = [c for c in log.columns if c != key]
    reduced = log.withColumn("_dead", tombstone).groupBy(key).agg(
        F.min_by(F.struct(*rest), F.when(~F.col("_dead"), F.col(order))).alias("_row"),
        F.max(F.when(F.col("_dead"), F.col(order))).alias("_cancelled"),
    )
    live = F.col(f"_row.{order}").isNotNull() & (
        F.col("_cancelled").isNull() | (F.col("_cancelled") < F.col(f"_row.{order}")))
    return reduced.filter(live).select(key, "_row.*")


def dequeue(df: DataFrame, n: int, queue: str = "queue", order: str = "seq") -> DataFrame:
    """The ``n`` oldest items of each queue."""
    return first_rows(df, queue, order, n)


def take(df: DataFrame, n: int, queue: str = "queue", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """(taken, remaining): the ``n`` oldest items of each queue, and all others."""
    ids = settled_ids(first_n(df.select(queue, order), [queue], [F.col(order)], n))
    return fetched(df, ids, [queue, order]), df.join(few_rows(ids), [queue, order], "left_anti")


def read_group(log: DataFrame, deliveries: DataFrame, group: str, count: int, after: dict[str, int] | None = None) -> DataFrame:
    """The next ``count`` entries per channel that the group never got.

    They are found by their ids, so payloads take no part in the anti join. ``after`` gives a position per channel
    up to which the group got all: neither the log nor the deliveries are read before it.
    """
    ids = ["channel", "msg_id"]
    if after:
        log, deliveries = start_at(log, after), start_at(deliveries, after)
    got = deliveries.filter(F.col("grp") == group).select(*ids)
    open_ids = log.select(*ids).join(got, ids, "left_anti")
    return fetched(log, settled_ids(first_n(open_ids, ["channel"], [F.col("msg_id")], count)), ids)


def pending(deliveries: DataFrame, acks: DataFrame) -> DataFrame:
    """Delivered entries without an acknowledgement."""
    return deliveries.join(acks.select("grp", "channel", "msg_id"), ["grp", "channel", "msg_id"], "left_anti")


def reclaim(pending: DataFrame, log: DataFrame, consumer: str, now: Column,
            count: int = RECLAIM_COUNT, min_idle_seconds: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(claimed, acks, returned): the oldest idle entries per group and channel change consumer.

    All claimed entries are acknowledged; those whose log entry has data are returned. The
    claim is kept in the shared folder (at most ``count`` rows per group and channel), so
    acks and returned rows agree, and the log is joined to a side of known size.
    """
    idle = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("delivered_at").cast("timestamp"))
    waiting = pending.filter(idle >= min_idle_seconds * 1_000_000)
    claimed = settled_ids(
        first_n(waiting, ["grp", "channel"], [F.col("msg_id")], count).withColumn("consumer", F.lit(consumer)))
    ids = claimed.select("grp", "channel", "msg_id", "consumer")
    returned = fetched(log.filter(F.col("payload").isNotNull()), ids, ["channel", "msg_id"])
    return claimed, claimed.select("grp", "channel", "msg_id"), returned


def register_groups(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Groups (channel, grp, position, created_seq); one that exists keeps its position."""
    return existing.unionByName(new).groupBy("channel", "grp").agg(
        F.min_by("position", "created_seq").alias("position"), F.min("created_seq").alias("created_seq"))


def queue_depth(log: DataFrame, acks: DataFrame, every: str, per_worker: int) -> DataFrame:
    """Entries not yet acknowledged per channel at the end of each window, and workers wanted.

    Arrivals (``ts``) count +1 and acknowledgements (``acked_at``) -1. Both are summed per
    window and channel ahead of the running sum, so the window holds one row per time
    slot and channel, however many entries there are.
    """
    deltas = log.select("channel", F.col("ts").alias("at"), F.lit(1).alias("d")).unionByName(
        acks.select("channel", F.col("acked_at").alias("at"), F.lit(-1).alias("d")))
    slots = deltas.groupBy("channel", F.window("at", every).alias("w")).agg(F.sum("d").alias("change"))
    running = Window.partitionBy("channel").orderBy("w.start").rowsBetween(Window.unboundedPreceding, 0)
    return slots.select("channel", F.col("w.start").alias("window_start"), "change",
                        F.sum("change").over(running).alias("depth")).withColumn(
        "workers", F.ceil(F.greatest("depth", F.lit(0)) / per_worker))
