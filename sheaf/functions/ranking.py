"""First rows and full ranks per key, without one task holding a whole key."""

from bisect import bisect
from itertools import accumulate
from math import ceil, floor

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from sheaf.session import few_rows, range_parts, settled, settled_ids, window_parts

#: Up to so many values of a leading id column (such as channels) are listed in a filter.
MOST_LISTED = 100


def group_limit(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.optimizer.windowGroupLimitThreshold"))


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key.

    Up to the session's group-limit threshold Spark cuts each map task's rows to ``n`` per key
    ahead of the shuffle, so a hot key costs no more than ``n`` rows per task. A larger ``n``
    goes over the distributed rank.
    """
    if n > group_limit(df.sparkSession):
        return ranked(df, keys, order, "__rank").filter(F.col("__rank") < n).drop("__rank")
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter(F.col("__rank") <= n).drop("__rank")


def first_rows(df: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """``first_n`` of a wide table whose (key, order) is unique.

    The rows are picked by these two columns alone and then fetched, so that payloads are
    neither sorted nor shuffled to find a few of them.
    """
    return fetched(df, settled_ids(first_n(df.select(key, order), [key], [F.col(order)], n)), [key, order])


def fetched(df: DataFrame, picked: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``df`` for settled ids; few ids are broadcast.

    The bounds of the last id column for each value of the first (or over all, if these are many) go into the scan, so that
    folders and row groups without any of the ids are not read.
    """
    return df.filter(bounds(picked, on[0], on[-1])).join(few_rows(picked), on)


def bounds(picked: DataFrame, first: str, last: str) -> Column:
    """A filter of literals that all picked rows pass. The driver reads up to 101 rows for it."""
    by = picked.groupBy(first).agg(F.min(last).alias("lo"), F.max(last).alias("hi"))
    read = by.limit(MOST_LISTED + 1).collect()
    if len(read) > MOST_LISTED:
        lo, hi = by.agg(F.min("lo"), F.max("hi")).first()
        return F.col(last).between(lo, hi)
    out = F.lit(False)
    for value, lo, hi in read:
        out = out | (F.col(first).eqNullSafe(F.lit(value)) if value is None else F.col(first) == value) & F.col(last).between(lo, hi)
    return out


def ranked(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    into: str,
    size_into: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """0-based rank of every row within its key (and the key's row count), by range partitioning.

    Rows are range-partitioned and sorted on (keys, order), so a key that holds a third of all
    rows is cut into many partitions. A row's rank is its place in its partition plus the
    number of its key's rows in earlier partitions; those numbers are one row per key and
    partition. The placed rows are kept in the shared folder, as both parts must see the
    same partition bounds.
    """
    n = partitions or range_parts(df)
    by = [F.col(k) for k in keys]
    placed = settled(
        df.repartitionByRange(n, *by, *order)
        .sortWithinPartitions(*by, *order)
        .withColumn("__at", F.monotonically_increasing_id())
        .withColumn("__part", F.shiftright("__at", 33))
    )
    runs = placed.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.withColumn("__base", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    if size_into:
        runs = runs.withColumn(size_into, F.sum("__n").over(Window.partitionBy(*keys)))
    return (
        placed.join(few_rows(runs), [*keys, "__part"])
        .withColumn(into, F.col("__base") + F.col("__at") - F.col("__first"))
        .drop("__at", "__part", "__n", "__first", "__base")
    )


def summed_before(df: DataFrame, keys: list[str], order: list[Column], size: Column, into: str) -> DataFrame:
    """The sum of ``size`` over the earlier rows of each row's key, in the way of ``ranked``: within a partition by a window, plus
    one sum per key and partition for the partitions before it."""
    by = [F.col(k) for k in keys]
    placed = settled(
        df.withColumn("__size", size).repartitionByRange(range_parts(df), *by, *order).withColumn("__part", F.spark_partition_id()))
    inside = Window.partitionBy(*keys, "__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    runs = placed.groupBy(*keys, "__part").agg(F.sum("__size").alias("__sum"))
    runs = runs.select(*keys, "__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__base"))
    return placed.withColumn("__in", F.coalesce(F.sum("__size").over(inside), F.lit(0))).join(few_rows(runs), [*keys, "__part"]).withColumn(
        into, F.col("__base") + F.col("__in")).drop("__size", "__part", "__in", "__base")


def in_ranges(df: DataFrame, keys: list[str], order: list[str], *measured: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows settled by range of (keys, order), with ``__part``, which grows with them; and the same dealt for windows over (``__part``, keys).

    So a task has one range, whatever the session's number of partitions. What a key's rows need of its other ranges is one row per key and range,
    for ``carried``. Rows equal in keys and order share a range. ``measured`` are rows at least as many as those of ``df`` that are cheaper to go through.
    """
    n = window_parts(*(measured or [df]))
    placed = settled(df.repartitionByRange(n, *keys, *order).withColumn("__part", F.spark_partition_id()))
    return placed, placed.repartitionById(n, "__part")


def carried(dealt: DataFrame, few: DataFrame, keys: list[str]) -> DataFrame:
    """``dealt`` with the other columns of ``few``, one row per key and range; null keys meet null keys."""
    on = ["__part", *keys]
    few = few_rows(settled(few.withColumnsRenamed({k: f"__of_{k}" for k in on})))
    same = [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in on]
    return dealt.join(few, same, "left").drop(*(f"__of_{k}" for k in on))


def earlier_ranges(keys: list[str]) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)


def quantiles(df: DataFrame, column: Column, shares: list[float]) -> list[float | None]:
    """What ``percentile`` gives, from the rows at the places in question: no task holds all values. Nulls are left out; of no values it is null."""
    values = df.select(column.alias("__value")).filter(F.col("__value").isNotNull())
    placed = settled(values.repartitionByRange(range_parts(values), "__value").sortWithinPartitions("__value").withColumn(
        "__at", F.monotonically_increasing_id()))
    runs = sorted(placed.groupBy(F.shiftright("__at", 33).alias("part")).agg(F.count("*"), F.min("__at")).collect())
    if not runs:
        return [None] * len(shares)
    starts = [0, *accumulate(n for _, n, _ in runs)]
    places = [(starts[-1] - 1) * share for share in shares]
    wanted = {runs[i][2] + at - starts[i]: at for p in places for at in {floor(p), ceil(p)} for i in [bisect(starts, at) - 1]}
    rows = placed.filter(F.col("__at").isin(list(wanted))).select("__at", "__value").collect()
    found = {wanted[at]: float(value) for at, value in rows}

    def between(place: float) -> float | None:
        lo, hi = floor(place), ceil(place)
        if found[lo] == found[hi]:
            return found[lo]
        return (hi - place) * found[lo] + (place - lo) * found[hi]

    return [between(p) for p in places]
