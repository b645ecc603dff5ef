"""Session settings, the shared working folder and size checks."""

import os
import sys
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Runtime SQL settings every job here wants; partition counts stay the cluster's own.
RUNTIME = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.variant.allowDuplicateKeys": "true",  # of a repeated JSON key the last value counts
    # state of streams on disk, as that of exact deduplication grows with the ids
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}

SPREAD_BYTES_PER_CORE = 32 << 20


def tune(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by spark.checkpoint.dir.

    A folder of our own is made only when the setting is absent and the master is local.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="sheaf-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def settled(df: DataFrame) -> DataFrame:
    """The rows computed once, as a Parquet table in the shared folder.

    Later uses see the same rows, read only the columns they need, and have a table of known
    size to plan with. It outlives any executor.
    """
    path = scratch(df.sparkSession, "settled")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def settled_ids(df: DataFrame) -> DataFrame:
    """The same for narrow rows such as ids, as a checkpoint, which is quicker to make."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def plan_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of a plan, in bytes; a stream has no bound."""
    if df.isStreaming:
        return sys.maxsize
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def read_bytes(df: DataFrame) -> int:
    """The size of all that a plan reads, by the optimizer's estimate; a stream has no bound."""
    if df.isStreaming:
        return sys.maxsize
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))


RANGE_BYTES, UNKNOWN_BYTES, MOST_PARTS = 128 << 20, 1 << 50, 50_000


def range_parts(df: DataFrame) -> int:
    """Partitions for an explicit range or id partitioning, which AQE does not resize: by the plan's size, or by that of what it
    reads if this is less, as the optimizer takes a join for the product of its sides.

    Rows made by Python have no size that the optimizer knows, and get the session's number.
    """
    least, size = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(plan_bytes(df), read_bytes(df))
    return max(least, min(size // RANGE_BYTES, MOST_PARTS)) if size < UNKNOWN_BYTES else least


WINDOW_BYTES = 32 << 20


def window_parts(*rows: DataFrame) -> int:
    """Partitions for ranges that windows are made over, by measuring the rows to place: a window holds all rows of its partition, each of
    several in turn holds them again, and none gives its memory back to the next."""
    size = sum(df.agg(F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()[0] for df in rows)
    return max(int(rows[0].sparkSession.conf.get("spark.sql.shuffle.partitions")), min(size // WINDOW_BYTES, MOST_PARTS))


FEW_ROWS, FEW_BYTES = 200_000, 64 << 20


def few_rows(df: DataFrame) -> DataFrame:
    """Marked for broadcast when it has few rows and bytes, by measuring both; else left to a shuffle join.

    For narrow rows that are cheap to go through twice, such as settled or aggregated ids.
    The optimizer's estimate would not do: behind joins it is far too high.
    """
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(row_bytes(df)), F.lit(0))).first()
    return F.broadcast(df) if n <= FEW_ROWS and size <= FEW_BYTES else df


def row_bytes(df: DataFrame) -> Column:
    """About how many bytes a row takes."""
    size = F.lit(8 * len(df.columns)).cast("long")
    for field in df.schema.fields:
        name, kind = f"`{field.name}`", field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size += F.coalesce(F.octet_length(name), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(name))), F.lit(0))
    return size


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores ahead of costly per-row work, when the input is small.

    A small file may be a single split, which would leave the work to one core. A large
    input has splits enough and is left alone: shuffling it would cost more than it gives.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if plan_bytes(df) < cores * SPREAD_BYTES_PER_CORE:
        return df.repartition(cores)
    return df
