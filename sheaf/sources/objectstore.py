"""The object store: Parquet commits, one row per object once they are folded."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from sheaf.operators.objects import get_objects, list_objects
from sheaf.schema import OBJECT
from sheaf.session import settled_ids
from sheaf.sources import commits

KEY, ORDER = "object_key", ["seq"]


def ensure_table(spark: SparkSession, path: str, schema: StructType, strict: bool = False,
                 by: tuple[str, ...] = ()) -> None:
    """Makes an empty table where there is none; with ``strict`` an existing one is an error."""
    empty = spark.createDataFrame([], schema)
    empty.write.mode("errorifexists" if strict else "ignore").partitionBy(*by).parquet(path)


def put_objects(spark: SparkSession, path: str, writes: DataFrame) -> None:
    """Stores (object_key, content, content_type, seq), replacing objects of the same key unless they have a higher seq.

    The rows are appended as a commit of their own: nothing stored is read, rewritten or locked, and of two writers at
    once both are kept. Which row counts is settled when objects are read.
    """
    commits.append(writes.withColumn("length", F.octet_length("content").cast("long")).select(*OBJECT.fieldNames()), path)


def remove_objects(spark: SparkSession, path: str, keys: DataFrame) -> None:
    """Deletes by key what was stored before; a later put stores anew, whatever its seq."""
    commits.append(keys.select(KEY).distinct(), path, commits.REMOVAL)


def compact_objects(spark: SparkSession, path: str) -> None:
    """Folds puts and removals into files sorted by key. Files without a changed key stay as they are."""
    commits.compact(spark, path, OBJECT, KEY, ORDER)


def live_objects(spark: SparkSession, path: str) -> DataFrame:
    return commits.current(spark, path, OBJECT, KEY, ORDER)


def list_stored(spark: SparkSession, path: str, prefix: str = "anon") -> DataFrame:
    """Keys below a prefix: contents are not read, and the prefix prunes what is sorted by key."""
    rows = commits.current(spark, path, StructType([OBJECT[KEY], OBJECT["seq"]]), KEY, ORDER, where=F.startswith(F.col(KEY), F.lit(prefix)))
    return list_objects(rows, prefix)


def get_stored(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Content of each asked key; a missing object gives empty bytes."""
    asked = settled_ids(keys.select(KEY).distinct())
    return get_objects(asked, stored_of(spark, path, asked))


def stored_of(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """Stored objects of the keys."""
    return commits.picked(spark, path, OBJECT, KEY, ORDER, settled_ids(keys.select(KEY).distinct()))


def read_files(spark: SparkSession, path: str, with_content: bool = True) -> DataFrame:
    """Files below a folder as objects; without ``with_content`` only their names are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length", "content") if with_content else files.select("path", "length")
