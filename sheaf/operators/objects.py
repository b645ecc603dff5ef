"""Stored objects as rows: keys, lookup, preview, deletion."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.ids import dated_key
from sheaf.functions.text import utf8_or_hex
from sheaf.schema import PREVIEW_BYTES
from sheaf.session import few_rows, settled_ids


def object_keys(df: DataFrame, ts: str, ident: str = "job_id", prefix: Column | str = "anon",
                filename: str = "data.json") -> DataFrame:
    """``object_key``: prefix/yyyy/MM/dd/id/filename, the date in UTC."""
    start = F.lit(prefix) if isinstance(prefix, str) else prefix
    return df.withColumn("object_key", dated_key(start, F.col(ts), F.col(ident), F.lit(filename)))


def upsert_objects(current: DataFrame | None, writes: DataFrame) -> DataFrame:
    """One row per key, the write with the highest ``seq``; ``current`` is older than a write of the same ``seq``, and
    where it has no ``seq`` older than any."""
    cols = ["content", "content_type", "length"]
    rows = writes.withColumn("length", F.octet_length("content").cast("long")).select(
        "object_key", *cols, "seq", F.lit(True).alias("new"))
    if current is not None:
        seq = F.col("seq") if "seq" in current.columns else F.lit(-1).cast("long").alias("seq")
        old = current.select("object_key", *cols, seq, F.lit(False).alias("new"))
        rows = rows.unionByName(old)
    return rows.groupBy("object_key").agg(
        F.max_by(F.struct(*cols), F.struct("seq", "new")).alias("_o"), F.max("seq").alias("seq")
    ).select("object_key", "_o.*", "seq")


def list_objects(objects: DataFrame, prefix: str = "anon") -> DataFrame:
    """Keys below a prefix; the filter reaches the scan and contents are not read."""
    return objects.filter(F.col("object_key").startswith(prefix)).select("object_key")


def get_objects(keys: DataFrame, objects: DataFrame) -> DataFrame:
    """Content of each asked key; a missing object gives empty bytes.

    A short list of keys is broadcast to the object table, so its contents are not shuffled.
    """
    asked = settled_ids(keys.select("object_key").distinct())
    found = objects.select("object_key", "content").join(few_rows(asked), "object_key")
    return asked.join(found, "object_key", "left").select(
        "object_key", F.coalesce("content", F.lit(b"")).alias("content"))


def preview(objects: DataFrame, size: int = PREVIEW_BYTES) -> DataFrame:
    """``preview``: the first bytes as text, or as hex where they are not valid UTF-8."""
    return objects.withColumn("preview", utf8_or_hex(F.substring("content", 1, size)))


def delete_objects(objects: DataFrame, keys: DataFrame) -> DataFrame:
    return objects.join(keys.select("object_key").distinct(), "object_key", "left_anti")
