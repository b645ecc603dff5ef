"""The keyed table kept in storage: changes are applied to the rows they name, and appended."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sheaf.operators.changes import apply_changes, get_items
from sheaf.session import settled, settled_ids
from sheaf.sources import commits

ITEM = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("name", T.StringType()), T.StructField("description", T.StringType()),
    T.StructField("price", T.DoubleType())])


def store_items(items: DataFrame, path: str) -> None:
    """Appends items; of an id stored before the newer row counts."""
    commits.append(items.select(*[items[f.name].cast(f.dataType).alias(f.name) for f in ITEM.fields]), path)


def stored_items(spark: SparkSession, path: str) -> DataFrame:
    """All items."""
    return commits.current(spark, path, ITEM, "id")


def compact_items(spark: SparkSession, path: str) -> None:
    """Folds what was appended into files sorted by id; files without a changed id stay as they are."""
    commits.compact(spark, path, ITEM, "id")


def get_stored_items(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """Each asked id with its row and status 200, or status 404; of folded files only those are opened whose ids may be asked for."""
    asked = settled_ids(ids.select("id").distinct())
    return get_items(commits.picked(spark, path, ITEM, "id", [], asked), asked)


def apply_stored(spark: SparkSession, path: str, changes: DataFrame, next_id: int) -> DataFrame:
    """Applies ordered changes and gives their statuses. ``next_id`` is carried by the caller from run to run (``id_after``), as
    ids of deleted items are not given again.

    Only the rows whose ids the changes name are read, and only these and new rows are written: the base table is neither
    shuffled nor rewritten. Changes of one run at a time; a run that failed before its removals and rows were both committed may be repeated, as
    its statuses are not out yet.
    """
    changes = settled(changes)
    touched = settled_ids(changes.filter("op <> 'POST'").select("id").distinct())
    base = settled(commits.picked(spark, path, ITEM, "id", [], touched))
    table, statuses = apply_changes(base, changes, next_id)
    made, told = settled(table), settled(statuses)
    commits.append(base.select("id").join(made.select("id"), "id", "left_anti"), path, commits.REMOVAL)
    store_items(made, path)
    return told
