"""A keyed table and its ordered changes (POST, PUT, PATCH, DELETE)."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.ranking import ranked
from sheaf.functions.skew import lookup
from sheaf.session import few_rows, settled_ids


def assign_ids(rows: DataFrame, next_id: int | Column, group: str, order: str = "seq") -> DataFrame:
    """``id`` = next_id, next_id + 1, ... in order, over rows that share one ``group`` value."""
    numbered = ranked(rows, [group], [F.col(order)], "_n")
    base = next_id if isinstance(next_id, Column) else F.lit(next_id)
    return numbered.withColumn("id", base + F.col("_n")).drop("_n")


def following_id(base: DataFrame) -> int:
    """The id after the highest one in use, 0 for an empty table (one number)."""
    return base.agg(F.coalesce(F.max("id") + 1, F.lit(0)).cast("long")).first()[0]


def id_after(next_id: int, changes: DataFrame) -> int:
    """The next id once ``changes`` are applied (one number). Carried to the next run, it keeps ids of deleted rows from
    being given again."""
    return next_id + changes.filter(F.col("op") == "POST").count()


def create_items(posts: DataFrame, next_id: int) -> DataFrame:
    """New rows with sequential ids; a null description becomes ``''``."""
    made = assign_ids(posts, next_id, "op")
    return made.select("seq", "op", "id", "name", F.coalesce("description", F.lit("")).alias("description"), "price")


def get_items(table: DataFrame, ids: DataFrame) -> DataFrame:
    """Each asked id with its row and status 200, or status 404. A short list of ids is broadcast, so only their rows are shuffled."""
    asked = settled_ids(ids.select("id").distinct())
    found = table.join(few_rows(asked), "id", "left_semi").withColumn("_here", F.lit(True))
    return asked.join(found, "id", "left").withColumn("status", F.when(F.col("_here"), 200).otherwise(404)).drop("_here")


def apply_changes(base: DataFrame, changes: DataFrame, next_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(table, statuses): the table after all changes, and 200, 201 or 404 per change.

    No change is applied one by one. An id is never used twice, so its first delete closes
    it. The table is one aggregation per id over births (base rows and POSTs) and changes,
    reduced per map task, so an id with very many changes is no hot spot: a change older
    than the birth can never be the latest value, since the birth sets every field.
    """
    next_id = following_id(base) if next_id is None else next_id
    posts = create_items(changes.filter(F.col("op") == "POST"), next_id)
    edits = changes.filter(F.col("op") != "POST")
    return _table(base, posts, edits), _statuses(base, posts, edits)


def _table(base: DataFrame, posts: DataFrame, edits: DataFrame) -> DataFrame:
    default = F.when(F.col("op") == "PATCH", F.col("description")).otherwise(
        F.coalesce("description", F.lit("")))
    rows = (
        base.select(F.lit(-1).cast("long").alias("seq"), F.lit("BASE").alias("op"), "id", "name",
                    F.coalesce("description", F.lit("")).alias("description"), "price")
        .unionByName(posts.select("seq", "op", "id", "name", "description", "price"))
        .unionByName(edits.select("seq", "op", "id", "name", default.alias("description"), "price"))
    )
    op, seq = F.col("op"), F.col("seq")
    sets = op != "DELETE"
    folded = rows.groupBy("id").agg(
        F.min(F.when(op.isin("BASE", "POST"), seq)).alias("_born"),
        F.max(F.when(~sets, seq)).alias("_deleted"),
        F.max_by("name", F.when(sets, seq)).alias("name"),
        F.max_by("description", F.when(sets & F.col("description").isNotNull(), seq)).alias("description"),
        F.max_by("price", F.when(sets, seq)).alias("price"),
    )
    here = F.col("_born").isNotNull() & (F.col("_deleted").isNull() | (F.col("_deleted") < F.col("_born")))
    return folded.filter(here).select("id", "name", "description", "price")


def _statuses(base: DataFrame, posts: DataFrame, edits: DataFrame) -> DataFrame:
    """POST is 201. An edit is 200 from its id's birth to its first delete inclusive, else 404."""
    births = base.select("id", F.lit(-1).cast("long").alias("born")).unionByName(
        posts.select("id", F.col("seq").alias("born")))
    deletes = lookup(edits.filter(F.col("op") == "DELETE").select("id", "seq"), births, "id", spread_by="seq")
    closed = deletes.filter(F.col("seq") > F.col("born")).groupBy("id").agg(F.min("seq").alias("closed"))
    life = births.join(closed, "id", "left")
    placed = lookup(edits.select("seq", "op", "id"), life, "id", spread_by="seq")
    alive = (F.col("seq") > F.col("born")) & (F.col("closed").isNull() | (F.col("seq") <= F.col("closed")))
    status = F.when(F.coalesce(alive, F.lit(False)), 200).otherwise(404)
    return placed.select("seq", "op", "id", status.alias("status")).unionByName(
        posts.select("seq", "op", "id", F.lit(201).alias("status")))
