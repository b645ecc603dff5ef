"""Sorted sets that stay stored: members by their key, and an index by score whose files know how many members they hold."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.operators.zset import zadd, zrange
from sheaf.session import few_rows, settled
from sheaf.sources import commits

FIELDS = [T.StructField("set_name", T.StringType()), T.StructField("member", T.StringType()), T.StructField("score", T.DoubleType())]
MEMBERS = T.StructType([T.StructField("key", T.StringType()), *FIELDS])
#: An entry of the index; ``weight`` is 1 where a member comes and -1 where it goes.
INDEX = T.StructType([*FIELDS, T.StructField("weight", T.IntegerType())])
COUNTS = "file string, set_name string, n long, score double, member string"
#: More rows than this are ranked by many tasks, over the whole set.
MOST_ROWS = 1_000_000


def _key() -> Column:
    """One text for set and member; the lengths keep apart what the joint text would not."""
    return F.concat_ws(":", F.length("set_name").cast("string"), "set_name", "member")


def _old(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    return commits.picked(spark, f"{path}/members", MEMBERS, "key", [], keys.select("key").distinct())


def zadd_stored(spark: SparkSession, path: str, writes: DataFrame, order: str = "seq") -> None:
    """Adds members or changes their scores, as ``zadd`` does. Only the files that may hold these members are read, and what changes is
    appended to the members and to the index. One writer at a time: what goes from the index is what was read before."""
    new = settled(zadd(None, writes, order).withColumn("key", _key()))
    old = settled(_old(spark, path, new))
    moved = new.join(old.select("key", F.col("score").alias("was")), "key", "left").filter(~F.col("was").eqNullSafe(F.col("score")))
    comes = moved.select("set_name", "member", "score", F.lit(1).alias("weight"))
    goes = moved.filter(F.col("was").isNotNull()).select("set_name", "member", F.col("was").alias("score"), F.lit(-1).alias("weight"))
    commits.append(comes.unionByName(goes), f"{path}/index")
    commits.append(new.select(*MEMBERS.fieldNames()), f"{path}/members")


def zremove_stored(spark: SparkSession, path: str, removes: DataFrame) -> None:
    """Removes members; those that a set does not have are ignored."""
    keys = settled(removes.select(_key().alias("key")).distinct())
    commits.append(_old(spark, path, keys).select("set_name", "member", "score", F.lit(-1).alias("weight")), f"{path}/index")
    commits.append(keys, f"{path}/members", commits.REMOVAL)


def members(spark: SparkSession, path: str) -> DataFrame:
    """(set_name, member, score) of all sets."""
    return commits.current(spark, f"{path}/members", MEMBERS, "key").select("set_name", "member", "score")


def fold_sets(spark: SparkSession, path: str) -> None:
    """Folds the members' commits, and writes the index anew from the members: sorted files, and for each the sets it holds, with the
    number of members and the first one. To be run when the commits since the last time have grown to a share of the whole."""
    commits.compact(spark, f"{path}/members", MEMBERS, "key")
    found = commits.live(spark, f"{path}/index")
    if not [c for c in found.commits if c.kind != commits.FOLDED]:
        return
    by = ["set_name", "score", "member"]
    rows = members(spark, path).withColumn("weight", F.lit(1)).select(*INDEX.fieldNames())

    def counted(kept: DataFrame) -> DataFrame:
        first = F.min(F.struct("score", "member"))
        return kept.groupBy(F.col("_metadata.file_name").alias("file"), "set_name").agg(F.count("*").alias("n"), first.alias("first")).select(
            "file", "set_name", "n", "first.*")

    written = rows.repartitionByRange(*by).sortWithinPartitions(*by).write
    commits.fold(spark, f"{path}/index", written, INDEX, counted, [c.name for c in found.commits], max(c.at for c in found.commits))


def zrange_stored(spark: SparkSession, path: str, start: int = 0, stop: int = -1, desc: bool = False) -> DataFrame:
    """``zrange`` of the stored sets: (set_name, member, score, rank).

    Counts of the sorted files, summed up, tell which of them can hold the ranks asked for: with p members that came and m that went since, a rank
    r lies between r - p and r + m of the folded ones. Only these files are read, and the changes since. With more than
    a million such rows the whole set is ranked instead.
    """
    at = f"{path}/index"
    found = commits.live(spark, at)
    if not found.commits:
        return zrange(members(spark, path), start, stop, desc)
    changes = settled(
        commits.read(spark, at, INDEX, found, (commits.PUT,)).groupBy("set_name", "score", "member").agg(F.sum("weight").cast("int").alias("weight"))
        .filter("weight <> 0"))
    since = changes.groupBy("set_name").agg(
        F.sum(F.when(F.col("weight") > 0, F.col("weight")).otherwise(0)).alias("p"), F.sum(F.when(F.col("weight") < 0, -F.col("weight")).otherwise(0)).alias("m"))
    in_set = Window.partitionBy("set_name")
    counts = commits.ranges(spark, at, found, COUNTS)
    placed = counts.withColumn("before", F.sum("n").over(in_set.orderBy("score", "member")) - F.col("n")).withColumn("total", F.sum("n").over(in_set))
    sizes = counts.groupBy("set_name").agg(F.sum("n").alias("total")).join(since, "set_name", "full").na.fill(0, ["total", "p", "m"])
    size = F.col("total") + F.col("p") - F.col("m")
    low = F.lit(start) if start >= 0 else size + start
    high = F.lit(stop) if stop >= 0 else size + stop
    if desc:
        low, high = size - 1 - high, size - 1 - low
    windows = settled(sizes.select("set_name", "p", "m", size.alias("size"), F.greatest(low, F.lit(0)).alias("low"), high.alias("high")).filter("low <= high"))
    files = settled(
        placed.drop("total").join(windows, "set_name")
        .filter((F.col("before") <= F.col("high") + F.col("m")) & (F.col("before") + F.col("n") > F.col("low") - F.col("p")))
        .select("file", "set_name", "n", "before"))
    rows = files.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    if rows + changes.count() > MOST_ROWS:
        return zrange(members(spark, path), start, stop, desc)
    names = [r[0] for r in files.select("file").distinct().collect()]
    of = files.groupBy("set_name").agg(F.min("before").alias("before"))
    held = commits.read(spark, at, INDEX, found, (commits.FOLDED,), names).withColumn(
        "file", F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1)).join(few_rows(files.select("file", "set_name")), ["file", "set_name"], "left_semi")
    both = held.select(*INDEX.fieldNames()).unionByName(changes.select(*INDEX.fieldNames()))
    net = both.groupBy("set_name", "score", "member").agg(F.sum("weight").alias("weight"))
    # rows below the files that are read count as one number; a change among them moves all that follow
    ranked = net.withColumn("rank", F.sum("weight").over(in_set.orderBy("score", "member")) - 1)
    found_rows = ranked.filter("weight = 1").join(few_rows(windows), "set_name").join(few_rows(of), "set_name", "left")
    rank = F.col("rank") + F.coalesce("before", F.lit(0))
    shown = F.col("size") - 1 - rank if desc else rank
    return found_rows.filter(rank.between(F.col("low"), F.col("high"))).select("set_name", "member", "score", shown.cast("long").alias("rank"))
