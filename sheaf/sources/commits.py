"""Tables that grow by commits: each write is a folder of Parquet files that one rename puts in its place.

A commit never changes the files of another, so writers do not wait for or undo each other, and a reader sees whole commits.
What counts of a key's rows is settled on reading: a row that is newer, and not removed later. ``compact`` folds commits
into sorted files with one row per key and a list of the files' key ranges; of the files it folded into before, it rewrites those alone whose
range holds a changed key.
"""

import re
import time
import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.session import few_rows, settled_ids

#: Kinds of commits: rows written, keys removed, and rows folded. The number orders them.
PUT, REMOVAL, FOLDED = "put", "removal", "folded"
NAME = re.compile(rf"(\d{{18}})-[0-9a-f]{{32}}-({PUT}|{REMOVAL}|{FOLDED})")
RANGES, REPLACES, UNFINISHED = "_ranges", "_replaces", "_unfinished-"
#: The commit's number, as a column of what is read.
AT = "commit_at"


class Commit(NamedTuple):
    name: str
    at: int
    kind: str


class Live(NamedTuple):
    """What a reader takes of a table: its commits, and of folded ones the files that were rewritten since."""

    commits: list[Commit]
    rewritten: dict[str, set[str]]

    def of(self, kind: str) -> list[Commit]:
        return [c for c in self.commits if c.kind == kind]


def _at(spark: SparkSession, path: str):
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    there, fs = _at(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(there)] if fs.exists(there) else []


def _replaced(spark: SparkSession, path: str, commit: str) -> list[str]:
    """Names of the commits, and ``commit/file`` of single files, that a folded commit stands for."""
    return [r[0] for r in spark.read.schema("name string").json(f"{path}/{commit}/{REPLACES}").collect()]


def live(spark: SparkSession, path: str) -> Live:
    found = sorted(Commit(n, int(m[1]), m[2]) for n in _names(spark, path) if (m := NAME.fullmatch(n)))
    gone, rewritten = set(), {}
    for c in found:
        for name in _replaced(spark, path, c.name) if c.kind == FOLDED else ():
            commit, _, file = name.partition("/")
            if file:
                rewritten.setdefault(commit, set()).add(file)
            else:
                gone.add(commit)
    return Live([c for c in found if c.name not in gone], rewritten)


def unfinished(path: str) -> str:
    return f"{path}/{UNFINISHED}{uuid.uuid4().hex}"


def finish(spark: SparkSession, at: str, path: str, kind: str, number: int | None = None) -> str:
    """Puts a written folder in its place, behind all commits that are there; its name."""
    if number is None:
        last = max((int(m[1]) for n in _names(spark, path) if (m := NAME.fullmatch(n))), default=0)
        number = max(time.time_ns() // 1000, last + 1)
    name = f"{number:018d}-{uuid.uuid4().hex}-{kind}"
    source, fs = _at(spark, at)
    if not fs.rename(source, spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")):
        raise OSError(f"could not rename {at}")
    return name


def append(rows: DataFrame, path: str, kind: str = PUT) -> str:
    """Commits rows as they are: no shuffle, and nothing that is stored is read."""
    at = unfinished(path)
    rows.write.parquet(at)
    return finish(rows.sparkSession, at, path, kind)


def read(spark: SparkSession, path: str, schema: T.StructType, found: Live, kinds: tuple[str, ...], files: list[str] | None = None) -> DataFrame:
    """Rows of the commits of some kinds, with the commit's number; ``files`` (``commit/file``) narrows folded commits."""
    paths = []
    for c in found.commits:
        if c.kind not in kinds:
            continue
        if c.kind == FOLDED and files is not None:
            paths += [f"{path}/{f}" for f in files if f.startswith(c.name)]
        elif rewritten := found.rewritten.get(c.name):
            paths += [f"{path}/{c.name}/{f}" for f in _names(spark, f"{path}/{c.name}") if f[0] not in "._" and f not in rewritten]
        else:
            paths.append(f"{path}/{c.name}")
    if not paths:
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField(AT, T.LongType())]))
    rows = spark.read.schema(schema).parquet(*paths)
    return rows.withColumn(AT, F.regexp_extract(F.col("_metadata.file_path"), rf"/(\d{{18}})-[0-9a-f]{{32}}-[a-z]+/", 1).cast("long"))


def newest(rows: DataFrame, removals: DataFrame | None, key: str, order: list[str]) -> DataFrame:
    """One row per key, the highest by ``order`` and then by commit, of those committed after the key's last removal."""
    rest = [c for c in rows.columns if c != key]
    if removals is not None:
        gone = removals.groupBy(key).agg(F.max(AT).alias("gone_at"))
        rows = rows.join(few_rows(settled_ids(gone)), key, "left").filter(F.col("gone_at").isNull() | (F.col(AT) > F.col("gone_at")))
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order, AT)).alias("row")).select(key, "row.*")


def current(
    spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str] = [], found: Live | None = None,
    asked: DataFrame | None = None, files: list[str] | None = None, where: Column | None = None,
) -> DataFrame:
    """The rows that count, one per key. ``asked`` (settled keys), ``files`` (of folded commits) and ``where`` (a filter of the key) narrow them.

    Folded rows of keys that no later commit has pass as they are; only the others are grouped.
    """
    found = found or live(spark, path)

    def some(kinds: tuple[str, ...], of: T.StructType = schema) -> DataFrame:
        rows = read(spark, path, of, found, kinds, files)
        rows = rows if where is None else rows.filter(where)
        return rows if asked is None else rows.join(few_rows(asked), key, "left_semi")

    folded, put = some((FOLDED,)), some((PUT,))
    if not found.of(PUT) and not found.of(REMOVAL):
        return folded.select(*schema.fieldNames())
    removals = some((REMOVAL,), T.StructType([schema[key]])) if found.of(REMOVAL) else None
    if not found.of(FOLDED):
        return newest(put, removals, key, order).select(*schema.fieldNames())
    later = put.select(key) if removals is None else put.select(key).unionByName(removals.select(key))
    touched = few_rows(settled_ids(later.distinct()))
    changed = put.unionByName(folded.join(touched, key, "left_semi"))
    return folded.join(touched, key, "left_anti").unionByName(newest(changed, removals, key, order)).select(*schema.fieldNames())


def ranges(spark: SparkSession, path: str, found: Live, schema: str) -> DataFrame:
    """The tables of all live files of folded commits; ``file`` is ``commit/file``."""
    commits = found.of(FOLDED)
    if not commits:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*[f"{path}/{c.name}/{RANGES}" for c in commits])
    gone = [f"{c}/{f}" for c, fs in found.rewritten.items() for f in fs]
    commit = F.regexp_extract(F.col("_metadata.file_path"), rf"/([^/]+)/{RANGES}/", 1)
    return rows.withColumn("file", F.concat_ws("/", commit, "file")).filter(~F.col("file").isin(gone))


def key_ranges(spark: SparkSession, path: str, found: Live, schema: T.StructType, key: str) -> DataFrame:
    """(file, lo, hi, n): the least and the greatest key of each live file of folded commits."""
    kind = schema[key].dataType.simpleString()
    return ranges(spark, path, found, f"file string, lo {kind}, hi {kind}, n long")


def files_of(spark: SparkSession, path: str, found: Live, schema: T.StructType, key: str, keys: list) -> list[str]:
    """The files of folded commits whose range may hold one of a few keys."""
    asked = F.array(*[F.lit(k) for k in keys]).cast(T.ArrayType(schema[key].dataType))
    meets = F.exists(asked, lambda k: k.between(F.col("lo"), F.col("hi")))
    return [r[0] for r in key_ranges(spark, path, found, schema, key).filter(meets).select("file").collect()]


#: Up to so many asked keys are listed in the scan's filters and looked up in the files' key ranges.
MOST_LISTED = 200


def picked(spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str], asked: DataFrame) -> DataFrame:
    """The rows that count of settled, distinct keys. A few keys are filters of the scan, and of folded commits only the files whose key
    range may hold one are opened; there a Bloom filter of the keys, which Parquet keeps for each row group, tells most others apart unread."""
    found = live(spark, path)
    listed = [r[0] for r in asked.select(key).limit(MOST_LISTED + 1).collect()]
    if len(listed) > MOST_LISTED:
        return current(spark, path, schema, key, order, found, asked=asked)
    listed = [k for k in listed if k is not None]
    files = files_of(spark, path, found, schema, key, listed) if found.of(FOLDED) and listed else None
    return current(spark, path, schema, key, order, found, files=files, where=F.col(key).isin(listed))


def compact(spark: SparkSession, path: str, schema: T.StructType, key: str, order: list[str] = []) -> str | None:
    """Folds all later commits, and the folded files that hold a key of theirs, into one commit; removals and older rows end there.

    Files are sorted by key, which the scan's filters prune by. Commits that come meanwhile are not in the list of what is replaced, and stay.
    """
    found = live(spark, path)
    later = [c for c in found.commits if c.kind != FOLDED]
    if not later:
        return None
    keys = settled_ids(read(spark, path, T.StructType([schema[key]]), found, (PUT, REMOVAL)).select(key).distinct())
    files = _holding(spark, path, T.StructType([schema[key]]), key, found, keys)
    rows = current(spark, path, schema, key, order, found, files=files)
    written = rows.repartitionByRange(key).sortWithinPartitions(key).write.option(
        f"parquet.bloom.filter.enabled#{key}", "true").option("parquet.bloom.filter.adaptive.enabled", "true")

    def listed(kept: DataFrame) -> DataFrame:
        return kept.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count("*").alias("n"))

    return fold(spark, path, written, schema, listed, [c.name for c in later] + files, max(c.at for c in found.commits))


def fold(spark: SparkSession, path: str, written, schema: T.StructType, listed, replaces: list[str], number: int) -> str:
    """Commits what a writer has to write in place of other commits and files, with a table of its files that ``listed`` makes. Of two
    foldings at once the later one fails, and leaves the table as the other made it."""
    at = unfinished(path)
    written.parquet(at)
    listed(spark.read.schema(schema).parquet(at)).write.parquet(f"{at}/{RANGES}")
    spark.createDataFrame([(n,) for n in replaces], "name string").write.json(f"{at}/{REPLACES}")
    now = live(spark, path)
    there = {c.name for c in now.commits}
    if any(c not in there or file in now.rewritten.get(c, ()) for c, _, file in (n.partition("/") for n in replaces)):
        raise RuntimeError("another folding came first")
    return finish(spark, at, path, FOLDED, number)


def _holding(spark: SparkSession, path: str, schema: T.StructType, key: str, found: Live, keys: DataFrame) -> list[str]:
    """The files of folded commits that hold any of many keys; only the key column is read, between the least and the greatest key."""
    lo, hi = keys.agg(F.min(key), F.max(key)).first()
    rows = read(spark, path, schema, found, (FOLDED,)).filter(F.col(key).between(lo, hi))
    if not found.of(FOLDED):
        return []
    file = F.regexp_extract(F.col("_metadata.file_path"), "([^/]+/[^/]+)$", 1)
    return [r[0] for r in rows.withColumn("file", file).join(few_rows(keys), key, "left_semi").select("file").distinct().collect()]


def vacuum(spark: SparkSession, path: str, older_than: float = 3600.0) -> list[str]:
    """Deletes commits that were replaced, once the one that replaced them is ``older_than`` seconds old, so that no reader is on them."""
    there, fs = _at(spark, path)
    names, keep = _names(spark, path), {c.name for c in live(spark, path).commits}
    until = (time.time() - older_than) * 1000
    folded = [s for s in (fs.listStatus(there) if fs.exists(there) else []) if s.getPath().getName().endswith(FOLDED)]
    replaced = {n for s in folded if s.getModificationTime() <= until for n in _replaced(spark, path, s.getPath().getName())}
    gone = [n for n in names if NAME.fullmatch(n) and n not in keep and n in replaced]
    for n in gone:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}"), True)
    return gone
