"""Stored sorted sets against a dictionary, and the files that a window reads."""

import random

import pytest
from pyspark.sql import functions as F

from sheaf.session import scratch
from sheaf.sources import commits, zsets

WRITES = "set_name string, member string, score double, seq long"


@pytest.fixture()
def many_files(spark):
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def window(sets, start, stop, desc):
    out = set()
    for name, members in sets.items():
        order = sorted(members, key=lambda m: (members[m], m), reverse=desc)
        n = len(order)
        for rank in range(max(0, start if start >= 0 else n + start), min(n - 1, stop if stop >= 0 else n + stop) + 1):
            out.add((name, order[rank], members[order[rank]], rank))
    return out


def test_windows_equal_a_dictionary(spark, many_files, monkeypatch):
    rng, path, sets = random.Random(2), scratch(spark, "sets"), {"a": {}, "b": {}}
    for step in range(4):
        rows = [(rng.choice("ab"), f"m{rng.randrange(60)}", float(rng.randrange(12)), i) for i in range(50 if step == 0 else 12)]
        zsets.zadd_stored(spark, path, spark.createDataFrame(rows, WRITES))
        for s, m, score, _ in rows:
            sets[s][m] = score
        gone = [(rng.choice("ab"), f"m{rng.randrange(60)}") for _ in range(6)]
        zsets.zremove_stored(spark, path, spark.createDataFrame(gone, "set_name string, member string"))
        for s, m in gone:
            sets[s].pop(m, None)
        if step in (0, 2):
            zsets.fold_sets(spark, path)
        for start, stop, desc in ((4, 9, False), (-5, -2, False), (3, 8, True), (20, 500, False)):
            got = {tuple(r) for r in zsets.zrange_stored(spark, path, start, stop, desc).collect()}
            assert got == window(sets, start, stop, desc), (step, start, stop, desc)
    assert {tuple(r) for r in zsets.members(spark, path).collect()} == {(s, m, x) for s, ms in sets.items() for m, x in ms.items()}
    monkeypatch.setattr(zsets, "MOST_ROWS", 1)
    assert {tuple(r) for r in zsets.zrange_stored(spark, path, 4, 9).collect()} == window(sets, 4, 9, False)


def test_a_window_reads_the_files_of_its_ranks(spark, many_files):
    opened = []
    for n in (2000, 8000):
        path = scratch(spark, "sets")
        rows = spark.range(n).select(
            F.lit("s").alias("set_name"), F.concat(F.lit("m"), "id").alias("member"), (F.col("id") * 7919 % n).cast("double").alias("score"), F.lit(0).alias("seq"))
        old = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", str(n // 250))
        zsets.zadd_stored(spark, path, rows)
        zsets.fold_sets(spark, path)
        spark.conf.set("spark.sql.shuffle.partitions", old)
        found = commits.live(spark, f"{path}/index")
        files = commits.ranges(spark, f"{path}/index", found, zsets.COUNTS).select("file").distinct().count()
        df = zsets.zrange_stored(spark, path, n // 2, n // 2 + 20)
        assert sorted(r["score"] for r in df.collect()) == [float(x) for x in range(n // 2, n // 2 + 21)]
        opened.append(len([f for f in df.inputFiles() if "-folded/" in f]))
        assert files >= n // 500 and opened[-1] <= 2
    assert opened[0] <= 2 and opened[1] <= 2


def test_an_empty_store(spark):
    assert zsets.zrange_stored(spark, scratch(spark, "sets")).count() == 0
