"""Interval sets of deliveries against the rows they stand for."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sheaf import session
from sheaf.operators import intervals
from sheaf.session import RANGE_BYTES, plan_bytes, range_parts

LOG = "channel string, msg_id long, payload string"
ROWS = "grp string, channel string, msg_id long"


def some(seed, n=60):
    rng = random.Random(seed)
    log = [(c, i, f"{c}{i}") for c in "ab" for i in sorted(rng.sample(range(400), n))]
    log += [("empty", 5, "x")]
    picked = [("g", c, i) for c, i, _ in log if c != "empty" and rng.random() < 0.6]
    picked += [("h", c, i) for c, i, _ in log if rng.random() < 0.3]
    return log, picked


def rows_of(pieces, log):
    out = set()
    for r in pieces:
        lo_open, hi_open = (r["lo_open"], r["hi_open"]) if "lo_open" in r.asDict() else (False, False)
        out |= {(r["grp"], c, i) for c, i, _ in log if c == r["channel"] and (r["lo"] < i if lo_open else r["lo"] <= i) and (i < r["hi"] if hi_open else i <= r["hi"])}
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_intervals_are_as_many_as_gaps(spark, seed):
    log, rows = some(seed)
    made = intervals.as_intervals(spark.createDataFrame(rows + rows[:5] + [("g", "a", 100_000)], ROWS), spark.createDataFrame(log, LOG)).collect()
    assert rows_of(made, log) == set(rows)
    order = {c: [i for d, i, _ in log if d == c] for c in ("a", "b", "empty")}
    have = set(rows)
    islands = sum((g, c, i) in have and (k == 0 or (g, c, ids[k - 1]) not in have) for g in "gh" for c, ids in order.items() for k, i in enumerate(ids))
    assert len(made) == islands


def test_reading_on_keeps_the_state_minimal(spark):
    log, rows = some(3)
    df, have = spark.createDataFrame(log, LOG), set(rows)
    state = intervals.as_intervals(spark.createDataFrame(rows, ROWS), df)
    state = spark.createDataFrame(state.collect(), state.schema)
    for count in (1, 4, 3, 200):
        got, after = intervals.read_group_intervals(df, state, "g", count)
        expected = set()
        for c in ("a", "b", "empty"):
            left = [i for d, i, _ in log if d == c and ("g", c, i) not in have]
            expected |= {(c, i, f"{c}{i}" if c != "empty" else "x") for i in left[:count]}
        assert {(r["channel"], r["msg_id"], r["payload"]) for r in got.collect()} == expected
        have |= {("g", c, i) for c, i, _ in expected}
        state = spark.createDataFrame(after.collect(), after.schema)
        assert rows_of(state.collect(), log) == have
        again = intervals.as_intervals(spark.createDataFrame(sorted(have), ROWS), df)
        assert state.filter("grp = 'g'").count() == again.filter("grp = 'g'").count()
    assert {r["channel"]: r["low_water"] for r in intervals.low_water(state, df).filter("grp = 'g'").collect()} == {
        c: max(i for d, i, _ in log if d == c) for c in ("a", "b", "empty")}


@pytest.mark.parametrize("seed", [4, 5])
def test_what_is_left_of_intervals(spark, seed):
    log, rows = some(seed)
    rng, df = random.Random(seed), spark.createDataFrame(log, LOG)
    acked = [r for r in rows if rng.random() < 0.5]
    delivered, gone = (intervals.as_intervals(spark.createDataFrame(x, ROWS), df) for x in (rows, acked))
    pieces = intervals.pending_intervals(delivered, gone)
    assert rows_of(pieces.collect(), log) == set(rows) - set(acked)
    assert {tuple(r) for r in intervals.entries_in(df, pieces).collect()} == set(rows) - set(acked)


def test_merging_overlaps(spark):
    made = intervals.merged(*(spark.createDataFrame(x, "grp string, channel string, lo long, hi long") for x in (
        [("g", "a", 1, 9), ("g", "a", 20, 30), ("h", "a", 2, 3)], [("g", "a", 3, 4), ("g", "a", 9, 12), ("g", "b", 1, 1)])))
    assert {tuple(r) for r in made.collect()} == {("g", "a", 1, 12), ("g", "a", 20, 30), ("h", "a", 2, 3), ("g", "b", 1, 1)}


def test_no_window_holds_a_whole_group(spark, monkeypatch):
    plans, settled = [], session.settled

    def seen(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return settled(df)

    monkeypatch.setattr(intervals, "settled", seen)
    log = spark.createDataFrame([("a", i, "x") for i in range(9)], LOG)
    delivered, acked = (spark.createDataFrame(x, "grp string, channel string, lo long, hi long") for x in ([("g", "a", 1, 6)], [("g", "a", 3, 4)]))
    got = intervals.entries_in(log, intervals.pending_intervals(delivered, acked))
    plans.append(got._jdf.queryExecution().optimizedPlan().toString())
    assert sorted(r["msg_id"] for r in got.collect()) == [1, 2, 5, 6]
    windows = [w for p in plans for w in re.findall(r"windowspecdefinition\(([^()]*)", p)]
    assert windows and all("__part#" in w for w in windows)


@pytest.mark.parametrize("seed", [6, 7])
def test_groups_cut_into_ranges(spark, monkeypatch, seed):
    monkeypatch.setattr(session, "WINDOW_BYTES", 512)
    rng, log = random.Random(seed), [(c, i, "x") for c in "ab" for i in range(300)]

    def drawn(n, longest):
        los = [(g, c, rng.randrange(300)) for g in ("g", "h", None) for c in "ab" for _ in range(n)]
        return [(g, c, lo, lo + rng.choice([0, 1, rng.randrange(longest)])) for g, c, lo in los] + [("g", "b", 20, 270)] * (longest > 9)

    def union(rows):
        out = []
        for g, c, lo, hi in sorted(rows, key=lambda r: (r[0] or "", *r[1:])):
            if out and out[-1][:2] == [g, c] and lo <= out[-1][3]:
                out[-1][3] = max(out[-1][3], hi)
            else:
                out.append([g, c, lo, hi])
        return sorted(map(tuple, out), key=str)

    def covered(rows):
        return {(g, c, i) for g, c, lo, hi in rows for i in range(lo, min(hi, 299) + 1)}

    state, taken = drawn(25, 40), drawn(30, 4)
    delivered, acked = (spark.createDataFrame(x, "grp string, channel string, lo long, hi long") for x in (state, taken))
    assert session.window_parts(delivered) > 6 and session.window_parts(acked) > 6
    assert sorted(map(tuple, intervals.merged(delivered).collect()), key=str) == union(state)
    assert sorted(map(tuple, intervals.merged(delivered, acked).collect()), key=str) == union(state + taken)
    pieces = intervals.pending_intervals(delivered, acked)
    kept = pieces.collect()
    assert rows_of(kept, log) == covered(state) - covered(taken)
    found = [tuple(r) for r in intervals.entries_in(spark.createDataFrame(log + log[:9], LOG), pieces).collect()]
    assert len(found) == len(set(found)) and set(found) == covered(state) - covered(taken)


def test_an_empty_state_reads_from_the_start(spark):
    log = spark.createDataFrame([("a", 3, "x"), ("a", 7, "y"), ("a", 9, "z")], LOG)
    got, state = intervals.read_group_intervals(log, spark.createDataFrame([], "grp string, channel string, lo long, hi long"), "g", 2)
    assert [r["msg_id"] for r in got.orderBy("msg_id").collect()] == [3, 7]
    assert [tuple(r) for r in state.collect()] == [("g", "a", 3, 7)]


def test_ranges_of_joined_rows_are_as_many_as_what_is_read_needs(spark):
    a, b = (spark.range(1_000_000).withColumn(n, F.col("id") % 7).hint("shuffle_hash") for n in "ab")
    assert plan_bytes(a.join(b, "id")) > 50_000 * RANGE_BYTES  # the product of both sides
    assert range_parts(a.join(b, "id")) == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert range_parts(spark.range(200_000_000)) == 200_000_000 * 8 // RANGE_BYTES
