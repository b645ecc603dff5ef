"""Deliveries and acknowledgements as intervals of a channel's entries: state in proportion to the gaps, not to the entries.

An interval (grp, channel, lo, hi) stands for all entries of the channel's log from lo to hi, both included. Ids need not be consecutive; what
lies between two entries that follow each other in the log is no gap.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions.ranking import carried, earlier_ranges, fetched, first_n, in_ranges, ranked
from sheaf.session import few_rows, settled, settled_ids

STATE = ["grp", "channel", "lo", "hi"]
KEY = ["grp", "channel"]
#: Above all ids, as a literal bound.
LAST = 1 << 62


def as_intervals(rows: DataFrame, log: DataFrame) -> DataFrame:
    """Intervals of delivered or acknowledged rows (grp, channel, msg_id), each as long as the log has no other entry in between.

    Gaps and islands over two distributed ranks: entries that follow each other in the log and among the rows have the same difference
    of ranks. Rows without an entry in the log count for nothing; rows given twice count once.
    """
    ids = ["channel", "msg_id"]
    placed = ranked(log.select(*ids).distinct(), ["channel"], [F.col("msg_id")], "in_log")
    held = rows.select(*KEY, "msg_id").distinct().join(placed, ids)
    numbered = ranked(held, KEY, [F.col("in_log")], "in_rows")
    return numbered.groupBy(*KEY, (F.col("in_log") - F.col("in_rows")).alias("island")).agg(
        F.min("msg_id").alias("lo"), F.max("msg_id").alias("hi")).select(*STATE)


def merged(*states: DataFrame) -> DataFrame:
    """The union of intervals that may overlap, by a running maximum of their ends.

    Gaps may be nearly as many as entries, so a group's intervals are cut into ranges: each knows how far the earlier ones reach and how many
    parts begin in them, and a part that goes on over ranges is put together by its number.
    """
    rows = states[0].select(*STATE)
    for more in states[1:]:
        rows = rows.unionByName(more.select(*STATE))
    placed, dealt = in_ranges(rows, KEY, ["lo", "hi"])
    order = Window.partitionBy("__part", *KEY).orderBy("lo", "hi")
    tops = placed.groupBy("__part", *KEY).agg(F.max("hi").alias("top")).withColumn("top", F.max("top").over(earlier_ranges(KEY)))
    reach = F.greatest(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), "top")
    begins = F.when(F.col("lo") <= reach, 0).otherwise(1)
    parts = settled(carried(dealt, tops, KEY).withColumn("begins", begins).withColumn("part", F.sum("begins").over(order)).groupBy(
        "__part", *KEY, "part").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")))
    begun = parts.groupBy("__part", *KEY).agg(F.max("part").alias("n")).withColumn("n", F.coalesce(F.sum("n").over(earlier_ranges(KEY)), F.lit(0)))
    return carried(parts, begun, KEY).groupBy(*KEY, (F.col("n") + F.col("part")).alias("part")).agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(*STATE)


def gaps(state: DataFrame, channels: DataFrame) -> DataFrame:
    """(grp, channel, after, before): what lies between a group's intervals, ``after`` and ``before`` excluded; null is without end.

    ``channels`` (grp, channel) names the channels a group reads, also those it has no interval of.
    """
    order = Window.partitionBy(*KEY).orderBy("lo")
    first = channels.select(*KEY).distinct().join(state.groupBy(*KEY).agg(F.min("lo").alias("before")), KEY, "left").select(
        *KEY, F.lit(None).cast("long").alias("after"), F.col("before").cast("long").alias("before"))
    return first.unionByName(state.select(
        *KEY, F.col("hi").cast("long").alias("after"), F.lead("lo").over(order).cast("long").alias("before")))


def low_water(state: DataFrame, log: DataFrame) -> DataFrame:
    """(grp, channel, low_water): the last entry up to which a group has all, for groups whose first interval begins with the log."""
    starts = log.groupBy("channel").agg(F.min("msg_id").alias("first"))
    lowest = state.groupBy(*KEY).agg(F.min(F.struct("lo", "hi")).alias("i"))
    return lowest.join(few_rows(settled_ids(starts)), "channel").filter(F.col("i.lo") <= F.col("first")).select(*KEY, F.col("i.hi").alias("low_water"))


def read_group_intervals(log: DataFrame, state: DataFrame, group: str, count: int) -> tuple[DataFrame, DataFrame]:
    """(entries, state): the next ``count`` entries per channel that the group never got, and its state with them delivered.

    Each gap but the first holds an entry or more, as intervals end where an undelivered entry follows: so ``count`` + 2 gaps of a channel
    hold the entries and the one behind them, and of the log only what lies in these gaps is read, from the low-water mark on. As the entries
    are the first ones not delivered, all up to the next one that is not is delivered now, and becomes one interval.
    """
    own = settled_ids(state.filter(F.col("grp") == group).select(*STATE))
    channels = log.select("channel").distinct().withColumn("grp", F.lit(group))
    first = settled_ids(first_n(gaps(own, channels), KEY, [F.col("after").asc_nulls_first()], count + 2))
    by = first.groupBy("channel").agg(F.collect_list(F.struct("after", "before")).alias("gaps"))
    bounds = first.groupBy("channel").agg(
        F.min(F.coalesce("after", F.lit(-LAST))).alias("lo"), F.max(F.coalesce("before", F.lit(LAST))).alias("hi"))
    reach = F.lit(False)
    for channel, lo, hi in bounds.collect():  # one row per channel
        reach = reach | ((F.col("channel") == channel) & (F.col("msg_id") > lo) & (F.col("msg_id") < hi))
    ident = F.col("msg_id")
    of = F.filter("gaps", lambda g: (g["after"].isNull() | (ident > g["after"])) & (g["before"].isNull() | (ident < g["before"])))
    open_ids = log.select("channel", "msg_id").filter(reach).join(few_rows(settled(by)), "channel").withColumn("gap", of).filter(F.size("gap") > 0)
    undelivered = open_ids.select("channel", "msg_id", F.col("gap")[0]["after"].alias("after")).distinct()
    picked = settled_ids(
        first_n(undelivered, ["channel"], [F.col("msg_id")], count + 1)
        .withColumn("n", F.row_number().over(Window.partitionBy("channel").orderBy("msg_id"))))
    taken = F.col("n") <= count
    ends = own.groupBy("channel").agg(F.max("hi").alias("last"))
    new = picked.groupBy("channel").agg(
        F.min_by(F.coalesce("after", "msg_id"), "n").alias("lo"), F.max(F.when(taken, F.col("msg_id"))).alias("hi"),
        F.max("n").alias("n"), F.max(F.when(~taken, F.col("after"))).alias("after")).join(ends, "channel", "left")
    hi = F.greatest("hi", F.when(F.col("n") > count, F.col("after")).otherwise(F.col("last")))
    new = new.select(F.lit(group).alias("grp"), "channel", "lo", hi.alias("hi"))
    others = state.filter(F.col("grp") != group).select(*STATE)
    return fetched(log, settled_ids(picked.filter(taken).select("channel", "msg_id")), ["channel", "msg_id"]), merged(own, new).unionByName(others)


def without(state: DataFrame, taken: DataFrame) -> DataFrame:
    """Intervals of ``state`` less those of ``taken``, as pieces (grp, channel, lo, hi, lo_open, hi_open); an open end is not part of it.

    A sweep over the sorted ends: a piece goes from one end to the next where ``state`` covers and ``taken`` does not. The ends are swept range by
    range, from the sums of the earlier ranges on and up to the first end of the next one.
    """
    def ends(of: DataFrame, covers: int, takes: int) -> DataFrame:
        # an interval begins before its first entry (side 0) and ends behind its last (side 1)
        return of.select(*KEY, F.explode(F.array(
            F.struct(F.col("lo").alias("at"), F.lit(0).alias("side"), F.lit(covers).alias("c"), F.lit(takes).alias("t")),
            F.struct(F.col("hi").alias("at"), F.lit(1).alias("side"), F.lit(-covers).alias("c"), F.lit(-takes).alias("t")))).alias("e")).select(*KEY, "e.*")

    placed, dealt = in_ranges(ends(state, 1, 0).unionByName(ends(taken, 0, 1)), KEY, ["at", "side"])
    of_ranges = placed.groupBy("__part", *KEY).agg(
        F.sum("c").alias("c_before"), F.sum("t").alias("t_before"), F.min(F.struct("at", "side")).alias("first"))
    carry = of_ranges.select("__part", *KEY, *(F.coalesce(F.sum(n).over(earlier_ranges(KEY)), F.lit(0)).alias(n) for n in ("c_before", "t_before")),
                             F.lead("first").over(Window.partitionBy(*KEY).orderBy("__part")).alias("follows"))
    points = dealt.groupBy("__part", *KEY, "at", "side").agg(F.sum("c").alias("c"), F.sum("t").alias("t"))
    order = Window.partitionBy("__part", *KEY).orderBy("at", "side")
    swept = points.withColumn("covered", F.sum("c").over(order)).withColumn("gone", F.sum("t").over(order)).withColumn(
        "next", F.lead(F.struct("at", "side")).over(order))
    met = carried(swept, carry, KEY).withColumn("next", F.coalesce("next", "follows"))
    return met.filter("covered + c_before > 0 and gone + t_before = 0").select(
        *KEY, F.col("at").alias("lo"), F.col("next.at").alias("hi"), (F.col("side") == 1).alias("lo_open"), (F.col("next.side") == 0).alias("hi_open"))


def entries_in(log: DataFrame, pieces: DataFrame) -> DataFrame:
    """(grp, channel, msg_id) of the log's entries in disjoint pieces, each group's apart.

    Entries and pieces are placed together by range of (channel, id); an entry is in the last piece of a group that begins before it, if that piece
    reaches it. Pieces that reach over a range's start are carried into it: one row per group, channel and range.
    """
    pieces = settled(pieces)
    groups_of = few_rows(settled_ids(pieces.select(*KEY).distinct()))
    entries = log.select("channel", "msg_id")
    points = entries.distinct().join(groups_of, "channel").select(
        *KEY, F.col("msg_id").alias("at"), F.lit(1).alias("side"), F.lit(None).cast("struct<hi:bigint,lo_open:boolean,hi_open:boolean,lo:bigint>").alias("piece"))
    begins = pieces.select(*KEY, F.col("lo").alias("at"), F.lit(0).alias("side"), F.struct(
        F.col("hi").cast("long").alias("hi"), "lo_open", "hi_open", F.col("lo").cast("long").alias("lo")).alias("piece"))
    rows = points.withColumn("at", F.col("at").cast("long")).unionByName(begins.withColumn("at", F.col("at").cast("long")))
    placed, dealt = in_ranges(rows, KEY, ["at", "side"], entries.join(groups_of, "channel"), pieces)
    inside = Window.partitionBy("__part", *KEY).orderBy("at", "side").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("piece", ignorenulls=True)
    ended = placed.groupBy("__part", *KEY).agg(F.max_by("piece", F.when(F.col("piece").isNotNull(), F.col("at"))).alias("ended"))
    before = ended.select("__part", *KEY, F.last("ended", ignorenulls=True).over(earlier_ranges(KEY)).alias("before"))
    met = carried(dealt.withColumn("own", last.over(inside)), before, KEY).withColumn("in", F.coalesce("own", "before"))
    reaches = (F.col("at") > F.col("in.lo")) | ((F.col("at") == F.col("in.lo")) & ~F.col("in.lo_open"))
    ends = (F.col("at") < F.col("in.hi")) | ((F.col("at") == F.col("in.hi")) & ~F.col("in.hi_open"))
    return met.filter((F.col("side") == 1) & reaches & ends).select(*KEY, F.col("at").alias("msg_id"))


def pending_intervals(delivered: DataFrame, acked: DataFrame) -> DataFrame:
    """Pieces of what was delivered and is not acknowledged."""
    return without(settled(merged(delivered)), settled(merged(acked)))
