"""Queue changes per time window from streams of arrivals and acknowledgements."""

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def change_stream(arrivals: DataFrame, acks: DataFrame, every: str) -> DataFrame:
    """Arrivals minus acknowledgements, as rows (channel, window_start, change) in append mode.

    A window's change is the sum of its rows: each task of a micro-batch adds up its own, and a late row is one more row, a correction of the
    window it belongs to. So there is no watermark that would drop it, and no state; the sink's log makes a repeated micro-batch harmless.
    """
    deltas = arrivals.select("channel", F.col("ts").alias("at"), F.lit(1).alias("d")).unionByName(
        acks.select("channel", F.col("acked_at").alias("at"), F.lit(-1).alias("d")))
    slots = deltas.select("channel", F.window(F.col("at").cast("timestamp"), every)["start"].alias("window_start"), F.col("d").cast("long").alias("change"))

    def summed(batches):
        for batch in batches:
            by = pa.Table.from_batches([batch]).group_by(["channel", "window_start"]).aggregate([("change", "sum")])
            yield from by.rename_columns(["channel", "window_start", "change"] if by.column_names[0] == "channel" else
                                         ["change", "channel", "window_start"]).select(["channel", "window_start", "change"]).to_batches()

    return slots.mapInArrow(summed, "channel string, window_start timestamp, change long")


def depth_of(changes: DataFrame, per_worker: int) -> DataFrame:
    """Depth per channel at the end of each window, and workers wanted, from the rows of ``change_stream``'s sink: what ``queue_depth``
    makes of the whole log."""
    slots = changes.groupBy("channel", "window_start").agg(F.sum("change").alias("change"))
    running = Window.partitionBy("channel").orderBy("window_start").rowsBetween(Window.unboundedPreceding, 0)
    return slots.withColumn("depth", F.sum("change").over(running)).withColumn(
        "workers", F.ceil(F.greatest("depth", F.lit(0)) / per_worker))
