"""Lookups that stay even when one key holds a large share of the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.session import plan_bytes

CHECK_ABOVE_BYTES = 1 << 30
HOT_SHARE = 1000
WAYS = 256


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: str,
    spread_by: str,
    check_above: int = CHECK_ABOVE_BYTES,
) -> DataFrame:
    """``left`` left-joined to ``right``, which has at most one row per ``on``.

    Above ``check_above`` bytes the keys with more than a 1/1000 share of ``left`` are found
    first (fewer than 1000 by definition). Their left rows are dealt over 256 salts by the
    hash of ``spread_by``, and their one right row is repeated per salt. All other
    keys keep salt 0, so nothing else is repeated.
    """
    if plan_bytes(left) < check_above:
        return left.join(right, on, "left")
    hot = hot_keys(left, on)
    if not hot:
        return left.join(right, on, "left")
    is_hot = F.col(on).isin(hot)
    salt = F.when(is_hot, F.pmod(F.xxhash64(spread_by), F.lit(WAYS))).otherwise(F.lit(0))
    salts = F.when(is_hot, F.sequence(F.lit(0), F.lit(WAYS - 1))).otherwise(F.array(F.lit(0)))
    return (
        left.withColumn("_salt", salt.cast("int"))
        .join(right.withColumn("_salt", F.explode(salts)), [on, "_salt"], "left")
        .drop("_salt")
    )


def hot_keys(df: DataFrame, key: str) -> list:
    """Keys holding more than 1/1000 of the rows: fewer than 1000 values."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    total = df.count()
    return [r[0] for r in counts.filter(F.col("n") > max(total // HOT_SHARE, 1)).select(key).collect()]
