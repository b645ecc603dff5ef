"""Quantiles by rank are those of percentile."""

from pyspark.sql import functions as F

from sheaf.functions.ranking import quantiles


def test_as_percentile(spark):
    shares = [0.0, 0.3, 0.5, 0.6, 1.0]
    for values in ([1, 5, 2, None, 9, 2, 2], [3], [4, 1], [7, 7, 7, None]):
        df = spark.createDataFrame([(v,) for v in values], "v long")
        assert quantiles(df, F.col("v"), shares) == df.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]
    many = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("v"))
    assert quantiles(many, F.col("v"), shares) == many.agg(F.percentile("v", F.array(*map(F.lit, shares)))).first()[0]


def test_no_values(spark):
    assert quantiles(spark.createDataFrame([(None,)], "v long"), F.col("v"), [0.3, 0.6]) == [None, None]
