"""Topic logs: Kafka where the connector is installed, else Parquet folders by topic.

Both have the columns of Spark's Kafka source (topic, key, value, partition, offset, timestamp).
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.schema import LOG, TOPICS


#: Per topic and partition the last offset that was read.
Positions = dict[str, dict[int, int]]


def read_log(spark: SparkSession, path: str, topics: list[str] | None = None, stream: bool = False, after: Positions | None = None) -> DataFrame:
    """Entries of the given topics (all by default); other topics' folders are not read. ``after`` starts behind positions, of a batch
    or a new stream; partitions it does not name are read from the start."""
    reader = spark.readStream if stream else spark.read
    log = reader.schema(LOG).parquet(path)
    log = log if topics is None else log.filter(F.col("topic").isin(topics))
    if after is None:
        return log
    if stream:
        return behind(log, after)
    # a topic at a time, as the folder and the columns in it are pruned by separate filters
    rest = log.filter(~F.col("topic").isin(list(after)))
    return reduce(DataFrame.unionByName, [behind(log.filter(F.col("topic") == t), {t: of}, of_one_topic=True) for t, of in after.items()], rest)


def behind(log: DataFrame, after: Positions, of_one_topic: bool = False) -> DataFrame:
    """Entries behind the positions. Of one topic, the filters reach the scan: files whose greatest offset is not behind them are skipped."""
    for topic, partitions in after.items():
        for partition, offset in partitions.items():
            passed = (F.col("partition") != partition) | (F.col("offset") > offset)
            log = log.filter(passed if of_one_topic else (F.col("topic") != topic) | passed)
    return log


def positions(log: DataFrame, after: Positions | None = None) -> Positions:
    """The last offset of each topic and partition, not before ``after``: one number for each goes to the driver."""
    out = {topic: dict(of) for topic, of in (after or {}).items()}
    for topic, partition, last in log.groupBy("topic", "partition").agg(F.max("offset")).collect():
        of = out.setdefault(topic, {})
        of[partition] = max(last, of.get(partition, last))
    return out


def read_kafka(spark: SparkSession, servers: str, topics: list[str], stream: bool = False,
               starting: str = "earliest") -> DataFrame:
    """The same from Kafka; needs the spark-sql-kafka package."""
    reader = spark.readStream if stream else spark.read
    return (reader.format("kafka").option("kafka.bootstrap.servers", servers)
            .option("subscribe", ",".join(topics)).option("startingOffsets", starting).load()
            .select(*LOG.fieldNames()))


def entries(df: DataFrame, topic: Column, key: Column, value: Column, offset: Column, timestamp: Column,
            partitions: int = 8, topics: list[str] | None = None) -> DataFrame:
    """Rows as log entries. A key fixes the partition, a null key spreads by offset; a topic
    that is not one of ``topics`` fails the job."""
    known = list(TOPICS.values()) if topics is None else topics
    bad = F.raise_error(F.concat(F.lit("unknown topic: "), F.coalesce(topic, F.lit("null")))).cast("string")
    place = F.pmod(F.when(key.isNull(), F.xxhash64(offset)).otherwise(F.xxhash64(key)), F.lit(partitions))
    return df.select(
        F.when(topic.isin(known), topic).otherwise(bad).alias("topic"),
        key.cast("binary").alias("key"), value.alias("value"),
        place.cast("int").alias("partition"),
        offset.cast("long").alias("offset"), timestamp.cast("timestamp").alias("timestamp"))


def produce(log: DataFrame, path: str) -> None:
    """Appends entries by topic. Rebalancing lets AQE cut a large topic into several files
    and keep small ones whole."""
    log.hint("rebalance", "topic").write.mode("append").partitionBy("topic").parquet(path)


def produce_kafka(log: DataFrame, servers: str) -> None:
    log.select("topic", "key", "value").write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def enqueue(df: DataFrame, queue: Column, item: Column, seq: Column) -> DataFrame:
    """Rows as items (queue, seq, item) of named first-in first-out queues."""
    return df.select(queue.alias("queue"), seq.cast("long").alias("seq"), item.alias("item"))


def append_queue(items: DataFrame, path: str) -> None:
    items.hint("rebalance", "queue").write.mode("append").partitionBy("queue").parquet(path)
