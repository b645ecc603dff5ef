"""Mixing sources to target weights by Poisson replication."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.llm.rows import numbered
from sheaf.session import few_rows, range_parts, settled

SEED, POWER, HASH_BITS = "mix-1", 0.5, 52
#: A rate above this is the sum of so many even parts that none is above it.
MOST_RATE = 500
#: Copies of a row are dealt out in blocks of so many, as an array of all of them need not fit in memory.
BLOCK = 1 << 16


def hashed(*parts: Column) -> Column:
    """A whole number below 2^52, as even as md5 is, from texts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def row_key(doc_id: str, text: str) -> Column:
    """The id as text; of a null id, a hash of the text."""
    return F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("null-"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))


def rates(docs: DataFrame, source: str, text: str, weights: dict | None, epochs: float) -> DataFrame:
    """(source, rate): how often a document of the source is to come, on average.

    A source's share of the mixed characters is its weight's share; without weights, that of the square root of its size.
    Sources that no weight names, and those without any character, have rate 0. The total is ``epochs`` times the input's.
    The sizes are summed once and kept, one row for each source.
    """
    sizes = docs.groupBy(F.col(source).alias("__source")).agg(F.sum(F.coalesce(F.length(text), F.lit(0))).cast("double").alias("__size"))
    sizes = settled(sizes)
    if weights is None:
        wish = F.pow("__size", F.lit(POWER))
    else:
        named = F.create_map(*[F.lit(x) for kv in weights.items() for x in (kv[0], float(kv[1]))]) if weights else F.lit(None).cast("map<string,double>")
        wish = F.coalesce(named[F.col("__source").cast("string")], F.lit(0.0))
    wished = sizes.withColumn("__wish", F.when(F.col("__size") > 0, wish).otherwise(0.0))
    total = wished.agg(F.sum("__size").alias("size"), F.sum("__wish").alias("wish")).first()
    share = F.col("__wish") / F.lit(total["wish"] or 1.0)
    rate = F.when(F.col("__size") > 0, share * F.lit(epochs * (total["size"] or 0.0)) / F.col("__size")).otherwise(0.0)
    return wished.select("__source", rate.alias("__rate"))


def steps(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... as far as a number below 1 - 2^-53 can reach."""
    last = F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")
    zero = F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("sum"), F.array(F.exp(-rate)).alias("all"))

    def more(a, j):
        p = a["p"] * rate / j
        return F.struct(p.alias("p"), (a["sum"] + p).alias("sum"), F.array_append(a["all"], a["sum"] + p).alias("all"))

    return F.aggregate(F.sequence(F.lit(1), last), zero, more)["all"]


def mixed(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
    weights: dict | None = None, epochs: float = 1.0, seed: str = SEED,
) -> DataFrame:
    """The rows of ``docs``, each as often as a Poisson number with its source's rate, in a global random order.

    Adds ``copy``, from 1, and ``order_key``, by which the rows are placed and sorted (columns of these names are replaced). The number is the inverse of the
    distribution function at a hash of the seed and the row's id (of a null id, its text), so a lost task gives the same rows again;
    repeated rows come equally often. A null source is a source; null and empty texts have no size and come as
    their source's do. Of a rate above 500, which a source that is small beside the others has, the number is the sum of
    independent Poisson numbers of even parts of the rate, each the inverse at a hash of its own; so there is no
    highest rate, up to the 2^31 that ``copy`` can count. Only the sources' rates are joined, broadcast if
    few; the global order needs no sampling, as hashes are even: one shuffle. Other columns may have any names and types.
    """
    key = row_key(doc_id, text)
    parts = F.greatest(F.lit(1), F.ceil(F.col("__rate") / MOST_RATE)).cast("int")
    table = rates(docs, source, text, weights, epochs).select("__source", parts.alias("__parts"), steps(F.col("__rate") / parts).alias("__steps"))

    def u(draw, of=key):
        return (hashed(F.lit(seed), draw, of) + 0.5) / F.lit(float(1 << HASH_BITS))

    def drawn(at):
        return F.size(F.filter("__steps", lambda c: c <= at)).cast("long")

    kept, made = F.col("__key"), ["copy", "order_key"]
    names = list(dict.fromkeys([*docs.columns, *made]))
    more = F.aggregate(F.sequence(F.lit(1), F.col("__parts") - 1), F.lit(0).cast("long"), lambda n, i: n + drawn(u(F.concat(F.lit("n"), i.cast("string")), kept)))
    first = F.col("__block") * BLOCK
    counted = (
        docs.select(*numbered(docs), F.col(source).alias("__of"), key.alias("__key"), u(F.lit("n")).alias("__u"))
        .join(few_rows(table), F.col("__of").eqNullSafe(F.col("__source")))
        .withColumn("__n", drawn(F.col("__u")) + F.when(F.col("__parts") > 1, more).otherwise(0))
        .filter(F.col("__n") > 0)
        .withColumn("__block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / BLOCK))))
        .withColumn("copy", F.explode(F.sequence((first + 1).cast("int"), F.least(first + BLOCK, F.col("__n")).cast("int"))))
        .withColumn("order_key", hashed(F.lit(seed), F.lit("order"), F.col("__key"), F.col("copy").cast("string")))
        .select(*[c if c in made else f"c{docs.columns.index(c)}" for c in names])
    )
    n = range_parts(docs)
    place = F.floor(F.col("order_key") / F.lit(float(1 << HASH_BITS)) * n).cast("int")
    return counted.repartitionById(n, place).sortWithinPartitions("order_key", "copy").toDF(*names)
