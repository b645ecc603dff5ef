"""Near duplicates by SimHash fingerprints, with meet-in-the-middle ball hashing."""

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.components import components
from sheaf.llm.rows import ROW, content_hash, whole
from sheaf.session import settled

SHINGLE, SEED, AT_ONCE = 3, 42, 1 << 16


def fingerprint(text: bytes) -> int:
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(SHINGLE, len(words))
    starts, ends = starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for i in range(0, len(starts), AT_ONCE):
        part = b"".join([digest(joined[s:e], SEED) for s, e in zip(starts[i : i + AT_ONCE], ends[i : i + AT_ONCE])])
        ones += np.unpackbits(np.frombuffer(part, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(starts)).tobytes(), "big", signed=True)


@F.arrow_udf(T.LongType())
def fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts.cast(pa.large_binary())], pa.int64())


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def near_pairs(fps: DataFrame, fp: str) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough to connect all that differ in 2 bits or fewer.

    Every fingerprint sends all variants within half the radius, itself and its 64 one-bit flips, to a shuffle on the
    variant; two fingerprints within the radius share a variant. As ``fps`` are distinct, a variant's fingerprints are
    told apart by the flipped bit, so a group is one 64-bit set, filled by map-side combine, and never over 65 members.
    Each group gives links from one member to the others, not all pairs.
    """
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << i if i < 63 else -(1 << 63)).cast("long") for i in range(64)])
    balls = fps.select(fp, F.explode(flips).alias("flip")).select(F.col(fp).bitwiseXOR(F.col("flip")).alias("variant"), "flip")
    met = (
        balls.groupBy("variant").agg(F.bit_or("flip").alias("bits"), F.max(F.col("flip") == 0).alias("itself"))
        .filter(F.bit_count("bits") + F.col("itself").cast("int") > 1)
    )
    lowest = F.col("bits").bitwiseAND(-F.col("bits"))
    one = F.col("variant").bitwiseXOR(F.when(F.col("itself"), F.lit(0).cast("long")).otherwise(lowest))
    links = met.select(
        one.alias("a"), "variant", F.explode(F.filter(flips, lambda m: m.bitwiseAND(F.col("bits")) != 0)).alias("flip"),
    ).select("a", F.col("variant").bitwiseXOR(F.col("flip")).alias("b"))
    pairs = links.filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2))
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id linked over any steps.

    A null or empty text, and one of white space only, has fingerprint zero and is linked as any other. Repeated rows
    and ids each give a row. A null id keeps its row and counts for no component's smallest id. No rows give no rows.
    """
    prints = settled(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text)).alias("fp")))
    firsts = settled(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(near_pairs(firsts, "fp"), "a", "b")
    labelled = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("label"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    of = labelled.join(smallest, "label").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row with the smallest id.

    A repeated smallest id keeps one of its rows, which is the same one on each run: the one with the smallest hash of
    its content. Rows with a null id count as after all others. Other columns may have any names and types.
    """
    key = ["id", "none", "hash"]
    marked = docs.select(
        whole(docs), F.col(text).alias("text"), F.col(doc_id).isNull().alias("none"), content_hash(docs).alias("hash"), F.col(doc_id).alias("id"))
    # a null id meets its own kind by the next column
    least = F.lit(0).cast(marked.schema["id"].dataType) if isinstance(marked.schema["id"].dataType, T.NumericType) else F.lit("").cast(marked.schema["id"].dataType)
    marked = marked.withColumn("id", F.coalesce("id", least))
    prints = settled(marked.select(*key, fingerprints(F.col("text")).alias("fp")))
    firsts = settled(prints.groupBy("fp").agg(F.min(F.struct("none", "id", "hash")).alias("first")))
    roots = components(near_pairs(firsts, "fp"), "a", "b")
    labelled = firsts.join(roots, F.col("fp") == F.col("node"), "left").select("first", F.coalesce("root", "fp").alias("label"))
    kept = labelled.groupBy("label").agg(F.min("first").alias("first")).select("first.*")
    equal_rows = Window.partitionBy(*key).orderBy("hash")
    return (
        marked.drop("text").join(kept, key, "left_semi").withColumn("n", F.row_number().over(equal_rows))
        .filter(F.col("n") == 1).select(f"{ROW}.*")
    )
