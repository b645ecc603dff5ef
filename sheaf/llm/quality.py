"""A quality score by hashed word n-grams and logistic regression, fitted by follow-the-regularised-leader updates."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm.words import NON_SPACE, Words, chunks, texts_of

#: Fixed size of the model, and how many labelled rows it is fitted on at the most, over how many fits.
BUCKETS, MOST_ROWS, FITS, ROUNDS = 1 << 18, 8_000, 4, 3
ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.05, 0.1
#: Word bytes of two kinds: letters with digits, and signs, so that signs at a word are words of their own.
KINDS = np.array([0 if not NON_SPACE[b] else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)
CRC_PARTS, HELD_OUT = 3, 1


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1- and 2-grams of the texts, and the text each belongs to.

    All 2-grams of a word and itself, and all words that begin with two capitals, have a bucket more, each one.
    """
    w = Words(data, offsets, NON_SPACE, KINDS)
    hashes = w.hashes()
    capital = np.append((data >= 65) & (data <= 90), False)
    loud = np.flatnonzero(capital[w.starts] & capital[w.starts + 1] & (w.ends - w.starts > 1))
    twice = np.flatnonzero((hashes[1:] == hashes[:-1]) & (w.text[1:] == w.text[:-1]))
    buckets, text = [np.zeros(len(loud), np.int64), np.ones(len(twice), np.int64)], [w.text[loud], w.text[twice]]
    for k in (1, 2):
        h, at = w.grams(hashes, k)
        buckets.append((h >> np.uint64(46)).astype(np.int64))
        text.append(w.text[at])
    return np.concatenate(buckets), np.concatenate(text)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]]) -> np.ndarray:
    """Weights by per-coordinate FTRL-proximal updates over the rows in order; the last is the bias."""
    z, n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(i):
        return np.where(np.abs(z[i]) <= L1, 0.0, (np.sign(z[i]) * L1 - z[i]) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(ROUNDS):
        for i, x, y in rows:
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -30, 30))) - y) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA * w
            n[i] += g * g
    return weights(np.arange(BUCKETS + 1))


@F.arrow_udf(T.BinaryType())
def packed(texts: pa.Array) -> pa.Array:
    """Each text's buckets, as 32-bit numbers, and behind them as many 32-bit values: its counts over the root of their sum."""
    out = []
    data, offsets = texts_of(texts)
    for at, to in chunks(offsets):
        buckets, text = features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        order = np.argsort(text, kind="stable")
        edges = np.searchsorted(text[order], np.arange(to - at + 1))
        for j in range(to - at):
            own, count = np.unique(buckets[order[edges[j] : edges[j + 1]]], return_counts=True)
            out.append(own.astype("<i4").tobytes() + (count / np.sqrt(max(1, count.sum()))).astype("<f4").tobytes())
    return pa.array(out, pa.binary())


def unpacked(row: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a packed row, and behind them the bias's."""
    half = len(row) // 8
    return np.append(np.frombuffer(row, "<i4", half), BUCKETS), np.append(np.frombuffer(row, "<f4", half, half * 4), 1.0)


def fitted(part: pa.Table) -> pa.Table:
    """One part of the sample, (row, y, at, part), to one row: how many rows it has, and its weights that are not zero, packed."""
    part = part.sort_by([("at", "ascending"), ("row", "ascending")])
    w = fit([(*unpacked(row), y) for row, y in zip(part["row"].to_pylist(), part["y"].to_pylist())])
    at = np.flatnonzero(w)
    return pa.table({"n": pa.array([len(part)], pa.int64()), "buckets": pa.array([at.astype("<i4").tobytes()]), "weights": pa.array([w[at].astype("<f8").tobytes()])})


def part_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 3; of a null id that of an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % CRC_PARTS


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = MOST_ROWS) -> np.ndarray:
    """Weights from a sample of up to ``most`` labelled documents outside the held-out part.

    The sample is the labelled ids with the smallest hashes, so it is the same on each run, and of rows that share an id
    the one whose text has the smallest hash, so it has no more rows than ids. A hash of the id deals it to ``FITS`` parts that
    each fit a model, and the models are averaged by the rows they were fitted on: so the weights do not depend on how
    rows are partitioned. Tasks get the rows' buckets, not their texts: at most 2 MB a row, however long its text. Up to ``FITS``
    rows of packed weights reach the driver. Null labels and ids labelled both ways are left out; without any label all
    weights are zero, and all scores 0.5.
    """
    known = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(label).isin(0, 1) & (part_of(F.col(doc_id)) != HELD_OUT))
        .groupBy(F.col(doc_id).alias("id")).agg(F.min(label).alias("y"), F.max(label).alias("most"))
        .filter(F.col("y") == F.col("most")).select("id", F.col("y").cast("int"), F.xxhash64("id").alias("at"))
        .orderBy("at", "id").limit(most)
    )
    sample = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).join(F.broadcast(known), "id")
    sample = sample.groupBy("id", "y", "at").agg(F.min(F.struct(F.xxhash64("text").alias("hash"), "text"))["text"].alias("text"))
    models = (
        sample.select(packed("text").alias("row"), "y", "at", F.pmod("at", F.lit(FITS)).alias("part"))
        .groupBy("part").applyInArrow(fitted, "n long, buckets binary, weights binary").collect()
    )
    out = np.zeros(BUCKETS + 1)
    for m in models:
        out[np.frombuffer(m["buckets"], "<i4")] += np.frombuffer(m["weights"], "<f8") * (m["n"] / sum(x["n"] for x in models))
    return out


def scorer(docs: DataFrame, weights: np.ndarray):
    """A column function: the score of a text, from 0 to 1. A null or empty text is scored by the bias alone."""
    held = docs.sparkSession.sparkContext.broadcast(weights)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        w, out = held.value, np.zeros(len(texts))
        data, offsets = texts_of(texts)
        for at, to in chunks(offsets):
            buckets, text = features(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
            total = np.bincount(text, w[buckets], to - at)
            out[at:to] = total / np.sqrt(np.maximum(1, np.bincount(text, minlength=to - at)))
        return pa.array(1 / (1 + np.exp(-np.clip(out + w[-1], -30, 30))))

    return score


def scored(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; repeated rows each get a row."""
    score = scorer(docs, train(docs, labels, doc_id, text))
    return docs.select(
        F.col(doc_id).alias("doc_id"), (part_of(F.col(doc_id)) == HELD_OUT).alias("held_out"), score(F.col(text)).alias("score"),
    ).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def accepted(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` scored 0.5 or more, with all their columns, whatever these are named."""
    score = scorer(docs, train(docs, labels, doc_id, text))
    return docs.filter(score(F.col(text)) >= 0.5)
