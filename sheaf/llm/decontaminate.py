"""Benchmark passages in documents, by a prefix-filtered join of word shingles and an exact check."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.rows import ROW, whole
from sheaf.llm.words import ALNUM, Words, chunks, texts_of
from sheaf.session import few_rows, settled

WINDOW, SHINGLE = 13, 5
#: Bits of the filter of known shingles, at any size of the benchmark: 2 MB.
FILTER_BITS = 1 << 24


def cut(data: np.ndarray, w: Words) -> list[bytes]:
    raw = w.bytes.tobytes()
    return [raw[s:e] for s, e in zip(w.starts.tolist(), w.ends.tolist())]


def item_windows(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item, window, k, shingles): the windows of each item, and the hashes of their shingles in order."""

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for at, to in chunks(offsets):
                w = Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], ALNUM)
                words, hashes = cut(data, w), w.hashes()
                grams = {}
                out = {"item": [], "window": [], "k": [], "shingles": []}
                for i in range(to - at):
                    first, n = int(w.first[i]), int(w.counts[i])
                    k = min(WINDOW, n)
                    size = min(SHINGLE, n)
                    if n and size not in grams:
                        h, where = w.grams(hashes, size)
                        grams[size] = dict(zip(where.tolist(), h.view(np.int64).tolist()))
                    for s in range(first, first + n - k + 1 if n else first):
                        out["item"].append(batch.column(0)[at + i].as_py())
                        out["window"].append(b" ".join(words[s : s + k]).decode())
                        out["k"].append(k)
                        out["shingles"].append([grams[size][s + j] for j in range(k - size + 1)])
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                    ("item", pa.string()), ("window", pa.string()), ("k", pa.int32()), ("shingles", pa.list_(pa.int64()))]))

    rows = items.select(F.col(item_id).cast("string"), F.col(text))
    return rows.mapInArrow(run, "item string, window string, k int, shingles array<long>")


def shingle_filter(hashes: DataFrame, name: str) -> np.ndarray:
    """A Bloom filter of fixed size, gathered as 64-bit pieces: a quarter million numbers at the most."""
    h = F.col(name)
    probes = F.explode(F.array(*[F.shiftrightunsigned(h, 24 * i).bitwiseAND(F.lit(FILTER_BITS - 1)) for i in range(2)]))
    pieces = (
        hashes.select(probes.alias("bit")).groupBy(F.shiftright("bit", 6).alias("piece"))
        .agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toPandas()
    )
    bits = np.zeros(FILTER_BITS // 64, np.int64)
    bits[pieces["piece"].to_numpy(np.int64)] = pieces["bits"].to_numpy(np.int64)
    return bits


def may_hold(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    found = np.ones(len(h), bool)
    for i in range(2):
        bit = (h >> np.uint64(24 * i)) & np.uint64(FILTER_BITS - 1)
        found &= (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)).astype(np.int64)) & 1 == 1
    return found


def scanned(docs: DataFrame, doc_id: str, text: str, sizes: list[int], bits) -> DataFrame:
    """(key, doc_id, n_words, text, shingles) per row; the text and its shingles that pass the filter, else nulls."""

    def run(batches):
        known = bits.value
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            for at, to in chunks(offsets):
                w = Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], ALNUM)
                hashes, found = w.hashes(), {}
                for size in sizes:
                    h, where = w.grams(hashes, size)
                    hit = may_hold(known, h)
                    for i, x in zip(w.text[where[hit]].tolist(), h[hit].view(np.int64).tolist()):
                        found.setdefault(i, set()).add(x)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), pa.array(w.counts, pa.int64()),
                    pa.array([t if i in found else None for i, t in enumerate(part.column(2))], pa.string()),
                    pa.array([sorted(found[i]) if i in found else None for i in range(to - at)], pa.list_(pa.int64())),
                ], names=["key", "doc_id", "n_words", "text", "shingles"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"key long, doc_id {kind}, n_words long, text string, shingles array<long>")


def contexts(hits: DataFrame, sizes: list[int], bits) -> DataFrame:
    """(key, n_words, shingle, at, since, words): each place of a prefix token, with the words that a window there can cover."""

    def run(batches):
        known = bits.value
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            for at, to in chunks(offsets):
                w = Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], ALNUM)
                words, hashes = cut(data, w), w.hashes()
                for size in sizes:
                    h, where = w.grams(hashes, size)
                    hit = may_hold(known, h)
                    h, where = h[hit].view(np.int64), where[hit]
                    text = w.text[where]
                    first, last = w.first[text], w.first[text + 1]
                    since = np.maximum(first, where - WINDOW + size)
                    until = np.minimum(last, where + WINDOW)
                    for i in range(0, len(h), 10_000):
                        p = slice(i, i + 10_000)
                        yield pa.RecordBatch.from_arrays([
                            batch.column(0).take(pa.array(at + text[p])), pa.array(w.counts[text[p]], pa.int64()),
                            pa.array(h[p]), pa.array((where - first)[p], pa.int64()), pa.array((since - first)[p], pa.int64()),
                            pa.array([[x.decode() for x in words[a:b]] for a, b in zip(since[p].tolist(), until[p].tolist())], pa.list_(pa.string())),
                        ], names=["key", "n_words", "shingle", "at", "since", "words"])

    return hits.select("key", "n_words", "text").mapInArrow(
        run, "key long, n_words long, shingle long, at long, since long, words array<string>")


def occurrences(docs: DataFrame, items: DataFrame, doc_id: str, text: str, item_id: str, item_text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The scanned rows, (key, window, start, k) of each occurrence of an item window, and (window, item).

    A containment of 1 asks for every shingle of a window, so one token is prefix enough: the one that the fewest documents
    have. Documents pass a filter of fixed size for any benchmark shingle; those few are counted over all documents, each
    window takes its rarest, and only places of these meet the windows, by hash. The place must leave room
    for the window in the document (length and positional bounds), and all its words must be the window's. Windows with
    a shingle that no document has are dropped with it.
    """
    spark = docs.sparkSession
    windows = settled(item_windows(items, item_id, item_text))
    sizes = sorted(min(SHINGLE, r["k"]) for r in windows.select(F.least("k", F.lit(SHINGLE)).alias("k")).distinct().collect())
    tokens = settled(windows.groupBy("window").agg(F.first("k").alias("k"), F.first("shingles").alias("shingles")))
    exploded = tokens.select("window", "k", F.posexplode("shingles").alias("offset", "shingle"))
    seen = settled(scanned(docs, doc_id, text, sizes, spark.sparkContext.broadcast(shingle_filter(exploded, "shingle"))))
    hits = seen.filter(F.col("shingles").isNotNull())
    frequency = hits.select(F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("df"))
    rarest = F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "offset"))
    prefixes = settled(
        exploded.join(frequency, "shingle", "left").groupBy("window", "k").agg(rarest.alias("token"))
        .filter(F.col("token.df") > 0).select("window", "k", "token.shingle", "token.offset")
    )
    places = contexts(hits, sizes, spark.sparkContext.broadcast(shingle_filter(prefixes, "shingle")))
    start = F.col("at") - F.col("offset")
    there = F.slice("words", (start - F.col("since") + 1).cast("int"), F.col("k"))
    found = (
        places.join(prefixes, "shingle")
        .filter((start >= F.col("since")) & (start + F.col("k") <= F.col("n_words")))
        .filter(F.array_join(there, " ") == F.col("window"))
        .select("key", "window", start.alias("start"), "k")
    )
    return seen, settled(found), windows.select("window", "item").distinct()


def judged(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated (and key, a row number).

    A word is hit when an occurrence of an item window covers it; contaminated is a twentieth of all words, or more. A
    null or empty text has no words and is clean; a null or empty item has no windows; a repeated item counts once; an
    item with a null id is found, and not listed. Without items all is clean; repeated rows each get a row.
    """
    seen, found, items_of = occurrences(docs, items, doc_id, text, item_id, item_text)
    step = F.struct(F.col("start").alias("s"), (F.col("start") + F.col("k")).alias("e"))
    covered = F.aggregate(
        F.array_sort(F.collect_list(step)), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["e"] - F.greatest(a["to"], x["s"]))).alias("n"), F.greatest(a["to"], x["e"]).alias("to")),
    )["n"]
    hit = found.groupBy("key").agg(covered.alias("n_hit"))
    # many documents have the same windows, so items are listed once for each set of windows and brought to them by its digest
    places = settled(found.groupBy("key").agg(F.array_sort(F.collect_set("window")).alias("windows")).withColumn(
        "of", F.sha2(F.to_json("windows").cast("binary"), 256)))
    sets = places.groupBy("of").agg(F.first("windows").alias("windows")).select("of", F.explode("windows").alias("window"))
    lists = sets.join(items_of, "window").groupBy("of").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    listed = places.select("key", "of").join(lists, "of").drop("of")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return (
        seen.select("key", "doc_id", "n_words").join(hit, "key", "left").join(listed, "key", "left")
        .select(
            "key", "doc_id", "n_words", n_hit.alias("n_hit"), F.size(ids).cast("long").alias("n_items"),
            F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
            ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
        )
    )


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated. Few rows are: only those go through the last join's small side. Other columns may
    have any names and types."""
    marked = docs.select(whole(docs), F.col(doc_id).alias("id"), F.xxhash64(F.col(text)).alias("hash"), F.col(text).alias("text"))
    named = marked.select(F.struct("id", "hash").alias("name"), "text")
    bad = judged(named, items, "name", "text", item_id, item_text).filter("contaminated").select(
        F.col("doc_id.id").alias("bad"), F.col("doc_id.hash").alias("bad_hash")).distinct()
    same = F.col("id").eqNullSafe(F.col("bad")) & (F.col("hash") == F.col("bad_hash"))
    return marked.join(few_rows(settled(bad)), same, "left_anti").select(f"{ROW}.*")
