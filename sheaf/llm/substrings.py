"""Long passages repeated across documents, by a compacted De Bruijn graph of word windows, and their removal."""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.llm.words import NON_SPACE, Words, chunks, texts_of
from sheaf.session import few_rows, settled

#: Words of a window, and of the anchors by which windows are preselected.
WINDOW, ANCHOR = 50, 20


class Windows:
    """All windows of ``size`` words of some texts, as edges between the hashes of their first and last ``size`` - 1 words.

    A window's anchor is the least hash of the shorter ones in it: equal windows have equal anchors, and neighbours mostly share one.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        self.words = w = Words(data, offsets, NON_SPACE)
        hashes, short = w.hashes(), min(ANCHOR, size)
        nodes, at = w.grams(hashes, size - 1)
        node = np.zeros(len(hashes) + 1, np.uint64)
        node[at] = nodes
        n = len(hashes) - size + 1
        self.at = np.flatnonzero(w.text[:n] == w.text[size - 1 :]) if n > 0 else np.zeros(0, np.int64)
        self.text, self.pos = w.text[self.at], self.at - w.first[w.text[self.at]]
        self.left, self.right = node[self.at].view(np.int64), node[self.at + 1].view(np.int64)
        gram, at = w.grams(hashes, short)
        least = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
        least[at] = gram
        span, of = 1, size - short + 1
        while span < of:
            step = min(span, of - span)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            span += step
        self.anchor = least[self.at].view(np.int64) if len(self.at) else np.zeros(0, np.int64)

    def anchors(self) -> list[np.ndarray]:
        """The distinct anchors of each text."""
        new = np.ones(len(self.at), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.text[1:] != self.text[:-1])
        text, anchor = self.text[new], self.anchor[new]
        edges = np.searchsorted(text, np.arange(self.words.n + 1))
        return [np.unique(anchor[a:b]) for a, b in zip(edges[:-1], edges[1:])]

    def firsts(self, of: np.ndarray) -> np.ndarray:
        """For each of the windows ``of``, which of them is the first one in its text with the same words."""
        order = np.lexsort((self.right[of], self.left[of], self.text[of]))  # stable, so by position at last
        same = np.zeros(len(order), bool)
        for x in (self.text, self.left, self.right):
            y = x[of][order]
            same[1:] = (y[1:] == y[:-1]) & (same[1:] if x is not self.text else True)
        out = np.empty(len(order), np.int64)
        out[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        return out


def named(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(id, h, text): rows with the same id and text give the same result, so both name a row."""
    return docs.select(F.col(doc_id).alias("id"), F.xxhash64(F.col(text).cast("string")).alias("h"), F.col(text).cast("string").alias("text"))


def anchored(rows: DataFrame, size: int) -> DataFrame:
    """(id, h, anchors) of each row."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(2))
            for at, to in chunks(offsets):
                w = Windows(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], size)
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(w.anchors(), pa.list_(pa.int64()))], names=["id", "h", "anchors"])

    return rows.mapInArrow(run, f"id {kind}, h long, anchors array<long>")


def same(a: Column, b: Column) -> Column:
    return a.eqNullSafe(b)


def suspects(rows: DataFrame, size: int) -> DataFrame:
    """(id, h, tag, anchors): the rows that share an anchor with another id's, and these anchors.

    ``tag`` is 0 where the id names one text, else ``h``, as it is for rows without an id.
    """
    prints = settled(anchored(rows, size))
    several = prints.groupBy("id").agg((F.min("h") != F.max("h")).alias("several")).filter("several").select("id")
    places = prints.select("id", "h", F.explode("anchors").alias("anchor"))
    shared = (
        places.groupBy("anchor").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), (F.count("*") > F.count("id")).alias("unnamed"))
        .filter((F.col("lo") < F.col("hi")) | F.col("lo").isNotNull() & F.col("unnamed")).select("anchor")
    )
    found = places.join(shared, "anchor").groupBy("id", "h").agg(F.collect_set("anchor").alias("anchors"))
    twice = settled(several).withColumn("twice", F.lit(True))
    tagged = found.join(few_rows(twice).withColumnRenamed("id", "other"), F.col("id") == F.col("other"), "left")
    return settled(tagged.select("id", "h", F.when(F.col("id").isNull() | F.col("twice"), F.col("h")).otherwise(F.lit(0).cast("long")).alias("tag"), "anchors"))


def with_rows(rows: DataFrame, of: DataFrame, how: str = "inner") -> DataFrame:
    """Rows joined to a table by (id, h): broadcast if it is few, else both are shuffled."""
    key = of.withColumnsRenamed({"id": "__id", "h": "__h"})
    return rows.join(few_rows(key), same(F.col("id"), F.col("__id")) & (F.col("h") == F.col("__h")), how).drop("__id", "__h")


def windows(rows: DataFrame, suspected: DataFrame, size: int) -> DataFrame:
    """(left, right, id, tag, pos): the distinct windows of each suspected row that have a shared anchor, where they come first."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(3))
            for at, to in chunks(offsets):
                w = Windows(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], size)
                known = batch.column(2).slice(at, to - at).flatten().to_numpy()
                of = np.flatnonzero(np.isin(w.anchor, known))
                of = of[w.firsts(of) == np.arange(len(of))]
                text = pa.array(at + w.text[of])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(w.left[of]), pa.array(w.right[of]), batch.column(0).take(text), batch.column(1).take(text), pa.array(w.pos[of])],
                    names=["left", "right", "id", "tag", "pos"])

    of = with_rows(rows, suspected).select("id", "tag", "anchors", "text")
    return of.mapInArrow(run, f"left long, right long, id {kind}, tag long, pos long")


def graph(edges: DataFrame) -> DataFrame:
    """(left, id, tag, pos, repeated, passed): the edges with their source; ``passed`` tells whether the node before one is
    passed through, with a single repeated edge into it and a single one out of it."""
    repeated = edges.filter("repeated")
    ends = F.explode(F.array(
        F.struct(F.col("left").alias("node"), F.lit(1).alias("out"), F.lit(0).alias("into")),
        F.struct(F.col("right").alias("node"), F.lit(0).alias("out"), F.lit(1).alias("into"))))
    passed = (
        repeated.select(ends.alias("e")).select("e.*").groupBy("node").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
        .filter("out = 1 and into = 1").select("node", F.lit(True).alias("passed"))
    )
    columns = ["left", "id", "tag", "pos", "repeated", "passed"]
    marked = repeated.join(passed, F.col("left") == F.col("node"), "left").withColumn("passed", F.coalesce("passed", F.lit(False)))
    return marked.select(*columns).unionByName(edges.filter("not repeated").withColumn("passed", F.lit(True)).select(*columns))


def compacted(sourced: DataFrame) -> DataFrame:
    """(id, tag, start, n, repeated, check): paths of edges, by their source coordinates.

    An edge is joined to the one before it if their node is passed through and both have neighbouring sources: so a path that does
    not branch is one row for each source it has. ``check`` sums up the nodes, for the source's text to verify.
    """
    order = Window.partitionBy("id", "tag").orderBy("pos")
    before = F.lag(F.struct("pos", "repeated")).over(order)
    joins = F.col("passed") & (before["pos"] == F.col("pos") - 1) & (before["repeated"] == F.col("repeated"))
    begins = F.when(joins, 0).otherwise(1)
    return (
        sourced.withColumn("begins", F.coalesce(begins, F.lit(1))).withColumn("path", F.sum("begins").over(order))
        .groupBy("id", "tag", "path").agg(
            F.min("pos").alias("start"), F.count("*").alias("n"), F.first("repeated").alias("repeated"), F.bit_xor("left").alias("check"))
        .drop("path")
    )


def paths(rows: DataFrame, suspected: DataFrame, size: int) -> DataFrame:
    """The compacted paths of all windows that have a shared anchor, with their sources: (id, tag, start, n, repeated, check).

    The source of an edge is the smallest id that has it, and the place there. For ids that name several texts, and rows without an
    id, the paths are those of each text's own windows that no smaller id has.
    """
    all_windows = windows(rows, suspected, size)
    edges = settled(
        all_windows.groupBy("left", "right").agg(
            F.min("id").alias("id"), F.max("id").alias("last"), F.min_by("pos", "id").alias("pos"), F.min_by("tag", "id").alias("tag"))
        .select("left", "right", "id", "tag", "pos", F.coalesce(F.col("id") < F.col("last"), F.lit(False)).alias("repeated"))
    )
    found = compacted(graph(edges.filter("tag = 0")))
    several = suspected.filter("tag <> 0")
    if several.isEmpty():
        return found
    of = edges.select(F.col("left").alias("l"), F.col("right").alias("r"), F.col("id").alias("source"))
    own = windows(rows, several, size).join(of, (F.col("left") == F.col("l")) & (F.col("right") == F.col("r")) & same(F.col("id"), F.col("source")))
    return found.unionByName(compacted(own.select("left", "id", "tag", "pos", F.lit(False).alias("repeated"), F.lit(True).alias("passed"))))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept) of every row of ``docs``.

    Words are stretches without ASCII white space; a window is ``size`` consecutive words of a row. Words covered by a window that also
    starts in a row with a smaller id are removed: ``spans`` has them as (start, end), ``kept`` the other words joined by one space.

    Windows are edges of a De Bruijn graph, between nodes of one word less; 128 bits tell an edge apart. Only windows whose anchor
    several ids have take part: equal windows have equal anchors, and there are some 16 times fewer anchors than windows. Edges are counted by an
    aggregation with map-side combine, so a window in a third of all rows is one row for each task; nodes that are passed through are found by
    a join, and what compacts there reaches the documents as ranges. A document's windows that no path has its coordinates for
    come from a smaller id. Each path is verified in its source's text.

    Windows of rows with the same id do not remove each other's words. A row without an id comes after all others: it removes
    nothing, and loses the windows of rows with an id. A null or empty text, and one of white space only, has no words and an
    empty ``kept``. Repeated rows each give a row; no rows give no rows.
    """
    rows = named(docs, doc_id, text)
    suspected = suspects(rows, size)
    own = paths(rows, suspected, size).groupBy("id", "tag").agg(F.collect_list(F.struct("start", "n", "check")).alias("own"))
    own = own.withColumnsRenamed({"id": "source", "tag": "source_tag"})
    known = settled(
        suspected.join(own, same(F.col("id"), F.col("source")) & (F.col("tag") == F.col("source_tag")), "left").select("id", "h", "anchors", "own"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(3))
            for at, to in chunks(offsets):
                part = batch.slice(at, to - at)
                yield removed(part, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], size)

    return with_rows(rows, known, "left").select("id", "anchors", "own", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string")


def removed(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray, size: int) -> pa.RecordBatch:
    """The result's rows of some texts: (id, shared anchors, own paths, text)."""
    w = Windows(data, offsets, size)
    words, n = w.words, len(w.words.starts)
    of = np.flatnonzero(np.isin(w.anchor, part.column(1).flatten().to_numpy()))
    mine = np.zeros(n + 1, np.int64)
    if len(of):
        node = np.zeros(n + 1, np.int64)
        node[w.at] = w.left
        xor = np.append(0, np.bitwise_xor.accumulate(node))
        lists = part.column(2)
        flat, text = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().fill_null(0).to_numpy())
        start, length, check = (flat.field(i).to_numpy() for i in range(3))
        start = start + words.first[text]
        if (xor[start + length] ^ xor[start] != check).any():
            raise ValueError("a path that its source's text does not spell")
        np.add.at(mine, start, 1)
        np.add.at(mine, start + length, -1)
    first = w.at[of][w.firsts(of)]
    gone = w.at[of][np.cumsum(mine)[first] == 0]
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, gone, 1)
    np.add.at(cover, gone + size, -1)
    out = np.cumsum(cover[:-1]) > 0
    edge = np.ones(n, bool)
    edge[1:] = (out[1:] != out[:-1]) | (words.text[1:] != words.text[:-1])
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], n)
    begin, end = begin[out[begin]], end[out[begin]]
    of_text = words.text[begin]
    struct = pa.StructArray.from_arrays([pa.array(begin - words.first[of_text], pa.int64()), pa.array(end - words.first[of_text], pa.int64())], names=["start", "end"])
    spans = pa.ListArray.from_arrays(pa.array(np.searchsorted(of_text, np.arange(words.n + 1)), pa.int32()), struct)
    n_removed = np.bincount(words.text[out], minlength=words.n)
    return pa.RecordBatch.from_arrays(
        [part.column(0), pa.array(words.counts, pa.int64()), pa.array(n_removed, pa.int64()), spans, words.joined(~out)],
        names=["doc_id", "n_words", "n_removed", "spans", "kept"])
