"""Not-modified revisits of an archive, resolved by an as-of join to the latest earlier full response."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.session import range_parts, settled

#: Headers of the stored response that a not-modified answer may not replace: they describe a body or one connection.
KEPT_HEADERS = [
    "connection", "content-encoding", "content-length", "content-md5", "content-range", "content-type", "keep-alive",
    "proxy-authenticate", "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade",
]


def canonical(url: Column) -> Column:
    """Without scheme, ``www.``, default port and fragment, the host in lower case, an empty path as ``/``; null stays null."""
    rest = F.regexp_replace(F.regexp_replace(F.trim(url), "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "#.*$", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^[^/?]*", 0)), "^www\\.", ""), ":(80|443)?$", "")
    path = F.regexp_extract(rest, "^[^/?]*(.*)$", 1)
    return F.concat(host, F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path)))


def lowered(headers: Column) -> Column:
    """Headers as (name in lower case, value) entries; of a repeated name the last."""
    entries = F.transform(
        F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>")),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))
    later = lambda i: F.slice(entries, i + 2, F.size(entries))
    return F.filter(entries, lambda e, i: ~F.exists(later(i), lambda x: x["key"] == e["key"]))


def header(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["key"] == name), F.lit(0))["value"]


def merged(stored: Column, newer: Column) -> Column:
    """The stored headers, updated by those of the not-modified answer that may do so, as a map."""
    allowed = F.filter(newer, lambda e: ~e["key"].isin(KEPT_HEADERS))
    names = F.transform(allowed, lambda e: e["key"])
    rest = F.filter(stored, lambda e: ~F.array_contains(names, e["key"]))
    return F.map_from_entries(F.array_sort(F.concat(rest, allowed)))


def latest_earlier(events: DataFrame) -> DataFrame:
    """(record_id, key, date, of) for each revisit of ``events`` (key, date, full, record_id): the latest earlier full response's id.

    Events are sorted by (key, date) over ranges, so that a key with a third of all rows is cut into many. Within
    a key and range the last full response is a running value; from range to range it is one row for each key and range.
    At one instant revisits come first, so only earlier responses count; of those of one instant the largest id.
    """
    order = ["key", "date", "full", "record_id"]
    placed = settled(
        events.repartitionByRange(range_parts(events), *order).withColumn("part", F.spark_partition_id())
    )
    response = F.when(F.col("full"), F.struct("date", "record_id"))
    within = Window.partitionBy("key", "part").orderBy("date", "full", "record_id").rowsBetween(Window.unboundedPreceding, -1)
    near = placed.withColumn("near", F.max(response).over(within)).filter(~F.col("full"))
    tails = placed.groupBy("key", "part").agg(F.max(response).alias("tail"))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    carried = tails.withColumn("far", F.max("tail").over(before)).filter(F.col("far").isNotNull()).select("key", "part", "far")
    return near.join(carried, ["key", "part"], "left").select(
        "record_id", "key", "date", F.coalesce("near", "far")["record_id"].alias("of"))


def resolved(records: DataFrame) -> DataFrame:
    """What each revisit of ``records`` stands for: (record_id, key, date, outcome, refers_to, status, digest, n_bytes, headers).

    ``records``: record_id, url, date, warc_type (``response`` or ``revisit``), status, headers (map), digest, n_bytes. A full
    response has status 200 and a digest. A revisit is ``resolved`` when an earlier full response of its canonical
    url has the validator it gives: the ETag (weak or not), else Last-Modified, else the payload digest. Otherwise it is
    ``no response``, ``changed`` (validators differ) or ``no validator``, and keeps its own headers. Bodies are
    referred to, not copied: ``refers_to`` is the record that holds it.

    A null url or date is never matched. Repeated ids among responses count once (the one whose content sorts first); repeated
    revisits each get a row. Null headers are none, and a header name in several spellings counts as its last.
    """
    full = (F.col("warc_type") == "response") & (F.col("status") == 200) & F.col("digest").isNotNull()
    rows = records.select(
        "record_id", canonical(F.col("url")).alias("key"), "date", F.coalesce(full, F.lit(False)).alias("full"),
        (F.col("warc_type") == "revisit").alias("revisit"), lowered(F.col("headers")).alias("headers"), "digest", "n_bytes",
    ).filter("full or revisit")
    rows = settled(rows)  # used three times; bodies are not in it
    usable = F.col("key").isNotNull() & F.col("date").isNotNull() & F.col("record_id").isNotNull()
    pairs = latest_earlier(rows.filter(usable).select("key", "date", "full", "record_id")).distinct()
    stored = rows.filter("full").groupBy(F.col("record_id").alias("of")).agg(F.min(F.struct("digest", "n_bytes", "headers")).alias("stored"))
    revisits = rows.filter("revisit").join(pairs, ["record_id", "key", "date"], "left")
    # A revisit without an earlier response has a key of its own, as nulls would all meet in one task.
    revisits = revisits.withColumn("of", F.coalesce("of", F.concat(F.lit("\0"), "record_id"))).join(stored, "of", "left")
    old = F.col("stored.headers")
    strong = lambda e: F.regexp_replace(header(e, "etag"), "^W/", "")
    own = [strong(F.col("headers")), header(F.col("headers"), "last-modified"), F.col("digest")]
    there = [strong(old), header(old, "last-modified"), F.col("stored.digest")]
    same = F.lit(None).cast("boolean")
    for a, b in reversed(list(zip(own, there))):
        same = F.when(a.isNotNull(), a.eqNullSafe(b)).otherwise(same)
    outcome = (
        F.when(F.col("stored").isNull(), "no response").when(same.isNull(), "no validator").when(same, "resolved").otherwise("changed"))
    good = F.col("outcome") == "resolved"
    return revisits.withColumn("outcome", outcome).select(
        "record_id", "key", "date", "outcome", F.when(good, F.col("of")).alias("refers_to"), F.when(good, 200).otherwise(304).alias("status"),
        F.when(good, F.col("stored.digest")).alias("digest"), F.when(good, F.col("stored.n_bytes")).alias("n_bytes"),
        F.when(good, merged(old, F.col("headers"))).otherwise(F.map_from_entries(F.array_sort("headers"))).alias("headers"))
