"""URL rules by host and path, as a sorted sweep over reversed hosts."""

from bisect import bisect_left
from operator import neg

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.session import few_rows, range_parts, settled

#: Ends each label of a reversed host; it sorts below all characters of host names.
DOT = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host, in lower case, and path; both empty for null and for a text without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The host's labels from the last to the first. A host and all its subdomains are one interval of these keys."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), DOT), F.lit(DOT))


def fits(host: str, path: str, rule_host: str, rule_path: str) -> bool:
    return path.startswith(rule_path) and (host == rule_host or host.endswith("." + rule_host))


class Level:
    """The rules of one host met so far: an interval of keys, nested in those of the hosts above it."""

    def __init__(self, key: str, host: str):
        self.key, self.host, self.rules, self.lengths = key, host, {}, []

    def add(self, path: str, rule: str, verdict: str):
        if path not in self.rules:
            n, at = len(path), bisect_left(self.lengths, -len(path), key=neg)
            if at == len(self.lengths) or self.lengths[at] != n:
                self.lengths.insert(at, n)  # as many as there are lengths of paths, the longest first
        self.rules[path] = max(self.rules.get(path, ("", "")), (rule, verdict))

    def best(self, host: str, path: str):
        if host == self.host or host.endswith("." + self.host):
            for n in self.lengths:
                if n <= len(path) and path[:n] in self.rules:
                    return self.rules[path[:n]]
        return None


def sweep(batches):
    """(carried, key, is_url, id, host, path, rule, verdict) rows of one range, carried rules first and all in order, to the longest rule for each url."""
    stack = []
    for batch in batches:
        keys, is_url, hosts, paths, rules, verdicts = (batch.column(i).to_pylist() for i in (1, 2, 4, 5, 6, 7))
        found = []
        for key, url, host, path, rule, verdict in zip(keys, is_url, hosts, paths, rules, verdicts):
            while stack and not key.startswith(stack[-1].key):
                stack.pop()
            if url:
                met = [x for level in stack if (x := level.best(host, path))]
                found.append(max(met, key=lambda x: (len(x[0]), x[0]), default=(None, None)))
                continue
            if not stack or stack[-1].key != key:
                stack.append(Level(key, host))
            stack[-1].add(path, rule, verdict)
        of = batch.filter(pa.array(is_url, pa.bool_()))
        yield pa.RecordBatch.from_arrays(
            [of.column(3), of.column(4), of.column(5), pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.string())],
            names=["id", "host", "path", "rule", "verdict"])


def judged(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row of ``pages``; ``rules`` has (rule, verdict), a rule being host and path.

    A rule fits its host and the subdomains, if the url's path starts with the rule's. The longest that fits decides, and
    ``default`` where none does. Urls and rules are sorted together by reversed host and then path, so a rule's interval holds the urls
    it may fit; a sweep over each range of them keeps a stack of the hosts whose interval it is in, with their rules. Into a range reach from
    earlier ranges the rules of its first key's host and of the hosts above it; they are put in front of the range as rows. Of the own host these
    are only the rules whose path begins that of the first key, if the range does not go on to another host. The path and id are part of the
    order, so one host with a third of all rows, or with very many rules, is cut into many ranges, and nearly all its rules go through one.

    A null url has empty host and path. Of rules given twice, the verdict that sorts first counts; null rules count for
    nothing, and so do null verdicts. Repeated rows each get a row; no rules leave all to ``default``.
    """
    slash = F.instr("rule", "/")
    rule_host = F.translate(F.when(slash > 0, F.substring("rule", F.lit(1), slash - 1)).otherwise(F.col("rule")), UPPER, LOWER)
    listed = (
        rules.filter(F.col("rule").isNotNull() & F.col("verdict").isNotNull()).groupBy("rule").agg(F.min("verdict").alias("verdict"))
        .select(
            rule_host.alias("host"), F.when(slash > 0, F.substring("rule", slash, F.length("rule"))).otherwise("").alias("path"), "rule", "verdict")
        .withColumn("key", host_key(F.col("host")))
    )
    host, path = host_path(F.col(url))
    urls = pages.select(F.col(page_id).alias("id"), host.alias("host"), path.alias("path"))
    kind = urls.schema["id"].dataType.simpleString()
    nothing = F.lit(None).cast("string")
    rows = urls.select(
        host_key(F.col("host")).alias("key"), F.lit(True).alias("is_url"), "id", "host", "path", nothing.alias("rule"), nothing.alias("verdict"),
    ).unionByName(listed.select("key", F.lit(False).alias("is_url"), F.lit(None).cast(kind).alias("id"), "host", "path", "rule", "verdict"))
    order = ["key", "path", "is_url", "id"]
    n = range_parts(pages)
    placed = settled(rows.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    labels = F.slice(F.split("key", DOT), F.lit(1), F.size(F.split("key", DOT)) - 1)
    above = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, F.lit(1), n), DOT), F.lit(DOT)))
    firsts = placed.groupBy("part").agg(F.min(F.struct("key", "path")).alias("first"), F.max("key").alias("last")).select(
        "part", F.col("first.key").alias("key"), F.col("first.path").alias("first_path"), "last")
    reaching = firsts.select("part", "first_path", "last", F.col("key").alias("own"), F.explode(above).alias("key")).join(few_rows(settled(listed)), "key")
    inside = (F.col("key") == F.col("own")) & (F.col("last") == F.col("own"))  # a range within one host
    carried = reaching.filter(~inside | F.startswith(F.col("first_path"), F.col("path"))).select(
        F.lit(True).alias("carried"), "key", F.lit(False).alias("is_url"), F.lit(None).cast(kind).alias("id"), "host", "path", "rule", "verdict", "part")
    swept = (
        placed.withColumn("carried", F.lit(False)).unionByName(carried).repartitionById(n, F.col("part"))
        .sortWithinPartitions(F.col("carried").desc(), *order)
        .select("carried", "key", "is_url", "id", "host", "path", "rule", "verdict")
        .mapInArrow(sweep, f"id {kind}, host string, path string, rule string, verdict string")
    )
    return swept.select(F.col("id").alias("page_id"), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
