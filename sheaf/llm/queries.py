"""The registered queries: each operator over its whole table, with an oracle where SQL can express it."""

from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.llm import crosstoken, decontaminate, extract, lines, mixing, periodic, quality, revisits, secrets, simhash, substrings, tokens, urlfilter
from sheaf.llm.words import tuned
from sheaf.session import scratch

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
PAIR = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *tables: str, sql: str | None = None):
    """Registers a function of the session and the named tables."""

    def register(build):
        QUERIES[name] = lambda spark, sf_dir: build(tuned(spark), *[spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables])
        if sql:
            ORACLES[name] = sql
        return build

    return register


@query("op1_mixing", "documents", sql="""
WITH sizes AS (SELECT source, sum(length(coalesce(text, '')))::DOUBLE AS size FROM documents GROUP BY source),
wished AS (SELECT *, sqrt(size) AS wish, sum(size) OVER () AS total FROM sizes),
rated AS (SELECT source, CASE WHEN size > 0 THEN wish / sum(wish) OVER () * total / size ELSE 0 END AS rate FROM wished),
keyed AS (SELECT d.*, coalesce(d.doc_id::VARCHAR, 'null-' || md5(coalesce(d.text, ''))) AS k, r.rate
          FROM documents d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT *, (('0x' || substr(md5('mix-1:n:' || k), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 AS u FROM keyed),
counted AS (SELECT *, len(list_filter(range(0, CAST(ceil(rate + 12 * sqrt(rate) + 30) AS BIGINT)), lambda j: list_sum(list_transform(range(0, j + 1),
              lambda i: exp(-rate + CASE WHEN i > 0 THEN i * ln(rate) ELSE 0 END - lgamma(i + 1)))) <= u)) AS n
            FROM drawn WHERE rate > 0)
SELECT doc_id, text, lang, source, n_chars, copy::INTEGER AS copy,
       ('0x' || substr(md5('mix-1:order:' || k || ':' || copy), 1, 13))::BIGINT AS order_key
FROM (SELECT *, unnest(range(1, n + 1)) AS copy FROM counted WHERE n > 0)
""")
def op1(spark, documents):
    """Sources mixed in shares of the square roots of their sizes, as many characters in all as come in."""
    return mixing.mixed(documents)


RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


@query("op2_url_filter", "pages", sql="""
WITH rules(rule, verdict) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'),
                                     ('com/fr/', 'allow'), ('com/de/', 'block')),
cut AS (SELECT *, regexp_extract(rule, '^[^/]*') AS rh, regexp_extract(rule, '/.*$') AS rp FROM rules),
rest AS (SELECT page_id, row_number() OVER () AS k, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS r FROM pages),
urls AS (SELECT page_id, k, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
met AS (SELECT k, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM urls JOIN cut
        ON starts_with(path, rp) AND (host = rh OR ends_with(host, '.' || rh)) GROUP BY k)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM urls LEFT JOIN met USING (k)
""")
def op2(spark, pages):
    return urlfilter.judged(pages, spark.createDataFrame(RULES, "rule string, verdict string"))


@query("op3_main_text", "pages")
def op3(spark, pages):
    return extract.extracted(pages)


@query("op4_token_output", "documents")
def op4(spark, documents):
    path = scratch(spark, "tokens")
    tokens.write_tokens(documents, path, TOKENIZER)
    return tokens.read_digests(spark, path)


@query("op5_secrets", "documents")
def op5(spark, documents):
    return secrets.scanned(documents)


@query("op6_line_rules", "documents")
def op6(spark, documents):
    return lines.judged(documents, with_text=False)


@query("op7_decontamination", "documents", "benchmark", sql="""
WITH words AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
item_words AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
cut AS (SELECT item_id, w, least(13, len(w)) AS n, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM item_words WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM cut),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT k, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n),
found AS (SELECT p.k, p.i, p.n, win FROM places p JOIN words USING (k)
          JOIN (SELECT DISTINCT n, win FROM windows) x ON x.n = p.n AND x.win = array_to_string(w[p.i : p.i + p.n - 1], ' ')),
hit AS (SELECT k, count(DISTINCT place) AS n_hit FROM (SELECT k, unnest(range(i, i + n)) AS place FROM found) GROUP BY k),
items AS (SELECT k, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM found JOIN windows USING (n, win) GROUP BY k)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit USING (k) LEFT JOIN items USING (k)
""")
def op7(spark, documents, benchmark):
    return decontaminate.judged(documents, benchmark).drop("key")


@query("op8_simhash", "documents")
def op8(spark, documents):
    return simhash.near_duplicates(documents)


@query("op9_quality", "documents", "labels")
def op9(spark, documents, labels):
    return quality.scored(documents, labels)


def archive(pages: DataFrame) -> DataFrame:
    """Records of an archive, made of ``pages``: a few captures and revisits of each."""
    tag = F.concat(F.lit('"'), F.substring(F.md5(F.col("url").cast("binary")), 1, 8), F.lit('"'))
    day, size, html = F.col("page_id") % 1000, F.octet_length("html").cast("long"), F.col("html").cast("binary")

    def event(step, url, date, kind, status, etag, digest, n_bytes):
        names = ["step", "url", "date", "warc_type", "status", "etag", "digest", "n_bytes"]
        return F.struct(*[(x if hasattr(x, "alias") else F.lit(x)).alias(n) for n, x in zip(names, [step, url, date, kind, status, etag, digest, n_bytes])])

    url, none = F.col("url"), F.lit(None).cast("string")
    newer = F.concat(F.lit('"n'), F.substring(tag, 2, 9))
    low = F.substring(tag, 2, 1)
    zero = F.lit(0).cast("long")
    events = [
        event("a", url, day + 10, "response", F.lit(200), tag, F.md5(html), size),
        event("b", F.concat(F.regexp_replace(url, "#.*$", ""), F.lit("#again")), day + 11, "revisit", F.lit(304), F.concat(F.lit("W/"), tag), none, zero),
        event("c", url, day + 12, "response", F.when(low < "5", 200).otherwise(404), newer, F.md5(F.concat(html, F.lit(b"n"))), size + 1),
        event("d", url, day + 13, "revisit", F.lit(304),
              F.when(low < "5", newer).when(low < "a", tag).when(low < "d", F.lit('"x"')), none, zero),
        event("e", url, day, "revisit", F.lit(304), tag, none, zero),
    ]
    rows = pages.select("page_id", F.explode(F.array(*events)).alias("e")).select("page_id", "e.*")
    headers = F.when(F.col("warc_type") == "response", F.create_map(
        F.lit("ETag"), F.col("etag"), F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("n_bytes").cast("string"), F.lit("Server"), F.lit("s")))
    again = F.create_map(F.lit("Date"), F.concat(F.lit("day "), F.col("date").cast("string")), F.lit("Content-Length"), F.lit("0"))
    tagged = F.when(F.col("etag").isNotNull(), F.map_concat(again, F.create_map(F.lit("Etag"), F.col("etag")))).otherwise(again)
    return rows.select(
        F.concat_ws("-", F.col("page_id").cast("string"), "step").alias("record_id"), "url", "date", "warc_type", "status",
        F.coalesce(headers, tagged).alias("headers"), "digest", "n_bytes")


@query("op10_revisits", "pages", sql=r"""
WITH base AS (SELECT page_id, url, html, page_id % 1000 AS day, substr(md5(url), 1, 8) AS t,
  regexp_replace(regexp_replace(trim(url), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '#.*$', '') AS rest FROM pages),
keyed AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*')), '^www\.', ''), ':(80|443)?$', '') AS host,
  regexp_extract(rest, '^[^/?]*(.*)$', 1) AS path FROM base),
k AS (SELECT *, host || CASE WHEN starts_with(path, '/') THEN path ELSE '/' || path END AS key,
  CASE WHEN substr(t, 1, 1) < '5' THEN '"n' || t || '"' WHEN substr(t, 1, 1) < 'a' THEN '"' || t || '"' WHEN substr(t, 1, 1) < 'd' THEN '"x"' END AS dtag FROM keyed),
full_r AS (SELECT page_id || '-a' AS id, key, day + 10 AS date, '"' || t || '"' AS etag, md5(html) AS digest, strlen(html) AS n_bytes FROM k
  UNION ALL SELECT page_id || '-c', key, day + 12, '"n' || t || '"', md5(html || 'n'), strlen(html) + 1 FROM k WHERE substr(t, 1, 1) < '5'),
rev AS (SELECT page_id || '-b' AS id, key, day + 11 AS date, 'W/"' || t || '"' AS etag FROM k
  UNION ALL SELECT page_id || '-d', key, day + 13, dtag FROM k UNION ALL SELECT page_id || '-e', key, day, '"' || t || '"' FROM k),
near AS (SELECT r.id, r.key, r.date, r.etag, arg_max(f.id, (f.date, f.id)) AS of FROM rev r LEFT JOIN full_r f ON f.key = r.key AND f.date < r.date GROUP BY ALL),
judged AS (SELECT n.*, f.etag AS old, f.digest AS d, f.n_bytes AS nb,
  CASE WHEN n.of IS NULL THEN 'no response' WHEN n.etag IS NULL THEN 'no validator'
       WHEN regexp_replace(n.etag, '^W/', '') = f.etag THEN 'resolved' ELSE 'changed' END AS outcome FROM near n LEFT JOIN full_r f ON f.id = n.of)
SELECT id AS record_id, key, date, outcome, CASE WHEN outcome = 'resolved' THEN of END AS refers_to,
  CASE WHEN outcome = 'resolved' THEN 200 ELSE 304 END AS status, CASE WHEN outcome = 'resolved' THEN d END AS digest,
  CASE WHEN outcome = 'resolved' THEN nb END AS n_bytes,
  CASE WHEN outcome = 'resolved' THEN 'content-length=' || nb || ';content-type=text/html;date=day ' || date || ';etag=' || etag || ';server=s'
       ELSE 'content-length=0;date=day ' || date || CASE WHEN etag IS NULL THEN '' ELSE ';etag=' || etag END END AS headers
FROM judged
""")
def op10(spark, pages):
    """Captures and revisits made of each page, resolved; headers as sorted text."""
    found = revisits.resolved(archive(pages))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return found.withColumn("headers", text)


@query("op11_substrings", "documents")
def op11(spark, documents):
    rows = substrings.deduplicated(documents)
    return rows.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@F.arrow_udf(T.StringType())
def repeated(texts: pa.Array, seeds: pa.Array) -> pa.Array:
    """Texts whose words from some place on are made to repeat with a period, both taken from the seed; of a null a null."""
    out = []
    for text, g in zip(texts.cast(pa.large_binary()).to_pylist(), seeds.to_pylist()):
        words = text.split() if text else []
        if words:
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        out.append(None if text is None else b" ".join(words).decode())
    return pa.array(out, pa.string())


@query("op12_periodic_runs", "documents")
def op12(spark, documents):
    """Runs of the documents, a tenth of which are made periodic. A null id plants nothing."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    planted = repeated(F.when(h % 10 == 0, F.col("text")), F.floor(h / 10).cast("long"))
    rows = periodic.runs(documents.select("doc_id", F.coalesce(planted, "text").alias("text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return rows.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query("op13_alignment", "documents")
def op13(spark, documents):
    """Groups as a digest, which is empty where a text has no tokens."""
    rows = crosstoken.aligned(documents, *PAIR)
    return rows.withColumn("groups_sha256", F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")).drop("groups")
