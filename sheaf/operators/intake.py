"""Requests to tasks: parsing, rules, ids, routing, payloads, envelopes."""

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sheaf.functions.ids import time_ordered_id
from sheaf.schema import METHODS, REASONS, TOPICS

REQUEST_FIELDS = ["url", "headers", "method", "body", "params", "scrape_type"]


def _typed(document: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(document, path, kind)


def _kind(value: Column) -> Column:
    """JSON kind of a variant: STRING, OBJECT<...>, BIGINT, VOID for a JSON null."""
    return F.schema_of_variant(value)


def _is_string(value: Column) -> Column:
    return F.coalesce(_kind(value) == "STRING", F.lit(False))


def _is_object(value: Column) -> Column:
    return F.coalesce(F.startswith(_kind(value), F.lit("OBJECT")), F.lit(False))


def _is_string_map(document: Column, path: str) -> Column:
    values = F.map_values(_typed(document, path, "map<string,variant>"))
    return F.coalesce(F.forall(values, _is_string), F.lit(False))


def _is_absent(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value)


def _is_falsy(value: Column) -> Column:
    """Unset, or a value that loose JSON counts as unset: null, false, zero and empty text."""
    return _is_absent(value) | F.to_json(value).isin("false", "0", "0.0", '""')


def parse_requests(df: DataFrame, col: str) -> DataFrame:
    """JSON text to the request's columns; unknown fields are left out.

    Adds ``doc`` (the parsed document, null for text that is no JSON) which the rules look at,
    and the typed columns url, headers, method, body (JSON text), params, scrape_type.
    """
    d = F.col("doc")
    body = _typed(d, "$.body", "variant")
    body_text = F.when(_is_string(body), F.when(_typed(d, "$.body", "string") == "", "{}")
                       .otherwise(_typed(d, "$.body", "string"))).otherwise(F.to_json(body))
    method, has_body = _typed(d, "$.method", "string"), ~_is_absent(body)
    default_type = F.when(method.isNotNull() & has_body, "API").otherwise("HTML")
    return df.withColumn("doc", F.try_parse_json(col)).select(
        "*",
        _typed(d, "$.url", "string").alias("url"),
        _typed(d, "$.headers", "map<string,string>").alias("headers"),
        method.alias("method"),
        F.when(has_body, body_text).alias("body"),
        _typed(d, "$.params", "map<string,string>").alias("params"),
        F.coalesce(_typed(d, "$.scrape_type", "string"), default_type).alias("scrape_type"),
    )


def with_reason(parsed: DataFrame) -> DataFrame:
    """``reason``: the first rule a parsed request breaks, null for a valid one.

    Rules in order: a JSON object; url text; headers a string map; a known scrape type; for
    API also one of the five methods and a body of strings; params, where given, a string map.
    """
    d = F.col("doc")
    api = F.col("scrape_type") == "API"
    body = _typed(d, "$.body", "variant")
    empty_text = _is_string(body) & (_typed(d, "$.body", "string") == "")
    params = _typed(d, "$.params", "variant")
    reason = (
        F.when(d.isNull() | ~_is_object(d), REASONS["object"])
        .when(~_is_string(_typed(d, "$.url", "variant")), REASONS["url"])
        .when(~_is_object(_typed(d, "$.headers", "variant")), REASONS["headers"])
        .when(~_is_string_map(d, "$.headers"), REASONS["headers_values"])
        .when(~F.col("scrape_type").isin(list(TOPICS)), "scrape_type: API, HTML or WEBDRIVER expected")
        .when(api & ~F.coalesce(F.col("method").isin(METHODS), F.lit(False)),
              "method: one of " + ", ".join(METHODS) + " expected")
        .when(api & ~empty_text & ~_is_object(body), "body: object expected")
        .when(api & ~empty_text & ~_is_string_map(d, "$.body"), "body: string{k:string} expected")
        .when(~_is_absent(params) & ~_is_object(params), REASONS["params"])
        .when(~_is_absent(params) & ~_is_string_map(d, "$.params"), REASONS["params_values"])
    )
    return parsed.withColumn("reason", reason)


def validate_requests(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) of parsed requests; every input row is in one of them.

    Both are filters over one projection. A caller that writes both should do so from
    one table of ``with_reason``, so the JSON is parsed once.
    """
    checked = with_reason(parsed).drop("doc")
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()),
    )


def verify_tasks(df: DataFrame, col: str) -> DataFrame:
    """``reason`` for JSON task messages (all fields optional, and a JSON null is an unset one), null when well formed."""
    d = F.col("doc")
    reason = F.when(d.isNull() | ~_is_object(d), REASONS["object"])
    for field in ("jobId", "url", "method"):
        v = _typed(d, f"$.{field}", "variant")
        reason = reason.when(~_is_absent(v) & ~_is_string(v), REASONS[field])
    for field in ("headers", "params"):
        v = _typed(d, f"$.{field}", "variant")
        reason = reason.when(~_is_absent(v) & ~_is_object(v), REASONS[field])
        reason = reason.when(~_is_absent(v) & ~_is_string_map(d, f"$.{field}"), REASONS[f"{field}_values"])
    v = _typed(d, "$.body", "variant")
    reason = reason.when(~_is_absent(v) & ~_is_string(v), REASONS["body"])
    return df.withColumn("doc", F.try_parse_json(col)).withColumn("reason", reason).drop("doc")


def assign_job_ids(df: DataFrame, ts: str, row_key: list[str]) -> DataFrame:
    """``job_id`` from the time and the row's own key, the same on every run."""
    return df.withColumn("job_id", time_ordered_id(F.col(ts), *[F.col(c) for c in row_key]))


def topic_of(scrape_type: Column, strict: bool = True) -> Column:
    """Topic (and channel: they share names) of a scrape type; unknown types fail the job."""
    names = F.create_map(*[F.lit(x) for x in chain(*TOPICS.items())])
    topic = F.try_element_at(names, scrape_type)
    if strict:
        unknown = F.raise_error(F.concat(F.lit("unknown scrape type: "), scrape_type)).cast("string")
        return F.coalesce(topic, unknown)
    return topic


def route(df: DataFrame, strict: bool = True) -> DataFrame:
    """``topic`` and ``channel`` per row; with ``strict=False`` an unknown type gives null."""
    topic = topic_of(F.col("scrape_type"), strict)
    return df.withColumn("topic", topic).withColumn("channel", F.col("topic"))


def to_payload(df: DataFrame) -> DataFrame:
    """``payload``: the request as JSON with its job id and without scrape_type."""
    fields = [c for c in REQUEST_FIELDS if c != "scrape_type" and c in df.columns]
    return df.withColumn("payload", F.to_json(F.struct(*fields, "job_id")))


def coerce_tasks(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected) from loose JSON: any scalar becomes text, missing text is ``''``.

    headers and params must be objects where given (null, false, 0 and '' are not); their values become text too.
    """
    checked = coerced(df, col)
    return (
        checked.filter(F.col("reason").isNull()).drop("reason"),
        checked.filter(F.col("reason").isNotNull()).drop("job_id", "url", "method", "headers", "params", "body"),
    )


def coerced(df: DataFrame, col: str) -> DataFrame:
    """Loose JSON to task columns plus ``reason`` (null when it could be read)."""
    d = F.col("doc")
    no_entries = F.create_map().cast("map<string,string>")

    def text(name: str) -> Column:
        return F.coalesce(_typed(d, f"$.{name}", "string"), F.lit(""))

    def entries(name: str) -> Column:
        given = _typed(d, f"$.{name}", "map<string,string>")
        return F.coalesce(F.transform_values(given, lambda _, v: F.coalesce(v, F.lit(""))), no_entries)

    reason = F.when(d.isNull() | ~_is_object(d), REASONS["object"])
    for name in ("headers", "params"):
        v = _typed(d, f"$.{name}", "variant")
        reason = reason.when(~_is_falsy(v) & ~_is_object(v), REASONS[name])
    return df.withColumn("doc", F.try_parse_json(col)).select(
        "*",
        text("jobId").alias("job_id"), text("url").alias("url"), text("method").alias("method"),
        entries("headers").alias("headers"), entries("params").alias("params"),
        text("body").alias("body"), reason.alias("reason"),
    ).drop("doc")


def export_tasks(df: DataFrame, defaults: bool = False) -> DataFrame:
    """``json``: the task in camelCase; unset fields are left out unless ``defaults``."""

    def kept(name: str) -> Column:
        c = F.col(name)
        if defaults:
            empty = F.create_map().cast("map<string,string>") if name in ("headers", "params") else F.lit("")
            return F.coalesce(c, empty)
        return F.when((F.size(c) if name in ("headers", "params") else F.length(c)) > 0, c)

    fields = [kept("job_id").alias("jobId")]
    fields += [kept(n).alias(n) for n in ("url", "method", "headers", "params", "body")]
    return df.withColumn("json", F.to_json(F.struct(*fields)))


def envelope(df: DataFrame, ts: str) -> DataFrame:
    """Readable wrapper around the encoded task in ``value``."""
    headers = F.coalesce(F.to_json("headers"), F.lit("{}"))
    return df.select(
        "job_id", "url", headers.alias("headers"),
        F.unix_timestamp(F.col(ts).cast("timestamp")).alias("timestamp"),
        F.col("value").alias("data"),
    )
