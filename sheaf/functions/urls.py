"""URL parts and query strings."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def query_string(params: Column) -> Column:
    """``k=v`` pairs in key order, percent-encoded; empty for no params."""
    pairs = F.transform(
        F.array_sort(F.map_entries(params)),
        lambda e: F.concat(F.url_encode(e["key"]), F.lit("="), F.url_encode(e["value"])),
    )
    return F.coalesce(F.array_join(pairs, "&"), F.lit(""))


def with_params(url: Column, params: Column) -> Column:
    """The URL with params appended to its query, ahead of any fragment."""
    base = F.regexp_extract(url, r"^([^#]*)", 1)
    fragment = F.regexp_extract(url, r"(#.*)$", 1)
    query = query_string(params)
    joint = (
        F.when(base.rlike(r"[?&]$"), "")
        .when(F.contains(base, F.lit("?")), "&")
        .otherwise("?")
    )
    return F.when(query == "", url).otherwise(F.concat(base, joint, query, fragment))


def host(url: Column) -> Column:
    return F.try_parse_url(url, F.lit("HOST"))
