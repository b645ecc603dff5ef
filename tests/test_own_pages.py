"""Checks of edge answers work on the pages' own contents."""

import json

import pytest
from conftest import DATA

from sheaf.operators import html, intake
from sheaf.plans import checks_more
from sheaf.plans.catalog import QUERIES


@pytest.mark.parametrize("name, where, function", [
    ("verified_nulls", intake, "verify_tasks"), ("coerced_falsy", intake, "coerced"),
    ("requests_repeated_keys", intake, "parse_requests"), ("text_spaces", checks_more, "parse_html")])
def test_texts_hold_the_page(spark, monkeypatch, name, where, function):
    seen, run = [], getattr(where, function)
    monkeypatch.setattr(where, function, lambda df, *args: (seen.append(df), run(df, *args))[1])
    QUERIES[name](spark, DATA)
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").limit(30).collect()}
    rows = [r for r in seen[0].collect() if r["page_id"] in pages]
    assert len(rows) == len(pages) > 9
    for r in rows:
        page = pages[r["page_id"]]
        if name == "text_spaces":
            assert r["html"].startswith(page["html"])
        else:
            pairs = json.loads(r["raw"], object_pairs_hook=list)
            assert ("url", page["url"]) in pairs and page["html"] in [v for _, v in pairs]
