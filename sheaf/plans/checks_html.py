"""Checks of HTML search and extraction operators."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sheaf.operators import extract, html
from sheaf.operators.extract import Field
from sheaf.plans.check import check
from sheaf.plans.fixtures import Inputs
from sheaf.session import settled


ENTITIES = (("quot", '"'), ("copy", "©"), ("middot", "·"), ("lt", "<"), ("gt", ">"), ("amp", "&"))


def plain(markup: str) -> str:
    """DuckDB text of a fragment: entities cut off before their ``;`` completed, tags out, entities back."""
    names = "|".join(name for name, _ in ENTITIES)
    text = rf"regexp_replace({markup}, '&({names})(<|$)', '&\1;\2', 'g')"
    text = f"regexp_replace({text}, '<[^>]*>', '', 'g')"
    for name, char in ENTITIES:
        text = f"replace({text}, '&{name};', '{char}')"
    return text


def inner(tag: str) -> str:
    return f"regexp_extract(html, '(?s)<{tag}>(.*?)</{tag}>', 1)"


NAV_LINKS = r"""regexp_extract_all(regexp_extract(html, '(?s)<nav>(.*?)</nav>', 1), '<a href="([^"]*)">([^<]*)</a>', {0})"""


def trees(fx: Inputs, keep: tuple[str, ...] = ()) -> DataFrame:
    return html.parse_html(fx.table("pages"), keep=keep)


@check("html_nodes", r"""
with clean as (select page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
 '(?s)<script>.*?</script>', '<script></script>', 'g') as html from pages),
tags as (select page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) as tag from clean)
select page_id, tag, count(*) as n from tags group by page_id, tag""")
def html_nodes(fx: Inputs) -> DataFrame:
    elements = html.nodes(trees(fx)).filter(~F.startswith("tag", F.lit("#")))
    return elements.groupBy("page_id", "tag").agg(F.count("*").alias("n"))


@check("titles", f"select page_id, {plain(inner('title'))} as title from pages")
def titles(fx: Inputs) -> DataFrame:
    return html.find_all(trees(fx), "title").select("page_id", F.col("text").alias("title"))


@check("headings", f"select page_id, {plain(inner('h1'))} as heading from pages where contains(html,'<h1>')")
def headings(fx: Inputs) -> DataFrame:
    return html.find_all(trees(fx), "h1").select("page_id", F.col("text").alias("heading"))


@check("links", f"""
with l as (select page_id, unnest({NAV_LINKS.format(1)}) as href, unnest({NAV_LINKS.format(2)}) as t from pages)
select page_id, {plain('href')} as href, {plain('t')} as text, count(*) as n from l group by all""")
def links(fx: Inputs) -> DataFrame:
    found = html.find_all(trees(fx), "a").select("page_id", F.col("attrs")["href"].alias("href"), "text")
    return found.groupBy("page_id", "href", "text").agg(F.count("*").alias("n"))


@check("article_text", f"""
select page_id, {plain("regexp_extract(html, '(?s)<article>(.*?)(</article>|$)', 1)")} as text from pages""")
def article_text(fx: Inputs) -> DataFrame:
    return html.find_all(trees(fx), "article").select("page_id", "text")


@check("page_text", f"""
select page_id, {plain("regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?s)<(script|style)>.*?</(script|style)>', '', 'g')")} as text
from pages""")
def page_text(fx: Inputs) -> DataFrame:
    runs = html.find_all(trees(fx), "#text")
    parts = F.array_sort(F.collect_list(F.struct("node_id", "text")))
    return runs.groupBy("page_id").agg(parts.alias("p")).select(
        "page_id", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text"))


@check("select_first", f"""
select page_id, {plain(f"({NAV_LINKS.format(1)})[1]")} as href, {plain(f"({NAV_LINKS.format(2)})[1]")} as text from pages
where len({NAV_LINKS.format(1)})>0""")
def select_first(fx: Inputs) -> DataFrame:
    return html.select_first(trees(fx), "nav li a").select("page_id", F.col("attrs")["href"].alias("href"), "text")


@check("select_children", f"""
with l as (select page_id, unnest({NAV_LINKS.format(2)}) as t, generate_subscripts({NAV_LINKS.format(2)}, 1) as pos from pages)
select page_id, pos, {plain('t')} as text from l""")
def select_children(fx: Inputs) -> DataFrame:
    found = html.select(trees(fx), "nav > ul > li")
    w = Window.partitionBy("page_id").orderBy("node_id")
    return found.select("page_id", F.row_number().over(w).cast("long").alias("pos"), "text")


@check("select_class", f"""
select page_id, {plain('''regexp_extract(html, '(?s)<div class="ad">(.*?)</div>', 1)''')} as text from pages
where contains(html, '<div class="ad">')""")
def select_class(fx: Inputs) -> DataFrame:
    return html.select_first(trees(fx), "div.ad").select("page_id", "text")


@check("xpath_scoped", f"""
with l as (select page_id, unnest({NAV_LINKS.format(2)}) as t, generate_subscripts({NAV_LINKS.format(2)}, 1) as pos from pages)
select page_id, pos, {plain('t')} as text from l""")
def xpath_scoped(fx: Inputs) -> DataFrame:
    page = settled(trees(fx))
    found = html.xpath(page, ".//li", scope=html.xpath(page, "//nav"))
    w = Window.partitionBy("page_id", "scope_id").orderBy("node_id")
    return found.select("page_id", F.row_number().over(w).cast("long").alias("pos"), "text")


@check("xpath_path", f"""
with l as (select page_id, unnest({NAV_LINKS.format(1)}) as href from pages)
select page_id, {plain('href')} as href, count(*) as n from l group by all""")
def xpath_path(fx: Inputs) -> DataFrame:
    page = settled(trees(fx))
    found = html.xpath(page, ".//ul//a[@href]", scope=html.xpath(page, "//nav"))
    return found.groupBy("page_id", F.col("attrs")["href"].alias("href")).agg(F.count("*").alias("n"))


@check("xpath_document", f"select page_id, {plain(inner('title'))} as title from pages where contains(html,'<nav>')")
def xpath_document(fx: Inputs) -> DataFrame:
    page = settled(trees(fx))
    return html.xpath(page, "//head/title", scope=html.xpath(page, "//nav")).select("page_id", F.col("text").alias("title"))


AD = "regexp_extract(html, '(?s)<div class=\"ad\">(.*?)</div>', 1)"


@check("sections", f"""
select page_id, {plain(AD)} as text from pages
where contains(lower({plain(AD)}),'the') or contains(lower({plain(AD)}),'der')""")
def sections(fx: Inputs) -> DataFrame:
    kept = html.relevant_sections(trees(fx), ["div", "table", "span"], ["the", "DER"])
    return html.section_text(kept).select("page_id", "text")


RECORDS = f"""
select page_id, {plain(inner('title'))} as title, nullif({plain(inner('h1'))},'') as heading,
 regexp_extract(html, '<html lang="([^"]*)"', 1) as lang, {plain(f"({NAV_LINKS.format(1)})[1]")} as first_link,
 cast(len(regexp_extract_all(html, '<a ')) as bigint) as links from pages"""


@check("records", RECORDS)
def records(fx: Inputs) -> DataFrame:
    spec = {"title": Field("title"), "heading": Field("h1"), "lang": Field("html", attr="lang"),
            "first_link": Field("nav li a", attr="href"), "links": Field("a", count=True)}
    return extract.extract_records(trees(fx), spec)


MANY = ["a", "article", "body", "div", "h1", "head", "html", "li", "main", "nav", "p", "script", "title", "ul", "footer"]


@check("records_many", r"""
with clean as (select page_id, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
 '(?s)<script>.*?</script>', '<script></script>', 'g') as html from pages),
tags as (select page_id, unnest(regexp_extract_all(html, '<([a-z0-9]+)[ >]', 1)) as tag from clean),
counts as (select page_id, """ + ", ".join(f"count(*) filter (tag='{t}') as n_{t}" for t in MANY) + f""" from tags group by page_id)
select * from ({RECORDS}) r join counts using (page_id)""")
def records_many(fx: Inputs) -> DataFrame:
    """Twenty fields in one pass over each page's nodes."""
    spec = {"title": Field("title"), "heading": Field("h1"), "lang": Field("html", attr="lang"),
            "first_link": Field("nav li a", attr="href"), "links": Field("a", count=True), **{f"n_{t}": Field(t, count=True) for t in MANY}}
    return extract.extract_pages(fx.table("pages"), spec)


@check("structured", f"""
select page_id, cast(length({plain(AD)}) as bigint) as chars from pages where contains(html, '<div class="ad">')""")
def structured(fx: Inputs) -> DataFrame:
    """Filtered text through a stand-in model that answers in JSON, and its answers read back."""
    prompt = "How long is the text?"

    def open_model():
        skip = len(prompt) + 2
        return lambda prompts: ['{"chars": %d}' % (len(p) - skip) for p in prompts]

    ads = html.select(trees(fx), "div.ad").select("page_id", "text")
    good, _ = extract.parse_answers(extract.structure_with_model(ads, prompt, open_model), "chars bigint")
    return good.select("page_id", "chars")


@check("answers", """
select job, json_valid(answer) as ok, case when json_valid(answer) then cast(json_extract_string(answer,'$.k') as bigint) end as k
from fx_model_output""")
def answers(fx: Inputs) -> DataFrame:
    good, bad = extract.parse_answers(fx.view("fx_model_output"), "k bigint")
    return good.select("job", F.lit(True).alias("ok"), "k").unionByName(
        bad.select("job", F.lit(False).alias("ok"), F.lit(None).cast("long").alias("k")))
