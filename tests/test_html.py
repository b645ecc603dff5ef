import pyarrow as pa
import pytest

from sheaf.functions import selectors
from sheaf.operators import extract, html
from sheaf.operators.extract import Field

PAGES = [
    "<p>a<b>b</p>c", "plain", "", "</p>x</p>", "<div id=d class='x y'>1<span>2<div>3</div></span>4</div>",
    "<ul><li>1<ul><li>2</ul><li>3", "<br/><div/>after<img src=i>x", "<script>if(a<b)t='</p>'</script>v<style>p{}</style>w",
    "<a HREF='1' href=2 title>t</a>", "a &amp; b &#233; &copy c &nope; <!-- no --> d", "<pre> \n </pre><p> \n </p><p>  </p>",
    "<div><div><div>deep</div></div><a>out</a></div>", "<p><b>x<br><p>y</p></article>z",
    "<div class='s'>has Price 1<div>price inner</div></div><table><tr><td>price 2</table><span>none</span>",
    "".join(f"<div><p>{i}<a href='{i}'>l{i}</a></p></div>" for i in range(400)),
]


@pytest.fixture(scope="module")
def trees(spark):
    df = spark.createDataFrame(list(enumerate(PAGES)) + [(99, None)], "page_id long, html string")
    return html.parse_html(df).cache()


def texts(df):
    return [(r.page_id, r.text) for r in df.orderBy("page_id", "node_id").collect()]


def on(df, page):
    return [t for p, t in texts(df) if p == page]


def test_tree_shape(trees):
    rows = {(r.page_id, r.node_id): r for r in html.nodes(trees).collect()}
    for (page, i), n in rows.items():
        assert i <= n.last_id and n.text_from <= n.text_to
        if n.parent_id >= 0:
            up = rows[page, n.parent_id]
            assert up.node_id < i and n.last_id <= up.last_id
            assert n.tag == "#raw" or (up.text_from <= n.text_from and n.text_to <= up.text_to)


def test_text(trees):
    p = html.find_all(trees, "p")
    assert on(p, 0) == ["ab"] and on(p, 3) == []
    assert on(html.find_all(trees, "#text"), 0) == ["a", "b", "c"]
    assert on(html.find_all(trees, "#text"), 1) == ["plain"] and on(html.find_all(trees, "#text"), 3) == ["x"]
    assert on(html.find_all(trees, "div"), 4) == ["1234", "3"]
    assert on(html.find_all(trees, "li"), 5) == ["123", "2", "3"]
    assert on(html.find_all(trees, "#text"), 6) == ["after", "x"] and on(html.find_all(trees, "div"), 6) == [""]
    assert on(html.find_all(trees, "#text"), 7) == ["v", "w"]
    assert on(html.find_all(trees, "#raw"), 7) == ["if(a<b)t='</p>'", "p{}"]
    assert on(html.find_all(trees, "script"), 7) == [""]
    assert on(html.find_all(trees, "#text"), 9) == ["a & b é © c &nope ", " d"]
    assert on(html.find_all(trees, "#text"), 10) == [" \n ", "\n", " "]
    assert on(html.find_all(trees, "p"), 12) == ["xyz", "y"]


def test_attributes(trees):
    a = html.find_all(trees, "a").filter("page_id = 8").first()
    assert a.attrs == {"href": "2", "title": ""}


def test_null_page_has_no_nodes(trees):
    assert trees.filter("page_id = 99").count() == 1 and html.nodes(trees).filter("page_id = 99").count() == 0


SELECTORS = ["div", "*", "#d", ".y", "div.x.y", "[href]", "a[href='7']", "div div", "div > div", "div div > div", "div span div",
             "div > p > a", "div p a", "ul > li", "ul ul > li", "li li", "div > a", "div a[href]", "body p"]


def brute(rows, steps):
    """Matches by walking every node's ancestors."""
    by = {(r.page_id, r.node_id): r for r in rows}

    def simple(n, s):
        if (s.tag and n.tag != s.tag) or (not s.tag and n.tag.startswith("#")):
            return False
        for name, op, value in s.tests:
            v = (n.attrs or {}).get(name)
            if v is None or (op == "is" and v != value) or (op == "word" and value not in v.split()):
                return False
        return True

    def holds(n, i):
        if not simple(n, steps[i]):
            return False
        if i == 0:
            return True
        up = by.get((n.page_id, n.parent_id))
        while up is not None:
            if holds(up, i - 1):
                return True
            if steps[i].child:
                return False
            up = by.get((up.page_id, up.parent_id))
        return False

    return sorted((r.page_id, r.node_id) for r in rows if holds(r, len(steps) - 1))


@pytest.mark.parametrize("css", SELECTORS)
def test_select_equals_brute_force(trees, css):
    rows = html.nodes(trees).collect()
    want = brute(rows, selectors.css(css))
    got = sorted((r.page_id, r.node_id) for r in html.select(trees, css).collect())
    assert got == want
    first = {}
    for p, n in want:
        first.setdefault(p, n)
    assert {r.page_id: r.node_id for r in html.select_first(trees, css).collect()} == first


def test_unsupported_selectors_are_refused():
    for bad in ("a:hover", "a + b", "a,b", "["):
        with pytest.raises(ValueError):
            selectors.css(bad)
    for bad in ("//a[1]", "a", ""):
        with pytest.raises(ValueError):
            selectors.xpath(bad)


def test_descendants_equal_a_plain_interval_join(trees):
    rows = html.nodes(trees).collect()
    divs = [r for r in rows if r.tag == "div"]
    want = sorted((d.page_id, d.node_id, n.node_id) for d in divs for n in rows
                  if n.page_id == d.page_id and d.node_id < n.node_id <= d.last_id)
    got = html.descendants(html.find_all(trees, "div"), html.nodes(trees))
    assert sorted((r.page_id, r.scope_id, r.node_id) for r in got.collect()) == want
    kids = html.children(html.find_all(trees, "div"), html.nodes(trees))
    assert sorted((r.page_id, r.scope_id, r.node_id) for r in kids.collect()) == [
        w for w in want if {(r.page_id, r.node_id): r.parent_id for r in rows}[w[0], w[2]] == w[1]]


def test_xpath_scope(trees):
    spans = html.find_all(trees, "span").filter("page_id = 4")
    assert on(html.xpath(trees, ".//div", spans), 4) == ["3"]
    assert on(html.xpath(trees, "//div", spans), 4) == ["1234", "3"]
    assert html.xpath(trees, "//div", spans).filter("page_id <> 4").count() == 0
    outer = html.find_all(trees, "div").filter("page_id = 11")
    pairs = sorted((r.scope_id, r.text) for r in html.xpath(trees, ".//div/div", outer).collect())
    assert pairs == [(0, "deep")]
    assert sorted(r.text for r in html.xpath(trees, "./a", outer).collect()) == ["out"]


def test_sections_are_outermost_and_mention_a_term(trees):
    kept = html.relevant_sections(trees.filter("page_id = 13"), ["div", "table", "span"], ["PRICE"])
    assert texts(kept) == [(13, "has Price 1price inner"), (13, "price 2")]
    assert html.section_text(kept).first().text == "has Price 1price inner\nprice 2"


def test_records(trees):
    spec = {"n": Field("div", count=True), "first": Field("div > p > a", attr="href", type="int"), "word": Field("p", type="int")}
    got = {r.page_id: (r.n, r["first"], r.word) for r in extract.extract_records(trees, spec).collect()}
    assert got[14] == (400, 0, None) and got[4] == (2, None, None) and got[1] == (0, None, None)
    assert len(got) == len(PAGES) + 1


def test_answers(spark):
    rows = ['{"name":"x","price":1.5}', '{"name":"x","price":"dear"}', "no", None, '{"name":"y"}']
    df = spark.createDataFrame(list(enumerate(rows)), "i int, answer string")
    good, bad = extract.parse_answers(df, "name string, price double")
    assert sorted(r.i for r in good.collect()) == [0, 4] and sorted(r.i for r in bad.collect()) == [1, 2, 3]


def test_a_page_is_parsed_once_for_all_fields(trees, spark):
    df = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    spec = {"a": Field("p"), "b": Field("div p"), "c": Field("p", count=True)}
    plan = extract.extract_records(html.parse_html(df), spec)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and plan.count("Exchange hash") == 0


SELECTORS = ["a", "nav li a", "div > p", "ul > li > a", ".x", "#one", "[href]", "div p b", "div > .x [a=v]", "body > div > ul a", "* > b", "li li", "div.x > p.y"]


def test_one_pass_equals_a_pass_for_each_field(spark):
    import random


    rng = random.Random(7)
    tags = ["div", "p", "ul", "li", "a", "b", "nav", "body"]

    def page(depth=0):
        if depth > 6 or rng.random() < 0.2:
            return rng.choice(["text ", "<br>", "&amp;x", "<script>if (a<b)</script>", "<!-- c -->"])
        tag, attrs = rng.choice(tags), "".join(rng.sample([" class='x y'", " class=y", " id=one", " href='/l'", " a=v", " a"], rng.randrange(3)))
        end = f"</{tag}>" if rng.random() < 0.85 else ""
        return f"<{tag}{attrs}>" + "".join(page(depth + 1) for _ in range(rng.randrange(4))) + end

    pages = spark.createDataFrame([(i, "".join(page() for _ in range(4))) for i in range(60)] + [(60, None), (61, "")], "page_id long, html string")
    spec = {}
    for i, s in enumerate(SELECTORS):
        spec |= {f"t{i}": extract.Field(s), f"a{i}": extract.Field(s, attr="href"), f"n{i}": extract.Field(s, count=True)}
    one, each = extract.extract_pages(pages, spec), extract.extract_records(html.parse_html(pages), spec)
    assert one.schema == each.schema
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, each.collect()))


def test_look_ups_grow_with_nodes_and_not_with_fields():

    _, rows = html.walked("<div><p><b>x</b></p><p>y</p></div>" * 300)
    sizes = []
    for n in (1, 40):
        machine = extract.Automaton({f"f{i}": extract.Field(f"table td.c{i}") for i in range(n)})
        machine.run(rows)
        sizes.append((len(machine.moves), len(machine.sets), max(map(len, machine.moves.values()))))
    assert sizes[0] == sizes[1] and sizes[1][2] == 0


def test_pages_are_parsed_in_parts_of_bounded_bytes(spark):
    made = [None, "", "<p>" + "é" * 200_000, "<b>" + "x" * 2_400_000, None, *["<i>" + "y" * 320_000] * 9]
    got = list(html._parse.func(iter([pa.array(made[:2] + made), pa.array([], pa.string())])))
    assert [len(t) for t in got] == [5, 1, 4, 3, 3]  # not all pages of a batch at once
    assert [len(x["nodes"]) for t in got for x in t.to_pylist()] == [0, 0, 0, 0, 2, 2, 0, *[2] * 9]
    assert [p.to_pylist() for p in html.parts(pa.array(["ab", None, "cde", "f", "", "g"]).slice(1), 3)] == [[None, "cde"], ["f", "", "g"]]


def test_memory_of_parsing_does_not_grow_with_the_batch(spark):
    import tracemalloc

    def peak(n):
        batch = pa.array([("<p class=a>" + "x" * 100) * 900] * n)  # 0.1 MB each
        tracemalloc.start()
        try:
            assert sum(map(len, html._parse.func(iter([batch])))) == n
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(60) < 1.3 * peak(20)


def test_a_page_is_parsed_once_for_child_steps(spark):
    pages = spark.createDataFrame([(1, "<nav><ul><li>a</li><li>b</li></ul></nav><ul><li>c</ul>")], "page_id long, html string")
    found = html.select(html.parse_html(pages), "nav > ul > li")
    assert "_parse" not in found._jdf.queryExecution().executedPlan().toString()  # it was, ahead of the steps
    assert sorted(r.text for r in found.collect()) == ["a", "b"]
