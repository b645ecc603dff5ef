"""Pages to trees of nodes, and searches over them.

``parse_html`` keeps a page's tree in one row: all visible text once, and the nodes in
document order with their place in that text. What looks at one page at a time (tags, texts,
records) is then a plain expression on the row and needs no shuffle. Searches that relate
nodes to each other explode only the nodes they name and work per page.
"""

from collections import Counter
from collections.abc import Iterator
from html import unescape
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sheaf.functions import selectors
from sheaf.functions.selectors import Step
from sheaf.schema import NODE, TREE, VOID_ELEMENTS
from sheaf.session import settled, spread

RAW_TEXT_IN = ("script", "style")
BLOCK = 256
#: Bytes of HTML whose nodes Python holds at a time; one longer page is parsed alone.
PART_BYTES = 1 << 20
ASCII_SPACE = " \t\n\r\f\v"


class _Walk(HTMLParser):
    """Collects one page's nodes; an end tag closes up to its nearest open element."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.rows, self.open, self.run = [], [], []
        self.opened = Counter()
        self.shown, self.raw = bytearray(), bytearray()

    def add(self, tag, attrs, start, end):
        parent = self.open[-1] if self.open else -1
        self.rows.append([parent, len(self.rows), tag, attrs, start, end])
        return len(self.rows) - 1

    def flush(self):
        text, self.run = "".join(self.run), []
        if not text:
            return
        inside = {self.rows[i][2] for i in self.open[-1:]}
        if not text.strip(ASCII_SPACE) and not self.opened["pre"] and not self.opened["textarea"]:
            text = "\n" if "\n" in text else " "
        hidden = bool(inside & set(RAW_TEXT_IN))
        buffer = self.raw if hidden else self.shown
        start = len(buffer)
        buffer += text.encode("utf-8", "replace")
        self.add("#raw" if hidden else "#text", (), start, len(buffer))

    def close_to(self, depth):
        for i in self.open[depth:]:
            self.rows[i][1] = len(self.rows) - 1
            self.rows[i][5] = len(self.shown)
            self.opened[self.rows[i][2]] -= 1
        del self.open[depth:]

    def handle_starttag(self, tag, attrs):
        self.flush()
        given = {k: v or "" for k, v in attrs}
        i = self.add(tag, tuple(given.items()), len(self.shown), len(self.shown))
        if tag not in VOID_ELEMENTS:
            self.open.append(i)
            self.opened[tag] += 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_ELEMENTS:
            self.close_to(len(self.open) - 1)

    def handle_endtag(self, tag):
        self.flush()
        if self.opened[tag]:
            depth = len(self.open) - 1
            while self.rows[self.open[depth]][2] != tag:
                depth -= 1
            self.close_to(depth)

    def handle_data(self, data):
        self.run.append(data)

    def handle_entityref(self, name):
        self.run.append(html5.get(name + ";", "&" + name))

    def handle_charref(self, name):
        self.run.append(unescape(f"&#{name};"))

    def handle_comment(self, data):
        self.flush()

    handle_decl = handle_pi = unknown_decl = handle_comment

    def walked(self, html):
        self.feed(html)
        self.close()
        self.flush()
        self.close_to(0)
        for row in self.rows:
            if row[2] == "#raw":
                row[4] += len(self.shown)
                row[5] += len(self.shown)
        return bytes(self.shown + self.raw), self.rows


def walked(html: str) -> tuple[bytes, list]:
    """A page's text, and its nodes as [parent, last, tag, attributes, text from, text to] in document order."""
    return _Walk().walked(html)


def parts(pages: pa.Array, most: int = PART_BYTES) -> Iterator[pa.Array]:
    """A batch of pages in parts of up to ``most`` bytes, or one longer page, as nodes in Python take many times a page's bytes."""
    size = pc.binary_length(pages).fill_null(0).to_numpy(zero_copy_only=False).astype("int64")
    ends = size.cumsum()
    at, done = 0, 0
    while at < len(pages):
        to = max(at + 1, int(ends.searchsorted(done + most, "right")))
        yield pages.slice(at, to - at)
        at, done = to, int(ends[to - 1])


@F.arrow_udf(TREE)
def _parse(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for pages in batches:
        yield from map(_trees, parts(pages))


def _trees(pages: pa.Array) -> pa.Array:
    texts, ends, nodes, attr_ends, keys, values = [], [0], [], [0], [], []
    for html in pages.to_pylist():
        text, rows = (None, []) if html is None else _Walk().walked(html)
        texts.append(text)
        for i, row in enumerate(rows):
            nodes.append((i, *row))
            for k, v in row[3]:
                keys.append(k)
                values.append(v)
            attr_ends.append(len(keys))
        ends.append(len(nodes))
    ids, parents, lasts, tags, _, starts, stops = zip(*nodes) if nodes else [()] * 7
    attrs = pa.MapArray.from_arrays(
        pa.array(attr_ends, pa.int32()), pa.array(keys, pa.string()), pa.array(values, pa.string()))
    ints = [pa.array(c, pa.int32()) for c in (ids, parents, lasts, starts, stops)]
    flat = pa.StructArray.from_arrays(
        [*ints[:3], pa.array(tags, pa.string()), attrs, *ints[3:]],
        ["node_id", "parent_id", "last_id", "tag", "attrs", "text_from", "text_to"])
    trees = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return pa.StructArray.from_arrays([pa.array(texts, pa.binary()), trees], ["text", "nodes"])


# Evaluated once per page, whatever filters and fields are taken from it later.
_parse = _parse.asNondeterministic()


def parse_html(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(page_id, tree) plus the columns in ``keep``; only ``html`` goes to Python and ends there."""
    return spread(pages.select(key, *keep, html)).select(F.col(key).alias("page_id"), *keep, _parse(html).alias("tree"))


def text_of(node: Column, tree: Column | None = None) -> Column:
    """Visible text of a node, in document order and without scripts, styles and comments.

    It is a slice of the page's text, as a node's descendants follow it without a gap.
    """
    text = F.col("tree.text") if tree is None else tree["text"]
    return F.substring(text, node["text_from"] + 1, node["text_to"] - node["text_from"]).cast("string")


def matching(step: Step) -> Column:
    return F.filter("tree.nodes", step.matches)


def nodes(trees: DataFrame) -> DataFrame:
    """The node table: one row per element and text run."""
    return trees.select("page_id", F.inline("tree.nodes"))


def _rows(trees: DataFrame, picked: Column, keep: tuple[str, ...] = ()) -> DataFrame:
    """The picked nodes of each page as rows with their text."""

    def row(n: Column) -> Column:
        return F.struct(n["node_id"].alias("node_id"), n["parent_id"].alias("parent_id"),
                        n["last_id"].alias("last_id"), n["tag"].alias("tag"), n["attrs"].alias("attrs"),
                        text_of(n).alias("text"))

    return trees.select("page_id", *keep, F.inline(F.transform(picked, row)))


def find_all(trees: DataFrame, tag: str) -> DataFrame:
    """All elements of a tag (or text runs, by ``#text``) with their text."""
    return _rows(trees, matching(Step(tag)))


def select(trees: DataFrame, steps: str | list[Step]) -> DataFrame:
    """All matches of a CSS selector (or of given steps), with their text."""
    steps = selectors.css(steps) if isinstance(steps, str) else steps
    if len(steps) == 1:
        return _rows(trees, matching(steps[0]))
    return _chain(_candidates(trees, steps), ["page_id"], steps)


def select_first(trees: DataFrame, css: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The first match per page in document order; pages without one give no row."""
    found = first_match(selectors.css(css))
    return _rows(trees, F.filter(F.array(found), lambda n: n.isNotNull()), keep)


def first_match(steps: list[Step]) -> Column:
    """The first node of a page that satisfies the steps, or null; needs no shuffle.

    One pass over the page's candidate nodes in document order. Per step it carries the highest
    ``last_id`` of the matches so far (a later node lies inside one of them exactly when
    that reaches it), and for a step with a child step behind it the matches still open.
    """
    if len(steps) == 1:
        return F.try_element_at(matching(steps[0]), F.lit(1))
    return _pass(steps, "hit")


def count_matches(steps: list[Step]) -> Column:
    """The number of matches of a chain of steps in the row's own page, in the same one pass."""
    return F.size(matching(steps[0])).cast("long") if len(steps) == 1 else _pass(steps, "n")


def _pass(steps: list[Step], wanted: str) -> Column:
    feeding = range(len(steps) - 1)
    opened = [i for i in feeding if steps[i + 1].child]
    no_nodes = F.array().cast("array<struct<id:int,last:int>>")
    zero = F.struct(
        *[F.lit(-1).alias(f"reach{i}") for i in feeding],
        *[no_nodes.alias(f"open{i}") for i in opened],
        F.lit(None).cast(NODE).alias("hit"), F.lit(0).cast("long").alias("n"))

    def visit(acc: Column, n: Column) -> Column:
        on = [steps[0].matches(n)]
        for i, step in enumerate(steps[1:]):
            inside = (F.exists(acc[f"open{i}"], lambda x: x["id"] == n["parent_id"]) if step.child
                      else acc[f"reach{i}"] >= n["node_id"])
            on.append(step.matches(n) & inside)
        reach = [F.when(on[i], F.greatest(acc[f"reach{i}"], n["last_id"])).otherwise(acc[f"reach{i}"]).alias(f"reach{i}")
                 for i in feeding]
        still = []
        for i in opened:
            kept = F.filter(acc[f"open{i}"], lambda x: x["last"] >= n["node_id"])
            me = F.struct(n["node_id"].alias("id"), n["last_id"].alias("last"))
            still.append(F.when(on[i], F.array_append(kept, me)).otherwise(kept).alias(f"open{i}"))
        hit = acc["hit"] if wanted == "n" else F.when(on[-1], n)
        moved = F.struct(*reach, *still, hit.alias("hit"), (acc["n"] + F.when(on[-1], 1).otherwise(0)).alias("n"))
        return moved if wanted == "n" else F.when(acc["hit"].isNotNull(), acc).otherwise(moved)

    return F.aggregate(F.filter("tree.nodes", lambda n: _any(steps, n)), zero, visit, lambda acc: acc[wanted])


def _any(steps: list[Step], n: Column) -> Column:
    out = steps[0].matches(n)
    for s in steps[1:]:
        out = out | s.matches(n)
    return out


def _candidates(trees: DataFrame, steps: list[Step]) -> DataFrame:
    """Nodes that match any step, with one flag per step; text only for the last step's."""

    def row(n: Column) -> Column:
        flags = [s.matches(n).alias(f"m{i}") for i, s in enumerate(steps)]
        return F.struct(n["node_id"].alias("node_id"), n["parent_id"].alias("parent_id"),
                        n["last_id"].alias("last_id"), n["tag"].alias("tag"), n["attrs"].alias("attrs"),
                        F.when(steps[-1].matches(n), text_of(n)).alias("text"), *flags)

    return trees.select("page_id", F.inline(F.transform(F.filter("tree.nodes", lambda n: _any(steps, n)), row)))


def _chain(candidates: DataFrame, keys: list[str], steps: list[Step]) -> DataFrame:
    """Candidates that satisfy the whole chain of steps.

    Node intervals nest, so a node lies inside an earlier match exactly when the highest
    ``last_id`` of the matches before it reaches it: a running maximum in document order,
    with one shuffle and sort for the whole chain. A child step looks its parent up by id, in candidates
    that are kept, so that pages are not parsed again for each of them.
    """
    if any(step.child for step in steps[1:]):
        candidates = settled(candidates)
    before = Window.partitionBy(*keys).orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    df = candidates.withColumn("on", F.col("m0"))
    for i, step in enumerate(steps[1:], 1):
        if step.child:
            parents = df.filter("on").select(*keys, F.col("node_id").alias("parent_id"), F.lit(True).alias("_p"))
            inside = F.coalesce("_p", F.lit(False))
            df = df.join(parents, [*keys, "parent_id"], "left").withColumn("on", F.col(f"m{i}") & inside).drop("_p")
        else:
            reach = F.max(F.when(F.col("on"), F.col("last_id"))).over(before)
            df = df.withColumn("on", F.col(f"m{i}") & F.coalesce(reach >= F.col("node_id"), F.lit(False)))
    return df.filter("on").select(*keys, "node_id", "parent_id", "last_id", "tag", "attrs", "text")


def descendants(of: DataFrame, among: DataFrame) -> DataFrame:
    """Pairs of an element in ``of`` (as ``scope_id``) and a node in ``among`` below it.

    An interval join: nodes meet the elements that reach into their block of 256 node ids, so
    on a very large page a node is not compared with every element of the page.
    """
    outer = of.select("page_id", F.col("node_id").alias("scope_id"), F.col("last_id").alias("_last"))
    blocks = F.sequence(F.floor(F.col("scope_id") / BLOCK), F.floor(F.col("_last") / BLOCK))
    outer = outer.withColumn("_block", F.explode(blocks))
    inner = among.withColumn("_block", F.floor(F.col("node_id") / BLOCK))
    below = (F.col("node_id") > F.col("scope_id")) & (F.col("node_id") <= F.col("_last"))
    return outer.join(inner, ["page_id", "_block"]).filter(below).drop("_block", "_last")


def children(of: DataFrame, among: DataFrame) -> DataFrame:
    """Pairs of an element (``scope_id``) and a node whose parent it is."""
    outer = of.select("page_id", F.col("node_id").alias("scope_id"))
    return outer.join(among.withColumn("scope_id", F.col("parent_id")), ["page_id", "scope_id"])


def xpath(trees: DataFrame, expr: str, scope: DataFrame | None = None) -> DataFrame:
    """Matches of an XPath. From a ``scope`` of elements, ``.//`` looks below each of them (and
    gives ``scope_id``), while ``//`` still searches the whole of the pages they are on."""
    relative, steps = selectors.xpath(expr)
    if not relative:
        if steps[0].child:
            raise ValueError("a path starts with // or .//")
        found = select(trees, steps)
        return found if scope is None else found.join(scope.select("page_id"), "page_id", "left_semi")
    if scope is None:
        raise ValueError("a relative path needs a scope")
    pair = children if steps[0].child else descendants
    if len(steps) == 1:
        return pair(scope, select(trees, steps))
    candidates = _candidates(trees, steps)
    started = pair(scope, candidates.filter("m0")).select(
        "page_id", "scope_id", "node_id", F.lit(True).alias("_start"))
    below = descendants(scope, candidates).join(started, ["page_id", "scope_id", "node_id"], "left")
    return _chain(below.withColumn("m0", F.coalesce("_start", F.lit(False))), ["page_id", "scope_id"], steps)


def relevant_sections(trees: DataFrame, tags: list[str], terms: list[str]) -> DataFrame:
    """Sections of the named tags whose text mentions a term (any case), outermost ones only.

    A section inside a kept one is left out, since its text is there already.
    """

    def wanted(n: Column) -> Column:
        text = F.lower(text_of(n))
        hit = F.lit(False)
        for t in terms:
            hit = hit | F.contains(text, F.lit(t.lower()))
        return n["tag"].isin(tags) & hit

    before = Window.partitionBy("page_id").orderBy("node_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = _rows(trees, F.filter("tree.nodes", wanted))
    nested = F.coalesce(F.max("last_id").over(before) >= F.col("node_id"), F.lit(False))
    return kept.withColumn("_nested", nested).filter(~F.col("_nested")).drop("_nested")


def section_text(sections: DataFrame) -> DataFrame:
    """One row per page: the kept sections' text, in document order."""
    parts = F.array_sort(F.collect_list(F.struct("node_id", "text")))
    return sections.groupBy("page_id").agg(parts.alias("_parts")).select(
        "page_id", F.array_join(F.transform("_parts", lambda p: p["text"]), "\n").alias("text"))


def require_element(trees: DataFrame, html: str, tag: str = "body") -> DataFrame:
    """``content``: the page as it is when it has the element, else null."""
    there = F.exists("tree.nodes", lambda n: n["tag"] == tag)
    return trees.withColumn("content", F.when(there, F.col(html)))
