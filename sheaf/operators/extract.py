"""Structured records from page trees, and answers of a caller's model."""

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sheaf.functions import selectors
from sheaf.operators.html import count_matches, first_match, parts, text_of, walked
from sheaf.session import spread


@dataclass(frozen=True)
class Field:
    """One field of a record: the first match's text or attribute, or the number of matches."""

    selector: str
    attr: str | None = None
    type: str = "string"
    count: bool = False


def _column(field: Field) -> Column:
    steps = selectors.css(field.selector)
    if field.count:
        return count_matches(steps).cast(field.type if field.type != "string" else "long")

    def value(node: Column) -> Column:
        return F.try_element_at(node["attrs"], F.lit(field.attr)) if field.attr else text_of(node)

    # The array binds the found node to a name, so that it is searched for once.
    return F.transform(F.array(first_match(steps)), value)[0].try_cast(field.type)


def extract_records(trees: DataFrame, spec: dict[str, Field], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per page with a typed column per field, null where nothing matches.

    All fields are read from the page's own row: the page is parsed once and nothing is
    shuffled, whatever the selectors.
    """
    fields = [_column(field).alias(name) for name, field in spec.items()]
    return trees.select("page_id", *keep, *fields)


class Automaton:
    """All selectors of a spec as one automaton over the elements of a page in document order.

    A state is a field and the step it waits for: at any element below, or only at the children of the one before. An element inherits the states
    of its parent. Sets of states are numbered as they come up, and so is which states of a set a tag can satisfy, so that an element
    costs two look-ups, however many fields there are, and tests for those alone that its tag concerns.
    """

    def __init__(self, spec: dict[str, Field]):
        self.fields = list(spec.values())
        self.steps = [selectors.css(f.selector) for f in self.fields]
        self.sets, self.numbers, self.moves, self.unions = [], {}, {}, {}
        self.start = self.number(frozenset((f, 0) for f in range(len(self.fields))))
        self.empty = self.number(frozenset())

    def number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
        return self.numbers[states]

    def satisfied(self, below: int, children: int, tag: str) -> list:
        """(field, step's place, tests) of the states of two sets that an element of this tag can satisfy."""
        key = below, children, tag
        found = self.moves.get(key)
        if found is None:
            found = self.moves[key] = [
                (f, k, self.steps[f][k].tests) for f, k in sorted(self.sets[below] | self.sets[children]) if self.steps[f][k].tag in (None, tag)]
        return found

    def with_more(self, number: int, more: tuple) -> int:
        if not more:
            return number
        key = number, more
        if key not in self.unions:
            self.unions[key] = self.number(self.sets[number] | frozenset(more))
        return self.unions[key]

    def run(self, rows: list) -> tuple[list[int | None], list[int]]:
        """Of each field the first node that matches, and how many do."""
        first, count = [None] * len(self.fields), [0] * len(self.fields)
        below, children = [], []
        for i, (parent, _, tag, attrs, *_) in enumerate(rows):
            near, there = (below[parent], children[parent]) if parent >= 0 else (self.start, self.empty)
            deeper, directly = (), ()
            for f, k, tests in self.satisfied(near, there, tag) if tag[0] != "#" else ():
                if tests and not passes(dict(attrs), tests):
                    continue
                if k + 1 == len(self.steps[f]):
                    count[f] += 1
                    if first[f] is None:
                        first[f] = i
                elif self.steps[f][k + 1].child:
                    directly += ((f, k + 1),)
                else:
                    deeper += ((f, k + 1),)
            below.append(self.with_more(near, deeper))
            children.append(self.with_more(self.empty, directly))
        return first, count


def passes(attrs: dict[str, str], tests: tuple) -> bool:
    for name, op, value in tests:
        own = attrs.get(name)
        if own is None or op == "word" and value not in re.split(r"\s+", own) or op == "is" and own != value:
            return False
    return True


def extract_pages(pages: DataFrame, spec: dict[str, Field], key: str = "page_id", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """``extract_records`` of pages that are parsed for this alone: one pass over a page's nodes finds all fields, and
    only these leave Python, not the nodes. For many fields, or trees that nothing else uses."""
    names = [f"f{i}" for i in range(len(spec))]

    @F.arrow_udf(StructType([StructField(n, StringType()) for n in names]))
    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        machine = Automaton(spec)
        for column in (part for pages in batches for part in parts(pages)):
            out = [[] for _ in names]
            for page in column.to_pylist():
                text, rows = (b"", []) if page is None else walked(page)
                first, count = machine.run(rows)
                for values, field, node, n in zip(out, machine.fields, first, count):
                    if field.count:
                        values.append(str(n))
                    elif node is None:
                        values.append(None)
                    elif field.attr:
                        values.append(dict(rows[node][3]).get(field.attr))
                    else:
                        values.append(text[rows[node][4] : rows[node][5]].decode("utf-8", "replace"))
            yield pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in out], names)

    found = spread(pages.select(key, *keep, html)).select(F.col(key).alias("page_id"), *keep, read.asNondeterministic()(html).alias("found"))
    kinds = [("long" if f.type == "string" else f.type) if f.count else f.type for f in spec.values()]
    return found.select("page_id", *keep, *[F.col("found")[n].try_cast(t).alias(name) for n, t, name in zip(names, kinds, spec)])


def structure_with_model(
    sections: DataFrame, prompt: str, open_model: Callable[[], Callable[[list[str]], list[str]]], text: str = "text"
) -> DataFrame:
    """Adds ``answer``: the caller's model on the prompt and each row's filtered text.

    ``open_model`` runs once per partition and gives a function over a list of prompts.
    """

    @F.arrow_udf(StringType())
    def ask(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        answer = open_model()
        for prompts in batches:
            yield pa.array(answer(prompts.to_pylist()), pa.string())

    question = F.concat(F.lit(prompt + "\n\n"), F.col(text))
    return sections.withColumn("answer", ask.asNondeterministic()(question))


def parse_answers(df: DataFrame, schema: str, col: str = "answer") -> tuple[DataFrame, DataFrame]:
    """(records, rejected): answers as columns of ``schema`` (a DDL string); broken ones rejected.

    An answer is broken when it is not JSON or a field does not fit its type.
    """
    whole = F.from_json(col, f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"})
    read = df.withColumn("_record", whole)
    broken = F.col("_record").isNull() | F.col("_record._bad").isNotNull()
    names = StructType.fromDDL(schema).fieldNames()
    records = read.filter(~broken).select(*df.columns, *[F.col("_record")[n].alias(n) for n in names])
    return records, read.filter(broken).select(*df.columns)
