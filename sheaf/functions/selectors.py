"""A small subset of CSS and XPath as lists of steps over nodes.

CSS: tag, ``*``, ``#id``, ``.class``, ``[a]``, ``[a=v]``, descendant and ``>``.
XPath: ``//tag``, ``/tag``, ``*``, ``[@a]``, ``[@a='v']``; ``.//`` starts at a given element.
"""

import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Step:
    """One compound selector and how it hangs on the one before it."""

    tag: str | None = None
    tests: tuple = field(default_factory=tuple)
    child: bool = False

    def matches(self, node: Column) -> Column:
        named = node["tag"] == self.tag if self.tag else ~F.startswith(node["tag"], F.lit("#"))
        for name, op, value in self.tests:
            attr = F.try_element_at(node["attrs"], F.lit(name))
            if op == "has":
                named = named & attr.isNotNull()
            elif op == "word":
                named = named & F.array_contains(F.split(F.coalesce(attr, F.lit("")), r"\s+"), value)
            else:
                named = named & (F.coalesce(attr, F.lit("\0")) == value)
        return named


_CSS_PART = re.compile(
    r"(?P<gt>\s*>\s*)|(?P<space>\s+)|(?P<tag>\*|[\w-]+)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)"
    r"|\[\s*(?P<attr>[\w:-]+)\s*(?:=\s*(?P<q>[\"']?)(?P<val>[^\"'\]]*)(?P=q)\s*)?\]"
)


def css(selector: str) -> list[Step]:
    steps, tag, tests, child, at = [], None, [], False, 0
    text, given = selector.strip(), False
    while at < len(text):
        m = _CSS_PART.match(text, at)
        if not m or (m["gt"] or m["space"]) and not given:
            raise ValueError(f"unsupported selector: {selector!r}")
        at, given = m.end(), not (m["gt"] or m["space"])
        if not given:
            steps.append(Step(tag, tuple(tests), child))
            tag, tests, child = None, [], bool(m["gt"])
        elif m["tag"]:
            tag = None if m["tag"] == "*" else m["tag"].lower()
        elif m["id"]:
            tests.append(("id", "is", m["id"]))
        elif m["cls"]:
            tests.append(("class", "word", m["cls"]))
        else:
            tests.append((m["attr"].lower(), "has" if m["val"] is None else "is", m["val"]))
    if not given:
        raise ValueError(f"unsupported selector: {selector!r}")
    return [*steps, Step(tag, tuple(tests), child)]


_XPATH_STEP = re.compile(r"(//?)(\*|[\w-]+)((?:\[@[\w:-]+(?:=(?:'[^']*'|\"[^\"]*\"))?\])*)")
_XPATH_TEST = re.compile(r"\[@([\w:-]+)(?:=(?:'([^']*)'|\"([^\"]*)\"))?\]")


def xpath(expr: str) -> tuple[bool, list[Step]]:
    """(relative, steps); relative expressions begin with a dot."""
    relative = expr.startswith(".")
    path, at, steps = expr[relative:], 0, []
    while at < len(path):
        m = _XPATH_STEP.match(path, at)
        if not m:
            break
        at = m.end()
        tests = tuple(
            (a.lower(), "has" if v is None and w is None else "is", v if v is not None else w)
            for a, v, w in ((t[1], t[2], t[3]) for t in _XPATH_TEST.finditer(m[3])))
        tag = None if m[2] == "*" else m[2].lower()
        steps.append(Step(tag, tests, m[1] == "/"))
    if at < len(path) or not steps:
        raise ValueError(f"unsupported xpath: {expr!r}")
    return relative, steps
