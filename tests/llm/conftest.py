import pytest

from sheaf.llm.words import tuned

DATA = "/root/testdata/sf0.001"

LONG = " ".join(f"word{i % 977} thing{i % 31}." for i in range(20_000))
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and then it rests for a while in the sun."),
    (2, "The quick brown fox jumps over the lazy dog and then it rests for a while in the sun."),
    (2, "The quick brown fox jumps over the lazy dog and then it rests for a while in the sun."),
    (3, ""), (4, None), (None, "A row without an id, but with some words in its text."), (None, None), (5, " \n\t "),
    (6, LONG), (7, "Straße café naïve 東京 ΑΣ KelvinK <|endoftext|> it's 100%.\nİstanbul x y á e ́"), (8, "one"), (8, "two"),
]


@pytest.fixture(scope="session")
def llm(spark):
    return tuned(spark)


@pytest.fixture(scope="session")
def odd(llm):
    """Nulls, empty and long texts, ties, repeated rows, and columns named as the operators' own."""
    rows = [(i, t, "en", None if i is None else f"s{(i or 0) % 2}", 0, "x", 1, 2.0, "y", 3, True, 7) for i, t in TEXTS]
    return llm.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key string, fp long, score double, label string,"
        " copy int, contaminated boolean, first long")


@pytest.fixture(scope="session")
def odder(odd):
    """The same with columns of names and types that clash more."""
    return odd.selectExpr(
        "*", "'n' as __n", "'h' as __hash", "doc_id as __id", "1 as __score", "'r' as __row", "'u' as __u", "text as hash", "map('k', key) as tags",
        "parse_json('{\"a\": 1}') as doc", "3 as `dot.ted name`", "struct(1 as `x.y`, map(1, 2) as m) as nested", "doc_id as id", "text as `tick``s`")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
