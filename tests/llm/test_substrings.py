import random

import numpy as np
import pytest
from conftest import DATA
from pyspark.sql import functions as F

from sheaf.llm import substrings
from sheaf.llm.queries import QUERIES


def brute(rows, size=substrings.WINDOW):
    """(doc_id, n_words, n_removed, kept) by a table of all windows."""
    words = [[w.decode() for w in (t or "").encode().split()] for _, t in rows]
    least = {}
    for (d, _), ws in zip(rows, words):
        for i in range(len(ws) - size + 1):
            if d is not None:
                key = tuple(ws[i : i + size])
                least[key] = min(least.get(key, d), d)
    out = []
    for (d, _), ws in zip(rows, words):
        gone = set()
        for i in range(len(ws) - size + 1):
            first = least.get(tuple(ws[i : i + size]))
            if first is not None and (d is None or first < d):
                gone.update(range(i, i + size))
        out.append((d, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)))
    return sorted(out, key=str)


def found(docs, size=substrings.WINDOW):
    rows = substrings.deduplicated(docs, size=size).collect()
    for r in rows:
        assert sum(s["end"] - s["start"] for s in r["spans"]) == r["n_removed"]
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:]))
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in rows), key=str)


def tangle(n=120, seed=4):
    """Texts of a few shared passages, cut, joined, repeated and edited; ids tie, and some are null."""
    rng = random.Random(seed)
    passages = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))] for _ in range(12)]
    for i in range(n):
        words = []
        for _ in range(rng.randrange(5)):
            p = list(rng.choice(passages))
            if rng.random() < 0.4:
                p[rng.randrange(len(p))] = f"e{rng.randrange(99)}"
            a = rng.randrange(len(p))
            words += p if rng.random() < 0.5 else p[a:]
            words += [f"u{rng.randrange(9999)}" for _ in range(rng.randrange(4))]
        yield (None if rng.random() < 0.05 else rng.randrange(n // 2) if rng.random() < 0.2 else 1000 + i, rng.choice([" ", "\n", " \t"]).join(words))


@pytest.mark.parametrize("size", [8, 25])
def test_tangles_equal_brute_force(llm, size):
    rows = list(tangle())
    docs = llm.createDataFrame(rows, "doc_id long, text string")
    assert found(docs.repartition(5), size) == brute(rows, size)


def test_documents_equal_brute_force(llm):
    rows = [tuple(r) for r in llm.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    expected = {d: (n, k) for d, n, k, _ in brute(rows)}
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in QUERIES["op11_substrings"](llm, DATA).collect()} == expected
    assert any(k for _, k in expected.values())


def test_odd_rows(llm, odd, none):
    long = " ".join(f"v{i % 4999} q{i % 13}" for i in range(30_000))
    extra = llm.createDataFrame([(20, long), (21, "before " + long), (None, long), (22, long[: len(long) // 2])], "doc_id long, text string")
    docs = odd.select("doc_id", "text").union(extra)
    rows = [tuple(r) for r in docs.collect()]
    assert found(docs) == brute(rows)
    assert found(docs.withColumn("id", F.lit(1)).withColumn("h", F.lit(2)).repartition(6)) == brute(rows)
    assert found(none) == []


def test_string_ids(llm):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [("b", f"x {passage} y"), ("a", f"z {passage}"), ("c", passage)]
    assert found(llm.createDataFrame(rows, "doc_id string, text string")) == brute(rows)


def test_a_path_is_one_row_for_each_source(llm):
    shared = [f"s{i}" for i in range(200)]
    rows = [(1, " ".join(shared)), (2, " ".join(["x", *shared, "y"])), (3, " ".join(shared[50:150] + ["z"])), (4, "other words " * 60)]
    docs = substrings.named(llm.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    suspected = substrings.suspects(docs, 50)
    made = [r for r in substrings.paths(docs, suspected, 50).collect() if r["repeated"]]
    assert [(r["id"], r["start"], r["n"]) for r in made] == [(1, 0, 151)]


def test_other_sources_and_branches_cut_paths(llm):
    a, b, c = ([f"{x}{i}" for i in range(100)] for x in "abc")
    rows = [(1, " ".join(a + b)), (2, " ".join(a + c)), (3, " ".join(a + b)), (4, " ".join(a + c))]
    docs = substrings.named(llm.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    made = sorted((r["id"], r["start"], r["n"]) for r in substrings.paths(docs, substrings.suspects(docs, 50), 50).collect())
    assert made == [(1, 0, 51), (1, 51, 100), (2, 51, 100)]


def test_first_window_of_equal_ones():
    text = np.frombuffer(b"a b a b a c", np.uint8)
    w = substrings.Windows(text, np.array([0, len(text)]), 2)
    assert w.firsts(np.arange(5)).tolist() == [0, 1, 0, 1, 4]
