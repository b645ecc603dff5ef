import hashlib
import re

from conftest import DATA

from sheaf.llm import decontaminate
from sheaf.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s : s + k]), set()).add(i)
    sizes = {len(x) for x in windows}
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for k in sizes:
            for s in range(len(w) - k + 1):
                if (of := windows.get(tuple(w[s : s + k]))) is not None:
                    hit.update(range(s, s + k))
                    ids.update(str(x) for x in of if x is not None)
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def found(docs, items):
    return sorted((tuple(r) for r in decontaminate.judged(docs, items).drop("key").collect()), key=str)


def test_against_brute_force(llm):
    docs, items = (llm.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = sorted((tuple(r) for r in QUERIES["op7_decontamination"](llm, DATA).collect()), key=str)
    assert rows == brute([(r["doc_id"], r["text"]) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert any(r[5] for r in rows)


def test_odd_rows_and_short_items(llm, odd, none):
    texts = [(1, "one"), (2, "One"), (2, "two THREE"), (3, None), (4, ""), (None, "quick brown fox"), (5, "a while in the sun"), (6, "word5 thing5. word6 thing6"),
             (7, " ".join(f"word{i} thing{i}" for i in range(31)))]
    items = llm.createDataFrame(texts, "item_id long, text string")
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert found(odd, items) == brute(rows, texts)
    assert all(r[2] == 0 for r in found(odd, items.limit(0)))
    assert found(none, items) == []


def test_clean_rows_stay(llm, odd):
    items = llm.createDataFrame([(1, "over the lazy dog and then it rests for a while in the sun")], "item_id long, text string")
    left = decontaminate.clean(odd, items)
    assert left.columns == odd.columns
    assert sorted(str(r["doc_id"]) for r in left.collect()) == sorted(str(r["doc_id"]) for r in odd.collect() if r["doc_id"] not in (1, 2))


def test_a_passage_in_all_documents_and_items(llm):
    passage = " ".join(f"p{i}" for i in range(50))
    docs = llm.createDataFrame([(i, f"start{i} {passage} end{i} {passage}") for i in range(60)], "doc_id long, text string")
    items = llm.createDataFrame([(i, f"q{i} {passage}") for i in range(9)], "item_id long, text string")
    assert found(docs, items) == brute([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
