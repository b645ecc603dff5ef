import hashlib
import random
import zlib

import numpy as np
from conftest import DATA

from sheaf.llm import periodic
from sheaf.llm.queries import QUERIES


def brute(words, shortest=periodic.SHORTEST):
    """All runs by comparing words at each distance; the smallest period of a stretch counts."""
    out, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                out.setdefault((i, j + q - i), q)
            i = max(j, i + 1)
    return sorted(((s, length, q) for (s, length), q in out.items()), key=lambda r: (r[0], r[2]))


def collapsed(words, runs):
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def some_texts(n=150):
    rng = random.Random(5)
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(90):
            base = [rng.choice("abc"[: rng.randrange(1, 4)]) for _ in range(rng.randrange(1, 12))]
            words += (base * rng.randrange(1, 6))[: rng.randrange(1, 60)]
        yield words


def test_runs_equal_brute_force():
    for words in some_texts():
        assert periodic.runs_of([ord(w) for w in words]) == brute(words)
        assert periodic.runs_of([ord(w) for w in words], 4) == brute(words, 4)


def test_common_extensions():
    rng = random.Random(6)
    for _ in range(30):
        words = [rng.randrange(3) for _ in range(rng.randrange(1, 80))]
        tree, n = periodic.SuffixTree(words), len(words)
        pairs = [(i, j) for i in range(n + 1) for j in range(n + 1) if i != j]
        expected = [next((k for k in range(n) if i + k >= n or j + k >= n or words[i + k] != words[j + k]), n) for i, j in pairs]
        assert tree.common(*np.array(pairs).T).tolist() == expected
        assert tree.rank[:n].argsort().tolist() == sorted(range(n), key=lambda i: words[i:])
        assert tree.back()[:n].argsort().tolist() == sorted(range(n), key=lambda i: [-w for w in words[i:]])


def test_operator_equals_brute_force(llm):
    texts = [(i, " ".join(w)) for i, w in enumerate(some_texts())]
    texts += [(900, "x " * 5000), (901, "a\x00 b\x00 " * 9), (902, "a\x00 a b " * 3 + " c"), (903, "é\tü\n" * 8 + "end")]
    for r in periodic.runs(llm.createDataFrame(texts, "doc_id long, text string").repartition(3)).collect():
        words = [w.decode() for w in dict(texts)[r["doc_id"]].encode().split()]
        expected = brute(words) if len(words) < 1000 else [(0, len(words), 1)]
        assert [tuple(x) for x in r["runs"]] == expected and r["n_words"] == len(words)
        assert r["collapsed"] == collapsed(words, expected)


def planted(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words and doc_id is not None:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def row_of(doc_id, words):
    runs = brute(words)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return doc_id, len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(collapsed(words, runs))


COLUMNS = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_query_equals_brute_force(llm):
    docs = {r["doc_id"]: planted(r["doc_id"], r["text"]) for r in llm.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = {r["doc_id"]: tuple(r) for r in QUERIES["op12_periodic_runs"](llm, DATA).select(*COLUMNS).collect()}
    short = [d for d, words in docs.items() if len(words) < 800]
    assert len(rows) == len(docs) and len(short) > 100 and sum(rows[d][1] > 0 for d in short) > 5
    assert all(rows[d] == row_of(d, docs[d]) for d in short)


def test_odd_rows(llm, odd, none):
    rows = periodic.runs(odd).collect()
    assert len(rows) == odd.count() and periodic.runs(none).count() == 0
    for r in rows:
        assert r["collapsed"] is not None and (r["n_words"] > 0 or (r["collapsed"], r["runs"]) == ("", []))
