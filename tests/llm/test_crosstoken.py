import hashlib
from collections import Counter, defaultdict

import numpy as np
import sentencepiece
from conftest import DATA
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sheaf.llm import crosstoken
from sheaf.llm.queries import PAIR, QUERIES


def brute(rows):
    """All columns of op13 from whole texts, byte by byte."""
    a, b = Tokenizer.from_file(PAIR[0]), sentencepiece.SentencePieceProcessor(model_file=PAIR[1])
    a.encode_special_tokens = True
    table = crosstoken.byte_table()
    links, groups, out = [], [], []
    for _, text in rows:
        whole = (" " + (text or "")).encode()
        ids = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        spelt = [bytes(table[c] for c in a.id_to_token(i)) for i in ids[0]], [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids[1]]
        if not text or any(b"".join(s) != whole for s in spelt):
            links.append([]), groups.append(""), out.append((0, 0))
            continue
        at = [dict(zip(np.cumsum([len(x) for x in s]).tolist(), range(len(s)))) for s in spelt]
        ends = sorted(set(at[0]) & set(at[1]))
        links.append([(ids[0][at[0][e]], ids[1][at[1][e]]) for e in ends])
        since, parts = (0, 0), []
        for e in ends:
            to = at[0][e] + 1, at[1][e] + 1
            parts.append("|".join(",".join(map(str, i[s:t])) for i, s, t in zip(ids, since, to)))
            since = to
        groups.append(";".join(parts)), out.append((len(ids[0]), len(ids[1])))
    n = Counter(x for ls in links for x in ls)
    best = defaultdict(int)
    for (_, y), c in n.items():
        best[y] = max(best[y], c)
    return sorted((
        (d, *o, len(ls), len(ls), sum(n[x] == best[x[1]] for x in ls), sum(n[x] for x in ls), hashlib.sha256(g.encode()).hexdigest() if ls else "")
        for (d, _), o, ls, g in zip(rows, out, links, groups)), key=str)


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def digested(rows):
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return sorted((tuple(r) for r in rows.withColumn("groups_sha256", sha).select(*COLUMNS).collect()), key=str)


def test_against_whole_texts(llm):
    docs = [tuple(r) for r in llm.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted((tuple(r) for r in QUERIES["op13_alignment"](llm, DATA).select(*COLUMNS).collect()), key=str) == brute(docs)


STRANGE = [
    " a", "a ", "a  b", "a \n b\n\nc", "\t x \r\n y", "it's we'll 'S", "a▁b and more", "<s> <0x41> </s><unk>", "<|endoftext|> x <|endoftext|>",
    "\x00 \x1c a\x1cb \x1f c", "a\x85b \x85 c", "　東京 タワー　x", "é é Å ﬁ", "😀 👩‍👩‍👧 😀😀", "x" * 300, "12345 6789 0.5%", " ", "  ", "\n",
    "word word   word", "﻿a ​ b", "a b", "a!\x1c\x1d!b \x1e c", "end.\nStart \n\n  next\t\tone ", "日本語" * 50, "aa aa aa aa", "- -- --- ----", "don't  can't\twon't",
]


def test_strange_texts(llm):
    rows = list(enumerate(STRANGE))
    assert digested(crosstoken.aligned(llm.createDataFrame(rows, "doc_id long, text string").repartition(3), *PAIR)) == brute(rows)


def test_odd_rows(llm, odd, none, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    expected = brute(rows)
    assert digested(crosstoken.aligned(odd, *PAIR)) == expected
    assert digested(crosstoken.aligned(odd.repartition(7), *PAIR)) == expected
    assert crosstoken.aligned(none, *PAIR).count() == 0 and crosstoken.pair_counts(none, *PAIR).count() == 0


def test_tokenizers_that_reach_over_spaces_take_whole_texts(monkeypatch):
    with open(PAIR[0], encoding="utf-8") as a, open(PAIR[1], "rb") as b:
        aligner = crosstoken.Aligner(a.read(), b.read())
    texts = [*STRANGE, "", None]
    by_units = aligner.units(texts)
    aligner.in_units = False
    for x, y in zip(by_units, aligner.units(texts)):
        assert ";".join(u.groups for u in x) == ";".join(u.groups for u in y)
        assert crosstoken.pairs_of(x).tolist() == crosstoken.pairs_of(y).tolist()


def test_pair_counts(llm):
    docs = llm.createDataFrame([(1, "one two one"), (2, "one")], "doc_id long, text string")
    found = {(r["a"], r["b"]): r["n"] for r in crosstoken.pair_counts(docs, *PAIR).collect()}
    assert sorted(found.values()) == [1, 3]


def test_perfect_hash_is_minimal_and_verifies():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 200_000):
        keys = np.unique(rng.integers(0, 1 << 50, n, np.int64))
        h = crosstoken.PerfectHash(keys)
        assert np.array_equal(np.sort(h.verified(keys)), np.arange(len(keys)))
        assert np.array_equal(h.keys[h.verified(keys)], keys.astype(np.uint64))
        try:
            h.verified(np.array([1 << 51]))
        except ValueError:
            continue
        raise AssertionError("an unknown key was found")


def test_pairs_are_bounded_by_the_vocabularies():
    with open(PAIR[0], encoding="utf-8") as a, open(PAIR[1], "rb") as b:
        aligner = crosstoken.Aligner(a.read(), b.read())
    spelt = [Counter(t.bytes.values()) for t in (aligner.a, aligner.b)]
    ends = sum(n * spelt[1][x[i:]] for x, n in spelt[0].items() for i in range(len(x)))
    ends += sum(n * spelt[0][x[i:]] for x, n in spelt[1].items() for i in range(1, len(x)))
    assert ends < 600_000
