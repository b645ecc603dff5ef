import json
import random
import zlib

import numpy as np
import pytest
from conftest import DATA
from tokenizers import Tokenizer

from sheaf.llm import tokens
from sheaf.llm.queries import QUERIES, TOKENIZER
from sheaf.session import scratch


def brute(rows):
    """(doc_id, start, n_tokens, ids_crc32) with whole texts encoded by the library; ids may tie, so starts are left to a check."""
    t = Tokenizer.from_file(TOKENIZER)
    out = []
    for d, text in rows:
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        out.append((d, len(ids), zlib.crc32(ids.tobytes())))
    return sorted(out, key=str)


def agree(rows, docs):
    assert sorted(((d, n, c) for d, _, n, c in rows), key=str) == brute(docs)
    rows = sorted(rows, key=lambda r: r[1])
    assert [r[1] for r in rows] == [0, *np.cumsum([r[2] for r in rows]).tolist()][:-1]
    ids = [r[0] for r in rows if r[0] is not None]
    assert ids == sorted(ids)


def test_against_whole_texts(llm):
    docs = llm.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    agree([tuple(r) for r in QUERIES["op4_token_output"](llm, DATA).collect()], [tuple(r) for r in docs])


@pytest.mark.parametrize("planes", ["bit", "byte"])
def test_odd_rows(llm, odd, none, planes, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK_IDS", 1000)
    path = scratch(llm, "tokens")
    tokens.write_tokens(odd, path, TOKENIZER, planes=planes)
    agree([tuple(r) for r in tokens.read_digests(llm, path).collect()], [(r["doc_id"], r["text"]) for r in odd.collect()])
    whole = tokens.read_documents(llm, path).collect()
    assert sorted(zlib.crc32(np.array(r["ids"], "<u4").tobytes()) for r in whole) == sorted(c for _, _, c in brute([(r["doc_id"], r["text"]) for r in odd.collect()]))
    sizes = {(r["shard"], r["block"]): r["n"] for r in llm.read.parquet(path).collect()}
    last = {s: max(b for x, b in sizes if x == s) for s, _ in sizes}
    assert all(n == 1000 for (s, b), n in sizes.items() if b < last[s]) and max(last.values()) > 20
    empty = scratch(llm, "tokens")
    tokens.write_tokens(none, empty, TOKENIZER, planes=planes)
    assert tokens.read_digests(llm, empty).count() == 0


@pytest.mark.parametrize("planes", ["bit", "byte"])
@pytest.mark.parametrize("n", [1, 7, 8, 1001])
def test_planes_round_trip(planes, n):
    ids = np.random.default_rng(n).integers(0, 1 << 32, n, np.uint64).astype("<u4")
    assert (tokens.unpack(*tokens.pack(ids, planes), n) == ids).all()


def test_word_by_word_is_the_whole_text():
    t = Tokenizer.from_file(TOKENIZER)
    known = tokens.WordIds(t.to_str())
    assert known.by_words
    rnd = random.Random(7)
    marks = ["'s", "'LL", "<|EndOfText|>", "<|startoftext|>", "ς", "Σ", "İ", "́", "　", "一"]
    some = ["".join(rnd.choices([chr(c) for c in range(256)] + marks, k=rnd.randint(1, 20))) for _ in range(2000)]
    for text in [*some, "", " ", "Ünder Ÿ ÿ µ ß İ ΑΣ ΑΣ. J̌ x ́y", "a b c d\x1ce\x85f", "don't WE'LL 1234 ＦＵＬＬ <|startoftext|>x<|endoftext|>", "é ̈́ 각 각 ﬁ Ǆ"]:
        assert np.frombuffer(known.encode(text), "<u4").tolist() == t.encode(text, add_special_tokens=False).ids


def test_another_tokenizer_takes_whole_texts():
    spec = json.loads(Tokenizer.from_file(TOKENIZER).to_str())
    spec["pre_tokenizer"]["pretokenizers"][0]["pattern"] = {"Regex": r"[\\p{L}\\s]+|[^\\p{L}\\s]+"}
    known = tokens.WordIds(json.dumps(spec))
    assert not known.by_words
    t = Tokenizer.from_str(json.dumps(spec))
    assert np.frombuffer(known.encode("a b  Cd, e"), "<u4").tolist() == t.encode("a b  Cd, e", add_special_tokens=False).ids
