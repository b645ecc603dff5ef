import random

import pytest
import xxhash
from conftest import DATA

from sheaf.llm import simhash
from sheaf.llm.components import components
from sheaf.llm.queries import QUERIES


def print_of(text):
    words = (text or "").translate({i: i + 32 for i in range(65, 91)})
    for c in "\t\n\v\f\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    k = min(3, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [print_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return sorted(
        ((d, f"{p:016x}", min((x for x in groups[find(i)] if x is not None), default=None)) for i, ((d, _), p) in enumerate(zip(rows, prints))), key=str)


def test_against_brute_force(llm):
    docs = llm.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text")
    rows = sorted((tuple(r) for r in QUERIES["op8_simhash"](llm, DATA).collect()), key=str)
    assert rows == brute([tuple(r) for r in docs.collect()])


def test_odd_rows(odd, none):
    rows = sorted((tuple(r) for r in simhash.near_duplicates(odd).collect()), key=str)
    assert rows == brute([(r["doc_id"], r["text"]) for r in odd.collect()])
    assert simhash.near_duplicates(none).count() == 0 and simhash.keep_one(none).count() == 0


def test_all_links_within_two_bits_are_found(llm):
    random.seed(3)
    prints = set()
    for _ in range(60):
        p = random.getrandbits(64)
        for _ in range(random.randint(1, 6)):
            prints.add(p)
            p ^= (1 << random.randrange(64)) ^ (1 << random.randrange(64)) * random.randint(0, 1)
    prints = sorted(prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = components(simhash.near_pairs(llm.createDataFrame([(p,) for p in signed], "fp long"), "fp"), "a", "b").collect()
    root = {r["node"]: r["root"] for r in found}
    want = {}
    for d, _, c in brute_prints(prints, signed):
        want[d] = c
    assert {p: root.get(p, p) for p in signed} == want


def brute_prints(prints, signed):
    group = {s: s for s in signed}
    changed = True
    while changed:
        changed = False
        for a, x in zip(prints, signed):
            for b, y in zip(prints, signed):
                if (a ^ b).bit_count() <= 2 and group[x] != group[y]:
                    group[x] = group[y] = min(group[x], group[y])
                    changed = True
    return [(s, None, group[s]) for s in signed]


@pytest.mark.parametrize("n", [1, 2, 37])
def test_components_of_chains_and_stars(llm, n):
    chain = [(i, i + 1) for i in range(100, 100 + n)] + [(7, i) for i in range(1000, 1000 + n)] + [(5, 5)]
    found = {r["node"]: r["root"] for r in components(llm.createDataFrame(chain, "a long, b long"), "a", "b").collect()}
    assert found == {**{i: 100 for i in range(101, 101 + n)}, **{i: 7 for i in range(1000, 1000 + n)}}


def test_one_row_of_each_group_stays(odd):
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns
    rows = kept.collect()
    texts = {r["text"] for r in rows}
    assert len(rows) == 7 and len([r for r in rows if r["doc_id"] in (1, 2)]) == 1  # 1 and 2, 2; and all without words
    assert {"one", "two", "A row without an id, but with some words in its text."} < texts
    assert [r["doc_id"] for r in rows if not (r["text"] or "").strip()] == [3]
