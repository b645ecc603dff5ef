import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from sheaf.llm import mixing


def poisson_inverse(rate, u):
    n, p = 0, math.exp(-rate)
    total = p
    while total <= u:
        n += 1
        p *= rate / n
        total += p
    return n


def test_counts_are_the_inverse_at_the_hash(llm, odd):
    rows = odd.collect()
    size = Counter()
    for r in rows:
        size[r["source"]] += len(r["text"] or "")
    total, wish = sum(size.values()), sum(math.sqrt(x) for x in size.values())
    want = Counter()
    for r in rows:
        rate = math.sqrt(size[r["source"]]) / wish * total / size[r["source"]]
        key = str(r["doc_id"]) if r["doc_id"] is not None else "null-" + hashlib.md5((r["text"] or "").encode()).hexdigest()
        u = (int(hashlib.md5(f"mix-1:n:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        want[r["doc_id"], r["text"]] += poisson_inverse(rate, u)
    out = mixing.mixed(odd)
    assert Counter((r["doc_id"], r["text"]) for r in out.collect()) == +want
    assert out.columns == [*odd.columns, "order_key"]


def test_the_order_is_global(llm, odd):
    big = odd.crossJoin(llm.range(200).select(F.col("id").alias("n"))).withColumn("doc_id", F.col("n") * 100 + F.col("doc_id"))
    keys = [r["order_key"] for r in mixing.mixed(big).collect()]
    assert keys == sorted(keys) and len(set(keys)) > 1000


def test_weights_set_the_shares(llm):
    docs = llm.range(30_000).selectExpr("id as doc_id", "'abcde' as text", "if(id % 3 = 0, 'a', if(id % 3 = 1, 'b', 'c')) as source")
    n = {r["source"]: r["count"] for r in mixing.mixed(docs, weights={"a": 3, "b": 1}).groupBy("source").count().collect()}
    assert set(n) == {"a", "b"} and abs(n["a"] - 22_500) < 600 and abs(n["b"] - 7_500) < 400
    few = docs.limit(3).filter("source = 'a'")
    assert abs(mixing.mixed(few, weights={"a": 1}, epochs=2000).count() - 2000) < 300


def test_no_rows(none, odd):
    assert mixing.mixed(none).count() == 0
    assert mixing.mixed(odd, weights={}).count() == 0


def test_rates_that_come_with_size_are_drawn_in_parts(llm):
    docs = llm.createDataFrame([(1, "x" * 4_000_000, "large"), (2, "ab", "small"), (3, "cd", None)], "doc_id long, text string, source string")
    small = math.sqrt(2) / (2000 + 2 * math.sqrt(2)) * 4_000_004 / 2
    parts = math.ceil(small / 500)
    assert parts == 3

    def count(key):
        draws = ["n", *(f"n{i}" for i in range(1, parts))]
        return sum(poisson_inverse(small / parts, (int(hashlib.md5(f"mix-1:{d}:{key}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) for d in draws)

    copies = {}
    for r in mixing.mixed(docs.repartition(2)).select("doc_id", "copy").collect():
        copies.setdefault(r["doc_id"], []).append(r["copy"])
    for k in (2, 3):
        assert sorted(copies[k]) == list(range(1, count(k) + 1)) and abs(len(copies[k]) - small) < 6 * math.sqrt(small)


def test_copies_are_numbered_over_blocks(llm):
    docs = llm.createDataFrame([(1, "x" * 100_000, "a"), (2, "y", "b")], "doc_id long, text string, source string")
    row = mixing.mixed(docs, weights={"b": 2}).selectExpr("count(*) n", "min(copy) least", "max(copy) most", "count(distinct copy) d", "min(doc_id) id").first()
    assert row["n"] == row["most"] == row["d"] > mixing.BLOCK and row["least"] == 1 and row["id"] == 2
