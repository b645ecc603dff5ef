import math
import zlib

import numpy as np
from conftest import DATA

from sheaf.llm import quality
from sheaf.llm.queries import QUERIES

LARGER = DATA.replace("sf0.001", "sf0.01")


def test_held_out_accuracy(llm):
    rows = QUERIES["op9_quality"](llm, LARGER).collect()
    labels = dict(tuple(r)[:2] for r in llm.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", "quality").collect())
    out = [(r["score"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    good, bad = (np.array([s for s, y in out if y == k]) for k in (1, 0))
    assert (good >= 0.5).mean() >= 0.99 and (bad < 0.5).mean() >= 0.7
    assert (good[:, None] > bad[None]).mean() >= 0.95
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.5)


def test_held_out_labels_are_not_learned_from(llm):
    docs, labels = (llm.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    flipped = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, 1 - quality, quality) as quality")
    assert (quality.train(docs, labels) == quality.train(docs, flipped)).all()


def test_the_sample_is_bounded_and_stable(llm):
    docs, labels = (llm.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    a, b = quality.train(docs, labels, most=20), quality.train(docs.repartition(7), labels.repartition(3), most=20)
    assert np.allclose(a, b) and np.count_nonzero(a) < np.count_nonzero(quality.train(docs, labels))


def test_odd_rows(llm, odd, none):
    labels = llm.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 1, 0), (None, 1, 0), (6, None, 0), (6, 0, 1), (99, 1, 1), (3, 0, 0)], "doc_id long, quality int, toxic int")
    rows = quality.scored(odd, labels).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    bias = {r["score"] for r in rows if r["doc_id"] in (3, 4, 5)}
    assert len(bias) == 1
    assert {r["score"] for r in quality.scored(odd, labels.limit(0)).collect()} == {0.5}
    assert quality.scored(none, labels).count() == 0
    kept = quality.accepted(odd, labels.limit(0))
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_repeated_rows_of_an_id_are_fitted_once(llm):
    docs, labels = (llm.read.parquet(f"{DATA}/{t}.parquet").select("doc_id", c) for t, c in (("documents", "text"), ("labels", "quality")))
    known = labels.filter("quality in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 3 <> 1").groupBy("doc_id").count().filter("count = 1")
    one = docs.join(known.orderBy("doc_id").limit(1).select("doc_id"), "doc_id")
    once, often = quality.train(docs, labels), quality.train(docs.union(one.crossJoin(llm.range(300)).select("doc_id", "text")), labels)
    assert one.count() == 1 and np.count_nonzero(once) and np.allclose(once, often)


def by_hand(rows, rounds=quality.ROUNDS):
    """The updates, one coordinate at a time."""
    z, n = {}, {}

    def weight(i):
        a = z.get(i, 0.0)
        return 0.0 if abs(a) <= quality.L1 else ((quality.L1 if a > 0 else -quality.L1) - a) / (
            (quality.BETA + n.get(i, 0.0) ** 0.5) / quality.ALPHA + quality.L2)

    for _ in range(rounds):
        for x, y in rows:
            old = {i: weight(i) for i in x}
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, sum(old[i] * v for i, v in x.items())))))
            for i, v in x.items():
                g = (p - y) * v
                now = n.get(i, 0.0) + g * g
                z[i] = z.get(i, 0.0) + g - (now ** 0.5 - n.get(i, 0.0) ** 0.5) / quality.ALPHA * old[i]
                n[i] = now
    return {i: weight(i) for i in z}


def test_updates_equal_those_by_hand():
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        at = np.unique(rng.integers(0, 50, rng.integers(0, 9)))
        rows.append((np.append(at, quality.BUCKETS), np.append(rng.random(len(at)), 1.0), int(rng.integers(0, 2))))
    found = quality.fit(rows)
    expected = by_hand([(dict(zip(i.tolist(), x.tolist())), y) for i, x, y in rows])
    out = np.zeros(quality.BUCKETS + 1)
    out[list(expected)] = list(expected.values())
    assert np.allclose(found, out)


def test_the_model_does_not_depend_on_partitions(llm):
    docs, labels = (llm.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    old = llm.conf.get("spark.sql.shuffle.partitions")
    models = []
    try:
        for n in (1, 4, 211):
            llm.conf.set("spark.sql.shuffle.partitions", str(n))
            models.append(quality.train(docs.repartition(n), labels.repartition(n)))
            models.append(quality.train(docs.repartition(n), labels.repartition(n), most=4))
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", old)
    assert all((a == models[0]).all() for a in models[::2]) and all((a == models[1]).all() for a in models[1::2])
    assert np.count_nonzero(models[1])
