import random

from sheaf.llm import revisits

SCHEMA = "record_id string, url string, date long, warc_type string, status int, headers map<string,string>, digest string, n_bytes long, key string, of string"


def clean(headers):
    return {k.lower(): v for k, v in (headers or {}).items()}


def brute(rows):
    out = []
    full = {}
    for r in rows:
        if r[3] == "response" and r[4] == 200 and r[6] is not None:
            full.setdefault(r[0], r)
    for r in rows:
        if r[3] != "revisit":
            continue
        h = clean(r[5])
        met = max(((f[2], f[0]) for f in full.values() if f[8] == r[8] and None not in (f[8], f[2], f[0], r[2], r[0]) and f[2] < r[2]), default=None)
        outcome, of, headers = "no response", None, h
        if met:
            of = full[met[1]]
            old = clean(of[5])
            pairs = [(h.get("etag", "").removeprefix("W/") or None, old.get("etag", "").removeprefix("W/") or None), (h.get("last-modified"), old.get("last-modified")), (r[6], of[6])]
            given = [(a, b) for a, b in pairs if a is not None]
            outcome = "no validator" if not given else "resolved" if given[0][0] == given[0][1] else "changed"
            if outcome == "resolved":
                headers = {**old, **{k: v for k, v in h.items() if k not in revisits.KEPT_HEADERS}}
        good = outcome == "resolved"
        out.append((r[0], r[8], r[2], outcome, of[0] if good else None, 200 if good else 304, of[6] if good else None, of[7] if good else None, headers))
    return sorted(out, key=str)


def found(records):
    return sorted((tuple(r) for r in revisits.resolved(records).collect()), key=str)


def test_against_brute_force_with_a_hot_url(llm):
    random.seed(9)
    rows = []
    for i in range(600):
        url = random.choice(["http://hot.org/"] * 4 + ["http://a.org/x", "http://b.org/", "http://c.org/q?1"])
        tags = {"ETag": random.choice(['"1"', '"2"', 'W/"1"']), "Server": "s", "Content-Length": "5"}
        if random.random() < 0.4:
            rows.append((f"r{i}", url, random.randrange(200), "response", random.choice([200, 200, 404]), tags, random.choice(["d1", "d2", None]), i, None, None))
        else:
            own = random.choice([tags, {}, None, {"last-modified": "x"}, {"Date": "now", **tags}])
            rows.append((f"r{i}", url, random.randrange(200), "revisit", 304, own, random.choice(["d1", None]), 0, None, None))
    rows = [(*r[:8], r[1].removeprefix("http://"), None) for r in rows]
    llm.conf.set("spark.sql.shuffle.partitions", "11")
    try:
        assert found(llm.createDataFrame(rows, SCHEMA)) == brute(rows)
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", "4")


def test_odd_rows(llm):
    tag = {"ETag": '"1"', "etag": '"2"'}
    rows = [
        ("a", "http://WWW.x.org:80", 1, "response", 200, {"ETag": '"1"'}, "d", 9, "x.org/", "o"), ("a", "http://WWW.x.org:80", 1, "response", 200, {"ETag": '"1"'}, "d", 9, "x.org/", "o"),
        ("b", "https://x.org/#f", 2, "revisit", None, {"eTag": '"1"'}, None, None, "x.org/", "o"), ("b", "https://x.org/#f", 2, "revisit", None, {"eTag": '"1"'}, None, None, "x.org/", "o"),
        ("c", "x.org/", 1, "revisit", 304, tag, None, 0, "x.org/", "o"), ("d", None, 5, "revisit", 304, None, None, 0, None, "o"),
        ("e", "x.org/", None, "revisit", 304, None, None, 0, "x.org/", "o"), (None, "x.org/", 7, "revisit", 304, None, "d", 0, "x.org/", "o"), ("f", "", 3, None, None, None, None, None, "", "o"),
        ("g", "x.org/?", 3, "revisit", 304, None, None, 0, "x.org/?", "o"),
    ]
    df = llm.createDataFrame(rows, SCHEMA)
    got = {r[0]: r for r in found(df)}
    assert len(found(df)) == 7
    assert got["b"][1:8] == ("x.org/", 2, "resolved", "a", 200, "d", 9) and got["c"][3] == "no response" and got["d"][3] == got["e"][3] == got[None][3] == "no response"
    assert got["c"][8] == {"etag": '"2"'} or got["c"][8] == {"etag": '"1"'}
    assert found(df.limit(0)) == []
