import random
import time

from conftest import DATA

from sheaf.llm import urlfilter
from sheaf.llm.queries import QUERIES, RULES


def cut(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    at = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, rest = rest[:at].translate({i: i + 32 for i in range(65, 91)}), rest[at:]
    return host, rest.split("#")[0].split("?")[0]


def brute(urls, rules, default="allow"):
    out = []
    for i, u in urls:
        host, path = cut(u)
        met = [(len(r), r, v) for r, v in rules if r is not None and v is not None
               for h, _, p in [r.partition("/")] if (host == h or host.endswith("." + h)) and path.startswith("/" + p if "/" in r else "")]
        best = max(met, default=(0, None, default))
        out.append((i, host, path, best[1], best[2]))
    return sorted(out, key=str)


def found(pages, rules):
    return sorted((tuple(r) for r in urlfilter.judged(pages, rules).collect()), key=str)


def test_against_brute_force(llm):
    urls = [tuple(r) for r in llm.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url").collect()]
    assert sorted((tuple(r) for r in QUERIES["op2_url_filter"](llm, DATA).collect()), key=str) == brute(urls, RULES)


def test_nested_rules_over_many_ranges(llm):
    random.seed(5)
    labels, paths = ["a", "b", "ab", "org", "com"], ["", "/", "/x", "/x/", "/x/y/z", "/y?q#f", "?q", "#f"]
    host = lambda: ".".join(random.choice(labels) for _ in range(random.randint(1, 4)))
    rules = sorted({(host() + random.choice(["/", "/x", "/x/", "/x/y", ""]), random.choice(["allow", "block"])) for _ in range(60)})
    rules = list({r: (r, v) for r, v in rules}.values())
    urls = [(i, random.choice(["http://", "HTTPS://", ""]) + random.choice([host(), host().upper(), "a.org"]) + random.choice(paths)) for i in range(800)]
    urls += [(900, None), (901, ""), (902, "://"), (903, "a://b://c"), (904, "http://a..org/x"), (None, "http://a.org/x/"), (5, "http://a.org/x/"), (5, "http://a.org/x/")]
    pages = llm.createDataFrame([(*u, "c", "d", 1) for u in urls], "page_id long, url string, rule string, host string, part int")
    llm.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert found(pages, llm.createDataFrame(rules, "rule string, verdict string")) == brute(urls, rules)
        odd = llm.createDataFrame([(None, "block"), ("org/", None), ("org/", "block"), ("org/", "allow")], "rule string, verdict string")
        assert found(pages, odd) == brute(urls, [("org/", "allow")])
        assert found(pages, odd.limit(0)) == brute(urls, [])
        assert found(pages.limit(0), odd) == []
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", "4")


def test_very_many_rules_of_one_host_take_linear_time(llm):
    seconds = []
    for n in (20_000, 80_000):
        level, start = urlfilter.Level("k", "h"), time.perf_counter()
        for i in range(n):
            level.add(f"/{i}/" + "x" * (i % 50), f"h/{i}", "block")
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 12 * seconds[0] + 0.1
    rules = [(f"h.org/{i}/", "block" if i % 2 else "allow") for i in range(20_000)] + [("h.org/7/8", "allow"), ("org/9", "block")]
    urls = [(i, f"http://h.org/{i * 13 % 25_000}/{i % 9}") for i in range(3000)] + [(4000, "http://sub.h.org/77/x"), (4001, "http://z.org/9")]
    by_path = {r: v for r, v in rules}

    def judged(host, path):
        fit = [r for n in range(1, len(path) + 1) if (r := f"h.org{path[:n]}") in by_path] if host.endswith("h.org") else []
        fit += ["org/9"] if path.startswith("/9") else []
        best = max(fit, key=lambda r: (len(r), r), default=None)
        return best, by_path.get(best, "allow")

    llm.conf.set("spark.sql.shuffle.partitions", "20")
    try:
        rows = found(llm.createDataFrame(urls, "page_id long, url string"), llm.createDataFrame(rules, "rule string, verdict string"))
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(rows) == len(urls) and all((rule, verdict) == judged(host, path) for _, host, path, rule, verdict in rows)


def test_very_long_urls(llm):
    urls = [(1, "http://a.org/" + "p/" * 200_000), (2, "http://" + "l." * 300 + "org/x"), (3, "x" * 300_000)]
    rules = [("a.org/" + "p/" * 1000, "block"), ("org/x", "block")]
    assert found(llm.createDataFrame(urls, "page_id long, url string"), llm.createDataFrame(rules, "rule string, verdict string")) == brute(urls, rules)
