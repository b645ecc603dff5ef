from conftest import DATA

from sheaf.llm import lines
from sheaf.llm.queries import QUERIES

SPACES = " \t\n\x0b\x0c\r"


def brute(text):
    text = text or ""
    spaced = "".join(" " if c in SPACES else c for c in text)
    w = [x for x in spaced.split(" ") if x]
    seen, dup = set(), 0
    for line in text.split("\n"):
        if any(c not in SPACES for c in line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    count = {}
    for x in windows:
        count[x] = count.get(x, 0) + 1
    hit = {j for i, x in enumerate(windows) if count[x] > 1 for j in range(i, i + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), len(w) < 10 or 100 * len(hit) > 20 * len(w)


def check(rows, texts):
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted(((r["doc_id"], *[r[n] for n in names]) for r in rows), key=str) == sorted(((i, *brute(t)) for i, t in texts), key=str)
    assert not any(r["kept"] and r["base_failed"] for r in rows)


def test_against_brute_force(llm):
    docs = [tuple(r) for r in llm.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    rows = QUERIES["op6_line_rules"](llm, DATA).collect()
    check(rows, docs)
    good = {r["doc_id"] for r in llm.read.parquet(f"{DATA}/labels.parquet").filter("quality = 1").collect()}
    lost = [r["doc_id"] for r in rows if r["doc_id"] in good and not r["base_failed"] and not r["kept"]]
    assert len(lost) == 0
    bad = [r for r in rows if r["doc_id"] not in good and not r["base_failed"]]
    assert any(not r["kept"] for r in bad)


def test_odd_rows(llm, odd, none):
    more = [(30, "a b c d e\na b c d e\n\n \n\x0b\na b c d e"), (31, "x\x1cy z\xa0w " * 3), (32, "one\r\none\r\n \r\n")]
    df = odd.select("doc_id", "text", "label", "key").union(llm.createDataFrame([(*m, "a", "b") for m in more], "doc_id long, text string, label string, key string"))
    check(lines.judged(df).collect(), [(r["doc_id"], r["text"]) for r in odd.collect()] + more)
    assert lines.judged(none).count() == 0


def test_lines_go_first_and_documents_then(llm):
    good = "This is a line of prose that ends as it should, with a stop."
    other = "Here stands another one, of other words, that goes on for longer than the first did."
    texts = [f"Home\n{good}\nAll rights reserved.\n{other}\nShort title", f"BUY!! NOW!! HERE!!\n| a | b |\nOK\n{good}", "A\nB\nC\n" * 5]
    rows = {r["doc_id"]: r for r in lines.judged(llm.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert rows[0]["cleaned"] == f"{good}\n{other}" and rows[0]["kept"]
    assert rows[1]["cleaned"] == good and not rows[2]["kept"]
