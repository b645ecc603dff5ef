import re
from html import unescape

from conftest import DATA

from sheaf.llm import extract
from sheaf.llm.queries import QUERIES

PAGE = """<!doctype html><html class=has-sidebar><head><title>T</title><style>p{}</style></head><body class="with-menu">
<div id="cookie-notice"><p>We use cookies on this site to make it better for you and for all of us.</p></div>
<header class=site><h1>Site</h1><p>The paper that has been read by all the people of the town for years.</p></header>
<nav><ul><li><a href=/a>A</a><li><a href=/b>B</a></ul></nav>
<main><article><header><h1>Head &amp; line</h1></header><p>First <b>bold</b>,&nbsp;text
 with   <a href=x>a link</a>.<p>Yes.<script>if (a<b) x("</p>")</script>
<aside><p>A side note that runs on for quite a number of words, as they do, in many papers.</p></aside>
<div class="ad banner">Buy now, buy more, and buy again, for as long as you have any money left.</div>
<form><label>Mail</label><input><button>Send</button></form>
<ul><li>One<li>Two</ul><blockquote>Said so.</blockquote><table><tr><td>1<td>2</table><!-- <p>no</p> --><p>1 &lt; 2 &#233;&hellip;</p></article>
<section id=comments><h2>Comments</h2><div class=comment><p>I do not agree with this at all, and here is a long reason why that is so.</p></div></section></main>
<footer><p>All rights are with us, and with those that wrote the words that stand above.</p></footer></body></html>"""
TEXT = "Head & line\nFirst bold, text with a link.\nYes.\nOne\nTwo\nSaid so.\n1\n2\n1 < 2 é…"


def test_a_page_of_all_parts():
    assert extract.main_text_of(PAGE, extract.trained()) == TEXT


def test_pages_without_marks():
    text = [" ".join(f"w{i}" for i in range(n)) for n in (40, 60, 3, 50)]
    page = "<body><div><a href=1>One</a> <a href=2>Two</a></div><h2>A head line here</h2><div>%s</div><div>%s</div><div>%s</div><div>%s</div><p>Some rights</p>" % tuple(text)
    assert extract.main_text_of(page, extract.trained()) == "\n".join(["A head line here", *text])


def test_the_tree_fits_its_table():
    rows = extract.np.array(extract.LABELLED, float)
    assert (extract.decide(extract.trained(), rows[:, :-1]) == rows[:, -1]).mean() > 0.95


def test_all_pages(llm):
    pages = {r["page_id"]: r["html"] for r in llm.read.parquet(f"{DATA}/pages.parquet").collect()}
    for r in QUERIES["op3_main_text"](llm, DATA).collect():
        article = re.search(r"<article>(.*?)(?:</article>|\Z)", pages[r["page_id"]], re.S)[1]
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_odd_pages(llm):
    rows = [(1, None), (2, ""), (2, ""), (None, "<p>"), (3, "<<<>>< & &amp &#xZ; <a <b"), (4, "<div " * 3000), (5, "<article>" + "<p>x y z" * 20_000), (6, "<script>never ends"), (7, "</p></div></article>")]
    df = llm.createDataFrame([(i, "u", h, "t", 1) for i, h in rows], "page_id long, url string, html string, text string, n_chars int")
    out = extract.extracted(df).collect()
    assert len(out) == len(rows) and [r["text"] for r in out if r["page_id"] == 5] == ["\n".join(["x y z"] * 20_000)]
    assert {r["text"] for r in out if r["page_id"] in (1, 2, 6, 7)} == {""}
    assert extract.extracted(df.limit(0)).count() == 0


def test_elements_without_an_end_tag():
    tree = extract.trained()
    for tag in ("embed", "object", "audio", "video", "canvas", "select", "svg", "math"):
        page = f"<article><p>One here.</p><{tag} id=1><p>Two here.</p></article><aside><{tag}><b>no</b></{tag}></aside><article><p>Three here.</p></article>"
        assert extract.main_text_of(page, tree) == "One here.\nTwo here.\nThree here.", tag
        if tag != "embed":
            page = f"<article><p>One here.</p><{tag}><b>no</b><{tag}>no</{tag}>no</{tag}><p>Two here.</p></article>"
            assert extract.main_text_of(page, tree) == "One here.\nTwo here.", tag
    page = "<article><p>One here.<select><option>A<option>B</option></p><p>Two <svg><path d=1></svg>here.</p></article>"
    assert extract.main_text_of(page, tree) == "One here.\nTwo here."


def test_names_and_forms_around_an_article():
    tree = extract.trained()
    text = [" ".join(f"w{i}" for i in range(n)) for n in (40, 60, 30)]
    body = "<h1>A head line here</h1>" + "".join(f"<p>{t}</p>" for t in text)
    want = "\n".join(["A head line here", *text])
    menu = "<ul class=nav-links><li><a href=a>One</a><li><a href=b>Two</a></ul>"
    article = f"<article class='post tag-search category-social sidebar'>{body}</article>"
    comments = "<div id=comments class=comments-area><article class=comment-body><p>I do not agree with this at all, and here is a long reason for that.</p></article></div>"
    for page in (
        article,
        f"<div class='content-sidebar-wrap'>{article}{comments}</div>",
        f"<div class='sidebar'><div class=social-banner>{article}</div></div>",
        f"<form id=aspnetForm>{menu}{article}</form>",
        f"<form id=aspnetForm>{menu}<div>{body}</div></form>",
        f"<div class='content-sidebar-wrap'>{menu}<div>{body}</div></div>",
        f"<div class='post tag-search category-social'>{body}</div>",
        f"<div class=social-stream>{menu}<main>{body}{comments}</main></div>",
    ):
        assert extract.main_text_of(f"<body>{menu}{page}<footer>All rights are with us.</footer></body>", tree) == want, page
    for name in ("sidebar", "primary-sidebar", "sidebar-2", "cookie-notice", "comments-area", "share-buttons", "related-posts"):
        assert extract.main_text_of(f"<body>{article}<div class={name}><p>{text[0]}</p><p>{text[2]}</p></div></body>", tree) == want, name


def words(n, of="w"):
    return " ".join(f"{of}{i}" for i in range(n))


MENU = "<ul><li><a href=a>Home</a><li><a href=b>About us</a><li><a href=c>Shop</a></ul>"
LINKS = "<div><a href=x>More like this</a></div><div><a href=y>Imprint</a></div>"
#: Pages without any mark of an article: before, main text, after.
UNMARKED = [
    ("", ["Short one here.", "Another short one."], ""),
    (MENU, ["Pancakes", "A plain dish for four, quickly made on any day.", "200 g flour", "2 eggs", "milk", "Mix all and wait a while before you fry them one by one in butter."], LINKS),
    ("<div><a href=q>Log</a></div>" + MENU, ["The garden", "'Who is there?' she asked.", "'No,' she said.", "'Why?'", "'Just so.'", "He went on to the gate and waited there."], LINKS),
    (MENU, ["Terms", "One", "Two things", "Three", "Four more things"], LINKS),
    (MENU, ["A long report", words(60), words(4, "s"), words(80), words(2, "t"), words(45)], "<p>Some rights</p>"),
    ("<p>My site</p>" + MENU, ["On the sea", "The waves go in, the waves go out,", "and what was here is gone,", "no man can say what they are about,", "they only carry on"], LINKS),
    (MENU, [words(30), words(9), words(22)], "<div><a href=1>Further reading</a></div><div><a href=2>On other things</a></div>"),
    ("", [words(7), words(12)], ""),
]


def test_pages_without_any_mark():
    tree = extract.trained()
    kept = right = wanted = 0
    for before, blocks, after in UNMARKED:
        body = "".join(f"<h2>{b}</h2>" if i == 0 and len(b.split()) < 5 and len(blocks) > 2 else f"<p>{b}</p>" for i, b in enumerate(blocks))
        got = extract.main_text_of(f"<body>{before}<div>{body}</div>{after}</body>", tree).split("\n")
        kept, wanted = kept + sum(len(b.split()) for b in got), wanted + sum(len(b.split()) for b in blocks)
        right += sum(len(b.split()) for b in got if b in blocks)
        assert set(blocks) - set(got) == set() or sum(len(b.split()) for b in set(blocks) - set(got)) < 4, (got, blocks)
    assert 2 * right / (kept + wanted) >= 0.95


def test_density_and_neighbours_decide():
    def used(tree):
        return set() if isinstance(tree, int) else {extract.FEATURES[tree[0]]} | used(tree[2]) | used(tree[3])

    assert {"link", "link_before", "link_after", "words_before", "words_after"} <= used(extract.trained())


def test_leads_and_sidebars_with_articles():
    tree = extract.trained()
    text = [words(40), words(30), words(20)]
    page = f"<article><p class='teaser'>{text[0]}</p><p>{text[1]}</p></article>"
    assert extract.main_text_of(page, tree) == "\n".join(text[:2])
    page = f"<div class='sidebar'><article><p>{text[2]}</p></article></div><main><p>{text[0]}</p><p>{text[1]}</p></main>"
    assert extract.main_text_of(page, tree) == "\n".join(text[:2])
