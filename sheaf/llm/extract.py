"""The main text of pages: flat text blocks, their neighbours, and a decision tree trained on a small labelled table."""

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

# HTML elements by their part in a page.
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var wbr".split())
RAW = set("script style title textarea iframe noscript template xmp noframes".split())  # up to their end tag, without tags
#: Elements that hold tags, and no text of the page.
FOREIGN = set("svg math object canvas audio video select".split())
BOILER = set("nav aside footer button fieldset label dialog menu head".split())
ARTICLE = set("article main".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
BOILER_NAMES = set(
    "nav navbar navigation menu sidebar aside footer header masthead breadcrumb breadcrumbs ad ads advert adverts advertisement "
    "sponsor sponsored promo banner cookie cookies consent gdpr notice disclaimer popup modal overlay comment comments respond "
    "reply replies discussion disqus share sharing social related recommended newsletter subscribe signup login search "
    "pagination pager toolbar widget teaser tags".split())
ARTICLE_NAMES = set("article post entry story content maincontent articlebody body text".split())
#: Words behind the head word of a name, and the names of parts that hold articles of others.
PLACES = set("area list item items bar box block section container wrap wrapper inner outer link links button buttons posts form left right top bottom primary secondary".split())
OF_OTHERS = set("comment comments respond reply replies discussion disqus related recommended".split())
#: A form holds article text if it holds an article, a first heading, or so many words in blocks of so many.
FORM_WORDS, FORM_BLOCK = 40, 20
#: Names of an article's first paragraph, on elements of text.
LEADS, TEXT_ELEMENTS = {"teaser"}, set("p h1 h2 h3 h4 h5 h6 blockquote".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())

TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>", re.S)
ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)

#: What no element of ``FOREIGN`` holds: an end tag behind it is another one's. And the options of a select.
OUTER = re.compile(r"</?(?:article|main|body|html)(?=[\s/>])", re.I)
OPTIONS = re.compile(r"(?:\s*</?(?:option|optgroup)(?=[\s/>])[^>]*>[^<]*)*", re.I)

FEATURES = ["words", "link", "words_before", "link_before", "words_after", "link_after", "boiler", "article", "heading"]
#: The labelled table: features of blocks of pages in general use, and 1 where the block is main text. Fixed values.
LABELLED = [
    # menus, headers and breadcrumbs
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0), (2, 1.0, 1, 1.0, 3, 1.0, 1, 0, 0, 0),
    (1, 1.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0), (3, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0),
    (2, 1.0, 2, 1.0, 40, 0.0, 0, 0, 0, 0), (5, 1.0, 4, 1.0, 6, 1.0, 0, 0, 0, 0), (4, 0.0, 0, 0.0, 1, 1.0, 1, 0, 1, 0),
    (3, 0.0, 0, 0.0, 1, 1.0, 0, 0, 0, 0), (2, 0.0, 0, 0.0, 3, 1.0, 0, 0, 1, 0), (6, 0.9, 3, 1.0, 12, 0.0, 0, 0, 0, 0),
    (8, 0.0, 2, 1.0, 7, 0.0, 1, 0, 0, 0), (15, 0.0, 3, 1.0, 9, 0.0, 1, 0, 0, 0), (3, 1.0, 1, 1.0, 20, 0.0, 1, 1, 0, 0),
    # adverts, notices, forms and sidebars
    (14, 0.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0), (30, 0.1, 2, 1.0, 10, 0.0, 1, 0, 0, 0), (22, 0.0, 60, 0.0, 55, 0.0, 1, 1, 0, 0),
    (45, 0.1, 5, 1.0, 3, 0.0, 1, 0, 0, 0), (9, 0.5, 30, 0.0, 2, 1.0, 1, 0, 0, 0), (12, 0.0, 80, 0.0, 5, 0.0, 1, 1, 0, 0),
    (60, 0.0, 12, 0.0, 70, 0.0, 1, 0, 0, 0), (35, 0.0, 40, 0.0, 38, 0.0, 1, 1, 0, 0), (2, 0.0, 35, 0.0, 1, 0.0, 1, 0, 1, 0),
    (5, 0.0, 90, 0.0, 28, 0.0, 1, 1, 1, 0), (7, 0.8, 6, 0.9, 7, 0.7, 0, 0, 0, 0), (10, 1.0, 11, 1.0, 9, 1.0, 0, 0, 0, 0),
    (90, 0.0, 60, 0.0, 85, 0.0, 1, 0, 0, 0), (120, 0.0, 4, 0.0, 95, 0.0, 1, 0, 0, 0), (150, 0.1, 80, 0.0, 0, 0.0, 1, 1, 0, 0),
    # parts whose names leave it in doubt, and forms around articles: their short and linked text, then their articles
    (2, 1.0, 3, 1.0, 4, 1.0, 0.5, 0, 0, 0), (5, 0.8, 6, 0.9, 7, 0.7, 0.5, 0, 0, 0), (4, 0.0, 3, 1.0, 6, 0.0, 0.5, 0, 0, 0),
    (8, 0.0, 5, 0.0, 0, 0.0, 0.5, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0.5, 0, 0, 0), (6, 0.9, 3, 1.0, 40, 0.0, 0.5, 0, 0, 0),
    (60, 0.0, 50, 0.0, 70, 0.0, 0.5, 0, 0, 1), (45, 0.1, 40, 0.0, 30, 0.0, 0.5, 1, 0, 1), (80, 0.0, 7, 0.0, 60, 0.0, 0.5, 0, 0, 1),
    (22, 0.0, 60, 0.0, 55, 0.0, 0.5, 1, 0, 1), (6, 0.0, 70, 0.0, 52, 0.0, 0.5, 1, 0, 1), (35, 0.0, 8, 0.0, 38, 0.0, 0.5, 0, 0, 1),
    (4, 0.0, 1, 1.0, 40, 0.0, 0.5, 0, 1, 1), (3, 0.0, 2, 1.0, 30, 0.0, 0.5, 0, 1, 1), (2, 0.0, 0, 0.0, 25, 0.0, 0.5, 0, 1, 1),
    (30, 0.0, 60, 0.0, 5, 0.0, 0.5, 0, 0, 1), (30, 0.0, 60, 0.0, 0, 0.0, 0.5, 0, 0, 1), (24, 0.0, 18, 0.0, 12, 0.0, 0.5, 0, 0, 1),
    (7, 0.0, 6, 0.0, 11, 0.0, 0.5, 0, 0, 0), (5, 0.0, 9, 0.0, 6, 0.0, 0.5, 0, 0, 0),
    (7, 0.0, 2, 1.0, 60, 0.0, 0.5, 0, 1, 1), (5, 0.0, 40, 0.0, 55, 0.0, 0.5, 1, 1, 1), (30, 0.0, 0, 0.0, 45, 0.0, 0.5, 0, 0, 1),
    # reader comments
    (25, 0.0, 3, 0.5, 18, 0.0, 1, 0, 0, 0), (40, 0.0, 2, 1.0, 33, 0.0, 1, 1, 0, 0), (3, 0.5, 40, 0.0, 25, 0.0, 1, 0, 0, 0),
    (70, 0.0, 4, 0.0, 66, 0.0, 1, 0, 0, 0), (2, 0.0, 50, 0.0, 12, 0.0, 1, 0, 1, 0), (1, 0.0, 20, 0.0, 30, 0.0, 1, 1, 0, 0),
    # footers
    (12, 0.0, 45, 0.0, 0, 0.0, 1, 0, 0, 0), (6, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 0), (9, 0.4, 3, 1.0, 0, 0.0, 0, 0, 0, 0),
    (20, 0.0, 30, 0.0, 0, 0.0, 1, 0, 0, 0), (4, 1.0, 4, 1.0, 0, 0.0, 0, 0, 0, 0), (2, 1.0, 80, 0.0, 2, 1.0, 0, 0, 0, 0),
    (5, 0.0, 2, 1.0, 0, 0.0, 0, 0, 0, 0), (8, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 0),
    # headlines
    (7, 0.0, 14, 0.0, 60, 0.0, 0, 1, 1, 1), (5, 0.0, 3, 1.0, 20, 0.0, 0, 1, 1, 1), (12, 0.0, 1, 1.0, 45, 0.0, 0, 1, 1, 1),
    (9, 0.0, 2, 1.0, 80, 0.0, 0, 0, 1, 1), (4, 0.0, 70, 0.0, 65, 0.0, 0, 0, 1, 1), (3, 0.0, 40, 0.0, 3, 0.0, 0, 1, 1, 1),
    (2, 0.0, 55, 0.0, 48, 0.0, 0, 1, 1, 1), (6, 1.0, 1, 1.0, 75, 0.0, 0, 1, 1, 1), (8, 0.0, 0, 0.0, 12, 0.0, 0, 1, 1, 1),
    (1, 0.0, 3, 0.0, 1, 0.0, 0, 1, 1, 1), (5, 0.0, 22, 0.0, 30, 0.0, 0, 0, 1, 1),
    # paragraphs, lists, quotes and tables of articles
    (60, 0.0, 7, 0.0, 55, 0.0, 0, 1, 0, 1), (45, 0.1, 60, 0.0, 80, 0.0, 0, 1, 0, 1), (2, 0.0, 50, 0.0, 40, 0.0, 0, 1, 0, 1),
    (1, 0.0, 2, 0.0, 30, 0.0, 0, 1, 0, 1), (1, 0.0, 40, 0.0, 1, 0.0, 0, 1, 0, 1), (8, 0.0, 30, 0.0, 12, 0.0, 0, 1, 0, 1),
    (3, 1.0, 25, 0.0, 3, 1.0, 0, 1, 0, 1), (12, 1.0, 40, 0.0, 35, 0.0, 0, 1, 0, 1), (30, 0.5, 20, 0.0, 45, 0.0, 0, 1, 0, 1),
    (90, 0.0, 85, 0.0, 12, 0.0, 0, 1, 0, 1), (14, 0.0, 66, 0.0, 9, 0.0, 0, 1, 0, 1), (2, 1.0, 2, 1.0, 50, 0.0, 0, 1, 0, 1),
    (5, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 1), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 1), (200, 0.0, 0, 0.0, 0, 0.0, 0, 1, 0, 1),
    (55, 0.0, 9, 0.0, 70, 0.0, 0, 0, 0, 1), (80, 0.1, 75, 0.0, 60, 0.0, 0, 0, 0, 1), (25, 0.0, 6, 0.0, 31, 0.0, 0, 0, 0, 1),
    (18, 0.0, 40, 0.0, 22, 0.0, 0, 0, 0, 1), (6, 0.0, 70, 0.0, 52, 0.0, 0, 0, 0, 1), (3, 0.0, 33, 0.0, 47, 0.0, 0, 0, 0, 1),
    (120, 0.0, 5, 1.0, 14, 0.0, 0, 0, 0, 1), (35, 0.2, 2, 1.0, 28, 0.0, 0, 0, 0, 1), (40, 0.0, 22, 0.0, 6, 0.0, 0, 0, 0, 1),
    (28, 0.0, 4, 0.0, 3, 1.0, 0, 0, 0, 1), (16, 0.0, 5, 0.0, 19, 0.0, 0, 0, 0, 1), (50, 0.0, 0, 0.0, 45, 0.0, 0, 0, 0, 1),
]
#: Labelled pages: of each block its words, its share of linked words, whether it is a heading, and 1 where it is main text. None has a mark of
#: an article or of boilerplate, so that only the blocks and their neighbours can tell. Fixed values.
LABELLED_PAGES = [
    # a menu, a recipe with its list, a footer of links
    [(1, 1, 0, 0), (1, 1, 0, 0), (2, 1, 0, 0), (3, 0, 1, 1), (12, 0, 0, 1), (3, 0, 0, 1), (2, 0, 0, 1), (1, 0, 0, 1), (4, 0, 0, 1), (18, 0, 0, 1), (9, 0, 0, 1), (2, 1, 0, 0), (1, 1, 0, 0)],
    # a dialogue between a menu and a line of rights behind links
    [(2, 1, 0, 0), (2, 1, 0, 0), (5, 0, 1, 1), (7, 0, 0, 1), (4, 0, 0, 1), (1, 0, 0, 1), (3, 0, 0, 1), (11, 0, 0, 1), (2, 0, 0, 1), (6, 0, 0, 1), (3, 1, 0, 0), (6, 0, 0, 0)],
    # short paragraphs and nothing else
    [(3, 0, 0, 1), (3, 0, 0, 1)], [(8, 0, 0, 1), (5, 0, 0, 1), (10, 0, 0, 1)], [(1, 0, 0, 1), (2, 0, 0, 1), (1, 0, 0, 1), (4, 0, 0, 1)], [(6, 0, 0, 1)],
    [(4, 0, 1, 1), (9, 0, 0, 1), (2, 0, 0, 1)], [(15, 0, 0, 1), (7, 0, 0, 1)], [(2, 0, 0, 1), (14, 0, 0, 1), (3, 0, 0, 1), (9, 0, 0, 1)],
    # a list of terms
    [(1, 1, 0, 0), (1, 1, 0, 0), (1, 1, 0, 0), (2, 0, 1, 1), (1, 0, 0, 1), (1, 0, 0, 1), (2, 0, 0, 1), (1, 0, 0, 1), (3, 0, 0, 1), (2, 0.5, 0, 0), (4, 1, 0, 0)],
    # a site's name above its menu, long paragraphs with short ones between, a line of rights behind them
    [(2, 0, 0, 0), (1, 1, 0, 0), (2, 1, 0, 0), (6, 0, 1, 1), (55, 0, 0, 1), (4, 0, 0, 1), (70, 0.1, 0, 1), (2, 0, 0, 1), (38, 0, 0, 1), (5, 0, 0, 0)],
    [(3, 0, 0, 0), (1, 1, 0, 0), (1, 1, 0, 0), (80, 0, 0, 1), (41, 0.1, 0, 1), (26, 0, 0, 1), (7, 0, 0, 0)], [(7, 0, 1, 1), (33, 0, 0, 1), (48, 0, 0, 1), (3, 0, 0, 0)],
    # a line of links behind a paragraph, and further reading
    [(4, 0, 1, 1), (25, 0.1, 0, 1), (9, 0, 0, 1), (40, 0, 0, 1), (3, 0.9, 0, 0), (8, 1, 0, 0), (7, 1, 0, 0), (9, 1, 0, 0)],
    # verse
    [(1, 1, 0, 0), (2, 1, 0, 0), (3, 0, 1, 1), (7, 0, 0, 1), (6, 0, 0, 1), (8, 0, 0, 1), (5, 0, 0, 1), (2, 1, 0, 0), (5, 0, 0, 0)],
    # short last lines ahead of links, and a word or two behind long paragraphs
    [(1, 1, 0, 0), (4, 0, 1, 1), (3, 0, 0, 1), (2, 0, 0, 1), (4, 0, 0, 1), (2, 1, 0, 0)], [(5, 0, 0, 1), (4, 0, 0, 1), (3, 0, 0, 1), (3, 1, 0, 0), (1, 1, 0, 0)],
    [(2, 1, 0, 0), (9, 0, 0, 1), (6, 0, 0, 1), (1, 0, 0, 1), (4, 1, 0, 0)], [(6, 0, 1, 1), (60, 0, 0, 1), (4, 0, 0, 1), (45, 0, 0, 1), (2, 0, 0, 0)],
    [(50, 0, 0, 1), (44, 0, 0, 1), (1, 0, 0, 0)], [(2, 1, 0, 0), (2, 0, 1, 1), (1, 0, 0, 1), (3, 0, 0, 1), (2, 1, 0, 0)],
    [(1, 1, 0, 0), (6, 0, 0, 1), (1, 0, 0, 1), (16, 0, 0, 1), (4, 1, 0, 0), (1, 1, 0, 0)],
]


def mark_of(name: str) -> float:
    """1 if a class or id is a name of boilerplate, or its head word is; 0.5 if another part of it is, which says little; else 0."""
    parts = [x for x in re.split(r"[-_]+", name) if x]
    if not set(parts) & BOILER_NAMES:
        return 0.0
    if parts[-1] in BOILER_NAMES or parts[0] == "comment":
        return 1.0
    head = list(parts)
    while len(head) > 1 and (head[-1] in PLACES or head[-1].isdigit()):
        head.pop()
    return 1.0 if head[-1] in BOILER_NAMES and not set(parts) & ARTICLE_NAMES else 0.5


def names_of(attributes: str) -> tuple[set[str], bool, float, bool]:
    """Parts of class and id names and roles of a tag, whether it is hidden, how its names mark it, and whether as holding articles of others."""
    names, hidden, mark, others = set(), False, 0.0, False
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), next((v for v in values if v), "").lower()
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
            hidden = True
        elif name == "role":
            hidden |= value in ROLES - {"form"}
            mark = max(mark, float(value == "form"))
        elif name in ("class", "id"):
            for word in value.split():
                if not re.match(r"(has|with|no|without|is|not|category|tag|tax|type|format|status)[-_]", word):
                    own = set(re.split(r"[-_]+", word))
                    names |= own
                    mark = max(mark, mark_of(word))
                    others |= bool(own & OF_OTHERS)
    return names, hidden, mark, others


class Mark:
    """What an open element's name, or its being a form, says of the text in it; what it turns out to hold can lower it."""

    def __init__(self, value: float, form: bool, others: bool):
        self.value, self.form, self.others, self.words = value, form, others, 0
        self.before = None  # what an article in it lowered

    def holds_article(self, tag: str):
        if tag == "main":
            self.value, self.before = 0.0, None
        elif not self.others:
            if self.value:
                self.before = self.value
            self.value = 0.0

    def stands_beside_main(self):
        """The page's main text is elsewhere, so the articles in here are others."""
        if self.before is not None:
            self.value = self.before

    def holds_text(self, words: int, link: float, heading: int):
        if self.form and self.value == 1.0:
            self.words += words if words >= FORM_BLOCK and link < 0.5 else 0
            if heading == 1 or self.words >= FORM_WORDS:
                self.value = 0.5


class Blocks:
    """Collects the text blocks of a page, with what stands open around each."""

    def __init__(self):
        self.open: list[tuple[str, bool, bool, Mark | None]] = []  # (tag, is boilerplate, is article, mark)
        self.parts, self.linked, self.in_link, self.heading = [], 0, 0, 0
        self.texts, self.found, self.has_main, self.marks = [], [], False, []

    def text(self, raw: str):
        value = unescape(raw) if "&" in raw else raw
        self.parts.append(value)
        if self.in_link:
            self.linked += len(value.split())

    def flush(self):
        if self.parts:
            own = "".join(self.parts).split()
            if own:
                words, text = len(own), " ".join(own)
                boiler, article = any(x[1] for x in self.open), any(x[2] for x in self.open)
                link, marks = min(1.0, self.linked / max(1, words)), [x[3] for x in self.open if x[3]]
                if not boiler:
                    for i, mark in enumerate(marks):
                        if not any(x.value == 1.0 and not x.form for x in marks[i + 1 :]):
                            mark.holds_text(words, link, self.heading)
                self.texts.append(text)
                self.found.append((words, link, boiler, marks, article, self.heading > 0))
        self.parts, self.linked = [], 0

    @property
    def rows(self) -> list[tuple]:
        """Of each block its words, share of links, 1 if it is in boilerplate or 0.5 if that is in doubt, and whether in an article and a heading."""
        return [(w, link, 1.0 if b else max((m.value for m in marks), default=0.0), a, h) for w, link, b, marks, a, h in self.found]

    def start(self, tag: str, attributes: str):
        if tag in INLINE:
            self.in_link += tag == "a"
            if tag in ("br", "img", "wbr"):
                self.parts.append(" " if tag == "br" else "")
            return
        self.flush()
        self.in_link = 0
        self.heading = int(tag[1]) if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456" else 0
        if tag in VOID or attributes.endswith("/"):
            return
        names, hidden, mark, others = names_of(attributes) if attributes else (set(), False, 0.0, False)
        article = tag in ARTICLE or bool(names & ARTICLE_NAMES)
        boiler = tag in BOILER or hidden
        mark = 1.0 if tag == "form" else 0.0 if tag in ("html", "body", "main", "article") else mark
        if tag in TEXT_ELEMENTS and names & LEADS:
            mark = 0.0  # a paragraph of the article that holds it
        self.has_main |= tag == "main"
        if tag in ARTICLE:
            for x in self.open:
                if x[3]:
                    x[3].holds_article(tag)
        boiler |= tag == "header" and not any(x[2] for x in self.open)
        if tag == "p" and self.open and self.open[-1][0] == "p":
            self.open.pop()
        held = Mark(mark, tag == "form", others) if mark else None
        if held:
            self.marks.append(held)
        self.open.append((tag, boiler, article and not boiler and mark < 1, held))

    def finish(self):
        self.flush()
        for mark in self.marks if self.has_main else ():
            mark.stands_beside_main()

    def end(self, tag: str):
        if tag in INLINE:
            self.in_link = max(0, self.in_link - (tag == "a"))
            return
        self.flush()
        self.in_link, self.heading = 0, 0
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in ("article", "main", "body") and tag not in ("body", "html"):
                return  # a stray end tag closes nothing outside of its article


class Ends:
    """Where the elements of ``FOREIGN`` that have an end tag of their own end; those without one are as if empty."""

    def __init__(self, html: str):
        self.html, self.found = html, {}

    def of(self, tag: str, start: int) -> int | None:
        if tag not in self.found:
            ends, waiting = {}, []
            for m in re.finditer(rf"<(/?){tag}(?=[\s/>])[^>]*>?", self.html, re.I):
                if not m[1]:
                    waiting.append(m.start())
                elif waiting:
                    ends[waiting.pop()] = m.end()
            self.found[tag] = ends
        end = self.found[tag].get(start)
        return None if end is None or OUTER.search(self.html, start, end) else end


def blocks_of(html: str) -> Blocks:
    out, at, ends = Blocks(), 0, Ends(html)
    while m := TAG.search(html, at):
        if m.start() > at:
            out.text(html[at : m.start()])
        at = m.end()
        close, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if close:
            if tag not in FOREIGN:
                out.end(tag)
        elif tag in RAW:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
                at = end.end() if end else len(html)
            out.flush()
        elif tag in FOREIGN:
            if not attributes.endswith("/"):
                at = ends.of(tag, m.start()) or (OPTIONS.match(html, at).end() if tag == "select" else at)
            if tag not in ("svg", "math", "canvas"):
                out.flush()
        else:
            out.start(tag, attributes)
    if at < len(html):
        out.text(html[at:])
    out.finish()
    return out


def table_of(rows: list[tuple]) -> np.ndarray:
    """Features of the blocks of one page, in order, with those of the blocks before and after."""
    own = np.array(rows, float).reshape(-1, 5)
    near = own[:, :2]
    none = np.zeros((1, 2))
    return np.hstack([near, np.vstack([none, near[:-1]])[: len(near)], np.vstack([near[1:], none])[-len(near) :] if len(near) else near, own[:, 2:]])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 9):
    """A classification tree by Gini impurity: a label, or (feature, limit, tree up to it, tree above it)."""
    if depth == 0 or y.min() == y.max():
        return int(2 * y.sum() > len(y))
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[:-1] + values[1:]) / 2:
            low = x[:, f] <= limit
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[low], y[~low]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, limit, low)
    if best is None:
        return int(2 * y.sum() > len(y))
    _, f, limit, low = best
    return f, limit, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def decide(tree, x: np.ndarray) -> np.ndarray:
    if isinstance(tree, int):
        return np.full(len(x), tree, bool)
    f, limit, low, high = tree
    left = x[:, f] <= limit
    out = np.zeros(len(x), bool)
    out[left], out[~left] = decide(low, x[left]), decide(high, x[~left])
    return out


def labelled() -> np.ndarray:
    """The labelled blocks: those of the table, and those of the labelled pages with their neighbours."""
    pages = [np.hstack([table_of([(w, link, 0, 0, h) for w, link, h, _ in page]), [[y] for *_, y in page]]) for page in LABELLED_PAGES]
    return np.vstack([np.array(LABELLED, float), *pages])


def trained(table=None):
    rows = labelled() if table is None else np.array(table, float)
    return grow(rows[:, :-1], rows[:, -1])


def main_text_of(html: str, tree) -> str:
    found = blocks_of(html)
    keep = decide(tree, table_of(found.rows))
    return "\n".join(t for t, k in zip(found.texts, keep) if k)


def main_text(table=None):
    """A column function from HTML to its main text, by a tree trained on ``table`` (rows as in ``LABELLED``).

    A null or empty page, and one without main text, gives an empty text. Blocks keep their order and are never cut.
    """
    tree = trained(table)

    @F.arrow_udf("string")
    def extract(pages: pa.Array) -> pa.Array:
        return pa.array([main_text_of(p.as_py() or "", tree) for p in pages], pa.string())

    return extract


def extracted(pages, page_id: str = "page_id", url: str = "url", html: str = "html"):
    """(page_id, url, text, n_chars) of every row of ``pages``, repeated ones too."""
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), main_text()(F.col(html)).alias("text")).withColumn(
        "n_chars", F.length("text").cast("long"))
