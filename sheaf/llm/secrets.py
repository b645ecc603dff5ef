"""Secrets in texts: fixed patterns, and a guess-cost estimate of values in credential contexts."""

import bisect
import hashlib
import heapq
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?P<value>[A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # of maximal runs, those of 16 or more
ASSIGN_LEAST, ACCESS_LEAST = 12, 18
KINDS = ["assign", "access", "hex", "value"]
#: Before a credential's value, besides the above. The search goes on right behind the keyword, as its value may hold the next context.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])(?:pass(?:word|wd|phrase|code|key)?|pwd|secret|token|api[_-]?key|(?:access|private|client|auth)[_-]?(?:key|secret|token)|credentials?|bearer)(?=\\*["']?\x20*(?P<sign>[:=]|is\x20|\x20)\x20*(?P<quote>\\*["']|))""",
    re.I | re.A)
#: Where a value without quotes ends: at a space or a character outside ASCII, at a quote that closes what is around it, at a tag, and at a
#: comma, semicolon or & before the next name. In a query string every & ends it.
NAME = r"""(?=[A-Za-z_][\w.-]*["']?\x20?[:=])"""
ENDS = r"""[^!-~]|\\*["'`](?![A-Za-z0-9])|[,;](?=[^!-~]|\Z|\\*["'\[{])|[,;&]""" + NAME + r"""|<(?=/?[A-Za-z])|&(?=amp;)"""
END, QUERY_END, LINE_END = re.compile(ENDS, re.A), re.compile(ENDS + "|&", re.A), re.compile(r"[\r\n]")
CLOSED = {q: re.compile(rf"(?:[^{q}\\\r\n]|\\[^\r\n])*+{q}") for q in "\"'"}
HINTS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer")
#: log10 of the guesses from which a value counts as a secret; below it are placeholders and plain words.
LEAST_GUESSES = 8.0
#: The same for a word of letters alone, in capitals or small but for its first, after a bare space or "is": prose has words of up to 15 letters there.
PLAIN_GUESSES = 16.0
#: Words tried first by guessers, the commonest first. Fixed values; a caller may give others.
COMMON = (
    "password 123456 qwerty admin welcome letmein monkey dragon master login abc123 iloveyou sunshine princess football secret "
    "shadow superman michael jordan hunter test guest root user default changeme example sample placeholder token your key "
    "access private public client server database prod dev local host null none true false value string redacted hidden "
    "the and for you with this that from have not are was all can has but one our out day get time name word pass code "
    "summer winter spring autumn monday friday january march april june july august december baseball batman trustno "
    "killer flower cookie coffee chocolate computer internet google love hello world computer apple banana orange "
    "here my insert replace enter put api auth credential bearer set value begin end rsa example todo none env config"
).split()
#: Words of the corpus that follow these in the ranks: so many at the most, of so many occurrences or more.
MOST_WORDS, LEAST_COUNT = 40_000, 3
#: What joins words, and what stands for a value elsewhere: both are cheap to guess.
SEPARATORS, SEPARATOR_COST, REFERENCE_COST = "-_./ ", 0.3, 2.0
#: References to a value that is kept elsewhere, from here to the end: templates, variables, settings read by code, a key file's first line, and
#: requests to put a value in.
REFERENCE = re.compile(
    r"""(?:\{\{|\$[({]|<%|%\(|<[A-Za-z]|\$[A-Za-z_]\w*\Z|%[A-Za-z_]+%\Z|(?:os|process|system|env|environ|getenv|config|cfg|settings|vault|secrets?|self|this|args|options|opts|request|req|params|ctx|context)(?:\.|->|::|[(\[]["']?)[A-Za-z_"')\]]|-+BEGIN\x20|(?:your|insert|replace|enter|put|change|my)[-_ ](?:own|me|with|the|your|api|access|private|secret|client|auth|token|key|password)(?![A-Za-z0-9]))""",
    re.I)
ROWS = ["`1234567890-=", "qwertyuiop[]\\", "asdfghjkl;'", "zxcvbnm,./"]
WALKS = [*ROWS, "abcdefghijklmnopqrstuvwxyz", "0123456789", "1qaz", "2wsx", "3edc", "4rfv", "5tgb", "6yhn", "7ujm"]
LEET = str.maketrans("@4301$57!", "aaeoissti")
DATE = re.compile(r"(?:19|20)\d\d(?:([-/._]?)(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12]\d|3[01]))?|(?:0[1-9]|[12]\d|3[01])([-/._]?)(?:0[1-9]|1[0-2])\2(?:19|20)\d\d")
SHORT_UNIT = 8  # of repeats that are looked for at each place; longer ones by their beginning


def brute(text: str) -> float:
    """log10 of the guesses for one character of the text: 10 each, as guessers try likely ones first."""
    return float(len(text))


def walk_of(low: str, at: int) -> int:
    """Length of the longest keyboard or alphabet walk from here, either way."""
    best = 0
    for row in WALKS:
        for line in (row, row[::-1]):
            i, n = line.find(low[at]), 0
            while i >= 0 and at + n < len(low) and i + n < len(line) and low[at + n] == line[i + n]:
                n += 1
            best = max(best, n)
    return best


def log_guesses(value: str, words: dict[str, int], enough: float = math.inf) -> float:
    """log10 of the guesses for a value: of all cuts into words, dates, repeats, walks and brute-force spans the cheapest.

    Once every cut costs ``enough``, a number not below it is given without going on, so the work does not grow with a long random value.
    """
    low, n = value.lower(), len(value)
    if len(low) != n:  # a few letters have a longer lower case
        low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    plain, longest = low.translate(LEET), max(map(len, words), default=0)
    best, ahead = [0.0] + [math.inf] * n, []  # the latter: (cost, place) of places reached
    same, units = [0] * (SHORT_UNIT + 1), {}  # how far the text goes on as it did so many characters before; costs of repeated units

    def offer(i, j, cost):
        if best[i] + cost < best[j]:
            best[j] = best[i] + cost
            heapq.heappush(ahead, (best[j], j))

    def repeat(i):
        for size in range(1, SHORT_UNIT + 1):
            at = max(i, same[size])
            while at + size < n and low[at] == low[at + size]:
                at += 1
            same[size] = at
            if at - i >= size:
                return size, (at - i) // size + 1
        probe = low[i : i + SHORT_UNIT + 1]
        j = low.find(probe, i + SHORT_UNIT + 1)
        while j >= 0 and 2 * j - i <= n:  # where a longer unit may begin again
            unit = low[i:j]
            if low.startswith(unit, j):
                times = 2
                while low.startswith(unit, i + times * len(unit)):
                    times += 1
                return len(unit), times
            j = low.find(probe, j + 1)
        return None

    for i in range(n):
        while ahead and ahead[0][1] < i:
            heapq.heappop(ahead)
        if ahead and ahead[0][0] >= enough:
            return ahead[0][0]
        offer(i, i + 1, SEPARATOR_COST if value[i] in SEPARATORS else brute(value[i]))
        if value[i] in "{$<%-" or not i:
            if REFERENCE.match(value, i):
                offer(i, n, REFERENCE_COST)
        for j in range(i + 2, min(n, i + longest) + 1):
            for form, extra in ((low, 0.0), (plain, 0.3)):
                rank = words.get(form[i:j])
                if rank:
                    capitals = 0.3 if value[i:j] != low[i:j] else 0.0
                    offer(i, j, math.log10(rank + 1) + extra + capitals)
        if m := DATE.match(value, i):
            offer(i, m.end(), 2.1 if m.end() - i == 4 else 4.6)
        if r := repeat(i):
            unit = low[i : i + r[0]]
            if unit not in units:
                units[unit] = log_guesses(unit, words, enough) if len(unit) > 1 else 1.1
            offer(i, i + r[0] * r[1], units[unit] + math.log10(r[1]))
        if (k := walk_of(low, i)) >= 3:
            for j in range(i + 3, i + k + 1):
                offer(i, j, 1.5 + math.log10(j - i))
    return best[n]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, kind, end) of the fixed patterns, by start and kind."""
    low, out = text.lower(), []
    if any(x in low for x in ("passw", "secret", "token", "api")):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m["value"]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def contexts(text: str):
    """(start, end, whether after a sign or in quotes) of the values in credential contexts, by start.

    A value in quotes goes to its closing quote on the line, after a sign with the spaces in it; another one to its delimiter, without
    the signs of the sentence around it. There is no longest value. One that begins with a context of its own gives way to that one's.
    """
    ends = {}

    def first(pattern, start):  # kept, as the next value may have the same end
        at, to = ends.get(pattern, (0, -1))
        if not at <= start <= to:
            m = pattern.search(text, start)
            ends[pattern] = start, to = start, m.start() if m else len(text)
        return to

    def closing(quote, start):
        if len(quote) == 1:
            m = CLOSED[quote].match(text, start)
            return m.end() - 1 if m else -1
        return text.find(quote, start, first(LINE_END, start))

    for m in CONTEXT.finditer(text):
        start, sign, quote = m.end("quote"), m["sign"] in (":", "="), m["quote"]
        inner = CONTEXT.match(text, start)
        if inner and inner["sign"] in (":", "="):
            continue
        end = closing(quote, start) if quote else -1
        if end >= 0 and (sign or not re.search(r"\s", text[start:end])):
            yield start, end, True
            continue
        end = first(QUERY_END if m["sign"] == "=" else END, start)
        while end > start and text[end - 1] in ("\"'`.,;:)]}>" if sign else "\"'`.,;:)]}>!?"):
            end -= 1
        yield start, end, sign or bool(quote)


def value_spans(text: str, base: list[tuple], words: dict[str, int]) -> list[tuple[int, int, int]]:
    """Values in credential contexts that are hard to guess and that no base span, and no value before, meets."""
    low = text.lower()
    if not any(x in low for x in HINTS):
        return []
    out, kinds = [], [[(s, e) for s, k, e in base if k == kind] for kind in range(3)]  # apart from each other within a kind
    done, easy = 0, ""
    for start, end, marked in contexts(text):
        last = [x[i - 1] for x in kinds if (i := bisect.bisect_left(x, (end, 0)))]
        if start < done or end - start < LEAST_GUESSES or any(start < e for _, e in last):
            continue
        value = text[start:end]
        least = PLAIN_GUESSES if not marked and value.isalpha() and (value[1:].islower() or value.isupper()) else LEAST_GUESSES
        if 0 < len(easy) - len(value) <= SHORT_UNIT and easy.startswith(value) and easy.endswith(value):
            easy = value  # a repeat, once less often than the one before
            continue
        if log_guesses(value, words, least) >= least:
            out.append((start, 3, end))
            done = end
        else:
            easy = value
    return out


def word_ranks(docs: DataFrame, text: str = "text", most: int = MOST_WORDS) -> list[str]:
    """The commonest words of all texts, as guessers rank them: ``COMMON``, and behind it up to ``most`` words of the corpus, which are
    what reaches the driver. Words are runs of letters, small but for the first; lines that speak of credentials are left out, as a secret that
    many copies have is no common word."""
    lines = F.regexp_replace(F.col(text).cast("string"), r"(?im)^.*(?:pass|pwd|secret|token|key|credential|bearer).*$", "")
    words = docs.select(F.explode(F.regexp_extract_all(lines, F.lit(r"(?<!\p{L})(\p{L}\p{Ll}{2,23})(?!\p{L})"), F.lit(1))).alias("word"))
    counts = words.groupBy(F.lower("word").alias("word")).agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_COUNT)
    return [*COMMON, *(r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(most).collect())]


def scanner(words: list[str]):
    """A column function from a text to its spans and counts."""
    ranks = {}
    for w in words:
        ranks.setdefault(w.lower(), len(ranks) + 1)
    ranks = {w: i for w, i in ranks.items() if len(w) > 1}

    @F.arrow_udf("struct<n_assign:bigint,n_access:bigint,n_hex:bigint,base_sha256:string,spans:string>")
    def scan(texts: pa.Array) -> pa.Array:
        out = []
        for t in texts:
            text = t.as_py() or ""
            base = base_spans(text)
            every = sorted([*base, *value_spans(text, base, ranks)])
            listed = [",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x) for x in (base, every)]
            counts = [sum(k == i for _, k, _ in base) for i in range(3)]
            out.append({"n_assign": counts[0], "n_access": counts[1], "n_hex": counts[2],
                        "base_sha256": hashlib.sha256(listed[0].encode()).hexdigest(), "spans": listed[1]})
        number = pa.int64()
        return pa.array(out, pa.struct([("n_assign", number), ("n_access", number), ("n_hex", number), ("base_sha256", pa.string()), ("spans", pa.string())]))

    return scan


def scanned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: list[str] | None = None) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans) of every row of ``docs``, repeated ones too.

    A null or empty text has no spans. ``spans`` lists kind:start:end, in code points, by start: the fixed patterns and
    the ``value`` spans, those of credential contexts whose value takes 10^8 guesses or more; after a bare space or "is", a word
    of letters alone, in small ones or in capitals but for its first, counts from 10^16, as prose goes on so. A value that meets a fixed pattern's span has no span of its own.

    Guesses are counted by the cheapest cut of a value into words, dates, repeats, keyboard walks, separators, references to values kept
    elsewhere, and brute force. The words are ranked by their count in all of ``docs``, unless ``words`` gives others.
    """
    found = scanner(word_ranks(docs, text) if words is None else words)(F.col(text))
    return docs.select(F.col(doc_id).alias("doc_id"), found.alias("found")).select("doc_id", "found.*")
