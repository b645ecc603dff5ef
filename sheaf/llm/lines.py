"""Quality rules, line first: failing lines go, then documents that lost too much of their text."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, LEAST_WORDS, MOST_REPEATED = 5, 10, 20
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = re.compile(r"[#*$%&|<>]")
#: A document that keeps less than this share of its words is rejected.
LEAST_KEPT = 0.3

# Rules for one line. Fixed values.
ENDS = tuple(".!?…:;\"'”’»)]。！？")
NAVIGATION = re.compile(
    r"\s*(home|menu|about( us)?|contact( us)?|login|log in|sign (in|up)|register|search|next|previous|back to top|share( this)?|"
    r"tweet|print|email|subscribe|skip to content|read more|click here|site map|faq|help)\s*", re.I)
BOILERPLATE = re.compile(
    r"cookie (policy|notice|settings)|accept (all )?cookies|all rights reserved|privacy policy|terms (of (use|service)|and conditions)|"
    r"javascript (is|must be)|enable javascript|lorem ipsum|powered by|copyright (©|\(c\)|\d)|unsubscribe", re.I)


def line_passes(line: str, words: list[str]) -> bool:
    """Whether a line is text: with an end mark or of some length, and neither navigation nor boilerplate."""
    if NAVIGATION.fullmatch(line) or BOILERPLATE.search(line):
        return False
    n, signs = len(words), len(SYMBOLS.findall(line))
    if signs * 2 > n:
        return False
    letters = [c for c in line if c.isalpha()]
    if n >= 3 and letters and sum(c.isupper() for c in letters) * 10 > 9 * len(letters):
        return False
    if n >= 20 and len(set(words)) * 4 < n:
        return False
    return line.rstrip(SPACES).endswith(ENDS) or n >= 8


def judge(text: str) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, cleaned text, share of words kept) of a text."""
    lines = text.split("\n")
    spaced = text
    for c in SPACES[1:]:
        spaced = spaced.replace(c, " ")
    words = [w for w in spaced.split(" ") if w]
    full = [line for line in lines if line.strip(SPACES)]
    again = Counter(zip(*(words[i:] for i in range(WINDOW))))
    repeated = 0
    if len(again) + WINDOW - 1 < len(words):
        inside = np.zeros(len(words), bool)
        for i, window in enumerate(zip(*(words[i:] for i in range(WINDOW)))):
            if again[window] > 1:
                inside[i : i + WINDOW] = True
        repeated = int(inside.sum())
    kept, n_kept = [], 0
    for line in lines:
        own = [w for w in line.split() if w]
        if not own or line_passes(line, own):
            kept.append(line)
            n_kept += len(own)
    share = n_kept / max(1, sum(len(line.split()) for line in lines))
    return len(words), sum(map(len, words)), len(SYMBOLS.findall(text)), len(full) - len(set(full)), repeated, "\n".join(kept).strip("\n"), share


FOUND = pa.struct([
    ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()),
    ("n_repeat_words", pa.int64()), ("text", pa.string()), ("share", pa.float64())])


def judging(with_text: bool):
    @F.arrow_udf("struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,text:string,share:double>")
    def judged_texts(texts: pa.Array) -> pa.Array:
        rows = [judge(t.as_py() or "") for t in texts]
        columns = [list(c) for c in zip(*rows)] if rows else [[] for _ in FOUND]
        if not with_text:
            columns[5] = [None] * len(rows)
        return pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND)], fields=list(FOUND))

    return judged_texts


def judged(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = True) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, cleaned) of every row.

    ``cleaned`` is the text without failing lines, if asked for. A document is kept unless it fails a base rule (under 10
    words, or over a fifth of its words in repeated 5-word windows) or loses over 70% of its words with its failing lines. A null or
    empty text has no words and fails. Repeated rows each get a row.
    """
    found = docs.select(F.col(doc_id).alias("doc_id"), judging(with_text)(F.col(text)).alias("f"))
    failed = (F.col("f.n_words") < LEAST_WORDS) | (100 * F.col("f.n_repeat_words") > MOST_REPEATED * F.col("f.n_words"))
    return found.select(
        "doc_id", "f.n_words", "f.word_chars", "f.n_symbols", "f.n_dup_lines", "f.n_repeat_words", failed.alias("base_failed"),
        (~failed & (F.col("f.share") >= LEAST_KEPT)).alias("kept"), *([F.col("f.text").alias("cleaned")] if with_text else []))
