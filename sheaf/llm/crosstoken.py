"""Alignment of two tokenizers' tokens, and corpus-wide counts of the id pairs that end together, by a minimal perfect hash."""

import gc
import json
import os
import re
import sys
import types
import uuid
from collections import Counter
from contextlib import contextmanager
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from sheaf.llm.words import mix
from sheaf.session import settled

#: A unit of text: white space and what follows it up to the next. Characters 28 to 31 are white space to Python, and not to the tokenizers.
UNIT = re.compile(r"\s*\S+|\s+")
BEHIND = re.compile(r"\S(\s)")
ODD = "\x1c\x1d\x1e\x1f"
#: The pattern of byte-level preparation. Fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a unit is cut into pieces, behind a letter and before a sign or digit of ASCII, if no entry of B reaches over it; A's pattern does not.
LETTER, SIGN = "[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]", r"[!-@\[-`{-~]"
CUT, JOINED = re.compile(f"(?<={LETTER})(?={SIGN})"), re.compile(LETTER + SIGN)
#: Units in a worker's memory, of each kind twice so many, and their characters; distinct units whose pairs are counted at a time.
MOST_UNITS, MOST_CHARS, COUNTED, AT_ONCE = 250_000, 6 << 20, 100_000, 300
#: Counts are summed in blocks of so many, in two steps of which the first has so many ways.
BLOCK, WAYS = 4096, 64
B_BITS = 32
#: What is summed up for a text, and the bits that each has in a unit's number; the last one has all that are left.
SUMS, SUM_BITS = ["n_a", "n_b", "n_links", "n_best", "count_sum"], 40


def byte_table() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the rest from U+0100 on."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    hidden = [b for b in range(256) if b not in shown]
    return {**{chr(b): b for b in shown}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


class ByteLevel:
    """Tokenizer A, a byte-level file of the tokenizers library. Text that spells a special token is plain text.

    Where the file's merges are in the order of their ids and its preparation is the library's own pattern, as with byte_bpe_50k.json, its
    ids are those of tiktoken with the same entries, which is several times faster on rare words; any other file is run by the
    tokenizers library.
    """

    def __init__(self, spec: str):
        held, table = json.loads(spec), byte_table()
        vocabulary = held["model"]["vocab"]
        self.bytes = {i: bytes(table[c] for c in t) for t, i in vocabulary.items()}
        split = held.get("pre_tokenizer") or {}
        # the pattern joins nothing to white space behind it
        self.at_spaces = held.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex", True)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in held["model"]["merges"]]
        by_id = all(vocabulary.get(x + y) == 256 + i for i, (x, y) in enumerate(merges)) and len(vocabulary) == 256 + len(merges)
        if by_id and self.at_spaces and not split.get("add_prefix_space"):
            import tiktoken

            ranks = {t: i for i, t in self.bytes.items()}
            self.run = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            tokenizer = Tokenizer.from_str(spec)
            tokenizer.encode_special_tokens = True
            self.run = lambda text: tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> list[int]:
        return self.run(" " + text)


class Pieces:
    """Tokenizer B, of the sentencepiece library, which puts a space before a text itself."""

    def __init__(self, model: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=model)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.bytes = {
            i: bytes([int(t[3:5], 16)]) if self.model.is_byte(i) else t.replace("\u2581", " ").encode() for i, t in enumerate(names)}
        #: White space that some piece joins to something before it.
        self.joined = {c for t in names for c in BEHIND.findall(t.replace("\u2581", " "))}
        self.at_signs = not any(JOINED.search(t) for i, t in enumerate(names) if not (
            self.model.is_byte(i) or self.model.is_control(i) or self.model.is_unknown(i)))

    def encode(self, parts: list[str]) -> list[int]:
        """The ids of a text that begins with a space, cut where tokens end; some parts at a time, as the library is slower on long texts."""
        texts, since = [], 0
        while since < len(parts):
            to = since + AT_ONCE
            while to < len(parts) and parts[to][0] != " ":  # the space that the library puts before each
                to += 1
            texts.append("".join(parts[since:to])[1:])
            since = to
        return [i for ids in self.model.encode(texts, num_threads=1) for i in ids]


class Unit:
    """What the tokenizers make of a piece of text: how many tokens, the groups as text, and the pairs that end together, as 64-bit numbers."""

    __slots__ = ("n_a", "n_b", "groups", "pairs", "n_links", "sums")

    def __init__(self, n_a: int, n_b: int, groups: str, pairs: bytes):
        self.n_a, self.n_b, self.groups, self.pairs = n_a, n_b, groups, pairs
        self.n_links, self.sums = len(pairs) // 8, None  # all of ``SUMS`` in one number, once it is looked up


def pairs_of(units) -> np.ndarray:
    return np.frombuffer(b"".join([u.pairs for u in units]), np.int64)


class Known(dict):
    """Units by their text, the newer half and the older half of those last met: what is met again is among the newer ones."""

    def __init__(self):
        self.older, self.chars = {}, 0

    def turn(self) -> None:
        """Forgets the older half, once the newer one is full."""
        if len(self) > MOST_UNITS or self.chars > MOST_CHARS:
            self.older, self.chars = dict(self), 0
            self.clear()

    def missing(self, parts: set) -> list[str]:
        """Those of the parts that are not known, for the caller to put in; what is known is among the newer ones then."""
        met = parts.difference(self)
        again = met.intersection(self.older)
        self.update(zip(again, map(self.older.__getitem__, again)))
        self.chars += sum(map(len, met))  # the others are to be put in
        return list(met.difference(again))


class Aligner:
    """Two tokenizers, and the units of text they have met."""

    def __init__(self, a_spec: str, b_model: bytes):
        self.a, self.b = ByteLevel(a_spec), Pieces(b_model)
        self.in_units = self.a.at_spaces and " " not in self.b.joined
        self.odd = re.compile(f"[{re.escape(ODD + ''.join(sorted(self.b.joined)))}]")
        self.sizes = [np.array([len(t.bytes.get(i, b"")) for i in range(max(t.bytes) + 1)], np.int64) for t in (self.a, self.b)]
        self.names = [str(i) for i in range(max(len(self.a.bytes), len(self.b.bytes)) + 1)]
        self.known, self.pieces, self.counted_by, self.unspelt = Known(), Known(), None, False

    def count_by(self, counts: str) -> None:
        """Units that were looked up in other counts are to be looked up anew."""
        if self.counted_by != counts:
            self.counted_by = counts
            for units in (self.known, self.known.older, self.pieces, self.pieces.older):
                for u in units.values():
                    if u is not None:
                        u.sums = None

    def align(self, parts: list[str]) -> list[Unit] | None:
        """A text that begins with a space, cut where both tokenizers start anew, to a unit for each part; None if the tokens do not spell it."""
        text = "".join(parts)
        whole, ids = text.encode(), (self.a.encode(text[1:]), self.b.encode(parts))
        if not whole or any(b"".join(map(t.bytes.__getitem__, x)) != whole for t, x in zip((self.a, self.b), ids)):
            return None
        a, b = (np.array(x, np.int64) for x in ids)
        a_ends, b_ends = (np.cumsum(size[x]) for size, x in zip(self.sizes, (a, b)))
        ends = np.zeros(len(whole) + 1, bool)
        ends[a_ends] = True
        at_b = np.flatnonzero(ends[b_ends])
        at_a = np.searchsorted(a_ends, b_ends[at_b])
        pairs = (a[at_a] << B_BITS | b[at_b]).tobytes()
        groups = self.grouped(*ids, at_a, at_b)
        ends = np.cumsum([len(p) if p.isascii() else len(p.encode()) for p in parts])  # of the parts
        cuts = [np.append(0, np.searchsorted(x, ends, "right")).tolist() for x in (a_ends, b_ends, a_ends[at_a])]
        return [
            Unit(x - w, y - v, groups[u] if z - u == 1 else ";".join(groups[u:z]), pairs[8 * u : 8 * z])
            for w, x, v, y, u, z in zip(cuts[0], cuts[0][1:], cuts[1], cuts[1][1:], cuts[2], cuts[2][1:])]

    def grouped(self, a: list[int], b: list[int], at_a: np.ndarray, at_b: np.ndarray) -> list[str]:
        """The groups that end at the given tokens, each as text."""
        names = self.names
        a, b = [names[i] for i in a], [names[i] for i in b]
        to_a, to_b = (at_a + 1).tolist(), (at_b + 1).tolist()
        return [
            (a[i] if j - i == 1 else ",".join(a[i:j])) + "|" + (b[k] if m - k == 1 else ",".join(b[k:m]))
            for i, j, k, m in zip([0, *to_a], to_a, [0, *to_b], to_b)]

    def learn(self, new: list[str]) -> None:
        """Takes pieces in, all as one text: those that do not begin with white space behind a word. One by one, if their tokens do not spell it, and
        those of white space alone, which would join what follows."""
        parts, at = [" x"], {}
        for p in new:
            if not p.isspace():
                if not p[0].isspace():
                    parts.append(" x")
                at[p] = len(parts)
                parts.append(p)
        found = self.align(parts)
        for p in new:
            unit = found[at[p]] if found and p in at else (self.align([" x", p]) or [None, None])[1]
            self.pieces[p] = unit

    def unit(self, pieces: list[str]) -> Unit | None:
        """A unit from its pieces, or None if the tokens of one do not spell it."""
        units = [self.pieces[p] for p in pieces]
        if None in units:
            return None
        return Unit(sum([u.n_a for u in units]), sum([u.n_b for u in units]), ";".join([u.groups for u in units]), b"".join([u.pairs for u in units]))

    def units(self, texts: list[str | None]) -> list[list[Unit]]:
        """Each text as units whose tokens, one after another, are those of the whole text; none for a text without tokens.

        Units and the pieces of units are kept for the next texts. A text with a unit that its tokens do not spell is aligned as a whole.
        """
        self.known.turn()
        self.pieces.turn()
        parts = [UNIT.findall(" " + t) if t and self.in_units and not self.odd.search(t) else [] for t in texts]
        new = self.known.missing(set().union(*parts))
        if new:
            cuts = [CUT.split(p) for p in new] if self.b.at_signs else [[p] for p in new]
            if pieces := self.pieces.missing(set(chain.from_iterable(cuts))):
                self.learn(pieces)
            known, single = self.known, self.pieces
            for part, pieces in zip(new, cuts):
                known[part] = single[pieces[0]] if len(pieces) == 1 else self.unit(pieces)
            self.unspelt = self.unspelt or None in map(known.__getitem__, new)
        out = []
        for t, ps in zip(texts, parts):
            units = list(map(self.known.__getitem__, ps))
            out.append(self.align([" " + t]) or [] if t and (not ps or self.unspelt and None in units) else units)
        return out


def aligner_of(tokenizers) -> Aligner:
    """The aligner of a Python worker, which serves many tasks."""
    store = sys.modules.setdefault("sheaf_worker_store", types.ModuleType("sheaf_worker_store")).__dict__
    key = "aligner", hash(tokenizers.value)
    if key not in store:
        store[key] = Aligner(*tokenizers.value)
    return store[key]


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys, which are kept beside it to verify.

    Each level hashes the keys left over by the ones before into twice as many bits; keys alone in their bit stay there, and their
    number is the count of bits set before it.
    """

    def __init__(self, keys: np.ndarray):
        self.levels, left, first = [], keys.astype(np.uint64), 0
        while len(left):
            m = 2 * len(left) + 64
            at = self.place(left, len(self.levels), m)
            alone = np.bincount(at, minlength=m) == 1
            bits = np.packbits(np.append(alone, np.zeros(-m % 64, bool)), bitorder="little").view("<u8")
            ones = np.bitwise_count(bits).astype(np.int64)
            self.levels.append((m, bits, first + np.cumsum(ones) - ones))
            first, left = first + int(ones.sum()), left[~alone[at]]
        self.keys = np.zeros(len(keys), np.uint64)
        self.keys[self.number(keys.astype(np.uint64))] = keys.astype(np.uint64)

    @staticmethod
    def place(keys: np.ndarray, level: int, m: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) % np.uint64(m)).astype(np.int64)

    def number(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number, from 0; of a key that was not built in, any number or -1."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, bits, before) in enumerate(self.levels):
            if not len(left):
                break
            at = self.place(keys[left], level, m)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            found = (bits[word] >> bit) & np.uint64(1) == 1
            below = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[found]] = (before[word] + np.bitwise_count(below))[found]
            left = left[~found]
        return out

    def verified(self, keys: np.ndarray) -> np.ndarray:
        """Each key's number. A key that was not built in is an error: both passes must see the same documents."""
        keys = keys.astype(np.uint64)
        n = self.number(keys)
        if len(keys) and (not len(self.keys) or (n < 0).any() or (self.keys[n] != keys).any()):
            raise ValueError("a pair of ids that the first pass did not see")
        return n


@contextmanager
def without_collector():
    """Units are many and in no cycles, so the garbage collector would go through them all again and again for nothing."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def partial_counts(texts: DataFrame, tokenizers) -> DataFrame:
    """(pair, n): the pairs that each task meets, with counts; a pair is A's id above 32 bits of B's id."""

    def run(batches):
        aligner, met = aligner_of(tokenizers), Counter()

        def counted():
            n = np.fromiter(met.values(), np.int64, len(met))
            pairs, of = np.unique(pairs_of(met), return_inverse=True)
            n = np.bincount(of, np.repeat(n, [u.n_links for u in met]).astype(np.float64), len(pairs))
            met.clear()
            return pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(n.astype(np.int64))], names=["pair", "n"])

        with without_collector():
            for batch in batches:
                for units in aligner.units(batch.column(0).to_pylist()):
                    met.update(units)
                if len(met) > COUNTED:
                    yield counted()
            if met:
                yield counted()

    return texts.mapInArrow(run, "pair long, n long")


def summed(parts: list[bytes]) -> bytes:
    return np.sum([np.frombuffer(p, "<i8") for p in parts], axis=0, dtype="<i8").tobytes()


def count_vector(partials: DataFrame, hashed, n_pairs: int) -> np.ndarray:
    """Counts of all pairs, indexed by the hash: each task's dense vector in blocks, summed as a tree of two steps."""

    def vectors(batches):
        counts = np.zeros(-(-n_pairs // BLOCK) * BLOCK, "<i8")
        for batch in batches:
            np.add.at(counts, hashed.value.verified(batch.column(0).to_numpy()), batch.column(1).to_numpy())
        blocks = counts.reshape(-1, BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        yield pa.RecordBatch.from_arrays([
            pa.array(some), pa.array(np.full(len(some), TaskContext.get().partitionId() % WAYS, np.int64)),
            pa.array([blocks[i].tobytes() for i in some], pa.binary())], names=["block", "way", "counts"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({
            "block": table["block"].slice(0, 1), "way": table["way"].slice(0, 1), "counts": pa.array([summed(table["counts"].to_pylist())], pa.binary())})

    schema = "block long, way long, counts binary"
    first = partials.mapInArrow(vectors, schema).groupBy("block", "way").applyInArrow(add, schema)
    out = np.zeros(-(-n_pairs // BLOCK) * BLOCK, "<i8")
    for row in first.groupBy("block").applyInArrow(add, schema).select("block", "counts").collect():
        out[row["block"] * BLOCK :][:BLOCK] = np.frombuffer(row["counts"], "<i8")
    return out[:n_pairs]


class Counts:
    """The counted pairs of a corpus: the hash, the counts by its numbers, and which are the highest of their B id."""

    def __init__(self, hashed: PerfectHash, counts: np.ndarray):
        self.hashed, self.counts = hashed, counts
        b = (hashed.keys & np.uint64((1 << B_BITS) - 1)).astype(np.int64)
        highest = np.zeros(int(b.max()) + 1 if len(b) else 0, np.int64)
        np.maximum.at(highest, b, counts)
        self.best = counts == highest[b] if len(b) else np.zeros(0, bool)

    def fill(self, units: list[Unit]) -> None:
        """Looks the links of some units up."""
        if units:
            n = self.hashed.verified(pairs_of(units))
            edges = np.cumsum([0, *[u.n_links for u in units]]).tolist()
            sums, best = (np.append(0, np.cumsum(x))[edges] for x in (self.counts[n], self.best[n].astype(np.int64)))
            for u, s, b in zip(units, np.diff(sums).tolist(), np.diff(best).tolist()):
                u.sums = u.n_a | u.n_b << SUM_BITS | u.n_links << 2 * SUM_BITS | b << 3 * SUM_BITS | s << 4 * SUM_BITS


def counted(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> tuple[Counts, object]:
    """Counts of all linked pairs of the corpus, and the tokenizers as a broadcast.

    Two linked tokens end at the same byte, so the bytes of one end those of the other. The distinct pairs are thus no
    more than the entries of one vocabulary that end, byte by byte, with one of the other: some hundred thousand for vocabularies of
    ten thousands, at any size of the corpus. So they, their hash and one vector of their counts are for the driver to hold.
    """
    spark = docs.sparkSession
    with open(a_file, encoding="utf-8") as a, open(b_file, "rb") as b:
        tokenizers = spark.sparkContext.broadcast((a.read(), b.read()))
    partials = settled(partial_counts(docs.select(F.col(text).cast("string").alias("text")), tokenizers))
    pairs = partials.select("pair").distinct().toArrow().column("pair").to_numpy()
    hashed = PerfectHash(np.sort(pairs))
    return Counts(hashed, count_vector(partials, spark.sparkContext.broadcast(hashed), len(pairs))), tokenizers


def pair_counts(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """(a, b, n): how many links of the corpus hold each pair of ids."""
    found, _ = counted(docs, a_file, b_file, text)
    keys = found.hashed.keys
    return docs.sparkSession.createDataFrame(pa.table({
        "a": pa.array((keys >> np.uint64(B_BITS)).astype(np.int64)), "b": pa.array((keys & np.uint64((1 << B_BITS) - 1)).astype(np.int64)),
        "n": pa.array(found.counts.astype(np.int64))}))


def aligned(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups) of every row of ``docs``.

    Tokenizer A is a byte-level file of the tokenizers library and encodes a space and the text, B a sentencepiece model that adds
    the space. A group ends where tokens of both end, and its last two tokens are a link; ``groups`` lists all, as
    ``a1,a2|b1;a3|b2``. ``count_sum`` sums how many links of the corpus each link's ids have, and ``n_best`` counts the links whose
    number is the highest of their B id, ties included. Texts are aligned twice: for the counts, and to look them up.

    Both tokenizers start anew where white space begins, so they run on what lies between these cuts, once for all its occurrences
    that a worker remembers. Whether they do the files' own settings and entries tell; tokenizers that may reach over a space, and texts with
    other white space that an entry joins to what is before it, such as a carriage return, are aligned as a whole.

    A null or empty text, and one that its tokens do not spell byte by byte, has no tokens: zeros and empty ``groups``. Repeated
    rows, and rows with a null id, each count and give a row; no rows give no rows.
    """
    found, tokenizers = counted(docs, a_file, b_file, text)
    held = docs.sparkSession.sparkContext.broadcast(found)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    groups, number, name = attrgetter("groups"), attrgetter("sums"), uuid.uuid4().hex
    low = (1 << SUM_BITS) - 1

    def run(batches):
        aligner = aligner_of(tokenizers)
        aligner.count_by(name)
        with without_collector():
            for batch in batches:
                units = aligner.units(batch.column(1).to_pylist())
                held.value.fill([u for u in set().union(*units) if u.sums is None])
                totals = [sum(map(number, us)) for us in units]
                sums = {k: pa.array([(t >> i * SUM_BITS) & low if i < 4 else t >> i * SUM_BITS for t in totals], pa.int64()) for i, k in enumerate(SUMS)}
                yield pa.RecordBatch.from_pydict({
                    "doc_id": batch.column(0), "n_a": sums["n_a"], "n_b": sums["n_b"], "n_groups": sums["n_links"], "n_links": sums["n_links"],
                    "n_best": sums["n_best"], "count_sum": sums["count_sum"], "groups": pa.array([";".join(map(groups, us)) for us in units], pa.string())})

    return rows.mapInArrow(
        run, f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
