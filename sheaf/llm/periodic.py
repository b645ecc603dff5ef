"""Periodic runs of words: suffix trees of a text and its reversal, constant-time common extensions, Lyndon roots."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheaf.llm.words import NON_SPACE, Words, chunks, mix, texts_of

#: The shortest run. All its words are covered by windows of half that length which come twice in the text.
SHORTEST = 12


class SuffixTree:
    """Ukkonen's suffix tree of a sequence of small numbers, with an end of its own, and its Euler tour.

    Every position has a leaf. The depth in words of the lowest common ancestor of two leaves, the length that their suffixes have
    in common, is the least depth between their places in the tour: two look-ups in a table of minima over powers of two.
    """

    def __init__(self, words: list[int]):
        self.n = len(words)
        self.grow([*words, -1])
        self.tour()

    def grow(self, s: list[int]) -> None:
        """Online construction: node 0 is the root; a node's edge is s[start:end], a leaf's runs to the end of ``s``."""
        n = len(s)
        start, end, link, children = [0], [0], [0], [{}]
        node, edge, length, left = 0, 0, 0, 0  # the active point, and how many suffixes wait
        for i, c in enumerate(s):
            left += 1
            last = 0
            while left:
                if not length:
                    edge = i
                here = children[node]
                child = here.get(s[edge])
                if child is None:
                    here[s[edge]] = len(start)
                    start.append(i), end.append(n), link.append(0), children.append(None)
                    if last:
                        link[last] = node
                        last = 0
                else:
                    size = (end[child] if end[child] < i + 1 else i + 1) - start[child]
                    if length >= size:
                        edge += size
                        length -= size
                        node = child
                        continue
                    if s[start[child] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    middle, at = len(start), start[child] + length
                    start.append(start[child]), end.append(at), link.append(0)
                    here[s[edge]] = middle
                    children.append({s[at]: child, c: middle + 1})
                    start.append(i), end.append(n), link.append(0), children.append(None)
                    start[child] = at
                    if last:
                        link[last] = middle
                    last = middle
                left -= 1
                if not node and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.children, self.total = start, end, children, n

    def tour(self) -> None:
        """Depths along the Euler tour, the place of each position's leaf in it, and ``rank``, the order of the suffixes; the end of
        the text comes before all words."""
        start, end, children, n = self.start, self.end, self.children, self.total
        depths, first, order = [0], [0] * n, []
        stack = [(0, 0, iter(sorted(children[0])))]
        while stack:
            node, depth, keys = stack[-1]
            key = next(keys, None)
            if key is None:
                stack.pop()
                if stack:
                    depths.append(stack[-1][1])
                continue
            child = children[node][key]
            below = depth + end[child] - start[child]
            if children[child] is None:
                at = n - below
                first[at] = len(depths)
                order.append(at)
                depths.append(below)
                depths.append(depth)
            else:
                depths.append(below)
                stack.append((child, below, iter(sorted(children[child]))))
        self.first = np.array(first, np.int64)
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.table = [np.array(depths, np.int32)]
        step = 1
        while 2 * step <= len(depths):
            low = self.table[-1]
            self.table.append(np.minimum(low[:-step], low[step:]))
            step *= 2

    def back(self) -> np.ndarray:
        """The rank of each suffix with words in the reverse order, where the end of the text still comes before all words."""
        start, end, children, n = self.start, self.end, self.children, self.total
        rank, place, stack = np.empty(n, np.int64), 0, [(0, 0)]
        while stack:
            node, depth = stack.pop()
            here = children[node]
            if here is None:
                rank[n - depth] = place
                place += 1
                continue
            below = sorted(here)  # the last one is taken from the stack first
            if below[0] < 0:
                below.append(below.pop(0))
            stack.extend([(here[k], depth + end[here[k]] - start[here[k]]) for k in below])
        return rank

    def common(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words the suffixes at i and at j, which differ, begin with in common; 0 behind the end."""
        x, y = self.first[i], self.first[j]
        x, y = np.minimum(x, y), np.maximum(x, y) + 1
        level = np.frexp((y - x).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level):
            of = level == k
            out[of] = np.minimum(self.table[k][x[of]], self.table[k][y[of] - (1 << int(k))])
        return out


def next_smaller(rank: list[int]) -> list[int]:
    """For each place the next one with a smaller rank, or the end."""
    n = len(rank)
    out, stack = [n] * n, []
    for i, r in enumerate(rank):
        while stack and rank[stack[-1]] > r:
            out[stack.pop()] = i
        stack.append(i)
    return out


def runs_of(words: list[int], shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence of small numbers, by start and period.

    The root of a run, as long as its period, is a longest Lyndon word of one of two opposite orders somewhere in it; a longest Lyndon word
    ends where the next smaller suffix begins. Each is extended to both sides as far as words a period apart are equal.
    """
    n = len(words)
    if n < shortest:
        return []
    tree, mirror = SuffixTree(words), SuffixTree(words[::-1])
    found = []
    for rank in (tree.rank, tree.back()):
        i, j = np.arange(n), np.array(next_smaller(rank[:n].tolist()), np.int64)
        period = j - i
        before, after = mirror.common(n - i, n - j), tree.common(i, j)
        length = before + period + after
        of = (length >= shortest) & (length >= 2 * period)
        found.append(np.stack([(i - before)[of], length[of], period[of]], axis=1))
    rows = np.unique(np.concatenate(found), axis=0)
    return [tuple(r) for r in rows[np.lexsort((rows[:, 2], rows[:, 0]))].tolist()]


def stretches(hashes: np.ndarray, text: np.ndarray, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Ranges of words that hold all runs, far shorter than the texts where these repeat little.

    A run of period q has ``shortest`` words and 2q or more; so all but its last q words, at least half of ``shortest``, come again
    q words on, and every word of it is in a window of that size that comes twice in the run. Words outside any window that comes
    twice in a text cut it; what is left is cut in the same way until nothing changes.
    """
    k = (shortest + 1) // 2
    m = len(hashes) - k + 1
    if m <= 0:
        return []
    gram = np.zeros(m, np.uint64)
    for i in range(k):
        gram = gram * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + m]
    of, at = text, np.flatnonzero(text[:m] == text[k - 1 :])
    while True:
        _, which, count = np.unique(mix(gram[at] ^ mix(of[at].astype(np.uint64))), return_inverse=True, return_counts=True)
        again = at[count[which] > 1]
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, again, 1)
        np.add.at(depth, again + k, -1)
        inside = np.cumsum(depth[:-1]) > 0
        edge = np.append(True, (inside[1:] != inside[:-1]) | (of[1:] != of[:-1]))
        of = np.cumsum(edge)
        if len(again) == len(at):
            starts = np.flatnonzero(edge)
            ends = np.append(starts[1:], len(hashes))
            kept = inside[starts] & (ends - starts >= shortest)
            return list(zip(starts[kept].tolist(), ends[kept].tolist()))
        at = again


def runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs``.

    Words are stretches without ASCII white space. A run is a stretch of ``shortest`` words or more, and of at least twice its smallest
    period, in which words a period apart are equal and which no neighbouring word extends; ``runs`` has all as (start, length,
    period), by start and period. ``collapsed`` is the text's words, joined by one space, without those that a run has after its
    first period. Each text is handled in its own task, and trees are built only over stretches of words that repeat within it, which takes
    about 1 KB of memory for each such word.

    A null or empty text, and one of white space only, has no words, no runs and an empty ``collapsed``. Repeated rows, and rows with
    a null id, each give a row; no rows give no rows.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            data, offsets = texts_of(batch.column(1))
            for at, to in chunks(offsets):
                w = Words(data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at], NON_SPACE)
                hashes = w.hashes()
                found, dropped = [[] for _ in range(to - at)], np.zeros(len(hashes) + 1, np.int64)
                for a, b in stretches(hashes, w.text, shortest):
                    i = w.text[a]
                    for start, length, period in runs_of(np.unique(hashes[a:b], return_inverse=True)[1].tolist(), shortest):
                        found[i].append((a + start - int(w.first[i]), length, period))
                        dropped[a + start + period] += 1
                        dropped[a + start + length] -= 1
                collapsed = w.joined(np.cumsum(dropped[:-1]) == 0)
                flat = [r for rs in found for r in rs]
                parts = [pa.array([r[c] for r in flat], pa.int64()) for c in range(3)]
                struct = pa.StructArray.from_arrays(parts, names=["start", "length", "period"])
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), struct)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(w.counts, pa.int64()), lists, collapsed],
                    names=["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")
