"""Words and word n-grams of a batch of texts, as numpy arrays over their UTF-8 bytes."""

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

from sheaf.session import tune

#: Bytes of text handled at a time. The arrays below take some 60 bytes for each of them; one
#: longer text is handled alone.
CHUNK_BYTES = 1 << 20
SPACES = b" \t\n\x0b\x0c\r"
FACTOR = 0x9E3779B97F4A7C15


def tuned(spark: SparkSession) -> SparkSession:
    """The library's settings, and Arrow batches bounded in rows and bytes, as texts may be long."""
    tune(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))
    return spark


def class_table(kept: dict[int, int]) -> np.ndarray:
    """A byte to byte table; bytes that are not named become 0, which separates words."""
    table = np.zeros(256, np.uint8)
    for byte, becomes in kept.items():
        table[byte] = becomes
    return table


def lowered(byte: int) -> int:
    return byte + 32 if 65 <= byte <= 90 else byte


#: Words of letters, digits and all non-ASCII characters, A-Z lower-cased.
ALNUM = class_table({b: lowered(b) for b in range(256) if b >= 128 or chr(b).isalnum()})
#: Words of anything but ASCII white space. The byte 0 becomes a tab, which no word has.
NON_SPACE = class_table({b: b or 9 for b in range(256) if b not in SPACES})


def texts_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after another, and where each begins (with the end); a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, most: int = CHUNK_BYTES):
    """Ranges of texts that hold up to ``most`` bytes, or one longer text."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1)
        yield at, to
        at = to


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def powers(n: int, factor: int) -> np.ndarray:
    out = np.full(n, factor, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class Words:
    """The words of some texts: ``starts`` and ``ends`` in the bytes, ``text`` each belongs to, and hashes.

    ``groups`` optionally tells kinds of word bytes apart: a word ends where the kind changes.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, table: np.ndarray, groups: np.ndarray | None = None):
        self.data, self.offsets = data, offsets
        self.bytes, self.n = table[data], len(offsets) - 1
        kind = (self.bytes != 0).astype(np.uint8) if groups is None else groups[data]
        edge = np.ones(len(data) + 1, bool)
        edge[1:-1] = kind[1:] != kind[:-1]
        edge[offsets] = True
        cuts = np.flatnonzero(edge)
        inside = kind[cuts[:-1]] != 0
        self.starts, self.ends = cuts[:-1][inside], cuts[1:][inside]
        self.text = np.searchsorted(offsets, self.starts, "right") - 1
        self.first = np.searchsorted(self.text, np.arange(self.n + 1))  # of each text, with the end
        self.counts = np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word: of equal words equal. Different words may share one, by chance only."""
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        sums = np.zeros(len(self.bytes) + 1, np.uint64)
        np.cumsum(self.bytes * powers(len(self.bytes), FACTOR), dtype=np.uint64, out=sums[1:])
        back = powers(len(self.bytes), pow(FACTOR, -1, 1 << 64))
        return mix((sums[self.ends] - sums[self.starts]) * back[self.starts])

    def grams(self, words: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``k``-word windows within a text, and the word each begins at."""
        n = len(words) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        h = np.zeros(n, np.uint64)
        for i in range(k):
            h = h * np.uint64(FACTOR) + words[i : i + n]
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return mix(h[at] + np.uint64(k)), at

    def joined(self, kept: np.ndarray) -> pa.Array:
        """Of each text the kept words, joined by one space."""
        at = np.flatnonzero(kept)
        size = np.zeros(len(self.data) + 1, np.int8)
        np.add.at(size, self.starts[at], 1)
        np.add.at(size, self.ends[at], -1)
        inside = np.cumsum(size[:-1], dtype=np.int8) > 0
        out = self.data.copy()
        gaps = self.ends[at[:-1]][self.text[at[:-1]] == self.text[at[1:]]]  # behind words with one to follow in their text
        out[gaps] = 32
        inside[gaps] = True
        edges = np.append(0, np.cumsum(inside))[self.offsets]
        return pa.Array.from_buffers(pa.large_string(), self.n, [None, pa.py_buffer(edges.astype(np.int64)), pa.py_buffer(out[inside])]).cast(pa.string())
