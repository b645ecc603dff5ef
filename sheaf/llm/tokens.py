"""Token ids of documents in a file format of compressed bit or byte planes, and back."""

import json
import re
import sys
import types
import zlib
from array import array

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.taskcontext import TaskContext

from sheaf.session import range_parts

BLOCK_IDS, LEVEL, END_ID = 1 << 16, 3, 1
#: Words, and pieces of words, whose ids a Python worker remembers, about 300 MB at the most.
KNOWN_WORDS, KNOWN_PIECES = 1_000_000, 500_000
PIECES = "array<struct<seq:bigint,doc_id:{kind},since:bigint,n:bigint,at:bigint>>"


def worker_store() -> dict:
    """Lives as long as a Python worker, which serves many tasks."""
    return sys.modules.setdefault("sheaf_worker_store", types.ModuleType("sheaf_worker_store")).__dict__


#: How a tokenizer may prepare a text for its ids to be those of its words, and of the pieces of these. Fixed values.
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words of visible Latin-1 characters, which that preparation only lower-cases, and their pieces by that pattern.
LATIN = re.compile("[!-~\xa1-\xff]+")
LETTERS, NUMBERS = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
PIECES_OF = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{LETTERS}{NUMBERS}]+")


def as_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def by_words(spec: dict) -> bool:
    """Whether a tokenizer drops white space and joins nothing over it, by the preparation named above."""
    normal, pre = spec.get("normalizer") or {}, spec.get("pre_tokenizer") or {}
    steps = [x["type"] for x in normal.get("normalizers", [])]
    split, level = [*pre.get("pretokenizers", []), {}, {}][:2]
    cuts = {k: split.get(k) for k in ("type", "pattern", "behavior", "invert")}
    return (
        steps == NORMALIZERS and len(pre.get("pretokenizers", [])) == 2 and level.get("type") == "ByteLevel"
        and not level.get("add_prefix_space") and not level.get("use_regex")
        and cuts == {"type": "Split", "pattern": {"Regex": PATTERN}, "behavior": "Removed", "invert": True})


class PieceIds(dict):
    """The ids of a piece of a word, by the tokenizer's model."""

    def __init__(self, tokenizer):
        from tokenizers.pre_tokenizers import ByteLevel

        self.level, self.cut = ByteLevel(add_prefix_space=False, use_regex=False), tokenizer.model.tokenize

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= KNOWN_PIECES:
            self.clear()
        spelt = piece if piece.isascii() else self.level.pre_tokenize_str(piece)[0][0]
        ids = self[piece] = as_bytes([t.id for t in self.cut(spelt)])
        return ids


class WordIds(dict):
    """The ids of a word, by the tokenizers library, as little-endian unsigned 32-bit integers."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.by_words, self.pieces = by_words(json.loads(tokenizer_json)), PieceIds(self.tokenizer)

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        if LATIN.fullmatch(word):
            ids = b"".join(map(self.pieces.__getitem__, PIECES_OF.findall(word.lower())))
        else:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def whole(self, text: str) -> bytes:
        return as_bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def encode(self, text: str) -> bytes:
        """Word by word, where the tokenizer drops white space and joins nothing over it, so the ids are those of the whole text.

        Where lower-casing goes letter by letter and no letter is composed (Latin-1), it comes first, so that fewer words differ.
        Another tokenizer, and a text that spells one of its special tokens, in any case, takes the whole text.
        """
        low = text.lower()
        if not self.by_words or any(x in text or x in low for x in self.special):
            return self.whole(text)
        try:
            if not text.isascii():
                text.encode("latin-1")
            text = low
        except UnicodeEncodeError:
            pass
        for space in "\n\t\r\x0b\x0c":
            text = text.replace(space, " ")
        return b"".join(map(self.__getitem__, text.split(" ")))


def to_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Ids as 32 planes, one for each bit, or as 4, one for each byte; the lowest first."""
    rows = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == "bit":
        return [p.tobytes() for p in np.packbits(np.unpackbits(rows, axis=1, bitorder="little").T, axis=1, bitorder="little")]
    return [p.tobytes() for p in np.ascontiguousarray(rows.T)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    table = np.stack([np.frombuffer(p, np.uint8) for p in planes])
    if len(planes) == 32:
        table = np.packbits(np.unpackbits(table, axis=1, count=n, bitorder="little").T, axis=1, bitorder="little").T
    return np.ascontiguousarray(table.T).view("<u4").ravel()


def pack(ids: np.ndarray, kind: str) -> tuple[bytes, list[int]]:
    """A block: its planes, each compressed, and the chunk index, which is where each plane ends."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    parts = [press.compress(p) for p in to_planes(ids, kind)]
    return b"".join(parts), np.cumsum([len(p) for p in parts]).tolist()


def unpack(data: bytes, index: list[int], n: int) -> np.ndarray:
    press = zstandard.ZstdDecompressor()
    return from_planes([press.decompress(data[a:b]) for a, b in zip([0, *index[:-1]], index)], n)


class Shard:
    """Ids of documents in their order, cut into blocks of a fixed size."""

    def __init__(self, number: int, kind: str):
        self.number, self.kind, self.block, self.first, self.seq = number, kind, 0, 0, 0
        self.waiting, self.size, self.pieces = [], 0, []

    def add(self, doc_id, ids: bytes):
        """Takes a document in; gives the blocks that are full."""
        ids, since = np.frombuffer(ids, "<u4"), 0
        while since < len(ids):
            n = min(BLOCK_IDS - self.size, len(ids) - since)
            self.waiting.append(ids[since : since + n])
            self.pieces.append({"seq": self.seq, "doc_id": doc_id, "since": since, "n": n, "at": self.first + self.size})
            since, self.size = since + n, self.size + n
            if self.size == BLOCK_IDS:
                yield self.flush()
        self.seq += 1

    def flush(self) -> dict:
        data, index = pack(np.concatenate(self.waiting), self.kind)
        out = {"shard": self.number, "block": self.block, "first": self.first, "n": self.size, "index": index, "data": data, "pieces": self.pieces}
        self.block, self.first = self.block + 1, self.first + self.size
        self.waiting, self.size, self.pieces = [], 0, []
        return out


def write_tokens(docs: DataFrame, path: str, tokenizer_file: str, doc_id: str = "doc_id", text: str = "text", planes: str = "byte") -> None:
    """Writes all ids of ``docs``, by ascending id, as blocks below ``path``.

    A row is a block: its shard and number, how many ids come before it in the shard, how many it holds, its planes
    with their chunk index, and the piece of each document in it. Shards are ranges of the document ids, so only texts are
    shuffled, once. A null text is empty and has the end id alone; null ids come first; rows of one id go by a hash of
    their text. A document of any length goes over as many blocks as it needs.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        tokenizer = spark.sparkContext.broadcast(f.read())
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text")]
    sorted_rows = rows.repartitionByRange(range_parts(rows), *order).sortWithinPartitions(*order)
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"shard int, block int, first long, n long, index array<int>, data binary, pieces {PIECES.format(kind=kind)}"
    end = np.array([END_ID], "<u4").tobytes()

    def run(batches):
        store, shard = worker_store(), Shard(TaskContext.get().partitionId(), planes)
        if store.get("tokenizer") != tokenizer.value:
            store["tokenizer"], store["words"] = tokenizer.value, WordIds(tokenizer.value)
        words, as_arrow = store["words"], None
        for batch in batches:
            as_arrow = as_arrow or block_schema(batch.schema.field(0).type)
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for block in shard.add(key, words.encode(value) + end):
                    yield pa.RecordBatch.from_pylist([block], as_arrow)
        if shard.size:
            yield pa.RecordBatch.from_pylist([shard.flush()], as_arrow)

    sorted_rows.mapInArrow(run, schema).write.option("compression", "none").parquet(path)


def block_schema(kind: pa.DataType) -> pa.Schema:
    piece = pa.struct([("seq", pa.int64()), ("doc_id", kind), ("since", pa.int64()), ("n", pa.int64()), ("at", pa.int64())])
    return pa.schema([
        ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n", pa.int64()),
        ("index", pa.list_(pa.int32())), ("data", pa.binary()), ("pieces", pa.list_(piece))])


def read_pieces(spark: SparkSession, path: str, of_ids, kind: str, as_arrow: pa.DataType) -> DataFrame:
    """(shard, seq, doc_id, since, n, at, value): ``of_ids`` of the ids of each piece, decoded from the blocks."""

    def run(batches):
        for batch in batches:
            doc = batch.schema.field("pieces").type.value_type.field("doc_id").type
            numbers = [(c, pa.int64()) for c in ("since", "n", "at")]
            schema = pa.schema([("shard", pa.int32()), ("seq", pa.int64()), ("doc_id", doc), *numbers, ("value", as_arrow)])
            for row in batch.to_pylist():
                ids = unpack(row["data"], row["index"], row["n"])
                p = row["pieces"]
                at = [x["at"] - row["first"] for x in p]
                yield pa.RecordBatch.from_pydict({
                    "shard": [row["shard"]] * len(p), **{c: [x[c] for x in p] for c in ("seq", "doc_id", "since", "n", "at")},
                    "value": [of_ids(ids[a : a + x["n"]]) for a, x in zip(at, p)]}, schema)

    blocks = spark.read.parquet(path)
    doc = blocks.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()
    return blocks.select("shard", "first", "n", "index", "data", "pieces").mapInArrow(
        run, f"shard int, seq long, doc_id {doc}, since long, n long, at long, value {kind}")


def starts(spark: SparkSession, path: str) -> DataFrame:
    """(shard, before): ids in earlier shards. One row per shard, of which there are as many as tasks that wrote."""
    sums = spark.read.parquet(path).groupBy("shard").agg(F.sum("n").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids): whole documents, with their ids as an array."""
    pieces = read_pieces(spark, path, lambda ids: ids.astype(np.int64).tolist(), "array<bigint>", pa.list_(pa.int64()))
    docs = pieces.groupBy("shard", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("since", "value"))).alias("parts"))
    return docs.join(F.broadcast(starts(spark, path)), "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", F.flatten("parts.value").alias("ids"))


@F.arrow_udf(T.LongType())
def joined_crc(crcs: pa.Array, sizes: pa.Array) -> pa.Array:
    """The crc32 of a document from those of its pieces: of zeros as long as the next piece, it takes the place of the bytes before."""
    out = []
    for own, n in zip(crcs.to_pylist(), sizes.to_pylist()):
        total = own[0]
        for crc, size in zip(own[1:], n[1:]):
            zeros = bytes(4 * size)
            total = zlib.crc32(zeros, total) ^ zlib.crc32(zeros) ^ crc
        out.append(total)
    return pa.array(out, pa.int64())


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the files."""
    pieces = read_pieces(spark, path, lambda ids: zlib.crc32(np.ascontiguousarray(ids)), "long", pa.int64())
    docs = pieces.groupBy("shard", "seq").agg(
        F.first("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n_tokens"),
        F.array_sort(F.collect_list(F.struct("since", "n", "value"))).alias("parts"))
    return docs.join(F.broadcast(starts(spark, path)), "shard").select(
        "doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", joined_crc("parts.value", "parts.n").alias("ids_crc32"))
