"""Task messages as bytes: encoding, decoding, delimited blobs, text and JSON values."""

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sheaf.functions import wire
from sheaf.functions.ranking import ranked, summed_before
from sheaf.functions.text import utf8
from sheaf.schema import TASK, TASK_FIELD_NUMBERS

TEXT_FIELDS = ("job_id", "url", "method", "body")
DECODED = T.StructType([*TASK.fields, T.StructField("error", T.StringType())])


def encode_tasks(df: DataFrame, into: str = "value") -> DataFrame:
    """Adds the binary message of each task, computed in the JVM; empty fields are not written."""
    return df.withColumn(into, wire.task_message())


def _message_class():
    """The task message type, made in the worker from its field numbers."""
    from google.protobuf import descriptor_pb2, descriptor_pool, message_factory

    Field = descriptor_pb2.FieldDescriptorProto
    file = descriptor_pb2.FileDescriptorProto(name="task.proto", syntax="proto3")
    task = file.message_type.add(name="Task")
    for name, number in TASK_FIELD_NUMBERS.items():
        if name in TEXT_FIELDS:
            task.field.add(name=name, number=number, type=Field.TYPE_STRING, label=Field.LABEL_OPTIONAL)
            continue
        entry = task.nested_type.add(name=name.capitalize() + "Entry")
        entry.options.map_entry = True
        for i, part in enumerate(("key", "value"), 1):
            entry.field.add(name=part, number=i, type=Field.TYPE_STRING, label=Field.LABEL_OPTIONAL)
        task.field.add(name=name, number=number, type=Field.TYPE_MESSAGE, label=Field.LABEL_REPEATED,
                       type_name=f".Task.{entry.name}")
    pool = descriptor_pool.DescriptorPool()
    pool.Add(file)
    return message_factory.GetMessageClass(pool.FindMessageTypeByName("Task"))


@F.arrow_udf(DECODED)
def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    from google.protobuf.message import DecodeError

    make = _message_class()
    strings = pa.map_(pa.string(), pa.string())
    for values in batches:
        cols = {n: [] for n in TASK_FIELD_NUMBERS}
        errors = []
        for raw in values.to_pylist():
            message, error = make(), None
            try:
                message.ParseFromString(raw or b"")
            except DecodeError as e:
                message, error = make(), str(e) or "undecodable"
            for n in TEXT_FIELDS:
                cols[n].append(getattr(message, n))
            for n in ("headers", "params"):
                cols[n].append(sorted(getattr(message, n).items()))
            errors.append(error)
        arrays = [pa.array(cols[n], strings if n in ("headers", "params") else pa.string()) for n in cols]
        yield pa.StructArray.from_arrays([*arrays, pa.array(errors, pa.string())], [*cols, "error"])


# Evaluated once per row even when a filter on its error sits above it.
_decode = _decode.asNondeterministic()


def decode(df: DataFrame, col: str = "value") -> DataFrame:
    """Adds the task's columns plus ``cancel`` (null value) and ``error`` (undecodable).

    Only the value column goes to Python; all others stay in the JVM. Missing fields read as
    ``''`` or an empty map, unknown ones are skipped, and of repeated ones the last counts.
    """
    clash = [c for c in df.columns if c in (*TASK_FIELD_NUMBERS, "cancel", "error")]
    return (
        df.drop(*clash)
        .withColumn("_task", _decode(col))
        .select("*", F.col(col).isNull().alias("cancel"), "_task.*")
        .drop("_task")
    )


def decode_tasks(df: DataFrame, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(tasks, rejected): decoded tasks, and the rows whose bytes are no task message.

    Null values are cancels and are in neither; ``decode`` shows them.
    """
    decoded = decode(df, col)
    tasks = decoded.filter(~F.col("cancel") & F.col("error").isNull()).drop("cancel", "error")
    rejected = decoded.filter(F.col("error").isNotNull()).select(col, "error", *[
        c for c in df.columns if c != col and c not in TASK_FIELD_NUMBERS])
    return tasks, rejected


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _split(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    def messages(blob: bytes):
        at, out = 0, []
        while at < len(blob):
            size = shift = 0
            while True:
                if at >= len(blob):
                    return None
                byte = blob[at]
                at += 1
                size |= (byte & 127) << shift
                shift += 7
                if byte < 128:
                    break
            if at + size > len(blob):
                return None
            out.append(blob[at:at + size])
            at += size
        return out

    for blobs in batches:
        yield pa.array([None if b is None else messages(b) for b in blobs.to_pylist()], pa.list_(pa.binary()))


_split = _split.asNondeterministic()


def split_delimited(df: DataFrame, col: str) -> tuple[DataFrame, DataFrame]:
    """(messages, rejected): one row per message of each blob with its ``pos``; cut blobs rejected."""
    read = df.withColumn("_messages", _split(col))
    rows = read.filter(F.col("_messages").isNotNull()).select(
        *[c for c in df.columns if c != col], F.posexplode("_messages").alias("pos", "value"))
    return rows, read.filter(F.col("_messages").isNull()).drop("_messages")


#: A blob is one cell, so it is cut behind so many bytes of messages.
MOST_BYTES = 64 << 20


def join_delimited(df: DataFrame, keys: list[str], order: str, value: str = "value", most: int | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Blobs (keys, ``blob_no``, ``blob``) of each key: each message behind its length, in order.

    A key's messages are cut into blobs numbered from 0: of ``most`` messages where that is given, and else behind ``most_bytes`` bytes, so that a key
    of any size fits. Where no key has that much, which its sizes tell first, all messages of a key are one blob.
    """
    if most is not None:
        numbered = ranked(df, keys, [F.col(order)], "_rank").withColumn("blob_no", F.floor(F.col("_rank") / most))
    else:
        size = F.octet_length(value).cast("long") + 5  # a length has 5 bytes at the most
        largest = df.groupBy(*keys).agg(F.sum(size).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest <= most_bytes:
            numbered = df.withColumn("blob_no", F.lit(0).cast("long"))
        else:
            numbered = summed_before(df, keys, [F.col(order)], size, "_bytes").withColumn("blob_no", F.floor(F.col("_bytes") / most_bytes))
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), wire.sized_hex(value).alias("h"))))
    return numbered.groupBy(*keys, "blob_no").agg(parts.alias("_parts")).select(
        *keys, "blob_no", F.unhex(F.array_join(F.transform("_parts", lambda p: p["h"]), "")).alias("blob"))


def decode_values(df: DataFrame, fmt: str, col: str = "value") -> tuple[DataFrame, DataFrame]:
    """(values, rejected) for ``fmt`` text or json: adds ``text``, or ``doc`` (a variant)."""
    text = utf8(F.col(col).cast("binary"))
    if fmt == "text":
        read, name = df.withColumn("text", text), "text"
    elif fmt == "json":
        read, name = df.withColumn("doc", F.try_parse_json(text)), "doc"
    else:
        raise ValueError(f"unknown format: {fmt}")
    return read.filter(F.col(name).isNotNull()), read.filter(F.col(name).isNull()).drop(name)
