"""Rows kept whole beside an operator's own columns, whatever names and types theirs have."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def whole(docs: DataFrame) -> Column:
    """All columns of a row as one, so that they meet no other names. ``ROW.*`` takes it apart again."""
    return F.struct(*[quoted(c) for c in docs.columns]).alias(ROW)


def numbered(docs: DataFrame) -> list[Column]:
    """The columns as c0, c1, and so on, for plans in which one column for all would be taken apart too early. ``toDF`` names them again."""
    return [quoted(c).alias(f"c{i}") for i, c in enumerate(docs.columns)]


def _hashable(kind: T.DataType) -> bool:
    if isinstance(kind, T.ArrayType):
        return _hashable(kind.elementType)
    if isinstance(kind, T.StructType):
        return all(_hashable(f.dataType) for f in kind.fields)
    return isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType, T.DatetimeType, T.NullType))


def content_hash(docs: DataFrame) -> Column:
    """A hash of all columns; of maps, variants and others that have none, that of their JSON text."""
    plain = [quoted(f.name) for f in docs.schema.fields if _hashable(f.dataType)]
    other = [F.to_json(F.struct(quoted(f.name).alias("x"))) for f in docs.schema.fields if not _hashable(f.dataType)]
    return F.xxhash64(*plain, *other)
