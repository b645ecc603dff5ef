"""Bytes as text."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def utf8(value: Column) -> Column:
    """Text of UTF-8 bytes, null when they are not valid UTF-8."""
    return F.try_validate_utf8(value.cast("string"))


def utf8_or_hex(value: Column) -> Column:
    return F.coalesce(utf8(value), F.hex(value))
