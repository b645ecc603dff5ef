"""Time-ordered ids and dated keys."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def time_ordered_id(ts: Column, *row_key: Column) -> Column:
    """A UUIDv7-shaped id: 48 bits of epoch millis, then bits of the row key's hash.

    Being a function of the row, it is the same when a task is run again. ``row_key``
    must tell apart rows of one millisecond (a log offset or a request id).
    """
    millis = F.unix_millis(ts.cast("timestamp"))
    head = F.lpad(F.lower(F.hex(millis)), 12, "0")
    bits = F.md5(F.concat_ws(":", *[c.cast("string") for c in row_key]))
    return F.concat(
        F.substring(head, 1, 8), F.lit("-"), F.substring(head, 9, 4),
        F.lit("-7"), F.substring(bits, 1, 3), F.lit("-8"), F.substring(bits, 4, 3),
        F.lit("-"), F.substring(bits, 7, 12),
    )


def dated_key(prefix: Column, ts: Column, ident: Column, filename: Column) -> Column:
    day = F.date_format(ts, "yyyy/MM/dd")
    return F.concat_ws("/", prefix, day, ident, filename)
