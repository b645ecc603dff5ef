"""The task message's wire format as SQL expressions (no Python worker needed).

Bytes are put together as hex text and turned to binary once at the end. The expressions are
SQL text, as they are long and parse faster than they would be built call by call.
"""

from pyspark.sql import Column
from pyspark.sql import functions as F

from sheaf.schema import TASK_FIELD_NUMBERS

LENGTH_DELIMITED = 2
MAP_FIELDS = ("headers", "params")


def varint_hex(n: str) -> str:
    """Base-128 length of up to five bytes, low group first."""

    def written(size: int) -> str:
        groups = [f"((shiftright({n}, {7 * i}) & 127) | 128)" for i in range(size - 1)]
        groups.append(f"shiftright({n}, {7 * (size - 1)})")
        return " || ".join(f"lpad(hex({g}), 2, '0')" for g in groups)

    cases = " ".join(f"when {n} < {1 << (7 * size)} then {written(size)}" for size in (1, 2, 3, 4))
    return f"case {cases} else {written(5)} end"


def _sized(number: int, size: str, content_hex: str) -> str:
    tag = f"{number << 3 | LENGTH_DELIMITED:02X}"
    return f"('{tag}' || {varint_hex(size)} || {content_hex})"


def _text_field(number: int, text: str) -> str:
    """Empty and unset text are not written."""
    size = f"octet_length({text})"
    return f"case when {size} > 0 then {_sized(number, size, f'hex({text})')} else '' end"


def _map_field(number: int, entries: str) -> str:
    """One sized entry per pair, in key order.

    Written in two passes, so that an entry's length is taken from its finished text and not
    from a copy of the expression that made it.
    """
    key = _sized(1, "octet_length(e.key)", "hex(e.key)")
    value = _sized(2, "octet_length(e.value)", "hex(e.value)")
    pairs = f"transform(array_sort(map_entries({entries})), e -> {key} || {value})"
    written = f"transform({pairs}, p -> {_sized(number, '(length(p) div 2)', 'p')})"
    return f"coalesce(array_join({written}, ''), '')"


def task_message() -> Column:
    """Binary message of the task in a row's columns."""
    fields = [(_map_field if name in MAP_FIELDS else _text_field)(number, name)
              for name, number in TASK_FIELD_NUMBERS.items()]
    return F.expr(f"unhex({' || '.join(fields)})")


def sized_hex(column: str) -> Column:
    """Hex text of a binary column behind its length."""
    return F.expr(f"{varint_hex(f'octet_length({column})')} || hex({column})")
