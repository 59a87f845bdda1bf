"""Logical column types, how Spark stores them, and which literals they take."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import types as T

from cairn.plans.errors import TypeMismatch

#: Logical type -> Spark type. Timestamps are microseconds; wide integers are 32 big-endian bytes
#: (signed ones with the sign bit flipped), so that binary order is numeric order.
SPARK = {
    "boolean": T.BooleanType(),
    "u8": T.ShortType(),
    "u64": T.DecimalType(20, 0),
    "integer": T.LongType(),
    "u256": T.BinaryType(),
    "i256": T.BinaryType(),
    "timestamp": T.LongType(),
    "float": T.DoubleType(),
    "text": T.StringType(),
    "json": T.StringType(),
    "blob": T.BinaryType(),
}
INTEGRAL = {"u8", "u64", "integer", "timestamp"}
_LIMITS = {"u8": (0, 255), "u64": (0, 2**64 - 1), "integer": (-(2**63), 2**63 - 1), "timestamp": (-(2**63), 2**63 - 1)}


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    nullable: bool = True

    def field(self) -> T.StructField:
        return T.StructField(self.name, SPARK[self.type], self.nullable, {"logical": self.type})


def logical(field: T.StructField) -> str | None:
    """The logical type of a Spark field: from its metadata, or the nearest one. None for types outside the model (arrays and so on)."""
    if "logical" in field.metadata:
        return field.metadata["logical"]
    t = field.dataType
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "integer"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "float"
    if isinstance(t, T.DecimalType):
        return "integer" if t.scale == 0 else "float"
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "timestamp"
    return {T.BooleanType: "boolean", T.StringType: "text", T.BinaryType: "blob"}.get(type(t))


def literal_fits(value, kind: str | None) -> bool:
    """Whether a column of the logical type may be compared with the literal; null fits everywhere."""
    if value is None or kind is None:
        return True
    if isinstance(value, bool):
        return kind == "boolean"
    if isinstance(value, int):
        return kind in INTEGRAL or kind in ("float", "u256", "i256")
    if isinstance(value, float):
        return kind in INTEGRAL or kind == "float"
    if isinstance(value, str):
        return kind in ("text", "json", "timestamp")
    if isinstance(value, (bytes, bytearray)):
        return kind in ("blob", "u256", "i256")
    return kind == "timestamp"


def check_value(column: Column, value):
    """A value for storage, or TypeMismatch. No coercion between kinds; floats must be finite."""
    if value is None:
        if not column.nullable:
            raise TypeMismatch(f"{column.name} is not nullable")
        return None
    kind, bad = column.type, TypeMismatch(f"{column.name}: {value!r} is no {column.type}")
    if kind == "boolean":
        if not isinstance(value, bool):
            raise bad
    elif kind in _LIMITS:
        lo, hi = _LIMITS[kind]
        if isinstance(value, bool) or not isinstance(value, int) or not lo <= value <= hi:
            raise bad
    elif kind == "float":
        if not isinstance(value, float) or not math.isfinite(value):
            raise bad
    elif kind in ("text", "json"):
        if not isinstance(value, str):
            raise bad
    elif kind in ("u256", "i256"):
        if not isinstance(value, (bytes, bytearray)) or len(value) != 32:
            raise bad
    elif not isinstance(value, (bytes, bytearray)):
        raise bad
    return value
