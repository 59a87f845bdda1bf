"""256-bit integers as 32 bytes whose binary order is numeric order, and their sums."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairn.plans.errors import Overflow, Underflow

MAX_U256 = (1 << 256) - 1


def u256(value: int) -> bytes:
    if value < 0:
        raise Underflow(f"{value} < 0")
    if value > MAX_U256:
        raise Overflow("over 256 bits")
    return value.to_bytes(32, "big")


def i256(value: int) -> bytes:
    if not -(1 << 255) <= value < 1 << 255:
        raise Overflow("over 256 bits")
    return (value + (1 << 255)).to_bytes(32, "big")


def from_u256(data: bytes) -> int:
    return int.from_bytes(data, "big")


def from_i256(data: bytes) -> int:
    return int.from_bytes(data, "big") - (1 << 255)


def limb_sums(c: Column) -> list[Column]:
    """Eight partial sums of 32-bit limbs, most significant first; each stays in a long for under 2^31 rows."""
    return [F.sum(F.conv(F.hex(F.substring(c, 1 + 4 * i, 4)), 16, 10).cast("long")).alias(f"limb{i}") for i in range(8)]


def from_limbs(sums) -> int:
    total = sum(int(s or 0) << (32 * (7 - i)) for i, s in enumerate(sums))
    if total > MAX_U256:
        raise Overflow("sum over 256 bits")
    return total
