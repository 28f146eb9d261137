"""Key encodings whose byte order is the order that a table promises, and helpers on keys."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


def prefix_end(prefix: bytes) -> bytes | None:
    """The least key above every key that begins with ``prefix``; None if there is none."""
    trimmed = prefix.rstrip(b"\xff")
    return trimmed[:-1] + bytes([trimmed[-1] + 1]) if trimmed else None


def separator(low: bytes, high: bytes) -> bytes:
    """A short key k with low <= k < high, given low < high."""
    for i, (a, b) in enumerate(zip(low, high, strict=False)):
        if a != b:
            return low[:i] + bytes([a + 1]) if a + 1 < b else low
    return low


def printable(key: bytes) -> str:
    """Text of a key for reports; other bytes as \\xHH."""
    return "".join(chr(b) if 0x20 <= b < 0x7F and b != 0x5C else f"\\x{b:02x}" for b in key)


@dataclass(frozen=True)
class KeyOrder:
    """A named order: ``column`` and ``encode`` map keys to bytes whose unsigned order is the order.

    Two keys are the same key if their encodings are equal.
    """

    name: str
    column: Callable[[Column], Column]
    encode: Callable[[bytes], bytes]


def _reverse_column(key: Column) -> Column:
    # byte by byte complement with an end mark above every complement, so that a prefix comes after its extensions
    digits = F.translate(F.hex(key), "0123456789ABCDEF", "FEDCBA9876543210")
    pairs = F.regexp_replace(digits, "(..)", "00$1")
    return F.unhex(F.concat(pairs, F.lit("FF")))


def _reverse_bytes(key: bytes) -> bytes:
    return b"".join(bytes([0, 255 - b]) for b in key) + b"\xff"


BYTEWISE = KeyOrder("bytewise", lambda k: k, lambda k: k)
REVERSE = KeyOrder("reverse-bytewise", _reverse_column, _reverse_bytes)
CASELESS = KeyOrder(
    "ascii-caseless",
    lambda k: F.encode(F.translate(F.decode(k, "ISO-8859-1"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "ISO-8859-1"),
    lambda k: bytes(b + 32 if 65 <= b <= 90 else b for b in k),
)
ORDERS = {o.name: o for o in (BYTEWISE, REVERSE, CASELESS)}


def numeric_key(number: Column, width: int = 16) -> Column:
    """Zero-padded decimal text, whose byte order is the numeric order for non-negative numbers of up to ``width`` digits."""
    return F.lpad(number.cast("string"), width, "0")
