"""Trigrams: the 3-byte windows of UTF-8 text, as integers with the first byte highest."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(a: int, b: int, c: int) -> int:
    return a << 16 | b << 8 | c


def unpack(trigram: int) -> tuple[int, int, int]:
    return trigram >> 16 & 255, trigram >> 8 & 255, trigram & 255


def shown(trigram: int) -> str:
    """Printable ASCII as it is, other bytes as \\xNN."""
    return "".join(chr(b) if 32 <= b < 127 else f"\\x{b:02x}" for b in unpack(trigram))


def extract(data: bytes) -> list[int]:
    return [pack(*data[k : k + 3]) for k in range(len(data) - 2)]


def extract_unique(data: bytes) -> list[int]:
    return list(dict.fromkeys(extract(data)))


def hex_of(trigram: int) -> str:
    return f"{trigram:06X}"
