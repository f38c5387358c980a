"""Seeds and ids from SHA-256, equal to the byte-wise definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex(parts: list[Column], sep: str) -> Column:
    return F.sha2(F.concat_ws(sep, *[p.cast("string") for p in parts]).cast("binary"), 256)


def seed_be4(*parts: Column) -> Column:
    """First four bytes, big-endian, of parts joined by '|'."""
    return F.conv(F.substring(_hex(list(parts), "|"), 1, 8), 16, 10).cast("long")


def seed_hex16(*parts: Column) -> Column:
    """First 16 hex digits modulo 2**32 - 1, of parts joined by '||'."""
    return (F.conv(F.substring(_hex(list(parts), "||"), 1, 16), 16, 10).cast("decimal(20,0)") % F.lit(4294967295).cast("decimal(20,0)")).cast("long")


def seed_le8(text: Column, modulo: int | None = None) -> Column:
    """First eight bytes, little-endian, of one text; modulo where one is given."""
    digits = F.sha2(text.cast("binary"), 256)
    flipped = F.array_join(F.reverse(F.transform(F.sequence(F.lit(1), F.lit(15), F.lit(2)), lambda i: F.substring(digits, i, F.lit(2)))), "")
    value = F.conv(flipped, 16, 10).cast("decimal(20,0)")
    return (value % F.lit(modulo).cast("decimal(20,0)")).cast("long") if modulo else value


def stable_id(*parts: Column) -> Column:
    """24 hex digits of parts joined by '||'."""
    return F.substring(_hex(list(parts), "||"), 1, 24)


def selection_digest(c: Column) -> Column:
    """Aggregate: SHA-256 of the sorted values, one a line."""
    return F.sha2(F.array_join(F.array_sort(F.collect_list(c.cast("string"))), "\n").cast("binary"), 256)
