"""Order-preserving key encodings and the size model, as Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import StoreConfig


def big_endian(c: Column) -> Column:
    """A signed 64-bit number as 8 bytes whose unsigned byte order is the number's order."""
    flipped = c.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def padded(c: Column, width: int = 8) -> Column:
    """A non-negative number as decimal text that sorts like the number."""
    return F.lpad(c.cast("string"), width, "0")


def entry_bytes(key: Column, value: Column, is_tombstone: Column, config: StoreConfig = StoreConfig()) -> Column:
    """Size of a memtable entry: key, value and overhead of a put; key and overhead of a delete."""
    put = F.coalesce(F.octet_length(value), F.lit(0)) + F.lit(config.put_overhead)
    return (F.octet_length(key) + F.when(is_tombstone, F.lit(config.delete_overhead)).otherwise(put)).cast("long")
