"""Seeded picks as pure functions of a key, the same in any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pick(key: Column, seed: int, n: int | Column) -> Column:
    """A number in [0, n) from md5(key-seed); null where the key is null or n isn't positive."""
    n = F.lit(n) if isinstance(n, int) else n
    h = F.conv(F.substring(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}"))), 1, 8), 16, 10).cast("bigint")
    return F.when(n > 0, F.pmod(h, n.cast("bigint"))).cast("int")


def pick_from(items: Column, key: Column, seed: int) -> Column:
    """The element of an array that ``pick`` names; null for an empty array."""
    return F.get(items, pick(key, seed, F.size(items)))


def hash_order(items: Column, key: Column, seed: int) -> Column:
    """An array's elements in an order that depends on key and seed only; equal elements keep their order."""
    tagged = F.transform(items, lambda x, i: F.struct(F.md5(F.concat(key.cast("string"), F.lit(f"-{seed}-"), i.cast("string"))).alias("h"), i.alias("i"), x.alias("x")))
    return F.transform(F.array_sort(tagged), lambda s: s["x"])
