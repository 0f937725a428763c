"""Scalar expressions on columns: truncation, merges of maps, reproducible uniforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def truncate_at(n: Column, digits: int) -> Column:
    """Largest multiple of ``10**-digits`` not above ``n``."""
    scale = float(10**digits)
    return F.floor(n * F.lit(scale)) / F.lit(scale)


def _merge(a: Column, b: Column, both) -> Column:
    """Merge maps by key.  Keys of ``a`` alone pass through; keys of ``b`` alone fall away."""
    merged = F.map_zip_with(a, b, lambda k, x, y: F.when(x.isNull() | y.isNull(), x).otherwise(both(x, y)))
    return F.map_filter(merged, lambda k, v: F.map_contains_key(a, k))


def add_maps(a: Column, b: Column) -> Column:
    return _merge(a, b, lambda x, y: x + y)


def divide_maps(a: Column, b: Column) -> Column:
    """Values of ``b`` divided by those of ``a``."""
    return _merge(a, b, lambda x, y: y / x)


def multiply_maps(a: Column, b: Column) -> Column:
    return _merge(a, b, lambda x, y: x * y)


def concat_array_maps(a: Column, b: Column) -> Column:
    """Merge maps of arrays; arrays of one key are joined."""
    empty = F.array()
    return F.map_zip_with(a, b, lambda k, x, y: F.concat(F.coalesce(x, empty), F.coalesce(y, empty)))


def hash_uniform(number: Column, seed: int = 0) -> Column:
    """A reproducible value in [0, 1) of a whole number and a seed: the first 48 bits of an MD5 digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), number.cast("string")))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))
