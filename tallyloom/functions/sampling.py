"""Seeded, engine-independent pseudo randomness: md5 of a key as a uniform number in [0, 1]."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_text(*keys, seed: str = "") -> Column:
    parts = [F.lit(seed)] + [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))


def hash_int(*keys, seed: str = "") -> Column:
    """First 32 bits of the md5 as BIGINT."""
    return F.conv(F.substring(hash_text(*keys, seed=seed), 1, 8), 16, 10).cast("bigint")


def uniform(*keys, seed: str = "") -> Column:
    return hash_int(*keys, seed=seed) / F.lit(4294967295.0)
