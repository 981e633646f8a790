"""Deterministic randomness: a keyed hash instead of a generator.

The same (seed, stream, key) gives the same number in every run, on every partitioning and after
every task retry, so samples and splits can be recomputed and checked in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def key_hash(seed: int, stream: str, *key: Column | str) -> Column:
    """32 hexadecimal digits of md5 over ``seed|stream|key...``, each key part with its length before it, so that
    different keys never spell the same text; a null part is ``-``."""
    texts = [(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(stream), *parts))


def hash_uniform(hashed: Column) -> Column:
    """The first 52 bits of a key hash as a number in [0, 1): all that a double holds exactly."""
    return F.conv(F.substring(hashed, 1, 13), 16, 10).cast("bigint") / F.lit(4503599627370496.0)


def uniform(seed: int, stream: str, *key: Column | str) -> Column:
    return hash_uniform(key_hash(seed, stream, *key))
