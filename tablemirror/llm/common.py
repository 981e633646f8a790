"""Small parts that several operators share."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORDS, BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Bytes of ASCII that stand between words, once A-Z are lower-cased.
PUNCTUATION = bytes(b for b in range(128) if not (48 <= b <= 57 or 97 <= b <= 122))
WORD_BYTES = bytes.maketrans(UPPER.encode() + bytes(b for b in PUNCTUATION if not 65 <= b <= 90),
                             LOWER.encode() + b" " * (len(PUNCTUATION) - 26))


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, everything else unchanged; null becomes the empty text."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def plain_words(text: str | None) -> list[bytes]:
    """Runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(WORD_BYTES).split()


def space_words(text: str | None) -> list[bytes]:
    """Runs without ASCII white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").lower().split()


def doc_remainder(key: Column, divisor: int) -> Column:
    """crc32 of the key as text, modulo ``divisor``; -1 for a null key."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % F.lit(divisor), F.lit(-1))


def bounded_batches(spark: SparkSession) -> None:
    """Texts can be long: batches that go to Python get small bounds, unless the session has set its own."""
    for name, default, bound in ((RECORDS, "10000", "2000"), (BYTES, "67108864b", "16m")):
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, bound)


def framed(rows: Iterable, names: list[str]) -> pd.DataFrame:
    """Rows for Spark with plain Python values, so that pandas guesses no types and no nulls."""
    return pd.DataFrame(list(rows), columns=names, dtype=object)


def only(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns under the operator's own names; whatever else the table holds stays outside."""
    bounded_batches(df.sparkSession)
    return df.select(*[F.col(f"`{source}`").alias(name) for name, source in columns.items()])


def fresh(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have: ``base``, else ``base`` with the first free number."""
    taken, name, n = set(df.columns), base, 0
    while name in taken:
        n += 1
        name = f"{base}{n}"
    return name
