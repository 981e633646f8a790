"""tablemirror: profile, encode, sample and compare real and synthetic tables with Spark."""

from tablemirror.schema import CATEGORICAL, NUMERICAL, ORDINAL, TableMeta, TablePair

__all__ = ["CATEGORICAL", "NUMERICAL", "ORDINAL", "TableMeta", "TablePair"]
