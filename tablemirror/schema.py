"""Column kinds and the two small containers every operator works with."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERICAL = "numerical"
CATEGORICAL = "categorical"
ORDINAL = "ordinal"
KINDS = (NUMERICAL, CATEGORICAL, ORDINAL)


@dataclass(frozen=True)
class TableMeta:
    """Kind of every column in table order, with optional fixed vocabularies."""

    kinds: Mapping[str, str]
    vocabularies: Mapping[str, Sequence[str]] = field(default_factory=dict)
    label: str | None = None
    problem_type: str | None = None

    def __post_init__(self):
        unknown = set(self.kinds.values()) - set(KINDS)
        if unknown:
            raise ValueError(f"unknown column kinds: {sorted(unknown)}")

    @property
    def columns(self) -> list[str]:
        return list(self.kinds)

    def of_kind(self, *kinds: str) -> list[str]:
        return [name for name, kind in self.kinds.items() if kind in kinds]

    @property
    def numericals(self) -> list[str]:
        return self.of_kind(NUMERICAL)

    @property
    def discretes(self) -> list[str]:
        return self.of_kind(CATEGORICAL, ORDINAL)

    def positions(self, kind: str) -> list[int]:
        """Positions of the columns of one kind."""
        return [i for i, k in enumerate(self.kinds.values()) if k == kind]

    def without(self, *names: str) -> TableMeta:
        kinds = {n: k for n, k in self.kinds.items() if n not in names}
        vocabularies = {n: v for n, v in self.vocabularies.items() if n not in names}
        label = None if self.label in names else self.label
        return TableMeta(kinds, vocabularies, label, self.problem_type)


@dataclass(frozen=True)
class TablePair:
    """A real table, a fake table of the same columns, and their metadata (all lazy)."""

    real: DataFrame
    fake: DataFrame
    meta: TableMeta

    def stacked(self) -> DataFrame:
        """Both tables with an ``origin`` column (real, fake), for plans that treat them in one go."""
        real = self.real.select(F.lit("real").alias("origin"), *self.meta.columns)
        return real.unionByName(self.fake.select(F.lit("fake").alias("origin"), *self.meta.columns))

    def select(self, *names: str) -> TablePair:
        drop = [n for n in self.meta.columns if n not in names]
        return TablePair(self.real.select(*names), self.fake.select(*names), self.meta.without(*drop))


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.NumericType)


def kinds_from_types(df: DataFrame, discrete: Sequence[str | int] | None = None,
                     meta: TableMeta | None = None) -> dict[str, str]:
    """Kinds by the given metadata, else by an explicit list (names or positions), else by type."""
    if meta is not None:
        return {c: meta.kinds[c] for c in df.columns}
    if discrete is not None:
        chosen = {df.columns[d] if isinstance(d, int) else d for d in discrete}
        return {c: CATEGORICAL if c in chosen else NUMERICAL for c in df.columns}
    return {f.name: NUMERICAL if is_numeric(f.dataType) else CATEGORICAL for f in df.schema.fields}
