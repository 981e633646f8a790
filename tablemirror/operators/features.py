"""Feature making for the model grids, fitted once on the real table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablemirror.operators.profile import fitted_vocabularies
from tablemirror.schema import CATEGORICAL, NUMERICAL, TableMeta

LOG_FROM = 1e3       # non-negative numericals reaching this far are taken as logarithms
LOG_FLOOR = 1e-2
SPAN = 5.0           # others are scaled to [0, SPAN]


@dataclass(frozen=True)
class FeatureMaker:
    meta: TableMeta
    ranges: dict[str, tuple[float, float]]
    vocabularies: dict[str, list[str]]
    label_values: list[str] | None
    means: dict[str, float]

    @classmethod
    def fit(cls, real: DataFrame, meta: TableMeta, classes: bool = True) -> FeatureMaker:
        inputs = meta.without(meta.label) if meta.label else meta
        ranges, means = {}, {}
        if inputs.numericals:
            row = real.agg(*[a for i, c in enumerate(inputs.numericals) for a in (
                F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}"),
                F.avg(F.col(c).cast("double")).alias(f"mean{i}"))]).first()
            ranges = {c: (row[f"lo{i}"] or 0.0, row[f"hi{i}"] or 0.0) for i, c in enumerate(inputs.numericals)}
            means = {c: row[f"mean{i}"] or 0.0 for i, c in enumerate(inputs.numericals)}
        texts = list(inputs.discretes) + ([meta.label] if meta.label and classes else [])
        vocabularies = fitted_vocabularies(real, texts) if texts else {}
        labels = vocabularies.pop(meta.label) if meta.label and classes else None
        for name, values in meta.vocabularies.items():
            if name in vocabularies:
                vocabularies[name] = list(values)
        return cls(meta, ranges, vocabularies, labels, means)

    def _code(self, column: str, values: Sequence[str]) -> Column:
        at = F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column).cast("string"))
        return (at - 1).cast("double")

    def columns(self) -> dict[str, Column]:
        """Named feature expressions in table order."""
        out: dict[str, Column] = {}
        for name, kind in self.meta.kinds.items():
            if name == self.meta.label:
                continue
            x = F.coalesce(F.col(name).cast("double"), F.lit(self.means[name])) if kind == NUMERICAL else None
            if kind == NUMERICAL:
                lo, hi = self.ranges[name]
                if lo >= 0 and hi >= LOG_FROM:
                    out[name] = F.log(F.greatest(x, F.lit(LOG_FLOOR)))
                else:
                    out[name] = (x - F.lit(lo)) / F.lit((hi - lo) or 1.0) * F.lit(SPAN)
            elif kind == CATEGORICAL and len(self.vocabularies[name]) > 2:
                for v in self.vocabularies[name]:
                    out[f"{name}={v}"] = F.coalesce((F.col(name).cast("string") == v).cast("double"), F.lit(0.0))
            else:
                out[name] = F.coalesce(self._code(name, self.vocabularies[name]), F.lit(-1.0))
        return out

    def label(self) -> Column:
        """Class codes of the real table (a label it never has: -1, which no model predicts), or the number itself."""
        if self.label_values is None:
            return F.col(self.meta.label).cast("double")
        code = self._code(self.meta.label, self.label_values)
        return code

    def transform(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep..., features (vector), label``. Rows without a label are left out, no others: a missing number is the
        real table's mean, a missing or unseen ordinal value -1, a missing or unseen category no category."""
        named = {f"f{i}": c for i, c in enumerate(self.columns().values())}
        flat = df.select(*keep, *[c.alias(n) for n, c in named.items()], self.label().alias("label"))
        assembler = VectorAssembler(inputCols=list(named), outputCol="features", handleInvalid="error")
        return assembler.transform(flat).select(*keep, "features", "label").filter(F.col("label").isNotNull())

    def flat(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep..., <features as columns>, label``."""
        return df.select(*keep, *[c.alias(n) for n, c in self.columns().items()], self.label().alias("label"))
