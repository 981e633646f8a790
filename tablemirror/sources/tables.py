"""Reading and writing tables, pairs, metadata and scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablemirror.operators.stats import align_tables
from tablemirror.schema import CATEGORICAL, NUMERICAL, ORDINAL, TableMeta, TablePair, kinds_from_types


def read_csv(spark: SparkSession, path: str, sep: str = ",", header: bool = True, schema: T.StructType | None = None,
             discrete: Sequence[str | int] | None = None, meta: TableMeta | None = None) -> tuple[DataFrame, list[str]]:
    """The table and its discrete columns; a file without header gets the positions as names.

    Give a schema for large files: inferring one reads them twice.
    """
    reader = spark.read.option("sep", sep).option("header", header)
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    if not header and schema is None:
        df = df.toDF(*[str(i) for i in range(len(df.columns))])
    kinds = kinds_from_types(df, discrete, meta)
    return df, [c for c, k in kinds.items() if k != NUMERICAL]


def read_text(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return spark.read.json(path, schema=schema)


# ---------------------------------------------------------------- whitespace separated text with a column spec

def read_spec(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """Column lines ``C low high`` or ``D value...`` (braces ignored), in order; one line per column."""
    lines = spark.read.text(path, wholetext=True).first()["value"].splitlines()
    spec = []
    for line in lines:
        parts = line.replace("{", " ").replace("}", " ").split()
        if not parts:
            continue
        if parts[0] not in ("C", "D"):
            raise ValueError(f"column line must start with C or D: {line!r}")
        spec.append((parts[0], parts[1:]))
    return spec


def spec_meta(spec: Sequence[tuple[str, list[str]]]) -> TableMeta:
    kinds = {str(i): NUMERICAL if k == "C" else CATEGORICAL for i, (k, _) in enumerate(spec)}
    return TableMeta(kinds, {str(i): v for i, (k, v) in enumerate(spec) if k == "D"})


def read_spec_table(spark: SparkSession, path: str, spec: Sequence[tuple[str, list[str]]]) -> DataFrame:
    """Columns ``0, 1, ...``: numbers as double, discrete values as their position in the spec.

    An unknown discrete value raises when the column is read.
    """
    cells = F.split(F.trim("value"), "\\s+")
    out = []
    for i, (kind, values) in enumerate(spec):
        cell = F.element_at(cells, i + 1)
        if kind == "C":
            out.append(cell.cast("double").alias(str(i)))
        else:
            at = F.array_position(F.array(*[F.lit(v) for v in values]), cell)
            wrong = F.raise_error(F.concat(F.lit(f"column {i}: unknown value "), cell))
            out.append(F.when(at > 0, (at - 1).cast("double")).otherwise(wrong.cast("double")).alias(str(i)))
    return spark.read.text(path).filter(F.trim("value") != "").select(*out)


def write_spec_table(df: DataFrame, spec: Sequence[tuple[str, list[str]]], path: str) -> None:
    """Numbers as they are, discrete codes as their value, separated by blanks."""
    cells = []
    for name, (kind, values) in zip(df.columns, spec):
        cells.append(F.col(name).cast("string") if kind == "C"
                     else F.element_at(F.array(*[F.lit(v) for v in values]), F.col(name).cast("int") + 1))
    df.select(F.concat_ws(" ", *cells).alias("value")).write.mode("overwrite").text(path)


# ---------------------------------------------------------------- metadata

def read_metadata(spark: SparkSession, path: str) -> TableMeta:
    """A JSON document with ``columns`` (name, type, min/max or size/i2s), ``problem_type``, ``label``."""
    df = spark.read.json(path, multiLine=True)
    entries = metadata_columns(df).collect()        # one row per column
    top = df.select(*[c for c in ("problem_type", "label") if c in df.columns]).first()
    kinds = {e["name"]: NUMERICAL if e["kind"] == "continuous" else e["kind"] for e in entries}
    vocabularies = {e["name"]: list(e["i2s"]) for e in entries if e["i2s"] is not None}
    extra = top.asDict() if top is not None else {}
    return TableMeta(kinds, vocabularies, extra.get("label"), extra.get("problem_type"))


def metadata_columns(document: DataFrame) -> DataFrame:
    """``name, kind, min, max, size, i2s``: one row per column of a metadata document."""
    names = document.schema["columns"].dataType.elementType.fieldNames()
    cells = document.select(F.inline("columns"))
    def field(name: str, dtype: str):
        return (F.col(name).cast(dtype) if name in names else F.lit(None).cast(dtype)).alias(name)
    return cells.select("name", F.col("type").alias("kind"), field("min", "double"), field("max", "double"),
                        field("size", "int"), field("i2s", "array<string>"))


def metadata_table(spark: SparkSession, meta: TableMeta) -> DataFrame:
    rows = [(i, n, k, list(meta.vocabularies[n]) if n in meta.vocabularies else None, meta.label == n, meta.problem_type)
            for i, (n, k) in enumerate(meta.kinds.items())]
    return spark.createDataFrame(rows, "position int, name string, kind string, i2s array<string>, is_label boolean, problem_type string")


def meta_from_table(df: DataFrame) -> TableMeta:
    rows = df.orderBy("position").collect()         # one row per column
    label = next((r["name"] for r in rows if r["is_label"]), None)
    return TableMeta({r["name"]: r["kind"] for r in rows}, {r["name"]: r["i2s"] for r in rows if r["i2s"] is not None},
                     label, rows[0]["problem_type"] if rows else None)


# ---------------------------------------------------------------- pairs

def write_pair(pair_by_split: Mapping[str, TablePair], path: str) -> None:
    """Real and fake rows of every split in one Parquet table by ``origin`` and ``split``, and the metadata."""
    out, meta = None, None
    for name, pair in pair_by_split.items():
        meta = pair.meta
        for origin, df in (("real", pair.real), ("fake", pair.fake)):
            tagged = df.select(*meta.columns).withColumns({"origin": F.lit(origin), "split": F.lit(name)})
            out = tagged if out is None else out.unionByName(tagged)
    out.write.mode("overwrite").partitionBy("origin", "split").parquet(f"{path}/rows")
    metadata_table(out.sparkSession, meta).coalesce(1).write.mode("overwrite").parquet(f"{path}/metadata")


def read_pair(spark: SparkSession, path: str, split: str = "train") -> TablePair:
    """One split of a written pair; the other partitions are not read."""
    meta = meta_from_table(spark.read.parquet(f"{path}/metadata"))
    rows = spark.read.parquet(f"{path}/rows").filter(F.col("split") == split)
    return TablePair(rows.filter(F.col("origin") == "real").select(*meta.columns),
                     rows.filter(F.col("origin") == "fake").select(*meta.columns), meta)


def read_splits(spark: SparkSession, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    """A train and a test table from two Parquet paths."""
    return spark.read.parquet(train), spark.read.parquet(test)


def pair_from_frames(real: DataFrame, fake: DataFrame, meta: TableMeta | None = None) -> TablePair:
    """A pair of tables that exist already; kinds by type if no metadata is given."""
    return TablePair(real, fake, meta or TableMeta(kinds_from_types(real)))


def read_csv_pair(spark: SparkSession, real: str, fake: str, real_sep: str = ",", fake_sep: str = ",",
                  drop: Sequence[str] | None = None) -> TablePair:
    """Two CSV files brought to the same columns and types."""
    a, _ = read_csv(spark, real, real_sep)
    b, _ = read_csv(spark, fake, fake_sep)
    return pair_from_frames(*align_tables(a, b, drop))


def typed_output(df: DataFrame, meta: TableMeta) -> DataFrame:
    """Generated rows for people: numericals truncated to int, codes replaced by their category."""
    out = []
    for name, kind in meta.kinds.items():
        if kind == NUMERICAL:
            out.append(F.col(name).cast("double").cast("int").alias(name))
        elif name in meta.vocabularies:
            values = F.array(*[F.lit(str(v)) for v in meta.vocabularies[name]])
            out.append(F.element_at(values, F.col(name).cast("int") + 1).alias(name))
        else:
            out.append(F.col(name).cast("string").alias(name))
    return df.select(*out)


def write_csv(df: DataFrame, folder: str, dataset: str, synthesizer: str, config: str, iteration: int) -> str:
    """Write a generated table; the name tells dataset, synthesizer, configuration and iteration."""
    path = f"{folder}/{dataset}-{synthesizer.lower()}-{config}-{iteration}"
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


# ---------------------------------------------------------------- scores

def read_scores(spark: SparkSession, folder: str, schema: T.StructType | None = None) -> DataFrame:
    """All score files of a folder, matched by column name; a column that a file lacks is null. ``version`` is the file
    name without ``.csv``. One row per file (its header) reaches the driver: files of one header are read together."""
    lines = spark.read.text(folder).select("value", F.col("_metadata.file_path").alias("path"),
                                           F.monotonically_increasing_id().alias("at"))
    files: dict[str, list[str]] = {}
    for r in lines.groupBy("path").agg(F.min_by("value", "at").alias("header")).orderBy("path").collect():
        files.setdefault(r["header"], []).append(r["path"])
    df = None
    for paths in files.values() or [[folder]]:
        one = _scores(spark, paths, schema)
        df = one if df is None else df.unionByName(one, allowMissingColumns=True)
    return df


def _scores(spark: SparkSession, paths: list[str], schema: T.StructType | None) -> DataFrame:
    df = spark.read.option("header", True).option("inferSchema", schema is None).csv(paths)
    if schema is not None:
        df = df.select(*[(F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                         for f in schema.fields], "_metadata")
    return df.withColumn("version", F.regexp_replace(F.col("_metadata.file_name"), "\\.csv$", ""))


def write_leaderboard(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


SOURCES = {"csv": read_csv, "tsv": read_spec_table, "json": read_json, "text": read_text, "numpy": read_splits,
           "fake": pair_from_frames}

__all__ = [*(f.__name__ for f in SOURCES.values()), "CATEGORICAL", "ORDINAL", "SOURCES"]
