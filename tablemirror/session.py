"""Reliable lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


WORTH_SPREADING = 50_000     # rows


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared checkpoint folder and drop its lineage."""
    settle_folder(df)
    return df.checkpoint(eager=True)


def cut_counted(df: DataFrame) -> tuple[DataFrame, int]:
    """``cut``, and the number of rows (counted on the written copy)."""
    done = cut(df)
    return done, done.count()


def spread(df: DataFrame, task_rows: int = WORTH_SPREADING) -> DataFrame:
    """``cut`` for compute-heavy rereading: dealt by hash over partitions of ``task_rows`` rows, so that how rows lie
    (which seeded fits depend on) follows from the rows alone, not from cores or files."""
    done, rows = cut_counted(df)
    return cut(done.repartition(max(1, -(-rows // task_rows)), F.xxhash64(*[F.col(f"`{c}`") for c in hashable(done)])))


def hashable(df: DataFrame) -> list[str]:
    """Columns that a hash can take (vectors cannot be hashed)."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.UserDefinedType)]


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: later readers take only the columns they need."""
    settle_folder(df)
    spark = df.sparkSession
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove the files of tables from ``written`` that nothing reads any more, and let the shuffles behind them go: Spark
    removes a shuffle's files once the driver has collected what refers to it."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        folder = f"{sc.getCheckpointDir()}/table-"
        for path in {name.rsplit("/", 1)[0] for name in df.inputFiles()}:
            if "/table-" in path and path.split(":", 1)[-1].lstrip("/").startswith(folder.split(":", 1)[-1].lstrip("/")):
                where = sc._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(sc._jsc.hadoopConfiguration()).delete(where, True)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def settle_folder(df: DataFrame) -> None:
    """The folder is the one the session names in ``spark.checkpoint.dir``. Only a local-mode session
    without the setting gets a folder of its own."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
            folder = tempfile.mkdtemp(prefix="tablemirror-")
        sc.setCheckpointDir(folder)
