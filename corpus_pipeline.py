"""Corpus pipeline: reject toxic documents, keep one of each near-duplicate group, drop benchmark leaks, pack the rest.

Every stage takes (spark, docs, sf_dir) and works on all its predecessor kept; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet in the shared folder and reads it again for the next.

Near duplicates take five-word shingles at a Jaccard similarity of 0.8 or more; benchmark leaks five-word shingles at a
weighted overlap of 0.8 or more. Rows without an id are kept by the second stage (they are linked with nothing); the
other stages judge rows by their text alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablemirror.llm import decontaminate, minhash, packing, toxicity
from tablemirror.llm.common import fresh
from tablemirror.operators.joins import lookup
from tablemirror.plans.registry import table
from tablemirror.session import written

TOXIC = 0.7


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.7 (a null or empty text is scored as empty), with all their columns;
    repeated rows are judged alike, columns of any name pass unchanged, an empty table gives an empty table."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score, evidence = fresh(docs, "_toxic_score"), fresh(docs, "_toxic_evidence")
    judged = toxicity.with_toxicity(docs, model, "text", score, evidence)
    return judged.filter(F.col(f"`{score}`") < TOXIC).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard 0.8): the smallest doc_id. Rows without an
    id or without words are linked with nothing and kept; rows of one id go or stay together."""
    found = minhash.near_duplicates(docs, size=5, percent=80)
    return lookup(docs, found.filter("NOT kept").select("doc_id").distinct(), ["doc_id"], how="left_anti").select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item (five-word shingles, weighted overlap 0.8), judged by their text
    alone: equal texts go or stay together; a null text has no passage; columns of any name pass unchanged."""
    key = fresh(docs, "_row_key")
    keyed = docs.withColumn(key, F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.coalesce("text", F.lit("")))))
    leaks = decontaminate.contamination(keyed.select(key, "text"), table(spark, sf_dir, "benchmark"), key=key)
    return lookup(keyed, leaks.select(key).distinct(), [key], how="left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens of every document kept, packed by best fit (see ``packing.pack``)."""
    return packing.pack(docs)


STAGES = [("toxicity", reject_toxic), ("near_duplicates", keep_one_of_each), ("decontamination", drop_leaks),
          ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
