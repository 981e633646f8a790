"""Queries of the operators over the whole test tables; the digest columns come from the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablemirror.llm import (collocations, decontaminate, divergence, hmm, html_text, licenses, minhash, packing, token_counts, topk,
                             toxicity, urls, warc)
from tablemirror.plans.registry import scratch, table

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def llm_query(name: str, sql: str | None = None):
    def add(fn):
        LLM_QUERIES[name] = fn
        if sql is not None:
            LLM_ORACLES[name] = sql
        return fn
    return add


@llm_query("op1_license_scan", licenses.brute_force_sql())
def op1(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


@llm_query("op2_html_extraction")
def op2(spark, folder):
    return html_text.extract_main_text(table(spark, folder, "pages"))


@llm_query("op4_exact_top_k", """
    WITH v AS (SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS e FROM embeddings
               WHERE vec_id IS NOT NULL AND len(embedding) > 0
                 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.vec_id AS query_id, v.vec_id, list_sum([q.e[i] * v.e[i] FOR i IN range(1, len(q.e) + 1)])::BIGINT AS score
          FROM v AS q, v WHERE q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""")
def op4(spark, folder):
    return topk.top_k(table(spark, folder, "embeddings"))


@llm_query("op5_url_filter")
def op5(spark, folder):
    return urls.url_filter(table(spark, folder, "pages"))


@llm_query("op9_warc_normaliser", """
    WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
               FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY 1 HAVING count(*) > 1)
    SELECT page_id, payload_bytes, payload_digest,
           CASE WHEN page_id IS DISTINCT FROM first AND first IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)""")
def op9(spark, folder):
    return warc.warc_round_trip(table(spark, folder, "pages"), scratch(spark, "warc"))


@llm_query("op6_minhash_dedup")
def op6(spark, folder):
    return minhash.near_duplicates(table(spark, folder, "documents"))


@llm_query("op3_best_fit_packing")
def op3(spark, folder):
    return packing.pack(table(spark, folder, "documents"))


@llm_query("op7_benchmark_decontamination")
def op7(spark, folder):
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@llm_query("op8_toxicity")
def op8(spark, folder):
    return toxicity.toxicity(table(spark, folder, "documents"), table(spark, folder, "labels"))


@llm_query("op10_lm_scoring")
def op10(spark, folder):
    return hmm.score_texts(table(spark, folder, "documents"))


@llm_query("op11_source_divergence", divergence.brute_force_sql())
def op11(spark, folder):
    return divergence.audit(table(spark, folder, "documents"))


@llm_query("op12_token_counts")
def op12(spark, folder):
    return token_counts.count_tokens(table(spark, folder, "documents"))


@llm_query("op13_phrase_collocations", collocations.brute_force_sql())
def op13(spark, folder):
    return collocations.collocations(table(spark, folder, "documents"))
