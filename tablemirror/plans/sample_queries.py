"""Sampling, splitting and synthesis."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablemirror.operators import sample, synth
from tablemirror.operators.joins import distinct_counts
from tablemirror.plans.fixtures import EVENTS, ORDERS, h_sql, long_sql, sides, sides_sql, u_sql
from tablemirror.plans.registry import query, rounded, table
from tablemirror.schema import TableMeta, TablePair

NET = {"l_linestatus": [], "l_returnflag": ["l_linestatus"], "l_linenumber": ["l_returnflag"]}
ORDER_COLUMNS = ["o_orderstatus", "o_orderpriority"]


def _half(df):
    return df.count() // 2


@query("r1_sample_without_replacement", f"""
SELECT o_orderkey, o_totalprice FROM orders
QUALIFY row_number() OVER (ORDER BY {h_sql(3, 'sample', 'o_orderkey')}) <= (SELECT count(*) // 2 FROM orders)""")
def r1(spark, sf):
    df = table(spark, sf, "orders")
    return sample.exact_sample(df, _half(df), ["o_orderkey"], 3).select("o_orderkey", "o_totalprice")


@query("r1_equal_length", f"""
WITH {sides_sql('events')}, sizes AS (SELECT least((SELECT count(*) FROM rl), (SELECT count(*) FROM fk)) AS n),
stacked AS (SELECT 'real' AS origin, event_id, value FROM rl UNION ALL SELECT 'fake', event_id, value FROM fk)
SELECT origin, event_id, value FROM stacked
QUALIFY row_number() OVER (PARTITION BY origin ORDER BY {h_sql(3, 'equal', 'event_id')}) <= (SELECT n FROM sizes)""")
def r1_equal(spark, sf):
    real, fake = sides(spark, sf, "events")
    even = sample.equal_length(TablePair(real, fake, TableMeta({"event_id": "numerical", "value": "numerical"})), ["event_id"], 3)
    return even.real.withColumn("origin", F.lit("real")).unionByName(even.fake.withColumn("origin", F.lit("fake")))


INDEXED = "SELECT *, row_number() OVER (ORDER BY {h}) - 1 AS idx FROM {t}"


@query("r2_sample_with_replacement", f"""
WITH ix AS ({INDEXED.format(h=h_sql(3, 'index', 'o_orderkey'), t='orders')}),
draws AS (SELECT range AS draw, CAST(floor({u_sql(3, 'bootstrap', 'range')} * (SELECT count(*) FROM orders)) AS BIGINT) AS idx
  FROM range((SELECT count(*) FROM orders)))
SELECT draw, o_orderkey, o_totalprice FROM draws JOIN ix USING (idx)""")
def r2(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return sample.sample_with_replacement(df, df.count(), ["o_orderkey"], 3)


CELLS = long_sql("orders", ORDER_COLUMNS, "VARCHAR", "o_orderkey, ")
CATEGORY_INDEX = f"""SELECT name, value, row_number() OVER (PARTITION BY name, value ORDER BY {h_sql(3, 'category', 'o_orderkey')}) - 1 AS idx, o_orderkey
FROM ({CELLS})"""


@query("r3_category_row_index", CATEGORY_INDEX)
def r3(spark, sf):
    return sample.category_row_index(table(spark, sf, "orders"), ORDER_COLUMNS, ["o_orderkey"], 3).select(
        "name", "value", "idx", "o_orderkey")


@query("r4_conditional_sample", f"""
WITH ix AS ({CATEGORY_INDEX}), sizes AS (SELECT name, value, count(*) AS cnt FROM ix GROUP BY ALL),
req AS (SELECT event_id AS request, CASE WHEN event_type IN ('click', 'view') THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS name,
  CASE WHEN event_type = 'click' THEN 'F' WHEN event_type = 'view' THEN 'P' ELSE '1-URGENT' END AS value FROM events)
SELECT request, name, value, o_orderkey FROM (
  SELECT request, name, value, CAST(floor({u_sql(3, 'condition', 'request')} * cnt) AS BIGINT) AS idx FROM req JOIN sizes USING (name, value))
JOIN ix USING (name, value, idx)""")
def r4(spark, sf):
    kind = F.col("event_type")
    requests = table(spark, sf, "events").select(
        F.col("event_id").alias("request"),
        F.when(kind.isin("click", "view"), "o_orderstatus").otherwise("o_orderpriority").alias("name"),
        F.when(kind == "click", "F").when(kind == "view", "P").otherwise("1-URGENT").alias("value"))
    return sample.conditional_sample(table(spark, sf, "orders"), requests, ORDER_COLUMNS, ["o_orderkey"], 3)


COUNTS = f"SELECT name, value, count(*) AS cnt FROM ({CELLS}) GROUP BY ALL"


def _pmf_sql(weight):
    return f"SELECT name, value, cnt, {weight} / sum({weight}) OVER (PARTITION BY name) AS p FROM ({COUNTS})"


@query("r5_category_pmf_log", f"SELECT name, value, cnt, round(p, 6) AS p FROM ({_pmf_sql('ln(cnt + 1)')})")
def r5(spark, sf):
    return rounded(sample.category_pmf(table(spark, sf, "orders"), ORDER_COLUMNS))


@query("r5_category_pmf_plain", f"SELECT name, value, cnt, round(p, 6) AS p FROM ({_pmf_sql('CAST(cnt AS DOUBLE)')})")
def r5_plain(spark, sf):
    return rounded(sample.category_pmf(table(spark, sf, "orders"), ORDER_COLUMNS, log_smoothing=False))


def _draws_sql(weight, columns="draw, column_id, name, category_id, value", extra=""):
    return f"""
WITH pmf AS ({_pmf_sql(weight)}),
cdf AS (SELECT name, value, row_number() OVER w - 1 AS category_id, coalesce(sum(p) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo,
  CASE WHEN lead(value) OVER w IS NULL THEN 2.0 ELSE sum(p) OVER (w ROWS UNBOUNDED PRECEDING) END AS hi FROM pmf WINDOW w AS (PARTITION BY name ORDER BY value)),
draws AS (SELECT range AS draw, CAST(floor({u_sql(3, 'column', 'range')} * 2) AS INTEGER) AS column_id, {u_sql(3, 'category', 'range')} AS u
  FROM range((SELECT count(*) FROM orders)))
SELECT {columns} FROM (SELECT draw, column_id, CASE column_id WHEN 0 THEN 'o_orderstatus' ELSE 'o_orderpriority' END AS name, u FROM draws)
JOIN cdf USING (name) WHERE u >= lo AND u < hi"""


VECTOR = ("draw, array_to_string([CASE WHEN i = category_id + CASE column_id WHEN 0 THEN 0 ELSE 3 END THEN '1.0' ELSE '0.0' END FOR i IN range(8)], ',') AS vector, "
          "array_to_string([CASE WHEN i = column_id THEN '1.0' ELSE '0.0' END FOR i IN range(2)], ',') AS mask")


@query("r6_balanced_conditions", _draws_sql("ln(cnt + 1)"))
def r6(spark, sf):
    df = table(spark, sf, "orders")
    return sample.condition_draws(df, ORDER_COLUMNS, df.count(), 3)


@query("r6_balanced_condition_vectors", _draws_sql("ln(cnt + 1)", VECTOR))
def r6_vectors(spark, sf):
    df = table(spark, sf, "orders")
    drawn = sample.condition_draws(df, ORDER_COLUMNS, df.count(), 3, vectors=True)
    return drawn.select("draw", F.array_join(F.col("vector").cast("array<string>"), ",").alias("vector"),
                        F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"))


@query("r7_empirical_conditions", _draws_sql("CAST(cnt AS DOUBLE)"))
def r7(spark, sf):
    df = table(spark, sf, "orders")
    return sample.condition_draws(df, ORDER_COLUMNS, df.count(), 3, log_smoothing=False)


@query("r8_fixed_condition", f"""
WITH ix AS ({INDEXED.format(h=h_sql(3, 'index', 'o_orderkey'), t="(SELECT * FROM orders WHERE o_orderstatus = 'P')")}),
draws AS (SELECT range AS draw, CAST(floor({u_sql(3, 'fixed', 'range')} * (SELECT count(*) FROM ix)) AS BIGINT) AS idx
  FROM range((SELECT count(*) FROM orders)))
SELECT draw, o_orderkey, o_orderstatus FROM draws JOIN ix USING (idx)""")
def r8(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    return sample.fixed_condition_sample(df, "o_orderstatus", "P", df.count(), ["o_orderkey"], 3)


def _uniform_sql():
    vocab = " , ".join(
        f"v_{c} AS (SELECT {c}, row_number() OVER (ORDER BY {c}) - 1 AS code FROM (SELECT DISTINCT {c} FROM orders))" for c in ORDER_COLUMNS)
    return f"""
WITH {vocab}, ends AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders),
d AS (SELECT range AS draw FROM range((SELECT count(*) FROM orders)))
SELECT draw, round(lo + {u_sql(3, 'uniform:o_totalprice', 'draw')} * (hi - lo), 4) AS o_totalprice, o_orderstatus, o_orderpriority
FROM d, ends
JOIN v_o_orderstatus s ON s.code = CAST(floor({u_sql(3, 'uniform:o_orderstatus', 'draw')} * (SELECT count(*) FROM v_o_orderstatus)) AS BIGINT)
JOIN v_o_orderpriority p ON p.code = CAST(floor({u_sql(3, 'uniform:o_orderpriority', 'draw')} * (SELECT count(*) FROM v_o_orderpriority)) AS BIGINT)"""


@query("r9_synthesize_uniform", _uniform_sql())
def r9_uniform(spark, sf):
    df = table(spark, sf, "orders")
    return rounded(synth.synthesize(df, ORDERS, df.count(), "uniform", ["o_orderkey"], 3), 4)


@query("r9_synthesize_independent", f"""
WITH ix AS ({INDEXED.format(h=h_sql(3, 'index', 'o_orderkey'), t='orders')}),
d AS (SELECT range AS draw, (SELECT count(*) FROM orders) AS n FROM range((SELECT count(*) FROM orders)))
SELECT draw, a.o_totalprice, b.o_orderstatus, c.o_orderpriority FROM d
JOIN ix a ON a.idx = CAST(floor({u_sql(3, 'marginal:o_totalprice', 'draw')} * n) AS BIGINT)
JOIN ix b ON b.idx = CAST(floor({u_sql(3, 'marginal:o_orderstatus', 'draw')} * n) AS BIGINT)
JOIN ix c ON c.idx = CAST(floor({u_sql(3, 'marginal:o_orderpriority', 'draw')} * n) AS BIGINT)""")
def r9_independent(spark, sf):
    df = table(spark, sf, "orders")
    return synth.synthesize(df, ORDERS, df.count(), "independent", ["o_orderkey"], 3)


@query("r9_synthesize_identity", f"""
WITH ix AS ({INDEXED.format(h=h_sql(3, 'index', 'event_id'), t='events')}),
draws AS (SELECT range AS draw, CAST(floor({u_sql(3, 'bootstrap', 'range')} * (SELECT count(*) FROM events)) AS BIGINT) AS idx
  FROM range((SELECT count(*) FROM events)))
SELECT draw, value, event_type FROM draws JOIN ix USING (idx)""")
def r9_identity(spark, sf):
    df = table(spark, sf, "events")
    return synth.synthesize(df, EVENTS, df.count(), "identity", ["event_id"], 3)


def _net_sql():
    """Ancestral sampling column by column; every conditional table becomes intervals of [0, 1)."""
    def intervals(child, parents):
        by = ", ".join([*parents, child])
        part = f"PARTITION BY {', '.join(parents)} " if parents else ""
        keep = "".join(f"{p}, " for p in parents)
        return (f"(SELECT {keep}{child}, coalesce(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lo, "
                f"sum(c) OVER (w ROWS UNBOUNDED PRECEDING) / sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi "
                f"FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY ALL) WINDOW w AS ({part}ORDER BY {child}))")
    t = "t AS (SELECT l_linestatus, l_returnflag, CAST(l_linenumber AS VARCHAR) AS l_linenumber FROM lineitem)"
    return f"""
WITH {t}, d0 AS (SELECT range AS draw FROM range((SELECT count(*) FROM lineitem))),
d1 AS (SELECT draw, l_linestatus FROM d0, {intervals('l_linestatus', [])} i WHERE {u_sql(3, 'net:l_linestatus', 'draw')} >= lo AND {u_sql(3, 'net:l_linestatus', 'draw')} < hi),
d2 AS (SELECT draw, l_linestatus, l_returnflag FROM d1 JOIN {intervals('l_returnflag', ['l_linestatus'])} i USING (l_linestatus)
  WHERE {u_sql(3, 'net:l_returnflag', 'draw')} >= lo AND {u_sql(3, 'net:l_returnflag', 'draw')} < hi),
d3 AS (SELECT draw, l_linestatus, l_returnflag, l_linenumber FROM d2 JOIN {intervals('l_linenumber', ['l_returnflag'])} i USING (l_returnflag)
  WHERE {u_sql(3, 'net:l_linenumber', 'draw')} >= lo AND {u_sql(3, 'net:l_linenumber', 'draw')} < hi)
SELECT * FROM d3"""


@query("r9_synthesize_bayes_net", _net_sql())
def r9_net(spark, sf):
    df = table(spark, sf, "lineitem")
    return synth.bayes_net_rows(df, NET, df.count(), 3)


# Missing values as parents and children: a rule on the key blanks them; every row takes part and is drawn.
NET_BLANKS = {"l_linestatus": "(l_orderkey + l_linenumber) % 7 = 3", "l_returnflag": "l_orderkey % 5 = 1",
              "l_linenumber": "l_orderkey % 11 = 4"}


def _net_null_sql():
    """As ``_net_sql``, joining missing with missing; a missing value sorts last."""
    def intervals(child, parents):
        by = ", ".join([*parents, child])
        part = f"PARTITION BY {', '.join(parents)} " if parents else ""
        keep = "".join(f"{p}, " for p in parents)
        return (f"(SELECT {keep}{child}, coalesce(sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS lo, "
                f"sum(c) OVER (w ROWS UNBOUNDED PRECEDING) / sum(c) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS hi "
                f"FROM (SELECT {by}, CAST(count(*) AS DOUBLE) AS c FROM t GROUP BY ALL) WINDOW w AS ({part}ORDER BY {child} NULLS LAST))")
    cols = ", ".join(f"CASE WHEN {rule} THEN NULL ELSE CAST({c} AS VARCHAR) END AS {c}" for c, rule in NET_BLANKS.items())
    u = {c: u_sql(3, f"net:{c}", "draw") for c in NET}
    return f"""
WITH t AS (SELECT {cols} FROM lineitem), d0 AS (SELECT range AS draw FROM range((SELECT count(*) FROM lineitem))),
d1 AS (SELECT draw, l_linestatus FROM d0, {intervals('l_linestatus', [])} i WHERE {u['l_linestatus']} >= lo AND {u['l_linestatus']} < hi),
d2 AS (SELECT draw, d1.l_linestatus, i.l_returnflag FROM d1 JOIN {intervals('l_returnflag', ['l_linestatus'])} i
  ON d1.l_linestatus IS NOT DISTINCT FROM i.l_linestatus WHERE {u['l_returnflag']} >= lo AND {u['l_returnflag']} < hi),
d3 AS (SELECT draw, d2.l_linestatus, d2.l_returnflag, i.l_linenumber FROM d2 JOIN {intervals('l_linenumber', ['l_returnflag'])} i
  ON d2.l_returnflag IS NOT DISTINCT FROM i.l_returnflag WHERE {u['l_linenumber']} >= lo AND {u['l_linenumber']} < hi)
SELECT * FROM d3"""


def blanked_lineitem(df):
    return df.withColumns({c: F.when(F.expr(rule), F.lit(None)).otherwise(F.col(c)) for c, rule in NET_BLANKS.items()})


@query("r9_null_parents", _net_null_sql())
def r9_null_parents(spark, sf):
    df = blanked_lineitem(table(spark, sf, "lineitem"))
    return synth.bayes_net_rows(df, NET, df.count(), 3)


@query("r11_split", f"""
SELECT CASE WHEN {u_sql(3, 'split', 'o_orderkey')} < 0.8 THEN 'train' ELSE 'test' END AS part, o_orderkey FROM orders""")
def r11(spark, sf):
    train, test = sample.split(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 0.8, 3)
    return train.select(F.lit("train").alias("part"), "o_orderkey").unionByName(
        test.select(F.lit("test").alias("part"), "o_orderkey"))


@query("r12_shuffle_cap", f"""
SELECT event_id, value, event_type FROM events
QUALIFY row_number() OVER (ORDER BY {h_sql(3, 'features', 'event_id')}) <= 50000""")
def r12(spark, sf):
    df = table(spark, sf, "events").select("event_id", "value", "event_type")
    return sample.shuffle_cap(df, ["event_id"], 50000, 3)


@query("r1_sample_with_copies", f"""
WITH copies AS (SELECT l_returnflag, l_linestatus FROM lineitem),
cut AS (SELECT l_returnflag, l_linestatus FROM copies
  QUALIFY row_number() OVER (ORDER BY {h_sql(3, 'sample', 'l_returnflag', 'l_linestatus')}) <= (SELECT count(*) // 2 FROM lineitem))
SELECT l_returnflag, l_linestatus, count(*) AS copies FROM cut GROUP BY ALL""")
def r1_copies(spark, sf):
    # Six different rows in all: the cut runs through the copies of one of them.
    df = table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus")
    return distinct_counts(sample.exact_sample(df, _half(df), seed=3))


