"""Plot data, leaderboards, sources and sinks."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from tablemirror.operators import leaderboard as boards
from tablemirror.operators import plotdata
from tablemirror.operators.profile import column_metadata, fitted_vocabularies
from tablemirror.operators.sample import split
from tablemirror.plans.compare_queries import assoc_sql, corr_sql, diff_sql
from tablemirror.plans.fixtures import LINEITEM, ORDERS, SEED, pair, sides, sides_sql, u_sql
from tablemirror.plans.registry import query, rounded, scratch, table
from tablemirror.schema import TableMeta, TablePair
from tablemirror.sources import tables as sources

NUM, DISC = LINEITEM.numericals, LINEITEM.discretes


# ---------------------------------------------------------------- plot data

@query("v1_pca_points")
def v1(spark, sf):
    real, fake = sides(spark, sf, "orders")
    keep = ["o_orderkey", *ORDERS.columns]
    both = TablePair(real.select(*keep), fake.select(*keep), ORDERS)
    return rounded(plotdata.pca_points(both, ["o_orderkey"]), 2)


def _kinds(sql_real, sql_fake):
    return f"SELECT 'Real' AS kind, * FROM ({sql_real}) UNION ALL SELECT 'Fake' AS kind, * FROM ({sql_fake})"


def _below(source):
    order = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(NUM))
    return f"SELECT col_a, col_b, round(value, 6) AS value FROM ({corr_sql(source, NUM)}) WHERE (CASE col_a {order} END) > (CASE col_b {order} END)"


@query("v2_correlation_triangle", f"WITH {sides_sql('lineitem')} {_kinds(_below('rl'), _below('fk'))}")
def v2(spark, sf):
    return rounded(plotdata.correlation_triangle(pair(spark, sf, "lineitem")))


def _encoded():
    out = {c: c for c in NUM}
    out.update({f"l_linenumber_{i}": f"CAST(l_linenumber = {i} AS DOUBLE)" for i in range(1, 8)})
    out.update({f"l_returnflag_{v}": f"CAST(l_returnflag = '{v}' AS DOUBLE)" for v in "ANR"})
    out["l_linestatus"] = "CAST(l_linestatus = 'O' AS DOUBLE)"
    return out


def _mean_std(source):
    return " UNION ALL ".join(f"SELECT '{n}' AS name, round(ln(abs(avg({e})) + 1e-5), 6) AS log_mean, round(ln(stddev_samp({e}) + 1e-5), 6) AS log_std FROM {source}"
                              for n, e in _encoded().items())


@query("v3_mean_std", f"WITH {sides_sql('lineitem')} {_kinds(_mean_std('rl'), _mean_std('fk'))}")
def v3(spark, sf):
    return rounded(plotdata.mean_std(pair(spark, sf, "lineitem")))


@query("v4_association_plot", f"""
WITH {sides_sql('lineitem')}, {diff_sql(LINEITEM)} SELECT col_a, col_b, round("real", 6) AS "real", round(fake, 6) AS fake, round(diff, 6) AS diff FROM d""")
def v4(spark, sf):
    return rounded(plotdata.association_plot(pair(spark, sf, "lineitem")))


def _cdf(source):
    return f"SELECT DISTINCT 'value' AS name, value, round(count(*) OVER (ORDER BY value) / CAST(count(*) OVER () AS DOUBLE), 6) AS share FROM {source}"


@query("v5_cumulative_distribution", f"WITH {sides_sql('events')} {_kinds(_cdf('rl'), _cdf('fk'))}")
def v5(spark, sf):
    return rounded(plotdata.cumulative_distribution(pair(spark, sf, "events"), ["value"]))


@query("v6_histogram", f"""
WITH {sides_sql('events')}, b AS (SELECT 'Real' AS kind, value FROM rl UNION ALL SELECT 'Fake', value FROM fk),
e AS (SELECT min(value) AS lo, (max(value) - min(value)) / 30 AS w FROM b), h AS (
SELECT kind, 'value' AS name, CAST(least(floor((value - lo) / w), 29) AS INTEGER) AS bin, lo, w, count(*) AS cnt FROM b, e GROUP BY ALL)
SELECT kind, name, bin, round(lo + bin * w, 6) AS low, round(lo + (bin + 1) * w, 6) AS high, cnt,
  round(cnt / (sum(cnt) OVER (PARTITION BY kind) * w), 6) AS density FROM h""")
def v6(spark, sf):
    return rounded(plotdata.histogram(pair(spark, sf, "events"), ["value"]))


@query("v6_density_curve")
def v6_curve(spark, sf):
    return rounded(plotdata.density_curve(plotdata.histogram(pair(spark, sf, "events"), ["value"], 50)))


def _proportions(source):
    return f"SELECT 'event_type' AS name, event_type AS value, round(count(*) / CAST(sum(count(*)) OVER () AS DOUBLE), 6) AS proportion FROM {source} GROUP BY event_type"


@query("v7_category_proportions", f"WITH {sides_sql('events')} {_kinds(_proportions('rl'), _proportions('fk'))}")
def v7(spark, sf):
    return rounded(plotdata.category_proportions(pair(spark, sf, "events"), ["event_type"]))


MANY = f"WITH {sides_sql('lineitem')}, fa AS (SELECT * FROM fk WHERE l_quantity <= 25), fb AS (SELECT * FROM fk WHERE l_quantity > 25)"


def _many(spark, sf):
    both = pair(spark, sf, "lineitem")
    low = F.col("l_quantity") <= 25
    return both.real, {"low": both.fake.filter(low), "high": both.fake.filter(~low)}


@query("v8_mean_std_of_many", f"""
{MANY} SELECT 'Real' AS synthesizer, * FROM ({_mean_std('rl')}) UNION ALL SELECT 'low', * FROM ({_mean_std('fa')}) UNION ALL SELECT 'high', * FROM ({_mean_std('fb')})""")
def v8(spark, sf):
    real, fakes = _many(spark, sf)
    return rounded(plotdata.mean_std_of_many(real, fakes, LINEITEM))


@query("v8_association_of_many", f"""
{MANY}, r AS ({assoc_sql('rl', LINEITEM)}), m AS (SELECT 'low' AS synthesizer, * FROM ({assoc_sql('fa', LINEITEM)}) UNION ALL SELECT 'high', * FROM ({assoc_sql('fb', LINEITEM)}))
SELECT synthesizer, col_a, col_b, round(m.value, 6) AS value, round(abs(m.value - r.value), 6) AS diff FROM m JOIN r USING (col_a, col_b)""")
def v8_association(spark, sf):
    real, fakes = _many(spark, sf)
    return rounded(plotdata.association_of_many(real, fakes, LINEITEM))


# ---------------------------------------------------------------- leaderboards

SCORES = """s AS (SELECT 'M_' || l_returnflag AS name, 'D_' || l_linestatus AS dataset, l_linenumber AS iteration, 'S_' || l_linenumber AS synthesizer,
  avg(l_discount) * 10 AS accuracy_real, avg(l_tax) * 10 AS accuracy_fake, avg(l_quantity) / 50 AS f1_real FROM lineitem GROUP BY ALL)"""


def scores(spark, sf):
    return table(spark, sf, "lineitem").groupBy(
        F.concat(F.lit("M_"), "l_returnflag").alias("name"), F.concat(F.lit("D_"), "l_linestatus").alias("dataset"),
        F.col("l_linenumber").alias("iteration"), F.concat(F.lit("S_"), F.col("l_linenumber").cast("string")).alias("synthesizer")).agg(
        (F.avg("l_discount") * 10).alias("accuracy_real"), (F.avg("l_tax") * 10).alias("accuracy_fake"), (F.avg("l_quantity") / 50).alias("f1_real"))


BOARD = "SELECT name, dataset, round(avg(accuracy_real), 6) AS accuracy_real, round(avg(accuracy_fake), 6) AS accuracy_fake, round(avg(f1_real), 6) AS f1_real FROM s GROUP BY ALL"


@query("l1_leaderboard", f"WITH {SCORES} {BOARD}")
def l1(spark, sf):
    return rounded(boards.leaderboard(scores(spark, sf)).drop("timestamp"))


@query("l1_leaderboard_appended", f"""
WITH {SCORES}, old AS (SELECT 'M_A' AS name, 'D_old' AS dataset, avg(l_tax) AS f1_real FROM lineitem UNION ALL SELECT 'M_old', 'D_old', avg(l_discount) FROM lineitem)
SELECT * FROM ({BOARD}) UNION ALL SELECT name, dataset, NULL, NULL, round(f1_real, 6) FROM old WHERE name <> 'M_A'""")
def l1_appended(spark, sf):
    df = table(spark, sf, "lineitem")
    old = df.agg(F.avg("l_tax").alias("t"), F.avg("l_discount").alias("d")).select(F.inline(F.array(
        F.struct(F.lit("M_A").alias("name"), F.lit("D_old").alias("dataset"), F.col("t").alias("f1_real")),
        F.struct(F.lit("M_old").alias("name"), F.lit("D_old").alias("dataset"), F.col("d").alias("f1_real")))))
    board = boards.leaderboard(scores(spark, sf), old, replace_existing=True).drop("timestamp")
    return rounded(board.select("name", "dataset", "accuracy_real", "accuracy_fake", "f1_real"))


METRICS = {"grid/syn_likelihood": "avg(l_discount)", "asia/syn_likelihood": "avg(l_tax)", "adult/f1": "avg(l_quantity)",
           "census/f1": "avg(l_extendedprice)", "other/f1": "avg(l_linenumber)"}
NAMES = {"A": "SynA", "N": "SynN", "R": "IdentitySynthesizer"}
LONG = "w AS (" + " UNION ALL ".join(
    f"SELECT CASE l_returnflag WHEN 'A' THEN 'SynA' WHEN 'N' THEN 'SynN' ELSE 'IdentitySynthesizer' END AS synthesizer, "
    f"CASE l_linestatus WHEN 'F' THEN '0.1' ELSE '0.2' END AS version, '{m}' AS metric, CAST({e} AS DOUBLE) AS value FROM lineitem "
    f"WHERE NOT (l_returnflag = 'N' AND l_linestatus = 'F') GROUP BY ALL" for m, e in METRICS.items()) + ")"


def version_scores(spark, sf):
    df = table(spark, sf, "lineitem").filter(~((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F")))
    name = F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv])[F.col("l_returnflag")]
    return df.groupBy(name.alias("synthesizer"), F.when(F.col("l_linestatus") == "F", "0.1").otherwise("0.2").alias("version")).agg(
        *[F.expr(e).cast("double").alias(m) for m, e in METRICS.items()])


@query("l2_wins", f"""
WITH {LONG}, r AS (SELECT *, rank() OVER (PARTITION BY metric, version ORDER BY value DESC) AS rk FROM w)
SELECT version, synthesizer, CAST(count(*) FILTER (rk = 1) AS BIGINT) AS wins FROM r GROUP BY ALL""")
def l2(spark, sf):
    return boards.wins(boards.to_long(version_scores(spark, sf), ["synthesizer", "version"]), by=["version"])


SECTION_SQL = ("sec AS (SELECT * FROM (VALUES ('grid/syn_likelihood', 'Gaussian Mixture Simulated Data'), ('asia/syn_likelihood', 'Bayesian Networks Simulated Data'), "
               "('adult/f1', 'Real World Datasets'), ('census/f1', 'Real World Datasets')) t(metric, section))")


@query("l3_version_summary", f"""
WITH {LONG}, {SECTION_SQL}, j AS (SELECT w.*, section FROM w JOIN sec USING (metric) WHERE synthesizer <> 'IdentitySynthesizer'),
r AS (SELECT *, rank() OVER (PARTITION BY section, metric, version ORDER BY value DESC) AS rk FROM j),
k AS (SELECT section, synthesizer, version, count(*) FILTER (rk = 1) AS wins FROM r GROUP BY ALL)
SELECT section, synthesizer, coalesce(CAST(max(wins) FILTER (version = '0.2') AS VARCHAR), 'N/E') AS "0.2",
  coalesce(CAST(max(wins) FILTER (version = '0.1') AS VARCHAR), 'N/E') AS "0.1" FROM k GROUP BY ALL""")
def l3(spark, sf):
    long = boards.to_long(version_scores(spark, sf), ["synthesizer", "version"])
    return boards.summary(boards.sectioned(long), ["0.1", "0.2"])


@query("l4_sectioned_scores", f"""
WITH {LONG}, {SECTION_SQL} SELECT synthesizer, version, metric, round(value, 6) AS value, section FROM w JOIN sec USING (metric) WHERE synthesizer <> 'IdentitySynthesizer'""")
def l4(spark, sf):
    """Score files of two versions, written and read back; the version comes from the file name."""
    wide = version_scores(spark, sf)
    folder = scratch(spark, "scores")
    wide.write.option("header", True).partitionBy("version").csv(folder)
    back = (spark.read.option("header", True).option("inferSchema", True).option("recursiveFileLookup", True).csv(folder)
            .withColumn("version", F.regexp_extract(F.col("_metadata.file_path"), "version=([^/]+)/", 1)))
    return rounded(boards.sectioned(boards.to_long(back, ["synthesizer", "version"])).select("synthesizer", "version", "metric", "value", "section"))


@query("l5_dataset_metrics", f"""
WITH {SCORES}, m AS (SELECT name, dataset, 'accuracy_real' AS metric, avg(accuracy_real) AS value FROM s GROUP BY ALL
  UNION ALL SELECT name, dataset, 'accuracy_fake', avg(accuracy_fake) FROM s GROUP BY ALL UNION ALL SELECT name, dataset, 'f1_real', avg(f1_real) FROM s GROUP BY ALL)
SELECT name, dataset || '/' || metric AS metric, round(value, 6) AS value FROM m""")
def l5(spark, sf):
    return rounded(boards.dataset_metrics(scores(spark, sf)))


@query("l6_repeated_runs", "WITH s AS (" + " UNION ALL ".join(
    f"SELECT o_orderstatus AS name, avg(o_totalprice) AS mean_price, {i} AS iteration, 'bootstrap' AS synthesizer, 'orders' AS dataset FROM orders WHERE {u_sql(i, 'split', 'o_orderkey')} < 0.8 GROUP BY 1"
    for i in range(3)) + ") SELECT name, dataset, round(avg(mean_price), 4) AS mean_price FROM s GROUP BY ALL")
def l6(spark, sf):
    df = table(spark, sf, "orders")

    def run(i):
        train, _ = split(df, ["o_orderkey"], 0.8, i)
        return train.groupBy(F.col("o_orderstatus").alias("name")).agg(F.avg("o_totalprice").alias("mean_price"))
    return rounded(boards.leaderboard(boards.repeated(run, 3, "bootstrap", "orders")).drop("timestamp"), 4)


# ---------------------------------------------------------------- sources and sinks

@query("s1_csv_scan", "SELECT o_orderkey, round(o_totalprice, 4) AS o_totalprice, o_orderstatus, 'o_orderstatus' AS discrete FROM orders")
def s1(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("header", True).csv(path)
    df, discrete = sources.read_csv(spark, path)
    return rounded(df.withColumn("discrete", F.lit(",".join(discrete))), 4)


@query("s1_csv_without_header", """SELECT o_orderkey AS "0", round(o_totalprice, 4) AS "1", o_orderstatus AS "2", '2' AS discrete FROM orders""")
def s1_headless(spark, sf):
    path = scratch(spark, "csv")
    table(spark, sf, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus").write.option("sep", ";").csv(path)
    df, discrete = sources.read_csv(spark, path, sep=";", header=False, discrete=[2])
    return rounded(df.withColumn("discrete", F.lit(",".join(discrete))), 4)


SPEC = ["C 0 1000000", "C 0 600000", "D F O P", "D {1-URGENT 2-HIGH 3-MEDIUM 4-NOT_SPECIFIED 5-LOW}"]


def _spec_rows(spark, sf):
    status = F.array_position(F.array(*[F.lit(v) for v in "FOP"]), F.col("o_orderstatus")) - 1
    priority = F.substring("o_orderpriority", 1, 1).cast("int") - 1
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("0"), F.col("o_totalprice").alias("1"), status.alias("2"), priority.alias("3"))


def _write_spec(spark, sf):
    folder = scratch(spark, "spec")
    spark.createDataFrame([("\n".join(SPEC),)], "value string").coalesce(1).write.text(f"{folder}/meta")
    spec = sources.read_spec(spark, f"{folder}/meta")
    sources.write_spec_table(_spec_rows(spark, sf), spec, f"{folder}/rows")
    return f"{folder}/rows", spec


@query("s2_spec_text_scan", """
SELECT CAST(o_orderkey AS DOUBLE) AS "0", round(o_totalprice, 4) AS "1", CASE o_orderstatus WHEN 'F' THEN 0.0 WHEN 'O' THEN 1.0 ELSE 2.0 END AS "2",
  CAST(substr(o_orderpriority, 1, 1) AS DOUBLE) - 1 AS "3" FROM orders""")
def s2(spark, sf):
    return rounded(sources.read_spec_table(spark, *_write_spec(spark, sf)), 4)


@query("s3_spec_text_sink", """
SELECT o_orderkey, o_orderstatus, replace(o_orderpriority, ' ', '_') AS o_orderpriority FROM orders""")
def s3(spark, sf):
    path, _ = _write_spec(spark, sf)
    cells = F.split("value", " ")
    return spark.read.text(path).select(cells[0].cast("bigint").alias("o_orderkey"), cells[2].alias("o_orderstatus"), cells[3].alias("o_orderpriority"))


@query("s4_train_test_scan", f"""
SELECT CASE WHEN {u_sql(SEED, 'split', 'o_orderkey')} < 0.8 THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(o_totalprice), 0) AS total FROM orders GROUP BY 1""")
def s4(spark, sf):
    folder = scratch(spark, "splits")
    train, test = split(table(spark, sf, "orders"), ["o_orderkey"], 0.8, SEED)
    train.write.parquet(f"{folder}/train")
    test.write.parquet(f"{folder}/test")
    out = None
    for part, df in zip(("train", "test"), sources.read_splits(spark, f"{folder}/train", f"{folder}/test")):
        one = df.agg(F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))
        out = one if out is None else out.unionByName(one)
    return rounded(out, 0)


@query("s6_metadata_document", """
SELECT 'o_totalprice' AS name, 'numerical' AS kind, min(o_totalprice) AS "min", max(o_totalprice) AS "max", NULL::INTEGER AS size, NULL AS i2s FROM orders UNION ALL
SELECT 'o_orderstatus', 'categorical', NULL, NULL, count(DISTINCT o_orderstatus), (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT o_orderstatus AS s FROM orders)) FROM orders UNION ALL
SELECT 'o_orderpriority', 'ordinal', NULL, NULL, count(DISTINCT o_orderpriority), (SELECT string_agg(s, ',' ORDER BY s) FROM (SELECT DISTINCT o_orderpriority AS s FROM orders)) FROM orders""")
def s6(spark, sf):
    df = table(spark, sf, "orders")
    vocabularies = fitted_vocabularies(df, ORDERS.discretes)
    columns = []
    for r in column_metadata(df, ORDERS).orderBy("position").collect():
        entry = {"name": r["name"], "type": r["kind"]}
        entry.update({"min": r["min"], "max": r["max"]} if r["kind"] == "numerical" else {"size": r["size"], "i2s": vocabularies[r["name"]]})
        columns.append(entry)
    path = scratch(spark, "metadata")
    document = json.dumps({"columns": columns, "problem_type": "regression", "label": "o_totalprice"}, indent=1)
    spark.createDataFrame([(document,)], "value string").coalesce(1).write.text(path)
    meta = sources.read_metadata(spark, path)
    if meta.columns != ORDERS.columns or meta.label != "o_totalprice":
        raise ValueError("metadata was not read back")
    return sources.metadata_columns(spark.read.json(path, multiLine=True)).withColumn("i2s", F.array_join("i2s", ","))


@query("s7_typed_output", """
SELECT CAST(trunc(o_totalprice) AS INTEGER) AS o_totalprice, o_orderstatus, o_orderpriority FROM orders""")
def s7(spark, sf):
    df = table(spark, sf, "orders")
    vocabularies = fitted_vocabularies(df, ORDERS.discretes)
    meta = TableMeta(ORDERS.kinds, vocabularies)
    codes = [(F.array_position(F.array(*[F.lit(v) for v in vocabularies[c]]), F.col(c)) - 1).cast("double").alias(c) for c in ORDERS.discretes]
    path = sources.write_csv(sources.typed_output(df.select("o_totalprice", *codes), meta), scratch(spark, "out"), "orders", "Identity", "base", 0)
    return spark.read.option("header", True).csv(path, schema="o_totalprice int, o_orderstatus string, o_orderpriority string")


@query("s8_pair_sink", f"""
WITH {sides_sql('orders')} SELECT 'real' AS origin, o_totalprice, o_orderstatus, o_orderpriority FROM rl UNION ALL
SELECT 'fake', o_totalprice, o_orderstatus, o_orderpriority FROM fk""")
def s8(spark, sf):
    path = scratch(spark, "pair")
    sources.write_pair({"train": pair(spark, sf, "orders")}, path)
    back = sources.read_pair(spark, path, "train")
    return back.real.withColumn("origin", F.lit("real")).unionByName(back.fake.withColumn("origin", F.lit("fake")))


@query("s10_score_folder", f"WITH {SCORES} SELECT name, dataset, iteration, synthesizer, round(accuracy_real, 6) AS accuracy_real, round(f1_real, 6) AS f1_real FROM s")
def s10(spark, sf):
    folder = scratch(spark, "runs")
    scores(spark, sf).select("name", "dataset", "iteration", "synthesizer", "accuracy_real", "f1_real").write.option("header", True).csv(folder)
    return rounded(sources.read_scores(spark, folder).drop("version"))


@query("s10_mixed_files", f"WITH {SCORES} SELECT name, dataset, iteration, synthesizer, round(accuracy_real, 6) AS accuracy_real, "
       f"CASE WHEN iteration % 2 = 0 THEN round(f1_real, 6) END AS f1_real FROM s")
def s10_mixed(spark, sf):
    """Files whose columns stand in another order, or are missing, are matched by name."""
    folder = scratch(spark, "mixed")
    rows = scores(spark, sf)
    names = ["name", "dataset", "iteration", "synthesizer", "accuracy_real", "f1_real"]
    rows.filter("iteration % 2 = 0").select(names[::-1]).write.option("header", True).csv(folder)
    rows.filter("iteration % 2 <> 0").select(names[:-1]).write.option("header", True).mode("append").csv(folder)
    return rounded(sources.read_scores(spark, folder).select(names))


@query("s11_leaderboard_sink", f"WITH {SCORES} {BOARD}")
def s11(spark, sf):
    path = scratch(spark, "board")
    sources.write_leaderboard(boards.leaderboard(scores(spark, sf)).drop("timestamp"), path)
    return rounded(spark.read.option("header", True).option("inferSchema", True).csv(path))


@query("s12_json_scan", "SELECT event_id, event_type, value FROM events")
def s12(spark, sf):
    path = scratch(spark, "json")
    table(spark, sf, "events").select("event_id", "event_type", "value").write.json(path)
    return sources.read_json(spark, path, "event_id long, event_type string, value double")


@query("s12_text_scan", "SELECT count(*) AS lines, count(DISTINCT event_type) AS kinds FROM events")
def s12_text(spark, sf):
    path = scratch(spark, "text")
    table(spark, sf, "events").select("event_type").write.text(path)
    return sources.read_text(spark, path).agg(F.count(F.lit(1)).alias("lines"), F.count_distinct("value").alias("kinds"))
