"""Splits, folds, baselines and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.operators import metrics as met
from tablelens.operators import split as sp

from .registry import query, table

LINE_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
LINE_KEY_SQL = ("concat_ws('|', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice AS VARCHAR))")


def _hash_sql(key: str, salt: str) -> str:
    return f"md5('{salt}|' || {key})"


# -- splits --------------------------------------------------------------------------------------------
@query("holdout_split", f"""
SELECT o_orderkey, CASE WHEN row_number() OVER (ORDER BY {_hash_sql('o_orderkey', '42')})
  <= ceil(count(*) OVER () * 0.2) THEN 0 ELSE 1 END AS part FROM orders""")
def holdout_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return sp.holdout_split(df, ["o_orderkey"], df.count()).assign(df, "part")


@query("kfold", f"""
SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY {_hash_sql('o_orderkey', '42f')}) - 1 AS INTEGER) AS fold FROM orders""")
def kfold(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return sp.kfold(df, ["o_orderkey"], df.count(), 5).assign(df, "fold")


@query("stratified_split", f"""
WITH s AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS n_test FROM s),
w AS (SELECT c, n * n_test // total AS whole, n * n_test % total AS rest, n_test FROM s, t),
q AS (SELECT c, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= n_test - sum(whole) OVER () THEN 1 ELSE 0
      END AS quota FROM w)
SELECT o_orderkey, CASE WHEN row_number() OVER (PARTITION BY c ORDER BY {_hash_sql('o_orderkey', '42')}) <= quota
  THEN 0 ELSE 1 END AS part FROM orders JOIN q ON o_orderpriority = c""")
def stratified_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sp.stratified_holdout(df, "o_orderpriority", ["o_orderkey"]).assign(df, "part").drop("o_orderpriority")


@query("stratified_kfold", f"""
WITH s AS (SELECT o_orderpriority AS c, count(*) AS n FROM orders GROUP BY 1),
o AS (SELECT c, n, sum(n) OVER (ORDER BY c) - n AS start FROM s),
f AS (SELECT c, i, (SELECT count(*) FROM range(start, start + n) r(x) WHERE x % 5 = i) AS size
      FROM (SELECT c, CAST(n AS BIGINT) AS n, CAST(start AS BIGINT) AS start FROM o), range(5) g(i)),
u AS (SELECT c, i, sum(size) OVER (PARTITION BY c ORDER BY i) AS upto, size FROM f),
r AS (SELECT o_orderkey, o_orderpriority AS c,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY {_hash_sql('o_orderkey', '42f')}) AS rk FROM orders)
SELECT o_orderkey, CAST(i AS INTEGER) AS fold FROM r JOIN u ON r.c = u.c AND rk <= upto AND rk > upto - size""")
def stratified_kfold(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return sp.stratified_kfold(df, "o_orderpriority", ["o_orderkey"], 5).assign(df, "fold").drop("o_orderpriority")


@query("stratified_split_lines", f"""
WITH s AS (SELECT l_returnflag AS c, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS n_test FROM s),
w AS (SELECT c, n * n_test // total AS whole, n * n_test % total AS rest, n_test FROM s, t),
q AS (SELECT c, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= n_test - sum(whole) OVER () THEN 1 ELSE 0
      END AS quota FROM w)
SELECT c AS l_returnflag, part, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS key_sum FROM (
  SELECT c, l_orderkey, CASE WHEN row_number() OVER (PARTITION BY c ORDER BY {_hash_sql(LINE_KEY_SQL, '42')}) <= quota
    THEN 0 ELSE 1 END AS part FROM lineitem JOIN q ON l_returnflag = c) GROUP BY 1, 2""")
def stratified_split_lines(spark, sf_dir):
    """A compound key: row counts and key sums of every class and part."""
    df = table(spark, sf_dir, "lineitem").select(*LINE_KEY, "l_returnflag")
    parts = sp.stratified_holdout(df, "l_returnflag", LINE_KEY).assign(df, "part")
    return parts.groupBy("l_returnflag", "part").agg(F.count("*").alias("n"), F.sum("l_orderkey").alias("key_sum"))


@query("stratified_split_many", f"""
WITH s AS (SELECT l_orderkey AS c, count(*) AS n FROM lineitem GROUP BY 1),
t AS (SELECT sum(n) AS total, CAST(ceil(sum(n) * 0.2) AS BIGINT) AS n_test FROM s),
w AS (SELECT c, n * n_test // total AS whole, n * n_test % total AS rest, n_test FROM s, t),
q AS (SELECT c, whole + CASE WHEN row_number() OVER (ORDER BY rest DESC, c) <= n_test - sum(whole) OVER () THEN 1 ELSE 0
      END AS quota FROM w)
SELECT l_orderkey, l_linenumber, CASE WHEN row_number() OVER (PARTITION BY c ORDER BY {_hash_sql(LINE_KEY_SQL, '42')}) <= quota
  THEN 0 ELSE 1 END AS part FROM lineitem JOIN q ON l_orderkey = c""")
def stratified_split_many(spark, sf_dir):
    """Every order is a class of its own."""
    df = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    return sp.stratified_holdout(df, "l_orderkey", LINE_KEY).assign(df, "part").select("l_orderkey", "l_linenumber", "part")


@query("stratified_kfold_many", f"""
WITH s AS (SELECT l_orderkey AS c, count(*) AS n FROM lineitem GROUP BY 1),
o AS (SELECT c, n, sum(n) OVER (ORDER BY c) - n AS start FROM s),
f AS (SELECT c, i, (SELECT count(*) FROM range(start, start + n) r(x) WHERE x % 3 = i) AS size
      FROM (SELECT c, CAST(n AS BIGINT) AS n, CAST(start AS BIGINT) AS start FROM o), range(3) g(i)),
u AS (SELECT c, i, sum(size) OVER (PARTITION BY c ORDER BY i) AS upto, size FROM f),
r AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY {_hash_sql(LINE_KEY_SQL, '42f')}) AS rk FROM lineitem)
SELECT l_orderkey, l_linenumber, CAST(i AS INTEGER) AS fold FROM r JOIN u ON l_orderkey = u.c AND rk <= upto AND rk > upto - size""")
def stratified_kfold_many(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(*LINE_KEY)
    return sp.stratified_kfold(df, "l_orderkey", LINE_KEY, 3).assign(df, "fold").select("l_orderkey", "l_linenumber", "fold")


# -- regression metrics --------------------------------------------------------------------------------
PRED_SQL = """(SELECT l_extendedprice AS y, p AS prediction, l_returnflag AS g FROM lineitem JOIN
  (SELECT l_quantity AS q, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1) ON l_quantity = q)"""


def price_by_quantity(spark, sf_dir) -> DataFrame:
    """Extended price predicted by its mean per quantity."""
    df = table(spark, sf_dir, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag")
    means = df.groupBy("l_quantity").agg(F.avg("l_extendedprice").alias("prediction"))
    return df.join(means, "l_quantity").select(
        F.col("l_extendedprice").alias("y"), "prediction", F.col("l_returnflag").alias("g"))


REGRESSION_SQL = """round(1 - sum((y - prediction) ** 2) / (var_pop(y) * count(*)), 5) AS r2,
  round(sqrt(avg((y - prediction) ** 2)), 4) AS rmse, round(avg(abs(y - prediction)), 4) AS mae,
  round(avg(CASE WHEN abs(y) >= 1e-9 THEN abs((y - prediction) / y) END) * 100, 4) AS mape_pct"""


def _round_metrics(df: DataFrame) -> DataFrame:
    digits = {"r2": 5, "rmse": 4, "mae": 4, "mape_pct": 4}
    return df.select(*[F.round(c, digits[c]).alias(c) if c in digits else F.col(c) for c in df.columns])


@query("regr_metrics", f"SELECT {REGRESSION_SQL} FROM {PRED_SQL}")
def regr_metrics(spark, sf_dir):
    return _round_metrics(met.regression_metrics(price_by_quantity(spark, sf_dir)))


@query("regr_metrics_by_group", f"SELECT g, {REGRESSION_SQL} FROM {PRED_SQL} GROUP BY g")
def regr_metrics_by_group(spark, sf_dir):
    return _round_metrics(met.regression_metrics(price_by_quantity(spark, sf_dir), ["g"]))


@query("metric_table", f"""
UNPIVOT (SELECT {REGRESSION_SQL.replace(', 5)', ', 4)')} FROM {PRED_SQL}) ON r2, rmse, mae, mape_pct
INTO NAME metric VALUE value""")
def metric_table(spark, sf_dir):
    """Metrics melted into rows and rounded for display."""
    m = met.regression_metrics(price_by_quantity(spark, sf_dir))
    return m.unpivot([], list(met.REGRESSION_METRICS), "metric", "value").withColumn("value", F.round("value", 4))


# -- classification metrics ----------------------------------------------------------------------------
CLASS_SQL = """(SELECT o_orderstatus AS y, CASE WHEN o_totalprice < 150000 THEN 'F' WHEN o_totalprice < 300000 THEN 'O'
  ELSE 'P' END AS prediction FROM orders)"""
CLASS_RATES_SQL = f"""(SELECT c, count(*) FILTER (y = c) AS support, count(*) FILTER (prediction = c) AS guessed,
  count(*) FILTER (y = c AND prediction = c) AS hit FROM {CLASS_SQL}, (SELECT unnest(['F', 'O', 'P']) AS c) GROUP BY c)"""


def status_by_price(spark, sf_dir) -> DataFrame:
    price = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderstatus").alias("y"),
        F.when(price < 150000, "F").when(price < 300000, "O").otherwise("P").alias("prediction"))


@query("class_metrics", f"""
SELECT round(sum(hit) / sum(support), 6) AS accuracy,
  round(sum(coalesce(2 * hit / nullif(support + guessed, 0), 0) * support) / sum(support), 6) AS f1_weighted,
  round(sum(coalesce(hit / nullif(guessed, 0), 0) * support) / sum(support), 6) AS precision_weighted,
  round(sum(coalesce(hit / nullif(support, 0), 0) * support) / sum(support), 6) AS recall_weighted FROM {CLASS_RATES_SQL}""")
def class_metrics(spark, sf_dir):
    m = met.classification_metrics(met.confusion_counts(status_by_price(spark, sf_dir)))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query("confusion", f"""
SELECT a.c AS y, b.c AS prediction, (SELECT count(*) FROM {CLASS_SQL} t WHERE t.y = a.c AND t.prediction = b.c) AS n
FROM (SELECT unnest(['F', 'O', 'P']) AS c) a, (SELECT unnest(['F', 'O', 'P']) AS c) b""")
def confusion(spark, sf_dir):
    return met.confusion_matrix(status_by_price(spark, sf_dir))


MANY_CLASS_SQL = "(SELECT o_custkey AS y, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE o_custkey % 97 END AS prediction FROM orders)"


@query("confusion_many", f"""
WITH n AS (SELECT y, prediction, count(*) AS n FROM {MANY_CLASS_SQL} GROUP BY 1, 2),
k AS (SELECT c FROM (SELECT y AS c, n FROM n UNION ALL SELECT prediction, n FROM n) GROUP BY c ORDER BY sum(n) DESC, c LIMIT 50)
SELECT coalesce(n.y, g.y) AS y, coalesce(n.prediction, g.prediction) AS prediction, coalesce(n.n, 0) AS n
FROM n FULL JOIN (SELECT a.c AS y, b.c AS prediction FROM k a, k b) g ON n.y = g.y AND n.prediction = g.prediction""")
def confusion_many(spark, sf_dir):
    """A class per customer."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("y"), F.when(
        F.col("o_orderkey") % 3 == 0, F.col("o_custkey")).otherwise(F.col("o_custkey") % 97).alias("prediction"))
    return met.confusion_matrix(rows)


@query("class_recall", f"SELECT c AS y, support, round(hit / support, 6) AS recall FROM {CLASS_RATES_SQL}")
def class_recall(spark, sf_dir):
    return met.class_recall(met.confusion_counts(status_by_price(spark, sf_dir))).withColumn("recall", F.round("recall", 6))


SCORE_SQL = "(SELECT round(l_extendedprice / 1000) AS score, l_quantity > 25 AS positive FROM lineitem)"


def scored_lines(spark, sf_dir) -> DataFrame:
    """Is the quantity above 25, scored by the price in thousands: many rows share a score."""
    return table(spark, sf_dir, "lineitem").select(
        F.rint(F.col("l_extendedprice") / 1000).alias("score"), (F.col("l_quantity") > 25).alias("positive"))


AUC_SQL = """
WITH s AS (SELECT score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM {t} GROUP BY 1),
c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS pos_to FROM s)
SELECT round(sum(CAST(neg AS DOUBLE) * (pos_to - pos / 2)) / (sum(pos) * sum(neg)), 8) AS auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg FROM c"""


@query("roc_auc", AUC_SQL.format(t=SCORE_SQL.replace("round(", "round_even(").replace("1000)", "1000, 0)")))
def roc_auc(spark, sf_dir):
    return met.roc_auc(scored_lines(spark, sf_dir)).withColumn("auc", F.round("auc", 8))


@query("roc_auc_distinct", AUC_SQL.format(t="(SELECT l_extendedprice AS score, l_quantity > 25 AS positive FROM lineitem)"))
def roc_auc_distinct(spark, sf_dir):
    """Nearly every score is different; small ranges make several tasks rank them."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("score"), (F.col("l_quantity") > 25).alias("positive"))
    return met.roc_auc(rows, bucket_rows=10_000).withColumn("auc", F.round("auc", 8))


@query("roc_curve", """
WITH s AS (SELECT score, count(*) FILTER (positive) AS pos, count(*) FILTER (NOT positive) AS neg FROM {t} GROUP BY 1),
c AS (SELECT *, sum(pos) OVER w AS p, sum(neg) OVER w AS n, lead(pos) OVER w AS pn, lead(neg) OVER w AS nn,
        max(score) OVER () AS top, sum(pos) OVER () AS pt, sum(neg) OVER () AS nt FROM s WINDOW w AS (ORDER BY score DESC))
SELECT score AS threshold, round(n / nt, 8) AS fpr, round(p / pt, 8) AS tpr FROM c
WHERE score = top OR pn IS NULL OR pn <> pos OR nn <> neg
UNION ALL SELECT NULL, 0.0, 0.0""".format(t=SCORE_SQL.replace("round(", "round_even(").replace("1000)", "1000, 0)")))
def roc_curve(spark, sf_dir):
    return met.roc_curve(scored_lines(spark, sf_dir), bucket_rows=20).select(
        "threshold", F.round("fpr", 8).alias("fpr"), F.round("tpr", 8).alias("tpr"))


OVR_SQL = """(SELECT CAST(n_regionkey % 3 AS INTEGER) AS y, [c_acctbal / 20000 + 0.5, c_custkey / 2000000, 0.3] AS p
  FROM customer JOIN nation ON c_nationkey = n_nationkey)"""


@query("auc_ovr", f"""
WITH t AS {OVR_SQL}, e AS (SELECT y, k AS c, p[k + 1] AS s FROM t, range(3) r(k)),
g AS (SELECT c, s, count(*) FILTER (y = c) AS pos, count(*) FILTER (y <> c) AS neg FROM e GROUP BY 1, 2),
h AS (SELECT *, sum(pos) OVER (PARTITION BY c ORDER BY s DESC) AS pos_to FROM g),
a AS (SELECT c, sum(CAST(neg AS DOUBLE) * (pos_to - pos / 2)) / (sum(pos) * sum(neg)) AS auc, sum(pos) AS n FROM h GROUP BY c)
SELECT round(sum(auc * n) / sum(n), 8) AS auc FROM a""")
def auc_ovr(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(
        (F.col("n_regionkey") % 3).cast("double").alias("y"),
        F.array(F.col("c_acctbal") / 20000 + 0.5, F.col("c_custkey") / 2000000, F.lit(0.3)).alias("probability"))
    return met.auc_ovr(rows, bucket_rows=500).withColumn("auc", F.round("auc", 8))


# -- baselines -----------------------------------------------------------------------------------------
@query("baseline_metrics", f"""
WITH h AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql('o_orderkey', '42')}) <= ceil(count(*) OVER () * 0.2) AS test
           FROM orders),
m AS (SELECT avg(o_totalprice) AS mean_price FROM h WHERE NOT test),
k AS (SELECT o_orderstatus AS major FROM h WHERE NOT test GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
SELECT round(mean_price, 4) AS mean_price, major, round(sqrt(avg((o_totalprice - mean_price) ** 2)), 4) AS rmse,
  round(avg(CASE WHEN o_orderstatus = major THEN 1.0 ELSE 0.0 END), 6) AS accuracy
FROM h, m, k WHERE test GROUP BY mean_price, major""")
def baseline_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    rows = sp.holdout_split(df, ["o_orderkey"], df.count()).assign(df, "part")
    train, test = rows.where("part = 1"), rows.where("part = 0")
    mean, major = met.mean_baseline(train, "o_totalprice"), met.majority_baseline(train, "o_orderstatus")
    r = met.regression_metrics(test.withColumn("prediction", F.lit(mean)), None, "o_totalprice").first()
    c = met.classification_metrics(met.confusion_counts(
        test.withColumn("prediction", F.lit(major)), None, "o_orderstatus")).first()
    return spark.createDataFrame(
        [(round(mean, 4), major, round(r["rmse"], 4), round(c["accuracy"], 6))],
        "mean_price double, major string, rmse double, accuracy double")


@query("improvement", f"""
WITH m AS (SELECT sqrt(avg((y - prediction) ** 2)) AS model, stddev_pop(y) AS base FROM {PRED_SQL})
SELECT round((base - model) / base * 100, 4) AS rmse_gain_pct, CAST(0 AS DOUBLE) AS zero_base FROM m""")
def improvement(spark, sf_dir):
    rows = price_by_quantity(spark, sf_dir)
    model = met.regression_metrics(rows).select(F.col("rmse").alias("model")).first()["model"]
    return rows.agg(F.stddev_pop("y").alias("base")).select(
        F.round(met.improvement_pct(F.col("base"), F.lit(model), higher_is_better=False), 4).alias("rmse_gain_pct"),
        met.improvement_pct(F.lit(0.0), F.lit(model), higher_is_better=True).alias("zero_base"))
