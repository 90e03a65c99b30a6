"""Models, cross-validation, importance and whole analyses."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens import config as C
from tablelens.config import AnalysisConfig, ModelSettings
from tablelens.operators import compare as cmp
from tablelens.operators import encode as enc
from tablelens.operators import knn
from tablelens.operators import models as mo
from tablelens.operators import split as sp
from tablelens.operators.clean import clean_frame
from tablelens.operators.importance import fallback_importance, permutation_importance
from tablelens.operators.profile import profile_table
from tablelens.plans.jobs import analyze

from .evaluate_queries import LINE_KEY, LINE_KEY_SQL, _hash_sql
from .registry import query, table

#: Small models, so that a whole comparison stays a matter of seconds.
LIGHT = ModelSettings(n_trees=10, forest_depth=5, forest_bins=32, boosting_rounds=5, hist_bins=64, max_iter=100, parallelism=4)
CONTEXT = mo.FitContext(n_rows=0, n_classes=0, seed=42, settings=LIGHT)


def _price_rows(spark, sf_dir) -> DataFrame:
    """The price of a line by its quantity, as modelling rows."""
    return table(spark, sf_dir, "lineitem").select(
        sp.row_key(LINE_KEY).alias("_id"), F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("quantity"))


def _with_vector(df: DataFrame) -> DataFrame:
    return df.withColumn("features", array_to_vector(F.array("quantity")))


def _line(model) -> tuple[float, float]:
    return round(float(model.model.coefficients[0]), 4), round(float(model.model.intercept), 3)


# -- linear models with one feature have closed forms --------------------------------------------------
@query("simple_linear_fit", """
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope,
  round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept FROM lineitem""")
def simple_linear_fit(spark, sf_dir):
    model = mo.regression_candidates()[0].fit(_with_vector(_price_rows(spark, sf_dir)), CONTEXT)
    return spark.createDataFrame([_line(model)], "slope double, intercept double")


# The discount varies little, so that the penalties weigh as much as the data.
DISCOUNT_SQL = """(SELECT covar_pop(l_extendedprice, l_discount) AS c, var_pop(l_discount) AS v, count(*) AS n,
  avg(l_extendedprice) AS my, avg(l_discount) AS mx FROM lineitem)"""


def _price_by_discount(spark, sf_dir) -> DataFrame:
    return _with_vector(table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("quantity")))


@query("ridge_fit", f"""
WITH w AS (SELECT *, c * n / (v * n + 1) AS b FROM {DISCOUNT_SQL})
SELECT round(b, 1) AS slope, round(my - b * mx, 1) AS intercept FROM w""")
def ridge_fit(spark, sf_dir):
    df = _price_by_discount(spark, sf_dir)
    slope, intercept = _line(mo.regression_candidates()[1].fit(df, mo.FitContext(df.count(), 0, 42, LIGHT)))
    return spark.createDataFrame([(round(slope, 1), round(intercept, 1))], "slope double, intercept double")


@query("elastic_net_fit", f"""
WITH w AS (SELECT *, sign(c) * greatest(abs(c) - 0.05, 0) / (v + 0.05) AS b FROM {DISCOUNT_SQL})
SELECT round(b, 1) AS slope, round(my - b * mx, 1) AS intercept FROM w""")
def elastic_net_fit(spark, sf_dir):
    slope, intercept = _line(mo.regression_candidates()[2].fit(_price_by_discount(spark, sf_dir), CONTEXT))
    return spark.createDataFrame([(round(slope, 1), round(intercept, 1))], "slope double, intercept double")


# -- nearest neighbours ----------------------------------------------------------------------------------
POINTS_SQL = f"""(SELECT CAST(c_custkey AS VARCHAR) AS id, c_acctbal / 1000 AS a, CAST(c_nationkey AS DOUBLE) AS b,
  CAST(c_custkey AS DOUBLE) AS y, m.code AS seg,
  row_number() OVER (ORDER BY {_hash_sql('c_custkey', '42')}) <= ceil(count(*) OVER () * 0.2) AS test FROM customer
  JOIN (SELECT c_mktsegment AS s, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS DOUBLE) AS code
        FROM (SELECT DISTINCT c_mktsegment FROM customer)) m ON c_mktsegment = m.s)"""
NEAR_SQL = f"""(SELECT q.id AS qid, t.id AS tid, t.y, t.seg, row_number() OVER (PARTITION BY q.id
  ORDER BY (q.a - t.a) * (q.a - t.a) + (q.b - t.b) * (q.b - t.b), t.id) AS rank
  FROM {POINTS_SQL} q, {POINTS_SQL} t WHERE q.test AND NOT t.test)"""


def _points(spark, sf_dir, y: str) -> tuple[DataFrame, DataFrame]:
    df = table(spark, sf_dir, "customer")
    coded = enc.label_encode(df, "c_mktsegment", enc.fit_labels(df, "c_mktsegment"), "seg")
    parts = sp.holdout_split(df, ["c_custkey"], df.count()).assign(coded, "part")
    rows = parts.select(
        F.col("c_custkey").cast("string").alias("id"), F.array(F.col("c_acctbal") / 1000, F.col("c_nationkey").cast("double")).alias("v"),
        F.col(y).cast("double").alias("y"), "part")
    return (rows.where("part = 0").select(F.col("id").alias("qid"), "v"),
            rows.where("part = 1").select(F.col("id").alias("tid"), "v", "y"))


@query("knn_neighbours", f"SELECT qid, CAST(rank AS INTEGER) AS rank, tid FROM {NEAR_SQL} WHERE rank <= 5")
def knn_neighbours(spark, sf_dir):
    return knn.nearest(*_points(spark, sf_dir, "c_custkey"), 5).select("qid", "rank", "tid")


@query("knn_predict", f"SELECT qid, round(avg(y), 6) AS prediction FROM {NEAR_SQL} WHERE rank <= 5 GROUP BY qid")
def knn_predict(spark, sf_dir):
    """Small blocks, so that pivots prune and blocks are merged."""
    found = knn.nearest(*_points(spark, sf_dir, "c_custkey"), 5, block_rows=100)
    return knn.mean_of_neighbours(found).withColumn("prediction", F.round("prediction", 6))


@query("knn_vote", f"""
SELECT qid, seg AS prediction, n / 5 AS share FROM (SELECT qid, seg, count(*) AS n,
  row_number() OVER (PARTITION BY qid ORDER BY count(*) DESC, seg) AS rk FROM {NEAR_SQL} WHERE rank <= 5 GROUP BY 1, 2)
WHERE rk = 1""")
def knn_vote(spark, sf_dir):
    found = knn.nearest(*_points(spark, sf_dir, "seg"), 5)
    return knn.vote_of_neighbours(found, 5).select("qid", "prediction", F.array_max("probability").alias("share"))


# -- cross-validation and importance of the one-feature model ------------------------------------------
@query("cross_validation", f"""
WITH t AS (SELECT l_extendedprice AS y, l_quantity AS x, row_number() OVER (ORDER BY {_hash_sql(LINE_KEY_SQL, '42')})
    <= ceil(count(*) OVER () * 0.2) AS test, {LINE_KEY_SQL} AS k FROM lineitem),
f AS (SELECT *, ntile(3) OVER (ORDER BY {_hash_sql('k', '42f')}) AS fold FROM t WHERE NOT test),
m AS (SELECT g.i, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM f, (SELECT unnest([1, 2, 3]) AS i) g
      WHERE fold <> g.i GROUP BY g.i),
s AS (SELECT fold, 1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - a - b * x) ** 2)) AS rmse,
      avg(abs(y - a - b * x)) AS mae FROM f JOIN m ON fold = i GROUP BY fold)
SELECT 'linear regression' AS model, round(avg(r2), 5) AS r2, round(avg(rmse), 3) AS rmse, round(avg(mae), 3) AS mae FROM s""")
def cross_validation(spark, sf_dir):
    rows = _price_rows(spark, sf_dir)
    config = AnalysisConfig(cv_folds=3, models=LIGHT)
    prepared = cmp.PreparedRows(rows, None, rows.count())
    labelled, k = cmp.split_rows(prepared, config, C.REGRESSION, [])
    train = labelled.where("part = 1")
    preps = enc.fit_prep(train, ["quantity"], [], config, {f"{f}": F.col("fold") != f for f in range(k)})
    sizes = {r["fold"]: r["count"] for r in train.groupBy("fold").count().collect()}
    scores = cmp.cross_validate(labelled, k, preps, mo.regression_candidates()[:1], C.REGRESSION, CONTEXT, sizes)
    board = cmp.leaderboard_table(spark, scores, C.REGRESSION)
    return board.select("model", F.round("r2", 5).alias("r2"), F.round("rmse", 3).alias("rmse"), F.round("mae", 3).alias("mae"))


@query("permutation_importance", f"""
WITH t AS (SELECT l_extendedprice * (1 - l_discount) AS y, l_extendedprice AS x1, l_discount AS x2, {LINE_KEY_SQL} AS k FROM lineitem),
h AS (SELECT *, row_number() OVER (ORDER BY {_hash_sql('k', '42')}) <= ceil(count(*) OVER () * 0.2) AS test FROM t),
c AS (SELECT avg(y) AS my, avg(x1) AS m1, avg(x2) AS m2, covar_pop(y, x1) AS c1, covar_pop(y, x2) AS c2, var_pop(x1) AS v1, var_pop(x2) AS v2,
      covar_pop(x1, x2) AS v12 FROM h WHERE NOT test),
b AS (SELECT *, (c1 * v2 - c2 * v12) / (v1 * v2 - v12 ** 2) AS b1, (c2 * v1 - c1 * v12) / (v1 * v2 - v12 ** 2) AS b2 FROM c),
o AS (SELECT y, x1, x2, row_number() OVER (ORDER BY {_hash_sql('k', '42p')}) - 1 AS p, count(*) OVER () AS n FROM h WHERE test),
v AS (SELECT var_pop(y) * count(*) AS sst FROM o),
e AS (SELECT r, col, 1 - sum((o.y - my - b1 * (CASE WHEN col = 1 THEN d.x1 ELSE o.x1 END - m1) - b2 * (CASE WHEN col = 2 THEN d.x2 ELSE o.x2 END - m2)) ** 2)
      / any_value(sst) AS r2 FROM o, range(6) g(r), (VALUES (1), (2)) q(col), b, v, o AS d WHERE d.p = (o.p + r) % o.n GROUP BY r, col),
i AS (SELECT CASE col WHEN 1 THEN 'price' ELSE 'discount' END AS feature,
      greatest(0, (SELECT max(r2) FROM e WHERE r = 0) - avg(r2) FILTER (r > 0)) AS imp FROM e GROUP BY col)
SELECT feature, round(imp, 5) AS importance, round(imp / sum(imp) OVER () * 100, 1) AS importance_pct FROM i""")
def permutation(spark, sf_dir):
    """Revenue by price and discount: the model needs both."""
    rows = table(spark, sf_dir, "lineitem").select(
        sp.row_key(LINE_KEY).alias("_id"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("y"),
        F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"))
    parts = sp.holdout_split(rows, ["_id"], rows.count()).assign(rows, "part")
    train, test = parts.where("part = 1"), parts.where("part = 0")
    prep = enc.fit_prep(train, ["price", "discount"], [], AnalysisConfig())["all"]
    model = mo.regression_candidates()[0].fit(prep.transform(train), CONTEXT)
    out = permutation_importance(model, prep, test, {"price": "price", "discount": "discount"}, C.REGRESSION, test.count(), 42)
    return out.withColumns({"importance": F.round("importance", 5), "importance_pct": F.round("importance_pct", 1)})


@query("fallback_importance")
def fallback(spark, sf_dir):
    df = table(spark, sf_dir, "part").select(F.col("p_retailprice").alias("y"), "p_size", "p_brand", "p_type")
    prep = enc.fit_prep(df, ["p_size"], ["p_brand", "p_type"], AnalysisConfig())["all"]
    model = mo.regression_candidates()[3].fit(prep.transform(df), CONTEXT)
    return fallback_importance(spark, model, prep)


# -- whole comparisons ---------------------------------------------------------------------------------
def _compared(df: DataFrame, config: AnalysisConfig, task: str) -> cmp.ModelingResult:
    clean = clean_frame(df, profile_table(df, count_duplicate_rows=False), config)
    return cmp.run_comparison(cmp.prepare_rows(clean, config, task), config, task)


@query("automl_regression")
def automl_regression(spark, sf_dir):
    """Line prices by quantity, discount, flags and date: the first four candidates."""
    df = table(spark, sf_dir, "lineitem").drop("l_partkey", "l_suppkey")
    config = AnalysisConfig(target="l_extendedprice", exclude_columns=("l_orderkey",), cv_folds=2, max_models=4, models=LIGHT)
    return _compared(df, config, C.REGRESSION).leaderboard


@query("automl_classification")
def automl_classification(spark, sf_dir):
    """Is a customer in debt? Trees, boosting and neighbours by balance, nation and segment."""
    df = table(spark, sf_dir, "customer").withColumn("debt", F.when(F.col("c_acctbal") < 0, "yes").otherwise("no"))
    config = AnalysisConfig(target="debt", key_columns=("c_custkey",), cv_folds=2, max_models=7, models=LIGHT)
    return _compared(df, config, C.CLASSIFICATION).metrics


@query("automl_predictions")
def automl_predictions(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    config = AnalysisConfig(target="o_orderstatus", key_columns=("o_orderkey",), cv_folds=2, max_models=2, models=LIGHT,
                            compute_importance=False)
    return _compared(df, config, C.CLASSIFICATION).predictions


@query("analyze_explore")
def analyze_explore(spark, sf_dir):
    """A whole analysis without a target: all findings."""
    return analyze(table(spark, sf_dir, "events"), AnalysisConfig(), source_meta={"source": "events"}).findings


@query("analyze_report_index")
def analyze_report_index(spark, sf_dir):
    """A whole analysis with a target: the tables of its report."""
    from tablelens.plans.report import report_index
    config = AnalysisConfig(target="p_retailprice", key_columns=("p_partkey",), cv_folds=2, max_models=3, models=LIGHT)
    return report_index(spark, analyze(table(spark, sf_dir, "part"), config, source_meta={"source": "part"}).tables)


def _shown_category(name: str, ordinal: int) -> str:
    return f"""SELECT '{ordinal}' AS ordinal, '{name}' AS name, format('{{:,}}', count(DISTINCT {name})) AS n_unique,
  (SELECT {name} FROM orders WHERE {name} IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS top_value,
  format('{{:,}}', (SELECT count(*) FROM orders WHERE {name} IS NOT NULL GROUP BY {name} ORDER BY 1 DESC LIMIT 1)) AS top_freq,
  '0' AS missing_pct, false AS truncated FROM orders"""


@query("report_display", " UNION ALL ".join([_shown_category("o_orderstatus", 2), _shown_category("o_orderpriority", 5)]))
def report_display(spark, sf_dir):
    """The table of categories of a whole analysis, as it is read in the report."""
    return analyze(table(spark, sf_dir, "orders"), AnalysisConfig()).display["categorical"]


@query("analyze_path")
def analyze_csv(spark, sf_dir):
    """A whole analysis from delimited text: the findings on the loaded table."""
    from tablelens.plans.jobs import analyze_path

    from .source_queries import _written
    return analyze_path(spark, _written(spark, sf_dir, "customer", sep=";"), AnalysisConfig()).findings
