"""Chart data and findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens import config as C
from tablelens.functions.text import cell_text, shorten
from tablelens.operators import charts as ch
from tablelens.operators import findings as fi
from tablelens.operators import profile as prof
from tablelens.operators.correlation import top_correlations
from tablelens.operators.metrics import roc_auc, roc_curve
from tablelens.plans.report import display_table

from .evaluate_queries import CLASS_SQL, PRED_SQL, price_by_quantity, scored_lines, status_by_price
from .prepare_queries import _messy
from .profile_queries import GAPPY, GAPPY_SQL, TABLES, corr_sql, gappy_lineitem, profile_sql
from .registry import ORACLES, query, table


def _round(df: DataFrame, **digits: int) -> DataFrame:
    return df.select(*[
        (F.round(c, digits[c]) + F.lit(0.0)).alias(c) if c in digits else F.col(c) for c in df.columns])


def _profile(df: DataFrame) -> prof.TableProfile:
    return prof.profile_table(df, count_duplicate_rows=False)


# -- exploring -----------------------------------------------------------------------------------------
MESSY_MISSING_SQL = """SELECT 'price' AS name, count(*) FILTER (l_linenumber = 1) / count(*) AS r, 0 AS o FROM lineitem
  UNION ALL SELECT 'quantity', count(*) FILTER (l_linenumber = 7) / count(*), 1 FROM lineitem
  UNION ALL SELECT 'flag', count(*) FILTER (l_linestatus = 'F') / count(*), 4 FROM lineitem
  UNION ALL SELECT 'nothing', 1.0, 7"""


@query("missing_top", f"""
SELECT name, name AS label, round(r * 100, 4) AS missing_pct FROM ({MESSY_MISSING_SQL}) ORDER BY r DESC, o LIMIT 3""")
def missing_top(spark, sf_dir):
    return _round(ch.missing_chart(_profile(_messy(spark, sf_dir)).frame(), 3), missing_pct=4)


def histogram_sql(source: str, name: str, x: str) -> str:
    """Bins by comparing with the edges."""
    return f"""
SELECT '{name}' AS name, CAST(b AS INTEGER) AS bin, round(lo + b * step, 3) + 0.0 AS low,
  round(CASE WHEN b = bins - 1 THEN hi ELSE lo + (b + 1) * step END, 3) + 0.0 AS high,
  (SELECT count(*) FROM {source} WHERE {x} >= lo + b * step AND ({x} < lo + (b + 1) * step OR b = bins - 1)) AS n
FROM (SELECT *, (hi - lo) / bins AS step FROM (SELECT min({x}) AS lo, max({x}) AS hi,
  CAST(least(40, greatest(10, floor(sqrt(count({x}))))) AS BIGINT) AS bins FROM {source})), range(40) r(b) WHERE b < bins"""


EVENT_NUMBERS = ("event_id", "user_id", "value")


def _enough_values(name: str) -> str:
    """Integers with few distinct values are categories, not numbers."""
    return f"(SELECT count(DISTINCT {name}) FROM events) > 20"


@query("histograms", "\nUNION ALL\n".join(
    f"SELECT *, (SELECT round(median({n}), 3) FROM events) AS median FROM (" +
    histogram_sql("events", n, f"CAST({n} AS DOUBLE)") + f" AND {_enough_values(n)})" for n in EVENT_NUMBERS))
def histograms(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return _round(ch.numeric_histograms(df, _profile(df)), low=3, high=3, median=3)


@query("target_distribution_numeric", histogram_sql("orders", "o_totalprice", "o_totalprice"))
def target_distribution_numeric(spark, sf_dir):
    return _round(ch.target_distribution(table(spark, sf_dir, "orders"), "o_totalprice", C.REGRESSION), low=3, high=3)


@query("target_distribution_classes", """
WITH k AS (SELECT p_name AS label, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, label LIMIT 20)
SELECT CAST(row_number() OVER (ORDER BY n DESC, label) AS INTEGER) AS rank, label, n,
  round(n / sum(n) OVER (), 6) AS share, round(max(n) OVER () / min(n) OVER (), 6) AS max_min_ratio,
  CAST(0 AS BIGINT) AS n_missing FROM k""")
def target_distribution_classes(spark, sf_dir):
    return _round(ch.target_distribution(table(spark, sf_dir, "part"), "p_name", C.CLASSIFICATION), share=6, max_min_ratio=6)


def box_sql(source: str, ordinal: int, name: str) -> str:
    x = f"CAST({name} AS DOUBLE)"
    return f"""
SELECT {ordinal} AS ordinal, '{name}' AS name, round((q1 - m) / s, 5) + 0.0 AS q1, round((q2 - m) / s, 5) + 0.0 AS median,
  round((q3 - m) / s, 5) + 0.0 AS q3,
  round(((SELECT least(min({x}), q1) FROM {source} WHERE {x} >= q1 - 1.5 * (q3 - q1)) - m) / s, 5) + 0.0 AS low_whisker,
  round(((SELECT greatest(max({x}), q3) FROM {source} WHERE {x} <= q3 + 1.5 * (q3 - q1)) - m) / s, 5) + 0.0 AS high_whisker,
  (SELECT count(*) FROM {source} WHERE {x} < q1 - 1.5 * (q3 - q1) OR {x} > q3 + 1.5 * (q3 - q1)) AS n_beyond
FROM (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3,
  avg({x}) AS m, stddev_pop({x}) AS s FROM {source})"""


@query("box_stats", box_sql("documents", 0, "doc_id") + "\nUNION ALL\n" + box_sql("documents", 4, "n_chars"))
def box_stats(spark, sf_dir):
    df = table(spark, sf_dir, "documents")
    z = ("q1", "median", "q3", "low_whisker", "high_whisker")
    return _round(ch.box_stats(df, _profile(df)), **dict.fromkeys(z, 5))


@query("target_by_category", """
SELECT * FROM (SELECT 0 AS chart, 'p_name' AS name, p_name AS label, round(avg(p_retailprice), 4) AS mean,
  round((SELECT avg(p_retailprice) FROM part), 4) AS overall FROM part GROUP BY p_name
  ORDER BY avg(p_retailprice) DESC, p_name LIMIT 12)
UNION ALL SELECT * FROM (SELECT 1, 'p_brand', p_brand, round(avg(p_retailprice), 4),
  round((SELECT avg(p_retailprice) FROM part), 4) FROM part GROUP BY p_brand
  ORDER BY avg(p_retailprice) DESC, p_brand LIMIT 12)""")
def target_by_category(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    return _round(ch.target_by_category(df, "p_retailprice", ["p_name", "p_brand", "p_type"]), mean=4, overall=4)


# -- modelling -----------------------------------------------------------------------------------------
# A leaderboard over predictors of the price: means per quantity, per flag, per line number.
PREDICTORS = ("l_quantity", "l_returnflag", "l_linenumber")


def _r2_sql(c: str) -> str:
    return (f"SELECT '{c}' AS model, round(1 - sum((l_extendedprice - p) ** 2) / (var_pop(l_extendedprice) * count(*)), 6) "
            f"AS r2 FROM lineitem JOIN (SELECT {c} AS k, avg(l_extendedprice) AS p FROM lineitem GROUP BY 1) ON {c} = k")


def _leaderboard(spark, sf_dir) -> DataFrame:
    from tablelens.operators.compare import CandidateScore, leaderboard_table
    from tablelens.operators.metrics import regression_metrics
    from tablelens.operators.models import Candidate

    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", *PREDICTORS)
    scores = []
    for i, c in enumerate(PREDICTORS):
        means = df.groupBy(c).agg(F.avg("l_extendedprice").alias("prediction"))
        m = regression_metrics(df.join(means, c), None, "l_extendedprice").first().asDict()
        scores.append(CandidateScore(Candidate(c, False, None), i, [m]))
    return leaderboard_table(spark, scores, C.REGRESSION)


LEADERBOARD_SQL = " UNION ALL ".join(_r2_sql(c) for c in PREDICTORS)


@query("leaderboard", f"""
SELECT CAST(row_number() OVER (ORDER BY r2 DESC) AS INTEGER) AS rank, model, round(r2, 4) AS r2 FROM ({LEADERBOARD_SQL})""")
def leaderboard(spark, sf_dir):
    from tablelens.operators.compare import leaderboard_display
    return leaderboard_display(_leaderboard(spark, sf_dir)).select("rank", "model", "r2")


@query("model_comparison", f"""
SELECT CASE WHEN length(model) > 18 THEN left(model, 17) || '…' ELSE model END AS model, round(r2, 4) AS value,
  r2 = max(r2) OVER () AS best FROM ({LEADERBOARD_SQL})""")
def model_comparison(spark, sf_dir):
    return _round(ch.model_comparison(_leaderboard(spark, sf_dir), "r2"), value=4)


IMPORTANCE_SQL = """SELECT event_type AS feature, greatest(0.0, round(avg(value) - (SELECT avg(value) FROM events), 6)) AS imp
  FROM events GROUP BY 1"""


def _importance(spark, sf_dir) -> DataFrame:
    """Event types weighted by how far their mean value exceeds the overall one."""
    from tablelens.operators.importance import importance_table
    df = table(spark, sf_dir, "events")
    overall = df.agg(F.avg("value")).first()[0]
    means = df.groupBy("event_type").agg((F.avg("value") - F.lit(overall)).alias("v")).orderBy("event_type").collect()
    return importance_table(spark, [(r["event_type"], max(0.0, r["v"])) for r in means])


@query("importance_chart", f"""
SELECT feature, feature AS label, round(imp, 5) AS importance, round(imp / sum(imp) OVER () * 100, 1) AS importance_pct,
  (SELECT count(*) FROM ({IMPORTANCE_SQL}) WHERE imp = 0) AS n_zero FROM ({IMPORTANCE_SQL}) WHERE imp > 0""")
def importance_chart(spark, sf_dir):
    return _round(ch.importance_chart(_importance(spark, sf_dir)), importance=5, importance_pct=1)


@query("confusion_chart", f"""
SELECT y AS actual, prediction AS predicted, count(*) AS n FROM {CLASS_SQL} GROUP BY 1, 2""")
def confusion_chart(spark, sf_dir):
    from tablelens.operators.encode import fit_labels
    from tablelens.operators.metrics import confusion_matrix
    rows = status_by_price(spark, sf_dir)
    codes = fit_labels(rows, "y").table
    code = {r["level"]: float(r["code"]) for r in codes.collect()}
    numbered = F.create_map(*[F.lit(v) for item in code.items() for v in item])
    coded = rows.select(numbered[F.col("y")].alias("y"), numbered[F.col("prediction")].alias("prediction"))
    return ch.confusion_chart(confusion_matrix(coded), codes)


@query("roc_chart", f"SELECT threshold, fpr, tpr, auc FROM ({ORACLES['roc_curve']}) r, ({ORACLES['roc_auc']}) a")
def roc_chart(spark, sf_dir):
    rows = scored_lines(spark, sf_dir)
    return _round(ch.roc_chart(roc_curve(rows), roc_auc(rows).first()["auc"]), fpr=8, tpr=8, auc=8)


@query("actual_vs_predicted", f"""
SELECT round(y, 4) AS actual, round(prediction, 4) AS predicted FROM {PRED_SQL}""")
def actual_vs_predicted(spark, sf_dir):
    return _round(ch.actual_vs_predicted(price_by_quantity(spark, sf_dir)), actual=4, predicted=4)


@query("actual_vs_predicted_grid", f"""
WITH t AS (SELECT * FROM {PRED_SQL}), r AS (SELECT least(min(y), min(prediction)) AS lo,
  greatest(max(y), max(prediction)) AS hi FROM t)
SELECT CAST(least(floor((y - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS actual_bin,
  CAST(least(floor((prediction - lo) / ((hi - lo) / 40)), 39) AS INTEGER) AS predicted_bin, count(*) AS n FROM t, r GROUP BY 1, 2""")
def actual_vs_predicted_grid(spark, sf_dir):
    return ch.actual_vs_predicted_grid(price_by_quantity(spark, sf_dir))


@query("identity_range", f"""
SELECT round(least(min(y), min(prediction)), 4) AS low, round(greatest(max(y), max(prediction)), 4) AS high FROM {PRED_SQL}""")
def identity_range(spark, sf_dir):
    low, high = ch.identity_range(price_by_quantity(spark, sf_dir))
    return spark.createDataFrame([(round(low, 4), round(high, 4))], "low double, high double")


@query("residual_histogram", histogram_sql(f"(SELECT y - prediction AS e FROM {PRED_SQL})", "residual", "e"))
def residual_histogram(spark, sf_dir):
    return _round(ch.residual_histogram(price_by_quantity(spark, sf_dir)), low=3, high=3)


@query("shortened_labels", """
SELECT c_custkey, CASE WHEN length(c_name || '/' || c_mktsegment) > 22
  THEN left(c_name || '/' || c_mktsegment, 21) || '…' ELSE c_name || '/' || c_mktsegment END AS label FROM customer""")
def shortened_labels(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", shorten(F.concat_ws("/", "c_name", "c_mktsegment")).alias("label"))


@query("display_table", """
SELECT format('{:,}', o_orderkey) AS o_orderkey, o_orderstatus, true AS truncated FROM orders ORDER BY orders.o_orderkey LIMIT 40""")
def display(spark, sf_dir):
    return display_table(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), order_by=["o_orderkey"])


@query("cell_text", """
SELECT p_partkey, CASE WHEN x = floor(x) THEN format('{:,}', CAST(x AS BIGINT)) ELSE format('{:.4g}', x) END AS text
FROM (SELECT p_partkey, p_retailprice / 7 AS x FROM part)""")
def cell_texts(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", cell_text(F.col("p_retailprice") / 7).alias("text"))


# -- findings ------------------------------------------------------------------------------------------
def _bare(df: DataFrame, digits: int = 4) -> DataFrame:
    return _round(df.select("section", "ord", "rule_id", "subject", "value", "n"), value=digits)


@query("findings_data", f"""
WITH m AS ({MESSY_MISSING_SQL}), o AS (
  SELECT name, outlier_ratio, n_outliers FROM ({profile_sql('documents', TABLES['documents'])}) WHERE outlier_ratio > 0.05)
SELECT 'messy' AS section, 0 AS ord, 'size' AS rule_id, 'lineitem' AS subject, 9.0 AS value, (SELECT count(*) FROM lineitem) AS n
UNION ALL SELECT 'messy', 1, 'type_mix', CASE WHEN (SELECT count(DISTINCT l_suppkey) FROM lineitem) > 20 THEN '5 numeric, 2'
  ELSE '4 numeric, 3' END || ' categorical, 1 datetime, 1 text', NULL, NULL
UNION ALL SELECT 'messy', 2, 'missing', 'nothing', 1.0, 4
UNION ALL SELECT 'documents', 0, 'size', 'documents', 5.0, (SELECT count(*) FROM documents)
UNION ALL SELECT 'documents', 1, 'type_mix', '2 numeric, 2 categorical, 0 datetime, 1 text', NULL, NULL
UNION ALL SELECT 'documents', 2, 'no_missing', '', NULL, NULL
UNION ALL SELECT 'documents', 3, 'outliers', name, round(outlier_ratio, 4), n_outliers FROM o""")
def findings_data(spark, sf_dir):
    messy = _profile(_messy(spark, sf_dir))
    documents = _profile(table(spark, sf_dir, "documents"))
    found = fi.data_findings(messy, "lineitem")
    keep = [f for f in found if f.rule_id != "outliers"]
    return _bare(fi.findings_table(spark, {"messy": keep, "documents": fi.data_findings(documents, "documents")}))


@query("findings_correlation", f"""
WITH c AS ({corr_sql(GAPPY[:-1], GAPPY_SQL)}), p AS (SELECT var1, var2, round(corr, 4) AS r FROM c
  WHERE ord1 < ord2 AND corr IS NOT NULL ORDER BY abs(round(corr, 4)) DESC, ord1, ord2 LIMIT 3)
SELECT 'correlation' AS section, 0 AS ord, 'strongest_pair' AS rule_id,
  '''' || var1 || ''' and ''' || var2 || '''' AS subject, r AS value, CAST(NULL AS BIGINT) AS n
FROM (SELECT * FROM p ORDER BY abs(r) DESC LIMIT 1)
UNION ALL SELECT 'correlation', 1, 'collinear', '', NULL, count(*) FILTER (abs(r) >= 0.85) FROM p HAVING max(abs(r)) >= 0.85
UNION ALL SELECT 'correlation', 1, 'weak_correlation', '', max(abs(r)), NULL FROM p HAVING max(abs(r)) < 0.3""")
def findings_correlation(spark, sf_dir):
    p = _profile(gappy_lineitem(spark, sf_dir).drop("flat"))
    return _bare(fi.findings_table(spark, {"correlation": fi.correlation_findings(p)}))


@query("findings_advice", """
SELECT 'advice' AS section, 0 AS ord, 'few_rows' AS rule_id, '' AS subject, CAST(NULL AS DOUBLE) AS value, count(*) AS n
FROM supplier HAVING count(*) < 500
UNION ALL SELECT 'advice', CASE WHEN (SELECT count(*) FROM supplier) < 500 THEN 1 ELSE 0 END, 'choose_target', '', NULL, NULL
UNION ALL SELECT 'advice', CASE WHEN (SELECT count(*) FROM supplier) < 500 THEN 2 ELSE 1 END, 'causality', '', NULL, NULL""")
def findings_advice(spark, sf_dir):
    return _bare(fi.findings_table(spark, {"advice": fi.advice_findings(_profile(table(spark, sf_dir, "supplier")), None)}))


@query("findings_worst_class", f"""
SELECT y AS level, round(count(*) FILTER (y = prediction) / count(*), 6) AS recall FROM {CLASS_SQL} GROUP BY y
ORDER BY count(*) FILTER (y = prediction) / count(*), y LIMIT 1""")
def findings_worst_class(spark, sf_dir):
    from tablelens.operators.encode import fit_labels, label_encode
    from tablelens.operators.metrics import confusion_matrix
    rows = status_by_price(spark, sf_dir)
    codes = fit_labels(rows, "y")
    coded = label_encode(label_encode(rows, "y", codes, "a"), "prediction", codes, "b")
    worst = fi.worst_class(confusion_matrix(coded, "a", "b"), codes.table)
    return spark.createDataFrame([(worst.subject, round(worst.value, 6))], "level string, recall double")


@query("findings_importance", f"""
WITH i AS (SELECT feature, round(imp / sum(imp) OVER () * 100, 2) AS pct, row_number() OVER (ORDER BY imp DESC, feature) AS rk
  FROM ({IMPORTANCE_SQL})), s AS (SELECT sum(pct) FILTER (rk <= 5) AS share, count(*) FILTER (pct < 0.5) AS low,
  least(count(*), 5) AS top FROM i)
SELECT 'importance' AS section, CAST(rk - 1 AS INTEGER) AS ord, 'driver' AS rule_id, feature AS subject,
  round(pct, 1) AS value, rk AS n FROM i WHERE rk <= 5
UNION ALL SELECT 'importance', CAST(top AS INTEGER), 'concentrated', '', round(share, 1), top FROM s WHERE share >= 80
UNION ALL SELECT 'importance', CAST(top AS INTEGER), 'spread_out', '', round(share, 1), top FROM s WHERE share <= 40
UNION ALL SELECT 'importance', CAST(top + CASE WHEN share >= 80 OR share <= 40 THEN 1 ELSE 0 END AS INTEGER), 'negligible',
  '', NULL, low FROM s WHERE low >= 3""")
def findings_importance(spark, sf_dir):
    found = fi.importance_findings(_importance(spark, sf_dir))
    return _bare(fi.findings_table(spark, {"importance": found}), 1)


@query("findings_summary", """
SELECT 'summary' AS section, 0 AS ord, 'summary_size' AS rule_id, 'customer' AS subject, CAST(5 AS DOUBLE) AS value, count(*) AS n FROM customer
UNION ALL SELECT 'summary', 1, 'summary_no_model', '', NULL, NULL""")
def findings_summary(spark, sf_dir):
    p = _profile(table(spark, sf_dir, "customer"))
    return _bare(fi.findings_table(spark, {"summary": fi.executive_summary(p, "customer", None)}))


@query("strongest_pairs", f"""
SELECT var1, var2, round(corr, 4) + 0.0 AS corr FROM ({corr_sql(list(EVENT_NUMBERS), 'events')})
WHERE ord1 < ord2 AND corr IS NOT NULL AND ({_enough_values('user_id')} OR 'user_id' NOT IN (var1, var2))
ORDER BY abs(round(corr, 4)) DESC, ord1, ord2 LIMIT 15""")
def strongest_pairs(spark, sf_dir):
    return _round(top_correlations(_profile(table(spark, sf_dir, "events")).correlation()), corr=4)


@query("findings_modeling", f"""
WITH m AS (SELECT 1 - sum((y - prediction) ** 2) / (var_pop(y) * count(*)) AS r2, sqrt(avg((y - prediction) ** 2)) AS rmse,
  avg(abs(y - prediction)) AS mae, count(*) AS n FROM {PRED_SQL})
SELECT 'modeling' AS section, 0 AS ord, 'task' AS rule_id, 'l_extendedprice' AS subject, CAST(NULL AS DOUBLE) AS value, 3 AS n FROM m
UNION ALL SELECT 'modeling', 1, 'best_model', 'l_quantity', n, n FROM m
UNION ALL SELECT 'modeling', 2, 'rmse', '', round(rmse, 4), NULL FROM m
UNION ALL SELECT 'modeling', 3, 'mae', '', round(mae, 4), NULL FROM m
UNION ALL SELECT 'modeling', 4, CASE WHEN r2 >= 0.8 THEN 'fit_high' WHEN r2 >= 0.5 THEN 'fit_medium'
  WHEN r2 >= 0.2 THEN 'fit_low' ELSE 'fit_none' END, '', round(r2, 4), NULL FROM m""")
def findings_modeling(spark, sf_dir):
    """The verdict on predicting the price by its mean per quantity."""
    from tablelens.operators.compare import ModelingResult
    from tablelens.operators.metrics import REGRESSION_METRICS, regression_metrics
    rows = price_by_quantity(spark, sf_dir)
    n = rows.count()
    metrics = regression_metrics(rows).unpivot([], list(REGRESSION_METRICS), "metric", "value")
    result = ModelingResult(C.REGRESSION, "l_extendedprice", "l_quantity", None, None, _leaderboard(spark, sf_dir), metrics,
                            None, rows, n, n)
    return _bare(fi.findings_table(spark, {"modeling": fi.modeling_findings(result)}))
