"""Cleaning, imputation, encoding and scaling."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.config import AnalysisConfig
from tablelens.operators import clean as cl
from tablelens.operators import encode as enc
from tablelens.operators.profile import profile_table

from .profile_queries import GAPPY_SQL, gappy_lineitem
from .registry import query, table

# -- single cleaning operators -------------------------------------------------------------------------
@query("winsorize", """
WITH q AS (SELECT quantile_cont(CAST(n_chars AS DOUBLE), 0.25) AS q1, quantile_cont(CAST(n_chars AS DOUBLE), 0.75) AS q3
           FROM documents)
SELECT doc_id, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), CAST(n_chars AS DOUBLE))) AS n_chars
FROM documents, q""")
def winsorize(spark, sf_dir):
    df = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return cl.apply_winsor(df, cl.fit_winsor(df, ["n_chars"]))


@query("datetime_parts", """
SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS o_orderdate_year, CAST(month(o_orderdate) AS DOUBLE) AS
  o_orderdate_month, CAST(day(o_orderdate) AS DOUBLE) AS o_orderdate_day,
  CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS o_orderdate_weekday FROM orders""")
def datetime_parts(spark, sf_dir):
    return cl.expand_dates(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@query("datetime_parts_text", """
SELECT o_orderkey, CAST(year(o_orderdate) AS DOUBLE) AS d_year, CAST(month(o_orderdate) AS DOUBLE) AS d_month,
  CAST(day(o_orderdate) AS DOUBLE) AS d_day, CAST(isodow(o_orderdate) - 1 AS DOUBLE) AS d_weekday FROM orders""")
def datetime_parts_text(spark, sf_dir):
    """Dates written in five layouts, one per order priority."""
    day = F.col("o_orderdate")
    text = (
        F.when(F.col("o_orderpriority").startswith("1"), F.date_format(day, "yyyy-MM-dd HH:mm:ss"))
        .when(F.col("o_orderpriority").startswith("2"), F.date_format(day, "yyyy/M/d"))
        .when(F.col("o_orderpriority").startswith("3"), F.date_format(day, "yyyyMMdd"))
        .when(F.col("o_orderpriority").startswith("4"), F.date_format(day, "MM/dd/yyyy"))
        .otherwise(F.concat(F.year(day), F.lit("년 "), F.month(day), F.lit("월 "), F.dayofmonth(day), F.lit("일")))
    )
    return cl.expand_dates(table(spark, sf_dir, "orders").select("o_orderkey", text.alias("d")), ["d"])


@query("missing_plan", f"""
SELECT 'quantity' AS name, 'median' AS fill, count(*) FILTER (quantity IS NULL) AS n_missing FROM {GAPPY_SQL}
UNION ALL SELECT 'discount', 'median', count(*) FILTER (discount IS NULL) FROM {GAPPY_SQL}""")
def missing_plan(spark, sf_dir):
    return cl.missing_plan(gappy_lineitem(spark, sf_dir), ["quantity", "discount", "l_tax"], [], AnalysisConfig())


def _gappy_keyed(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"),
        F.when(F.col("l_linestatus") != "F", F.col("l_returnflag")).alias("flag"))


GAPPY_KEYED_SQL = """(SELECT l_orderkey, l_linenumber,
  CASE WHEN l_linenumber <> 7 THEN l_quantity END AS quantity, nullif(l_discount, 0.0) AS discount,
  CASE WHEN l_linestatus <> 'F' THEN l_returnflag END AS flag FROM lineitem)"""


def _filled(df: DataFrame, config: AnalysisConfig, numeric: list[str], categorical: list[str]) -> DataFrame:
    prep = enc.fit_prep(df, numeric, categorical, config)["all"]
    fill = {n: c.fill for n, c in (prep.numbers | prep.categories).items()}
    return df.select(*[F.round(F.coalesce(n, F.lit(fill[n])), 6).alias(n) if n in numeric else
                       F.coalesce(n, F.lit(fill[n])).alias(n) if n in categorical else n for n in df.columns])


for _name, _sql in (("median", "quantile_cont({c}, 0.5)"), ("mean", "avg({c})"), ("constant", "0.0")):
    def _run(spark, sf_dir, how=_name):
        df = _gappy_keyed(spark, sf_dir).drop("flag")
        return _filled(df, AnalysisConfig(numeric_impute=how), ["quantity", "discount"], [])

    query(f"impute_{_name}", f"""
SELECT l_orderkey, l_linenumber, round(coalesce(quantity, fq), 6) AS quantity, round(coalesce(discount, fd), 6) AS discount
FROM {GAPPY_KEYED_SQL}, (SELECT {_sql.format(c='quantity')} AS fq, {_sql.format(c='discount')} AS fd
  FROM {GAPPY_KEYED_SQL} LIMIT 1)""")(_run)


@query("impute_mode", f"""
SELECT l_orderkey, l_linenumber, coalesce(flag, m) AS flag FROM {GAPPY_KEYED_SQL},
  (SELECT flag AS m FROM {GAPPY_KEYED_SQL} WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, flag LIMIT 1)""")
def impute_mode(spark, sf_dir):
    df = _gappy_keyed(spark, sf_dir).select("l_orderkey", "l_linenumber", "flag")
    return _filled(df, AnalysisConfig(), [], ["flag"])


@query("impute_category_constant", f"""
SELECT l_orderkey, l_linenumber, coalesce(flag, '미상') AS flag FROM {GAPPY_KEYED_SQL}""")
def impute_category_constant(spark, sf_dir):
    df = _gappy_keyed(spark, sf_dir).select("l_orderkey", "l_linenumber", "flag")
    return _filled(df, AnalysisConfig(categorical_impute="constant"), [], ["flag"])


# -- encoding ------------------------------------------------------------------------------------------
TAGGED_SQL = """(SELECT o_orderkey, o_orderdate < TIMESTAMP '1997-01-01' AS train,
  CASE WHEN o_totalprice > 498000 THEN 'rush' ELSE o_orderstatus || '-' || year(o_orderdate) END AS tag FROM orders)"""


def _tagged(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", (F.col("o_orderdate") < F.to_timestamp_ntz(F.lit("1997-01-01 00:00:00"))).alias("train"),
        F.when(F.col("o_totalprice") > 498000, F.lit("rush"))
        .otherwise(F.concat_ws("-", "o_orderstatus", F.year("o_orderdate"))).alias("tag"))


@query("onehot_rare", f"""
WITH t AS {TAGGED_SQL}, lv AS (
  SELECT tag, cnt < 0.01 * sum(cnt) OVER () AS rare FROM (SELECT tag, count(*) AS cnt FROM t WHERE train GROUP BY 1))
SELECT o_orderkey, CASE WHEN lv.tag IS NOT NULL AND NOT rare THEN t.tag
  WHEN (SELECT bool_or(rare) FROM lv) THEN '(rare)' ELSE '(none)' END AS hot,
  CASE WHEN lv.tag IS NOT NULL OR (SELECT bool_or(rare) FROM lv) THEN CAST(1 AS DOUBLE) ELSE 0 END AS total
FROM t LEFT JOIN lv ON t.tag = lv.tag""")
def onehot_rare(spark, sf_dir):
    """Fitted on the orders before 1997; the tags of later years are unknown and share the rare column."""
    df = _tagged(spark, sf_dir)
    prep = enc.fit_prep(df, [], ["tag"], AnalysisConfig(), {"train": F.col("train")})["train"]
    names = F.array(*[F.lit(n.split("=", 1)[1]) for n in prep.feature_names])
    hot = vector_to_array("features")
    return prep.transform(df).select(
        "o_orderkey",
        F.coalesce(F.try_element_at(names, F.array_position(hot, F.lit(1.0)).cast("int")), F.lit("(none)")).alias("hot"),
        F.aggregate(hot, F.lit(0.0), lambda a, b: a + b).alias("total"))


@query("ordinal_encode", """
WITH t AS (SELECT l_orderkey, l_linenumber, l_shipdate < TIMESTAMP '1998-01-01' AS train,
  strftime(l_shipdate, '%Y-%m') AS month FROM lineitem),
lv AS (SELECT month, row_number() OVER (ORDER BY month) - 1 AS code FROM (SELECT DISTINCT month FROM t WHERE train))
SELECT l_orderkey, l_linenumber, CAST(coalesce(code, -1) AS DOUBLE) AS code FROM t LEFT JOIN lv ON t.month = lv.month""")
def ordinal_encode(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", (F.col("l_shipdate") < F.to_timestamp_ntz(F.lit("1998-01-01 00:00:00"))).alias("train"),
        F.date_format("l_shipdate", "yyyy-MM").alias("month"))
    prep = enc.fit_prep(df, [], ["month"], AnalysisConfig(), {"train": F.col("train")})["train"]
    return prep.transform(df).select("l_orderkey", "l_linenumber", vector_to_array("features")[0].alias("code"))


@query("cardinality_routing", """
SELECT name, CASE WHEN n <= 30 THEN 'onehot' ELSE 'ordinal' END AS kind FROM (
  SELECT 'p_brand' AS name, count(DISTINCT p_brand) AS n FROM part
  UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part
  UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)""")
def cardinality_routing(spark, sf_dir):
    names = ["p_brand", "p_name", "p_type"]
    codes = enc.fit_prep(table(spark, sf_dir, "part"), [], names, AnalysisConfig())["all"].categories
    kinds = [(n, "onehot" if isinstance(c, enc.OneHotCoding) else "ordinal") for n, c in codes.items()]
    return spark.createDataFrame(kinds, "name string, kind string")


def _scaled(spark, sf_dir, scaling: str) -> DataFrame:
    names = ["p_size", "p_retailprice", "flat"]
    df = table(spark, sf_dir, "part").select(
        "p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice", F.lit(7.0).alias("flat"))
    prep = enc.fit_prep(df, names, [], AnalysisConfig(scaling=scaling))["all"]
    return df.select("p_partkey", *[
        (F.round(enc.number_feature(F.col(n), prep.numbers[n]), 6) + F.lit(0.0)).alias(n) for n in names])


@query("scale_standard", """
SELECT p_partkey, round((p_size - m1) / s1, 6) + 0.0 AS p_size, round((p_retailprice - m2) / s2, 6) + 0.0 AS p_retailprice,
  CAST(0 AS DOUBLE) AS flat FROM part, (SELECT avg(p_size) AS m1, stddev_pop(p_size) AS s1, avg(p_retailprice) AS m2,
  stddev_pop(p_retailprice) AS s2 FROM part)""")
def scale_standard(spark, sf_dir):
    return _scaled(spark, sf_dir, "standard")


@query("scale_minmax", """
SELECT p_partkey, round((p_size - a1) / (b1 - a1), 6) + 0.0 AS p_size,
  round((p_retailprice - a2) / (b2 - a2), 6) + 0.0 AS p_retailprice, CAST(0 AS DOUBLE) AS flat
FROM part, (SELECT min(p_size) AS a1, max(p_size) AS b1, min(p_retailprice) AS a2, max(p_retailprice) AS b2 FROM part)""")
def scale_minmax(spark, sf_dir):
    return _scaled(spark, sf_dir, "minmax")


@query("label_encode", """
SELECT o_orderkey, CAST(y AS DOUBLE) AS y FROM orders JOIN
  (SELECT o_orderpriority AS p, row_number() OVER (ORDER BY o_orderpriority) - 1 AS y
   FROM (SELECT DISTINCT o_orderpriority FROM orders)) ON o_orderpriority = p""")
def label_encode(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    return enc.label_encode(df, "o_orderpriority", enc.fit_labels(df, "o_orderpriority")).select("o_orderkey", "y")


@query("class_labels", """
SELECT event_type AS level, count(*) AS cnt, row_number() OVER (ORDER BY event_type) - 1 AS code
FROM events GROUP BY event_type""")
def class_labels(spark, sf_dir):
    return enc.fit_labels(table(spark, sf_dir, "events"), "event_type").table


@query("prepared_vector", """
WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS d FROM part),
lv AS (SELECT p_type, count(*) AS cnt FROM part GROUP BY 1)
SELECT 'p_size' AS feature, round(avg(((p_size - m) / d) * ((p_size - m) / d)), 4) AS mean_square, count(*) AS n FROM part, s
UNION ALL SELECT 'p_type=' || p_type, round(cnt / (SELECT count(*) FROM part), 4), (SELECT count(*) FROM part) FROM lv
UNION ALL SELECT 'p_name', round(avg(code * code), 4), count(*) FROM part JOIN (SELECT p_name AS nm,
  CAST(row_number() OVER (ORDER BY p_name) - 1 AS DOUBLE) AS code FROM (SELECT DISTINCT p_name FROM part)) ON p_name = nm""")
def prepared_vector(spark, sf_dir):
    """The pipeline stage end to end: mean square and count of every encoded feature."""
    df = table(spark, sf_dir, "part")
    model = enc.TablePrep(["p_size"], ["p_type", "p_name"], AnalysisConfig()).fit(df)
    names = F.array(*[F.lit(n) for n in model.prep.feature_names])
    cells = model.transform(df).select(F.posexplode(vector_to_array("features")))
    return cells.groupBy(names[F.col("pos")].alias("feature")).agg(
        F.round(F.avg(F.col("col") * F.col("col")), 4).alias("mean_square"), F.count("*").alias("n"))


# -- whole cleaning ------------------------------------------------------------------------------------
def _messy(spark, sf_dir) -> DataFrame:
    """Gaps in features and target, a constant, an all-missing column, a skewed column, a date."""
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 1, F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity"),
        F.pow("l_quantity", F.lit(4.0)).alias("skewed"),
        F.concat(F.floor(F.col("l_partkey") / 1000).cast("string"), F.lit(","),
                 F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0")).alias("part_text"),
        F.when(F.col("l_linestatus") != "F", F.col("l_returnflag")).alias("flag"),
        F.col("l_shipdate").alias("shipped"), F.lit("same").alias("flat"), F.lit(None).cast("double").alias("nothing"),
        F.col("l_suppkey").alias("supplier"))


MESSY_SQL = """(SELECT CASE WHEN l_linenumber <> 1 THEN l_extendedprice END AS price,
  CASE WHEN l_linenumber <> 7 THEN l_quantity END AS quantity, pow(l_quantity, 4.0) AS skewed,
  CAST(l_partkey AS DOUBLE) AS part_text, CASE WHEN l_linestatus <> 'F' THEN l_returnflag END AS flag,
  l_shipdate AS shipped, CAST(l_suppkey AS DOUBLE) AS supplier FROM lineitem WHERE l_linenumber <> 1)"""
MESSY_CONFIG = AnalysisConfig(target="price", exclude_columns=("supplier",))


def _clean_messy(spark, sf_dir) -> cl.CleanTable:
    df = _messy(spark, sf_dir)
    return cl.clean_frame(df, profile_table(df, count_duplicate_rows=False), MESSY_CONFIG)


@query("clean_frame", f"""
WITH t AS {MESSY_SQL}, q AS (SELECT quantile_cont(skewed, 0.25) AS q1, quantile_cont(skewed, 0.75) AS q3 FROM t)
SELECT price, quantity, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), skewed)) AS skewed, part_text,
  CAST(year(shipped) AS DOUBLE) AS shipped_year, CAST(month(shipped) AS DOUBLE) AS shipped_month,
  CAST(day(shipped) AS DOUBLE) AS shipped_day, CAST(isodow(shipped) - 1 AS DOUBLE) AS shipped_weekday, flag FROM t, q""")
def clean_frame(spark, sf_dir):
    return _clean_messy(spark, sf_dir).df


@query("prep_log", f"""
WITH t AS {MESSY_SQL}, q AS (SELECT quantile_cont(skewed, 0.25) AS q1, quantile_cont(skewed, 0.75) AS q3 FROM t)
SELECT * FROM (
  SELECT 0 AS ord, 'drop column' AS step, 'flat' AS target, 'excluded automatically (single value)' AS detail, CAST(NULL AS BIGINT) AS n
  UNION ALL SELECT 1, 'drop column', 'nothing', 'excluded automatically (too many missing values)', NULL
  UNION ALL SELECT 2, 'drop column', 'supplier', 'excluded by the user', NULL
  UNION ALL SELECT 3, 'convert type', 'part_text', 'text to number', NULL
  UNION ALL SELECT 4, 'date parts', 'shipped', 'year, month, day and weekday', NULL
  UNION ALL SELECT 5, 'outliers', 'skewed', 'moved onto the IQR limits',
    count(*) FILTER (skewed < q1 - 1.5 * (q3 - q1) OR skewed > q3 + 1.5 * (q3 - q1)) FROM t, q
  UNION ALL SELECT 6, 'missing values', 'quantity', 'filled with median', count(*) FILTER (quantity IS NULL) FROM t
  UNION ALL SELECT 7, 'missing values', 'flag', 'filled with most frequent value', count(*) FILTER (flag IS NULL) FROM t
  UNION ALL SELECT 8, 'drop rows', 'price', 'missing target', (SELECT count(*) FROM lineitem WHERE l_linenumber = 1))""")
def prep_log(spark, sf_dir):
    return cl.log_table(spark, _clean_messy(spark, sf_dir).log)


@query("encoded_feature_count", f"""
SELECT CAST(7 + count(DISTINCT flag) AS BIGINT) AS n_features FROM {MESSY_SQL}""")
def encoded_feature_count(spark, sf_dir):
    c = _clean_messy(spark, sf_dir)
    prep = enc.fit_prep(c.df, c.numeric_features, c.categorical_features, MESSY_CONFIG)["all"]
    return spark.createDataFrame([(len(prep.feature_names),)], "n_features bigint")


@query("prepared_target", """
SELECT CAST(o_orderkey AS VARCHAR) AS _id, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END AS y FROM orders
WHERE o_orderstatus <> 'F'""")
def prepared_target(spark, sf_dir):
    """A numeric target held as text: rows without a readable number are dropped."""
    from tablelens import config as C
    from tablelens.operators.compare import prepare_rows
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", F.when(F.col("o_orderstatus") == "F", F.lit("on request"))
        .otherwise(F.format_string("%.2f", "o_totalprice")).alias("price"))
    config = AnalysisConfig(target="price", key_columns=("o_orderkey",), analysis_type=C.REGRESSION)
    clean = cl.clean_frame(df, profile_table(df, count_duplicate_rows=False), config)
    return prepare_rows(clean, config, C.REGRESSION).df.select("_id", "y")
