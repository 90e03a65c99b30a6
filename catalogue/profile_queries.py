"""Typing, profiling and correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens import config as C
from tablelens.operators import correlation as corr
from tablelens.operators import profile as prof
from tablelens.operators.duplicates import duplicate_rows
from tablelens.operators.typing_rules import infer_column_type, suggest_task_type

from .registry import query, table

# Columns of the test tables and how they are stored.
TABLES = {
    "orders": {"o_orderkey": "int", "o_custkey": "int", "o_orderstatus": "str", "o_totalprice": "float",
               "o_orderdate": "ts", "o_orderpriority": "str"},
    "lineitem": {"l_orderkey": "int", "l_partkey": "int", "l_suppkey": "int", "l_linenumber": "int",
                 "l_quantity": "float", "l_extendedprice": "float", "l_discount": "float", "l_tax": "float",
                 "l_returnflag": "str", "l_linestatus": "str", "l_shipdate": "ts"},
    "customer": {"c_custkey": "int", "c_name": "str", "c_nationkey": "int", "c_acctbal": "float",
                 "c_mktsegment": "str"},
    "events": {"event_id": "int", "ts": "ts", "user_id": "int", "event_type": "str", "value": "float",
               "props": "str"},
    "part": {"p_partkey": "int", "p_name": "str", "p_brand": "str", "p_type": "str", "p_size": "int",
             "p_retailprice": "float"},
    "documents": {"doc_id": "int", "text": "str", "lang": "str", "source": "str", "n_chars": "int"},
    "pages": {"page_id": "int", "url": "str", "html": "str"},
    "conversations": {"conv_id": "int", "turn": "int", "role": "str", "text": "str"},
    "labels": {"doc_id": "int", "quality": "int", "toxic": "int"},
    "supplier": {"s_suppkey": "int", "s_name": "str", "s_nationkey": "int", "s_acctbal": "float"},
}

NUMBER_SQL = (
    "CASE WHEN regexp_matches(replace({c}, ',', ''), '^\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*$') "
    "THEN TRY_CAST(trim(replace({c}, ',', '')) AS DOUBLE) END"
)


def rounded_profile(profile: DataFrame) -> DataFrame:
    """The profile with moments rounded for comparison between engines."""
    fives = ("missing_ratio", "unique_ratio", "mean", "std", "minimum", "q1", "median", "q3", "maximum",
             "outlier_ratio", "low_bound", "high_bound")
    return profile.select(
        "ordinal", "name", "semantic_type", "n_missing", "n_unique", F.array_join("sample_values", "|").alias("samples"),
        *[(F.round(c, 5) + F.lit(0.0)).alias(c) for c in fives],
        (F.round("skewness", 4) + F.lit(0.0)).alias("skewness"), "n_outliers", "top_value", "top_freq",
        "exclusion_reason",
    )


def column_profile_sql(source: str, ordinal: int, name: str, kind: str) -> str:
    x = {"int": f"CAST({name} AS DOUBLE)", "float": f"CAST({name} AS DOUBLE)", "str": NUMBER_SQL.format(c=name),
         "ts": "CAST(NULL AS DOUBLE)"}[kind]
    integral = {"int": "true", "float": f"bool_and({name} % 1 = 0)", "str": "false", "ts": "false"}[kind]
    # Texts longer than 256 bytes are ranked by their digest.
    order = (f"CASE WHEN octet_length(encode({name})) > 256 THEN 'sha256:' || sha256({name}) ELSE {name} END"
             if kind == "str" else name)
    shown = ("CASE WHEN extract('microsecond' FROM v) % 1000000 = 0 THEN strftime(v, '%Y-%m-%d %H:%M:%S') "
             "ELSE strftime(v, '%Y-%m-%d %H:%M:%S.%f') END" if kind == "ts" else "CAST(v AS VARCHAR)")
    n_dates = f"count(TRY_CAST({name} AS TIMESTAMP))" if kind == "str" else "0"
    n_marks = f"count(*) FILTER (regexp_matches({name}, '[-/:]|년|월'))" if kind == "str" else "0"
    kind_rule = {
        "ts": "'datetime'",
        "int": "CASE WHEN n_present = 0 THEN 'text' WHEN n_unique <= 20 THEN 'categorical' ELSE 'numeric' END",
        "float": "CASE WHEN n_present = 0 THEN 'text' WHEN n_unique <= 20 AND integral THEN 'categorical' ELSE 'numeric' END",
        "str": "CASE WHEN n_present = 0 THEN 'text' "
               "WHEN n_number / n_present > 0.95 THEN (CASE WHEN n_numbers > 20 THEN 'numeric' ELSE 'categorical' END) "
               "WHEN n_marks / n_present > 0.6 AND n_dates / n_present > 0.9 THEN 'datetime' "
               "WHEN n_unique / n_present >= 0.5 AND n_unique > 20 THEN 'text' ELSE 'categorical' END",
    }[kind]
    return f"""
SELECT {ordinal} AS ordinal, '{name}' AS name, semantic_type, CAST(n_rows - n_present AS BIGINT) AS n_missing,
  CAST(n_unique AS BIGINT) AS n_unique, coalesce(samples, '') AS samples,
  round((n_rows - n_present) / n_rows, 5) AS missing_ratio, round(n_unique / n_rows, 5) AS unique_ratio,
  CASE WHEN num THEN round(mean, 5) + 0.0 END AS mean, CASE WHEN num THEN round(std, 5) + 0.0 END AS std,
  CASE WHEN num THEN round(lo, 5) + 0.0 END AS minimum, CASE WHEN num THEN round(q1, 5) + 0.0 END AS q1,
  CASE WHEN num THEN round(q2, 5) + 0.0 END AS median, CASE WHEN num THEN round(q3, 5) + 0.0 END AS q3,
  CASE WHEN num THEN round(hi, 5) + 0.0 END AS maximum,
  CASE WHEN num THEN round(n_out / n_rows, 5) ELSE 0.0 END AS outlier_ratio,
  CASE WHEN num THEN round(low, 5) + 0.0 END AS low_bound, CASE WHEN num THEN round(high, 5) + 0.0 END AS high_bound,
  CASE WHEN num THEN round(CASE WHEN std = 0 THEN 0.0 ELSE skew END, 4) + 0.0 END AS skewness,
  CAST(CASE WHEN num THEN n_out ELSE 0 END AS BIGINT) AS n_outliers,
  CASE WHEN NOT num THEN top_value END AS top_value, CAST(CASE WHEN NOT num THEN top_freq END AS BIGINT) AS top_freq,
  CASE WHEN (n_rows - n_present) / n_rows > 0.6 THEN 'too many missing values' WHEN n_unique <= 1 THEN 'single value'
       WHEN semantic_type = 'text' THEN 'identifier or free text' ELSE '' END AS exclusion_reason
FROM (
  SELECT *, semantic_type = 'numeric' AS num FROM (
    SELECT *, {kind_rule} AS semantic_type FROM (
      SELECT count(*) AS n_rows, count({name}) AS n_present, count(DISTINCT {name}) AS n_unique, {integral} AS integral,
        count({x}) AS n_number, count(DISTINCT {x}) AS n_numbers, {n_marks} AS n_marks, {n_dates} AS n_dates,
        avg({x}) AS mean, stddev_samp({x}) AS std, min({x}) AS lo, max({x}) AS hi, skewness({x}) AS skew
      FROM {source}) a,
      (SELECT string_agg({shown}, '|' ORDER BY cnt DESC, o) AS samples,
         first({shown} ORDER BY cnt DESC, o) AS top_value, max(cnt) AS top_freq
       FROM (SELECT {name} AS v, {order} AS o, count(*) AS cnt FROM {source} WHERE {name} IS NOT NULL
             GROUP BY 1, 2 ORDER BY cnt DESC, o LIMIT 5)) f,
      (SELECT *, (SELECT count(*) FROM {source}
                  WHERE high > low AND q3 > q1 AND ({x} < low OR {x} > high)) AS n_out
       FROM (SELECT *, q1 - 1.5 * (q3 - q1) AS low, q3 + 1.5 * (q3 - q1) AS high FROM
         (SELECT quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3
          FROM {source}))) q
  ))"""


def profile_sql(source: str, columns: dict[str, str]) -> str:
    return "\nUNION ALL\n".join(column_profile_sql(source, k, n, kind) for k, (n, kind) in enumerate(columns.items()))


def _register_profiles() -> None:
    for name, columns in TABLES.items():
        def run(spark: SparkSession, sf_dir: str, name=name) -> DataFrame:
            df = table(spark, sf_dir, name)
            return rounded_profile(prof.profile_table(df, count_duplicate_rows=False).frame())

        query(f"profile_{name}", profile_sql(name, columns))(run)


_register_profiles()

# Numbers and dates held as text, with gaps.
AS_TEXT_SQL = """(SELECT
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(CAST(l_partkey AS BIGINT) // 1000 AS VARCHAR) || ','
    || lpad(CAST(l_partkey % 1000 AS VARCHAR), 3, '0') END AS amount,
  strftime(l_shipdate, '%Y-%m-%d') AS shipped,
  CAST(l_linenumber AS VARCHAR) AS line,
  l_returnflag || '-' || l_linestatus AS flags,
  CAST(l_suppkey AS VARCHAR) || 'D' AS product_code,
  l_tax AS rate, l_extendedprice AS price FROM lineitem)"""
AS_TEXT_COLUMNS = {"amount": "str", "shipped": "str", "line": "str", "flags": "str", "product_code": "str",
                   "rate": "float", "price": "float"}


def lineitem_as_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.concat(
            F.floor(F.col("l_partkey") / 1000).cast("string"), F.lit(","),
            F.lpad((F.col("l_partkey") % 1000).cast("string"), 3, "0"))).alias("amount"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("shipped"),
        F.col("l_linenumber").cast("string").alias("line"),
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("flags"),
        F.concat(F.col("l_suppkey").cast("string"), F.lit("D")).alias("product_code"),
        F.col("l_tax").alias("rate"), F.col("l_extendedprice").alias("price"),
    )


@query("type_inference_text", profile_sql(AS_TEXT_SQL, AS_TEXT_COLUMNS))
def type_inference_text(spark, sf_dir):
    return rounded_profile(prof.profile_table(lineitem_as_text(spark, sf_dir), count_duplicate_rows=False).frame())


@query("type_overrides", """
SELECT name, semantic_type FROM (VALUES ('p_partkey', 'numeric'), ('p_name', 'text'), ('p_brand', 'categorical'),
  ('p_type', 'categorical'), ('p_size', 'categorical'), ('p_retailprice', 'numeric')) v(name, semantic_type)
WHERE (SELECT count(*) FROM part) > 0""")
def type_overrides(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    p = prof.profile_table(df, overrides={"p_name": "text", "p_size": "categorical"}, count_duplicate_rows=False)
    return p.frame().select("name", "semantic_type")


@query("names_by_type", """
SELECT CASE WHEN n_unique <= 20 THEN 'categorical' ELSE 'numeric' END AS semantic_type, name FROM (
  SELECT 'c_custkey' AS name, count(DISTINCT c_custkey) AS n_unique FROM customer
  UNION ALL SELECT 'c_nationkey', count(DISTINCT c_nationkey) FROM customer
  UNION ALL SELECT 'c_acctbal', count(DISTINCT c_acctbal) FROM customer)
UNION ALL SELECT 'text', 'c_name' UNION ALL SELECT 'categorical', 'c_mktsegment'""")
def names_by_type(spark, sf_dir):
    p = prof.profile_table(table(spark, sf_dir, "customer"), count_duplicate_rows=False)
    kinds = ("numeric", "categorical", "datetime", "text")
    return spark.createDataFrame([(k, n) for k in kinds for n in p.names_by_type(k)], "semantic_type string, name string")


TASK_TARGETS = [("lineitem", "l_extendedprice"), ("lineitem", "l_returnflag"), ("lineitem", "l_linenumber"),
                ("lineitem", "l_discount"), ("labels", "quality"), ("orders", "o_totalprice"), ("customer", "c_name")]


def task_sql(source: str, target: str) -> str:
    number = f"typeof(any_value({target})) IN ('BIGINT', 'INTEGER', 'DOUBLE')"
    whole = f"bool_and(coalesce(TRY_CAST({target} AS DOUBLE) % 1 = 0, false))"
    return (
        f"SELECT '{source}' AS source, '{target}' AS target, CASE WHEN {number} THEN "
        f"(CASE WHEN count(DISTINCT {target}) <= 2 OR (count(DISTINCT {target}) <= 20 AND {whole}) "
        f"THEN 'classification' ELSE 'regression' END) ELSE 'classification' END AS task FROM {source}"
    )


@query("task_type", "\nUNION ALL\n".join(task_sql(*t) for t in TASK_TARGETS)
       + "\nUNION ALL SELECT 'orders', NULL, 'eda'")
def task_type(spark, sf_dir):
    rows = [(s, t, suggest_task_type(table(spark, sf_dir, s), t)) for s, t in [*TASK_TARGETS, ("orders", None)]]
    return spark.createDataFrame(rows, "source string, target string, task string")


@query("infer_column_type", """
SELECT 'p_name' AS name, CASE WHEN count(DISTINCT p_name) / count(p_name) >= 0.5 AND count(DISTINCT p_name) > 20
  THEN 'text' ELSE 'categorical' END AS semantic_type FROM part
UNION ALL SELECT 'p_size', CASE WHEN count(DISTINCT p_size) <= 20 THEN 'categorical' ELSE 'numeric' END FROM part
UNION ALL SELECT 'p_retailprice', 'numeric' FROM (SELECT count(DISTINCT p_retailprice) AS n FROM part) WHERE n > 20""")
def infer_types(spark, sf_dir):
    df = table(spark, sf_dir, "part")
    names = ("p_name", "p_size", "p_retailprice")
    return spark.createDataFrame([(n, infer_column_type(df, n)) for n in names], "name string, semantic_type string")


@query("duplicate_rows", """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag, l_linestatus, d, l_quantity FROM
    (SELECT *, nullif(l_discount, 0.0) AS d FROM lineitem))) AS BIGINT) AS n_duplicated FROM lineitem""")
def duplicates(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "lineitem").select(
        "l_returnflag", "l_linestatus", F.nullif("l_discount", F.lit(0.0)).alias("d"), "l_quantity"))


@query("duplicate_rows_wide", """
SELECT CAST(count(*) AS BIGINT) AS n_rows,
  CAST(count(*) - (SELECT count(*) FROM (SELECT DISTINCT text, lang, source FROM documents)) AS BIGINT) AS n_duplicated
FROM documents""")
def duplicates_wide(spark, sf_dir):
    return duplicate_rows(table(spark, sf_dir, "documents").select("text", "lang", "source"))


@query("table_summary", """
SELECT CAST((SELECT count(*) FROM orders) AS BIGINT) AS n_rows, 6 AS n_cols, 3 AS n_numeric, 2 AS n_categorical,
  1 AS n_datetime, 0 AS n_text, 0 AS n_with_missing, CAST(0 AS BIGINT) AS n_duplicated_rows,
  round((SELECT sum(32 + octet_length(encode(o_orderstatus)) + octet_length(encode(o_orderpriority))) FROM orders)
    / 1024 / 1024, 6) AS size_mb""")
def table_summary(spark, sf_dir):
    return prof.profile_table(table(spark, sf_dir, "orders")).summary().withColumn("size_mb", F.round("size_mb", 6))


@query("type_counts", """
SELECT semantic_type, CAST(count(*) AS BIGINT) AS n_columns, CAST(0 AS BIGINT) AS n_with_missing FROM (
  SELECT unnest(['numeric', 'numeric', 'numeric', 'categorical', 'categorical', 'datetime']) AS semantic_type
  WHERE (SELECT count(DISTINCT o_orderstatus) FROM orders) <= 20) GROUP BY 1""")
def type_counts(spark, sf_dir):
    return prof.type_counts(prof.profile_table(table(spark, sf_dir, "orders"), count_duplicate_rows=False).frame())


# -- tables of the profile ---------------------------------------------------------------------------
#: The mean to four digits, else the most frequent value, else two samples.
HEADLINE_SQL = """CASE WHEN semantic_type = 'numeric' AND abs(mean) >= 9999.5 THEN regexp_replace(format('{:.3e}', mean), '\\.?0*e', 'e')
  WHEN semantic_type = 'numeric' THEN regexp_replace(format('{:,}', round(mean, 3 - CAST(floor(log10(abs(mean))) AS INTEGER))), '\\.0$', '')
  ELSE coalesce(top_value, array_to_string(string_split(samples, '|')[1:2], ', ')) END"""


@query("overview", f"""
SELECT ordinal, name, CASE WHEN name IN ('rate', 'price') THEN 'double' ELSE 'string' END AS dtype, semantic_type, n_missing, round(missing_ratio * 100, 2) AS missing_pct, n_unique, {HEADLINE_SQL} AS headline
FROM ({profile_sql(AS_TEXT_SQL, AS_TEXT_COLUMNS)})""")
def overview(spark, sf_dir):
    p = prof.profile_table(lineitem_as_text(spark, sf_dir), count_duplicate_rows=False)
    return prof.overview_table(p.frame())


@query("headline_values", f"""
SELECT name, {HEADLINE_SQL} AS headline
FROM ({profile_sql('customer', TABLES['customer'])})""")
def headline(spark, sf_dir):
    p = prof.profile_table(table(spark, sf_dir, "customer"), count_duplicate_rows=False)
    return prof.overview_table(p.frame()).select("name", "headline")


@query("describe_numeric", f"""
SELECT ordinal, name, round(mean, 4) AS mean, round(std, 4) AS std, round(minimum, 4) AS minimum, round(q1, 4) AS q1,
  round(median, 4) AS median, round(q3, 4) AS q3, round(maximum, 4) AS maximum, skewness, n_outliers
FROM ({profile_sql('part', TABLES['part'])}) WHERE semantic_type = 'numeric'""")
def describe_numeric(spark, sf_dir):
    p = prof.profile_table(table(spark, sf_dir, "part"), count_duplicate_rows=False)
    return prof.numeric_describe_table(p.frame()).withColumn("skewness", F.col("skewness") + F.lit(0.0))


@query("categorical_table", f"""
SELECT ordinal, name, n_unique, top_value, top_freq, round(missing_ratio * 100, 2) AS missing_pct
FROM ({profile_sql('customer', TABLES['customer'])}) WHERE semantic_type = 'categorical'""")
def categorical_table(spark, sf_dir):
    p = prof.profile_table(table(spark, sf_dir, "customer"), count_duplicate_rows=False)
    return prof.categorical_table(p.frame())


# -- correlation -------------------------------------------------------------------------------------
# A constant column and derived gaps exercise the guards.
GAPPY = ["l_orderkey", "l_suppkey", "quantity", "l_extendedprice", "discount", "l_tax", "flat"]
GAPPY_SQL = """(SELECT l_orderkey, l_suppkey, CASE WHEN l_linenumber = 7 THEN NULL ELSE l_quantity END AS quantity,
  l_extendedprice, nullif(l_discount, 0.0) AS discount, l_tax, 1.0 AS flat FROM lineitem)"""


def gappy_lineitem(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", F.when(F.col("l_linenumber") != 7, F.col("l_quantity")).alias("quantity"),
        "l_extendedprice", F.nullif("l_discount", F.lit(0.0)).alias("discount"), "l_tax", F.lit(1.0).alias("flat"))


def corr_sql(names: list[str], source: str) -> str:
    parts = []
    for i, a in enumerate(names):
        for j, b in enumerate(names):
            r = f"corr(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE))"
            value = f"CASE WHEN stddev_pop({a}) = 0 OR isnan({r}) THEN NULL ELSE {'1.0' if i == j else r} END"
            parts.append(f"SELECT {i} AS ord1, '{a}' AS var1, {j} AS ord2, '{b}' AS var2, {value} AS corr FROM {source}")
    return "\nUNION ALL\n".join(parts)


def gappy_correlation(spark, sf_dir) -> DataFrame:
    df = gappy_lineitem(spark, sf_dir)
    row = df.agg(*[f(n).alias(f"{n}|{k}") for n in GAPPY for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return corr.correlation_matrix(df, GAPPY, {n: (float(row[f"{n}|m"]), float(row[f"{n}|s"])) for n in GAPPY})


@query("correlation_matrix", f"""
SELECT ord1, var1, ord2, var2, round(corr, 4) + 0.0 AS corr FROM ({corr_sql(GAPPY, GAPPY_SQL)})""")
def correlation_matrix(spark, sf_dir):
    return gappy_correlation(spark, sf_dir).withColumn("corr", F.round("corr", 4) + F.lit(0.0))


WIDE = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
        "l_tax", "revenue", "charge"]
WIDE_SQL = """(SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  nullif(l_discount, 0.0) AS l_discount, l_tax, l_extendedprice * (1 - l_discount) AS revenue,
  l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge FROM lineitem)"""


def wide_lineitem(spark, sf_dir) -> DataFrame:
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        F.nullif("l_discount", F.lit(0.0)).alias("l_discount"), "l_tax", revenue.alias("revenue"),
        (revenue * (1 + F.col("l_tax"))).alias("charge"))


def wide_correlation(spark, sf_dir) -> DataFrame:
    df = wide_lineitem(spark, sf_dir)
    row = df.agg(*[f(n).alias(f"{n}|{k}") for n in WIDE for k, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
    return corr.correlation_matrix(df, WIDE, {n: (float(row[f"{n}|m"]), float(row[f"{n}|s"])) for n in WIDE})


@query("correlation_wide", f"""
SELECT ord1, var1, ord2, var2, round(corr, 4) + 0.0 AS corr FROM ({corr_sql(WIDE, WIDE_SQL)})""")
def correlation_wide(spark, sf_dir):
    return wide_correlation(spark, sf_dir).withColumn("corr", F.round("corr", 4) + F.lit(0.0))


MANY = [f"m{i}" for i in range(16)]


def many_columns(mod: str) -> list[str]:
    """Sixteen columns of one table, some nearly alike, one flat, one with holes."""
    made = [f"{mod.format(f'l_orderkey * {i + 1} + l_partkey', 7 + i)} + l_quantity" for i in range(12)]
    return [*made, "l_extendedprice", "l_extendedprice * l_discount", "l_quantity * 0 + 3", "CASE WHEN l_linenumber < 4 THEN l_suppkey END"]


@query("correlation_panels", f"""
SELECT ord1, var1, ord2, var2, round(corr, 4) + 0.0 AS corr FROM ({corr_sql(MANY, "(SELECT " + ", ".join(
    f"CAST({c} AS DOUBLE) AS {n}" for c, n in zip(many_columns("({} % {})"), MANY)) + " FROM lineitem)")})""")
def correlation_panels(spark, sf_dir):
    """Sixteen columns in panels of six."""
    df = table(spark, sf_dir, "lineitem").select(*[F.expr(c).cast("double").alias(n) for c, n in zip(many_columns("({} % {})"), MANY)])
    found = corr.correlation_matrix(df, MANY, {n: (None, None) for n in MANY}, panel=6)
    return found.withColumn("corr", F.round("corr", 4) + F.lit(0.0))


@query("top_correlations", f"""
SELECT var1, var2, round(corr, 4) + 0.0 AS corr FROM ({corr_sql(WIDE, WIDE_SQL)})
WHERE ord1 < ord2 AND corr IS NOT NULL ORDER BY abs(round(corr, 4)) DESC, ord1, ord2 LIMIT 15""")
def top_correlations(spark, sf_dir):
    return corr.top_correlations(wide_correlation(spark, sf_dir)).withColumn("corr", F.col("corr") + F.lit(0.0))


@query("corr_heatmap", f"""
WITH c AS ({corr_sql(WIDE, WIDE_SQL)}),
k AS (SELECT ord1 AS o, row_number() OVER (ORDER BY avg(abs(corr)) DESC NULLS LAST, ord1) AS pos FROM c GROUP BY ord1)
SELECT CAST(r.pos AS INTEGER) AS row_no, var1 AS row_var, CAST(l.pos AS INTEGER) AS col_no, var2 AS col_var,
  round(corr, 4) + 0.0 AS corr
FROM c JOIN k r ON c.ord1 = r.o JOIN k l ON c.ord2 = l.o WHERE r.pos > l.pos AND r.pos <= 6 AND l.pos <= 6""")
def corr_heatmap(spark, sf_dir):
    return corr.correlation_heatmap(wide_correlation(spark, sf_dir), 6).withColumn(
        "corr", F.round("corr", 4) + F.lit(0.0))


DECIMALS = {"l_quantity": "decimal(10,0)", "l_extendedprice": "decimal(12,2)", "l_discount": "decimal(4,2)", "l_orderkey": "decimal(20,0)"}


@query("profile_decimals", " UNION ALL ".join(f"""
SELECT '{c}' AS name, CASE WHEN u <= {C.CATEGORICAL_MAX_DISTINCT} AND whole THEN 'categorical' ELSE 'numeric' END AS semantic_type,
  CASE WHEN u <= {C.CATEGORICAL_MAX_DISTINCT} AND whole THEN 'categorical' ELSE 'numeric' END AS inferred, u AS n_unique, top
FROM (SELECT count(DISTINCT x) AS u, bool_and(x % 1 = 0) AS whole, (SELECT CAST(y AS VARCHAR) FROM (SELECT CAST({c} AS {t}) AS y FROM lineitem)
  GROUP BY y ORDER BY count(*) DESC, y LIMIT 1) AS top FROM (SELECT CAST({c} AS {t}) AS x FROM lineitem))""" for c, t in DECIMALS.items()))
def profile_decimals(spark, sf_dir):
    """Money and counts as decimals: typed alike by the profile and by the single-column rule."""
    df = table(spark, sf_dir, "lineitem").select(*[F.col(c).cast(t).alias(c) for c, t in DECIMALS.items()])
    found = prof.profile_table(df, count_duplicate_rows=False)
    rows = [(c.name, c.semantic_type, infer_column_type(df, c.name), c.n_unique, c.sample_values[0]) for c in found.columns]
    return spark.createDataFrame(rows, "name string, semantic_type string, inferred string, n_unique long, top string")
