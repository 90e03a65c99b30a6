"""Reading and tidying: the test tables are written as delimited text below the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablelens.functions.columns import normalise_missing
from tablelens.functions.staging import shared_folder
from tablelens.sources import tidy as td
from tablelens.sources.delimited import charset_session, detect_encoding
from tablelens.sources.load import load_table

from .registry import query, table


def _written(spark, sf_dir, name: str, *, sep: str = ",", encoding: str = "UTF-8") -> str:
    df = table(spark, sf_dir, name)
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.csv"
    if encoding != "UTF-8":
        other = charset_session(spark)
        df = other.read.parquet(f"{sf_dir}/{name}.parquet")
    df.write.option("header", True).option("sep", sep).option("escape", '"').option("encoding", encoding).csv(path)
    return path


@query("load_csv", """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000') AS o_orderdate, o_orderpriority FROM orders""")
def load_csv(spark, sf_dir):
    return load_table(spark, _written(spark, sf_dir, "orders")).df.withColumn("o_orderdate", F.col("o_orderdate").cast("string"))


def _as_text(spark, header: str, rows: DataFrame) -> str:
    """A folder with one text file, as a header stands at its top; the rows keep their letters as they are."""
    path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.csv"
    lines = spark.createDataFrame([(header,)], "line string").unionAll(rows)
    lines.coalesce(1).write.text(path)
    return path


@query("load_csv_long_ids", """
SELECT '7' || lpad(CAST(c_custkey AS VARCHAR), 22, '0') AS id, c_custkey * 1000000000 AS fits, c_acctbal AS amount FROM customer""")
def load_csv_long_ids(spark, sf_dir):
    """Ids of 23 digits, which no number type holds."""
    rows = table(spark, sf_dir, "customer").select(F.concat_ws(
        ",", F.concat(F.lit("7"), F.lpad(F.col("c_custkey").cast("string"), 22, "0")), (F.col("c_custkey") * 1000000000).cast("string"),
        F.col("c_acctbal").cast("string")))
    return load_table(spark, _as_text(spark, "id,fits,amount", rows)).df


@query("load_csv_ragged", """
SELECT n_nationkey AS key, n_name AS name, CASE WHEN n_nationkey % 3 = 0 THEN 'x,' || n_regionkey END AS _extra,
  (SELECT count(*) FILTER (n_nationkey % 3 = 0) || ' rows have more fields than the header; they are kept in ' || chr(39) || '_extra' || chr(39)
   FROM nation) AS note FROM nation""")
def load_csv_ragged(spark, sf_dir):
    """Every third row has two fields more than the header."""
    rows = table(spark, sf_dir, "nation").select(F.concat_ws(
        ",", F.col("n_nationkey").cast("string"), "n_name",
        F.when(F.col("n_nationkey") % 3 == 0, F.concat_ws(",", F.lit("x"), F.col("n_regionkey").cast("string")))))
    got = load_table(spark, _as_text(spark, "key,name", rows))
    note = got.notes_table(spark).where("note LIKE '%more fields%'").first()["note"]
    return got.df.withColumn("note", F.lit(note))


@query("load_csv_replacement_letter", """
SELECT o_orderkey AS key, '우선 ' || CASE WHEN o_orderkey = (SELECT min(o_orderkey) FROM orders) THEN chr(65533) ELSE o_orderpriority END AS text
FROM orders""")
def load_csv_replacement_letter(spark, sf_dir):
    """Valid UTF-8 that holds the letter U+FFFD once."""
    orders = table(spark, sf_dir, "orders")
    least = orders.agg(F.min("o_orderkey")).first()[0]
    rows = orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), F.concat(
        F.lit("우선 "), F.when(F.col("o_orderkey") == least, "�").otherwise(F.col("o_orderpriority")))))
    return load_table(spark, _as_text(spark, "key,text", rows)).df


@query("load_csv_quotes", """
SELECT p_partkey AS key, CAST(p_size AS VARCHAR) || '"' AS size, CASE WHEN p_partkey % 2 = 0 THEN 'a;b,"' ELSE p_brand END AS text FROM part""")
def load_csv_quotes(spark, sf_dir):
    """Inch marks inside fields, and quoted fields with separators and doubled quotes."""
    quoted = F.when(F.col("p_partkey") % 2 == 0, F.lit('"a;b,"""')).otherwise(F.col("p_brand"))
    rows = table(spark, sf_dir, "part").select(F.concat_ws(
        ",", F.col("p_partkey").cast("string"), F.concat(F.col("p_size").cast("string"), F.lit('"')), quoted))
    return load_table(spark, _as_text(spark, "key,size,text", rows)).df


@query("load_csv_semicolon", """
SELECT c_custkey, c_name, CAST(c_nationkey AS BIGINT) AS c_nationkey, c_acctbal, c_mktsegment, ';' AS sep FROM customer""")
def load_csv_semicolon(spark, sf_dir):
    got = load_table(spark, _written(spark, sf_dir, "customer", sep=";"))
    return got.df.withColumn("sep", F.lit(got.separator))


@query("load_csv_quoted", "SELECT conv_id, turn, role, text FROM conversations")
def load_csv_quoted(spark, sf_dir):
    """Free text with separators and quotes inside the fields."""
    return load_table(spark, _written(spark, sf_dir, "conversations")).df


def _as_one_file(spark, rows: DataFrame) -> str:
    """A folder with one file of quoted fields: the parts are written by all tasks and put one after the other below the header."""
    name = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    options = {"quoteAll": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    rows.limit(0).coalesce(1).write.options(header=True, **options).csv(f"{name}-0")
    rows.write.options(header=False, **options).csv(f"{name}-1")
    hadoop, conf = spark._jvm.org.apache.hadoop, spark._jsc.hadoopConfiguration()
    files = hadoop.fs.Path(name).getFileSystem(conf)
    out = files.create(hadoop.fs.Path(f"{name}.csv/part-00000.csv"))
    for folder in (f"{name}-0", f"{name}-1"):
        for part in sorted(f.getPath().toString() for f in files.listStatus(hadoop.fs.Path(folder)) if f.getPath().getName().startswith("part-")):
            source = files.open(hadoop.fs.Path(part))
            hadoop.io.IOUtils.copyBytes(source, out, 1 << 20, False)
            source.close()
        files.delete(hadoop.fs.Path(folder), True)
    out.close()
    return f"{name}.csv"


@query("load_csv_multiline", """
SELECT doc_id, CASE WHEN trim(text) <> '' THEN text END AS text, lang, source FROM documents""")
def load_csv_multiline(spark, sf_dir):
    """Whole texts with line breaks, quotes and separators as quoted fields of one file, read in splits of 256 kB."""
    path = _as_one_file(spark, table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    session = spark.newSession()
    session.conf.set("spark.sql.files.maxPartitionBytes", "256k")
    session.conf.set("spark.sql.files.openCostInBytes", "1k")
    return load_table(session, path).df


@query("detect_encoding", """
SELECT 'utf-8-sig' AS utf8, 'cp949' AS ms949 FROM (SELECT count(*) AS n FROM nation) WHERE n > 0""")
def encodings(spark, sf_dir):
    """The order priorities with a Hangul mark, written in two encodings."""
    other = charset_session(spark)
    marked = other.read.parquet(f"{sf_dir}/orders.parquet").select(F.concat(F.lit("우선 "), "o_orderpriority").alias("text"))
    found = []
    for charset in ("UTF-8", "MS949"):
        path = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}.csv"
        marked.write.option("encoding", charset).csv(path)
        found.append(detect_encoding(spark, path))
    return spark.createDataFrame([tuple(found)], "utf8 string, ms949 string")


def _holey(spark, sf_dir) -> DataFrame:
    """Rows without any value, an empty column, a nearly empty unnamed one, and untidy names."""
    keep = F.col("l_linenumber") != 7
    return table(spark, sf_dir, "lineitem").select(
        F.when(keep, F.col("l_orderkey")).alias(" key "), F.when(keep, F.col("l_quantity")).alias("qty"),
        F.when(keep, F.col("l_tax")).alias(" qty"), F.lit(None).cast("string").alias("empty"),
        F.when(F.col("l_quantity") == 1, F.lit("x")).alias("Unnamed: 4"))


@query("tidy_table", """
SELECT CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS key, CASE WHEN l_linenumber <> 7 THEN l_quantity END AS qty,
  CASE WHEN l_linenumber <> 7 THEN l_tax END AS qty_1 FROM lineitem WHERE l_linenumber <> 7 OR l_quantity = 1""")
def tidy_table(spark, sf_dir):
    return td.tidy(_holey(spark, sf_dir), "lineitem").df


@query("load_meta", """
WITH k AS (SELECT count(*) FILTER (l_linenumber <> 7 OR l_quantity = 1) AS n FROM lineitem)
SELECT 'lineitem' AS source, n AS n_rows, 3 AS n_cols FROM k""")
def load_meta(spark, sf_dir):
    return td.tidy(_holey(spark, sf_dir), "lineitem").meta(spark).select("source", "n_rows", "n_cols")


@query("load_notes", """
SELECT 0 AS ord, 'dropped 1 nearly empty columns: Unnamed: 4' AS note
UNION ALL SELECT 1, 'tidied from ' || format('{:,}', count(*)) || ' rows x 5 columns to ' ||
  format('{:,}', count(*) FILTER (l_linenumber <> 7 OR l_quantity = 1)) || ' x 3' FROM lineitem""")
def load_notes(spark, sf_dir):
    return td.tidy(_holey(spark, sf_dir), "lineitem").notes_table(spark)


@query("drop_empty", """
SELECT CASE WHEN l_linenumber <> 7 THEN l_orderkey END AS key, nullif(l_discount, 0.0) AS discount FROM lineitem
WHERE l_linenumber <> 7 OR l_discount <> 0""")
def drop_empty(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.when(F.col("l_linenumber") != 7, F.col("l_orderkey")).alias("key"),
        F.nullif("l_discount", F.lit(0.0)).alias("discount"), F.lit(None).cast("double").alias("nothing"))
    return td.drop_empty_columns(td.drop_empty_rows(df))


@query("trim_names", "SELECT n_nationkey AS a, n_name AS a_1, n_regionkey AS a_1_1 FROM nation")
def trim_names(spark, sf_dir):
    return td.trim_names(table(spark, sf_dir, "nation").toDF("a ", " a", "a_1"))


@query("cap_rows", "SELECT * FROM supplier ORDER BY s_acctbal, s_suppkey LIMIT 25")
def cap_rows(spark, sf_dir):
    return td.cap_rows(table(spark, sf_dir, "supplier"), 25, ["s_acctbal", "s_suppkey"])


@query("preview", "SELECT * FROM part ORDER BY p_partkey LIMIT 10")
def preview(spark, sf_dir):
    return td.preview(table(spark, sf_dir, "part"), 10, ["p_partkey"])


@query("missing_tokens", """
SELECT event_id, CASE WHEN event_type IN ('NA', 'null') THEN NULL ELSE event_type END AS event_type,
  CASE WHEN user_id % 5 = 0 THEN NULL ELSE CAST(user_id AS VARCHAR) END AS user_text,
  CASE WHEN value < 1 THEN NULL ELSE value END AS value FROM events""")
def missing_tokens(spark, sf_dir):
    tokens = F.element_at(F.array(*[F.lit(t) for t in ("NA", " N/A ", "null", "None", "nan")]),
                          (F.col("user_id") / 5 % 5 + 1).cast("int"))
    df = table(spark, sf_dir, "events").select(
        "event_id", "event_type",
        F.when(F.col("user_id") % 5 == 0, tokens).otherwise(F.col("user_id").cast("string")).alias("user_text"),
        F.when(F.col("value") < 1, F.lit(float("nan"))).otherwise(F.col("value")).alias("value"))
    return normalise_missing(df)


@query("load_folder", "SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region FROM nation")
def load_folder(spark, sf_dir):
    """A folder without a suffix, of two text files whose columns stand in different orders."""
    folder = f"{shared_folder(spark)}/text-{uuid.uuid4().hex}"
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    rows.where("key % 2 = 0").coalesce(1).write.option("header", True).csv(folder)
    rows.where("key % 2 = 1").select("region", "key", "name").coalesce(1).write.mode("append").option("header", True).csv(folder)
    return load_table(spark, folder).df


@query("load_table_name", "SELECT * FROM supplier")
def load_table_name(spark, sf_dir):
    """A view of the catalog by its name."""
    table(spark, sf_dir, "supplier").createOrReplaceTempView("loaded_supplier")
    return load_table(spark, "loaded_supplier").df
