"""The corpus pipeline: documents in, packed training sequences out.

Each stage takes (spark, docs, sf_dir), works on all documents that the one before has kept, and returns documents with
the columns it was given; the last returns the packed pieces. Rows that a stage drops, and texts that it cuts, stay so.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.staging import stage
from tablelens.llm import decontaminate, language_crf, line_dedup, ngram_join, packing

#: The share of the way from an even guess (one by the number of labels) to certainty that a document's words must reach on
#: average, each with its own likeliest language; so text in two or three languages does. Fewer words with a letter than LEAST_WORDS are too few to tell.
LEAST_CERTAINTY, LEAST_WORDS = 0.45, 8


def _restored(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*[F.col("row").getField(c).alias(c) for c in columns])


def least_certainty(n_labels: int) -> float:
    """The least certainty that is not rejected; with a single label it tells nothing."""
    return 1 / n_labels + (1 - 1 / n_labels) * LEAST_CERTAINTY if n_labels > 1 else 0.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and those whose words belong to no language in particular. The model learns from the
    labelled documents that are not held out. Without any labelled document nothing can be rejected. A language of which
    there is no labelled document at all is rejected as far as its words leave the labels open: foreign scripts mostly are,
    languages like a learned one mostly pass."""
    learn = docs.where(F.col("doc_id").isNotNull() & ~language_crf.is_held_out(F.col("doc_id")))
    model = language_crf.fit(learn.select("text", "lang", F.col("doc_id").alias("key")))
    if model is None:
        return docs
    names = [c if c == "text" else f"own {i}" for i, c in enumerate(docs.columns)]  # none is one that is added
    found = language_crf.predict(docs.toDF(*names), model, names, certainty=True)
    short = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D\p{L}]*+\p{L}[^\x20\x09-\x0D]*+")) < LEAST_WORDS
    sure = (F.col("certainty") >= least_certainty(len(model.labels))) | short
    return found.where((F.col("lang_pred") != language_crf.UNKNOWN) & sure).select(*[F.col(f"`{n}`") for n in names]).toDF(*docs.columns)


def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts later repeats of at least 50 words of whole lines; a document of which nothing is left goes."""
    cut = line_dedup.dedup_lines(docs)
    changed = F.col("line_dedup.n_removed_lines") > 0
    left = cut.where(~changed | (F.col("text") != ""))
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return left.select(*docs.columns)


def _identified(docs: DataFrame) -> DataFrame:
    """(row, id, text, alone): an id for every text. It is doc_id, but rows without one, or whose doc_id has several texts, get a
    hash of both beyond 2**62, so equal rows share it. `alone` is false where several rows may share the id."""
    doc_id = F.col("doc_id").cast("long")
    per_id = docs.where(doc_id.isNotNull()).groupBy(doc_id.alias("of")).agg(
        F.count("*").alias("n"), F.min(F.xxhash64("text")).alias("low"), F.max(F.xxhash64("text")).alias("high"))
    repeated = stage(per_id.where("n > 1").select("of", (F.col("low") != F.col("high")).alias("differ")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), doc_id.alias("own"), F.col("text").alias("text"))
    hashed = F.xxhash64("own", "text").bitwiseAND(F.lit(2**62 - 1)).bitwiseOR(F.lit(2**62))
    unclear = F.col("own").isNull() | F.coalesce("differ", F.lit(False))
    return rows.join(repeated, F.col("own") == F.col("of"), "left").select(
        "row", F.when(unclear, hashed).otherwise(F.col("own")).alias("id"), "text",
        (F.col("own").isNotNull() & F.col("of").isNull()).alias("alone"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of documents alike in eight tenths of their five-word shingles: the one of the least id
    (those without an id, or with one of several texts, come last), and of rows that are equal in id and text the least."""
    rows = _identified(docs)
    groups = ngram_join.jaccard_groups(rows.select(F.col("id").alias("doc_id"), "text"), n=5, num=80, den=100)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("id")).distinct()
    kept = rows.join(gone, "id", "left_anti")
    one_each = kept.where(~F.col("alone")).groupBy("id").agg(F.min("row").alias("row"))
    return _restored(kept.where("alone").select("row").unionByName(one_each.select("row")), docs.columns)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item, exactly or edited."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(stage(found.select("doc_id").distinct()), "doc_id", "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens."""
    return packing.pack(docs, capacity=2048, tokenizer="word_bpe_49k.json", end_id=0)


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_deduplication),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("best-fit packing", best_fit_packing),
]
#: A trained model, hashes and a tokenizer stand between SQL and the rows: tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to `documents` in their order, each reading what the one before it has written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
