"""Deletion of repeated runs of lines by winnowing. DataFrame functions only.

A line is a non-blank line with the blank ones after it; lines are equal if they are, up to outer white space. A window
is a shortest run of lines with at least `min_words` words, taken forwards from every line and backwards from every
line. Of each window the least line hash is its fingerprint, so two documents that share `min_words` words of whole
lines share a window and its fingerprint for certain. Per (fingerprint, window) the first place in the order of
(doc_id, hash of the text, line) is found by partial minima; every later place is joined to it, and the match is
extended both ways, along its diagonal, over the line hashes of both documents. Every run of equal lines there with
at least `min_words` words is deleted from the later place. So the first occurrence of a text always stays, and a line
goes if and only if it lies in a run of that many words which occurs earlier, in the same or in another document.

What is joined for a match is one row per (document, source, diagonal) with line hashes, never texts or all pairs: a
text that a third of all documents share is one source for all of them.

Defined cases: a NULL text stays NULL and has no lines; a text without words has one line and keeps it; a NULL document
id comes before all others; rows with the same id and the same text are one document and are treated alike; a document
that repeats others wholly is left with an empty text; all other columns are kept, but one named `line_dedup` is replaced. No documents
give no rows. Line hashes have 64 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.staging import stage
from .native import SPACE_CLASS, upto

NONE = -(2**63)
#: A line break before a line with a word.
BREAK = r"\n(?=[^\n]*[^\n" + SPACE_CLASS[1:] + ")"


def _units(text: Column) -> Column:
    return F.split(text, BREAK, -1)


def _windows(words: Column, n: Column, least: int) -> Column:
    """Per line the number of lines, from it on, that first reach `least` words; NULL if they never do. Every line but
    that of a wordless text has a word, so no window has more than `least` lines."""
    def length(i: Column) -> Column:
        walked = F.aggregate(
            F.slice(words, i + 1, F.lit(least)), F.struct(F.lit(0).alias("words"), F.lit(0).alias("lines")),
            lambda acc, w: F.when(acc["words"] < least, F.struct((acc["words"] + w).alias("words"), (acc["lines"] + 1).alias("lines"))).otherwise(acc))
        return F.transform(F.array(walked), lambda x: F.when(x["words"] >= least, x["lines"]))[0]
    return F.transform(upto(n), length)


def lines_of(docs: DataFrame) -> DataFrame:
    """(did, th, h, w): per distinct document its id and text hash, and its lines' hashes and word counts."""
    units = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("did"), F.xxhash64("text").alias("th"), _units(F.col("text")).alias("u"))
    return units.where("u IS NOT NULL").select(
        "did", "th", F.transform("u", lambda x: F.xxhash64(F.btrim(x, F.lit(" \t\n\x0b\x0c\r")))).alias("h"),
        F.transform("u", lambda x: F.regexp_count(x, F.lit("[^" + SPACE_CLASS[1:] + "+"))).alias("w"))


def repeated_runs(lines: DataFrame, min_words: int) -> DataFrame:
    """(did, th, gone): the numbers of the lines to delete, ascending, per document that has any. lines: staged."""
    n = F.size("h")
    long_enough = lines.where(F.aggregate("w", F.lit(0).cast("long"), lambda a, x: a + x) >= min_words).withColumn("n", n)
    ahead = F.transform(_windows(F.col("w"), F.col("n"), min_words), lambda k, i: F.when(k.isNotNull(), F.struct(i.alias("at"), k.alias("k"))))
    back = F.transform(_windows(F.reverse("w"), F.col("n"), min_words), lambda k, i: F.when(
        k.isNotNull(), F.struct((F.col("n") - i - k).cast("int").alias("at"), k.alias("k"))))
    places = F.filter(F.array_distinct(F.concat(ahead, back)), lambda x: x.isNotNull())
    prints = F.transform(places, lambda x: F.struct(
        x["at"].alias("at"), F.array_min(F.slice("h", x["at"] + 1, x["k"])).alias("print"), F.xxhash64(F.slice("h", x["at"] + 1, x["k"])).alias("window")))
    rows = stage(long_enough.select("did", "th", F.explode(prints).alias("p")).select("did", "th", "p.at", "p.print", "p.window"))
    first = rows.groupBy("print", "window").agg(F.min(F.struct("did", "th", "at")).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    matches = rows.join(first.drop("copies"), ["print", "window"]).where(F.struct("did", "th", "at") > F.col("first"))
    diagonals = matches.select(
        "did", "th", F.col("first.did").alias("sdid"), F.col("first.th").alias("sth"), (F.col("at") - F.col("first.at")).alias("shift")).distinct()
    sources = lines.select(F.col("did").alias("sdid"), F.col("th").alias("sth"), F.col("h").alias("sh"))
    both = diagonals.join(lines, ["did", "th"]).join(sources, ["sdid", "sth"])

    def equal(i: Column) -> Column:  # beyond either end there is no line
        return F.coalesce((i >= 0) & (F.get("h", i) == F.when(i >= F.col("shift"), F.get("sh", i - F.col("shift")))), F.lit(False))

    begins = F.filter(upto(F.size("h")), lambda i: equal(i) & ~equal(i - 1))
    ends = F.filter(upto(F.size("h")), lambda i: equal(i) & ~equal(i + 1))
    runs = F.filter(F.arrays_zip(begins.alias("a"), ends.alias("b")), lambda r: F.aggregate(
        F.slice("w", r["a"] + 1, r["b"] - r["a"] + 1), F.lit(0).cast("long"), lambda acc, x: acc + x) >= min_words)
    found = both.select("did", "th", F.flatten(F.transform(runs, lambda r: F.sequence(r["a"], r["b"]))).alias("lines"))
    return found.groupBy("did", "th").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("lines")))).alias("gone"))


def dedup_lines(docs: DataFrame, *, min_words: int = 50) -> DataFrame:
    """The documents with later repeated runs cut out of `text`, and (n_lines, n_removed_lines) in a struct `line_dedup`."""
    lines = stage(lines_of(docs).distinct())
    gone = repeated_runs(lines, min_words)
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NONE)).alias("did"),
        F.xxhash64("text").alias("th"))
    rows = rows.join(gone, ["did", "th"], "left").withColumn("u", F.when(F.col("gone").isNotNull(), _units(F.col("row.text"))))
    marks = F.concat(F.array(F.lit(-1)), F.col("gone"), F.array(F.size("u")))
    kept = F.flatten(F.transform(upto(F.size("gone") + 1), lambda k: F.slice(
        "u", F.get(marks, k) + 2, F.get(marks, k + 1) - F.get(marks, k) - 1)))
    text = F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(F.array_join(kept, "\n"))
    counts = F.struct(F.coalesce(F.size(_units(F.col("row.text"))), F.lit(0)).cast("long").alias("n_lines"),
                      F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed_lines"))
    return rows.select(*[(text if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns if c != "line_dedup"],
                       counts.alias("line_dedup"))
