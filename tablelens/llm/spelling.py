"""Group the spelling variants of words that are one edit apart, by permuterm rotations. DataFrame functions only.

A word u = A x B ends with a mark, so its rotation after the character x is B$A x. All words that differ from u in x alone
have rotations with the same beginning B$A, and the word A B without x has B$A itself as a whole rotation. So every rotation
is written twice: as it is, and with its last character skipped. Sorted by that key, words one edit apart stand together, and
a scan over the group tells each member how many others it has and which is the most frequent. A key has at most one whole
rotation and one skipped one per character, so a group is no larger than the alphabet, whatever the number of words.
Of equal neighbouring characters the first alone stands for their removal: so no two groups hold the same pair.

Where A and B have more than LONG code points together the key is two 64-bit hashes, of A and of B, and words of more than
LONG go by a short name in code-point order, so that the rows of a long word take space in proportion to its length (their
hashing still takes time by its square).

A word's form is its near word of largest n (ties: the least in code-point order) where that is at least `times` its own n;
roots follow forms to the last, by doubling the steps. n grows at each step, so there are no circles.

Defined cases: NULL words are left out; the words given to `variants` are different ones; an empty word is near each word of
one character; the mark inside a word is a character like others. Other columns are ignored. No words give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.staging import stage
from .native import upto
from .url_rules import LOWER, UPPER

MARK = "$"
#: Code points of a rotation that is written out.
LONG = 64


def runs(text: Column, letters: str, least: int) -> Column:
    """Maximal runs of at least `least` of the letters (what stands in a regular expression's brackets), A to Z lower-cased."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(f"([{letters}]{{{least},}}+)"), F.lit(1))


def word_counts(words: DataFrame, least_n: int = 2) -> DataFrame:
    """(word, n) of the words that occur at least `least_n` times."""
    return words.where("word IS NOT NULL").groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_n)


def _long_names(words: DataFrame) -> DataFrame | None:
    """(word, n, name) of the words longer than LONG: names stand in the order of the words, between all other words."""
    rest = words.where(F.length("word") > LONG)
    if rest.isEmpty():
        return None
    dealt = stage(rest.repartitionByRange("word").withColumn("part", F.spark_partition_id()))
    place = F.row_number().over(Window.partitionBy("part").orderBy("word"))
    return stage(dealt.select("word", "n", F.concat(F.substr("word", F.lit(1), F.lit(LONG)), F.format_string("%010d%019d", "part", place)).alias("name")))


def rotations(words: DataFrame) -> DataFrame:
    """(key, skipped, first, n, name): every rotation of the words (word, n, name), whole (skipped is empty) and without its
    last character; `first` is whether the skipped character is the first of its equal neighbours."""
    word, length = F.col("word"), F.length("word")

    def row(a: Column, b: Column, skipped: Column, first: Column) -> Column:
        # what tells the kinds of key apart depends on A and B only, so a group has one kind
        key = F.when(F.length(a) + F.length(b) > LONG, F.concat(F.lit(MARK + MARK), F.hex(F.xxhash64(b)), F.lit(MARK), F.hex(F.xxhash64(a))))
        key = key.when(F.contains(F.concat(a, b), F.lit(MARK)), F.concat(b, F.lit(MARK), a, F.lit(MARK), F.length(b).cast("string")))
        return F.struct(key.otherwise(F.concat(b, F.lit(MARK), a)).alias("key"), skipped.alias("skipped"), first.alias("first"))

    def cut(i: Column) -> Column:
        x = word.substr(i + 1, F.lit(1))
        return row(word.substr(F.lit(1), i), word.substr(i + 2, length), x, (i == 0) | (word.substr(i, F.lit(1)) != x))

    def whole(i: Column) -> Column:
        return row(word.substr(F.lit(1), i), word.substr(i + 1, length), F.lit(""), F.lit(False))

    made = F.concat(F.transform(upto(length), cut), F.transform(upto(length + 1), whole))
    return words.select(F.explode(made).alias("r"), "n", "name").select("r.*", "n", "name")


def near(words: DataFrame) -> DataFrame:
    """(name, n_near, best): for each of the words (word, n, name; a NULL name is spelled by the word) with a word one edit
    away, how many there are and (minus n, name) of the first of them."""
    place = F.locate(MARK, F.col("key"))
    spelled = F.concat(F.substr("key", place + 1), "skipped", F.substr("key", F.lit(1), place - 1))
    group = Window.partitionBy("key")
    rows = rotations(words).withColumn("size", F.count("*").over(group)).where("size > 1")
    rows = rows.select("key", "skipped", "first", F.struct((-F.col("n")).alias("n"), F.coalesce("name", spelled).alias("name")).alias("me"))
    rows = rows.withColumn("cut", F.when(F.col("skipped") != "", F.col("me")))
    ordered = group.orderBy("skipped")
    every = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before, after = ordered.rowsBetween(Window.unboundedPreceding, -1), ordered.rowsBetween(1, Window.unboundedFollowing)
    firsts = F.when(F.col("first"), F.col("cut"))
    rows = rows.select(
        "me", "cut", "first", F.count("cut").over(every).alias("n_cut"), F.count(firsts).over(every).alias("n_first"),
        F.min(firsts).over(every).alias("best_first"), F.min(F.when(F.col("cut").isNull(), F.col("me"))).over(every).alias("whole"),
        F.least(F.min("cut").over(before), F.min("cut").over(after)).alias("other"))
    shorter = F.when(F.col("first"), F.col("whole"))
    n_near = F.when(F.col("cut").isNull(), F.col("n_first")).otherwise(F.col("n_cut") - 1 + shorter.isNotNull().cast("int"))
    best = F.when(F.col("cut").isNull(), F.col("best_first")).otherwise(F.least("other", shorter))
    found = rows.select(F.col("me.name").alias("name"), n_near.cast("long").alias("n_near"), best.alias("best")).where("n_near > 0")
    return found.groupBy("name").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(name, root) of the names that have a form: the last of the forms that follow each other."""
    links = stage(forms.select("name", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("name").alias("root"), F.col("root").alias("next"))
        moved = stage(links.join(on, "root", "left").select("name", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = moved.select("name", "root")
        if moved.where("moved").isEmpty():
            return links


def variants(words: DataFrame, *, times: int = 10) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of all different words (word, n)."""
    words = words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n"))
    marked = F.when(F.contains("word", F.lit(MARK)), F.col("word"))
    longs = _long_names(words)
    named = words.where(F.length("word") <= LONG).withColumn("name", marked)
    if longs is not None:
        named = named.unionByName(longs)
    found = stage(named.select("word", "n", F.coalesce("name", "word").alias("name")).join(near(named), "name", "left"))
    best_n = -F.col("best.n")
    forms = found.select("name", F.when(best_n >= times * F.col("n"), F.col("best.name")).alias("form"), best_n.alias("form_n")).where("form IS NOT NULL")
    last = roots(forms)
    out = found.join(forms.join(last, "name"), "name", "left")
    if longs is not None:
        for column in ("form", "root"):
            texts = longs.select(F.col("name").alias(column), F.col("word").alias("text"))
            out = out.join(texts, column, "left").withColumn(column, F.coalesce("text", column)).drop("text")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
