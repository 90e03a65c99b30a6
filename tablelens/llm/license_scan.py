"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory. DataFrame functions only.

A file's licence is the first that is found of these: the first known name in an SPDX-License-Identifier; the licence
whose whole text or header is like the whole file; that whose whole text or header is like the file's header block; that
of the one to four paragraphs in a row of this block that are most like one; that of its best statement. The header block is the comment at the file's beginning after a line with #!: one in /* */, <!-- -->
or triple quotes, else the lines up to the first that begins with no comment mark and is not blank. Whole files and header
blocks are weighed if they have one of the LEGAL words, which every whole text and header has (`long_ok`). There a term's weight
is 1 + ln(count) times ln((1 + N) / (1 + df)) + 1 over the N whole texts and headers (`licence_texts`).

For statements, a text is read in statements: its lines, cut further after a full stop, exclamation or question mark and white space.
Terms are runs of a-z and 0-9 after lower-casing. A term's weight is its count times ln((1 + N) / (1 + df)) + 1, with df
the number of the N templates that hold it; terms outside the templates count in a statement's norm. A statement's
licence is the template with the largest cosine (ties: the first name), a text's is that of its best statement (ties:
the first statement), if the cosine reaches `least`.

Only statements with one of the templates' own words are weighed: of the others no more than the COMMON words can
agree, and `templates_ok` shows that these alone can't reach `least`. So the scan over all texts is one expression, and
only what may be a licence is shuffled. The columns `statement` and `score` of a file are those of what was found: no
statement but a statement's number, 1 for an identifier, else the cosine.

A file whose name says so (`licence_file`) speaks for its directory and all below; a file without a licence of its own
takes that of the nearest directory upwards. Directories are joined, one row each, by their paths.

Defined cases: a NULL or empty text has no licence of its own; a NULL path lies in the root ('') like a path without a
directory; several licence files in a directory: the largest cosine, then the first name, then the first path; repeated
rows are files of their own and get the same result; other columns are kept, but one named `licence` is replaced. No files give no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .licence_texts import long_templates

# The usual short statements of public licences.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-3-Clause": "Released under the 3-Clause BSD License.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Dedicated to the public domain under CC0 1.0 Universal.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "ISC": "Released under the ISC License.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.",
    "proprietary": "All rights reserved.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Words of the templates that any text may hold.
COMMON = ("all", "and", "by", "is", "of", "the", "this", "to", "under", "0", "1", "2", "3")
TERM = "[a-z0-9]+"
STATEMENT_BREAK = r"\n|(?<=[.!?])[ \t]+"
LEGAL = "(?i)licen[cs]e|copyright|warrant"
IDENTIFIER = r"(?i)SPDX-License-Identifier:[ \t]*([^\n]*)"
FENCED = r"""(?s)^(/\*.*?\*/|<!--.*?-->|\"\"\".*?\"\"\"|'''.*?''')"""
COMMENT_LINE = r"^[ \t\r]*($|#|//|/\*|\*|--|;|%|\.\.|<!--|(?i:rem|dnl)\b)"
MARK = r"(?m)^[ \t]*(#+|//+|/\*+|\*+/?|--+|;+|%+|\.\.|<!--|(?i:rem|dnl)\b)"
#: Paragraphs of a header, at most.
PARAGRAPHS = 4
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice|unlicense)([._-].*)?$"


def terms(text: str) -> Counter:
    return Counter(re.findall(TERM, text.lower()))


def weights(templates: dict[str, str]) -> dict[str, float]:
    """The weight of each template term, and of any other under ''."""
    df = Counter(t for text in templates.values() for t in terms(text))
    n = len(templates)
    return {t: math.log((1 + n) / (1 + k)) + 1 for t, k in df.items()} | {"": math.log(1 + n) + 1}


def templates_ok(templates: dict[str, str], least: float) -> bool:
    """Whether the common words alone can't make a statement reach `least` with any template."""
    w = weights(templates)
    for text in templates.values():
        square = {t: (k * w[t]) ** 2 for t, k in terms(text).items()}
        if sum(v for t, v in square.items() if t in COMMON) >= least**2 * sum(square.values()):
            return False
    return True


def long_ok(long: list[tuple[str, str]]) -> bool:
    return all(re.search(LEGAL, text) for _, text in long)


def _header(text: Column) -> Column:
    text = F.regexp_replace(text, r"^(#![^\n]*\n)?\s*", "")
    lines = F.split(text, "\n")
    other = F.array_position(F.transform(lines, lambda x: ~x.rlike(COMMENT_LINE)), True).cast("int")
    marked = F.array_join(F.when(other == 0, lines).otherwise(F.slice(lines, F.lit(1), F.greatest(other - 1, F.lit(0)))), "\n")
    fenced = F.regexp_extract(text, FENCED, 1)
    return F.when(fenced != "", fenced).otherwise(marked)


def _identified(legal: DataFrame, names: list[str]) -> DataFrame:
    """(key, licence) of the files with a known SPDX identifier."""
    known = F.create_map(*[F.lit(x) for name in names for x in (name.lower(), name)])
    ids = F.regexp_extract_all(F.lower(F.regexp_extract("text", IDENTIFIER, 1)), F.lit("([a-z0-9.+-]+)"))
    found = F.filter(F.transform(ids, lambda x: F.try_element_at(known, F.regexp_replace(x, r"(-only|-or-later|\+)$", ""))), lambda x: x.isNotNull())
    return legal.where(F.col("text").rlike(IDENTIFIER)).select("key", F.get(found, F.lit(0)).alias("licence")).where("licence IS NOT NULL")


def _alike(legal: DataFrame, long: list[tuple[str, str]], least: float) -> DataFrame:
    """(key, kind, licence, score): the whole files (kind 1), header blocks (2) and their paragraphs (3) that reach `least` with a whole text or header."""
    if not long_ok(long):
        raise ValueError("a whole text or header has none of the legal words")
    counts = [terms(text) for _, text in long]
    df = Counter(t for c in counts for t in c)
    idf = {t: math.log((1 + len(long)) / (1 + k)) + 1 for t, k in df.items()}
    damped = [{t: (1 + math.log(k)) * idf[t] for t, k in c.items()} for c in counts]
    spark = legal.sparkSession
    weights_ = spark.createDataFrame(list(idf.items()), "term string, idf double")
    table = spark.createDataFrame(
        [(i, name, t, v * idf[t], math.sqrt(sum(x * x for x in d.values()))) for i, ((name, _), d) in enumerate(zip(long, damped)) for t, v in d.items()],
        "template int, licence string, term string, weight double, norm double")
    header = F.lower(_header(F.col("text")))
    paragraphs = F.split(F.regexp_replace(header, MARK, ""), r"\n[ \t\r]*\n")
    runs = F.flatten(F.transform(paragraphs, lambda _, i: F.transform(
        F.array(*map(F.lit, range(1, PARAGRAPHS + 1))), lambda k: F.array_join(F.slice(paragraphs, i + 1, k), "\n"))))
    blocks = legal.select("key", F.posexplode(F.concat(F.array(F.lower("text"), header), F.array_distinct(runs))).alias("block", "s")).where(F.col("s").rlike(LEGAL))
    words = blocks.select("key", "block", F.explode(F.regexp_extract_all("s", F.lit(f"({TERM})"))).alias("term"))
    words = words.groupBy("key", "block", "term").agg((F.log(F.count("*")) + 1).alias("v"))
    norms = words.join(F.broadcast(weights_), "term", "left").groupBy("key", "block").agg(
        F.sqrt(F.sum(F.pow(F.col("v") * F.coalesce("idf", F.lit(math.log(1 + len(long)) + 1)), 2))).alias("own"))
    dots = words.join(F.broadcast(table), "term").groupBy("key", "block", "template", "licence").agg(
        F.sum(F.col("v") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.join(norms, ["key", "block"]).select(
        "key", F.least(F.col("block") + 1, F.lit(3)).alias("kind"), "licence", F.round(F.col("dot") / (F.col("norm") * F.col("own")), 6).alias("score"))
    return scored.where(F.col("score") >= least)


def own_licences(files: DataFrame, key: str, *, templates: dict[str, str] = TEMPLATES, least: float = 0.75,
                 long: list[tuple[str, str]] | None = None) -> DataFrame:
    """(key, licence, score, statement) of the files that bear a licence. `key` names a file."""
    long = long_templates() if long is None else long
    if not templates_ok(templates, least):
        raise ValueError("a template consists of common words")
    w = weights(templates)
    rare = sorted(t for t in w if t and t not in COMMON)
    telling = F.filter(F.transform(F.split(F.coalesce(F.lower("text"), F.lit("")), STATEMENT_BREAK), lambda s, i: F.struct(i.alias("i"), s.alias("s"))),
                       lambda x: x["s"].rlike(r"(^|[^a-z0-9])(" + "|".join(rare) + r")($|[^a-z0-9])"))
    found = files.select(F.col(key).alias("key"), F.explode(telling).alias("x")).distinct()  # repeated rows once
    words = found.select("key", "x.i", F.explode(F.regexp_extract_all("x.s", F.lit(f"({TERM})"))).alias("term"))
    words = words.groupBy("key", "i", "term").agg(F.count("*").alias("k"))
    spark = files.sparkSession
    table = spark.createDataFrame(  # a row per template and term: as small as the templates
        [(name, t, float(k) * w[t] ** 2, math.sqrt(sum((n * w[x]) ** 2 for x, n in terms(text).items())))
         for name, text in templates.items() for t, k in terms(text).items()], "licence string, term string, weight double, norm double")
    idf = F.lit(w[""])
    for t, value in w.items():
        idf = F.when(F.col("term") == t, F.lit(value)).otherwise(idf)
    norms = words.groupBy("key", "i").agg(F.sqrt(F.sum(F.pow(F.col("k") * idf, 2))).alias("own"))
    dots = words.join(F.broadcast(table), "term").groupBy("key", "i", "licence").agg(
        F.sum(F.col("k") * F.col("weight")).alias("dot"), F.first("norm").alias("norm"))
    scored = dots.join(norms, ["key", "i"]).select(
        "key", "licence", F.col("i").alias("statement"), F.round(F.col("dot") / (F.col("norm") * F.col("own")), 6).alias("score"))
    legal = files.select(F.col(key).alias("key"), F.col("text").cast("string").alias("text")).where(F.col("text").rlike(LEGAL)).distinct()
    names = sorted({*templates, *(name for name, _ in long)} - {"proprietary"})
    ways = scored.where(F.col("score") >= least).select("key", F.lit(4).alias("kind"), "score", "statement", "licence").unionByName(
        _identified(legal, names).select("key", F.lit(0).alias("kind"), F.lit(1.0).alias("score"), F.lit(None).cast("int").alias("statement"), "licence")).unionByName(
        _alike(legal, long, least).select("key", "kind", "score", F.lit(None).cast("int").alias("statement"), "licence"))
    best = F.struct("kind", (-F.col("score")).alias("s"), "statement", "licence")
    return ways.groupBy("key").agg(F.min(best).alias("b")).select(
        F.col("key").alias(key), "b.licence", (-F.col("b.s")).alias("score"), "b.statement")


def _directory(path: Column) -> Column:
    return F.regexp_extract(F.coalesce(path, F.lit("")), "^(.*)/[^/]*$", 1)


def licences(files: DataFrame, key: str, *, licence_file: Column | None = None, templates: dict[str, str] = TEMPLATES,
             least: float = 0.75) -> DataFrame:
    """The files with `licence` (name, origin, score, directory) in a struct: their own, an inherited one, or NULLs.

    files: the key, `path` and `text`. `licence_file` tells which files speak for their directory."""
    is_file = F.regexp_extract(F.coalesce("path", F.lit("")), "([^/]*)$", 1).rlike(LICENCE_FILE) if licence_file is None else licence_file
    own = own_licences(files, key, templates=templates, least=least).select(
        F.col(key).alias("own_key"), F.col("licence").alias("own_name"), F.col("score").alias("own_score"))
    rows = files.select(F.struct(*[F.col(f"`{c}`") for c in files.columns]).alias("row"), F.col(f"`{key}`").alias("own_key"),
                        _directory(F.col("path")).alias("dir"), F.col("path"), F.coalesce(is_file, F.lit(False)).alias("speaks"))
    slim = rows.select("own_key", "dir", "path", "speaks").join(own, "own_key", "left")
    spoken = slim.where(F.col("speaks") & F.col("own_name").isNotNull()).groupBy("dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_name").alias("name"), "path")).alias("b"))
    spoken = spoken.select(F.col("dir").alias("up"), F.col("b.name").alias("name"), (-F.col("b.s")).alias("score"))
    # every directory and its ancestors, itself and the root among them
    parts = F.split("dir", "/")
    ups = F.when(F.col("dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(
        parts, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))))
    directories = slim.groupBy("dir").agg(F.count("*").alias("n")).select("dir", F.explode(F.array_distinct(ups)).alias("up"))
    nearest = directories.join(spoken, "up").groupBy("dir").agg(F.max_by(F.struct("name", "score", "up"), F.length("up")).alias("given"))
    out = slim.where("own_name IS NULL").select("own_key", "dir").distinct().join(nearest, "dir").select("own_key", "dir", "given")
    joined = rows.join(own, "own_key", "left").join(out, ["own_key", "dir"], "left")
    has = F.col("own_name").isNotNull()
    licence = F.struct(
        F.coalesce("own_name", "given.name").alias("name"),
        F.when(has, "own").when(F.col("given").isNotNull(), "inherited").alias("origin"),
        F.coalesce("own_score", "given.score").alias("score"),
        F.when(has, F.col("dir")).otherwise(F.col("given.up")).alias("directory"))
    return joined.select(*[F.col("row").getField(c).alias(c) for c in files.columns if c != "licence"], licence.alias("licence"))
