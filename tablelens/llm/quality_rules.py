"""Quality by weak supervision: rules vote or abstain, expectation-maximisation weighs them. DataFrame functions only.

Base figures are counted over the whole text; two hard base rules fail a document at once. Beyond that each rule
votes good, bad or not at all. A latent class (good or bad) stands behind the votes: expectation-maximisation over the
counts of all vote patterns (at most 3 ** rules rows, counted over all documents) estimates the share of good documents
and, per rule, how often its votes are right on good and on bad documents; abstentions say nothing. A document is kept
if its posterior probability of being good is at least `least`.

Fixed choice: a rule knows one kind of bad document, so it may miss most bad ones, but it is held to vote bad on at most
one in 500 good ones; the start keeps a small weight in every estimate. So the classes can't change places.

Defined cases: a NULL text has no words; a document without words fails the base rules; one on which every rule
abstains has the share of good documents as its posterior; repeated rows are judged alike; other columns are kept as
they are, but those with the name of an added column are replaced. No documents give no rows.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .native import SPACE_CLASS, upto, words

GOOD, BAD, ABSTAIN = "g", "b", "-"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5


#: Where the estimation starts, and the least share of good documents on which a rule does not vote bad.
SPECIFIC, SENSITIVE, LEAST_SPECIFIC = 0.998, 0.3, 0.998
#: Weight of the start in every estimate, as a share of all documents.
HELD = 0.001


class Fitted(NamedTuple):
    prior: float  # share of good documents
    accuracy: list[dict[str, float]]  # per rule: class, share of right votes among its votes


#: Columns that `figures` adds; the names beginning with q_ are for the rules only.
FIGURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "q_n_lines", "q_signs", "q_digits", "q_upper",
           "q_shouts", "q_stops", "q_bars", "q_distinct", "q_text_words", "q_words", "q_windows", "q_lines")


def _repeat_words(windows: Column) -> Column:
    """Words inside windows (hashes in order) that occur twice or more: equal neighbours in the order of hashes repeat."""
    def covered(ordered: Column) -> Column:
        def h(i: Column) -> Column:
            return F.get(ordered, i)["h"]
        again = F.filter(upto(F.size(ordered)), lambda i: (h(i) == h(i - 1)) | (h(i) == h(i + 1)))
        places = F.array_sort(F.transform(again, lambda i: F.get(ordered, i)["i"]))
        return F.aggregate(places, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda acc, p: F.struct(
            (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n"), p.alias("last")), lambda acc: acc["n"])

    ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    # the array of one lets the order be made once for all looks at it
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
        F.element_at(F.transform(F.array(ordered), covered), 1))


def _bound(rows: DataFrame, **columns: Column) -> DataFrame:
    """Add columns as the output of a generator: they are computed once per row, as no filter or projection over them is
    merged into what makes them."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def figures(docs: DataFrame) -> DataFrame:
    """Add the base figures, and those that only the rules need (their names begin with `q_`)."""
    docs = docs.drop(*FIGURES, "base_failed", "votes", "quality", "kept")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike("[^" + SPACE_CLASS[1:]))

    def count(pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    out = _bound(docs, q_text_words=words(F.col("text")), q_lines=F.transform(lines, lambda x: F.xxhash64(x)))
    out = _bound(out, q_words=F.transform("q_text_words", lambda w: F.xxhash64(w)),
                 word_chars=F.length(F.array_join("q_text_words", "")).cast("long"))
    out = _bound(out, q_windows=F.transform(upto(F.size("q_words") - (WINDOW - 1)), lambda i: F.xxhash64(
        *[F.get(F.col("q_words"), i + k) for k in range(WINDOW)])))
    out = _bound(
        out, n_words=F.size("q_words").cast("long"), n_symbols=count(SYMBOLS).cast("long"),
        n_dup_lines=(F.size("q_lines") - F.size(F.array_distinct("q_lines"))).cast("long"),
        n_repeat_words=_repeat_words(F.col("q_windows")).cast("long"), q_n_lines=F.size("q_lines"),
        q_signs=count(r"[!-@\[-`{-~]"), q_digits=count("[0-9]"), q_upper=count("[A-Z]"), q_shouts=count("!"),
        q_stops=count("[.,;:?]"), q_bars=count("[|]"), q_distinct=F.size(F.array_distinct("q_words")))
    return out.select(*docs.columns, *[c for c in FIGURES if c not in ("q_text_words", "q_words", "q_windows", "q_lines")])


def vote(bad: Column, good: Column) -> Column:
    return F.when(bad, BAD).when(good, GOOD).otherwise(ABSTAIN)


def rules() -> dict[str, Column]:
    """Votes from the figures, as columns of one letter."""
    n, chars = F.col("n_words"), F.col("word_chars")
    letters, undigited = chars - F.col("q_signs"), chars - F.col("q_digits")
    return {
        "symbols": vote(F.col("n_symbols") * 10 > n, F.col("n_symbols") * 100 < n),
        "word_length": vote((chars > 12 * n) | (chars < 3 * n), chars.between(4 * n, 9 * n)),
        "capitals": vote(F.col("q_upper") * 3 > letters, F.col("q_upper") * 10 < letters),
        "shouting": vote(F.col("q_shouts") * 10 > n, F.col("q_shouts") * 100 < n),
        "letters": vote(letters * 10 < undigited * 7, letters * 10 > undigited * 9),
        "digits": vote(F.col("q_digits") * 2 > chars, F.col("q_digits") * 20 < chars),
        "tables": vote(F.col("q_bars") * 10 > n, F.col("q_bars") * 100 < n),
        "sentences": vote((n >= 20) & (F.col("q_stops") * 60 < n), F.col("q_stops") * 25 > n),
        "repeated_lines": vote(F.col("n_dup_lines") * 3 > F.col("q_n_lines") * 2, (F.col("q_n_lines") > 3) & (F.col("n_dup_lines") == 0)),
        "repeated_words": vote(F.col("n_repeat_words") * 5 > n, (n >= 50) & (F.col("n_repeat_words") * 50 < n)),
        "vocabulary": vote((n >= 50) & (F.col("q_distinct") * 5 < n), (n >= 50) & (F.col("q_distinct") * 5 > n * 2)),
    }


def fit(patterns: list[tuple[str, int]], n_rules: int, *, prior: float = 0.9, rounds: int = 300) -> Fitted:
    """Expectation-maximisation over (votes, documents)."""
    fitted = Fitted(prior, [{GOOD: SPECIFIC, BAD: SENSITIVE}] * n_rules)
    total = sum(count for _, count in patterns)
    for _ in range(rounds if total else 0):
        good = [(votes, count, posterior(votes, fitted) * count) for votes, count in patterns]
        accuracy = []
        for rule in range(n_rules):
            right, voted = {GOOD: SPECIFIC * HELD * total, BAD: SENSITIVE * HELD * total}, {GOOD: HELD * total, BAD: HELD * total}
            for votes, count, p in good:
                v = votes[rule]
                if v != ABSTAIN:
                    right[v] += p if v == GOOD else count - p
                    voted[GOOD] += p
                    voted[BAD] += count - p
            specific = min(0.9999, max(LEAST_SPECIFIC, right[GOOD] / voted[GOOD]))
            # bad votes are never more frequent on good documents than on bad ones
            accuracy.append({GOOD: specific, BAD: min(0.99, max(1 - specific, right[BAD] / voted[BAD]))})
        new = Fitted(min(0.99, max(0.5, sum(p for _, _, p in good) / total)), accuracy)
        moved = max(abs(new.prior - fitted.prior), *(abs(a[c] - b[c]) for a, b in zip(new.accuracy, fitted.accuracy) for c in a))
        fitted = new
        if moved < 1e-9:
            break
    return fitted


def posterior(votes: str, fitted: Fitted) -> float:
    odds = math.log(fitted.prior / (1 - fitted.prior)) + sum(_weight(a, v) for a, v in zip(fitted.accuracy, votes))
    return 1 / (1 + math.exp(-odds))


def _weight(accuracy: dict[str, float], vote: str) -> float:
    if vote == ABSTAIN:
        return 0.0
    on_good, on_bad = accuracy[GOOD], 1 - accuracy[BAD]
    return math.log(on_good / on_bad) if vote == GOOD else math.log((1 - on_good) / (1 - on_bad))


def judged(docs_with_figures: DataFrame, *, least: float = 0.5) -> DataFrame:
    """Add `votes`, `quality` (the posterior) and `kept`. Reads its input twice: stage it first."""
    n = F.col("n_words")
    own = rules()
    base = (n < 10) | (F.col("n_repeat_words") * 100 > n * 20)
    rows = docs_with_figures.withColumn("base_failed", base).withColumn("votes", F.concat(*own.values()))
    counts = [(r.votes, r.n) for r in rows.groupBy("votes").agg(F.count("*").alias("n")).orderBy("votes").collect()]
    fitted = fit(counts, len(own))
    odds = F.lit(math.log(fitted.prior / (1 - fitted.prior)))
    for i, accuracy in enumerate(fitted.accuracy):
        v = F.substr("votes", F.lit(i + 1), F.lit(1))
        odds = odds + F.when(v == GOOD, F.lit(_weight(accuracy, GOOD))).when(v == BAD, F.lit(_weight(accuracy, BAD))).otherwise(F.lit(0.0))
    return rows.withColumn("quality", 1 / (1 + F.exp(-odds))).withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
