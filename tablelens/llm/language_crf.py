"""Language identification of words in their context by a linear-chain conditional random field.

A line of a text is a chain of words; each word has the languages as its possible labels. A word's features are its
byte n-grams of 1 to 4 with marks at its ends (so its affixes are among them) and the word itself (a learned lexicon),
hashed into one weight table; between words there is a learned table of transitions. Forward-backward gives every word
its probabilities, so text that switches its language is labelled part by part. A document's language has the largest
mean probability over its words with a letter; that mean is its score.

The weights are learned on the driver from a bounded sample: of every label the different texts with the least hash, so
that every label that has an example is learned, however rare it is and however often other texts are repeated. A label's
share is `sample_docs` by the number of labels, and `per_label` texts (or `sample_docs`, if less) at any rate. Examples have
at most `sample_chars` code points (longer ones are no examples, no text is cut). All else covers whole texts.

Defined cases: a text that is NULL or has no letter is `und` with score 0; without any labelled text every text is;
equal means go to the first label in alphabetical order; a NULL label is never learned; repeated rows are documents of
their own; other columns are kept out. No documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .word_hashes import Words, mix, words_of

_U = np.uint64
UNKNOWN = "und"
#: The bounded sample.
SAMPLE_DOCS, PER_LABEL, SAMPLE_CHARS = 600, 150, 30_000
TABLE_BITS = 17
LONGEST_GRAM = 4
EPOCHS, BATCH_CHAINS, RATE, DECAY = 4, 1_500, 0.4, 1e-6

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Model(NamedTuple):
    labels: list[str]
    weights: np.ndarray  # features x labels
    transitions: np.ndarray  # from x to
    start: np.ndarray


def _features(words: Words, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, where each word's begin) of the chosen words."""
    starts, ends = words.starts[chosen], words.ends[chosen]
    size = ends - starts + 2  # with a mark at either end
    first = np.cumsum(size) - size
    total = int(size.sum())
    word = np.repeat(np.arange(len(chosen)), size)
    inside = np.arange(total) - first[word]
    letters = np.empty(total, np.uint8)
    at_end = (inside == 0) | (inside == size[word] - 1)
    letters[~at_end] = _LOWER[words.data[(starts[word] + inside - 1)[~at_end]]]
    letters[inside == 0], letters[inside == size[word] - 1] = 2, 3
    value, room = np.zeros(total, _U), size[word] - inside
    ids, owners = [], []
    for k in range(1, LONGEST_GRAM + 1):
        shifted = np.zeros(total, _U)
        shifted[:total - k + 1] = letters[k - 1:]
        value = (value << _U(8)) | shifted
        ok = room >= k
        ids.append(mix(value[ok] + _U(k << 40)) >> _U(64 - TABLE_BITS))
        owners.append(word[ok])
    ids.append(mix(words.hashes[chosen] + _U(99)) >> _U(64 - TABLE_BITS))
    owners.append(np.arange(len(chosen)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    ids = np.concatenate(ids)[order].astype(np.int64)
    return ids, np.searchsorted(owner[order], np.arange(len(chosen)))


def _chains(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, length) of every line with words."""
    line = np.cumsum(words.data == 10)[words.starts]
    n = len(words.starts)
    new = np.ones(n, bool)
    new[1:] = (words.row[1:] != words.row[:-1]) | (line[1:] != line[:-1])
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, n))


def _marginals(scores: np.ndarray, first: np.ndarray, length: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of each word's labels, and the expected transitions summed over all chains."""
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    local = np.exp(scores - scores.max(axis=1, keepdims=True))
    step = np.exp(model.transitions)
    running = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
    forward, backward = np.empty_like(local), np.ones_like(local)
    now = np.exp(model.start) * local[first]
    now /= now.sum(axis=1, keepdims=True)
    forward[first] = now
    for t in range(1, len(running)):
        k = running[t]
        now = (now[:k] @ step) * local[first[:k] + t]
        now /= now.sum(axis=1, keepdims=True)
        forward[first[:k] + t] = now
    pairs = np.zeros_like(step)
    after = np.ones((0, local.shape[1]), local.dtype)
    for t in range(len(running) - 1, 0, -1):
        k = running[t]
        if len(after) < k:
            after = np.concatenate([after, np.ones((k - len(after), local.shape[1]), local.dtype)])
        here = first[:k] + t
        ahead = local[here] * after[:k]
        joint = forward[here - 1][:, :, None] * step[None] * ahead[:, None, :]
        pairs += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        after = ahead @ step.T
        after /= after.sum(axis=1, keepdims=True)
        backward[here - 1] = after
    both = forward * backward
    return both / both.sum(axis=1, keepdims=True), pairs


def train(texts: list[str], labels: list[str]) -> Model:
    """Weights by stochastic gradient ascent on the chains' likelihood; each word of a text bears its label."""
    names = sorted(set(labels))
    n_labels = len(names)
    model = Model(names, np.zeros((1 << TABLE_BITS, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32),
                  np.zeros(n_labels, np.float32))
    slices = list(words_of(pa.array(texts, pa.large_string())))
    squares = [np.full_like(a, 1e-4) for a in model[1:]]
    rng = np.random.default_rng(0)
    truth_of_row = np.array([names.index(x) for x in labels])
    for _ in range(EPOCHS):
        for words in slices:
            first, length = _chains(words)
            mix_up = rng.permutation(len(first))
            for at in range(0, len(mix_up), BATCH_CHAINS):
                some = mix_up[at:at + BATCH_CHAINS]
                size = length[some]
                starts = np.cumsum(size) - size
                index = np.repeat(first[some] - starts, size) + np.arange(int(size.sum()))
                truth = truth_of_row[words.first_row + words.row[index]]
                _, chosen, inverse = np.unique(words.hashes[index], return_index=True, return_inverse=True)
                ids, begin = _features(words, index[chosen])
                emitted = np.add.reduceat(model.weights[ids], begin, axis=0)
                probs, pairs = _marginals(emitted[inverse], starts, size, model)
                miss = -probs
                miss[np.arange(len(truth)), truth] += 1
                by_word = np.stack([np.bincount(inverse, miss[:, j], len(chosen)) for j in range(n_labels)], axis=1)
                spread = np.repeat(by_word, np.diff(np.append(begin, len(ids))), axis=0)
                gradient = np.stack([np.bincount(ids, spread[:, j], 1 << TABLE_BITS) for j in range(n_labels)], axis=1)
                seen = np.zeros_like(pairs)
                inner = np.ones(len(truth), bool)
                inner[starts] = False
                np.add.at(seen, (truth[np.flatnonzero(inner) - 1], truth[inner]), 1)
                begun = np.bincount(truth[starts], minlength=n_labels) - probs[starts].sum(axis=0)
                for values, g, square in zip(model[1:], (gradient, seen - pairs, begun), squares):
                    g = (g / len(truth)).astype(np.float32) - DECAY * values
                    square += g * g
                    values += RATE * g / np.sqrt(square)
    return model


def label_words(words: Words, model: Model) -> np.ndarray:
    """Probabilities of the labels of every word."""
    if not len(words.starts):
        return np.zeros((0, len(model.labels)), np.float32)
    _, chosen, inverse = np.unique(words.hashes, return_index=True, return_inverse=True)
    ids, begin = _features(words, chosen)
    emitted = np.add.reduceat(model.weights[ids], begin, axis=0)
    return _marginals(emitted[inverse], *_chains(words), model)[0]


def _least_hashes(usable: DataFrame, sample_docs: int, per_label: int) -> list[tuple[str, int]]:
    """(lang, h): the least different hashes of each label. Only sketches of counts and these hashes, some more at most, are sent."""
    zeros = F.when(F.col("h") < 0, 0).otherwise(64 - F.length(F.bin("h")))  # leading zeros; 0 has one digit
    counted: dict[str, dict[int, int]] = {}
    for r in usable.groupBy("lang", zeros.alias("zeros")).agg(F.approx_count_distinct("h").alias("n")).collect():
        counted.setdefault(r.lang, {})[r.zeros] = r.n
    if not counted:
        return []
    share = max(sample_docs // len(counted), min(sample_docs, per_label))
    found: dict[str, list[int]] = {}
    wanted, aim = dict(counted), 2 * share
    while wanted:
        least = {}  # of each label, the leading zeros that give enough
        for lang, by_zeros in wanted.items():
            total = 0
            for z in sorted(by_zeros, reverse=True):
                least[lang], total = z, total + by_zeros[z]
                if total >= aim:
                    break
        table = usable.sparkSession.createDataFrame(list(least.items()), "lang string, least int")
        some = usable.withColumn("zeros", zeros).join(F.broadcast(table), "lang").where("zeros >= least")
        got: dict[str, list[int]] = {}
        for r in some.select("lang", "h").distinct().collect():
            got.setdefault(r.lang, []).append(r.h)
        for lang in list(wanted):
            if len(got[lang]) >= share or least[lang] == min(wanted[lang]):
                found[lang] = sorted(got[lang], key=lambda h: h % 2**64)[:share]
                del wanted[lang]
        aim *= 4  # the counts are estimates
    return [(lang, h) for lang, hashes in found.items() for h in hashes]


def fit(labelled: DataFrame, *, sample_docs: int = SAMPLE_DOCS, per_label: int = PER_LABEL, sample_chars: int = SAMPLE_CHARS) -> Model | None:
    """labelled: (text, lang); other columns are ignored. The sample is the same for the same texts in any order and number."""
    usable = labelled.where(F.col("lang").isNotNull() & (F.length("text") <= sample_chars) & F.col("text").rlike(r"\p{L}"))
    usable = usable.select("text", "lang", F.xxhash64("text").alias("h"))
    chosen = _least_hashes(usable.select("lang", "h"), sample_docs, per_label)
    if not chosen:
        return None
    table = labelled.sparkSession.createDataFrame(chosen, "lang string, h long")
    rows = usable.join(F.broadcast(table), ["lang", "h"]).groupBy("lang", "h").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.h, r.lang))
    return train([r.text for r in rows], [r.lang for r in rows])


def predict(docs: DataFrame, model: Model | None, keep: list[str], *, certainty: bool = False) -> DataFrame:
    """The columns `keep`, `lang_pred` and `score` of every document, and `certainty` if asked for: the mean over its words
    with a letter of the probability of each word's likeliest label."""
    added = ["lang_pred", "score"] + ["certainty"] * certainty
    keep = [k for k in keep if k not in added]
    if model is None:
        none = [F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("certainty")]
        return docs.select(*[F.col(f"`{k}`") for k in keep], *none[:len(added)])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size: 2 ** TABLE_BITS rows
    once = "text" in keep and docs.schema["text"].dataType == StringType()  # a kept text is the one that is read
    others = [k for k in keep if not (once and k == "text")]
    places = [others.index(k) + 1 if k in others else 0 for k in keep]

    def classify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            text = batch.column(0)
            for words in words_of(text):
                found, score, sure = [], [], []
                probs = label_words(words, model)
                ascii_letter = np.zeros(len(words.data) + 1, np.int64)
                np.cumsum(((words.data | 32) - 97 < 26) | (words.data >= 128), out=ascii_letter[1:])
                lettered = ascii_letter[words.ends] > ascii_letter[words.starts]
                texts = text.slice(words.first_row, words.rows).to_pylist()
                for r, t in enumerate(texts):
                    a, b = words.bounds[r], words.bounds[r + 1]
                    if t is None or not any(map(str.isalpha, t)):
                        found.append(UNKNOWN)
                        score.append(0.0)
                        sure.append(0.0)
                        continue
                    each = probs[a:b][lettered[a:b]]
                    own = each.mean(axis=0, dtype=np.float64)
                    best = int(np.argmax(own))
                    found.append(model.labels[best])
                    score.append(min(1.0, float(own[best])))
                    sure.append(min(1.0, float(each.max(axis=1).mean(dtype=np.float64))) if certainty else 0.0)
                # the rows of each slice at once: neither side holds a second whole batch
                rows = batch.slice(words.first_row, words.rows)
                new = [pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.float64())]
                yield pa.RecordBatch.from_arrays([*[rows.column(i) for i in places], *new[:len(added)]], names=[*keep, *added])

    sent = docs.select(F.col("text").cast("string").alias("the text"), *[F.col(f"`{k}`") for k in others])
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)
    return sent.mapInArrow(classify, f"{fields}{', ' if fields else ''}lang_pred string, score double{', certainty double' if certainty else ''}")


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
