"""Quality rules: counts of each text, and a calibrated logistic regression over hashed n-grams."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm.batches import IS_SPACE, code_points, find_words, flat, map_columns, mix, running, span_hash, whole_grams, word_hashes
from tillwatch.llm.linear import char_grams, collect_vectors, fit_logistic, platt, shares, text_words, word_grams

#: At most so many labelled documents of each class are learned from, those with the smallest hash of the id.
SAMPLE = 1200
#: Slots for each of words, pairs of words, single characters and three characters.
SLOT_BITS = 11
SIZE = 4 << SLOT_BITS
#: A document is kept if it is good with at least this probability.
KEEP_FROM = 0.5
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 50, 50, 3

IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(b"#*$%&|<>")] = True

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


class Model(NamedTuple):
    weights: np.ndarray
    bias: float
    slope: float
    shift: float


def repeats_in(doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """True where a hash occurs twice in its text, and where it occurred earlier in it."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    own = mix(hashes + mix(doc.astype(np.uint64)))
    order = np.argsort(own, kind="stable")
    same = own[order][1:] == own[order][:-1]
    twice, earlier = np.zeros(len(own), bool), np.zeros(len(own), bool)
    earlier[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, earlier


def counts_of(texts: pa.Array) -> list[np.ndarray]:
    """COUNTS of every text."""
    data, offsets = flat(texts)
    words = find_words(data, offsets)
    hashes = word_hashes(words)
    space = IS_SPACE[data]

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(flags)))[offsets])

    starts = whole_grams(words, REPEAT_WINDOW)
    sums = running(hashes)
    twice, _ = repeats_in(words.doc[starts], span_hash(sums, starts, starts + REPEAT_WINDOW))
    change = np.zeros(len(words.doc) + 1, np.int64)
    change[starts[twice]] += 1
    change[starts[twice] + REPEAT_WINDOW] -= 1
    repeated = np.cumsum(change[:-1]) > 0

    full = offsets[:-1][np.diff(offsets) > 0]
    line = np.unique(np.concatenate((full, np.flatnonzero(data == 10) + 1)))
    line = line[line < len(data)]
    line_end = np.concatenate((line[1:], [len(data)])) if len(line) else line
    line_end = line_end - (data[line_end - 1] == 10) if len(line) else line
    has_word = np.concatenate(([0], np.cumsum(~space)))
    has_word = has_word[line_end] > has_word[line]
    line, line_end = line[has_word], line_end[has_word]
    doc = np.searchsorted(offsets, line, "right") - 1
    byte_sums = running(data.astype(np.uint64) + np.uint64(1))
    _, again = repeats_in(doc, span_hash(byte_sums, line, line_end))
    n = len(texts)
    return [
        np.diff(words.first),
        per_text(code_points(data) & ~space),
        per_text(IS_SYMBOL[data]),
        np.bincount(doc[again], minlength=n),
        np.bincount(words.doc[repeated], minlength=n),
    ]


def vectors(texts: pa.Array):
    """Shares of hashed words, pairs of words, single and three characters of every text, one vector after the other."""
    data, offsets = flat(texts)
    words = find_words(data, offsets)
    hashes = word_hashes(words)
    for i in range(len(texts)):
        own = hashes[text_words(words, i)]
        chars = [char_grams(data[offsets[i] : offsets[i + 1]], n, SLOT_BITS) for n in (1, 3)]
        yield shares([word_grams(own, 1, SLOT_BITS), word_grams(own, 2, SLOT_BITS), *chars], 1 << SLOT_BITS)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from at most ``sample`` labelled documents of each class; a third of them calibrates.

    Probabilities are calibrated for the shares the classes have in all labels. Labels without
    id or quality are not used; of several for one document the lowest counts. With no
    document of one of the classes every document has the probability of the other one.
    """
    marks = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    totals = {r.quality: r.n for r in marks.groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = F.xxhash64("doc_id")
    chosen = [marks.where(F.col("quality") == q).orderBy(order, "doc_id").limit(sample) for q in (0, 1)]
    # At most 2 * sample rows of two numbers; the limit holds the bound if ids of documents repeat.
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionAll(chosen[1])), "doc_id").limit(2 * sample)
    x, y = collect_vectors(rows, "quality", vectors, SIZE)
    y = np.array(y, np.int64)
    if len(set(y.tolist())) < 2:
        sure = -30.0 if 0 in y else 30.0
        return Model(np.zeros(SIZE, np.float32), 0.0, 1.0, sure)
    share = np.array([totals[q] / max((y == q).sum(), 1) for q in (0, 1)])
    weight = share[y] / share.mean()
    place = np.zeros(len(y), np.int64)
    for q in (0, 1):
        place[y == q] = np.arange((y == q).sum())
    train = place % 3 != 0
    if len(set(y[train].tolist())) < 2:
        train[:] = True
    held = ~train if (~train).any() and not train.all() else train
    w, b = fit_logistic(x[train], y[train, None].astype(np.float32), np.where(y[train] == 1, 1 / (y[train] == 1).sum(), 1 / (y[train] == 0).sum()))
    slope, shift = platt(x[held] @ w[:, 0] + b[0], y[held], weight[held])
    return Model(w[:, 0], float(b[0]), slope, shift)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with COUNTS, probability (of being good), base_failed and kept.

    Words are ``[^\\x20\\x09-\\x0D]+``. base_failed: fewer than 50 words, or more than half of them in
    three-word windows that the text holds twice. kept: neither base_failed nor less probably good
    than KEEP_FROM. Null and empty texts have no words and fail; repeated rows get equal results;
    columns of ``docs`` that have one of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def judge(texts: pa.Array) -> list:
        m = shared.value
        counts = counts_of(texts)
        raw_scores = np.array([float(v @ m.weights) for v in vectors(texts)]) + m.bias
        probability = 1 / (1 + np.exp(-np.clip(m.slope * raw_scores + m.shift, -30, 30)))
        failed = (counts[0] < MIN_WORDS) | (100 * counts[4] > MAX_REPEAT_PERCENT * counts[0])
        return [*(pa.array(c.astype(np.int64)) for c in counts), pa.array(probability), pa.array(failed), pa.array(~failed & (probability >= KEEP_FROM))]

    fields = [T.StructField(c, T.LongType()) for c in COUNTS]
    fields += [T.StructField("probability", T.DoubleType()), T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType())]
    return map_columns(docs, ["text"], fields, judge)


def judge_quality(docs: DataFrame, labels: DataFrame, learn_from: DataFrame | None = None) -> DataFrame:
    """Fit on the labelled documents of ``learn_from`` (``docs`` by default) and score all of ``docs``."""
    return score(docs, fit(docs if learn_from is None else learn_from, labels))
