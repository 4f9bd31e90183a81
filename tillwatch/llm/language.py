"""Language identification by error-correcting output codes over hashed character n-grams."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm.batches import flat, map_columns
from tillwatch.llm.linear import char_grams, collect_vectors, fit_logistic, shares

#: About so many documents are learned from, equally many of each language as far as there are.
SAMPLE = 2400
#: So many values of lang are learned, those with the most documents.
MOST_LANGUAGES = 400
#: Slots for each length of n-grams.
SLOT_BITS, LENGTHS = 11, (1, 2, 3, 4)
SIZE = len(LENGTHS) << SLOT_BITS
UNDETERMINED = "und"
#: A text is ambiguous if the loss of the second best language is less than this above the best.
CLEAR = 0.1
#: Sharpness of scores: the loss is a mean over bits.
SHARPNESS = 8.0

#: A-Z as a-z; what is ASCII but no letter tells nothing of a language and is a space.
LETTERS = np.array([b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
#: Features of a text shrink as if it had so many more bytes: short texts give less certain margins.
SHORT = 16


class Model(NamedTuple):
    languages: list[str]
    code: np.ndarray  # languages x bits, 1 or -1
    weights: np.ndarray  # features x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit in decoding, sum 1


def codewords(n: int) -> np.ndarray:
    """Codewords of n languages as 1 and -1: all ways to part them in two up to six, else the best of seeded draws."""
    if n < 2:
        return np.ones((n, 0), np.int64)
    if n <= 6:
        bits = 2 ** (n - 1) - 1
        return np.array([[1 if i == 0 or not (c + 1) >> (i - 1) & 1 else -1 for c in range(bits)] for i in range(n)])
    draw, bits, best = np.random.default_rng(1), 10 * math.ceil(math.log2(n)), (-1, None)
    for _ in range(200):
        code = np.where(draw.random((n, bits)) < 0.5, 1, -1)
        apart = (bits - code @ code.T) // 2 + bits * np.eye(n, dtype=np.int64)
        if apart.min() > best[0]:
            best = int(apart.min()), code
    return best[1][:, np.abs(best[1].sum(0)) < n]


def vectors(texts: pa.Array):
    """Shares of hashed 1 to 4 bytes of the LETTERS of every text, one vector after the other."""
    data, offsets = flat(texts)
    data = LETTERS[data]
    for a, b in zip(offsets[:-1], offsets[1:]):
        own = data[a:b]
        own = own[np.concatenate(([True], (own[1:] != 32) | (own[:-1] != 32)))] if len(own) else own
        yield shares([char_grams(own, n, SLOT_BITS) for n in LENGTHS], 1 << SLOT_BITS) * np.float32(len(own) / (len(own) + SHORT))


def held_out(doc_id: Column, folds: int = 5) -> Column:
    """crc32 of the id as text is divisible by ``folds``; documents without id are never learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == 0, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE, most: int = MOST_LANGUAGES) -> Model:
    """Learn from documents with id, text and lang. About ``sample`` are chosen by a hash of id and text.

    Each bit of the code is one logistic regression. A quarter of the sample is kept back to see how
    far each bit can be trusted. Of more than ``most`` values of lang those with the most documents are learned (ties: the
    first by name), and texts of others get the nearest of these; a value of which nothing was chosen is not learned
    either. Copies of a row count once in the sample, so it is the same however the rows are dealt.
    """
    rows = docs.where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", "text")
    totals = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(most).collect()
    each = max(sample // max(len(totals), 1), 1)
    part = F.xxhash64("doc_id", "text", F.lit("lang"))
    few = spark_rows(docs, [(r.lang, int(min(each / r.n, 1) * (1 << 30))) for r in totals], "lang string, below long")
    drawn = rows.withColumn("part", part).join(F.broadcast(few), "lang").where(F.pmod("part", F.lit(1 << 30)) < F.col("below"))
    chosen = drawn.groupBy("doc_id", "lang", "part").agg(F.first("text").alias("text")).select("doc_id", "lang", "text")
    x, names = collect_vectors(chosen, "lang", vectors, SIZE)
    languages = sorted(set(names))
    code = codewords(len(languages))
    nothing = Model(languages, code, np.zeros((SIZE, code.shape[1]), np.float32), np.zeros(code.shape[1]), np.ones(code.shape[1]))
    place = {name: i for i, name in enumerate(languages)}
    number = np.array([place[n] for n in names], np.int64)
    if len(set(number.tolist())) < 2:
        return nothing
    y = (code[number] > 0).astype(np.float32)
    weight = 1 / np.bincount(number, minlength=len(languages))[number]
    back = np.arange(len(number)) % 4 == 0 if len(number) >= 40 else np.zeros(len(number), bool)
    w, b = fit_logistic(x[~back], y[~back], weight[~back])
    test = back if back.any() else ~back
    right = (((x[test] @ w + b) > 0) == (y[test] > 0)).mean(0)
    trust = np.log(np.clip(right, 0.5, 0.999) / (1 - np.clip(right, 0.5, 0.999))) + 1e-3
    return Model(languages, code, w, b, trust / trust.sum())


def spark_rows(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def decode(margins: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language, score and ambiguity by the trusted mean of the logistic losses of all bits."""
    signed = margins[:, None, :] * model.code[None, :, :]
    loss = (np.logaddexp(0, -signed) * model.trust).sum(2)
    best = loss.argmin(1)
    likely = np.exp(-SHARPNESS * (loss - loss.min(1, keepdims=True)))
    score = likely[np.arange(len(best)), best] / likely.sum(1)
    gap = np.partition(loss, 1, axis=1)[:, 1] - loss.min(1) if loss.shape[1] > 1 else np.full(len(best), np.inf)
    return best, score, gap < CLEAR


def has_letter(text: bytes | None) -> bool:
    if not text:
        return False
    if any(97 <= c <= 122 for c in text[:64].lower()):
        return True
    return any(map(str.isalpha, text.decode("utf-8")))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, score (0 to 1) and ambiguous.

    Only the text is looked at. Null texts and texts without a letter, and all texts if nothing was learned,
    are ``und`` with score 0 and not ambiguous. With one learned language every other text has it, with score 1.
    Columns of ``docs`` that have one of the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def name(texts: pa.Array) -> list:
        m = shared.value
        known = np.array([has_letter(t) for t in texts.cast(pa.binary()).to_pylist()], bool) & bool(m.languages)
        if not known.any():
            n = len(texts)
            return [pa.array([UNDETERMINED] * n), pa.array(np.zeros(n)), pa.array(np.zeros(n, bool))]
        margins = np.array([v @ m.weights for v in vectors(texts)], np.float64).reshape(len(texts), -1) + m.bias
        best, score, unclear = decode(margins, m)
        names = [m.languages[i] if k else UNDETERMINED for i, k in zip(best, known)]
        return [pa.array(names), pa.array(np.where(known, score, 0.0)), pa.array(known & unclear)]

    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    return map_columns(docs, ["text"], fields, name)
