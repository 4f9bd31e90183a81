"""Substring dedup by seed and extend: winnowed anchors meet, matches are extended, repeats of 35 words go.

Seeds. Of every window of ``length`` words the smallest hash of ``seed`` consecutive words in it is
the anchor (leftmost of equals), so equal windows have equal anchors at the same place, and
neighbouring windows mostly share theirs: about one anchor per 12 words leaves a text.

Extension. The windows that share an anchor make up its extent, the longest stretch of text
that the anchor stands for. Occurrences of an anchor whose whole extents are equal match over the
extent. Where extents of one anchor differ (at the ends of a repeat), one sample of each extent is
extended window by window, to the left and right of the anchor. Equal windows of two extents are repeats in
all occurrences of both. Overlapping windows are the maximal repeats.

Occurrences are counted, never paired, so a passage with n copies costs n rows. Windows count as
equal if a 64-bit hash of the anchor and one of the window or extent are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm.batches import find_words, flat, map_columns, rows_of, running, span_hash, whole_grams, word_hashes
from tillwatch.llm.keys import KEY, keyed
from tillwatch.session import materialise

LENGTH = 35
SEED = 12

RUNS = rows_of(anchor=T.LongType(), extent=T.LongType(), at=T.IntegerType(), n=T.IntegerType())
WINDOWS = rows_of(anchor=T.LongType(), extent=T.LongType(), offset=T.IntegerType(), window=T.LongType())


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """For each i the place of the smallest of values[i : i + width], the leftmost of equals."""
    best, have = np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        left, right = best[:-step], best[step:]
        best = np.where(values[right] < values[left], right, left)
        have += step
    return best


def list_of(offsets: np.ndarray, **columns: np.ndarray) -> pa.ListArray:
    values = pa.StructArray.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def runs_of(texts: pa.Array, length: int, seed: int) -> pa.ListArray:
    """For each text its anchors: hash of the anchor, hash of the extent, first window, number of windows."""
    words = find_words(*flat(texts))
    starts = whole_grams(words, length)
    if not len(starts):
        nothing = np.zeros(0, np.int64)
        return list_of(np.zeros(len(texts) + 1), anchor=nothing, extent=nothing, at=nothing.astype(np.int32), n=nothing.astype(np.int32))
    sums = running(word_hashes(words))
    places = np.arange(len(words.doc) - seed + 1)
    grams = span_hash(sums, places, places + seed)
    anchor = window_minima(grams, length - seed + 1)[starts]
    first = np.flatnonzero(np.concatenate(([True], anchor[1:] != anchor[:-1])))
    last = np.concatenate((first[1:], [len(anchor)])) - 1
    extents = span_hash(sums, starts[first], starts[last] + length)
    doc = words.doc[starts[first]]
    return list_of(
        np.searchsorted(doc, np.arange(len(texts) + 1)),
        anchor=grams[anchor[first]].view(np.int64),
        extent=extents.view(np.int64),
        at=(starts[first] - words.first[doc]).astype(np.int32),
        n=(last - first + 1).astype(np.int32),
    )


def windows_of(texts: pa.Array, runs: pa.ListArray, length: int) -> pa.ListArray:
    """For each run the hashes of its windows."""
    words = find_words(*flat(texts))
    sums = running(word_hashes(words))
    rows = runs.flatten()
    doc = np.repeat(np.arange(len(runs)), runs.value_lengths().to_numpy())
    at, n = rows.field("at").to_numpy() + words.first[doc], rows.field("n").to_numpy()
    run = np.repeat(np.arange(len(rows)), n)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start = at[run] + offset
    return list_of(
        np.searchsorted(doc[run], np.arange(len(texts) + 1)),
        anchor=rows.field("anchor").to_numpy()[run],
        extent=rows.field("extent").to_numpy()[run],
        offset=offset.astype(np.int32),
        window=span_hash(sums, start, start + length).view(np.int64),
    )


def cut(texts: pa.Array, hits: pa.ListArray, length: int) -> list[pa.Array]:
    """Number of words, number of words in hits, and the words outside joined by one space."""
    data, offsets = flat(texts)
    words = find_words(data, offsets)
    rows = hits.flatten()
    doc = np.repeat(np.arange(len(hits)), hits.value_lengths().fill_null(0).to_numpy())
    lists = rows.field("offsets")
    sizes = lists.value_lengths().fill_null(0).to_numpy() if len(rows) else np.zeros(0, np.int64)
    at = rows.field("at").to_numpy() + words.first[doc]
    whole = sizes == 0
    start = np.concatenate((at[whole], np.repeat(at, sizes) + lists.flatten().to_numpy()))
    end = np.concatenate(((at + rows.field("n").to_numpy())[whole], np.repeat(at, sizes) + lists.flatten().to_numpy() + 1)) + length - 1
    change = np.zeros(len(words.doc) + 1, np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, end, -1)
    gone = np.cumsum(change[:-1]) > 0
    # Bytes of words that stay, and one space before each but the first of a text.
    byte = np.zeros(len(data) + 1, np.int64)
    np.add.at(byte, words.start[~gone], 1)
    np.add.at(byte, words.end[~gone], -1)
    stay = np.cumsum(byte[:-1]) > 0
    kept_start, kept_doc = words.start[~gone], words.doc[~gone]
    lead = np.zeros(len(data), bool)
    lead[kept_start[1:][kept_doc[1:] == kept_doc[:-1]]] = True
    width = stay.astype(np.int64) + lead
    ends = np.concatenate(([0], np.cumsum(width)))
    out = np.full(ends[-1], 32, np.uint8)
    out[ends[1:][stay] - 1] = data[stay]
    text_offsets = ends[offsets].astype(np.int32)
    kept = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(text_offsets), pa.py_buffer(out)]).cast(pa.string())
    removed = np.bincount(words.doc[gone], minlength=len(texts))
    return [pa.array(np.diff(words.first)), pa.array(removed.astype(np.int64)), kept]


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """``docs`` with n_words, n_removed and kept: the words not in any window of ``length`` words that occurs twice.

    Words are ``[^\\x20\\x09-\\x0D]+``, compared as they are; kept ones are joined by one space. Windows
    are those of the input: both places of a repeat go, in one document or two. Null and empty texts
    have no words and an empty ``kept``; shorter ones than a window stay whole; repeated rows repeat each
    other's windows. Columns of ``docs`` with one of the new names are replaced.
    """
    docs = keyed(docs)
    seen = map_columns(docs.select(*KEY, "text"), ["text"], [T.StructField("runs", RUNS)], lambda t: [runs_of(t, length, seed)])
    seen = materialise(seen.select(*KEY, F.inline("runs")), "seeds")
    anchors = seen.groupBy("anchor").agg(F.count(F.lit(1)).alias("c"), F.min("extent").alias("low"), F.max("extent").alias("high"))
    # Written, so that a join with a hot anchor has a plain exchange on both sides and can be split.
    anchors = materialise(anchors.where("c > 1").select("anchor", (F.col("low") != F.col("high")).alias("ends_differ")), "anchors")
    met = materialise(seen.join(anchors, "anchor"), "met")

    sample = F.min(F.struct(*KEY, "at", "n")).alias("sample")
    extents = met.groupBy("anchor", "extent").agg(F.count(F.lit(1)).alias("copies"), F.first("ends_differ").alias("ends_differ"), sample)
    extents = materialise(extents.where("copies > 1 OR ends_differ"), "extents")
    open_ends = extents.where("ends_differ").select("anchor", "extent", "sample.*")
    asked = open_ends.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "extent", "at", "n")).alias("runs"))
    texts = docs.select(*KEY, "text").join(asked, KEY)
    windows = map_columns(texts, ["text", "runs"], [T.StructField("windows", WINDOWS)], lambda t, r: [windows_of(t, r, length)])
    windows = materialise(windows.select(F.inline("windows")), "windows")
    twice = materialise(windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("c")).where("c > 1").drop("c"), "twice")
    partial = windows.join(twice, ["anchor", "window"]).groupBy("anchor", "extent").agg(F.collect_set("offset").alias("offsets"))
    # An extent that occurs twice is hit as a whole: no offsets.
    whole = extents.where("copies > 1").select("anchor", "extent", F.array().cast("array<int>").alias("offsets"))
    once = extents.where("copies = 1").select("anchor", "extent").join(partial, ["anchor", "extent"])
    hits = met.drop("ends_differ").join(whole.unionByName(once), ["anchor", "extent"])
    hits = hits.groupBy(*KEY).agg(F.collect_list(F.struct("at", "n", "offsets")).alias("__hits"))
    fields = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())]
    joined = docs.join(hits, KEY, "left")
    return map_columns(joined, ["text", "__hits"], fields, lambda t, h: cut(t, h, length)).drop(*KEY, "__hits")
