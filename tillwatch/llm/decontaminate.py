"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one scan of every text."""

from __future__ import annotations

import ahocorasick
import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm.batches import code_points, map_columns, raw
from tillwatch.session import materialise

WINDOW = 10
#: Items are scanned for in blocks of about so many bytes of text, each one automaton of bounded size.
BLOCK_BYTES = 400_000

#: A-Z becomes a-z, digits and all bytes from 0x80 stay, everything else separates words.
NORMAL = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", SPANS),
]


def windows_of(text: bytes, window: int) -> list[bytes]:
    words = text.translate(NORMAL).split()
    if len(words) <= window:
        return [b" ".join(words)] if words else []
    return [b" ".join(words[i : i + window]) for i in range(len(words) - window + 1)]


def automaton_of(items: list[tuple[str, bytes]], window: int) -> ahocorasick.Automaton:
    """Every window once, with its number of words and its items. Bytes are read as Latin-1: one character each."""
    found: dict[bytes, set[str]] = {}
    for item, text in items:
        for gram in windows_of(text, window):
            found.setdefault(gram, set()).add(item)
    automaton = ahocorasick.Automaton()
    for gram, names in found.items():
        automaton.add_word(f" {gram.decode('latin-1')} ", (gram.count(b" ") + 1, len(gram) + 2, sorted(names)))
    if found:
        automaton.make_automaton()
    return automaton


_built: dict[int, tuple[Broadcast, ahocorasick.Automaton]] = {}


def _automaton(items: Broadcast, window: int) -> ahocorasick.Automaton:
    """Built once per Python worker; only the newest is kept."""
    key = id(items.value)
    if key not in _built:
        _built.clear()
        _built[key] = items.value, automaton_of(items.value, window)
    return _built[key][1]


def scan(text: bytes | None, automaton: ahocorasick.Automaton) -> tuple[int, int, list[str], list[dict]]:
    """Words, words in hits, items, and the hits as spans of code points of the text as it was."""
    if not text:
        return 0, 0, [], []
    normal = text.translate(NORMAL)
    words = normal.split()
    joined = f" {b' '.join(words).decode('latin-1')} "
    matches = list(automaton.iter(joined)) if len(automaton) else []
    if not matches:
        return len(words), 0, [], []
    gaps = np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
    change = np.zeros(len(words) + 1, np.int64)
    items: set[str] = set()
    for last, (n, length, names) in matches:
        first = int(np.searchsorted(gaps, last - length + 1))
        change[first] += 1
        change[first + n] -= 1
        items.update(names)
    hit = np.cumsum(change[:-1]) > 0
    data = np.frombuffer(normal, np.uint8)
    inside = np.concatenate(([False], data != 32, [False]))
    starts, ends = np.flatnonzero(inside[1:-1] & ~inside[:-2]), np.flatnonzero(inside[1:-1] & ~inside[2:]) + 1
    edge = np.concatenate(([False], hit, [False]))
    first, last = np.flatnonzero(edge[1:-1] & ~edge[:-2]), np.flatnonzero(edge[1:-1] & ~edge[2:])
    place = np.concatenate(([0], np.cumsum(code_points(np.frombuffer(text, np.uint8)))))
    spans = [{"start": int(place[starts[a]]), "end": int(place[ends[b]])} for a, b in zip(first, last)]
    return len(words), int(hit.sum()), sorted(items), spans


def _blocks(benchmark: DataFrame, block_bytes: int) -> list[list[tuple[str, bytes]]]:
    """The items in blocks of a checked size; one is collected at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text"))
    # Copies would all fall into one block.
    items = materialise(items.where(F.col("text").isNotNull()).distinct(), "items")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // block_bytes) or 1
    part = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [items.where(part == i) for i in range(n)]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` with n_words, n_hit, items (ids as sorted strings) and spans (hit passages in code points).

    Words are compared after lower-casing A-Z and dropping punctuation. A document word
    is hit if it lies in an occurrence of ``window`` consecutive words of an item, or of a
    whole item that is shorter. Null and empty texts have no words; items without words
    match nothing; an item without id counts with the empty id; repeated items count once.
    Columns of ``docs`` that have one of the new names are replaced.

    The benchmark is read in blocks of ``block_bytes``. Usually it is one; with more, each
    further one is a scan that adds to what the earlier ones found.
    """
    out = docs
    for n, block in enumerate(_blocks(benchmark, block_bytes)):
        items = docs.sparkSession.sparkContext.broadcast([(r.item, bytes(r.text)) for r in block.collect()])

        if n == 0:

            def first(texts, items=items):
                automaton = _automaton(items, window)
                return [list(x) for x in zip(*(scan(t, automaton) for t in raw(texts)))] or [[], [], [], []]

            out = map_columns(out, ["text"], FIELDS, first)
        else:

            def more(texts, had_items, had_spans, items=items):
                automaton = _automaton(items, window)
                rows = [merged(t, scan(t, automaton), a, b) for t, a, b in zip(raw(texts), had_items.to_pylist(), had_spans.to_pylist())]
                return [list(x) for x in zip(*rows)] or [[], [], [], []]

            out = map_columns(out, ["text", "items", "spans"], FIELDS, more)
    return out


def merged(text: bytes | None, new: tuple, items: list[str], spans: list[dict]) -> tuple:
    """What a block found, joined with what earlier blocks found in the same text."""
    n_words, n_hit, new_items, new_spans = new
    every = sorted((s["start"], s["end"]) for s in [*spans, *new_spans])
    if not spans or not new_spans:
        hit = n_hit or sum(len(_words(text, a, b)) for a, b in every)
        return n_words, hit, sorted({*items, *new_items}), spans or new_spans
    joined: list[list[int]] = []
    for a, b in every:
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    hit = sum(len(_words(text, a, b)) for a, b in joined)
    return n_words, hit, sorted({*items, *new_items}), [{"start": a, "end": b} for a, b in joined]


def _words(text: bytes, start: int, end: int) -> list[bytes]:
    return text.decode("utf-8")[start:end].encode().translate(NORMAL).split()
