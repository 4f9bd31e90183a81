"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, byte fallback, white-space marks."""

from __future__ import annotations

import re
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwatch.llm.batches import map_columns, raw
from tillwatch.llm.pieces import BYTE, Cache, Vocabulary, chunks, fill, read_model

#: Bytes of segmented chunks that a Python worker keeps from one batch to the next.
CACHED = 48 << 20

_ids = Cache()
_of: list = []


@lru_cache(maxsize=4)
def vocabulary_of(path: str) -> Vocabulary:
    """Read on the driver; tasks get it by broadcast (its size is that of the vocabulary)."""
    return read_model(path)


def encode_texts(texts: list[bytes | None], vocabulary: Vocabulary, cache: Cache, most: int = CACHED) -> list[bytes | None]:
    """Ids of each text as little-endian 32-bit integers."""
    pattern = re.compile(vocabulary.chunk)
    split = [chunks(t, vocabulary, pattern) if t else [] for t in texts]
    fill(cache, set().union(*split), vocabulary, False, most)
    return [None if t is None else b"".join(map(cache.__getitem__, own)) for t, own in zip(texts, split)]


def int_lists(parts: list[bytes | None]) -> pa.ListArray:
    sizes = np.array([len(p) // 4 if p else 0 for p in parts], np.int64)
    offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
    missing = pa.array([p is None for p in parts], pa.bool_())
    return pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(p for p in parts if p), "<i4")), mask=missing)


def encode(docs: DataFrame, path: str, text: str = "text", tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``tokens``, the ids of the segmentation of ``text`` with the highest sum of log scores.

    ``path`` names a model file with byte pieces whose normaliser changes nothing; see read_model for the
    scores. A space is put first if the model says so. The mark U+2581 in a text counts as a space.
    Of segmentations with equal sums the one with the longest last piece is taken, within each chunk.
    Null gives null, the empty text no tokens. An older column ``tokens`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def run(column: pa.Array) -> list[pa.Array]:
        vocabulary = shared.value
        if not _of or _of[0] is not vocabulary:
            _of[:] = [vocabulary]
            _ids.clear()
        return [int_lists(encode_texts(raw(column), vocabulary, _ids))]

    return map_columns(docs, [text], [T.StructField(tokens, T.ArrayType(T.IntegerType()))], run)


class PieceTexts(NamedTuple):
    """What ids decode to, one after the other. The last entry stands for ids out of range."""

    data: np.ndarray
    at: np.ndarray
    size: np.ndarray
    is_byte: np.ndarray


def piece_texts(vocabulary: Vocabulary) -> PieceTexts:
    texts = [*vocabulary.texts, " ⁇ ".encode()]
    size = np.array([len(t) for t in texts])
    return PieceTexts(np.frombuffer(b"".join(texts), np.uint8), np.cumsum(size) - size, size, np.append(vocabulary.kinds == BYTE, False))


def decode_lists(lists: pa.ListArray, pieces: PieceTexts, prefix: bool) -> pa.Array:
    """Texts of lists of ids: the bytes of all pieces gathered at once, then cut into rows.

    Bytes that are no UTF-8 are read as U+FFFD, ids out of range as the unknown piece, control pieces
    as nothing; null ids are left out.
    """
    ids, counts = lists.flatten(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if ids.null_count:
        row = np.repeat(np.arange(len(counts)), counts)
        counts = np.bincount(row[ids.is_valid().to_numpy(zero_copy_only=False)], minlength=len(counts))
        ids = ids.drop_null()
    ids = ids.to_numpy(zero_copy_only=False)
    known = len(pieces.size) - 1
    ids = np.where((ids >= 0) & (ids < known), ids, known)
    size = pieces.size[ids]
    ends = np.cumsum(size)
    data = pieces.data[np.arange(ends[-1] if len(ends) else 0) + np.repeat(pieces.at[ids] - (ends - size), size)]
    first = np.cumsum(counts) - counts
    offsets = np.concatenate(([0], ends))[np.append(first, len(ids))]
    if prefix and len(data):
        rows = np.flatnonzero(offsets[1:] > offsets[:-1])
        cut = rows[(data[offsets[rows]] == 0x20) & ~pieces.is_byte[ids[first[rows]]]]
        kept = np.ones(len(data), bool)
        kept[offsets[cut]] = False
        data = data[kept]
        gone = np.zeros(len(offsets), np.int64)
        gone[cut + 1] = 1
        offsets = offsets - np.cumsum(gone)
    missing = lists.is_null().to_numpy(zero_copy_only=False)
    valid = pa.py_buffer(np.packbits(~missing, bitorder="little")) if missing.any() else None
    out = pa.Array.from_buffers(pa.large_binary(), len(lists), [valid, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)])
    try:
        return out.cast(pa.string())
    except pa.ArrowInvalid:
        return pa.array([None if t is None else t.decode("utf-8", "replace") for t in out.to_pylist()], pa.string())


def decode(df: DataFrame, path: str, tokens: str = "tokens", text: str = "decoded") -> DataFrame:
    """``df`` with ``decoded``, the text of the ids in ``tokens``; null gives null, null ids are left out."""
    shared = df.sparkSession.sparkContext.broadcast(piece_texts(vocabulary_of(path)))
    prefix = vocabulary_of(path).prefix

    def run(column: pa.Array) -> list[pa.Array]:
        return [decode_lists(column, shared.value, prefix)]

    return map_columns(df, [tokens], [T.StructField(text, T.StringType())], run)
