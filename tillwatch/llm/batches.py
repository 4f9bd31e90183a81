"""Arrow batches of texts as flat byte arrays, and words, hashes and n-grams over them in numpy.

A word is ``[^\\x20\\x09-\\x0D]+``: only ASCII white space separates, so words can be
found in UTF-8 bytes without decoding them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tillwatch.session import prepare

#: An Arrow batch of texts is cut at so many bytes (a longer single text is a batch of its own).
BATCH_BYTES = 1 << 20

IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def arrow_session(spark: SparkSession) -> SparkSession:
    """Batches bounded in bytes: with rows alone as the bound, long texts would fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return prepare(spark)


def map_columns(df: DataFrame, inputs: list[str], fields: list[T.StructField], make: Callable) -> DataFrame:
    """``df`` with the columns ``fields``, which ``make(*arrays of inputs)`` yields for every batch.

    Columns of ``df`` that have a name of ``fields`` are replaced, all others stay as they are.
    """
    arrow_session(df.sparkSession)
    made = {f.name.lower() for f in fields}
    kept = [f for f in df.schema.fields if f.name.lower() not in made]
    schema = T.StructType(kept + fields)
    names = [f.name for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            arrays = make(*(batch.column(c) for c in inputs))
            arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=arrow.field(len(names) + i).type) for i, a in enumerate(arrays)]
            old = [batch.column(c).cast(arrow.field(i).type) for i, c in enumerate(names)]
            yield pa.RecordBatch.from_arrays(old + arrays, schema=arrow)

    return df.mapInArrow(run, schema)


def rows_of(**fields: T.DataType) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(k, v) for k, v in fields.items()]))


def raw(column: pa.Array) -> list[bytes | None]:
    """Texts as UTF-8 bytes."""
    return column.cast(pa.binary()).to_pylist()


class Words(NamedTuple):
    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # where each text begins, and the end
    start: np.ndarray  # of each word, in data
    end: np.ndarray
    doc: np.ndarray  # the text each word is of
    first: np.ndarray  # index of the first word of each text, and the number of words


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts; null is an empty text."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)
    return data, offsets - offsets[0]


def find_words(data: np.ndarray, offsets: np.ndarray) -> Words:
    inside = ~IS_SPACE[data]
    n = len(data)
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = False
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = offsets[1:]
    after[ends[ends > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(data, offsets, start, end, doc, first)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64 bits, so that sums and low bits of hashes are as good as high ones."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: An odd base and its inverse modulo 2**64: hashes of spans come from differences of running sums.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse; one size is kept, enough for the usual batch."""
    if not _powers or _powers[0][0].size < n:
        size = max(n, BATCH_BYTES + 1)
        up, down = np.full(size, BASE, np.uint64), np.full(size, UNBASE, np.uint64)
        up[0] = down[0] = 1
        tables = np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)
        if size > 4 * BATCH_BYTES:
            return tables
        _powers[0] = tables
    return _powers[0]


def running(values: np.ndarray) -> np.ndarray:
    up, _ = powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:], dtype=np.uint64)
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of values[start:end] by running(values); of the values and their order, not of their place."""
    _, down = powers(len(sums))
    length = (end - start).astype(np.uint64)
    return mix((sums[end] - sums[start]) * down[start] + length * np.uint64(0xD6E8FEB86659FD93))


def word_hashes(words: Words) -> np.ndarray:
    return span_hash(running(BYTE_VALUE[words.data]), words.start, words.end)


def whole_grams(words: Words, k: int) -> np.ndarray:
    """Indices of the words at which k words of one text begin."""
    n = len(words.doc)
    if n < k:
        return np.empty(0, np.int64)
    return np.flatnonzero(words.doc[: n - k + 1] == words.doc[k - 1 :])


def code_points(data: np.ndarray) -> np.ndarray:
    """True at the first byte of every code point."""
    return (data & 0xC0) != 0x80
