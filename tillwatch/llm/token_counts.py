"""Token counts: forward scores over a trie of distinct pre-tokens, once for each shared prefix.

A task gathers the distinct pre-tokens of a batch that it has not met, sorts them, which makes a trie
of them, and computes the best score and its number of tokens for every node level by level
(``pieces.forward``). The counts at the terminal nodes are kept for the pre-tokens to come, and a
document's count is the sum over its pre-tokens. Nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tillwatch.llm.batches import map_columns, raw
from tillwatch.llm.pieces import Cache, chunks, fill
from tillwatch.llm.sentencepiece import vocabulary_of

#: Bytes of counted pre-tokens that a Python worker keeps from one batch to the next.
CACHED = 96 << 20

_counts = Cache()
_of: list = []


def count_tokens(docs: DataFrame, path: str, cached: int = CACHED) -> DataFrame:
    """``docs`` with n_pretokens and n_tokens: what encoding the whole text with the model at ``path`` gives.

    Pre-tokens are runs that no piece of the vocabulary crosses: a word with the spaces before it, trailing spaces, a line
    end. Null and empty texts have none. Columns with the new names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary_of(path))

    def run(column: pa.Array) -> list:
        vocabulary = shared.value
        if not _of or _of[0] is not vocabulary:
            _of[:] = [vocabulary]
            _counts.clear()
        pattern = re.compile(vocabulary.chunk)
        split = [chunks(t, vocabulary, pattern) if t else [] for t in raw(column)]
        fill(_counts, set().union(*split), vocabulary, True, cached)
        return [[len(own) for own in split], [sum(map(_counts.__getitem__, own)) for own in split]]

    fields = [T.StructField("n_pretokens", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_columns(docs, ["text"], fields, run)
