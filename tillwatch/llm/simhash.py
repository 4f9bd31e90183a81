"""SimHash near-dedup by Golay-code fuzzy hashing.

The binary Golay code [23,12,7] has a codeword within 3 bits of every 23-bit word. A word's keys are
all codewords within 4 bits of it, 1 or 6, and words that differ in up to two bits always share one
(checked over all error patterns in the tests). A 64-bit fingerprint is cut in three segments. Of two
fingerprints within two bits, one segment is equal in both (pigeonhole), and the next one
shares a Golay key. So a fingerprint has, for each segment, keys of the segment as it is and each
Golay key of the next: 16 keys on average. Fingerprints with equal keys meet and their bits are compared.
"""

from __future__ import annotations

from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwatch.llm.batches import map_columns, raw, rows_of
from tillwatch.llm.components import components
from tillwatch.llm.keys import KEY, keyed
from tillwatch.session import materialise

SHINGLE = 3
MAX_BITS = 2
SEED = 42

# Bits of the code, and its generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
CODE_BITS, CHECK_BITS, GENERATOR = 23, 11, 0xC75
#: (lowest bit, number of bits) of the segments.
SEGMENTS = [(0, 22), (22, 21), (43, 21)]

#: Fingerprints that share a key are compared in one task up to this number; a larger bucket is
#: dealt out again by all pairs of bits outside the equal segment.
BUCKET = 1024


def syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders by the generator polynomial."""
    words = words.copy()
    for bit in range(CODE_BITS - 1, CHECK_BITS - 1, -1):
        words = np.where(words >> bit & 1, words ^ (GENERATOR << (bit - CHECK_BITS)), words)
    return words


def error_table() -> np.ndarray:
    """For each syndrome the patterns of up to 4 wrong bits that have it; -1 where there are fewer than 6."""
    table = np.full((1 << CHECK_BITS, 6), -1, np.int64)
    filled = np.zeros(1 << CHECK_BITS, np.int64)
    patterns = [sum(1 << b for b in bits) for weight in range(5) for bits in combinations(range(CODE_BITS), weight)]
    for pattern, syndrome in zip(patterns, syndromes(np.array(patterns))):
        table[syndrome, filled[syndrome]] = pattern
        filled[syndrome] += 1
    return table


def golay_keys(words: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Message bits of the codewords within 4 bits of each word, six columns; -1: none."""
    errors = table[syndromes(words)]
    return np.where(errors < 0, -1, (words[:, None] ^ errors) >> CHECK_BITS)


def bucket_keys(prints: np.ndarray, table: np.ndarray) -> np.ndarray:
    """All keys of fingerprints (uint64), eighteen columns; -1: none."""
    parts = [(prints >> np.uint64(low) & np.uint64((1 << size) - 1)).astype(np.int64) for low, size in SEGMENTS]
    keys = []
    for i, part in enumerate(parts):
        near = golay_keys(parts[(i + 1) % 3], table)
        keys.append(np.where(near < 0, -1, (i << 40) | (part[:, None] << 12) | near))
    return np.concatenate(keys, axis=1)


def fingerprint(text: bytes | None, shingle: int) -> int:
    """Bits set in over half the XXH64 of the shingles; 0 if there are no words."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - shingle + 1, 1)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    last = starts[min(shingle, len(words)) :]
    hashes = np.fromiter((xxhash.xxh64_intdigest(joined[a : b - 1], SEED) for a, b in zip(starts, last)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 16):  # 64 bytes a shingle
        ones += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``docs`` with fingerprint as a signed long; null and empty texts have 0."""

    def make(texts: pa.Array) -> list[pa.Array]:
        return [pa.array(np.array([fingerprint(t, shingle) for t in raw(texts)], np.uint64).view(np.int64))]

    return map_columns(docs, ["text"], [T.StructField("fingerprint", T.LongType())], make)


def _links_in(prints: np.ndarray, max_bits: int) -> list[dict]:
    """Links that join what is within max_bits in a bucket: each fingerprint to the smallest it reaches."""
    prints = np.unique(prints)
    near = np.bitwise_count((prints[:, None] ^ prints[None, :]).view(np.uint64)) <= max_bits
    label, n = np.arange(len(prints)), len(prints)
    while True:
        new = np.where(near, label, n).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [{"a": int(prints[x]), "b": int(p)} for x, p in zip(label, prints) if prints[x] != p]


def links(prints: DataFrame, max_bits: int = MAX_BITS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints within ``max_bits``, directly or over others."""
    if not 0 <= max_bits <= 2:
        raise ValueError("the keys find fingerprints that differ in 2 bits at most")
    table = error_table()

    def keys(column: pa.Array) -> list[pa.Array]:
        found = bucket_keys(column.to_numpy(zero_copy_only=False).view(np.uint64), table)
        real = found >= 0
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(real.sum(1)))).astype(np.int32)), pa.array(found[real]))]

    keyed = map_columns(prints, ["fingerprint"], [T.StructField("keys", T.ArrayType(T.LongType()))], keys)
    keyed = materialise(keyed.select("fingerprint", F.explode("keys").alias("key")), "keys")
    sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "buckets")

    def compare(column: pa.Array) -> list[list]:
        return [[_links_in(np.array(b, np.int64), max_bits) for b in column.to_pylist()]]

    met = keyed.join(sizes.where(F.col("n") <= bucket), "key").groupBy("key").agg(F.collect_list("fingerprint").alias("prints"))
    found = map_columns(met, ["prints"], [T.StructField("links", rows_of(a=T.LongType(), b=T.LongType()))], compare)
    found = found.select(F.inline("links"))

    # In a large bucket fingerprints are equal in one segment. Two that differ in two other bits are equal
    # without these, and at most four fingerprints are equal without two bits.
    large = keyed.join(sizes.where(F.col("n") > bucket), "key").select(F.shiftright("key", 40).alias("segment"), "fingerprint").distinct()
    for i, (low, size) in enumerate(SEGMENTS):
        free = [b for b in range(64) if not low <= b < low + size]
        masks = [-1 ^ (1 << x) ^ (1 << y) for x, y in combinations(free, 2)]
        masks = F.array(*[F.lit((m & (1 << 63) - 1) - (m & 1 << 63)) for m in masks])
        rest = large.where(F.col("segment") == i).select("fingerprint", F.posexplode(F.transform(masks, lambda m: F.col("fingerprint").bitwiseAND(m))).alias("pair", "rest"))
        alike = rest.groupBy("pair", "rest").agg(F.array_sort(F.collect_set("fingerprint")).alias("prints")).where(F.size("prints") > 1)
        near = alike.select(F.explode("prints").alias("b"), F.col("prints")[0].alias("a"), "prints").select("b", F.explode("prints").alias("a")).where("a < b")
        found = found.unionByName(near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits))
    return found.distinct()


def _owners(prints: DataFrame, least: str, max_bits: int) -> DataFrame:
    """(fingerprint, owner) with the smallest value of the column ``least`` over the component of the fingerprint."""
    distinct = materialise(prints.groupBy("fingerprint").agg(F.min(least).alias("least")), "distinct")
    roots = components(links(distinct.select("fingerprint"), max_bits))
    rooted = distinct.join(roots, distinct.fingerprint == roots.node, "left").select(
        "fingerprint", F.coalesce("root", "fingerprint").alias("root"), "least"
    )
    owners = rooted.groupBy("root").agg(F.min("least").alias("owner"))
    return rooted.select("fingerprint", "root").join(owners, "root").select("fingerprint", "owner")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: the smallest doc_id reachable over links.

    Texts are lower-cased in A-Z; shingles are ``shingle`` consecutive words joined by a space, repeats
    included, the whole text if it has fewer. Texts without words, null too, have fingerprint 0, which
    links like any other. Rows without id are linked too; component_id is null only if no row
    reached has an id. Repeated rows are rows of one component. Further columns are not used.
    """
    prints = materialise(fingerprints(docs.select("doc_id", "text"), shingle).select("doc_id", "fingerprint"), "prints")
    owners = _owners(prints, "doc_id", max_bits).withColumnRenamed("owner", "component_id")
    return prints.join(owners, "fingerprint").select("doc_id", "fingerprint", "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """The row of ``docs`` with the smallest doc_id of each component, all columns as they were.

    Of rows with equal id the one with the smallest hash of the text stays, of rows equal in both any one.
    Rows without id come first.
    """
    rows = keyed(docs.select("doc_id", "text"))
    prints = materialise(fingerprints(rows, shingle).select(F.struct(*KEY).alias("key"), "fingerprint"), "prints")
    kept = _owners(prints, "key", max_bits).select("owner.*").distinct()
    return keyed(docs).join(kept, KEY).dropDuplicates(KEY).select(*docs.columns)
