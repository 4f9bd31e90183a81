import random
import re
import struct

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from tillwatch.llm import pieces
from tillwatch.llm.queries import VOCABULARY
from tillwatch.llm.sentencepiece import decode, decode_lists, encode, piece_texts, vocabulary_of
from tillwatch.llm.token_counts import count_tokens

TEXTS = [
    "", " ", "  two  spaces ", "Hello, world!", "line\nbreak\n\n end", "日本語のテキスト 🎉🎉", "\t\r\nab", "▁marked▁ text", "x" * 500, " " * 90 + "é" * 90,
    "naïve façade — “quotes”", "\x00\x01", "token = \"04dbebab91ab85687d33\"", "<s> </s> <0x41>", None,
]


def number(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def part(field, content):
    return number(field << 3 | 2) + number(len(content)) + content


@pytest.fixture(scope="module")
def library():
    """The installed library as a unigram model with the same pieces and scores."""
    vocabulary, out, i = vocabulary_of(VOCABULARY), b"", 0
    with open(VOCABULARY, "rb") as file:
        model = file.read()
    for field, value in pieces.fields(model):
        if field == pieces.PIECES:
            row = dict(pieces.fields(value))
            out += part(1, part(1, row[1]) + number(2 << 3 | 5) + struct.pack("<f", vocabulary.scores[i]) + number(3 << 3) + number(row.get(3, 1)))
            i += 1
        elif field == pieces.TRAINER:
            out += part(2, value.replace(number(3 << 3) + number(pieces.BPE), number(3 << 3) + number(pieces.UNIGRAM), 1))
        else:
            out += part(field, value)
    return sentencepiece.SentencePieceProcessor(model_proto=out)


def test_ids_are_those_of_the_library(spark, library):
    texts = [t for t in TEXTS if t is not None]
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(60).collect() for w in r.text.split() if re.fullmatch(r"\w+", w)})
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + words[:3000])], "i int, text string").repartition(4)
    vocabulary = vocabulary_of(VOCABULARY)
    for r in encode(df, VOCABULARY).collect():
        want = library.encode(r.text)
        if list(r.tokens) != want:  # another segmentation with the same sum (the library adds 32-bit numbers)
            assert abs(sum(vocabulary.scores[r.tokens]) - sum(vocabulary.scores[want])) < 1e-4, r.text


def test_round_trip_and_counts(spark):
    docs = spark.createDataFrame([(i, t, "old", 3) for i, t in enumerate(TEXTS)], "doc_id long, text string, tokens string, n_tokens int")
    back = decode(encode(docs, VOCABULARY), VOCABULARY)
    counts = {r.doc_id: r.n_tokens for r in count_tokens(docs, VOCABULARY).collect()}
    for r in back.collect():
        text = TEXTS[r.doc_id]
        assert r.decoded == (None if text is None else text.replace("▁", " "))
        assert counts[r.doc_id] == (len(r.tokens) if r.tokens is not None else 0)
    assert encode(docs.limit(0), VOCABULARY).count() == 0 and count_tokens(docs.limit(0), VOCABULARY).count() == 0


def test_decoding_of_foreign_ids(spark):
    vocabulary = vocabulary_of(VOCABULARY)
    byte = vocabulary.byte_ids
    rows = [([1, 0, 2], " ⁇ "), ([int(byte[0xC3])], "�"), ([int(byte[0xC3]), int(byte[0xA9])], "é"), ([-1, 10**6], "⁇  ⁇ "), ([None], ""), ([], ""), (None, None)]
    df = spark.createDataFrame([(i, ids) for i, (ids, _) in enumerate(rows)], "i int, tokens array<int>")
    got = {r.i: r.decoded for r in decode(df, VOCABULARY).collect()}
    assert got[1] == "�" and got[2] == "é" and got[4] == got[5] == "" and got[6] is None and "⁇" in got[0] and "⁇" in got[3]


def plain_decode(ids, v):
    out = b"".join(v.texts[i] if 0 <= i < len(v.texts) else " ⁇ ".encode() for i in ids)
    first_is_byte = bool(ids) and 0 <= ids[0] < len(v.texts) and v.kinds[ids[0]] == pieces.BYTE
    return (out[1:] if v.prefix and out[:1] == b" " and not first_is_byte else out).decode("utf-8", "replace")


def test_flat_decoding_against_joined_pieces():
    v, draw = vocabulary_of(VOCABULARY), random.Random(3)
    special = [0, 1, 2, -1, 10**6, int(v.byte_ids[0x20]), int(v.byte_ids[0xC3]), int(v.byte_ids[0xA9])]
    table = piece_texts(v)
    for valid in (True, False):
        rows = [None if draw.random() < 0.1 else [draw.choice(special) if draw.random() < 0.4 and not valid else draw.randrange(3, 32000) for _ in range(draw.randint(0, 9))] for _ in range(600)]
        rows = [r and [None if draw.random() < 0.05 else i for i in r] for r in rows]
        lists = pa.array(rows, pa.list_(pa.int32()))
        want = [None if r is None else plain_decode([i for i in r if i is not None], v) for r in rows]
        assert decode_lists(lists, table, v.prefix).to_pylist() == want
        assert decode_lists(lists[200:300], table, v.prefix).to_pylist() == want[200:300]
    assert decode_lists(pa.array([], pa.list_(pa.int32())), table, True).to_pylist() == []
    assert decode_lists(pa.array([None, []], pa.list_(pa.int32())), table, True).to_pylist() == [None, ""]


def test_a_full_cache_starts_anew():
    v, cache = vocabulary_of(VOCABULARY), pieces.Cache()
    pieces.fill(cache, {b"one", b" two"}, v, False, 10**6)
    held = cache.held
    assert held > 300 and len(cache) == 2
    pieces.fill(cache, {b"one"}, v, False, 10**6)
    assert cache.held == held
    pieces.fill(cache, {b"three"}, v, False, held - 1)
    assert set(cache) == {b"three"} and cache.held < held


def test_trie_finds_all_pieces_and_nothing_else():
    keys = {b"a": 0, b"ab": 1, b"abc": 2, b"b": 3, "é".encode(): 4, b" a": 5, b"\xff": 6}
    base, check, value = pieces.double_array(keys)

    def look_up(key):
        state = 0
        for byte in key:
            to = base[state] + byte
            if not base[state] or check[to] != state:
                return -1
            state = to
        return value[state]

    assert {k: look_up(k) for k in keys} == keys
    assert all(look_up(k) == -1 for k in (b"c", b"abcd", b"\xc3", b"ba", b"", b" "))


def brute(word, v, known):
    best = {0: (0.0, ())}
    text = word.decode()
    bounds = [len(text[:i].encode()) for i in range(len(text) + 1)]
    for j, end in enumerate(bounds[1:], 1):
        options = []
        for i, at in enumerate(bounds[:j]):
            if word[at:end] in known:
                options.append((best[at][0] + v.scores[known[word[at:end]]], best[at][1] + (known[word[at:end]],)))
            elif i == j - 1:
                options.append((best[at][0] + v.unknown_score, best[at][1] + tuple(int(v.byte_ids[b]) for b in word[at:end])))
        best[end] = max(options, key=lambda o: o[0])
    return best[len(word)]


def test_shared_prefixes_against_plain_viterbi():
    v = vocabulary_of(VOCABULARY)
    known = {t: i for i, t in enumerate(v.texts) if v.kinds[i] == pieces.NORMAL}
    draw = random.Random(8)
    words = sorted({" ".join("".join(draw.choices(["th", "er", "é", "▁", "🎉", "q", "ing", "漢", "\t"], k=draw.randint(1, 7))) for _ in range(1)).replace("▁", " ").encode() for _ in range(400)})
    lattice = pieces.forward(words, v)
    ids = pieces.backtrack(lattice)
    for word, got, n in zip(words, ids, pieces.terminal_counts(lattice)):
        got = np.frombuffer(got, "<i4").tolist()
        score, want = brute(word, v, known)
        mine = pieces.segment(word, v)
        assert got == mine and len(got) == n
        assert got == list(want) or abs(sum(v.scores[list(want)]) - sum(v.scores[got])) < 1e-9


def test_models_that_are_not_supported():
    with pytest.raises(ValueError):
        pieces.parse_model(part(1, part(1, b"a")))
