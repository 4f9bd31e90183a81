"""SentencePiece vocabularies: reading the model file, a double-array trie of pieces, unigram Viterbi.

In the trie the white-space mark (U+2581) is a plain space, so texts are looked up as they are.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

# Field numbers and piece kinds of the model file, and the penalty of an unknown character.
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE_TEXT, PIECE_SCORE, PIECE_KIND = 1, 2, 3
MODEL_KIND, UNIGRAM, BPE = 3, 1, 2
ADD_PREFIX, REMOVE_SPACES, CHARSMAP = 3, 4, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
MARK = "▁".encode()

#: Longer chunks are segmented one by one instead of together.
LONG = 64
#: Distinct chunks segmented together.
TOGETHER = 25_000


def fields(message: bytes) -> Iterator[tuple[int, int | float | bytes]]:
    """Fields of a protocol buffer message: number and value."""
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        elif tag & 7 == 2:
            size = number()
            yield tag >> 3, message[at : at + size]
            at += size
        elif tag & 7 == 5:
            yield tag >> 3, struct.unpack("<f", message[at : at + 4])[0]
            at += 4
        else:
            yield tag >> 3, message[at : at + 8]
            at += 8


class Vocabulary(NamedTuple):
    texts: list[bytes]  # what each id decodes to
    kinds: np.ndarray
    scores: np.ndarray  # log scores
    unknown_score: float
    byte_ids: np.ndarray  # id of each byte
    prefix: bool
    base: np.ndarray
    check: np.ndarray
    value: np.ndarray
    chunk: bytes  # pattern of chunks between which no piece reaches


def double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of a trie: state s has the child base[s] + byte where check there is s."""
    size, block = 1 << 16, 1 << 11
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    used = np.zeros(size, bool)
    used[0] = True
    todo: list[tuple[int, int, list[bytes]]] = [(0, 0, sorted(keys))]
    free = 1  # all places before it are used
    while todo:
        state, depth, own = todo.pop()
        if len(own[0]) == depth:
            value[state] = keys[own[0]]
            own = own[1:]
        if not own:
            continue
        groups: dict[int, list[bytes]] = {}
        for key in own:
            groups.setdefault(key[depth], []).append(key)
        free += int(np.argmin(used[free:]))
        at = max(free - min(groups), 1)
        while True:
            if at + block + 512 > size:
                base, check = np.concatenate((base, np.zeros(size, np.int32))), np.concatenate((check, np.full(size, -1, np.int32)))
                value, used = np.concatenate((value, np.full(size, -1, np.int32))), np.concatenate((used, np.zeros(size, bool)))
                size *= 2
            taken = np.zeros(block, bool)
            for byte in groups:
                taken |= used[at + byte : at + byte + block]
            fits = int(np.argmin(taken))
            if not taken[fits]:
                at += fits
                break
            at += block
        places = at + np.fromiter(groups, np.int64)
        base[state] = at
        used[places] = True
        check[places] = state
        todo += [(at + byte, depth + 1, group) for byte, group in groups.items()]
    return base, check, value


def read_model(path: str) -> Vocabulary:
    """A vocabulary with byte pieces and no character map.

    Scores of a unigram model are its log scores. A merge model has ranks instead (scores 0, -1, -2
    and so on): by Zipf's law the log score of rank r is -ln(1 + r).
    """
    with open(path, "rb") as file:
        return parse_model(file.read())


def parse_model(message: bytes) -> Vocabulary:
    rows, kind, prefix = [], UNIGRAM, True
    for number, value in fields(message):
        if number == PIECES:
            rows.append(dict(fields(value)))
        elif number == TRAINER:
            kind = dict(fields(value)).get(MODEL_KIND, UNIGRAM)
        elif number == NORMALIZER:
            rule = dict(fields(value))
            prefix = bool(rule.get(ADD_PREFIX, 1))
            if rule.get(CHARSMAP) or rule.get(REMOVE_SPACES, 1):
                raise ValueError("only models that leave texts as they are can give them back")
    kinds = np.array([r.get(PIECE_KIND, NORMAL) for r in rows])
    if (kinds == BYTE).sum() != 256:
        raise ValueError("the vocabulary has to have a piece for each byte")
    if kind not in (UNIGRAM, BPE):
        raise ValueError("only unigram and merge models have scored pieces")
    scores = np.array([r.get(PIECE_SCORE, 0.0) for r in rows], np.float64)
    if kind == BPE:
        scores = -np.log1p(np.maximum(-scores, 0))
    texts, byte_ids, keys = [], np.zeros(256, np.int32), {}
    for i, r in enumerate(rows):
        piece = r[PIECE_TEXT]
        if kinds[i] == BYTE:
            byte = int(piece[3:5], 16)
            byte_ids[byte] = i
            texts.append(bytes([byte]))
        elif kinds[i] in (NORMAL, USER_DEFINED):
            piece = piece.replace(MARK, b" ")
            keys[piece] = i
            texts.append(piece)
        else:
            texts.append(" ⁇ ".encode() if kinds[i] == UNKNOWN else b"")
    # Texts fall into chunks that no piece crosses: before spaces that follow something else, and at line ends.
    inner_space = any(b" " in k.lstrip(b" ") for k in keys)
    line_end = any(b"\n" in k for k in keys)
    chunk = rb"(?s).+" if inner_space else rb" *[^ ]+| +" if line_end else rb" *[^ \n]+| +|\n"
    lowest = scores[kinds == NORMAL].min()
    return Vocabulary(texts, kinds, scores, lowest - UNKNOWN_PENALTY, byte_ids, prefix, *double_array(keys), chunk)


def chunks(text: bytes, vocabulary: Vocabulary, pattern: re.Pattern) -> list[bytes]:
    """Chunks of a text, which are segmented one by one: the best segmentation has a boundary between them."""
    if not text:
        return []
    text = text.replace(MARK, b" ")
    return pattern.findall(b" " + text if vocabulary.prefix else text)


#: Bytes that follow the first byte of a character.
FOLLOW = np.array([0 if b < 0xC0 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3 for b in range(256)])


class Lattice(NamedTuple):
    """Best segmentations of words over the trie of their prefixes. Nodes of level d are prefixes of d bytes."""

    lengths: np.ndarray
    node: np.ndarray  # levels x words: node of the word's prefix, counted over all levels
    tokens: np.ndarray  # of each node: number of tokens of the best segmentation
    start: np.ndarray  # of each node: where its last token begins
    piece: np.ndarray  # of each node: its last token


def forward(words: list[bytes], vocabulary: Vocabulary) -> Lattice:
    """Best scores of all prefixes of sorted distinct words, computed once where words share a prefix.

    Level by level, each node keeps the states of the piece trie that its last bytes have reached,
    with the score of the node where they began. Of equal scores the longest last piece wins.
    A character without a piece of its own costs the unknown score and is written as its bytes.
    """
    v = vocabulary
    lengths = np.array([len(w) for w in words])
    data = np.frombuffer(b"".join(words), np.uint8)
    begin = np.cumsum(lengths) - lengths
    top = int(lengths.max())
    node = np.zeros((top + 1, len(words)), np.int32)
    best, count = np.zeros(1), np.zeros(1, np.int32)
    char_best, char_count, char_at = best, count, np.zeros(1, np.int32)
    rest = np.zeros(1, np.int64)
    e_node = e_start = e_count = np.zeros(0, np.int32)
    e_state, e_score = np.zeros(0, np.int32), np.zeros(0)
    offset, here = 0, np.zeros(len(words), np.int32)
    tokens, starts, pieces = [count], [np.zeros(1, np.int32)], [np.zeros(1, np.int32)]
    for d in range(top):
        alive = np.flatnonzero(lengths > d)
        byte, parent = data[begin[alive] + d], here[alive]
        change = np.concatenate(([True], (parent[1:] != parent[:-1]) | (byte[1:] != byte[:-1])))
        offset += len(best)
        here[alive] = np.cumsum(change) - 1
        node[d + 1, alive] = here[alive] + offset
        parent, byte = parent[change], byte[change]
        # A piece may begin at every node that ends a character.
        new = np.flatnonzero(rest == 0).astype(np.int32)
        order = np.argsort(np.concatenate((e_node, new)), kind="stable")
        e_node = np.concatenate((e_node, new))[order]
        e_start = np.concatenate((e_start, np.full(len(new), d, np.int32)))[order]
        e_state = np.concatenate((e_state, np.zeros(len(new), np.int32)))[order]
        e_score = np.concatenate((e_score, best[new]))[order]
        e_count = np.concatenate((e_count, count[new]))[order]
        low, high = np.searchsorted(e_node, parent), np.searchsorted(e_node, parent, "right")
        size = high - low
        child = np.repeat(np.arange(len(parent), dtype=np.int32), size)
        at = np.arange(len(child)) + np.repeat(low - (np.cumsum(size) - size), size)
        state = e_state[at]
        reached = v.base[state] + byte[child]
        ok = (reached < len(v.check)) & (v.check[np.minimum(reached, len(v.check) - 1)] == state) & (v.base[state] > 0)
        at = at[ok]
        e_node, e_state, e_start, e_score, e_count = child[ok], reached[ok].astype(np.int32), e_start[at], e_score[at], e_count[at]

        first = rest[parent] == 0
        char_best, char_count = np.where(first, best[parent], char_best[parent]), np.where(first, count[parent], char_count[parent])
        char_at = np.where(first, d, char_at[parent]).astype(np.int32)
        rest = np.where(first, FOLLOW[byte], rest[parent] - 1)
        n = len(parent)
        best, count = np.full(n, -np.inf), np.zeros(n, np.int32)
        start, piece = np.full(n, d, np.int32), v.byte_ids[byte]
        whole = np.flatnonzero(v.value[e_state] >= 0)
        alone = np.zeros(n, bool)
        if len(whole):
            w_node, w_piece = e_node[whole], v.value[e_state[whole]]
            score = e_score[whole] + v.scores[w_piece]
            alone[w_node[e_start[whole] == char_at[w_node]]] = True
            group = np.flatnonzero(np.concatenate(([True], w_node[1:] != w_node[:-1])))
            most = np.maximum.reduceat(score, group)
            equal = np.flatnonzero(score == np.repeat(most, np.diff(np.concatenate((group, [len(score)])))))
            pick = equal[np.concatenate(([True], w_node[equal[1:]] != w_node[equal[:-1]]))]
            ends = w_node[pick]
            best[ends], start[ends], piece[ends] = score[pick], e_start[whole[pick]], w_piece[pick]
            count[ends] = e_count[whole[pick]] + 1
        unknown = np.flatnonzero((rest == 0) & ~alone)
        unknown = unknown[char_best[unknown] + v.unknown_score > best[unknown]]
        best[unknown], start[unknown], piece[unknown] = char_best[unknown] + v.unknown_score, d, v.byte_ids[byte[unknown]]
        count[unknown] = char_count[unknown] + d + 1 - char_at[unknown]
        tokens.append(count)
        starts.append(start)
        pieces.append(piece)
    return Lattice(lengths, node, np.concatenate(tokens), np.concatenate(starts), np.concatenate(pieces))


def terminal_counts(lattice: Lattice) -> np.ndarray:
    """Number of tokens of each word."""
    return lattice.tokens[lattice.node[lattice.lengths, np.arange(len(lattice.lengths))]]


def backtrack(lattice: Lattice) -> list[bytes]:
    """Ids of each word's best segmentation, as little-endian 32-bit integers."""
    at, words = lattice.lengths.copy(), np.arange(len(lattice.lengths))
    steps = []
    while (at > 0).any():
        node = lattice.node[at, words]
        steps.append(np.where(at > 0, lattice.piece[node], -1).astype("<i4"))
        at = np.where(at > 0, lattice.start[node], 0)
    ids = np.stack(steps[::-1], axis=1)
    found = ids >= 0
    flat = ids[found].tobytes()
    ends = (4 * np.cumsum(found.sum(1))).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def segment(word: bytes, vocabulary: Vocabulary) -> list[int]:
    """Ids of one word by the same rules, for words of any length."""
    v, n = vocabulary, len(word)
    base, check, value, scores = v.base, v.check, v.value, v.scores
    best, back, piece = [-np.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0], at = 0.0, 0
    while at < n:
        size = int(FOLLOW[word[at]]) + 1
        state, alone = 0, False
        for end in range(at, n):
            b = int(base[state])
            to = b + word[end]
            if not b or to >= len(check) or check[to] != state:
                break
            state = to
            found = int(value[state])
            if found >= 0:
                score = best[at] + float(scores[found])
                if score > best[end + 1]:
                    best[end + 1], back[end + 1], piece[end + 1] = score, at, found
                alone = alone or end + 1 == at + size
        if not alone and best[at] + v.unknown_score > best[at + size]:
            best[at + size], back[at + size], piece[at + size] = best[at] + v.unknown_score, at, -1
        at += size
    ids: list[int] = []
    while n:
        ids += [piece[n]] if piece[n] >= 0 else [int(v.byte_ids[b]) for b in reversed(word[back[n] : n])]
        n = back[n]
    return ids[::-1]


class Cache(dict):
    """What segmented words gave, and about how many bytes that holds."""

    held = 0
    #: Two objects and their places in the table.
    ENTRY = 180

    def add(self, word: bytes, found: bytes | int) -> None:
        self[word] = found
        self.held += self.ENTRY + len(word) + (len(found) if isinstance(found, bytes) else 0)

    def clear(self) -> None:
        super().clear()
        self.held = 0


def fill(cache: Cache, words: set[bytes], vocabulary: Vocabulary, counts: bool, most: int) -> None:
    """Add what the cache lacks of words: their number of tokens, or their ids. Beyond ``most`` bytes the cache starts anew."""
    if cache.held > most:
        cache.clear()
    missing = words.difference(cache)
    short = sorted(w for w in missing if len(w) <= LONG)
    for i in range(0, len(short), TOGETHER):
        part = short[i : i + TOGETHER]
        lattice = forward(part, vocabulary)
        for word, found in zip(part, terminal_counts(lattice).tolist() if counts else backtrack(lattice)):
            cache.add(word, found)
    for word in missing:
        if len(word) > LONG:
            ids = segment(word, vocabulary)
            cache.add(word, len(ids) if counts else np.array(ids, "<i4").tobytes())
