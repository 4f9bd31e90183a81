import random
import re
from collections import Counter

from tillwatch.llm.repeats import remove_repeats, window_minima


def expected(texts, length):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + length]) for w in words for i in range(len(w) - length + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - length + 1) if seen[tuple(w[i : i + length])] > 1 for p in range(i, i + length)}
        out.append((len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return out


def corpus():
    draw = random.Random(2)
    texts = []
    passages = [[draw.choice("abcdefgh") * draw.randint(1, 3) for _ in range(draw.randint(4, 15))] for _ in range(6)]
    for _ in range(60):
        words = []
        for _ in range(draw.randint(0, 6)):
            words += draw.choice(passages) if draw.random() < 0.4 else [draw.choice("abcdefghijklmnop") + draw.choice("éßx") for _ in range(draw.randint(1, 9))]
        if words and draw.random() < 0.5:
            words[draw.randrange(len(words))] = "changed"
        texts.append(draw.choice([" ", "\n", " \t "]).join(words))
    return texts + [None, "", "   ", "a " * 40, "one", texts[7], texts[7], " ".join(passages[0]) + "\x0b" + " ".join(passages[0]), "lead  é " * 3]


def test_against_all_windows(spark):
    texts = corpus()
    for length, seed in ((7, 3), (5, 5), (12, 4)):
        want = expected(texts, length)
        docs = spark.createDataFrame([(i, t, "k", 7) for i, t in enumerate(texts)], "doc_id long, text string, kept string, anchor int").repartition(3)
        got = {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs, length, seed).collect()}
        assert [got[i] for i in range(len(texts))] == want
        assert any(w[1] for w in want) and any(w[0] > w[1] > 0 for w in want)


def test_null_and_equal_ids(spark):
    text = " ".join(f"w{i}" for i in range(50))
    docs = spark.createDataFrame([(None, text), (None, text), (1, "a b"), (1, "c d")], "doc_id long, text string")
    got = sorted((r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs).collect())
    assert got == [(2, 0, "a b"), (2, 0, "c d"), (50, 50, ""), (50, 50, "")]
    assert remove_repeats(docs.limit(0)).count() == 0


def test_window_minima():
    import numpy as np

    values = np.random.default_rng(0).integers(0, 5, 200).astype(np.uint64)
    for width in (1, 2, 3, 7, 24):
        got = window_minima(values, width)
        assert list(got) == [i + int(np.argmin(values[i : i + width])) for i in range(len(values) - width + 1)]
