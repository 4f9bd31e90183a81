import random
import re

from tillwatch.llm.decontaminate import _blocks, find_leaks

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words_of(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def expected(text, items, window):
    words, hit, found = words_of(text), set(), set()
    for item, t in items:
        w = words_of(t)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if n else 0):
            for p in range(len(words) - n + 1):
                if words[p : p + n] == w[i : i + n]:
                    hit.update(range(p, p + n))
                    found.add("" if item is None else str(item))
    return len(words), len(hit), sorted(found)


def test_against_brute_force_in_one_block_and_in_many(spark):
    draw = random.Random(6)
    vocabulary = ["a", "b", "c", "ÀB", "été", "9", "x9"]
    items = [(i, draw.choice([" ", ", ", "\n"]).join(draw.choices(vocabulary, k=draw.randint(1, 9)))) for i in range(12)]
    items += [(12, None), (13, ""), (14, "..."), (None, "c c c c"), (3, items[3][1]), (3, "B b B b B"), (20, items[5][1])]
    texts = [draw.choice([" ", "-", "; "]).join(w.upper() if draw.random() < 0.3 else w for w in draw.choices(vocabulary, k=draw.randint(0, 40))) for _ in range(50)]
    texts += [None, "", "!!", "C.c.c.C", items[0][1], texts[0]]
    docs = spark.createDataFrame([(i, t, "mine", 5) for i, t in enumerate(texts)], "doc_id long, text string, items string, other int")
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    for block in (10**6, 60):
        got = {r.doc_id: r for r in find_leaks(docs, benchmark, 4, block).collect()}
        for i, t in enumerate(texts):
            want = expected(t, items, 4)
            assert (got[i].n_words, got[i].n_hit, got[i]["items"]) == want, (block, i, t)
            assert sum(len(words_of(t[s.start : s.end])) for s in got[i].spans) == want[1]
            assert got[i].other == 5


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert find_leaks(docs, nothing).first()[2:] == (2, 0, [], [])
    assert find_leaks(docs.limit(0), nothing).count() == 0


def test_copies_of_an_item_do_not_fill_a_block(spark):
    rows = [(1, "the same ten words"), (None, "q")] * 300 + [(i, f"item number {i}") for i in range(2, 12)]
    benchmark = spark.createDataFrame(rows, "item_id long, text string")
    blocks = [b.collect() for b in _blocks(benchmark, 60)]
    assert sorted((r.item, bytes(r.text).decode()) for b in blocks for r in b) == sorted({("" if i is None else str(i), t) for i, t in rows})
    assert len(blocks) == 3 and max(sum(len(r.text) for r in b) for b in blocks) <= 120
