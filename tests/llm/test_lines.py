import random
import re

import pytest

from tillwatch.llm.lines import dedup_lines


def within_one(a, b):
    if a == b:
        return True
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows, min_chars, edits):
    """rows: (doc_id, text); ids are distinct or rows equal."""
    near = within_one if edits else (lambda a, b: a == b)
    every = [(i, n, line) for i, t in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)) if t is not None for n, line in enumerate(t.split("\n"))]
    out = {}
    for i, t in set(rows):
        if t is None:
            out[i, t] = (None, 0, 0)
            continue
        kept = []
        for n, line in enumerate(t.split("\n")):
            key = (i is not None, i or 0, n)
            earlier = [x for j, m, x in every if (j is not None, j or 0, m) < key and len(x) >= min_chars]
            if len(line) < min_chars or not any(near(line, x) for x in earlier):
                kept.append(line)
        out[i, t] = ("\n".join(kept), len(t.split("\n")), len(t.split("\n")) - len(kept))
    return out


def corpus():
    draw = random.Random(5)
    pool = ["".join(draw.choice("ab é🎉") for _ in range(draw.randint(8, 14))) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(draw.randint(1, 6)):
            line = list(draw.choice(pool))
            for _ in range(draw.randint(0, 2)):
                at = draw.randrange(len(line))
                change = draw.choice("dis")
                line[at : at + (change != "i")] = [] if change == "d" else [draw.choice("abcé")]
            lines.append("".join(line))
        rows.append((i, "\n".join(lines)))
    return rows + [(100, None), (101, ""), (102, "\n\n"), (None, "a line without id here"), (103, "a line without id her"), (104, rows[3][1]), (3, rows[3][1]), (105, "x" * 3000), (106, "x" * 2999 + "y")]


@pytest.mark.parametrize("edits", [0, 1])
def test_against_all_pairs(spark, edits):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, n_lines int, line string")
    got = dedup_lines(docs, edits, 10).collect()
    want = expected(rows, 10, edits)
    assert len(got) == len(rows)
    for r in got:
        text = dict((x[0], x[1]) for x in rows)[r.doc_id]
        assert (r.text, r.n_lines, r.n_removed) == want[r.doc_id, text], r.doc_id
        assert r.line == "z"
    assert any(r.n_removed for r in got)


def test_hot_line_and_empty_table(spark):
    docs = spark.range(300).selectExpr("id AS doc_id", "concat('the very same line', if(id % 2 = 0, '!', ''), '\\nown line number ', id * 1000) AS text")
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got[0] == "the very same line!\nown line number 0"
    assert all("same" not in t for i, t in got.items() if i)
    empty = dedup_lines(spark.createDataFrame([], "doc_id long, text string"))
    assert empty.count() == 0 and empty.columns == ["doc_id", "text", "n_lines", "n_removed"]


def test_no_python_and_no_pairs_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "one line of text")], "doc_id long, text string")
    plan = dedup_lines(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", plan)
    with pytest.raises(ValueError):
        dedup_lines(docs, 2)


def test_shorter_lines_are_no_partners(spark):
    docs = spark.createDataFrame([(1, "abcdefghi\nabcdefghi"), (2, "abcdefghij\nabcdefghijk")], "doc_id long, text string")
    assert {r.doc_id: r.text for r in dedup_lines(docs).collect()} == {1: "abcdefghi\nabcdefghi", 2: "abcdefghij"}
