import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm.test_decontaminate import expected as leaks
from tests.llm.test_lines import within_one
from tests.llm.test_simhash import brute_components, plain_print
from tillwatch.llm import pieces
from tillwatch.llm.queries import VOCABULARY
from tillwatch.llm.sentencepiece import vocabulary_of

SF = "/root/testdata/sf0.001"


def brute_lines(rows):
    """rows sorted by id. Only lines with an equal half can be within one edit."""
    first, halves, kept = {}, {}, []
    for place, (i, text) in enumerate(rows):
        left = []
        for n, line in enumerate(text.split("\n")):
            keys = {(m, s, part) for m in (len(line), len(line) - 1) for s, part in ((0, line[: m // 2]), (1, line[len(line) - (m - m // 2) :]))}
            early = {x for k in keys for x in halves.get(k, ())}
            if len(line) < 10 or (line not in first and not any(within_one(line, x) for x in early)):
                left.append(line)
            if len(line) >= 10 and line not in first:
                first[line] = (place, n)
                for k in keys:
                    halves.setdefault(k, []).append(line)
        kept.append((i, "\n".join(left)))
    return kept


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    stages = [stage for _, stage in corpus_pipeline.STAGES]
    assert len(stages) == 5
    good = stages[0](spark, docs, SF).cache()
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    rows = sorted((r.doc_id, r.text) for r in good.collect())

    lines = stages[1](spark, good, SF).cache()
    rows = brute_lines(rows)
    got = {r.doc_id: r for r in lines.collect()}
    assert lines.columns == docs.columns and {i: r.text for i, r in got.items()} == dict(rows)
    assert all(r.n_chars == len(r.text) for r in got.values())

    apart = stages[2](spark, lines, SF).cache()
    label = brute_components([plain_print(t, 3) for _, t in rows], 2)
    rows = [r for place, (r, own) in enumerate(zip(rows, label)) if own == place]
    assert apart.columns == docs.columns and sorted((r.doc_id, r.text) for r in apart.collect()) == rows

    clean = stages[3](spark, apart, SF).cache()
    rows = [(i, t) for i, t in rows if not leaks(t, items, 10)[1]]
    assert clean.columns == docs.columns and sorted(r.doc_id for r in clean.collect()) == [i for i, _ in rows]

    last = {r.doc_id: r for r in stages[4](spark, clean, SF).collect()}
    vocabulary = vocabulary_of(VOCABULARY)
    assert set(last) == {i for i, _ in rows} and all(r.round_trip for r in last.values())
    for i, t in rows[:5]:
        assert last[i].n_tokens == len(pieces.segment((" " + t).encode(), vocabulary) if t else [])
    assert {(r.doc_id, r.tokens_sha256) for r in corpus_pipeline.run(spark, SF).collect()} == {(i, r.tokens_sha256) for i, r in last.items()}


@pytest.mark.parametrize("stage", range(5))
def test_stages_take_nulls_repeats_and_further_columns(spark, stage):
    text = " ".join(f"word{i}" for i in range(80))
    rows = [(1, text, None, None, None), (1, text, None, None, None), (None, text + " x", "en", "s", 5), (2, None, "en", "s", 0), (3, "", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit(1)).withColumn("key", F.lit("k"))
    out = corpus_pipeline.STAGES[stage][1](spark, docs, SF)
    assert stage == 4 or out.columns == docs.columns
    assert out.count() == {0: out.count(), 1: 5, 2: out.count(), 3: 5, 4: 5}[stage]
    assert corpus_pipeline.STAGES[stage][1](spark, docs.limit(0), SF).count() == 0
