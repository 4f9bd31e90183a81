import random
import re
import time

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.compare import differences
from tillwatch.llm import chat

WILD = ["", "\\", "\\\\", "<|", "<|end|>", "<|turn|>a<|text|>b<|end|>", "</s>[INST] ok [/INST]", "\\<|end|>", "<\\|end|>", "$1 \\$2", "a\nb", "<<SYS>>x<</SYS>>", "é🎉", "<", "[INST", "<s"]


def test_escapes_are_reversible(spark):
    draw = random.Random(3)
    texts = WILD + ["".join(draw.choice(["<", "|", "\\", "[INST]", "</s>", "end", ">", "a", "é"]) for _ in range(12)) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t
        assert not any(m in r.e for m in chat.FOREIGN)


def fold(events):
    """One event after the other."""
    state = {}
    rank = {"regenerate": 0, "edit": 1, "delta": 2}
    for _, kind, message, role, text in sorted(events, key=lambda e: (e[0], rank[e[1]], e[2], e[3] or "", e[4] or "")):
        if kind == "regenerate":
            state = {m: v for m, v in state.items() if m < message}
            continue
        old_role, old_text = state.get(message, (None, ""))
        text = text or ""
        state[message] = (role if role is not None else old_role, text if kind == "edit" else old_text + text)
    return {m: (r or "", t) for m, (r, t) in state.items()}


def test_fold_against_a_replay(spark):
    draw = random.Random(1)
    logs = {}
    for conv in [None, *range(40)]:
        logs[conv] = [
            (seq, draw.choices(["delta", "edit", "regenerate"], [8, 1, 1])[0], draw.randrange(4), draw.choice(["user", "assistant", None]), draw.choice(WILD + [None, "word "]))
            for seq in draw.sample(range(200), draw.randint(1, 25))
        ]
    rows = [(c, *e) for c, log in logs.items() for e in log]
    draw.shuffle(rows)
    events = spark.createDataFrame(rows, "conv_id long, seq long, kind string, message long, role string, text string").repartition(5)
    got = {}
    for r in chat.fold_events(events).collect():
        got.setdefault(r.conv_id, {})[r.message] = (r.role, r.text)
    want = {c: m for c, log in logs.items() if (m := fold(log))}
    assert got == want


def test_render_reads_back(spark):
    rows = [(1, i, r, t) for i, (r, t) in enumerate([("system", "be <|end|>"), ("user", None), ("assistant", "a🎉\\"), (None, "x"), ("assistant", "</s>[INST] ok [/INST]")])]
    rows += [(2, 0, "assistant", ""), (2, 0, "assistant", "twin"), (2, 0, "assistant", "twin"), (None, 5, "us<|er", "q")]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string").withColumn("turn", F.lit(9))
    got = chat.read_back(chat.render(messages))
    by = {r.conv_id: r for r in got.collect()}
    assert [(t.role, t.text) for t in by[1].turns] == [(r or "", t or "") for _, _, r, t in rows[:5]]
    assert by[1].loss == "a🎉\\</s>[INST] ok [/INST]"
    assert by[2].loss == "twintwin" and len(by[2].turns) == 3
    assert by[None].turns[0].role == "us<|er"
    spans = [by[1].formatted[s.start : s.start + s.length] for s in by[1].loss_spans]
    assert spans == ["a🎉\\\\", "<\\/s>[\\INST] ok [\\/INST]"]


def test_empty_and_native(spark):
    events = spark.createDataFrame([], "conv_id long, seq long, kind string, message long, role string, text string")
    out = chat.render(chat.fold_events(events))
    assert out.count() == 0
    assert not re.search("Python|Arrow|Pandas|CartesianProduct|NestedLoop", out._jdf.queryExecution().toString())


def test_query_counts_every_row_as_a_turn(spark, tmp_path):
    rows = [(1, 0, "user", "q"), (1, 0, "assistant", "a"), (1, 1, "user", "again"), (1, 1, "user", "again")]
    rows += [(2, None, "assistant", "last"), (2, None, None, "z"), (2, None, "user", None), (2, 5, "user", "b"), (2, 5, "user", "a")]
    rows += [(None, 0, "assistant", "x"), (None, 0, "user", "y"), (None, None, "assistant", "x")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = entry.queries()["op2_chat_format"](spark, str(tmp_path))
    assert differences(found, con, entry.oracle_sql()["op2_chat_format"]) == []
    assert {r.conv_id: (r.n_turns, r.loss_chars) for r in found.collect() if r.conv_id != -1} == {1: (4, 1), 2: (5, 4), None: (3, 2)}


def test_recorded_log_folds_back(spark):
    draw = random.Random(5)
    texts = WILD + [None, "x" * 999] + ["".join(draw.choice("ab\\<|é🎉 ") for _ in range(draw.randrange(30))) for _ in range(200)]
    rows = [(c, n, draw.choice(["user", "assistant", None]), draw.choice(texts)) for c in [None, 1, 2] for n in range(1, 150)]
    messages = spark.createDataFrame(rows, "conv_id long, message long, role string, text string")
    log = chat.recorded_log(messages).repartition(7)
    kinds = {r.kind: r.n for r in log.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    assert kinds["regenerate"] > 90 and kinds["edit"] > 90
    got = {(r.conv_id, r.message): (r.role, r.text) for r in chat.fold_events(log).collect()}
    assert got == {(c, n): (r or "", t or "") for c, n, r, t in rows}


def test_query_folds_its_log_without_python(spark, tmp_path):
    spark.createDataFrame([(1, 0, "user", "q")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    plan = entry.queries()["op2_chat_format"](spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert "regenerate" in plan and "edit" in plan and "collect_list" in plan
    assert not re.search("Python|Arrow|Pandas|Cartesian", plan)


def test_spans_of_a_long_conversation(spark):
    """Every span is where it says, and reading twice the turns takes about twice the time."""
    took = []
    for n in (8000, 16000):
        roles = F.when(F.col("id") % 2 == 0, "user").otherwise("assistant")
        messages = spark.range(n).select(F.lit(1).alias("conv_id"), (F.col("id") + 1).alias("message"), roles.alias("role"), F.concat(F.lit("w<| "), F.repeat(F.lit("word "), 40), "id").alias("text"))
        start = time.time()
        r = chat.read_back(chat.render(chat.fold_events(chat.recorded_log(messages)))).first()
        took.append(time.time() - start)
        assert len(r.turns) == n and len(r.loss_spans) == n // 2
        assert "".join(r.formatted[s.start : s.start + s.length] for s in r.loss_spans).replace("\\", "") == r.loss
    assert took[1] < 20
