import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillwatch.llm import language, quality, secrets
from tillwatch.llm.linear import platt

SF = "/root/testdata/sf0.01"


def counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    covered = {p for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for p in (i, i + 1, i + 2)}
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)]


def test_quality_counts(spark):
    texts = [None, "", "\n\n", "a b c a b c", "a\nb\na\n a\nb", "x | y <z> #é# 　é\x85", "é " * 70, "one\x0btwo\x0cthree\ttwo", " ".join(f"w{i}" for i in range(60)), "q\n" * 3 + "q", "\nq\n\nq"]
    docs = spark.createDataFrame([(i, t, True) for i, t in enumerate(texts)], "doc_id long, text string, kept boolean")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for r in quality.judge_quality(docs, labels).collect():
        want = counts(texts[r.doc_id])
        assert [r[c] for c in quality.COUNTS] == want, r.doc_id
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert r.kept == (not r.base_failed)  # nothing learned: all are good
    assert quality.judge_quality(docs.limit(0), labels).count() == 0


def test_quality_on_documents_not_learned_from(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").join(docs.select("doc_id"), "doc_id")
    odd = F.xxhash64("doc_id") % 2 != 0
    judged = quality.judge_quality(docs, labels.where(odd)).join(labels.where(~odd), "doc_id").where("NOT base_failed")
    rows = judged.select("kept", "quality", "probability").collect()
    assert len(rows) > 100
    assert sum(r.kept == bool(r.quality) for r in rows) / len(rows) > 0.95
    clean = [r for r in rows if r.quality == 1]
    assert sum(r.kept for r in clean) / len(clean) > 0.97


def test_quality_labels_with_nulls_and_conflicts(spark):
    docs = spark.createDataFrame([(i, ("good words here " if i % 2 else "# | # | ") * 40 + str(i), 1) for i in range(40)], "doc_id long, text string, quality int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(None, 1), (1, None), (0, 0), (99, 1), (3, 7)], "doc_id long, quality int")
    model = quality.fit(docs, labels, 12)
    assert {r.doc_id % 2: r.probability > 0.5 for r in quality.score(docs, model).collect()} == {0: False, 1: True}
    one_class = quality.fit(docs, labels.where("quality = 0"))
    assert not any(r.kept for r in quality.score(docs, one_class).collect())


def test_platt_gives_shares():
    draw = np.random.default_rng(0)
    scores = draw.normal(size=4000)
    y = (draw.random(4000) < 1 / (1 + np.exp(-(3 * scores - 1)))).astype(int)
    a, b = platt(scores, y, np.ones(4000))
    assert abs(a - 3) < 0.4 and abs(b + 1) < 0.2


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = language.held_out(F.col("doc_id"))
    found = language.predict(docs, language.fit(docs.where(~held))).withColumn("held", held)
    rows = [r for r in found.collect() if r.held]
    assert len(rows) > 100 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark):
    texts = {"xx": "zork blim zork flum ", "yy": "ärü öpö äpä ürö ", "zz": "qqat wwet qqit wwot "}
    rows = [(i, t * (1 + i % 5), code, 0.5) for i, (code, t) in enumerate(list(texts.items()) * 20)]
    rows += [(100, None, "xx", 0.1), (101, "", "xx", 0.1), (102, "12 34 !", "yy", 0.1), (None, "zork blim zork", "zz", 0.1), (103, "qqat wwet qqit", None, 0.1), (104, "1 ä 2", None, 0.1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in language.predict(docs, language.fit(docs.where("doc_id < 100"))).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (100, 101, 102))
    assert got[103].lang_pred == "zz" and got[None].lang_pred == "xx" and got[104].lang_pred != "und"
    assert all(got[i].lang_pred == r[2] for i, r in enumerate(rows[:60]))
    alone = language.predict(docs, language.fit(docs.where("lang = 'yy'")))
    assert {r.lang_pred for r in alone.collect()} == {"yy", "und"}
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs.limit(0))).collect()} == {"und"}


def test_more_values_of_lang_than_are_learned(spark):
    rows = [(i, f"{'zork blim flum' if i % 2 else 'ärü öpö äpä'} {i}", "ab"[i % 2]) for i in range(300)] + [(1000 + i, f"some text {i}", f"dirty{i:04}") for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, most=5)
    assert model.languages[:2] == ["a", "b"] and set(model.languages[2:]) <= {"dirty0000", "dirty0001", "dirty0002"}
    got = language.predict(docs.where("doc_id < 1000"), model).collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert {r.lang_pred for r in language.predict(docs, language.fit(docs)).collect()} <= {r[2] for r in rows}


def test_language_model_does_not_depend_on_partitions_or_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    many = docs.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(6)))).drop("n")
    found = []
    for parts in (3, 7):
        found.append({r.doc_id: (r.lang_pred, round(r.score, 4)) for r in language.predict(docs, language.fit(many.repartition(parts), 300)).collect()})
    assert found[0] == found[1]


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 30])
def test_codewords_are_apart(n):
    code = language.codewords(n)
    apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
    assert min(apart) >= (2 ** (n - 2) if n <= 6 else 6)


def test_language_ties_are_flagged():
    model = language.Model(["a", "b", "c"], language.codewords(3), np.zeros((1, 3)), np.zeros(3), np.ones(3) / 3)
    best, score, unclear = language.decode(np.array([[0.0, 0.0, 0.0], 5.0 * model.code[2]]), model)
    assert unclear.tolist() == [True, False] and best[1] == 2 and score[1] > score[0]


def test_secrets(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b"
    rows = [(i, f'the token = "{key[i % 7:]}{i:04x}" in use and internationalizations{"ab" * (i % 3)} there {i} of 1234567890123456', "src/a.py") for i in range(60)]
    rows += [(100, None, None), (101, "", "x"), (102, key, "tests/x"), (103, f'secret: {key} {key}', None), (104, "no candidates at all", "y"), (None, f'token = "{key}"', "z"), (5, rows[5][1], "src/a.py")]
    docs = spark.createDataFrame([(*r, "mine") for r in rows], "doc_id long, text string, source string, token string")
    found = secrets.scan(docs, secrets.triage).collect()
    assert {r.doc_id for r in found} == {*range(60), 102, 103, None}
    assert all(r.is_secret == (r.digits > 0.1 and r.digits < 1) for r in found if r.doc_id is not None and r.doc_id < 60)
    twice = [r for r in found if r.doc_id == 103]
    assert [r.token for r in twice] == [key, key] and any(r.is_secret and "secret" in r.before for r in twice)
    assert sum(r.doc_id == 5 for r in found) == 6
    assert secrets.scan(docs.limit(0), secrets.triage).count() == 0
    plain = secrets.scan(docs, lambda f: f.withColumn("label", F.lit(None).cast("int")))
    assert not any(r.is_secret for r in plain.collect())


def test_secret_neighbours(spark):
    docs = spark.createDataFrame([(1, "before AAAAAAAAAAAAAAAAAAAA mid BBBBBBBBBBBBBBBBBBBB"), (2, "CCCCCCCCCCCCCCCCCCCC\nDDDDDDDDDDDDDDD")], "doc_id long, text string")
    got = sorted((r.token[0], r.before, r.after, r.path) for r in secrets.find_candidates(docs).collect())
    assert got == [("A", "before ", " mid ", ""), ("B", " mid ", "", ""), ("C", "", "\nDDDDDDDDDDDDDDD", "")]


def test_secrets_in_common_forms(spark):
    draw = random.Random(2)
    key = lambda n=40: "".join(draw.choices("0123456789abcdef", k=n))
    forms = ["export API_KEY={}", 'aws_secret_access_key = "{}"', "database_password: {}", "Authorization: Bearer {}", "api-key: {}", "db_password_main={}", 'accessToken: "{}"']
    kept = [(i, k := key(), f"some words here\n{forms[i % len(forms)].format(k)}\nand more") for i in range(70)]
    none = [(100 + i, "internationalization" + "abc" * (i % 5), "") for i in range(70)]
    docs = spark.createDataFrame([(i, t or f"on {k} and so on, revision {key()} of it") for i, k, t in kept + none], "doc_id long, text string")
    found = secrets.scan(docs, secrets.triage).collect()
    values = {r.doc_id: r for r in found if r.doc_id < 100 and r.token == kept[r.doc_id][1]}
    assert len(values) == 70
    assert all(r.credential_before == r.assigned == 1 and r.is_secret for r in values.values())
    assert not any(r.is_secret for r in found if r.doc_id >= 100)
    labelled = {(r.doc_id, r.token): r.label for r in secrets.triage(spark.createDataFrame(found)).collect()}
    assert all(labelled[i, k] == 1 for i, k, _ in kept)
    assert {v for (i, _), v in labelled.items() if i >= 100} == {0} and labelled[1, "aws_secret_access_key"] is None


def test_secret_runs_and_what_leads_to_them(spark):
    rows = [(1, "x=AAAAAAAAAAAAAAAAAAAA== y"), (2, 'NAME_OF_SIXTEEN_="BBBBBBBBBBBBBBBB="'), (3, "a=CCCCCCCCCCCCCC==&b=DDDDDDDDDDDDDDD="), (4, "E" * 60 + " at " + "F" * 16)]
    got = sorted((r.doc_id, r.token, r.lead) for r in secrets.find_candidates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [
        (1, "A" * 20 + "==", "x="),
        (2, "B" * 16 + "=", 'NAME_OF_SIXTEEN_="'),
        (2, "NAME_OF_SIXTEEN_", ""),
        (3, "C" * 14 + "==", "a="),
        (3, "D" * 15 + "=", "a=" + "C" * 14 + "==&b="),
        (4, "E" * 60, ""),
        (4, "F" * 16, "E" * 44 + " at "),
    ]


def test_short_secrets_are_candidates(spark):
    forms = {
        'password = "hunter2!Xy"': "hunter2!Xy",
        "db_password: abc123def456, x": "abc123def456",
        "see postgres://admin:s3cr3t!pw@db.host/x": "s3cr3t!pw",
        "The pwd: hunter2xyz. Then": "hunter2xyz",
        "https://x.y/?token=abc.123&user=someone": "abc.123",
        "Authorization: Basic dXNlcjpw": "dXNlcjpw",
        "{'apiKey': 'k&9=:x.'}": "k&9=:x.",
        "PASSWORD=a&b.12345..": "a&b.12345",
        "access token := " + "ab.9" * 5000: "ab.9" * 5000,
        "secret: 9f86d081884c7d659a2f!x": "9f86d081884c7d659a2f!x",
        "author: someone compass: northern tokenizer: wordpiece": None,
        "password: abc.. token = 12345 http://host:8080/a@b": None,
    }
    docs = spark.createDataFrame(list(enumerate(forms)), "doc_id long, text string")
    words = secrets.dictionary(docs)
    found = secrets.with_features(secrets.find_candidates(docs), words).collect()
    assert {(r.doc_id, r.token) for r in found} == {(i, v) for i, v in enumerate(forms.values()) if v}
    assert all(r.credential_before == 1 and r.assigned == 1 for r in found)


def test_secret_dictionary_has_all_words(spark):
    frequent = spark.range(20_500).selectExpr("id AS doc_id", "translate(lpad(conv(id, 10, 8), 6, '0'), '01234567', 'stuvwxyz') AS word")
    docs = frequent.selectExpr("doc_id", "concat_ws(' ', word, word) AS text").unionByName(spark.createDataFrame([(-1, "jkkjw " + "jkkj" * 4)], "doc_id long, text string"))
    words = secrets.dictionary(docs)
    assert words.count() == 20_501
    assert secrets.with_features(secrets.find_candidates(docs), words).first().coverage == 4 / 13
