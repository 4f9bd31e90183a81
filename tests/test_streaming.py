"""Streams: equal to the batch form, late rows, replays, files that arrive one after the other."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillwatch.operators.rollup import rollup_notes
from tillwatch.schemas import NOTE_COLUMNS
from tillwatch.session import work_dir
from tillwatch.streaming import file_stream, rollup_stream

SCHEMA = "cod_cajero string, fecha_hora timestamp_ntz, cod_admin_efectivo int, monto_total double, " + ", ".join(
    f"{c} int" for c in NOTE_COLUMNS
)
START = dt.datetime(2024, 1, 1, 10)


def records(spark, minutes, amount=100.0):
    notes = tuple(range(len(NOTE_COLUMNS)))
    return spark.createDataFrame(
        [(str(i % 3), START + dt.timedelta(minutes=m), 2 + i % 2, amount + i, *notes) for i, m in enumerate(minutes)], SCHEMA
    )


def run(query):
    query.awaitTermination()
    assert query.exception() is None


def stream(spark, folder):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def table(df, column):
    keys = [column, "cod_cajero", "cod_admin_efectivo"]
    numbers = [F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in sorted(df.dtypes) if c not in keys]
    return sorted(df.select(*keys, *numbers).collect(), key=repr)


@pytest.mark.parametrize("key", ["15min", "30min", "1hora"])
def test_stream_equals_batch_over_several_triggers(spark, key):
    policy, folder, target, state = rollup_stream.POLICIES[key], *(work_dir(spark, n) for n in ("in", "out", "state"))
    first, second = records(spark, range(0, 50, 7)), records(spark, range(20, 90, 9), 500.0)
    for part in (first, second):  # each run of the query takes what is new
        part.coalesce(1).write.mode("append").parquet(folder)
        run(rollup_stream.maintain_rollup(spark, stream(spark, folder), policy, target, state, once=True))
    batch = rollup_notes(first.unionByName(second), policy.width, policy.column)
    assert table(spark.read.parquet(target).drop("dia"), policy.column) == table(batch, policy.column)


def test_rows_later_than_allowed_stay_out_until_refreshed(spark):
    policy, folder, target, state = rollup_stream.POLICIES["15min"], *(work_dir(spark, n) for n in ("in", "out", "state"))
    early, jump, late = records(spark, [0, 1, 2]), records(spark, [300, 301]), records(spark, [3, 302])
    for part in (early, jump, late):
        part.coalesce(1).write.mode("append").parquet(folder)
        run(rollup_stream.maintain_rollup(spark, stream(spark, folder), policy, target, state, once=True))
    assert spark.read.parquet(target).agg(F.sum("num_registros")).first()[0] == 6  # the row of minute 3 is missing
    stored = spark.read.schema(SCHEMA).parquet(folder)
    rollup_stream.refresh_range(spark, stored, policy, target, START, START + dt.timedelta(hours=1))
    assert table(spark.read.parquet(target).drop("dia"), policy.column) == table(
        rollup_notes(early.unionByName(jump).unionByName(late), policy.width, policy.column), policy.column
    )


def test_append_writes_closed_buckets_once(spark):
    policy, folder, target, state = rollup_stream.POLICIES["15min"], *(work_dir(spark, n) for n in ("in", "out", "state"))
    for part in (records(spark, [0, 1, 16]), records(spark, [200])):
        part.coalesce(1).write.mode("append").parquet(folder)
        run(rollup_stream.append_rollup(stream(spark, folder), policy, target, state, once=True))
    out = spark.read.parquet(target)
    assert out.agg(F.sum("num_registros")).first()[0] == 3  # the newest bucket is still open
    assert out.select("bucket_15min", "cod_cajero", "cod_admin_efectivo").distinct().count() == out.count()


def test_chained_rollups_equal_batch_over_several_triggers(spark):
    folder, state = work_dir(spark, "in"), work_dir(spark, "state")
    targets = {name: work_dir(spark, name) for name in rollup_stream.POLICIES}
    parts = [records(spark, range(0, 95, 4)), records(spark, range(20, 180, 7), 500.0), records(spark, [600, 601]), records(spark, [900])]
    for part in parts:  # the last two only move the watermark
        part.coalesce(1).write.mode("append").parquet(folder)
        run(rollup_stream.maintain_rollups(spark, stream(spark, folder), targets, state, "2 hours", once=True))
    both = parts[0].unionByName(parts[1])
    for name, policy in rollup_stream.POLICIES.items():
        early = spark.read.parquet(targets[name]).drop("dia").filter(F.col(policy.column) < F.lit(START + dt.timedelta(hours=5)).cast("timestamp_ntz"))
        assert table(early, policy.column) == table(rollup_notes(both, policy.width, policy.column), policy.column)
    plan = rollup_stream.chained_rollups(stream(spark, folder))._jdf.queryExecution().analyzed().toString()
    assert plan.count("StreamingRelation") == 1


PROFILE = (
    "cod_cajero string, dispensacion_promedio double, dispensacion_std double, disp_madrugada double,"
    " ratio_vs_zona double, pct_anomalias_3std double, score_modelo double"
)


def test_files_are_scored_as_they_arrive(spark, tmp_path):
    profile = spark.createDataFrame(
        [("100", 1000.0, 10.0, 0.0, 1.0, 0.0, -0.9), ("200", 1000.0, 10.0, 500.0, 1.0, 0.0, -0.1)], PROFILE
    )
    folder, target, state = tmp_path / "in", work_dir(spark, "alerts"), work_dir(spark, "state")
    folder.mkdir()
    unknown = []

    def watch():
        run(
            file_stream.watch_files(
                spark, str(folder), profile, target, state, 1, once=True,
                on_unknown=lambda df: unknown.extend(r.cod_cajero for r in df.collect()),
            )
        )

    (folder / "a.txt").write_text(
        "01,20240101030000,3\n02,100,2,5000,20240101030100,1,5\n02,100,3,4000,20240101030000,1,2\n"
        "02,200,2,1000,20240101030000,1,1\n02,999,2,1,20240101030000,1,1\n"
    )
    watch()
    first = spark.read.parquet(target).collect()
    assert [(r.cod_cajero, r.fecha_hora, r.monto_dispensado) for r in first] == [
        ("100", dt.datetime(2024, 1, 1, 3, 1), 9000.0)  # both lines, the time of the first
    ]
    assert unknown == ["999"]
    (folder / "b.txt").write_text("01,20240102120000,1\n02,100,2,9000,20240102120000,1,5\n")
    (folder / "c.txt").write_text("01,20240101040000,1\n02,100,2,7000,20240101030100,1,5\n")
    watch()
    rows = {r.fecha_hora: r for r in spark.read.parquet(target).collect()}
    assert len(rows) == 2
    merged = rows[dt.datetime(2024, 1, 1, 3, 1)]
    assert merged.monto_dispensado == 9000.0 and "$7,000" in merged.descripcion  # the amount stays, the text is new
    newest = file_stream.alerts_of_batch(spark.read.parquet(target))
    assert newest.count() == 1
    watch()  # nothing new
    assert spark.read.parquet(target).count() == 2
