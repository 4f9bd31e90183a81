"""The side table of late rows: nothing is lost, replays change nothing, closed days come back whole."""

import datetime as dt

from pyspark.sql import functions as F

from tests.test_streaming import SCHEMA, records, run, table
from tillwatch.operators.rollup import rollup_notes
from tillwatch.session import work_dir
from tillwatch.sources.tables import finish_switch, switch_table
from tillwatch.streaming import late_rows
from tillwatch.streaming.rollup_stream import POLICIES

POLICY = POLICIES["15min"]
COLUMN = POLICY.column


def places(spark):
    return [work_dir(spark, n) for n in ("in", "out", "late", "state")]


def feed(spark, folder, rows):
    rows.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(SCHEMA).parquet(folder)


def test_every_record_is_in_one_of_the_two_tables(spark):
    folder, target, late, state = places(spark)
    batches = [range(0, 300, 7), range(100, 3000, 13), range(0, 3100, 11)]
    for minutes in batches:  # each run is a trigger of the restarted query
        run(late_rows.maintain_with_late_rows(spark, feed(spark, folder, records(spark, minutes)), POLICY, target, late, state, once=True))
    newest, dropped, kept = None, [], []
    for minutes in batches:
        rows = [(m, newest is not None and m // 15 * 15 + 15 <= newest - 60) for m in minutes]
        dropped += [m for m, gone in rows if gone]
        kept += [m for m, gone in rows if not gone]
        newest = max([*minutes, *([] if newest is None else [newest])])
    side = spark.read.parquet(late)
    start = dt.datetime(2024, 1, 1, 10)
    assert sorted(int((r[0] - start).total_seconds() // 60) for r in side.select("fecha_hora").collect()) == sorted(dropped)
    assert len(dropped) > 100
    assert late_rows.read_rollup(spark, target).agg(F.sum("num_registros")).first()[0] == len(kept)
    everything = spark.read.schema(SCHEMA).parquet(folder)
    on_time = everything.exceptAll(side.select(*everything.columns))
    assert table(late_rows.read_rollup(spark, target), COLUMN) == table(rollup_notes(on_time), COLUMN)

    days = late_rows.refresh_late(spark, everything, POLICY, target, late, state)
    assert days == [dt.date(2024, 1, 1), dt.date(2024, 1, 2)]  # the third is still open
    closed = F.col(COLUMN) < F.lit("2024-01-03").cast("timestamp_ntz")
    assert table(late_rows.read_rollup(spark, target).filter(closed), COLUMN) == table(rollup_notes(everything).filter(closed), COLUMN)
    assert late_rows.refresh_late(spark, everything, POLICY, target, late, state) == []


def test_a_trigger_that_runs_again_changes_nothing(spark):
    folder, target, late, state = places(spark)
    for minutes in (range(0, 200, 9), range(0, 400, 8)):
        run(late_rows.maintain_with_late_rows(spark, feed(spark, folder, records(spark, minutes)), POLICY, target, late, state, once=True))
    whole, side = table(late_rows.read_rollup(spark, target), COLUMN), spark.read.parquet(late).count()
    # The second trigger again, as after a crash before its commit.
    again = records(spark, range(0, 400, 8))
    before = late_rows._advance(again, state, 1)
    assert before == dt.datetime(2024, 1, 1, 10) + dt.timedelta(minutes=198)
    late_rows._merge(late_rows.bucket_states(again, POLICY), POLICY, target, late_rows.query_name(state), 1)
    assert table(late_rows.read_rollup(spark, target), COLUMN) == whole and spark.read.parquet(late).count() == side


def test_nulls_empty_triggers_and_repeated_rows(spark):
    folder, target, late, state = places(spark)
    some = records(spark, [0, 0, 5])
    odd = some.limit(1).withColumn("fecha_hora", F.lit(None).cast("timestamp_ntz"))
    nameless = some.limit(1).withColumn("cod_cajero", F.lit(None).cast("string")).withColumn("monto_total", F.lit(None).cast("double"))
    for rows in (some.limit(0), some.unionByName(odd).unionByName(nameless), nameless.unionByName(some)):
        run(late_rows.maintain_with_late_rows(spark, feed(spark, folder, rows), POLICY, target, late, state, once=True))
    whole = spark.read.schema(SCHEMA).parquet(folder).filter("fecha_hora IS NOT NULL")
    assert table(late_rows.read_rollup(spark, target), COLUMN) == table(rollup_notes(whole), COLUMN)
    assert [r.dia for r in spark.read.parquet(late).collect()] == [None]


def test_a_mark_left_half_written_is_ignored(spark):
    state = work_dir(spark, "state")
    base, name = late_rows._mark(state)
    rows = records(spark, [0, 30])
    assert late_rows._advance(rows, state, 0) is None
    newest = late_rows._advance(records(spark, [10]), state, 1)
    assert newest == dt.datetime(2024, 1, 1, 10, 30)
    switch_table(spark.read.parquet(f"{base}/{name}"), base, f"{name}-copy")
    finish_switch(spark, base, name)
    assert late_rows._advance(records(spark, [10]), state, 1) == newest
    assert late_rows.watermark(spark, state, POLICY) == dt.datetime(2024, 1, 1, 9, 30)
