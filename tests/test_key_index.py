"""Bitmaps of stored keys: never a miss, few false hits, exact inserts, files indexed once."""

import datetime as dt

from pyspark.sql import functions as F

from tillwatch.session import work_dir
from tillwatch.sources import fact_load, key_index

KEYS = fact_load.FACT_KEY


def rows(spark, low, high, days=20, value=1.0):
    """One row an id; ids 7 days apart share a day, and every id has a time of its own."""
    day = F.expr(f"timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % {days} as int), 0, 0, cast(id as int))")
    return spark.range(low, high).select(F.col("id").alias("id_tlf"), day.alias("fecha_transaccion"), F.lit("c").alias("cod_terminal"), F.lit(value).alias("valor"))


def dated(df):
    return df.withColumn("dia", F.to_date("fecha_transaccion"))


def test_no_stored_key_is_ruled_out_and_few_others_are_possible(spark):
    stored, fresh = dated(rows(spark, 0, 40_000)), dated(rows(spark, 40_000, 80_000))
    bits = key_index.key_bits(stored, KEYS).withColumnRenamed("bits", "guardados")
    assert key_index.with_possible(stored, bits, KEYS).filter("NOT posible").count() == 0
    assert key_index.with_possible(fresh, bits, KEYS).filter("posible").count() < 40


def test_insert_is_exact_and_compares_only_candidates(spark):
    target = work_dir(spark, "fact")
    insert = lambda df: fact_load.insert_if_absent(spark, df, target, by_index=True)
    assert insert(rows(spark, 0, 20_000)) == {"insertados": 20_000, "omitidos": 0}
    load = rows(spark, 19_900, 20_500, value=2.0)
    assert insert(load) == {"insertados": 500, "omitidos": 100}
    assert insert(load) == {"insertados": 0, "omitidos": 600}
    # A writer that knows nothing of bitmaps: its files are indexed before the next load.
    dated(rows(spark, 30_000, 30_100)).write.mode("append").partitionBy("dia").parquet(target)
    assert insert(rows(spark, 30_050, 30_150, value=2.0)) == {"insertados": 50, "omitidos": 50}
    table = spark.read.parquet(target)
    assert table.count() == table.select(*KEYS).distinct().count() == 20_650
    assert table.filter("valor = 2").count() == 550
    possible = dated(load.filter("id_tlf < 20000 AND id_tlf % 20 < 3"))
    met = key_index.stored_candidates(table, possible, KEYS)
    assert met.select("id_tlf").distinct().count() == possible.count() == met.count()
    assert "PartitionFilters: [dia" in met._jdf.queryExecution().toString()


def test_files_are_read_once_and_a_stopped_run_counts_for_nothing(spark):
    target = work_dir(spark, "fact")
    fact_load.insert_if_absent(spark, rows(spark, 0, 100, days=3), target, by_index=True)
    bits = key_index.key_bits(dated(rows(spark, 500, 600)), KEYS)
    bits.withColumn("carga", F.lit("stopped")).write.mode("append").partitionBy("carga", "dia").parquet(f"{target}_llaves")
    assert key_index.index_keys(spark, target, KEYS) == len(spark.read.parquet(target).inputFiles())
    assert key_index.index_keys(spark, target, KEYS) == 0
    want = key_index.key_bits(dated(rows(spark, 0, 100, days=3)), KEYS)
    assert sorted(key_index.stored_bits(spark, target).collect()) == sorted(want.collect())


def test_null_keys_empty_loads_and_many_copies(spark):
    target = work_dir(spark, "fact")
    some = rows(spark, 0, 50, days=2)
    nulls = spark.createDataFrame([(None, dt.datetime(2024, 1, 1), "a", 1.0)] * 3 + [(1, None, "b", 1.0)], "id_tlf long, fecha_transaccion timestamp_ntz, cod_terminal string, valor double")
    copies = some.unionByName(some).unionByName(some)
    assert fact_load.insert_if_absent(spark, some.limit(0), target, by_index=True) == {"insertados": 0, "omitidos": 0}
    assert fact_load.insert_if_absent(spark, copies.unionByName(nulls), target, by_index=True)["insertados"] == 54
    assert fact_load.insert_if_absent(spark, copies.unionByName(nulls), target, by_index=True)["insertados"] == 4
    assert fact_load.insert_if_absent(spark, some.limit(0), target, by_index=True) == {"insertados": 0, "omitidos": 0}
