"""The 15-minute dispensing file: header line, detail lines with (count, denomination) pairs.

Lines are read one row each, so a large file is split like any text file. The
position of a line is its block offset and its number inside the block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.plans.skew import lookup_join
from tillwatch.schemas import ADMIN_CODES, DENOMINATIONS, DISPENSING_CODES
from tillwatch.session import materialise

STAMP = "yyyyMMddHHmmss"


def with_file(text: DataFrame) -> DataFrame:
    """Text lines, batch or stream, with their file path and block offset."""
    return text.select(
        "value",
        F.col("_metadata.file_path").alias("archivo_origen"),
        F.col("_metadata.file_block_start").alias("bloque"),
    )


def with_position(lines: DataFrame) -> DataFrame:
    """Number the lines; numbers grow inside a block because one task reads it in order."""
    return lines.select(
        "value", "archivo_origen", F.struct("bloque", F.monotonically_increasing_id().alias("numero")).alias("linea")
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Numbered lines of files, written once: all later steps see the same numbers."""
    return materialise(with_position(with_file(spark.read.text(path))), "lines")


def _stamp(text: Column) -> Column:
    return F.try_to_timestamp(F.trim(text), F.lit(STAMP)).cast("timestamp_ntz")


def _note_count(fields: Column, denomination: int) -> Column:
    """Count of one denomination over the pairs that start at the sixth field; the last pair wins.

    A trailing field without partner is ignored.
    """
    starts = F.filter(
        F.sequence(F.lit(6), F.greatest(F.size(fields), F.lit(6)), F.lit(2)),
        lambda i: F.trim(F.try_element_at(fields, i + 1)).try_cast("int") == denomination,
    )
    return F.trim(F.try_element_at(fields, F.try_element_at(starts, F.lit(-1)))).try_cast("int")


def file_headers(lines: DataFrame) -> DataFrame:
    """Per file, from its first line: position, time sent and expected number of rows."""
    first = lines.filter("linea.bloque = 0").groupBy("archivo_origen").agg(
        F.min_by("value", "linea").alias("cabecera"), F.min("linea").alias("linea_cabecera")
    )
    fields = F.split("cabecera", ",")
    return first.select(
        "archivo_origen",
        "linea_cabecera",
        _stamp(F.get(fields, F.lit(1))).alias("fecha_envio"),
        F.trim(F.get(fields, F.lit(2))).try_cast("bigint").alias("registros_esperados"),
    )


def parse_lines(lines: DataFrame) -> DataFrame:
    """Detail lines of the dispensing codes, typed, with the time their file was sent."""
    fields = F.split(F.trim("value"), ",")
    names = F.create_map(*[F.lit(v) for pair in ADMIN_CODES.items() for v in pair])
    detail = (
        lines.withColumn("_f", fields)
        .filter(F.size("_f") >= 5)
        .withColumn("cod_admin_efectivo", F.trim(F.get("_f", F.lit(2))).try_cast("int"))
        .filter(F.col("cod_admin_efectivo").isin(DISPENSING_CODES))
    )
    f = F.col("_f")
    detail = detail.select(
        "archivo_origen",
        "linea",
        F.get(f, F.lit(1)).alias("cod_cajero"),
        "cod_admin_efectivo",
        F.coalesce(F.try_element_at(names, F.col("cod_admin_efectivo")), F.lit("Desconocido")).alias("tipo_admin"),
        F.trim(F.get(f, F.lit(3))).try_cast("double").alias("monto_total"),
        _stamp(F.get(f, F.lit(4))).alias("fecha_hora"),
        *[_note_count(f, d).alias(f"billetes_{d}k") for d in DENOMINATIONS],
    )
    headers = file_headers(lines).select("archivo_origen", "linea_cabecera", "fecha_envio")
    return (
        lookup_join(detail, headers, ["archivo_origen"], derived=True)
        .filter(F.col("linea") != F.col("linea_cabecera"))
        .drop("linea_cabecera")
    )


def file_summary(lines: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per file: rows kept, machines, amount, and detail lines read against the expected number."""
    kept = parsed.groupBy("archivo_origen").agg(
        F.count(F.lit(1)).alias("registros"),
        F.countDistinct("cod_cajero").alias("cajeros"),
        F.sum("monto_total").alias("monto_total"),
    )
    read = lines.groupBy("archivo_origen").agg((F.count(F.lit(1)) - 1).alias("registros_leidos"))
    headers = file_headers(lines).select("archivo_origen", "fecha_envio", "registros_esperados")
    return headers.join(read, "archivo_origen").join(kept, "archivo_origen", "left").fillna(0, ["registros", "cajeros"])
