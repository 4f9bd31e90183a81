"""Monthly transaction extracts: CSV folders to one typed Parquet dataset."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.plans.skew import anti_join, lookup_join
from tillwatch.schemas import (
    DATE_HEADING,
    FLOAT_HEADINGS,
    INT_HEADINGS,
    TIME_FORMAT,
    TIME_HEADING,
    TRANSACTION_HEADINGS,
)
from tillwatch.session import materialise
from tillwatch.sources.tables import remove

# What folder names of partitions have as percent escapes.
ESCAPED = "\"#%'*/:=?\\\x7f{[]^"

SURPLUS = "_sobra"
FILE = "_ruta"
#: Of a line: its block in the file and its number in the block, its text, and the heading line of its file.
POSITION, TEXT, HEADING = "_posicion", "_texto", "_encabezado"
LINE = [POSITION, TEXT, HEADING]
#: Of a heading line: where in a line the fields of the known columns are.
PLACES = "_lugares"
QUARANTINE = ["mes_origen", "archivo_origen", "linea", "motivo", "texto", "encabezado"]


def _fields(line: Column, most: int) -> Column:
    """The fields of a CSV line as an array of texts; of a line with quotes the first ``most``.

    A line without quotes is cut at its commas. One with quotes is parsed, in an expression that holds the parser once:
    a filter on a field is moved to where the field is made, and would parse the line again for every other field.
    """
    schema = ", ".join(f"_{i} STRING" for i in range(most))
    parsed = F.array(F.from_csv(line, schema, {"mode": "PERMISSIVE"}))
    texts = F.transform(parsed, lambda csv: F.array(*[csv[f"_{i}"] for i in range(most)]))
    return F.when(F.contains(line, F.lit('"')), F.get(texts, F.lit(0))).otherwise(F.split(line, ",", -1))


def _numbered_lines(spark: SparkSession, path: str, recursive: bool) -> DataFrame:
    """Lines of all ``*.csv`` files of a folder, in one scan. Written, so that numbers hold: they grow within a block."""
    text = spark.read.option("pathGlobFilter", "*.csv").option("recursiveFileLookup", recursive).text(path)
    meta = F.col("_metadata")
    return materialise(
        text.select(
            F.col("value").alias(TEXT),
            meta.file_path.alias(FILE),
            F.url_decode(F.replace(meta.file_name, F.lit("+"), F.lit("%2B"))).alias("archivo_origen"),
            F.struct(meta.file_block_start.alias("bloque"), F.monotonically_increasing_id().alias("numero")).alias(POSITION),
        ),
        "month-lines",
    )


def _headings(lines: DataFrame) -> DataFrame:
    """The first line of each file that is not blank, without a byte order mark."""
    first = lines.filter((F.col(f"{POSITION}.bloque") == 0) & (F.trim(F.translate(TEXT, "\ufeff", "")) != ""))
    found = first.groupBy(FILE).agg(F.min_by(TEXT, POSITION).alias(HEADING), F.min(POSITION).alias("_primera"))
    return found.withColumn(HEADING, F.ltrim(F.translate(HEADING, "\ufeff", "")))


#: Put behind a heading line, it tells how many fields the line has, empty ones too.
END = "\u0001"


def _with_places(firsts: DataFrame, headings: Sequence[str], most: int) -> DataFrame:
    """Add to every HEADING, once for all its lines, the places of the named columns and of the end: -1 where there is none."""
    names = firsts.withColumn("_nombres", F.transform(_fields(F.concat(HEADING, F.lit("," + END)), most), F.trim))
    return names.withColumn(PLACES, F.array(*[F.array_position("_nombres", h).cast("int") - 1 for h in (*headings, END)])).drop("_nombres")


def _by_heading(lines: DataFrame, headings: Sequence[str], most: int) -> DataFrame:
    """Lines, each with the PLACES of its heading, with the text columns found there, and SURPLUS. Empty fields are null."""
    rows = lines.withColumn("_campos", _fields(F.col(TEXT), most))
    columns = [F.nullif(F.get("_campos", F.get(PLACES, F.lit(i))), F.lit("")).alias(h) for i, h in enumerate((*headings, SURPLUS))]
    return rows.select("*", *columns).drop("_campos", PLACES)


def _widest(headings: DataFrame) -> int:
    """Fields that a line can have to be looked at: those of the widest heading, one more, and the mark of its end."""
    return (headings.agg(F.max(F.size(F.split(HEADING, ",")))).first()[0] or 0) + 2


def read_month(
    spark: SparkSession,
    base: str,
    month: str,
    headings: Sequence[str] = tuple(TRANSACTION_HEADINGS),
    recursive: bool = False,
) -> DataFrame:
    """All ``*.csv`` files of a month folder as text columns, with lineage and the lines themselves.

    The folder is one scan, whatever the number of files. Columns are found by their heading, file by file: their order does
    not matter, those without a known heading (such as the index) are dropped, missing ones are null, of two with one
    heading the first counts. The heading is the first line that is not blank. A field past the last heading of its
    own file is kept apart, to tell malformed lines.
    """
    return _parsed(_numbered_lines(spark, f"{base.rstrip('/')}/{month}", recursive), month, headings)


def _parsed(lines: DataFrame, month: str, headings: Sequence[str] = tuple(TRANSACTION_HEADINGS)) -> DataFrame:
    firsts = materialise(_headings(lines), "headings")
    most = _widest(firsts)
    found = lookup_join(lines.filter(F.trim(TEXT) != ""), _with_places(firsts, headings, most), [FILE], "inner")
    rows = _by_heading(found.filter(F.col(POSITION) != F.col("_primera")).drop("_primera"), headings, most)
    return rows.withColumns({"mes_origen": F.lit(month), "fecha_procesamiento": F.current_timestamp()})


def is_malformed() -> Column:
    """Lines with more fields than the header; short lines are read with nulls."""
    return F.col(SURPLUS).isNotNull()


def coerce_types(
    df: DataFrame,
    ints: Sequence[str] = tuple(INT_HEADINGS),
    floats: Sequence[str] = tuple(FLOAT_HEADINGS),
    time: str = TIME_HEADING,
    date: str = DATE_HEADING,
) -> DataFrame:
    """Cast the configured columns that are present; values that cannot be read or do not fit become null.

    Types are fixed, not chosen from the data. Whole numbers written as ``3.0`` are accepted.
    """
    casts = {}
    for c in df.columns:
        name = f"`{c}`"
        if c in ints:
            casts[c] = F.expr(f"try_cast(try_cast({name} AS DOUBLE) AS INT)")
        elif c in floats:
            casts[c] = F.expr(f"try_cast({name} AS DOUBLE)")
        elif c == time:
            casts[c] = F.try_to_timestamp(F.col(name), F.lit(TIME_FORMAT)).cast("timestamp_ntz")
        elif c == date:
            casts[c] = F.coalesce(
                F.expr(f"try_cast({name} AS DATE)"), F.try_to_timestamp(F.col(name), F.lit("yyyy/MM/dd")).cast("date")
            )
        elif c == "Id Tlf":
            exact = f"try_cast({name} AS DECIMAL(38, 9))"
            casts[c] = F.expr(f"CASE WHEN {exact} = floor({exact}) THEN try_cast({exact} AS BIGINT) END")
    return df.withColumns(casts)


def split_bad_files(month: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of the readable files, and one error row per file with a malformed line. The text is parsed once."""
    month = materialise(month.drop(*LINE), "month")
    bad = materialise(  # one row per malformed file
        month.filter(is_malformed())
        .groupBy("mes_origen", FILE, "archivo_origen")
        .agg(F.count(F.lit(1)).alias("lineas")),
        "bad-files",
    )
    errors = bad.select(
        "mes_origen", "archivo_origen", F.concat(F.col("lineas"), F.lit(" lineas con campos de mas")).alias("error")
    )
    return anti_join(month, bad, [FILE]).drop(SURPLUS, FILE), errors


def bad_line(required: Sequence[str] = ()) -> Column:
    """Why a line is rejected: more fields than its heading, or a required column without a readable value. Null: it is not."""
    reason = F.when(is_malformed(), F.lit("campos de mas"))
    for heading in required:
        reason = reason.when(F.col(f"_tipado.`{heading}`").isNull(), F.lit(f"valor ilegible: {heading}"))
    return reason


def split_bad_lines(month: DataFrame, required: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Typed rows of the good lines, and the rejected ones: ``QUARANTINE`` with file, line number, reason, text and heading.

    Blank lines count in the number of a line.
    """
    plain = [c for c in month.columns if c not in (*LINE, SURPLUS, FILE)]
    typed = coerce_types(month.select(*plain, *LINE, SURPLUS, FILE))
    rows = typed.withColumn("_tipado", F.struct(*[F.col(f"`{c}`") for c in plain])).withColumn("_motivo", bad_line(required))
    rejected = rows.filter(F.col("_motivo").isNotNull()).select("mes_origen", "archivo_origen", FILE, F.col("_motivo").alias("motivo"), F.col(TEXT).alias("texto"), F.col(HEADING).alias("encabezado"), POSITION)
    return rows.filter(F.col("_motivo").isNull()).select(*[F.col(f"`{c}`") for c in plain]), rejected


def _with_line_numbers(rejected: DataFrame, lines: DataFrame) -> DataFrame:
    """Numbers of rejected lines in their files, from the number of lines in the blocks before."""
    blocks = lines.groupBy(FILE, F.col(f"{POSITION}.bloque").alias("_bloque")).agg(F.count(F.lit(1)).alias("_n"), F.min(f"{POSITION}.numero").alias("_cero"))
    before = F.sum("_n").over(Window.partitionBy(FILE).orderBy("_bloque").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("_antes", F.coalesce(before, F.lit(0))).drop("_n")
    number = F.col("_antes") + F.col(f"{POSITION}.numero") - F.col("_cero") + 1
    found = rejected.withColumn("_bloque", F.col(f"{POSITION}.bloque")).join(blocks, [FILE, "_bloque"])
    return found.withColumn("linea", number).select(*QUARANTINE)


def load_month_lines(
    spark: SparkSession, base: str, month: str, recursive: bool = False, required: Sequence[str] = ()
) -> tuple[DataFrame | None, DataFrame, DataFrame | None]:
    """Typed rows of a month, its errors, and its rejected lines: a bad line costs that line only.

    A file with rejected lines is an error row that tells how many; so is a missing or empty folder.
    """
    missing = _missing_folder(spark, base, month, recursive)
    if missing is not None:
        return None, missing, None
    lines = _numbered_lines(spark, f"{base.rstrip('/')}/{month}", recursive)
    good, rejected = split_bad_lines(_parsed(lines, month), required)
    rejected = materialise(rejected, "rejected")
    errors = rejected.groupBy("mes_origen", "archivo_origen").agg(F.concat(F.count(F.lit(1)), F.lit(" lineas en cuarentena")).alias("error"))
    return good, errors, materialise(_with_line_numbers(rejected, lines), "quarantine")


def replay_lines(spark: SparkSession, lines: DataFrame, target: str, required: Sequence[str] = ()) -> DataFrame:
    """Add corrected lines of the quarantine (its columns, ``texto`` mended) to their months; returns those still rejected.

    The heading kept with a line tells its columns. Loading a month again replaces what was added to it.
    """
    lines = materialise(lines.select(*QUARANTINE), "replay")
    rows = lines.select("mes_origen", "archivo_origen", F.col("archivo_origen").alias(FILE), F.col("texto").alias(TEXT), F.col("encabezado").alias(HEADING), F.struct(F.lit(0).cast("long").alias("bloque"), F.col("linea").alias("numero")).alias(POSITION))
    firsts = materialise(rows.select(HEADING).distinct(), "headings")
    headings, most = tuple(TRANSACTION_HEADINGS), _widest(firsts)
    parsed = _by_heading(lookup_join(rows, _with_places(firsts, headings, most), [HEADING]), headings, most)
    good, rejected = split_bad_lines(parsed.withColumn("fecha_procesamiento", F.current_timestamp()), required)
    write_month(materialise(good, "replayed"), target)
    return rejected.withColumn("linea", F.col(f"{POSITION}.numero")).select(*QUARANTINE)


def load_month(
    spark: SparkSession, base: str, month: str, recursive: bool = False
) -> tuple[DataFrame | None, DataFrame]:
    """Typed rows of a month and its errors; a missing or empty folder is an error row, not a failure.

    A file with a malformed line is skipped whole; ``load_month_lines`` skips the line.
    """
    missing = _missing_folder(spark, base, month, recursive)
    if missing is not None:
        return None, missing
    good, errors = split_bad_files(read_month(spark, base, month, recursive=recursive))
    return coerce_types(good), errors


def _missing_folder(spark: SparkSession, base: str, month: str, recursive: bool) -> DataFrame | None:
    """The error row of a folder that is not there or has no files."""
    error_schema = "mes_origen string, archivo_origen string, error string"
    path = f"{base.rstrip('/')}/{month}"
    try:
        names = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").option(
            "recursiveFileLookup", recursive
        ).load(path).select("path")
    except AnalysisException:
        return spark.createDataFrame([(month, None, "Carpeta no encontrada")], error_schema)
    return spark.createDataFrame([(month, None, "Sin archivos CSV")], error_schema) if names.isEmpty() else None


def write_month(df: DataFrame, target: str, replace: bool = False) -> None:
    """Add a month to the consolidated dataset, one partition per month.

    Appending writes new files and leaves the existing ones alone.
    """
    writer = df.write.partitionBy("mes_origen").option("compression", "snappy")
    if replace:
        writer.mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(target)
    else:
        writer.mode("append").parquet(target)


def consolidate(months: Sequence[DataFrame]) -> DataFrame:
    """All months as one table; a column a month lacks is null there."""
    out = months[0]
    for month in months[1:]:
        out = out.unionByName(month, allowMissingColumns=True)
    return out


def read_consolidated(spark: SparkSession, target: str) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(target)


def _folder_name(value: str) -> str:
    """A partition value as the name of its folder."""
    return "".join(f"%{ord(c):02X}" if c in ESCAPED or ord(c) < 32 else c for c in value)


def ingest_months(
    spark: SparkSession, base: str, months: Sequence[str], target: str, quarantine: str | None = None, required: Sequence[str] = ()
) -> DataFrame:
    """Load each month folder into ``target``; returns the errors, the run goes on past them.

    A month that was loaded before is replaced. Files with a bad line are skipped whole, or, given a table ``quarantine``,
    only the lines are: they are kept there by month, without readable values of ``required`` columns too.
    """
    problems = []
    for month in dict.fromkeys(months):
        if quarantine is None:
            rows, errors = load_month(spark, base, month)
        else:
            rows, errors, rejected = load_month_lines(spark, base, month, required=required)
            if rejected is not None:
                remove(spark, f"{quarantine}/mes_origen={_folder_name(month)}")
                write_month(rejected, quarantine)
        if rows is not None:
            write_month(rows, target, replace=True)
        problems.append(errors)
    return consolidate(problems)


def month_report(consolidated: DataFrame, time: str = "fecha_transaccion") -> DataFrame:
    """Rows and first/last time per month, and over all months (``mes_origen`` = ``TOTAL``)."""
    per_month = consolidated.groupBy("mes_origen").agg(
        F.count(F.lit(1)).alias("registros"), F.min(time).alias("desde"), F.max(time).alias("hasta")
    )
    total = per_month.agg(
        F.lit("TOTAL").alias("mes_origen"),
        F.sum("registros").alias("registros"),
        F.min("desde").alias("desde"),
        F.max("hasta").alias("hasta"),
    )
    return per_month.unionByName(total)
