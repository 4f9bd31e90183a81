"""Queries of the sources, the loading and merging of tables, the 15-minute files and the streams.

The files they read are written by Spark from the given tables, into the shared work folder.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog import features as f
from catalog import scoring as s
from catalog import tables as t
from catalog.registry import ORACLE, query
from catalog.tables import NOTES, rounded, rounded_sql, with_tables
from tillwatch.operators import rollup as r
from tillwatch.operators.machine_profile import machine_profile
from tillwatch.functions.calendar import bucket
from tillwatch.operators import rules as ru
from tillwatch.plans.skew import anti_join
from tillwatch.session import materialise, work_dir
from tillwatch.schemas import MACHINE_HEADINGS, TRANSACTION_HEADINGS
from tillwatch.sources import fact_load as fl
from tillwatch.sources import machines as mc
from tillwatch.sources import monthly_extracts as me
from tillwatch.sources import quarter_files as qf
from tillwatch.sources import tables as tb
from tillwatch.streaming import file_stream as fs
from tillwatch.streaming import late_rows as lt
from tillwatch.streaming import live_rules as lr
from tillwatch.streaming import recent_mean as rm
from tillwatch.streaming import rollup_stream as rst

# -- monthly extracts ----------------------------------------------------------------------------------------



def months(spark, sf) -> list[str]:
    """The months there are (a few)."""
    return sorted(r[0] for r in t.transactions(spark, sf).select("mes_origen").distinct().collect())


def raw_extract(spark, sf):
    """Transactions under their raw headings, as text, with an index column first."""
    rows = t.transactions(spark, sf).withColumn(
        "fecha_transaccion", F.date_format("fecha_transaccion", "yyyy/MM/dd HH:mm:ss")
    )
    text = [F.col(new).cast("string").alias(old) for old, new in TRANSACTION_HEADINGS.items()]
    return rows.select("mes_origen", F.col("id_tlf").cast("string").alias("indice"), *text)


def write_extract(spark, sf, broken: bool = False) -> str:
    """Month folders with one CSV file per day; ``broken`` puts a surplus field into every seventh day."""
    base = work_dir(spark, "extract")
    for month in months(spark, sf):
        rows = raw_extract(spark, sf).filter(F.col("mes_origen") == month).drop("mes_origen")
        rows = rows.withColumn("dia", F.substring("Fecha Transacción", 9, 2))
        writer = rows.repartition("dia").write
        if broken:
            spoilt = F.when(F.col("dia").cast("int") % 7 == 0, F.concat("Canal", F.lit(",x"))).otherwise(F.col("Canal"))
            writer = rows.withColumn("Canal", spoilt).repartition("dia").write.option("quote", "\u0000")
        writer.partitionBy("dia").option("header", True).csv(f"{base}/{month}")
    return base


EXTRACT_SQL = """
    SELECT id_tlf, date_trunc('second', fecha_transaccion) AS fecha_transaccion, cod_terminal,
           nullif(autorizador, '') AS autorizador,
           tipo_operacion, cod_estado_transaccion, valor_transaccion, valor_transaccion_original, cantidad_tx,
           fecha_negocio FROM tx"""
EXTRACT_COLUMNS = [
    "id_tlf",
    "fecha_transaccion",
    "cod_terminal",
    "autorizador",
    "tipo_operacion",
    "cod_estado_transaccion",
    "valor_transaccion",
    "valor_transaccion_original",
    "cantidad_tx",
    "fecha_negocio",
]


@query("s01_scan_month", with_tables("tx", f"{EXTRACT_SQL} WHERE mes_origen = '2024/02'"))
def _(spark, sf):
    base = write_extract(spark, sf)
    rows, _ = me.load_month(spark, base, "2024/02", recursive=True)
    return fl.rename_headings(rows).select(*EXTRACT_COLUMNS)


@query(
    "s02_bad_files",
    with_tables(
        "tx",
        """
        SELECT 'filas' AS clase, count(*) FILTER (day(fecha_transaccion) % 7 <> 0) AS n FROM tx
        UNION ALL SELECT 'archivos con error', count(DISTINCT day(fecha_transaccion))
            FILTER (day(fecha_transaccion) % 7 = 0) FROM tx
        UNION ALL SELECT 'carpetas ausentes', 1""",
    ),
)
def _(spark, sf):
    base = write_extract(spark, sf, broken=True)
    loaded = [me.load_month(spark, base, m, recursive=True) for m in [*months(spark, sf), "2023/12"]]
    rows = me.consolidate([good for good, _ in loaded if good is not None])
    errors = me.consolidate([bad for _, bad in loaded])
    missing = F.col("archivo_origen").isNull()
    return (
        rows.agg(F.count(F.lit(1)).alias("n"))
        .select(F.lit("filas").alias("clase"), "n")
        .unionByName(
            errors.groupBy(F.when(missing, "carpetas ausentes").otherwise("archivos con error").alias("clase")).agg(
                F.count(F.lit(1)).alias("n")
            )
        )
    )


@query(
    "s02_line_quarantine",
    with_tables(
        "tx",
        """
        SELECT dia, count(*) FILTER (dia % 7 <> 0) AS filas, count(*) FILTER (dia % 7 = 0) AS en_cuarentena,
               CASE WHEN dia % 7 = 0 THEN 2 END AS primera_linea, CASE WHEN dia % 7 = 0 THEN count(*) + 1 END AS ultima_linea, count(*) AS tras_corregir
        FROM (SELECT day(fecha_transaccion) AS dia FROM tx) GROUP BY dia""",
    ),
)
def _(spark, sf):
    """Lines with a surplus field are kept apart; mended, they go into their month."""
    base, target = write_extract(spark, sf, broken=True), work_dir(spark, "months")
    kept = []
    for month in months(spark, sf):
        rows, _, rejected = me.load_month_lines(spark, base, month, recursive=True)
        me.write_month(rows, target)
        kept.append(rejected)
    rejected, day = me.consolidate(kept), F.dayofmonth("Fecha Transacción")
    before = materialise(me.read_consolidated(spark, target).groupBy(day.alias("dia")).agg(F.count(F.lit(1)).alias("filas")), "before")
    me.replay_lines(spark, rejected.withColumn("texto", F.replace("texto", F.lit("ATM,x"), F.lit("ATM"))), target)
    after = me.read_consolidated(spark, target).groupBy(day.alias("dia")).agg(F.count(F.lit(1)).alias("tras_corregir"))
    lines = rejected.groupBy(F.regexp_extract("texto", "2024/01/([0-9]+)", 1).cast("int").alias("dia")).agg(
        F.count(F.lit(1)).alias("en_cuarentena"), F.min("linea").cast("int").alias("primera_linea"), F.max("linea").alias("ultima_linea")
    )
    found = after.join(before, "dia", "left").join(lines, "dia", "left")
    return found.fillna(0, ["filas", "en_cuarentena"]).select("dia", "filas", "en_cuarentena", "primera_linea", "ultima_linea", "tras_corregir")


@query(
    "s03_coerce_types",
    with_tables(
        "tx",
        """
        SELECT id_tlf AS "Id Tlf", CASE WHEN id_tlf % 11 <> 0 THEN date_trunc('second', fecha_transaccion) END
               AS "Fecha Transacción", CASE WHEN id_tlf % 13 <> 0 THEN cod_terminal END AS "Cod Terminal",
               CASE WHEN id_tlf % 17 <> 0 THEN valor_transaccion END AS "Valor Transacción",
               CASE WHEN id_tlf % 19 <> 0 THEN fecha_negocio END AS "Fecha Negocio" FROM tx""",
    ),
)
def _(spark, sf):
    raw = raw_extract(spark, sf)
    key = F.col("Id Tlf").cast("bigint")
    spoilt = {
        "Fecha Transacción": F.when(key % 11 == 0, "31/12/2024").otherwise(F.col("Fecha Transacción")),
        "Cod Terminal": F.when(key % 13 == 0, "x").otherwise(F.concat("Cod Terminal", F.lit(".0"))),
        "Valor Transacción": F.when(key % 17 == 0, "n/a").otherwise(F.col("Valor Transacción")),
        "Fecha Negocio": F.when(key % 19 == 0, "ayer").otherwise(F.col("Fecha Negocio")),
    }
    return me.coerce_types(raw.withColumns(spoilt)).select("Id Tlf", *spoilt)


@query(
    "s04_lineage",
    with_tables(
        "tx",
        "SELECT id_tlf, mes_origen, true AS con_archivo, true AS con_fecha FROM tx",
    ),
)
def _(spark, sf):
    base = write_extract(spark, sf)
    rows = me.consolidate([me.load_month(spark, base, m, recursive=True)[0] for m in months(spark, sf)])
    return rows.select(
        F.col("Id Tlf").alias("id_tlf"),
        "mes_origen",
        F.col("archivo_origen").endswith(".csv").alias("con_archivo"),
        F.col("fecha_procesamiento").isNotNull().alias("con_fecha"),
    )


REPORT_SQL = """
    SELECT mes_origen, count(*) AS registros, min(fecha_transaccion) AS desde, max(fecha_transaccion) AS hasta
    FROM (SELECT mes_origen, date_trunc('second', fecha_transaccion) AS fecha_transaccion FROM tx) GROUP BY mes_origen
    UNION ALL SELECT 'TOTAL', count(*), min(date_trunc('second', fecha_transaccion)),
                     max(date_trunc('second', fecha_transaccion)) FROM tx"""


@query("s05_s06_s07_consolidated_report", with_tables("tx", REPORT_SQL))
def _(spark, sf):
    base, target = write_extract(spark, sf), work_dir(spark, "consolidated")
    for month in months(spark, sf):
        me.write_month(me.load_month(spark, base, month, recursive=True)[0], target)
    return me.month_report(fl.rename_headings(me.read_consolidated(spark, target)))


@query(
    "s06_u02_union_months",
    with_tables(
        "tx",
        "SELECT id_tlf, CASE WHEN mes_origen <> '2024/02' THEN canal END AS canal, mes_origen FROM tx",
    ),
)
def _(spark, sf):
    rows = t.transactions(spark, sf).select("id_tlf", "canal", "mes_origen")
    names = months(spark, sf)
    parts = [rows.filter(F.col("mes_origen") == m) for m in names]
    parts[names.index("2024/02")] = parts[names.index("2024/02")].drop("canal")  # a month whose extract lacks a column
    return me.consolidate(parts)


@query(
    "s08_machine_master",
    with_tables(
        "cj",
        rounded_sql(
            "SELECT codigo, CAST(round(latitud, 6) AS DOUBLE) AS latitud, municipio_dane AS municipio, departamento,"
            " cierre_nocturno, cajero_adyacente_oficina,"
            " CASE CAST(codigo AS INTEGER) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS vip FROM cj",
            "latitud",
        ),
    ),
)
def _(spark, sf):
    m = t.machines(spark, sf)
    number = F.col("codigo").cast("int")
    texts = {
        "codigo": F.col("codigo"),
        "longitud": F.col("longitud").cast("string"),
        "latitud": F.col("latitud").cast("string"),
        "municipio": F.col("municipio_dane"),
        "departamento": F.col("departamento"),
        "cierre_nocturno": F.when(F.col("cierre_nocturno"), " sí ").otherwise("No"),
        "cajero_adyacente_oficina": F.when(F.col("cajero_adyacente_oficina"), "S").otherwise("0"),
        "vip": F.when(number % 3 == 0, "TRUE").when(number % 3 == 1, "n").otherwise("quizás"),
    }
    path, target = work_dir(spark, "master"), work_dir(spark, "machines")
    export = m.select(*[texts.get(new, F.lit("x")).alias(old) for old, new in MACHINE_HEADINGS.items()])
    export.write.option("header", True).csv(path)
    rows = mc.replace_machines(spark, path, target)
    flags = ["cierre_nocturno", "cajero_adyacente_oficina", "vip"]
    out = rows.select("codigo", F.col("latitud").cast("double"), "municipio", "departamento", *flags)
    return rounded(out)


# -- loading the fact ----------------------------------------------------------------------------------------


def typed_extract(spark, sf):
    tx = t.transactions(spark, sf)
    return tx.select(*[F.col(new).alias(old) for old, new in TRANSACTION_HEADINGS.items()], "mes_origen")


FACT = "id_tlf, fecha_transaccion, cod_terminal, autorizador, tipo_operacion, valor_transaccion"


@query(
    "s09_p01_p03_fact_load",
    with_tables(
        "tx",
        f"SELECT {FACT}, time_bucket(INTERVAL '15 minutes', fecha_transaccion) AS fecha_transaccion_15min FROM tx"
        " WHERE fecha_transaccion >= TIMESTAMP '2024-01-11' AND tipo_operacion IN ('Avance', 'Retiro')"
        " AND autorizador IS NOT NULL AND autorizador <> ''",
    ),
)
def _(spark, sf):
    first = typed_extract(spark, sf).withColumn("archivo_origen", F.lit("a.csv"))
    again = first.withColumn("archivo_origen", F.lit("b.csv")).withColumn(
        "Valor Transacción", F.col("Valor Transacción") + 1
    )
    fact = fl.prepare_fact(again.unionByName(first), months=1, as_of=datetime(2024, 2, 10))
    return fact.select(*FACT.split(", "), "fecha_transaccion_15min")


@query(
    "p01_recent",
    with_tables(
        "tx",
        "SELECT id_tlf FROM tx WHERE fecha_transaccion >= (SELECT max(fecha_transaccion) FROM tx) - INTERVAL '30 days'",
    ),
)
def _(spark, sf):
    return fl.keep_recent(t.transactions(spark, sf), 1).select("id_tlf")


@query("p02_types", with_tables("tx", "SELECT id_tlf FROM tx WHERE tipo_operacion IN ('Avance', 'Retiro')"))
def _(spark, sf):
    return fl.keep_types(t.transactions(spark, sf)).select("id_tlf")


@query("p03_authoriser", with_tables("tx", "SELECT id_tlf FROM tx WHERE autorizador IS NOT NULL AND autorizador <> ''"))
def _(spark, sf):
    return fl.require_authoriser(t.transactions(spark, sf)).select("id_tlf")


@query(
    "s10_insert_if_absent",
    with_tables(
        "tx",
        """
        SELECT id_tlf, fecha_transaccion, valor_transaccion
               + CASE WHEN fecha_transaccion < TIMESTAMP '2024-01-16' THEN 0 ELSE 1 END AS valor_transaccion,
               (SELECT count(*) FROM tx WHERE fecha_transaccion >= TIMESTAMP '2024-01-16') AS insertados,
               (SELECT count(*) FROM tx WHERE fecha_transaccion < TIMESTAMP '2024-01-16') AS omitidos FROM tx""",
    ),
)
def _(spark, sf):
    target = work_dir(spark, "fact")
    tx = t.transactions(spark, sf)
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    fl.insert_if_absent(spark, tx.filter(F.col("fecha_transaccion") < half), target)
    counts = fl.insert_if_absent(spark, tx.withColumn("valor_transaccion", F.col("valor_transaccion") + 1), target)
    rows = tb.read_table(spark, target.rsplit("/", 1)[0], target.rsplit("/", 1)[1])
    return rows.select(
        "id_tlf",
        "fecha_transaccion",
        "valor_transaccion",
        *[F.lit(v).cast("bigint").alias(k) for k, v in counts.items()],
    )


@query("s10_insert_by_index", ORACLE["s10_insert_if_absent"])
def _(spark, sf):
    target = work_dir(spark, "fact")
    tx = t.transactions(spark, sf)
    half = F.lit("2024-01-16").cast("timestamp_ntz")
    fl.insert_if_absent(spark, tx.filter(F.col("fecha_transaccion") < half), target, by_index=True)
    counts = fl.insert_if_absent(spark, tx.withColumn("valor_transaccion", F.col("valor_transaccion") + 1), target, by_index=True)
    numbers = [F.lit(v).cast("bigint").alias(k) for k, v in counts.items()]
    return spark.read.parquet(target).select("id_tlf", "fecha_transaccion", "valor_transaccion", *numbers)


@query(
    "s12_read_table",
    with_tables("mv", "SELECT cod_terminal, bucket_15min, num_transacciones FROM mv WHERE num_transacciones > 1"),
)
def _(spark, sf):
    base = work_dir(spark, "tables")
    tb.replace_table(t.rollup(spark, sf), base, "mv_dispensacion_por_cajero_15min")
    rows = tb.read_table(
        spark, base, "mv_dispensacion_por_cajero_15min", ["cod_terminal", "bucket_15min", "num_transacciones"]
    )
    return rows.filter("num_transacciones > 1")


@query(
    "s14_alert_upsert",
    with_tables(
        "al",
        rounded_sql(
            "SELECT cod_cajero, fecha_hora, 'nuevo' AS severidad, score_anomalia + 1 AS score_anomalia,"
            " monto_dispensado + CASE WHEN score_anomalia >= 50 THEN 0 ELSE 1 END AS monto_dispensado FROM al"
            " WHERE score_anomalia >= 40"
            " UNION ALL SELECT cod_cajero, fecha_hora, severidad, score_anomalia, monto_dispensado FROM al"
            " WHERE score_anomalia BETWEEN 35 AND 40",
            "score_anomalia",
        ),
    ),
)
def _(spark, sf):
    target = work_dir(spark, "alerts")
    alerts = materialise(t.alerts(spark, sf), "alerts-in")
    score = F.col("score_anomalia")
    tb.upsert_alerts(spark, alerts.filter((score >= 50) | score.between(35, 40)), target)
    newer = alerts.filter(score >= 40).withColumns(
        {"severidad": F.lit("nuevo"), "score_anomalia": score + 1, "monto_dispensado": F.col("monto_dispensado") + 1}
    )
    tb.upsert_alerts(spark, newer, target)
    rows = spark.read.parquet(target)
    return rounded(rows.select("cod_cajero", "fecha_hora", "severidad", "score_anomalia", "monto_dispensado"))


SUMMARY_MERGE = ["dispensacion_promedio", "disp_promedio_lunes", "total_transacciones", "fecha_ultimo_registro"]
t.CTES["s1"] = (
    t.CTES["su"][0].replace("FROM disp", "FROM disp WHERE fecha_transaccion < TIMESTAMP '2024-01-16'"),
    ("disp",),
)


@query(
    "s15_summary_upsert",
    with_tables(
        "s1 su",
        rounded_sql(
            "SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero, su.dispensacion_promedio,"
            " CASE WHEN s1.cod_terminal IS NOT NULL THEN s1.disp_promedio_lunes ELSE su.disp_promedio_lunes END"
            " AS disp_promedio_lunes, su.total_transacciones, su.fecha_ultima_transaccion AS fecha_ultimo_registro"
            " FROM su LEFT JOIN s1 USING (cod_terminal)",
            "dispensacion_promedio disp_promedio_lunes",
        ),
    ),
)
def _(spark, sf):
    tx = t.transactions(spark, sf)

    def stored(rows):
        out = r.machine_summary(rows).withColumnRenamed("fecha_ultima_transaccion", "fecha_ultimo_registro")
        return out.select(F.col("cod_terminal").cast("string").alias("cod_cajero"), *SUMMARY_MERGE)

    first = stored(tx.filter(F.col("fecha_transaccion") < F.lit("2024-01-16").cast("timestamp_ntz")))
    return rounded(tb.merge_rows(first, stored(tx), ["cod_cajero"], tb.SUMMARY_UPDATES))


@query(
    "s16_append",
    with_tables("al", "SELECT severidad, 2 * count(*) AS cantidad FROM al GROUP BY severidad"),
)
def _(spark, sf):
    base = work_dir(spark, "alerts")
    alerts = materialise(t.alerts(spark, sf), "alerts-in")
    tb.append_table(alerts, base, "alertas")
    tb.append_table(alerts, base, "alertas")
    return tb.read_table(spark, base, "alertas").groupBy("severidad").agg(F.count(F.lit(1)).alias("cantidad"))


# -- 15-minute files -----------------------------------------------------------------------------------------


def write_quarter_files(spark, sf) -> str:
    """One file per six hours of events; some lines are cut short, have a lone last field or repeat a denomination."""
    d = t.dispensed(spark, sf)
    event = F.col("event_id")
    start = bucket("fecha_hora", "6 hours")
    name = F.date_format(start, "yyyyMMddHH").alias("archivo")
    whole = F.concat_ws(
        ",",
        F.lit("02"),
        "cod_cajero",
        "cod_admin_efectivo",
        F.col("monto_total").cast("bigint"),
        F.date_format("fecha_hora", "yyyyMMddHHmmss"),
        "billetes_20k",
        F.lit("20"),
        "billetes_50k",
        F.lit("50"),
        "billetes_100k",
        F.lit("100"),
    )
    line = (
        F.when(event % 37 == 0, F.concat_ws(",", F.lit("02"), "cod_cajero", "cod_admin_efectivo"))
        .when(event % 31 == 0, F.concat(whole, F.lit(",7")))
        .when(event % 29 == 0, F.concat(whole, F.lit(",3,50")))
        .otherwise(whole)
    )
    detail = d.select(name, event.alias("orden"), line.alias("value"))
    sent = F.date_format(F.max(start) + F.expr("INTERVAL '6' HOUR"), "yyyyMMddHHmmss")
    header = d.groupBy(name).agg(
        F.lit(-1).cast("bigint").alias("orden"),
        F.concat_ws(",", F.lit("01"), sent, F.count(F.lit(1))).alias("value"),
    )
    path = work_dir(spark, "quarter")
    lines = detail.unionByName(header).repartition("archivo").sortWithinPartitions("archivo", "orden")
    lines.select("archivo", "value").write.partitionBy("archivo").text(path)
    return path


t.CTES["qf"] = (
    """
    SELECT event_id, time_bucket(INTERVAL '6 hours', fecha_hora) + INTERVAL '6 hours' AS fecha_envio, cod_cajero, cod_admin_efectivo,
           CASE cod_admin_efectivo WHEN 2 THEN 'Dispensacion acumulada' WHEN 3 THEN 'Dispensacion antes de provision'
                ELSE 'Dispensacion despues de provision' END AS tipo_admin,
           monto_total, date_trunc('second', fecha_hora) AS fecha_hora, billetes_20k,
           CASE WHEN event_id % 29 = 0 AND event_id % 31 <> 0 THEN 3 ELSE billetes_50k END AS billetes_50k,
           billetes_100k
    FROM de WHERE cod_admin_efectivo IN (2, 3, 4) AND event_id % 37 <> 0""",
    ("de",),
)


@query(
    "s11_parse_file",
    with_tables(
        "qf",
        "SELECT * EXCLUDE (event_id), CAST(NULL AS INTEGER) AS billetes_10k, CAST(NULL AS INTEGER) AS billetes_5k,"
        " CAST(NULL AS INTEGER) AS billetes_2k, CAST(NULL AS INTEGER) AS billetes_1k FROM qf",
    ),
)
def _(spark, sf):
    parsed = qf.parse_lines(qf.read_lines(spark, write_quarter_files(spark, sf)))
    return parsed.select(
        "fecha_envio",
        "cod_cajero",
        "cod_admin_efectivo",
        "tipo_admin",
        "monto_total",
        "fecha_hora",
        *[f"billetes_{n}" for n in NOTES],
    )


@query(
    "a38_file_summary",
    with_tables(
        "de qf",
        """
        SELECT fecha_envio, registros_esperados, registros_esperados AS registros_leidos,
               coalesce(registros, 0) AS registros, coalesce(cajeros, 0) AS cajeros, monto_total
        FROM (SELECT time_bucket(INTERVAL '6 hours', fecha_hora) + INTERVAL '6 hours' AS fecha_envio,
                     count(*) AS registros_esperados FROM de GROUP BY 1)
        LEFT JOIN (SELECT fecha_envio, count(*) AS registros, count(DISTINCT cod_cajero) AS cajeros,
                          sum(monto_total) AS monto_total FROM qf GROUP BY 1) USING (fecha_envio)""",
    ),
)
def _(spark, sf):
    lines = qf.read_lines(spark, write_quarter_files(spark, sf))
    return qf.file_summary(lines, qf.parse_lines(lines)).drop("archivo_origen")


t.CTES["qt"] = (
    """
    SELECT fecha_envio, cod_cajero, sum(monto_total) AS m, arg_min(fecha_hora, event_id) AS fecha_hora
    FROM qf GROUP BY fecha_envio, cod_cajero""",
    ("qf",),
)


@query(
    "j11_machines_without_history",
    with_tables(
        "qt disp",
        "SELECT cod_cajero, fecha_hora, m AS monto_dispensado FROM qt WHERE cod_cajero NOT IN"
        " (SELECT CAST(cod_terminal AS VARCHAR) FROM disp WHERE fecha_transaccion < TIMESTAMP '2024-01-03')",
    ),
)
def _(spark, sf):
    totals = materialise(ru.file_totals(qf.parse_lines(qf.read_lines(spark, write_quarter_files(spark, sf)))), "totals")
    # The profile is as old as the third day, so machines that began later have none.
    early = t.transactions(spark, sf).filter(F.col("fecha_transaccion") < F.lit("2024-01-03").cast("timestamp_ntz"))
    profile = machine_profile(r.rollup_transactions(early), ("basic",))
    return anti_join(totals, profile, ["cod_cajero"]).drop("archivo_origen")


def profile_with_score(spark, sf):
    """Machine features with a stand-in for the model's raw score that SQL can repeat."""
    rows = s.machine_features(spark, sf)
    raw = -F.least(F.lit(1.0), F.col("max_z_score_historico") / 6)
    return materialise(rows.withColumn("score_modelo", raw), "scored-profile")


BLEND = "0.6::DOUBLE * si + 0.4::DOUBLE * least(s1 + s2 + s3 + s4 + s5, 1.0)"
t.CTES["qa"] = (
    f"""
    SELECT cod_cajero, fecha_hora, m, p, des, si, least(s1 + s2 + s3 + s4 + s5, 1.0) AS sr, {BLEND} AS sfin
    FROM ({s._rules_sql("SELECT cod_cajero, fecha_hora, m FROM qt")})
    JOIN (SELECT cod_cajero, 1 / (1 + exp(-least(1.0::DOUBLE, max_z_score_historico / 6))) AS si FROM pf)
    USING (cod_cajero) WHERE {BLEND} >= 0.45""",
    ("qt", "pf", "zo"),
)
ALERT_SQL = """
    SELECT cod_cajero, fecha_hora, CASE WHEN sfin >= 0.9 THEN 'Crítico' WHEN sfin >= 0.7 THEN 'Advertencia'
                                        WHEN sfin >= 0.5 THEN 'Sospechoso' ELSE 'Normal' END AS severidad,
           sfin AS score_anomalia, m AS monto_dispensado, p AS monto_esperado,
           CASE WHEN des > 0 THEN (m - p) / des ELSE 0 END AS desviacion_std, si AS score_isolation_forest,
           sr AS score_reglas FROM qa"""
ALERT_DOUBLES = "score_anomalia monto_esperado desviacion_std score_isolation_forest score_reglas"


def _with_scores(alerts):
    """Pull the two part scores back out of the JSON detail."""
    detail = F.from_json("razones", "score_isolation_forest double, score_reglas double")
    return alerts.withColumn("_d", detail).select(
        "cod_cajero",
        "fecha_hora",
        "severidad",
        "score_anomalia",
        "monto_dispensado",
        "monto_esperado",
        "desviacion_std",
        F.col("_d.score_isolation_forest").alias("score_isolation_forest"),
        F.col("_d.score_reglas").alias("score_reglas"),
    )


@query("m12_file_detection", with_tables("qa", rounded_sql(ALERT_SQL, ALERT_DOUBLES)))
def _(spark, sf):
    lines = qf.read_lines(spark, write_quarter_files(spark, sf))
    alerts, _ = fs.detect_in_files(lines, profile_with_score(spark, sf), min_score=0.45)
    return rounded(_with_scores(alerts))


# -- streams -------------------------------------------------------------------------------------------------


def event_stream(spark, sf):
    schema = t.load(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _register_streams() -> None:
    for key, minutes in (("15min", 15), ("30min", 30), ("1hora", 60)):
        policy = rst.POLICIES[key]

        @query(f"t01_stream_{key}", f._note_sql(minutes, policy.column))
        def _(spark, sf, policy=policy):
            target = work_dir(spark, "rollup")
            records = t.dispensed_of(event_stream(spark, sf)).drop("event_id")
            rst.maintain_rollup(
                spark, records, policy, target, work_dir(spark, "rollup-state"), once=True
            ).awaitTermination()
            return rounded(spark.read.parquet(target).drop("dia"))


_register_streams()

WIDTHS = {"15min": 15, "30min": 30, "1hora": 60}


def _closed_sql(key: str) -> str:
    """With an hour of lateness the hours before the last two are closed when the last record is in."""
    column, sql = rst.POLICIES[key].column, f._note_sql(WIDTHS[key], rst.POLICIES[key].column)
    return f"SELECT '{key}' AS ancho, {column} AS bucket, * EXCLUDE ({column}) FROM ({sql}) WHERE {column} < (SELECT time_bucket(INTERVAL '1 hour', max({column})) FROM ({sql})) - INTERVAL 2 HOUR"


@query("t01_chained_rollups", " UNION ALL BY NAME ".join(_closed_sql(key) for key in WIDTHS))
def _(spark, sf):
    targets = {key: work_dir(spark, f"rollup-{key}") for key in WIDTHS}
    records = t.dispensed_of(event_stream(spark, sf)).drop("event_id")
    rst.maintain_rollups(spark, records, targets, work_dir(spark, "chain-state"), "1 hour", once=True).awaitTermination()
    last = t.dispensed(spark, sf).agg((F.date_trunc("hour", F.max("fecha_hora")) - F.expr("INTERVAL 2 HOURS")).cast("timestamp_ntz").alias("ultima"))
    tables = [
        spark.read.parquet(path).drop("dia").withColumnRenamed(rst.POLICIES[key].column, "bucket").withColumn("ancho", F.lit(key))
        for key, path in targets.items()
    ]
    rows = tables[0].unionByName(tables[1]).unionByName(tables[2])
    return rounded(rows.join(F.broadcast(last), F.col("bucket") < F.col("ultima")).drop("ultima"))


DAY = "fecha_hora >= TIMESTAMP '2024-01-10' AND fecha_hora < TIMESTAMP '2024-01-13'"


@query(
    "t02_refresh_range",
    f"SELECT * FROM ({f._note_sql(15, 'bucket_15min')}) WHERE {DAY.replace('fecha_hora', 'bucket_15min')}",
)
def _(spark, sf):
    target, policy = work_dir(spark, "rollup"), rst.POLICIES["15min"]
    records = t.dispensed(spark, sf)
    early = records.filter(F.hour("fecha_hora") < 12)  # what was there before the late rows came
    for rows in (early, records):
        rst.refresh_range(spark, rows, policy, target, "2024-01-10", "2024-01-12 23:59:59")
    return rounded(spark.read.parquet(target).drop("dia"))


LATE_SQL = f"""
    SELECT r.*, coalesce(tardias, 0) AS tardias FROM ({f._note_sql(15, "bucket_15min")}) r LEFT JOIN (
        SELECT time_bucket(INTERVAL '15 minutes', fecha_hora) AS bucket_15min, cod_cajero, cod_admin_efectivo, count(*) AS tardias
        FROM de, (SELECT max(fecha_hora) - INTERVAL 1 HOUR AS marca FROM de WHERE event_id % 10 <> 0 AND fecha_hora < TIMESTAMP '2024-01-20')
        WHERE (event_id % 10 = 0 OR fecha_hora >= TIMESTAMP '2024-01-20') AND time_bucket(INTERVAL '15 minutes', fecha_hora) + INTERVAL 15 MINUTE <= marca
        GROUP BY ALL) USING (bucket_15min, cod_cajero, cod_admin_efectivo)"""


@query("t02_late_rows", with_tables("de", LATE_SQL))
def _(spark, sf):
    folder, target, late, state = (work_dir(spark, n) for n in ("arriving", "rollup", "late", "late-state"))
    records, policy = t.dispensed(spark, sf), rst.POLICIES["15min"]
    second = (F.col("event_id") % 10 == 0) | (F.col("fecha_hora") >= F.lit("2024-01-20").cast("timestamp_ntz"))
    for part in (~second, second):  # the query is stopped in between and goes on from its checkpoint
        records.filter(part).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(records.schema).parquet(folder)
        lt.maintain_with_late_rows(spark, stream, policy, target, late, state, once=True).awaitTermination()
    lt.refresh_late(spark, records, policy, target, late, state)
    keys = ["bucket_15min", "cod_cajero", "cod_admin_efectivo"]
    counts = spark.read.parquet(late).groupBy(bucket("fecha_hora").alias("bucket_15min"), *keys[1:]).agg(F.count(F.lit(1)).alias("tardias"))
    return rounded(lt.read_rollup(spark, target).join(counts, keys, "left").fillna(0, "tardias"))


@query(
    "t03_stream_detection",
    with_tables("qa", rounded_sql(f"SELECT * FROM ({ALERT_SQL}) WHERE score_anomalia >= 0.5", ALERT_DOUBLES)),
)
def _(spark, sf):
    folder, target = write_quarter_files(spark, sf), work_dir(spark, "alerts")
    fs.watch_files(
        spark, folder, profile_with_score(spark, sf), target, work_dir(spark, "files-state"), 5000, once=True
    ).awaitTermination()
    return rounded(_with_scores(spark.read.parquet(target)))


RECENT_SQL = """
    SELECT cod_cajero, fecha_hora, m AS monto_dispensado, r AS promedio_reciente,
           coalesce(CASE WHEN r > 0 AND abs((m - r) / r * 100) > 200 THEN 0.2::DOUBLE * least(abs((m - r) / r * 100) / 500, 1.0::DOUBLE) END, 0) AS regla_3
    FROM (SELECT *, list_avg(list_transform(list_filter(antes, lambda x: x.fecha_hora >= fecha_hora - INTERVAL 24 HOUR), lambda x: x.m)) AS r
          FROM (SELECT *, list({'fecha_hora': fecha_hora, 'm': m}) OVER (PARTITION BY cod_cajero ORDER BY fecha_hora ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS antes FROM qt))"""


def _with_rule_3(totals):
    """Score of the rule of drastic changes against the recent mean."""
    recent = F.col("promedio_reciente")
    rules = ru.business_rules(F.col("monto_dispensado"), F.hour("fecha_hora"), *[F.lit(None).cast("double")] * 5, recent=recent)
    part = F.aggregate(
        F.filter(rules["reglas"], lambda x: x["regla"] == "regla_3_cambio_drastico"), F.lit(0.0), lambda a, x: a + x["score_parcial"]
    )
    return rounded(totals.select("cod_cajero", "fecha_hora", "monto_dispensado", "promedio_reciente", part.alias("regla_3")))


@query("m11_recent_mean", with_tables("qt", rounded_sql(RECENT_SQL, "promedio_reciente regla_3")))
def _(spark, sf):
    lines = qf.read_lines(spark, write_quarter_files(spark, sf))
    return _with_rule_3(ru.with_recent_mean(ru.file_totals(qf.parse_lines(lines))))


@query("t03_recent_mean", with_tables("qt", rounded_sql(RECENT_SQL, "promedio_reciente regla_3")))
def _(spark, sf):
    folder, totals, target = write_quarter_files(spark, sf), work_dir(spark, "totals"), work_dir(spark, "recent")
    rm.watch_totals(spark, folder, totals, work_dir(spark, "totals-state"), 5000, once=True).awaitTermination()
    rm.maintain_recent_means(rm.totals_stream(spark, totals), target, work_dir(spark, "recent-state"), once=True).awaitTermination()
    return _with_rule_3(spark.read.parquet(target))


#: What the streams have told for certain when the last row is in: an hour of lateness, and the reach of the join.
SETTLED = "fecha_transaccion < (SELECT max(fecha_transaccion) FROM tx) - INTERVAL 4 HOUR"


def _settled(spark, sf, hits):
    target = work_dir(spark, "hits")
    lr.maintain_live_hits(hits, target, work_dir(spark, "hits-state"), once=True).awaitTermination()
    last = t.transactions(spark, sf).agg((F.max("fecha_transaccion") - F.expr("INTERVAL 4 HOURS")).alias("ultima"))
    rows = spark.read.schema(hits.schema).parquet(target)  # the schema: there may be no file
    return rows.join(F.broadcast(last), F.col("fecha_transaccion") < F.col("ultima")).drop("ultima", "dia")


def _hits_sql(rule: str, name: str, value: str) -> str:
    return f"SELECT '{rule}' AS regla, id_tlf, cod_terminal, fecha_transaccion, {value}::DOUBLE AS valor FROM ({ORACLE[name]}) WHERE {SETTLED}"


@query(
    "x01_x02_x05_live_rates",
    with_tables(
        "tx",
        _hits_sql("cambios_pin", "x01_frequent_pin_changes", "cambios_pin")
        + " UNION ALL " + _hits_sql("retiro_grande", "x02_large_withdrawals", "monto_periodo")
        + " UNION ALL " + _hits_sql("velocidad", "x05_high_rate", "transacciones_periodo"),
    ),
)
def _(spark, sf):
    arriving = t.transactions_of(event_stream(spark, sf))
    rules = [lr.RateRule("cambios_pin", "cambio", 1, 12 * 3600), lr.RateRule("retiro_grande", "retiro", 2_000_000, 6 * 3600), lr.RateRule("velocidad", "todas", 2, 3 * 3600)]
    return _settled(spark, sf, lr.live_rates(arriving, "1 hour", rules))


@query("x06_live_pin_withdrawals", with_tables("tx", _hits_sql("pin_y_retiro", "x06_withdrawal_after_pin_change", "segundos_desde_pin")))
def _(spark, sf):
    return _settled(spark, sf, lr.live_pin_withdrawals(t.transactions_of(event_stream(spark, sf)), "1 hour", 7200))


@query("t03_watch_files")
def _(spark, sf):
    profile, model = s.machine_model(spark, sf)
    scored = materialise(fs.score_machines(profile, model), "scored-profile")
    folder, target = write_quarter_files(spark, sf), work_dir(spark, "alerts")
    fs.watch_files(
        spark, folder, scored, target, work_dir(spark, "files-state"), files_per_trigger=5000, once=True
    ).awaitTermination()
    return spark.read.parquet(target).drop("fecha_deteccion", "lote")
