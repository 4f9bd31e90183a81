"""Queries of the roll-ups, the calendar, and the transaction, machine and bucket features."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from catalog import tables as t
from catalog.registry import query
from catalog.tables import NOTES, rounded, rounded_sql, with_tables
from tillwatch.functions import calendar
from tillwatch.operators import buckets as b
from tillwatch.operators import machine_profile as mp
from tillwatch.operators import partials as pt
from tillwatch.operators import rollup as r
from tillwatch.operators import transactions as tx
from tillwatch.operators.neighbours import with_coordinates, zone_features
from tillwatch.session import materialise, work_dir
from tillwatch.sources.tables import read_table, replace_table

AS_OF = datetime(2024, 1, 20)

# -- filters and calendar ------------------------------------------------------------------------------------


@query(
    "p04_dispensing",
    with_tables(
        "disp",
        "SELECT id_tlf, fecha_transaccion, fecha_transaccion_15min, cod_terminal, tipo_operacion, valor_transaccion,"
        " valor_transaccion_original, cod_estado_transaccion, adquiriente, autorizador, cantidad_tx, fecha_negocio,"
        " mes_origen FROM disp",
    ),
)
def _(spark, sf):
    return r.dispensing(t.transactions(spark, sf))


@query(
    "p05_tx_calendar",
    with_tables(
        "tx",
        "SELECT id_tlf, CAST(hour(fecha_transaccion) AS INTEGER) AS hora,"
        " CAST(isodow(fecha_transaccion) - 1 AS INTEGER) AS dia_semana,"
        " isodow(fecha_transaccion) >= 6 AS es_fin_de_semana,"
        " hour(fecha_transaccion) >= 22 OR hour(fecha_transaccion) <= 6 AS es_horario_nocturno,"
        " hour(fecha_transaccion) <= 6 AS es_madrugada FROM tx",
    ),
)
def _(spark, sf):
    columns = ["id_tlf", "hora", "dia_semana", "es_fin_de_semana", "es_horario_nocturno", "es_madrugada"]
    return tx.with_calendar(t.transactions(spark, sf)).select(*columns)


FLAGS_SQL = """
    SELECT id_tlf, valor_transaccion - valor_transaccion_original AS diferencia_valor,
           valor_transaccion >= 2000000 AND tipo_operacion IN ('Retiro', 'Avance') AS es_retiro_maximo,
           CASE tipo_operacion WHEN 'Cambio De Pin' THEN 1 WHEN 'Avance' THEN 2 WHEN 'Retiro' THEN 3
                WHEN 'Depositos' THEN 4 WHEN 'Transferencias' THEN 5 END AS tipo_operacion_encoded,
           cod_estado_transaccion = 1 AS transaccion_exitosa, cod_estado_transaccion = 2 AS transaccion_rechazada,
           tipo_operacion = 'Cambio De Pin' AS es_cambio_pin FROM tx"""


@query("p06_tx_flags", with_tables("tx", FLAGS_SQL))
def _(spark, sf):
    return tx.with_value_flags(t.transactions(spark, sf)).select(
        "id_tlf",
        "diferencia_valor",
        "es_retiro_maximo",
        "tipo_operacion_encoded",
        "transaccion_exitosa",
        "transaccion_rechazada",
        "es_cambio_pin",
    )


@query(
    "p07_bucket_calendar",
    with_tables(
        "zb",
        "SELECT bucket_15min, cod_terminal, hora_del_dia, dia_semana, mes, es_fin_de_semana, es_fin_de_mes,"
        " es_quincena FROM zb",
    ),
)
def _(spark, sf):
    return b.with_bucket_calendar(r.bucket_totals(t.rollup(spark, sf))).drop(
        "monto_total_dispensado", "num_transacciones"
    )


@query(
    "p08_part_of_day",
    with_tables(
        "disp",
        "SELECT CASE WHEN hour(fecha_transaccion) < 6 THEN 'madrugada' WHEN hour(fecha_transaccion) < 12 THEN 'manana'"
        " WHEN hour(fecha_transaccion) < 18 THEN 'tarde' ELSE 'noche' END AS franja, count(*) AS n,"
        " sum(valor_transaccion) AS monto FROM disp GROUP BY 1",
    ),
)
def _(spark, sf):
    return (
        r.dispensing(t.transactions(spark, sf))
        .groupBy(calendar.part_of_day("fecha_transaccion").alias("franja"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("valor_transaccion").alias("monto"))
    )


# -- roll-ups ------------------------------------------------------------------------------------------------


def _note_sql(minutes: int, name: str) -> str:
    sums = ", ".join(f"CAST(sum(billetes_{n}) AS BIGINT) AS total_billetes_{n}" for n in NOTES)
    total = " + ".join(f"billetes_{n}" for n in NOTES)
    body = f"""
        SELECT time_bucket(INTERVAL '{minutes} minutes', fecha_hora) AS {name}, cod_cajero, cod_admin_efectivo,
               count(*) AS num_registros, sum(monto_total) AS monto_total, avg(monto_total) AS monto_promedio,
               max(monto_total) AS monto_maximo, min(monto_total) AS monto_minimo,
               stddev_samp(monto_total) AS monto_std, {sums}, CAST(sum({total}) AS BIGINT) AS total_billetes
        FROM de GROUP BY ALL"""
    return with_tables("de", rounded_sql(body, "monto_promedio monto_std"))


def _register_note_rollups() -> None:
    for name, minutes, column in (
        ("a01_rollup_15min", 15, "bucket_15min"),
        ("a02_rollup_30min", 30, "bucket_30min"),
        ("a03_rollup_1h", 60, "bucket_1hora"),
        ("x09_rollup_45min", 45, "bucket_45min"),
    ):

        @query(name, _note_sql(minutes, column))
        def _(spark, sf, minutes=minutes, column=column):
            return rounded(r.rollup_notes(t.dispensed(spark, sf), f"{minutes} minutes", column))


_register_note_rollups()

MODE_SQL = """
    SELECT mv.*, dia_semana_mas_comun FROM mv JOIN (
        SELECT cod_terminal, fecha_transaccion_15min AS bucket_15min, tipo_operacion, d AS dia_semana_mas_comun
        FROM (SELECT cod_terminal, fecha_transaccion_15min, tipo_operacion,
                     CAST(dayofweek(fecha_transaccion) AS INTEGER) AS d, count(*) AS n
              FROM disp GROUP BY ALL)
        QUALIFY row_number() OVER (PARTITION BY cod_terminal, fecha_transaccion_15min, tipo_operacion
                                   ORDER BY n DESC, d) = 1)
    USING (cod_terminal, bucket_15min, tipo_operacion)"""


@query("a04_rollup_tx", with_tables("mv", rounded_sql(MODE_SQL, "monto_promedio monto_std hora_promedio")))
def _(spark, sf):
    return rounded(t.rollup(spark, sf))


def _summary_sql() -> str:
    hour, dow, v = "hour(fecha_transaccion)", "dayofweek(fecha_transaccion)", "valor_transaccion"
    parts = {"madrugada": (0, 5), "manana": (6, 11), "tarde": (12, 17), "noche": (18, 23)}
    by_part = ", ".join(
        f"avg({v}) FILTER ({hour} BETWEEN {a} AND {z}) AS disp_promedio_{n}" for n, (a, z) in parts.items()
    )
    by_day = ", ".join(f"avg({v}) FILTER ({dow} = {d}) AS disp_promedio_{n}" for n, d in r.WEEKDAY_COLUMNS.items())
    return f"""
        SELECT cod_terminal, count(*) AS total_transacciones, sum({v}) AS monto_total_dispensado,
               avg({v}) AS dispensacion_promedio, stddev_samp({v}) AS dispensacion_std, max({v}) AS dispensacion_max,
               min({v}) AS dispensacion_min, {by_part}, {by_day},
               count(*) FILTER (tipo_operacion = 'Retiro') / count(*) AS ratio_retiros,
               count(*) FILTER (tipo_operacion = 'Avance') / count(*) AS ratio_avances,
               min(fecha_transaccion) AS fecha_primera_transaccion, max(fecha_transaccion) AS fecha_ultima_transaccion
        FROM disp GROUP BY cod_terminal"""


SUMMARY_DOUBLES = " ".join(
    [
        "dispensacion_promedio dispensacion_std ratio_retiros ratio_avances",
        *[f"disp_promedio_{p}" for p in ("madrugada", "manana", "tarde", "noche")],
        *[f"disp_promedio_{d}" for d in r.WEEKDAY_COLUMNS],
    ]
)
t.CTES["su"] = (_summary_sql(), ("disp",))


@query("a05_machine_summary", with_tables("su", rounded_sql("SELECT * FROM su", SUMMARY_DOUBLES)))
def _(spark, sf):
    return rounded(r.machine_summary(t.transactions(spark, sf)))


PATTERN = (
    "avg(monto_total) AS dispensacion_promedio, stddev_samp(monto_total) AS dispensacion_std,"
    " max(monto_total) AS dispensacion_max, count(*) AS num_transacciones"
)


@query(
    "a06_machine_pattern_by_hour",
    with_tables(
        "de",
        rounded_sql(
            f"SELECT cod_cajero, CAST(hour(fecha_hora) AS INTEGER) AS hora, {PATTERN} FROM de"
            " WHERE cod_admin_efectivo IN (2, 3, 4) GROUP BY ALL",
            "dispensacion_promedio dispensacion_std",
        ),
    ),
)
def _(spark, sf):
    return rounded(r.machine_patterns(t.dispensed(spark, sf), by_hour=True))


@query(
    "a06_pattern_function",
    with_tables(
        "de",
        rounded_sql(
            f"SELECT {PATTERN}, 'todas' AS horas FROM de WHERE cod_admin_efectivo IN (2, 3, 4) AND cod_cajero = '7'"
            f" UNION ALL SELECT {PATTERN}, '10' FROM de WHERE cod_admin_efectivo IN (2, 3, 4) AND cod_cajero = '7'"
            " AND hour(fecha_hora) = 10",
            "dispensacion_promedio dispensacion_std",
        ),
    ),
)
def _(spark, sf):
    r.register_pattern_function(spark, t.dispensed(spark, sf))
    whole = spark.sql("SELECT *, 'todas' AS horas FROM get_patron_cajero('7')")
    return rounded(whole.unionByName(spark.sql("SELECT *, '10' AS horas FROM get_patron_cajero('7', 10)")))


@query(
    "a07_last_24h",
    with_tables(
        "de",
        rounded_sql(
            "SELECT cod_cajero, count(*) AS num_dispensaciones, sum(monto_total) AS monto_total_24h,"
            " avg(monto_total) AS monto_promedio_24h, max(monto_total) AS monto_maximo_24h,"
            " min(fecha_hora) AS primera_dispensacion, max(fecha_hora) AS ultima_dispensacion FROM de"
            " WHERE cod_admin_efectivo IN (2, 3, 4)"
            " AND fecha_hora >= (SELECT max(fecha_hora) FROM de) - INTERVAL '24 hours' GROUP BY cod_cajero",
            "monto_promedio_24h",
        ),
    ),
)
def _(spark, sf):
    return rounded(r.last_day_summary(t.dispensed(spark, sf)))


# -- machine profile -----------------------------------------------------------------------------------------

BASIC_SQL = """
    SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero, avg(m) AS dispensacion_promedio,
           stddev_samp(m) AS dispensacion_std, max(m) AS dispensacion_max, min(m) AS dispensacion_min,
           quantile_cont(m, 0.5) AS dispensacion_mediana,
           CASE WHEN avg(m) > 0 THEN stddev_samp(m) / avg(m) ELSE 0 END AS coef_variacion,
           count(*) AS num_periodos_15min, CAST(sum(num_transacciones) AS BIGINT) AS transacciones_totales,
           avg(num_transacciones) AS transacciones_promedio_15min,
           quantile_cont(m, 0.25) AS q25, quantile_cont(m, 0.75) AS q75,
           quantile_cont(m, 0.75) - quantile_cont(m, 0.25) AS iqr,
           min(bucket_15min) AS fecha_primer_dato, max(bucket_15min) AS fecha_ultimo_dato
    FROM (SELECT *, monto_total_dispensado AS m FROM mv) GROUP BY cod_terminal"""
BASIC_DOUBLES = (
    "dispensacion_promedio dispensacion_std dispensacion_mediana coef_variacion transacciones_promedio_15min q25 q75 iqr"
)

TIME_SQL = """
    SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero,
           coalesce(avg(m) FILTER (h < 6), 0) AS disp_madrugada,
           coalesce(avg(m) FILTER (h BETWEEN 6 AND 11), 0) AS disp_manana,
           coalesce(avg(m) FILTER (h BETWEEN 12 AND 17), 0) AS disp_tarde,
           coalesce(avg(m) FILTER (h >= 18), 0) AS disp_noche,
           any_value(hora_pico) AS hora_pico, any_value(mejor) AS dispensacion_hora_pico,
           coalesce(avg(m) FILTER (fds), 0) AS disp_fin_semana, coalesce(avg(m) FILTER (NOT fds), 0) AS disp_laboral,
           CASE WHEN coalesce(avg(m) FILTER (NOT fds), 0) > 0
                THEN coalesce(avg(m) FILTER (fds), 0) / avg(m) FILTER (NOT fds) ELSE 1 END AS ratio_fds_laboral,
           any_value(std_por_hora) AS std_por_hora
    FROM (SELECT *, monto_total_dispensado AS m, hour(bucket_15min) AS h, isodow(bucket_15min) >= 6 AS fds FROM mv)
    JOIN (SELECT cod_terminal, CAST(first(h ORDER BY media DESC, h) AS INTEGER) AS hora_pico, max(media) AS mejor,
                 avg(s) AS std_por_hora
          FROM (SELECT cod_terminal, hour(bucket_15min) AS h, avg(monto_total_dispensado) AS media,
                       stddev_samp(monto_total_dispensado) AS s FROM mv GROUP BY ALL)
          GROUP BY cod_terminal) USING (cod_terminal)
    GROUP BY cod_terminal"""
TIME_DOUBLES = (
    "disp_madrugada disp_manana disp_tarde disp_noche dispensacion_hora_pico disp_fin_semana disp_laboral"
    " ratio_fds_laboral std_por_hora"
)

WEEK = 18
TREND_SQL = f"""
    SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero,
           CASE WHEN count(*) > 5 THEN coalesce(regr_slope(m, i), 0) ELSE 0 END AS tendencia_slope,
           CASE WHEN count(*) > 5 THEN coalesce(power(covar_pop(m, i)
                / nullif(stddev_pop(m) * stddev_pop(i), 0), 2), 0) ELSE 0 END AS tendencia_r2,
           arg_max(vol, i) AS volatilidad_reciente, avg(vol) AS volatilidad_promedio,
           coalesce(CASE WHEN count(*) > {WEEK} AND avg(m) FILTER (i < n - {WEEK}) > 0
                THEN (avg(m) FILTER (i >= n - {WEEK}) - avg(m) FILTER (i < n - {WEEK}))
                     / avg(m) FILTER (i < n - {WEEK}) * 100 END, 0) AS cambio_reciente_pct
    FROM (SELECT cod_terminal, monto_total_dispensado AS m,
                 CAST(row_number() OVER w - 1 AS DOUBLE) AS i, count(*) OVER (PARTITION BY cod_terminal) AS n,
                 stddev_samp(monto_total_dispensado) OVER (PARTITION BY cod_terminal
                     ORDER BY bucket_15min, tipo_operacion ROWS BETWEEN {WEEK - 1} PRECEDING AND CURRENT ROW) AS vol
          FROM mv WINDOW w AS (PARTITION BY cod_terminal ORDER BY bucket_15min, tipo_operacion))
    GROUP BY cod_terminal"""
TREND_DOUBLES = "tendencia_slope tendencia_r2 volatilidad_reciente volatilidad_promedio cambio_reciente_pct"

HISTORY_SQL = """
    SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero, count(*) FILTER (z > 2) AS anomalias_2std,
           count(*) FILTER (z > 3) AS anomalias_3std, count(*) FILTER (z > 4) AS anomalias_4std,
           count(*) FILTER (z > 2) / count(*) * 100 AS pct_anomalias_2std,
           count(*) FILTER (z > 3) / count(*) * 100 AS pct_anomalias_3std,
           coalesce(max(z), 0) AS max_z_score_historico
    FROM (SELECT cod_terminal, CASE WHEN des > 0 THEN abs((monto_total_dispensado - media) / des) END AS z
          FROM mv JOIN base USING (cod_terminal)) GROUP BY cod_terminal"""
HISTORY_DOUBLES = "pct_anomalias_2std pct_anomalias_3std max_z_score_historico"

t.CTES["fb"] = (BASIC_SQL, ("mv",))
t.CTES["ft"] = (TIME_SQL, ("mv",))
t.CTES["fr"] = (TREND_SQL, ("mv",))
t.CTES["fh"] = (HISTORY_SQL, ("mv", "base"))
t.CTES["pf"] = (
    "SELECT * FROM fb JOIN ft USING (cod_cajero) JOIN fr USING (cod_cajero) JOIN fh USING (cod_cajero)",
    ("fb", "ft", "fr", "fh"),
)
EDGES = ("fecha_primer_dato", "fecha_ultimo_dato")


@query("a08_basic_statistics", with_tables("fb", rounded_sql("SELECT * FROM fb", BASIC_DOUBLES)))
def _(spark, sf):
    return rounded(mp.machine_profile(t.rollup(spark, sf), ("basic",)))


@query("a09_time_patterns", with_tables("ft", rounded_sql("SELECT * FROM ft", TIME_DOUBLES)))
def _(spark, sf):
    return rounded(mp.machine_profile(t.rollup(spark, sf), ("time",)).drop(*EDGES))


@query("a10_w09_trend", with_tables("fr", rounded_sql("SELECT * FROM fr", TREND_DOUBLES)))
def _(spark, sf):
    return rounded(mp.machine_profile(t.rollup(spark, sf), ("trend",), WEEK).drop("tendencia_pvalue", *EDGES))


# The tail of the t test as an integral of a power of the cosine, by Simpson's rule over 400 steps.
P_VALUE_SQL = """
    SELECT cod_cajero, CASE WHEN n <= 5 THEN 1
           ELSE greatest(0, 1 - 2 * exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt(pi())
                * asin(least(abs(r), 1)) / 1200 * sum(w * power(cos(asin(least(abs(r), 1)) * k / 400), n - 3))) END
           AS tendencia_pvalue
    FROM (SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero, CAST(count(*) AS DOUBLE) AS n,
                 coalesce(covar_pop(m, i) / nullif(stddev_pop(m) * stddev_pop(i), 0), 0) AS r
          FROM (SELECT cod_terminal, monto_total_dispensado AS m, CAST(row_number() OVER (PARTITION BY cod_terminal
                       ORDER BY bucket_15min, tipo_operacion) AS DOUBLE) AS i FROM mv) GROUP BY cod_terminal),
         (SELECT range AS k, CASE WHEN range IN (0, 400) THEN 1 WHEN range % 2 = 1 THEN 4 ELSE 2 END AS w
          FROM range(401))
    GROUP BY cod_cajero, n, r"""


@query("a10_trend_p_value", with_tables("mv", rounded_sql(P_VALUE_SQL, "tendencia_pvalue", 6)))
def _(spark, sf):
    profile = mp.machine_profile(t.rollup(spark, sf), ("trend",))
    return rounded(profile.select("cod_cajero", "tendencia_pvalue"), digits=6)


@query("a11_anomaly_history", with_tables("fh", rounded_sql("SELECT * FROM fh", HISTORY_DOUBLES)))
def _(spark, sf):
    return rounded(mp.machine_profile(t.rollup(spark, sf), ("history",)).drop(*EDGES))


PROFILE_DOUBLES = f"{BASIC_DOUBLES} {TIME_DOUBLES} {TREND_DOUBLES} {HISTORY_DOUBLES}"


@query("a12_machine_profile", with_tables("pf", rounded_sql("SELECT * FROM pf", PROFILE_DOUBLES)))
def _(spark, sf):
    return rounded(mp.machine_profile(t.rollup(spark, sf), week_rows=WEEK).drop("tendencia_pvalue"))


def _updated_states(rows, states, time):
    """States of all days, the last days added after the others: each day's state is of its own input only."""
    last = F.lit("2024-01-25").cast("timestamp_ntz")
    return states(rows.filter(F.col(time) < last)).unionByName(states(rows.filter(F.col(time) >= last)))


@query("a05_summary_from_states", with_tables("su", rounded_sql("SELECT * FROM su", SUMMARY_DOUBLES)))
def _(spark, sf):
    return rounded(pt.summary_of(_updated_states(t.transactions(spark, sf), pt.transaction_states, "fecha_transaccion")))


EXACT_BASIC = "dispensacion_promedio dispensacion_std coef_variacion transacciones_promedio_15min"


@query(
    "a12_profile_from_states",
    with_tables(
        "fb ft fr fh mv",
        rounded_sql(
            f"SELECT fb.* EXCLUDE (dispensacion_mediana, q25, q75, iqr), ft.* EXCLUDE (cod_cajero), tendencia_slope, tendencia_r2, tendencia_pvalue,"
            f" max_z_score_historico FROM fb JOIN ft USING (cod_cajero) JOIN fr USING (cod_cajero) JOIN fh USING (cod_cajero) JOIN ({P_VALUE_SQL}) USING (cod_cajero)",
            f"{EXACT_BASIC} {TIME_DOUBLES} tendencia_slope tendencia_r2 tendencia_pvalue max_z_score_historico",
        ),
    ),
)
def _(spark, sf):
    profile = pt.profile_of(_updated_states(t.rollup(spark, sf), pt.rollup_states, "bucket_15min"))
    return rounded(profile.drop(*pt.ESTIMATES), f"{EXACT_BASIC} {TIME_DOUBLES} tendencia_slope tendencia_r2 tendencia_pvalue max_z_score_historico")


RANKS = [0.05, 0.25, 0.5, 0.75, 0.95]


@query(
    "a08_quantile_sketches",
    with_tables(
        "mv",
        "SELECT cod_terminal, count(*) AS filas, [true, true, true, true, true] AS cerca FROM mv"
        " WHERE bucket_15min >= TIMESTAMP '2024-01-05' AND bucket_15min < TIMESTAMP '2024-01-26' GROUP BY cod_terminal",
    ),
)
def _(spark, sf):
    """Whether the true rank of each estimated quantile is within twice the error that sketches of this size promise."""
    rollup = materialise(t.rollup(spark, sf), "rollup")
    found = pt.quantiles_of(pt.rollup_states(rollup), RANKS, "2024-01-05", "2024-01-25")
    rows = rollup.filter(F.to_date("bucket_15min").between("2024-01-05", "2024-01-25")).join(found.drop("sketch"), "cod_terminal")
    ranked = rows.groupBy("cod_terminal").agg(
        F.count(F.lit(1)).alias("filas"),
        *[F.count_if(F.col(mp.AMOUNT) < F.col("valores")[i]).alias(f"_bajo{i}") for i in range(len(RANKS))],
        *[F.count_if(F.col(mp.AMOUNT) <= F.col("valores")[i]).alias(f"_hasta{i}") for i in range(len(RANKS))],
    )
    error = 2 * 1.65 / pt.SKETCH
    near = [(F.col(f"_bajo{i}") / F.col("filas") - error <= s) & (F.col(f"_hasta{i}") / F.col("filas") + error >= s) for i, s in enumerate(RANKS)]
    return ranked.select("cod_terminal", "filas", F.array(*near).alias("cerca"))


@query(
    "a08_statistics_of_totals",
    with_tables(
        "bk",
        rounded_sql(BASIC_SQL.replace("FROM mv)", "FROM bk)"), BASIC_DOUBLES),
    ),
)
def _(spark, sf):
    return rounded(mp.machine_profile(r.bucket_totals(t.rollup(spark, sf)), ("basic",)))


@query(
    "w13_row_index",
    with_tables(
        "mv",
        "SELECT cod_terminal, bucket_15min, tipo_operacion, CAST(row_number() OVER (PARTITION BY cod_terminal"
        " ORDER BY bucket_15min, tipo_operacion) - 1 AS DOUBLE) AS periodo FROM mv",
    ),
)
def _(spark, sf):
    rows = mp._trend_columns(t.rollup(spark, sf), WEEK)
    return rows.select("cod_terminal", "bucket_15min", "tipo_operacion", F.col("_periodo").alias("periodo"))


HAVERSINE_SQL = (
    "2 * 6371 * asin(sqrt(least(greatest(power(sin(radians(b.latitud - a.latitud) / 2), 2)"
    " + cos(radians(a.latitud)) * cos(radians(b.latitud)) * power(sin(radians(b.longitud - a.longitud) / 2), 2),"
    " 0), 1)))"
)
t.CTES["zo"] = (
    f"""
    SELECT lo.*, CAST(coalesce(n, 0) AS INTEGER) AS cajeros_cercanos_1km,
           coalesce(zona, dispensacion_promedio) AS dispensacion_promedio_zona,
           CASE WHEN coalesce(zona, dispensacion_promedio) > 0
                THEN dispensacion_promedio / coalesce(zona, dispensacion_promedio) ELSE 1 END AS ratio_vs_zona
    FROM lo LEFT JOIN (
        SELECT a.cod_cajero, count(*) AS n, avg(b.dispensacion_promedio) AS zona
        FROM lo a JOIN lo b ON {HAVERSINE_SQL} <= 1 AND {HAVERSINE_SQL} > 0.001
        GROUP BY a.cod_cajero) USING (cod_cajero)""",
    ("lo",),
)
t.CTES["lo"] = (
    """
    SELECT cod_cajero, dispensacion_promedio, latitud, longitud, municipio_dane, departamento
    FROM fb LEFT JOIN cj ON cod_cajero = codigo AND latitud IS NOT NULL AND longitud IS NOT NULL""",
    ("fb", "cj"),
)


@query(
    "j09_neighbours",
    with_tables(
        "zo",
        rounded_sql(
            "SELECT * FROM zo", "dispensacion_promedio latitud longitud dispensacion_promedio_zona ratio_vs_zona"
        ),
    ),
)
def _(spark, sf):
    profile = t.baseline(spark, sf).select("cod_cajero", "dispensacion_promedio")
    return rounded(zone_features(profile, t.machines(spark, sf)))


@query(
    "p15_located_machines",
    with_tables(
        "cj",
        rounded_sql(
            "SELECT codigo, latitud, longitud FROM cj WHERE latitud IS NOT NULL AND longitud IS NOT NULL",
            "latitud longitud",
        ),
    ),
)
def _(spark, sf):
    return rounded(with_coordinates(t.machines(spark, sf)).select("codigo", "latitud", "longitud"))


# -- transaction features ------------------------------------------------------------------------------------

t.CTES["gp"] = (
    """
    SELECT id_tlf, epoch_us(fecha_transaccion) - lag(epoch_us(fecha_transaccion)) OVER (
               PARTITION BY cod_terminal ORDER BY fecha_transaccion, id_tlf) AS us FROM tx""",
    ("tx",),
)
t.CTES["ms"] = (
    """
    SELECT cod_terminal, count(*) AS tx_total_cajero, avg(valor_transaccion) AS monto_promedio_cajero,
           stddev_samp(valor_transaccion) AS monto_std_cajero,
           avg(CASE WHEN cod_estado_transaccion = 2 THEN 1.0::DOUBLE ELSE 0 END) AS tasa_rechazo_cajero,
           avg(us / 1000000) AS velocidad_promedio_cajero
    FROM tx JOIN gp USING (id_tlf) GROUP BY cod_terminal""",
    ("tx", "gp"),
)
MS_DOUBLES = "monto_promedio_cajero monto_std_cajero tasa_rechazo_cajero velocidad_promedio_cajero"


@query(
    "w11_gap",
    with_tables(
        "gp",
        "SELECT id_tlf, us / 1000000 AS tiempo_desde_anterior_seg,"
        " coalesce(us < 10000000, false) AS es_transaccion_rapida FROM gp",
    ),
)
def _(spark, sf):
    return tx.with_gap(t.transactions(spark, sf)).select(
        "id_tlf", "tiempo_desde_anterior_seg", "es_transaccion_rapida"
    )


@query("a13_machine_statistics", with_tables("ms", rounded_sql("SELECT * FROM ms", MS_DOUBLES)))
def _(spark, sf):
    return rounded(tx.machine_statistics(t.transactions(spark, sf)))


@query(
    "j02_tx_with_statistics",
    with_tables(
        "ms",
        rounded_sql(
            "SELECT id_tlf, tx_total_cajero, monto_promedio_cajero, tasa_rechazo_cajero,"
            " (valor_transaccion - monto_promedio_cajero) / (monto_std_cajero + 1) AS desviacion_monto_cajero,"
            " tx_total_cajero / 720 AS tx_por_hora_cajero FROM tx JOIN ms USING (cod_terminal)",
            "monto_promedio_cajero tasa_rechazo_cajero desviacion_monto_cajero tx_por_hora_cajero",
        ),
    ),
)
def _(spark, sf):
    return rounded(
        tx.with_machine_statistics(t.transactions(spark, sf)).select(
            "id_tlf",
            "tx_total_cajero",
            "monto_promedio_cajero",
            "tasa_rechazo_cajero",
            "desviacion_monto_cajero",
            "tx_por_hora_cajero",
        )
    )


MASTER = "cj.codigo = CAST(cod_terminal AS VARCHAR) AND latitud IS NOT NULL"


@query(
    "j03_tx_with_machine_flags",
    with_tables(
        "tx cj",
        "SELECT id_tlf, coalesce(CAST(cajero_adyacente_oficina AS INTEGER), 0) AS cajero_adyacente_encoded,"
        f" coalesce(CAST(cj.cierre_nocturno AS INTEGER), 0) AS cierre_nocturno_encoded FROM tx LEFT JOIN cj ON {MASTER}",
    ),
)
def _(spark, sf):
    master = with_coordinates(t.machines(spark, sf))  # machines that are not located count as unknown
    return tx.with_machine_flags(t.transactions(spark, sf), master).select(
        "id_tlf", "cajero_adyacente_encoded", "cierre_nocturno_encoded"
    )


t.CTES["tf"] = (
    f"""
    SELECT id_tlf AS id_transaccion, CAST(hour(fecha_transaccion) AS INTEGER) AS hora,
           CAST(isodow(fecha_transaccion) - 1 AS INTEGER) AS dia_semana,
           isodow(fecha_transaccion) >= 6 AS es_fin_de_semana,
           hour(fecha_transaccion) >= 22 OR hour(fecha_transaccion) <= 6 AS es_horario_nocturno,
           hour(fecha_transaccion) <= 6 AS es_madrugada,
           diferencia_valor, es_retiro_maximo, us / 1000000 AS tiempo_desde_anterior_seg,
           coalesce(us < 10000000, false) AS es_transaccion_rapida, es_cambio_pin,
           coalesce(tipo_operacion_encoded, 0) AS tipo_operacion_encoded, transaccion_exitosa, transaccion_rechazada,
           tx_total_cajero / 720 AS tx_por_hora_cajero, monto_promedio_cajero, tasa_rechazo_cajero,
           (valor_transaccion - monto_promedio_cajero) / (monto_std_cajero + 1) AS desviacion_monto_cajero,
           velocidad_promedio_cajero,
           coalesce(CAST(cajero_adyacente_oficina AS INTEGER), 0) AS cajero_adyacente_encoded,
           coalesce(CAST(cierre_nocturno AS INTEGER), 0) AS cierre_nocturno_encoded
    FROM tx JOIN ({FLAGS_SQL}) USING (id_tlf) JOIN gp USING (id_tlf) JOIN ms USING (cod_terminal)
    LEFT JOIN cj ON codigo = CAST(cod_terminal AS VARCHAR)""",
    ("tx", "gp", "ms", "cj"),
)
TF_DOUBLES = (
    "tx_por_hora_cajero monto_promedio_cajero tasa_rechazo_cajero desviacion_monto_cajero velocidad_promedio_cajero"
)


@query("s13_transaction_features", with_tables("tf", rounded_sql("SELECT * FROM tf", TF_DOUBLES)))
def _(spark, sf):
    base = work_dir(spark, "tables")
    for _ in range(2):  # the second run replaces the first
        replace_table(tx.transaction_features(t.transactions(spark, sf), t.machines(spark, sf)), base, "features")
    return rounded(read_table(spark, base, "features"), TF_DOUBLES)


# -- bucket features -----------------------------------------------------------------------------------------

DAY, HOUR, WEEKDAY = 4, 8, 4


@query(
    "w14_j01_z_machine",
    with_tables(
        "zb", rounded_sql("SELECT bucket_15min, cod_terminal, z_score_vs_cajero FROM zb", "z_score_vs_cajero", 6)
    ),
)
def _(spark, sf):
    rows = b.with_machine_z(r.bucket_totals(t.rollup(spark, sf)), t.baseline(spark, sf))
    return rounded(rows.select("bucket_15min", "cod_terminal", "z_score_vs_cajero"), digits=6)


def _change(rows: int) -> str:
    lag = f"lag(monto_total_dispensado, {rows}) OVER (PARTITION BY cod_terminal ORDER BY bucket_15min)"
    return f"CASE WHEN {lag} > 0 THEN (monto_total_dispensado - {lag}) / {lag} * 100 ELSE 0 END"


def _z(partition: str, frame: str) -> str:
    over = f"OVER (PARTITION BY cod_terminal, {partition} {frame})"
    x = "monto_total_dispensado"
    return f"CASE WHEN stddev_samp({x}) {over} > 0 THEN ({x} - avg({x}) {over}) / stddev_samp({x}) {over} ELSE 0 END"


def _trailing(rows: int) -> str:
    return f"ORDER BY bucket_15min ROWS BETWEEN {rows} PRECEDING AND 1 PRECEDING"


def _slope(rows: int, least: int) -> str:
    over = (
        "OVER (PARTITION BY cod_terminal ORDER BY bucket_15min"
        f" ROWS BETWEEN {rows} PRECEDING AND CURRENT ROW)"
    )
    return (
        f"CASE WHEN count(*) {over} >= {max(least, 2)} THEN regr_slope(monto_total_dispensado, segundos) {over} END"
    )


VOLATILITY = (
    "stddev_samp(monto_total_dispensado) OVER (PARTITION BY cod_terminal ORDER BY bucket_15min"
    f" ROWS BETWEEN {DAY} PRECEDING AND 1 PRECEDING)"
)
t.CTES["zs"] = (
    "SELECT *, epoch(bucket_15min) - epoch(min(bucket_15min) OVER (PARTITION BY cod_terminal)) AS segundos FROM zb",
    ("zb",),
)
KEYS = "bucket_15min, cod_terminal"


@query(
    "w01_change_previous",
    with_tables("bk", rounded_sql(f"SELECT {KEYS}, {_change(1)} AS cambio_vs_anterior FROM bk", "cambio_vs_anterior")),
)
def _(spark, sf):
    rows = b.with_changes(r.bucket_totals(t.rollup(spark, sf)))
    return rounded(rows.select("bucket_15min", "cod_terminal", "cambio_vs_anterior"))


@query(
    "w02_change_day",
    with_tables("bk", rounded_sql(f"SELECT {KEYS}, {_change(DAY)} AS cambio_vs_ayer FROM bk", "cambio_vs_ayer")),
)
def _(spark, sf):
    rows = b.with_changes(r.bucket_totals(t.rollup(spark, sf)), DAY)
    return rounded(rows.select("bucket_15min", "cod_terminal", "cambio_vs_ayer"))


@query(
    "w02_change_by_clock",
    with_tables(
        "bk",
        rounded_sql(
            "SELECT b.bucket_15min, b.cod_terminal, CASE WHEN a.monto_total_dispensado > 0 THEN"
            " (b.monto_total_dispensado - a.monto_total_dispensado) / a.monto_total_dispensado * 100 ELSE 0 END"
            " AS cambio_vs_ayer FROM bk b LEFT JOIN bk a ON a.cod_terminal = b.cod_terminal"
            " AND a.bucket_15min = b.bucket_15min - INTERVAL '24 hours'",
            "cambio_vs_ayer",
        ),
    ),
)
def _(spark, sf):
    rows = b.with_changes(r.bucket_totals(t.rollup(spark, sf)), by_clock=True)
    return rounded(rows.select("bucket_15min", "cod_terminal", "cambio_vs_ayer"))


@query(
    "w03_w04_z_trailing",
    with_tables(
        "zb",
        rounded_sql(
            f"SELECT {KEYS}, {_z('hora_del_dia', _trailing(HOUR))} AS z_score_vs_hora,"
            f" {_z('dia_semana', _trailing(WEEKDAY))} AS z_score_vs_dia_semana FROM zb",
            "z_score_vs_hora z_score_vs_dia_semana",
        ),
    ),
)
def _(spark, sf):
    rows = b.with_bucket_calendar(r.bucket_totals(t.rollup(spark, sf)))
    rows = b.with_group_z(rows, "trailing", HOUR, WEEKDAY)
    return rounded(rows.select("bucket_15min", "cod_terminal", "z_score_vs_hora", "z_score_vs_dia_semana"))


@query(
    "w05_j05_z_history",
    with_tables(
        "zb",
        rounded_sql(
            f"SELECT {KEYS}, {_z('hora_del_dia', '')} AS z_score_vs_hora,"
            f" {_z('dia_semana', '')} AS z_score_vs_dia_semana FROM zb",
            "z_score_vs_hora z_score_vs_dia_semana",
        ),
    ),
)
def _(spark, sf):
    rows = b.with_group_z(b.with_bucket_calendar(r.bucket_totals(t.rollup(spark, sf))), "history")
    return rounded(rows.select("bucket_15min", "cod_terminal", "z_score_vs_hora", "z_score_vs_dia_semana"))


@query(
    "w06_w07_volatility_trend",
    with_tables(
        "zs",
        rounded_sql(
            f"SELECT {KEYS}, {VOLATILITY} AS volatilidad_reciente, {_slope(DAY, 2)} AS tendencia_24h FROM zs",
            "volatilidad_reciente tendencia_24h",
        ),
    ),
)
def _(spark, sf):
    rows = b.with_trend(r.bucket_totals(t.rollup(spark, sf)), DAY)
    return rounded(rows.select("bucket_15min", "cod_terminal", "volatilidad_reciente", "tendencia_24h"))


LONG = 17
LONG_OVER = f"OVER (PARTITION BY cod_terminal ORDER BY bucket_15min ROWS BETWEEN {LONG} PRECEDING AND 1 PRECEDING)"


@query(
    "w06_w07_long_frames",
    with_tables(
        "zs",
        rounded_sql(
            rounded_sql(
                f"SELECT {KEYS}, stddev_samp(monto_total_dispensado) {LONG_OVER} AS volatilidad_reciente,"
                f" {_slope(LONG, 2)} AS tendencia_24h FROM zs",
                "volatilidad_reciente",
                2,
            ),
            "tendencia_24h",
        ),
    ),
)
def _(spark, sf):
    rows = b.with_trend(r.bucket_totals(t.rollup(spark, sf)), LONG)
    rows = rows.select("bucket_15min", "cod_terminal", "volatilidad_reciente", "tendencia_24h")
    return rounded(rounded(rows, "volatilidad_reciente", 2), "tendencia_24h")


def _since(interval: str, upto: str = "INTERVAL 1 MICROSECOND PRECEDING") -> str:
    return f"ORDER BY bucket_15min RANGE BETWEEN INTERVAL {interval} PRECEDING AND {upto}"


@query(
    "w03_w04_clock_z",
    with_tables(
        "zb",
        rounded_sql(
            f"SELECT {KEYS}, {_z('hora_del_dia', _since('10 DAY'))} AS z_score_vs_hora,"
            f" {_z('dia_semana', _since('10 DAY'))} AS z_score_vs_dia_semana FROM zb",
            "z_score_vs_hora z_score_vs_dia_semana",
        ),
    ),
)
def _(spark, sf):
    rows = b.with_clock_z(b.with_bucket_calendar(r.bucket_totals(t.rollup(spark, sf))), days=10)
    return rounded(rows.select("bucket_15min", "cod_terminal", "z_score_vs_hora", "z_score_vs_dia_semana"))


CLOCK_DAY = f"OVER (PARTITION BY cod_terminal {_since('24 HOUR')})"
CLOCK_UPTO = f"OVER (PARTITION BY cod_terminal {_since('24 HOUR', 'CURRENT ROW')})"


@query(
    "w06_w07_clock_trend",
    with_tables(
        "zs",
        rounded_sql(
            f"SELECT {KEYS}, stddev_samp(monto_total_dispensado) {CLOCK_DAY} AS volatilidad_reciente,"
            f" CASE WHEN count(*) {CLOCK_UPTO} >= 2 THEN regr_slope(monto_total_dispensado, segundos) {CLOCK_UPTO} END AS tendencia_24h FROM zs",
            "volatilidad_reciente tendencia_24h",
        ),
    ),
)
def _(spark, sf):
    rows = b.with_clock_trend(r.bucket_totals(t.rollup(spark, sf)))
    return rounded(rows.select("bucket_15min", "cod_terminal", "volatilidad_reciente", "tendencia_24h"))


@query(
    "w09_clock_volatility",
    with_tables(
        "bk",
        rounded_sql(
            "SELECT cod_terminal, arg_max(vol, bucket_15min) AS volatilidad_reciente, avg(vol) AS volatilidad_promedio"
            f" FROM (SELECT *, stddev_samp(monto_total_dispensado) OVER (PARTITION BY cod_terminal {_since('7 DAY', 'CURRENT ROW')}) AS vol FROM bk)"
            " GROUP BY cod_terminal",
            "volatilidad_reciente volatilidad_promedio",
            3,
        ),
    ),
)
def _(spark, sf):
    return rounded(b.clock_volatility(r.bucket_totals(t.rollup(spark, sf))), digits=3)


MONTH_RANK = "percent_rank() OVER (PARTITION BY cod_terminal, mes ORDER BY monto_total_dispensado) * 100"


@query(
    "w08_month_percentile",
    with_tables("zb", rounded_sql(f"SELECT {KEYS}, {MONTH_RANK} AS percentil_vs_mes FROM zb", "percentil_vs_mes")),
)
def _(spark, sf):
    rows = b.with_month_percentile(b.with_bucket_calendar(r.bucket_totals(t.rollup(spark, sf))))
    return rounded(rows.select("bucket_15min", "cod_terminal", "percentil_vs_mes"))


def _features_sql(baseline: str) -> str:
    trailing = baseline == "trailing"
    return f"""
        SELECT * EXCLUDE (segundos), {_change(1)} AS cambio_vs_anterior, {_change(DAY)} AS cambio_vs_ayer,
               {VOLATILITY} AS volatilidad_reciente, {_slope(DAY if trailing else 12, 2 if trailing else 10)} AS
               tendencia_24h, {_z('hora_del_dia', _trailing(HOUR) if trailing else '')} AS z_score_vs_hora,
               {_z('dia_semana', _trailing(WEEKDAY) if trailing else '')} AS z_score_vs_dia_semana,
               {MONTH_RANK} AS percentil_vs_mes FROM zs"""


BF_DOUBLES = (
    "z_score_vs_cajero cambio_vs_anterior cambio_vs_ayer volatilidad_reciente tendencia_24h z_score_vs_hora"
    " z_score_vs_dia_semana percentil_vs_mes"
)
t.CTES["bf"] = (_features_sql("trailing"), ("zs",))


@query("w_bucket_features", with_tables("bf", rounded_sql("SELECT * FROM bf", BF_DOUBLES)))
def _(spark, sf):
    return rounded(bucket_features(spark, sf))


def bucket_features(spark, sf):
    """Bucket features with frames short enough for the density of the test data."""
    return b.bucket_features(
        r.bucket_totals(t.rollup(spark, sf), with_baseline=True),
        day_rows=DAY,
        hour_rows=HOUR,
        weekday_rows=WEEKDAY,
    )


@query(
    "w_bucket_features_history",
    with_tables(
        "zs",
        rounded_sql(
            f"SELECT {KEYS}, {_z('hora_del_dia', '')} AS z_score_vs_hora, {_slope(12, 10)} AS tendencia_24h FROM zs",
            "z_score_vs_hora tendencia_24h",
        ),
    ),
)
def _(spark, sf):
    rows = b.bucket_features(
        r.bucket_totals(t.rollup(spark, sf)), t.baseline(spark, sf), baseline="history", day_rows=12
    )
    return rounded(rows.select("bucket_15min", "cod_terminal", "z_score_vs_hora", "tendencia_24h"))
