"""Queries of the reports, lists and data checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import features as f
from catalog import tables as t
from catalog.registry import query
from catalog.tables import rounded, rounded_sql, with_tables
from tillwatch.operators import machine_profile as mp
from tillwatch.operators import rollup as r
from tillwatch.operators.behaviour import blended_scores
from tillwatch.operators.isolation_forest import training_summary
from tillwatch.plans import reports as rp

START, END, BEFORE = "2024-01-10 00:00:00", "2024-01-25 23:59:59", "2024-01-01 00:00:00"
RANGE = f"fecha_hora >= TIMESTAMP '{START}' AND fecha_hora <= TIMESTAMP '{END}'"
LAST_30 = "fecha_hora >= (SELECT max(fecha_hora) FROM al) - INTERVAL '{days} days'"

t.CTES["pl"] = ("SELECT codigo AS cod_cajero, latitud, longitud, municipio_dane, departamento FROM cj", ("cj",))


def places(spark, sf):
    return t.machines(spark, sf).withColumnRenamed("codigo", "cod_cajero")


def located_profile(spark, sf):
    """Basic statistics per machine with its place, as the stored machine features have them."""
    return t.baseline(spark, sf).join(places(spark, sf), "cod_cajero", "left")


def full_profile(spark, sf):
    return mp.machine_profile(t.rollup(spark, sf), ("basic", "history"))


# -- lists ---------------------------------------------------------------------------------------------------

LIST = (
    "cod_cajero, fecha_hora, tipo_anomalia, severidad, score_anomalia, monto_dispensado, monto_esperado,"
    " desviacion_std, 'Alerta ' || severidad AS descripcion, razones, modelo_usado, fecha_deteccion"
)
AL_DOUBLES = "score_anomalia monto_esperado desviacion_std"


@query(
    "p09_alert_list",
    with_tables(
        "al",
        rounded_sql(
            f"SELECT {LIST} FROM al WHERE CAST(fecha_hora AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-25'"
            " AND severidad = 'alto' ORDER BY fecha_deteccion DESC, score_anomalia DESC, fecha_hora DESC, cod_cajero"
            " LIMIT 1000",
            AL_DOUBLES,
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.alert_list(t.alerts(spark, sf), "2024-01-10", "2024-01-25", "alto"))


@query(
    "p09_scored_transactions",
    with_tables(
        "sc tx cj",
        rounded_sql(
            "SELECT id_transaccion, fecha_transaccion, cod_terminal, tipo_operacion, valor_transaccion, score_final,"
            " nivel_anomalia, municipio_dane AS municipio, departamento, latitud, longitud"
            " FROM sc JOIN tx ON id_transaccion = id_tlf LEFT JOIN cj ON codigo = CAST(cod_terminal AS VARCHAR)"
            f" WHERE fecha_transaccion >= TIMESTAMP '{START}' AND fecha_transaccion < TIMESTAMP '{END}'"
            " AND nivel_anomalia = 'Advertencia' ORDER BY score_final DESC, id_transaccion LIMIT 10000",
            "score_final latitud longitud",
            8,
        ),
    ),
)
def _(spark, sf):
    rows = rp.scored_transactions(
        t.scores(spark, sf), t.transactions(spark, sf), t.machines(spark, sf), START, END, "Advertencia"
    )
    return rounded(rows, digits=8)


@query(
    "p10_search_machine",
    with_tables("al", "SELECT cod_cajero, fecha_hora, severidad FROM al WHERE contains(lower(cod_cajero), '12')"),
)
def _(spark, sf):
    return rp.search_machine(t.alerts(spark, sf), "12").select("cod_cajero", "fecha_hora", "severidad")


CARD_SQL = """
    SELECT cod_cajero, dispensacion_promedio, dispensacion_std, dispensacion_max, coef_variacion, pct_anomalias_3std,
           latitud, longitud, municipio_dane, departamento, num_periodos_15min, transacciones_totales
    FROM fb JOIN fh USING (cod_cajero) LEFT JOIN pl USING (cod_cajero) WHERE cod_cajero = '7'"""


@query(
    "p13_machine_card",
    with_tables(
        "fb fh pl",
        rounded_sql(
            CARD_SQL, "dispensacion_promedio dispensacion_std coef_variacion pct_anomalias_3std latitud longitud"
        ),
    ),
)
def _(spark, sf):
    profile = full_profile(spark, sf).join(places(spark, sf), "cod_cajero", "left")
    return rounded(rp.machine_card(profile, "7"))


@query(
    "p13_machine_alerts",
    with_tables(
        "al",
        rounded_sql(
            "SELECT fecha_hora, severidad, score_anomalia, monto_dispensado, monto_esperado, desviacion_std,"
            " 'Alerta ' || severidad AS descripcion, razones, tipo_anomalia FROM al WHERE cod_cajero = '7'"
            " ORDER BY fecha_hora DESC LIMIT 100",
            AL_DOUBLES,
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.machine_alerts(t.alerts(spark, sf), "7"))


@query(
    "p15_machine_locations",
    with_tables(
        "cj",
        rounded_sql(
            "SELECT codigo, latitud, longitud, municipio_dane AS municipio, departamento FROM cj"
            " WHERE latitud IS NOT NULL",
            "latitud longitud",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.machine_locations(t.machines(spark, sf)))


@query(
    "l01_latest_alerts",
    with_tables(
        "al",
        rounded_sql(
            "SELECT cod_cajero, fecha_hora, severidad, score_anomalia, monto_dispensado, monto_esperado,"
            " 'Alerta ' || severidad AS descripcion, razones FROM al"
            " ORDER BY fecha_hora DESC, score_anomalia DESC, cod_cajero LIMIT 100",
            "score_anomalia monto_esperado",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.latest_alerts(t.alerts(spark, sf), 100))


TOP_LOCATED_SQL = f"""
    SELECT cod_cajero, fecha_hora, severidad, score_anomalia, monto_dispensado, 'Alerta ' || severidad AS descripcion,
           latitud, longitud, municipio_dane, departamento
    FROM al JOIN pl USING (cod_cajero)
    WHERE {RANGE} AND severidad IN ('critico', 'alto') AND latitud IS NOT NULL AND longitud IS NOT NULL"""


@query(
    "l02_j07_top_located_alerts",
    with_tables(
        "al pl",
        rounded_sql(
            f"{TOP_LOCATED_SQL} ORDER BY score_anomalia DESC, cod_cajero, fecha_hora LIMIT 50",
            "score_anomalia latitud longitud",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.top_located_alerts(t.alerts(spark, sf), places(spark, sf), START, END, 50))


@query(
    "l03_top_z",
    with_tables(
        "zb",
        rounded_sql(
            "SELECT cod_terminal, bucket_15min, monto_total_dispensado, z_score_vs_cajero FROM zb"
            " ORDER BY z_score_vs_cajero DESC, cod_terminal, bucket_15min LIMIT 5",
            "z_score_vs_cajero",
        ),
    ),
)
def _(spark, sf):
    columns = ["cod_terminal", "bucket_15min", "monto_total_dispensado", "z_score_vs_cajero"]
    return rounded(rp.top_by_z(t.scored_buckets(spark, sf).select(*columns)))


@query(
    "l03_top_absolute_z",
    with_tables(
        "zb",
        rounded_sql(
            "SELECT cod_terminal, bucket_15min, z_score_vs_cajero FROM zb"
            " ORDER BY abs(z_score_vs_cajero) DESC, cod_terminal, bucket_15min LIMIT 5",
            "z_score_vs_cajero",
        ),
    ),
)
def _(spark, sf):
    rows = rp.top_by_z(f.bucket_features(spark, sf), absolute=True)
    return rounded(rows.select("cod_terminal", "bucket_15min", "z_score_vs_cajero"))


@query(
    "l04_top_machines_by_count",
    with_tables(
        "su",
        rounded_sql(
            "SELECT cod_terminal, total_transacciones, monto_total_dispensado AS monto_total,"
            " dispensacion_promedio AS promedio, dispensacion_max AS maximo, fecha_primera_transaccion,"
            " fecha_ultima_transaccion FROM su ORDER BY total_transacciones DESC, cod_terminal LIMIT 10",
            "promedio",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.top_machines_by_count(r.machine_summary(t.transactions(spark, sf))))


@query(
    "l05_latest_buckets",
    with_tables(
        "mv",
        rounded_sql(
            "SELECT cod_terminal, bucket_15min, tipo_operacion, num_transacciones, monto_total_dispensado AS monto_total,"
            " monto_promedio FROM mv"
            " WHERE bucket_15min >= (SELECT max(bucket_15min) FROM mv) - INTERVAL '24 hours'"
            " ORDER BY bucket_15min DESC, num_transacciones DESC, cod_terminal, tipo_operacion LIMIT 20",
            "monto_promedio",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.latest_buckets(t.rollup(spark, sf)))


@query(
    "l07_t04_last_run",
    with_tables(
        "al pl",
        rounded_sql(
            "SELECT cod_cajero, fecha_hora, severidad, score_anomalia, monto_dispensado,"
            " 'Alerta ' || severidad AS descripcion, latitud, longitud, municipio_dane FROM al LEFT JOIN pl"
            " USING (cod_cajero) WHERE fecha_deteccion >= (SELECT max(fecha_deteccion) FROM al) - INTERVAL '600 minutes'",
            "score_anomalia latitud longitud",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.last_run_alerts(t.alerts(spark, sf), t.machines(spark, sf), minutes=600))


# -- key figures ---------------------------------------------------------------------------------------------


def _counts(names: dict[str, str], prefix: str = "", column: str = "severidad") -> str:
    return ", ".join(f"count(*) FILTER ({column} = '{v}') AS {prefix}{k}" for k, v in names.items())


@query(
    "a14_alert_kpis",
    with_tables(
        "al",
        f"SELECT {_counts(rp.BUCKET_LABELS, 'alertas_')}, count(*) AS total_alertas,"
        f" count(DISTINCT cod_cajero) AS cajeros_con_alertas FROM al WHERE {RANGE}",
    ),
)
def _(spark, sf):
    return rp.alert_kpis(t.alerts(spark, sf), START, END)


@query(
    "a15_alert_shares",
    with_tables(
        "al",
        rounded_sql(
            f"SELECT {_counts(rp.BUCKET_LABELS)}, count(*) AS total, "
            + ", ".join(
                f"count(*) FILTER (severidad = '{v}') * 100 / nullif(count(*), 0) AS pct_{k}"
                for k, v in rp.BUCKET_LABELS.items()
            )
            + " FROM al",
            "pct_criticas pct_altas pct_medias",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.alert_shares(t.alerts(spark, sf)))


@query(
    "a16_level_kpis",
    with_tables(
        "lv",
        f"SELECT count(*) AS total_alertas, {_counts(rp.LEVEL_LABELS)},"
        " count(DISTINCT cod_cajero) AS cajeros_afectados, max(fecha_deteccion) AS ultima_actualizacion FROM lv",
    ),
)
def _(spark, sf):
    return rp.level_kpis(t.level_alerts(spark, sf))


@query(
    "a16_score_kpis",
    with_tables(
        "sc tx",
        f"SELECT count(*) AS total_anomalias, {_counts(rp.LEVEL_LABELS, column='nivel_anomalia')},"
        " count(DISTINCT id_transaccion) AS transacciones_unicas FROM sc JOIN tx ON id_transaccion = id_tlf",
    ),
)
def _(spark, sf):
    return rp.score_kpis(t.scores(spark, sf), t.transactions(spark, sf))


DAILY = {k: rp.BUCKET_LABELS[k] for k in ("criticas", "altas")}
t.CTES["dy"] = (
    f"SELECT CAST(fecha_hora AS DATE) AS fecha, {_counts(DAILY)} FROM al WHERE {RANGE} GROUP BY 1",
    ("al",),
)


@query("a17_alerts_per_day", with_tables("dy", "SELECT * FROM dy"))
def _(spark, sf):
    return rp.alerts_per_day(t.alerts(spark, sf), START, END)


@query(
    "a17_per_day_and_severity",
    with_tables("al", "SELECT CAST(fecha_hora AS DATE) AS fecha, severidad, count(*) AS cantidad FROM al GROUP BY ALL"),
)
def _(spark, sf):
    return rp.alerts_per_day_and_severity(t.alerts(spark, sf))


BAND_SQL = """
    SELECT *, coalesce(criticas > banda_superior OR criticas < banda_inferior, false) AS es_anomalia
    FROM (SELECT *, m + 2 * s AS banda_superior, CASE WHEN m - 2 * s IS NOT NULL THEN greatest(m - 2 * s, 0) END
                 AS banda_inferior
          FROM (SELECT fecha, altas AS criticas,
                       CASE WHEN count(*) OVER w = 7 THEN avg(altas) OVER w END AS m,
                       CASE WHEN count(*) OVER w = 7 THEN stddev_samp(altas) OVER w END AS s
                FROM dy WINDOW w AS (ORDER BY fecha ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)))"""


@query(
    "w12_bands",
    with_tables(
        "dy",
        rounded_sql(
            f"SELECT * RENAME (m AS criticas_promedio, s AS criticas_std) FROM ({BAND_SQL})",
            "criticas_promedio criticas_std banda_superior banda_inferior",
        ),
    ),
)
def _(spark, sf):
    daily = rp.alerts_per_day(t.alerts(spark, sf), START, END)  # banded on the more frequent "alto" counts
    return rounded(rp.critical_bands(daily.select("fecha", F.col("altas").alias("criticas"))))


# -- machines ------------------------------------------------------------------------------------------------

TOP_SQL = """
    SELECT x.*, municipio_dane, departamento FROM (
        SELECT cod_cajero, count(*) AS num_alertas, count(*) FILTER (severidad = 'critico') AS alertas_criticas,
               max(fecha_hora) AS ultima_alerta, avg(score_anomalia) AS score_promedio,
               CASE max(CASE severidad WHEN 'critico' THEN 3 WHEN 'alto' THEN 2 ELSE 1 END)
                    WHEN 3 THEN 'critico' WHEN 2 THEN 'alto' ELSE 'medio' END AS severidad_max
        FROM al {where} GROUP BY cod_cajero
        ORDER BY num_alertas DESC, alertas_criticas DESC, cod_cajero LIMIT 10) x LEFT JOIN pl USING (cod_cajero)"""


@query("a18_top_machines", with_tables("al pl", rounded_sql(TOP_SQL.format(where=""), "score_promedio")))
def _(spark, sf):
    return rounded(rp.top_machines(t.alerts(spark, sf), places(spark, sf)))


@query(
    "a18_top_machines_in_range",
    with_tables("al pl", rounded_sql(TOP_SQL.format(where=f"WHERE {RANGE}"), "score_promedio")),
)
def _(spark, sf):
    return rounded(rp.top_machines(t.alerts(spark, sf), places(spark, sf), start=START, end=END))


@query(
    "a18_top_machines_by_scores",
    with_tables(
        "sc tx cj",
        rounded_sql(
            "SELECT cod_terminal, municipio_dane AS municipio, count(*) AS anomalias, avg(score_final) AS score_promedio"
            " FROM sc JOIN tx ON id_transaccion = id_tlf JOIN cj ON codigo = CAST(cod_terminal AS VARCHAR)"
            f" WHERE fecha_transaccion >= TIMESTAMP '{START}' AND fecha_transaccion < TIMESTAMP '{END}'"
            " AND municipio_dane IS NOT NULL GROUP BY ALL ORDER BY anomalias DESC, cod_terminal, municipio LIMIT 10",
            "score_promedio",
        ),
    ),
)
def _(spark, sf):
    rows = rp.scores_in_range(t.scores(spark, sf), t.transactions(spark, sf), START, END)
    return rounded(rp.top_machines_by_scores(rows, t.machines(spark, sf)))


@query(
    "a29_volatile_machines",
    with_tables(
        "fb fh pl",
        rounded_sql(
            "SELECT cod_cajero, dispensacion_promedio, dispensacion_std, coef_variacion, pct_anomalias_3std,"
            " municipio_dane AS municipio, departamento FROM fb JOIN fh USING (cod_cajero) LEFT JOIN pl"
            " USING (cod_cajero) WHERE coef_variacion IS NOT NULL ORDER BY coef_variacion DESC, cod_cajero LIMIT 20",
            "dispensacion_promedio dispensacion_std coef_variacion pct_anomalias_3std",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.volatile_machines(full_profile(spark, sf), t.machines(spark, sf)))


# -- patterns ------------------------------------------------------------------------------------------------


@query(
    "a19_hour_weekday",
    with_tables(
        "al",
        rounded_sql(
            "SELECT CAST(hour(fecha_hora) AS INTEGER) AS hora, CAST(dayofweek(fecha_hora) AS INTEGER) AS dia_semana,"
            " count(*) AS num_alertas, avg(score_anomalia) AS score_promedio FROM al GROUP BY ALL",
            "score_promedio",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.hour_weekday_counts(t.alerts(spark, sf)))


@query(
    "a19_hour_weekday_matrix",
    with_tables(
        "al",
        "SELECT CAST(hour(fecha_hora) AS INTEGER) AS hora, "
        + ", ".join(f"count(*) FILTER (dayofweek(fecha_hora) = {d}) AS d{d}" for d in range(7))
        + " FROM al GROUP BY 1",
    ),
)
def _(spark, sf):
    return rp.hour_weekday_matrix(t.alerts(spark, sf))


@query(
    "a20_monthly_trend",
    with_tables(
        "al",
        "SELECT CAST(date_trunc('month', fecha_hora) AS TIMESTAMP) AS mes, count(*) AS num_alertas,"
        f" {_counts(DAILY)} FROM al GROUP BY 1",
    ),
)
def _(spark, sf):
    return rp.monthly_trend(t.alerts(spark, sf))


@query(
    "a21_score_bands",
    with_tables(
        "al",
        "SELECT CASE WHEN score_anomalia >= 90 THEN '90-100' WHEN score_anomalia >= 80 THEN '80-89'"
        " WHEN score_anomalia >= 70 THEN '70-79' WHEN score_anomalia >= 60 THEN '60-69' ELSE '50-59' END"
        " AS rango_score, count(*) AS cantidad FROM al GROUP BY 1",
    ),
)
def _(spark, sf):
    return rp.score_bands(t.alerts(spark, sf))


@query(
    "a22_score_histogram",
    with_tables(
        "al",
        "SELECT CAST(least(floor((score_anomalia - lo) / (hi - lo) * 50) + 1, 50) AS INTEGER) AS intervalo, severidad,"
        " count(*) AS cantidad FROM al, (SELECT min(score_anomalia) AS lo, max(score_anomalia) AS hi FROM al)"
        " GROUP BY ALL",
    ),
)
def _(spark, sf):
    return rp.score_histogram(t.alerts(spark, sf))


@query(
    "a23_j10_compare_periods",
    with_tables(
        "al",
        rounded_sql(
            f"""
            SELECT *, round((alertas_actuales - alertas_anteriores) * 100.0::DOUBLE / nullif(alertas_anteriores, 0), 2)
                   AS cambio_porcentual, score_actual - score_anterior AS cambio_score
            FROM (SELECT count(*) FILTER ({RANGE}) AS alertas_actuales,
                         avg(score_anomalia) FILTER ({RANGE}) AS score_actual,
                         count(*) FILTER (fecha_hora >= TIMESTAMP '{BEFORE}' AND fecha_hora < TIMESTAMP '{START}')
                             AS alertas_anteriores,
                         avg(score_anomalia) FILTER (fecha_hora >= TIMESTAMP '{BEFORE}'
                             AND fecha_hora < TIMESTAMP '{START}') AS score_anterior
                  FROM al WHERE severidad = 'alto')""",
            "score_actual score_anterior cambio_score",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.compare_periods(t.alerts(spark, sf), START, END, BEFORE, "alto"))


@query(
    "a26_severity_summary",
    with_tables(
        "al",
        rounded_sql(
            "SELECT severidad, count(*) AS cantidad, avg(score_anomalia) AS score_promedio,"
            " avg(desviacion_std) AS desv_std_promedio FROM al GROUP BY severidad",
            "score_promedio desv_std_promedio",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.severity_summary(t.alerts(spark, sf)))


@query("a31_severity_share", with_tables("lv", "SELECT severidad, count(*) AS cantidad FROM lv GROUP BY severidad"))
def _(spark, sf):
    return rp.severity_share(t.level_alerts(spark, sf))


# -- places --------------------------------------------------------------------------------------------------


@query(
    "a24_alerts_by_department",
    with_tables(
        "al pl",
        rounded_sql(
            "SELECT departamento, count(*) AS num_alertas, count(DISTINCT cod_cajero) AS cajeros_afectados,"
            " avg(score_anomalia) AS score_promedio FROM al JOIN pl USING (cod_cajero)"
            f" WHERE {LAST_30.format(days=14)} AND departamento IS NOT NULL GROUP BY departamento",
            "score_promedio",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.alerts_by_department(t.alerts(spark, sf), places(spark, sf), days=14))


@query(
    "a25_alerts_by_municipality",
    with_tables(
        "al pl",
        "SELECT municipio_dane, departamento, count(*) AS num_alertas, count(DISTINCT cod_cajero) AS cajeros_afectados"
        f" FROM al JOIN pl USING (cod_cajero) WHERE {LAST_30.format(days=14)} AND municipio_dane IS NOT NULL"
        " GROUP BY ALL ORDER BY num_alertas DESC, municipio_dane, departamento LIMIT 20",
    ),
)
def _(spark, sf):
    return rp.alerts_by_municipality(t.alerts(spark, sf), places(spark, sf), days=14)


RISK_SQL = """
    SELECT cod_cajero, count(*) AS total_eventos,
           sum(CASE severidad WHEN 'Crítico' THEN 50 WHEN 'Advertencia' THEN 10 ELSE 2 END) / 10 AS risk_score,
           max(fecha_hora) AS ultima_anomalia, latitud, longitud, municipio_dane, departamento
    FROM lv JOIN pl USING (cod_cajero)
    WHERE fecha_hora >= (SELECT max(fecha_hora) FROM lv) - INTERVAL '20 days' AND latitud IS NOT NULL
    GROUP BY ALL"""


@query("a30_risk_map", with_tables("lv pl", rounded_sql(RISK_SQL, "risk_score latitud longitud")))
def _(spark, sf):
    return rounded(rp.risk_map(t.level_alerts(spark, sf), t.machines(spark, sf), days=20))


@query(
    "a30_risk_summary",
    with_tables(
        "lv pl",
        rounded_sql(
            "SELECT count(*) AS cajeros, count(*) FILTER (risk_score > 20) AS alto_riesgo,"
            f" quantile_cont(risk_score, 0.95) AS tope_color FROM ({RISK_SQL})",
            "tope_color",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.risk_summary(rp.risk_map(t.level_alerts(spark, sf), t.machines(spark, sf), days=20)))


@query(
    "a32_map_centre",
    with_tables(
        "al pl",
        rounded_sql(
            f"SELECT avg(latitud) AS latitud, avg(longitud) AS longitud FROM ({TOP_LOCATED_SQL})", "latitud longitud"
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.map_centre(rp.located_alerts(t.alerts(spark, sf), places(spark, sf), START, END)))


@query(
    "x08_shared_patterns",
    with_tables(
        "al pl",
        rounded_sql(
            "SELECT municipio_dane, time_bucket(INTERVAL '15 minutes', fecha_hora) AS bucket,"
            " count(DISTINCT cod_cajero) AS cajeros, count(*) AS alertas, avg(score_anomalia) AS score_promedio"
            " FROM al JOIN pl USING (cod_cajero) WHERE municipio_dane IS NOT NULL GROUP BY ALL"
            " HAVING count(DISTINCT cod_cajero) >= 2",
            "score_promedio",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.shared_patterns(t.alerts(spark, sf), places(spark, sf)))


# -- history and data checks ---------------------------------------------------------------------------------

HISTORY_SQL = """
    SELECT cod_terminal, count(*) AS num_periodos, avg(monto_total_dispensado) AS dispensacion_promedio,
           stddev_samp(monto_total_dispensado) AS dispensacion_std, max(monto_total_dispensado) AS dispensacion_max,
           min(bucket_15min) AS fecha_inicio, max(bucket_15min) AS fecha_fin FROM mv GROUP BY cod_terminal"""


@query("a27_history", with_tables("mv", rounded_sql(HISTORY_SQL, "dispensacion_promedio dispensacion_std")))
def _(spark, sf):
    return rounded(rp.history_per_machine(t.rollup(spark, sf)))


@query(
    "a27_history_overview",
    with_tables(
        "mv",
        rounded_sql(
            "SELECT count(*) AS cajeros, avg(dispensacion_promedio) AS promedio_global,"
            " CAST(sum(num_periodos) AS BIGINT) AS periodos,"
            " CAST(floor(epoch(max(fecha_fin) - min(fecha_inicio)) / 86400) AS INTEGER) AS dias_historia"
            f" FROM ({HISTORY_SQL})",
            "promedio_global",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.history_overview(rp.history_per_machine(t.rollup(spark, sf))))


@query(
    "a28_hourly_profile",
    with_tables(
        "mv",
        rounded_sql(
            "SELECT *, dispensacion_promedio + dispensacion_std AS banda_superior,"
            " dispensacion_promedio - dispensacion_std AS banda_inferior FROM (SELECT"
            " CAST(hour(bucket_15min) AS INTEGER) AS hora, avg(monto_total_dispensado) AS dispensacion_promedio,"
            " count(*) AS num_transacciones, stddev_samp(monto_total_dispensado) AS dispensacion_std"
            " FROM mv GROUP BY 1)",
            "dispensacion_promedio dispensacion_std banda_superior banda_inferior",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.hourly_profile(t.rollup(spark, sf)))


PARTS = [f"disp_promedio_{p}" for p in ("madrugada", "manana", "tarde", "noche")]


@query(
    "a33_summary_quality",
    with_tables(
        "su",
        rounded_sql(
            "SELECT count(*) AS total_cajeros, count(dispensacion_promedio) AS con_promedio,"
            " count(dispensacion_std) AS con_std, count(*) FILTER (total_transacciones > 0) AS con_transacciones,"
            f" count(*) FILTER (coalesce({', '.join(PARTS)}) IS NOT NULL) AS con_patron_horario,"
            " count(*) FILTER (total_transacciones > 25) AS cajeros_activos,"
            " avg(dispensacion_promedio) AS promedio_general, max(dispensacion_max) AS max_dispensacion FROM su",
            "promedio_general",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.summary_quality(r.machine_summary(t.transactions(spark, sf)), active=25))


@query(
    "a34_u01_part_of_day_profile",
    with_tables(
        "su",
        rounded_sql(
            " UNION ALL ".join(
                f"SELECT '{label}' AS franja, count(*) AS cajeros, avg({c}) AS monto_promedio FROM su"
                f" WHERE {c} IS NOT NULL"
                for c, label in rp.PART_LABELS.items()
            ),
            "monto_promedio",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.part_of_day_profile(r.machine_summary(t.transactions(spark, sf))))


KIND = "tipo_operacion IN ('Retiro', 'Avance')"


@query(
    "a35_load_check",
    with_tables(
        "tx",
        rounded_sql(
            f"SELECT count(*) AS registros, count(*) FILTER ({KIND}) AS retiros_avances,"
            f" count(*) FILTER ({KIND}) * 100.0::DOUBLE / count(*) AS pct_retiros_avances,"
            " min(fecha_transaccion) AS desde, max(fecha_transaccion) AS hasta,"
            f" count(DISTINCT cod_terminal) FILTER ({KIND}) AS cajeros,"
            f" sum(valor_transaccion) FILTER ({KIND} AND cod_estado_transaccion = 1) AS total_dispensado FROM tx",
            "pct_retiros_avances",
        ),
    ),
)
def _(spark, sf):
    return rounded(rp.load_check(t.transactions(spark, sf)))


@query(
    "a35_load_check_per_month",
    with_tables("tx", "SELECT mes_origen, count(*) AS registros FROM tx GROUP BY mes_origen"),
)
def _(spark, sf):
    return rp.load_check_per_month(t.transactions(spark, sf))


@query(
    "j08_machines_without_summary",
    with_tables(
        "disp",
        "SELECT cod_terminal, count(*) AS num_transacciones, min(fecha_transaccion) AS primera_tx,"
        " max(fecha_transaccion) AS ultima_tx FROM disp GROUP BY cod_terminal"
        " HAVING min(fecha_transaccion) >= TIMESTAMP '2024-01-03' ORDER BY cod_terminal LIMIT 10",
    ),
)
def _(spark, sf):
    # The summary is as old as the third day, so machines that began later have none.
    early = t.transactions(spark, sf).filter(F.col("fecha_transaccion") < F.lit("2024-01-03").cast("timestamp_ntz"))
    summary = r.machine_summary(early).select(F.col("cod_terminal").cast("string").alias("cod_cajero"))
    return rp.machines_without_summary(t.transactions(spark, sf), summary)


@query(
    "a37_training_summary",
    with_tables(
        "bk",
        "SELECT count(*) AS total_registros_entrenamiento, min(bucket_15min) AS fecha_datos_desde,"
        " max(bucket_15min) AS fecha_datos_hasta, count(DISTINCT cod_terminal) AS cajeros_unicos FROM bk",
    ),
)
def _(spark, sf):
    return training_summary(r.bucket_totals(t.rollup(spark, sf)))


@query(
    "x07_blended_scores",
    with_tables(
        "tx",
        rounded_sql(
            """
            SELECT *, CASE WHEN score_final > 0.8 THEN 'Crítico' WHEN score_final > 0.5 THEN 'Sospechoso'
                           ELSE 'Normal' END AS nivel_anomalia
            FROM (SELECT *, 0.5::DOUBLE * score_reglas + 0.5::DOUBLE * score_isolation_forest AS score_final
                  FROM (SELECT id_tlf AS id_transaccion,
                               CASE WHEN cod_estado_transaccion = 1 THEN least(1.0::DOUBLE, valor_transaccion / 2000000)
                                    ELSE 0 END AS score_reglas,
                               CASE WHEN tipo_operacion = 'Retiro' THEN least(1.0::DOUBLE, valor_transaccion / 1000000)
                                    ELSE 0 END AS score_isolation_forest
                        FROM tx))""",
            "score_reglas score_isolation_forest score_final",
            8,
        ),
    ),
)
def _(spark, sf):
    tx, amount = t.transactions(spark, sf), F.col("valor_transaccion")
    key = F.col("id_tlf").alias("id_transaccion")
    rules = tx.filter("cod_estado_transaccion = 1").select(key, F.least(F.lit(1.0), amount / 2000000).alias("score_reglas"))
    model = tx.filter("tipo_operacion = 'Retiro'").select(
        key, F.least(F.lit(1.0), amount / 1000000).alias("score_isolation_forest")
    )
    return rounded(blended_scores(rules, model), digits=8)
