"""Queries of the rules, reasons, alert texts, the isolation forest and the transaction rules on sequences."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from catalog import features as f
from catalog import tables as t
from catalog.registry import ORACLE, query
from catalog.tables import rounded, rounded_sql, with_tables
from tillwatch.operators import alerts as al
from tillwatch.operators import behaviour as bh
from tillwatch.operators import isolation_forest as forest
from tillwatch.operators import machine_profile as mp
from tillwatch.operators import reasons as rs
from tillwatch.operators import rollup as r
from tillwatch.operators import rules as ru
from tillwatch.operators import transactions as tx
from tillwatch.operators.neighbours import zone_features
from tillwatch.plans.reports import reasons_per_type, transaction_reasons
from tillwatch.plans.skew import first_per_key
from tillwatch.plans.strata import stratified_sample
from tillwatch.schemas import BUCKET_MODEL_FEATURES, MACHINE_MODEL_FEATURES
from tillwatch.session import materialise

# -- alert expressions ---------------------------------------------------------------------------------------

t.CTES["sb"] = (
    "SELECT *, least(100.0, 20 * abs(z_score_vs_cajero)) AS score_anomalia FROM bf",
    ("bf",),
)


def scored_features(spark, sf):
    score = F.least(F.lit(100.0), 20 * F.abs("z_score_vs_cajero"))
    return f.bucket_features(spark, sf).withColumn("score_anomalia", score)


SEVERITY_SQL = """CASE WHEN (score_anomalia >= 80 AND abs(z_score_vs_cajero) >= 4) OR score_anomalia >= 85
    OR abs(z_score_vs_cajero) >= 5 THEN 'critico'
    WHEN score_anomalia >= 70 OR abs(z_score_vs_cajero) >= 3 THEN 'alto' ELSE 'medio' END"""
EXPECTED_SQL = """CASE WHEN z_score_vs_cajero = 0 THEN monto_total_dispensado
    ELSE monto_total_dispensado / nullif(1 + z_score_vs_cajero, 0) END"""


@query(
    "m06_m07_severity_expected",
    with_tables(
        "sb",
        rounded_sql(
            f"SELECT bucket_15min, cod_terminal, {SEVERITY_SQL} AS severidad, {EXPECTED_SQL} AS monto_esperado FROM sb",
            "monto_esperado",
            -1,  # close to z = -1 the quotient magnifies the last bits
        ),
    ),
)
def _(spark, sf):
    z = F.col("z_score_vs_cajero")
    rows = scored_features(spark, sf).select(
        "bucket_15min",
        "cod_terminal",
        al.severity(F.col("score_anomalia"), z).alias("severidad"),
        al.expected_amount(F.col("monto_total_dispensado"), z).alias("monto_esperado"),
    )
    return rounded(rows, digits=-1)


REASON_SQL = """coalesce(nullif(concat_ws(' | ',
    CASE WHEN abs(z_score_vs_cajero) >= 3 THEN printf('Z-score vs cajero: %.2f std', z_score_vs_cajero) END,
    CASE WHEN abs(z_score_vs_hora) >= 3 THEN printf('Z-score vs misma hora: %.2f std', z_score_vs_hora) END,
    CASE WHEN abs(z_score_vs_dia_semana) >= 2.5
         THEN printf('Z-score vs mismo dia: %.2f std', z_score_vs_dia_semana) END,
    CASE WHEN percentil_vs_mes >= 95 THEN printf('Percentil mensual: %.1f%%', percentil_vs_mes) END,
    CASE WHEN abs(cambio_vs_anterior) >= 200 THEN printf('Cambio vs anterior: %+.1f%%', cambio_vs_anterior) END,
    CASE WHEN score_anomalia >= 70 THEN printf('Isolation Forest: %.0f/100', score_anomalia) END), ''),
    'Anomalia detectada por modelo')"""


@query("m08_reason_text", with_tables("sb", f"SELECT bucket_15min, cod_terminal, {REASON_SQL} AS razones FROM sb"))
def _(spark, sf):
    text = al.reason_text(F.col("score_anomalia"))
    return scored_features(spark, sf).select("bucket_15min", "cod_terminal", text.alias("razones"))


DESCRIPTION_SQL = """concat_ws(' | ',
    'Dispensacion: $' || format('{:,}', CAST(monto_total_dispensado AS BIGINT)) || ' ('
        || printf('%+.1f', CASE WHEN esperado > 0 THEN (monto_total_dispensado - esperado) / esperado * 100
                                ELSE 0.0 END) || '% vs esperado)',
    ['Lunes', 'Martes', 'Miercoles', 'Jueves', 'Viernes', 'Sabado', 'Domingo'][dia_semana]
        || printf(' %02d:XX', hora_del_dia),
    printf('Z-score: %.2f std', z_score_vs_cajero),
    CASE WHEN es_fin_de_semana THEN 'Fin de semana' END, CASE WHEN es_quincena THEN 'Quincena' END)"""


@query(
    "m09_description_text",
    with_tables(
        "sb",
        f"SELECT bucket_15min, cod_terminal, {DESCRIPTION_SQL} AS descripcion"
        f" FROM (SELECT *, {EXPECTED_SQL} AS esperado FROM sb)",
    ),
)
def _(spark, sf):
    rows = scored_features(spark, sf)
    expected = al.expected_amount(F.col("monto_total_dispensado"), F.col("z_score_vs_cajero"))
    rows = rows.withColumn("_esperado", expected)
    text = al.description_text(F.col("_esperado"))
    return rows.select("bucket_15min", "cod_terminal", text.alias("descripcion"))


@query(
    "m10_alert_rows",
    with_tables(
        "sb",
        rounded_sql(
            f"""
            SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero, bucket_15min AS fecha_hora,
                   'isolation_forest' AS tipo_anomalia, {SEVERITY_SQL} AS severidad, score_anomalia,
                   monto_total_dispensado AS monto_dispensado, esperado AS monto_esperado,
                   abs(z_score_vs_cajero) AS desviacion_std, {DESCRIPTION_SQL} AS descripcion,
                   {REASON_SQL} AS razones, 'isolation_forest_v2' AS modelo_usado
            FROM (SELECT *, {EXPECTED_SQL} AS esperado FROM sb) WHERE score_anomalia >= 40""",
            "score_anomalia monto_esperado desviacion_std",
            2,
        ),
    ),
)
def _(spark, sf):
    flagged = scored_features(spark, sf).filter("score_anomalia >= 40")
    return rounded(al.build_alerts(flagged).drop("fecha_deteccion"), digits=2)


# -- preparation and scaling ---------------------------------------------------------------------------------

PREPARED = ["monto_total_dispensado", "es_fin_de_semana", "tendencia_24h", "volatilidad_reciente"]


@query(
    "p11_impute_median",
    with_tables(
        "bf",
        rounded_sql(
            """
            SELECT bucket_15min, cod_terminal, monto_total_dispensado,
                   CAST(es_fin_de_semana AS DOUBLE) AS es_fin_de_semana,
                   coalesce(tendencia_24h, (SELECT median(tendencia_24h) FROM bf)) AS tendencia_24h,
                   coalesce(volatilidad_reciente, (SELECT median(volatilidad_reciente) FROM bf))
                       AS volatilidad_reciente FROM bf""",
            "tendencia_24h volatilidad_reciente",
        ),
    ),
)
def _(spark, sf):
    numbers = materialise(
        forest.as_numbers(f.bucket_features(spark, sf).select("bucket_15min", "cod_terminal", *PREPARED), PREPARED),
        "numbers",
    )
    return rounded(forest.impute(numbers, forest.fit_medians(numbers, PREPARED)))


@query(
    "p12_zero_fill",
    with_tables(
        "bf",
        rounded_sql(
            "SELECT bucket_15min, cod_terminal, coalesce(tendencia_24h, 0) AS tendencia_24h,"
            " coalesce(volatilidad_reciente, 0) AS volatilidad_reciente FROM bf",
            "tendencia_24h volatilidad_reciente",
        ),
    ),
)
def _(spark, sf):
    columns = ["tendencia_24h", "volatilidad_reciente"]
    rows = f.bucket_features(spark, sf).select("bucket_15min", "cod_terminal", *columns)
    return rounded(forest.zero_fill(rows, columns))


@query(
    "m03_standardise",
    with_tables(
        "bk",
        rounded_sql(
            "SELECT bucket_15min, cod_terminal,"
            " (monto_total_dispensado - avg(monto_total_dispensado) OVER ()) / stddev_pop(monto_total_dispensado) OVER ()"
            " AS monto_total_dispensado, (num_transacciones - avg(num_transacciones) OVER ())"
            " / stddev_pop(num_transacciones) OVER () AS num_transacciones FROM bk",
            "monto_total_dispensado num_transacciones",
            6,
        ),
    ),
)
def _(spark, sf):
    columns = ["monto_total_dispensado", "num_transacciones"]
    rows = r.bucket_totals(t.rollup(spark, sf))
    return rounded(forest.scale(rows, forest.fit_scaler(rows, columns)), digits=6)


@query(
    "m05_inverted_min_max",
    with_tables(
        "bk",
        rounded_sql(
            "SELECT bucket_15min, cod_terminal, (1 - (monto_total_dispensado - min(monto_total_dispensado) OVER ())"
            " / nullif(max(monto_total_dispensado) OVER () - min(monto_total_dispensado) OVER (), 0)) * 100 AS score"
            " FROM bk",
            "score",
            6,
        ),
    ),
)
def _(spark, sf):
    rows = r.bucket_totals(t.rollup(spark, sf))
    amount = F.col("monto_total_dispensado")
    bounds = rows.agg(F.struct(F.min(amount).alias("lo"), F.max(amount).alias("hi"))).scalar()
    rows = rows.withColumn("_b", bounds)
    score = al.invert_min_max(amount, F.col("_b.lo"), F.col("_b.hi"))
    return rounded(rows.select("bucket_15min", "cod_terminal", score.alias("score")), digits=6)


# -- isolation forest ----------------------------------------------------------------------------------------

BUCKET_KEYS = ["cod_terminal", "bucket_15min"]


def prepared_buckets(spark, sf):
    rows = materialise(f.bucket_features(spark, sf), "bucket-features")
    return rows, forest.fit_bucket_forest(rows)


def tree_nodes(spark, sf):
    rows = materialise(f.bucket_features(spark, sf), "bucket-features")
    numbers = materialise(forest.as_numbers(rows.select(*BUCKET_KEYS, *BUCKET_MODEL_FEATURES), BUCKET_MODEL_FEATURES), "n")
    filled = forest.impute(numbers, forest.fit_medians(numbers, BUCKET_MODEL_FEATURES))
    scaled = forest.scale(filled, forest.fit_scaler(filled, BUCKET_MODEL_FEATURES))
    return forest.grow_trees(scaled, BUCKET_MODEL_FEATURES, BUCKET_KEYS, 200, min(256, rows.count()), 0.8, 42)


@query("m01_bucket_forest")
def _(spark, sf):
    return tree_nodes(spark, sf)


@query("m04_m05_score_buckets")
def _(spark, sf):
    rows, model = prepared_buckets(spark, sf)
    return model.transform(rows).select(*BUCKET_KEYS, "score_modelo", "es_anomalia", "score_anomalia")


@query("m10_forest_alerts")
def _(spark, sf):
    rows, model = prepared_buckets(spark, sf)
    return al.build_alerts(model.transform(rows).filter("es_anomalia"))


@query(
    "m01_tree_samples",
    with_tables(
        "bk",
        "SELECT CAST(range AS INTEGER) AS arbol, least(256, (SELECT count(*) FROM bk)) AS filas_raiz,"
        " least(256, (SELECT count(*) FROM bk)) AS filas_hojas, true AS hondura_valida FROM range(200)",
    ),
)
def _(spark, sf):
    """Every tree holds a full sample, its leaves add up to it, and no path is too long."""
    return tree_nodes(spark, sf).groupBy("arbol").agg(
        F.sum(F.when(F.col("nodo") == 0, F.col("filas"))).alias("filas_raiz"),
        F.sum(F.when(F.col("variable") < 0, F.col("filas"))).alias("filas_hojas"),
        (F.max("hondura") <= 8).alias("hondura_valida"),
    )


@query(
    "m16_model_metadata",
    with_tables(
        "bk",
        "SELECT '2.0' AS version, count(*) AS total_registros_entrenamiento, 0.01::DOUBLE AS contamination,"
        " 42 AS random_state, min(bucket_15min) AS fecha_datos_desde, max(bucket_15min) AS fecha_datos_hasta,"
        " count(DISTINCT cod_terminal) AS cajeros_unicos, CAST(least(256, count(*)) AS INTEGER) AS psi FROM bk",
    ),
)
def _(spark, sf):
    """What the model was fitted on; its random threshold and score range are left out."""
    return prepared_buckets(spark, sf)[1].describe(spark).drop("umbral", "score_minimo", "score_maximo")


@query(
    "m17_training_check",
    with_tables(
        "bk",
        "SELECT count(*) AS registros, true AS proporcion_valida, 0.0::DOUBLE AS score_min, 1.0::DOUBLE AS score_max"
        " FROM bk",
    ),
)
def _(spark, sf):
    """The share flagged is the contamination, up to one row and ties of the score at the threshold."""
    rows, model = prepared_buckets(spark, sf)
    check = forest.training_check(model.transform(rows))
    expected, flagged = 0.01 * F.col("registros"), F.col("anomalias")
    return check.select(
        "registros",
        flagged.between(0.8 * expected - 1, expected + 1).alias("proporcion_valida"),
        "score_min",
        "score_max",
    )


@query(
    "l06_stratified_sample",
    with_tables(
        "bk",
        """
        SELECT bucket_15min, cod_terminal, monto_total_dispensado, num_transacciones FROM (
            SELECT *, row_number() OVER (PARTITION BY mes, cod_terminal ORDER BY substr(md5('42|' || CAST(bucket_15min AS VARCHAR) || '|' || cod_terminal), 1, 15)) AS puesto
            FROM (SELECT *, month(bucket_15min) * 100 + day(bucket_15min) // 10 AS mes FROM bk))
        JOIN (SELECT mes, cod_terminal, hasta * 1000 // total - (hasta - n) * 1000 // total AS cupo
              FROM (SELECT *, CAST(sum(n) OVER (ORDER BY mes, cod_terminal) AS BIGINT) AS hasta, CAST(sum(n) OVER () AS BIGINT) AS total
                    FROM (SELECT month(bucket_15min) * 100 + day(bucket_15min) // 10 AS mes, cod_terminal, count(*) AS n FROM bk GROUP BY ALL)))
        USING (mes, cod_terminal) WHERE puesto <= cupo""",
    ),
)
def _(spark, sf):
    """A thousand buckets over periods of ten days and machines; the test data have one month."""
    rows = r.bucket_totals(t.rollup(spark, sf))
    rows = rows.withColumn("mes", F.month("bucket_15min") * 100 + F.floor(F.dayofmonth("bucket_15min") / 10))
    return stratified_sample(rows, ["mes", "cod_terminal"], ["bucket_15min", "cod_terminal"], 1000).drop("mes")


@query("l06_training_sample")
def _(spark, sf):
    rows = r.bucket_totals(t.rollup(spark, sf))
    return forest.sample_rows(rows, 1000, BUCKET_KEYS)


def machine_features(spark, sf):
    profile = mp.machine_profile(t.rollup(spark, sf), week_rows=f.WEEK)
    return zone_features(profile, t.machines(spark, sf))


def machine_model(spark, sf):
    profile = materialise(machine_features(spark, sf), "machine-features")
    return profile, forest.fit_machine_forest(profile, contamination=0.05)


@query("m02_machine_forest")
def _(spark, sf):
    profile, model = machine_model(spark, sf)
    return model.transform(profile).select("cod_cajero", "score_modelo", "es_anomalia", "score_anomalia")


@query(
    "a12_j09_machine_features",
    with_tables(
        "pf zo",
        rounded_sql(
            "SELECT cod_cajero, "
            + ", ".join(MACHINE_MODEL_FEATURES)
            + " FROM pf JOIN zo USING (cod_cajero)",
            " ".join(m for m in MACHINE_MODEL_FEATURES if m not in ("hora_pico", "cajeros_cercanos_1km")),
        ).replace("cod_cajero, dispensacion_promedio,", "cod_cajero, pf.dispensacion_promedio,"),
    ),
)
def _(spark, sf):
    return rounded(machine_features(spark, sf).select("cod_cajero", *MACHINE_MODEL_FEATURES))


# -- rules ---------------------------------------------------------------------------------------------------

RULE_WHEN = {
    1: ("des > 0 AND z > 3", "least(z / 10, 1.0::DOUBLE)", 0.30),
    2: ("h BETWEEN 0 AND 5 AND CASE WHEN p > 0 THEN disp_madrugada / p ELSE 0 END < 0.1", "1.0::DOUBLE", 0.25),
    3: ("p > 0 AND abs((m - p) / p * 100) > 200", "least(abs((m - p) / p * 100) / 500, 1.0::DOUBLE)", 0.20),
    4: ("pct_anomalias_3std > 5", "least(pct_anomalias_3std / 20, 1.0::DOUBLE)", 0.15),
    5: ("ratio > 3 OR ratio < 0.3", "CASE WHEN ratio > 3 THEN 1.0::DOUBLE ELSE 0.7::DOUBLE END", 0.10),
}
PARTS_SQL = ", ".join(
    f"coalesce(CASE WHEN {when} THEN {w}::DOUBLE * {strength} END, 0) AS s{i}"
    for i, (when, strength, w) in RULE_WHEN.items()
)


def _rules_sql(source: str) -> str:
    """Rule parts per row of ``source`` (cod_cajero, fecha_hora, m) against the machine's profile."""
    return f"""
        SELECT *, {PARTS_SQL} FROM (
            SELECT x.*, hour(fecha_hora) AS h, dispensacion_promedio AS p, dispensacion_std AS des,
                   abs((m - dispensacion_promedio) / nullif(dispensacion_std, 0)) AS z, disp_madrugada,
                   pct_anomalias_3std, ratio_vs_zona AS ratio
            FROM ({source}) x
            JOIN (SELECT cod_cajero, pf.dispensacion_promedio, dispensacion_std, disp_madrugada, pct_anomalias_3std,
                         ratio_vs_zona FROM pf JOIN zo USING (cod_cajero)) USING (cod_cajero))"""


BUCKET_SOURCE = (
    "SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero, bucket_15min AS fecha_hora,"
    " monto_total_dispensado AS m FROM bk"
)


@query(
    "m11_rules",
    with_tables(
        "bk pf zo",
        rounded_sql(
            "SELECT cod_cajero, fecha_hora, least(s1 + s2 + s3 + s4 + s5, 1.0) AS score_reglas, concat_ws(',',"
            + ", ".join(
                f"CASE WHEN s{i} > 0 THEN '{name}' END" for i, name in enumerate(ru.WEIGHTS, start=1)
            )
            + f") AS reglas FROM ({_rules_sql(BUCKET_SOURCE)})",
            "score_reglas",
            6,
        ),
    ),
)
def _(spark, sf):
    profile = materialise(machine_features(spark, sf), "machine-features")
    buckets = r.bucket_totals(t.rollup(spark, sf)).select(
        F.col("cod_terminal").cast("string").alias("cod_cajero"),
        F.col("bucket_15min").alias("fecha_hora"),
        F.col("monto_total_dispensado").alias("monto_dispensado"),
    )
    known, _ = ru.with_history(buckets, profile)
    rules = ru.business_rules(F.col("monto_dispensado"), F.hour("fecha_hora"))
    rows = known.withColumn("_r", rules).select(
        "cod_cajero",
        "fecha_hora",
        F.col("_r.score").alias("score_reglas"),
        F.concat_ws(",", F.col("_r.reglas.regla")).alias("reglas"),
    )
    return rounded(rows, digits=6)


# -- reasons of transactions ---------------------------------------------------------------------------------


def anomalies(spark, sf):
    transactions = t.transactions(spark, sf)
    features = tx.transaction_features(transactions, t.machines(spark, sf))
    return rs.anomalous_transactions(t.scores(spark, sf), transactions, features)


ANOMALY_SQL = """
    SELECT sc.id_transaccion, score_final, nivel_anomalia, fecha_transaccion, cod_terminal, tipo_operacion,
           valor_transaccion, tf.* EXCLUDE (id_transaccion)
    FROM sc JOIN tx ON sc.id_transaccion = id_tlf JOIN tf ON tf.id_transaccion = sc.id_transaccion
    WHERE nivel_anomalia IN ('Crítico', 'Advertencia')"""
t.CTES["an"] = (ANOMALY_SQL, ("sc", "tx", "tf"))


@query(
    "j06_anomalous_transactions",
    with_tables("an", rounded_sql("SELECT * FROM an", f.TF_DOUBLES)),
)
def _(spark, sf):
    return rounded(anomalies(spark, sf), f.TF_DOUBLES)


AMOUNT_TEXT = "format('{{:,}}', CAST(round_even({0}, 0) AS BIGINT))"
REASONS = [
    (
        "es_horario_nocturno AND cierre_nocturno_encoded <> 0",
        "printf('Transacción a las %02d:00 en cajero que cierra de noche', hora)",
        "'ubicacion'",
        "4",
    ),
    ("es_madrugada", "printf('Transacción en madrugada (%02d:00)', hora)", "'temporal'", "4"),
    (
        "es_fin_de_semana",
        "'Transacción en fin de semana (' || ['Lun', 'Mar', 'Mie', 'Jue', 'Vie', 'Sáb', 'Dom'][dia_semana + 1] || ')'",
        "'otro'",
        "4",
    ),
    ("es_retiro_maximo", f"'Retiro máximo: $' || {AMOUNT_TEXT.format('valor_transaccion')}", "'monto'", "8"),
    (
        "abs(desviacion_monto_cajero) > 3",
        "printf('Monto %.1fσ ', abs(desviacion_monto_cajero)) || CASE WHEN desviacion_monto_cajero > 0"
        " THEN 'por encima' ELSE 'por debajo' END || ' del promedio del cajero'",
        "'monto'",
        "7",
    ),
    (
        "abs(diferencia_valor) > 1000",
        f"'Diferencia entre valor original y final: $' || {AMOUNT_TEXT.format('diferencia_valor')}",
        "'otro'",
        "4",
    ),
    (
        "es_transaccion_rapida",
        "printf('Transacción %.0f segundos después de la anterior', tiempo_desde_anterior_seg)",
        "'velocidad'",
        "8",
    ),
    ("tx_por_hora_cajero > 30", "printf('Alta frecuencia en cajero: %.0f tx/hora', tx_por_hora_cajero)", "'velocidad'", "6"),
    ("es_cambio_pin", "'Cambio de PIN detectado'", "'operacion'", "CASE WHEN es_transaccion_rapida THEN 4 ELSE 5 END"),
    ("transaccion_rechazada", "'Transacción rechazada'", "'operacion'", "4"),
    (
        "tasa_rechazo_cajero > 0.3",
        "printf('Cajero con alta tasa de rechazo: %.1f%%', tasa_rechazo_cajero * 100)",
        "'ubicacion'",
        "4",
    ),
    ("cajero_adyacente_encoded = 0", "'Cajero aislado (no adyacente a oficina)'", "'ubicacion'", "5"),
    ("score_final > 0.7", "printf('Patrón anómalo detectado por ML (score: %.3f)', score_final)", "'ml'", "4"),
]
t.CTES["rz"] = (
    "SELECT id_transaccion, tipo_razon, descripcion, severidad, CAST(row_number() OVER (PARTITION BY id_transaccion"
    " ORDER BY k) AS INTEGER) AS orden FROM ("
    + " UNION ALL ".join(
        f"SELECT id_transaccion, {kind} AS tipo_razon, {text} AS descripcion, {weight} AS severidad, {k} AS k"
        f" FROM an WHERE {when}"
        for k, (when, text, kind, weight) in enumerate(REASONS)
    )
    + ")",
    ("an",),
)


@query("m13_m14_m15_reasons", with_tables("rz", "SELECT * FROM rz"))
def _(spark, sf):
    return rs.explain_transactions(anomalies(spark, sf))


@query("a36_reasons_per_type", with_tables("rz", "SELECT tipo_razon, count(*) AS cantidad FROM rz GROUP BY tipo_razon"))
def _(spark, sf):
    return reasons_per_type(rs.explain_transactions(anomalies(spark, sf)))


@query(
    "p14_transaction_reasons",
    with_tables(
        "rz",
        "SELECT tipo_razon, descripcion, severidad FROM rz WHERE id_transaccion = (SELECT min(id_transaccion) FROM rz)",
    ),
)
def _(spark, sf):
    reasons = materialise(rs.explain_transactions(anomalies(spark, sf)), "reasons")
    first = reasons.agg(F.min("id_transaccion")).first()[0]
    return transaction_reasons(reasons, first)


# -- rules on sequences --------------------------------------------------------------------------------------

LOOKBACK = "OVER (PARTITION BY cod_terminal ORDER BY fecha_transaccion RANGE BETWEEN INTERVAL '{0}' PRECEDING AND CURRENT ROW)"


@query(
    "x01_frequent_pin_changes",
    with_tables(
        "tx",
        f"SELECT * FROM (SELECT id_tlf, cod_terminal, fecha_transaccion, count(*) {LOOKBACK.format('12 hours')}"
        " AS cambios_pin FROM tx WHERE tipo_operacion = 'Cambio De Pin') WHERE cambios_pin > 1",
    ),
)
def _(spark, sf):
    return bh.frequent_pin_changes(t.transactions(spark, sf), more_than=1, seconds=12 * 3600)


@query(
    "x02_large_withdrawals",
    with_tables(
        "disp",
        "SELECT * FROM (SELECT id_tlf, cod_terminal, fecha_transaccion, valor_transaccion,"
        f" sum(valor_transaccion) {LOOKBACK.format('6 hours')} AS monto_periodo FROM disp)"
        " WHERE monto_periodo > 2000000",
    ),
)
def _(spark, sf):
    return bh.large_withdrawals(t.transactions(spark, sf), seconds=6 * 3600)


@query(
    "x03_rejection_runs",
    with_tables(
        "tx",
        """
        SELECT cod_terminal, count(*) AS rechazos, min(fecha_transaccion) AS desde, max(fecha_transaccion) AS hasta
        FROM (SELECT *, row_number() OVER (PARTITION BY cod_terminal ORDER BY fecha_transaccion, id_tlf)
                     - row_number() OVER (PARTITION BY cod_terminal, cod_estado_transaccion
                                          ORDER BY fecha_transaccion, id_tlf) AS isla FROM tx)
        WHERE cod_estado_transaccion = 2 GROUP BY cod_terminal, isla HAVING count(*) >= 3""",
    ),
)
def _(spark, sf):
    return bh.rejection_runs(t.transactions(spark, sf), at_least=3)


@query(
    "x04_outside_hours",
    with_tables(
        "tx cj",
        """
        SELECT id_tlf, cod_terminal, fecha_transaccion, hora_apertura_atm AS abre, hora_cierre_atm AS cierra
        FROM (SELECT *, strftime(fecha_transaccion, '%H:%M') AS hm FROM tx
              JOIN cj ON codigo = CAST(cod_terminal AS VARCHAR))
        WHERE CASE WHEN hora_apertura_atm <= hora_cierre_atm THEN hm < hora_apertura_atm OR hm > hora_cierre_atm
                   ELSE hm < hora_apertura_atm AND hm > hora_cierre_atm END""",
    ),
)
def _(spark, sf):
    return bh.outside_hours(t.transactions(spark, sf), t.machines(spark, sf))


@query(
    "x05_high_rate",
    with_tables(
        "tx",
        f"SELECT * FROM (SELECT id_tlf, cod_terminal, fecha_transaccion, count(*) {LOOKBACK.format('3 hours')}"
        " AS transacciones_periodo FROM tx) WHERE transacciones_periodo > 2",
    ),
)
def _(spark, sf):
    return bh.high_rate(t.transactions(spark, sf), more_than=2, seconds=3 * 3600)


@query(
    "x06_withdrawal_after_pin_change",
    with_tables(
        "tx",
        """
        SELECT id_tlf, cod_terminal, fecha_transaccion, cambio_pin,
               (epoch_us(fecha_transaccion) - epoch_us(cambio_pin)) / 1000000 AS segundos_desde_pin
        FROM (SELECT *, max(fecha_transaccion) FILTER (tipo_operacion = 'Cambio De Pin') OVER (PARTITION BY cod_terminal
                     ORDER BY fecha_transaccion) AS cambio_pin FROM tx)
        WHERE tipo_operacion IN ('Retiro', 'Avance') AND cod_estado_transaccion = 1
          AND epoch_us(fecha_transaccion) - epoch_us(cambio_pin) < 7200000000""",
    ),
)
def _(spark, sf):
    return bh.withdrawal_after_pin_change(t.transactions(spark, sf), seconds=7200)


#: Looser limits than the defaults, so that every rule is met in the test tables; the same as in x01 to x06.
LOOSE = {
    "cambios_pin": {"more_than": 1, "seconds": 12 * 3600},
    "retiro_grande": {"seconds": 6 * 3600},
    "velocidad": {"more_than": 2, "seconds": 3 * 3600},
    "pin_y_retiro": {"seconds": 7200},
    "rechazos": {"at_least": 3},
}


def _met(rule: str, query_name: str) -> str:
    return f"SELECT id_tlf, {bh.RULE_SCORES[rule]}::DOUBLE AS punto, '{rule}' AS regla FROM ({ORACLE[query_name]})"


RULES_SQL = f"""
    SELECT id_tlf AS id_transaccion, max(punto) AS score_reglas, coalesce(string_agg(DISTINCT regla, ',' ORDER BY regla), '') AS reglas
    FROM (SELECT id_tlf, 0::DOUBLE AS punto, NULL AS regla FROM tx
          UNION ALL {_met("cambios_pin", "x01_frequent_pin_changes")}
          UNION ALL {_met("retiro_grande", "x02_large_withdrawals")}
          UNION ALL {_met("velocidad", "x05_high_rate")}
          UNION ALL {_met("pin_y_retiro", "x06_withdrawal_after_pin_change")}
          UNION ALL {_met("fuera_de_horario", "x04_outside_hours")}
          UNION ALL SELECT id_tlf, {bh.RULE_SCORES["rechazos"]}::DOUBLE, 'rechazos' FROM tx
                    JOIN ({ORACLE["x03_rejection_runs"]}) AS r ON tx.cod_terminal = r.cod_terminal
                    AND fecha_transaccion BETWEEN desde AND hasta WHERE cod_estado_transaccion = 2)
    GROUP BY id_tlf"""


@query("x07_rule_scores", with_tables("tx", RULES_SQL))
def _(spark, sf):
    scored = bh.rule_scores(t.transactions(spark, sf), t.machines(spark, sf), **LOOSE)
    return scored.withColumn("reglas", F.array_join("reglas", ","))


@query(
    "x07_scores",
    with_tables(
        "tx",
        rounded_sql(
            f"""
            SELECT id_transaccion, score_reglas, score_isolation_forest, score_final,
                   CASE WHEN score_final > 0.8 THEN 'Crítico' WHEN score_final > 0.5 THEN 'Sospechoso' ELSE 'Normal' END AS nivel_anomalia
            FROM (SELECT r.id_transaccion, score_reglas, modelo AS score_isolation_forest, 0.5::DOUBLE * score_reglas + 0.5::DOUBLE * modelo AS score_final
                  FROM ({RULES_SQL}) AS r JOIN (SELECT id_tlf, least(1.0::DOUBLE, valor_transaccion / 1000000) AS modelo FROM tx) AS m
                  ON r.id_transaccion = m.id_tlf)""",
            "score_reglas score_isolation_forest score_final",
            8,
        ),
    ),
)
def _(spark, sf):
    tx = t.transactions(spark, sf)
    model = tx.select(F.col("id_tlf").alias("id_transaccion"), F.least(F.lit(1.0), F.col("valor_transaccion") / 1000000).alias("score_isolation_forest"))
    rules = bh.rule_scores(tx, t.machines(spark, sf), **LOOSE)
    return rounded(bh.blended_scores(rules, model), digits=8)


# -- a small forest written by hand --------------------------------------------------------------------------

#: (tree, node, feature, cut, left, right, rows, depth); feature -1: a leaf.
SMALL_NODES = [
    (0, 0, 0, 0.25, 1, 2, 16, 0), (0, 1, 1, -0.5, 3, 4, 10, 1), (0, 2, -1, 0.0, -1, -1, 6, 1),
    (0, 3, -1, 0.0, -1, -1, 1, 2), (0, 4, -1, 0.0, -1, -1, 9, 2),
    (1, 0, 1, 0.5, 1, 2, 16, 0), (1, 1, -1, 0.0, -1, -1, 14, 1), (1, 2, 0, 1.0, 3, 4, 2, 1),
    (1, 3, -1, 0.0, -1, -1, 1, 2), (1, 4, -1, 0.0, -1, -1, 1, 2),
]
SMALL_FOREST = forest.Forest(
    ["monto_total_dispensado", "num_transacciones"],
    {"monto_total_dispensado": 1e6, "num_transacciones": 1.0},
    {"monto_total_dispensado": (2e6, 1e6), "num_transacciones": (1.5, 0.5)},
    pd.DataFrame(SMALL_NODES, columns=["arbol", "nodo", "variable", "corte", "izquierda", "derecha", "filas", "hondura"]),
    16,
    -0.5,
    -0.8,
    -0.3,
)


def _mean_depth(n: str) -> str:
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329) - 2 * ({n} - 1)::DOUBLE / {n} WHEN {n} = 2 THEN 1 ELSE 0 END"


SMALL_SQL = f"""
    WITH RECURSIVE nodes(arbol, nodo, variable, corte, izquierda, derecha, filas, hondura) AS (
        VALUES {", ".join(map(str, SMALL_NODES))}),
    x AS (SELECT cod_terminal, bucket_15min, (monto_total_dispensado - 2e6) / 1e6 AS x0, (num_transacciones - 1.5) / 0.5 AS x1 FROM bk),
    walk AS (
        SELECT cod_terminal, bucket_15min, x0, x1, nodes.* FROM x, nodes WHERE nodo = 0
        UNION ALL
        SELECT cod_terminal, bucket_15min, x0, x1, n.* FROM walk w JOIN nodes n ON n.arbol = w.arbol
            AND n.nodo = CASE WHEN CASE w.variable WHEN 0 THEN x0 ELSE x1 END <= w.corte THEN w.izquierda ELSE w.derecha END
        WHERE w.variable >= 0),
    scored AS (
        SELECT cod_terminal, bucket_15min, -pow(2, -avg(hondura + {_mean_depth("filas")}) / ({_mean_depth("16")})) AS score_modelo
        FROM walk WHERE variable < 0 GROUP BY ALL)
    SELECT cod_terminal, bucket_15min, score_modelo, score_modelo < -0.5 AS es_anomalia,
           least(greatest((1 - (score_modelo + 0.8) / 0.5) * 100, 0), 100)::DOUBLE AS score_anomalia FROM scored"""


@query("m04_small_forest", with_tables("bk", rounded_sql(SMALL_SQL, "score_modelo score_anomalia", 8)))
def _(spark, sf):
    rows = r.bucket_totals(t.rollup(spark, sf)).select("cod_terminal", "bucket_15min", *SMALL_FOREST.features)
    return rounded(SMALL_FOREST.transform(rows).drop(*SMALL_FOREST.features), digits=8)


# -- duplicates ----------------------------------------------------------------------------------------------


@query(
    "w10_first_per_key",
    with_tables(
        "tx",
        "SELECT id_tlf // 4 AS id, tipo_operacion, arg_min(fecha_transaccion, id_tlf) AS fecha_transaccion,"
        " arg_min(valor_transaccion, id_tlf) AS valor_transaccion, min(id_tlf) AS id_tlf FROM tx GROUP BY 1, 2",
    ),
)
def _(spark, sf):
    rows = t.transactions(spark, sf).select(
        F.floor(F.col("id_tlf") / 4).alias("id"), "tipo_operacion", "fecha_transaccion", "valor_transaccion", "id_tlf"
    )
    return first_per_key(rows, ["id", "tipo_operacion"], [F.col("id_tlf")])
