"""The driver's tables as domain tables, in Spark and as SQL common table expressions.

Amounts are whole pesos, so sums do not depend on the order of addition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwatch.operators.alerts import expected_amount, severity
from tillwatch.operators.buckets import with_bucket_calendar, with_machine_z
from tillwatch.operators.machine_profile import machine_profile
from tillwatch.operators.rollup import bucket_totals, rollup_transactions
from tillwatch.schemas import ADMIN_CODES, ALERT_COLUMNS, OPERATION_CODES

TYPES = {
    "purchase": "Retiro",
    "click": "Avance",
    "signup": "Cambio De Pin",
    "view": "Depositos",
    "error": "Retiro",
}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _map(values: dict, key):
    return F.try_element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), key)


def _cases(values: dict, key):
    """The same as a chain of cases, which a filter on the result can reach through."""
    chain = F.lit(None)
    for name, value in reversed(values.items()):
        chain = F.when(key == name, value).otherwise(chain)
    return chain


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transactions_of(load(spark, sf_dir, "events"))


def transactions_of(events: DataFrame) -> DataFrame:
    """Transactions of an events table or stream."""
    events = events.select("event_id", "ts", "user_id", "event_type", "value")
    event, kind = F.col("event_id"), _cases(TYPES, F.col("event_type"))
    amount = F.round(F.col("value") * 10000, 0)
    return events.select(
        event.alias("id_tlf"),
        F.col("ts").cast("timestamp_ntz").alias("fecha_transaccion"),
        F.col("user_id").cast("int").alias("cod_terminal"),
        F.when(event % 50 == 0, None)
        .when(event % 50 == 1, "")
        .otherwise(F.concat(F.lit("AUT"), event % 7))
        .alias("autorizador"),
        kind.alias("tipo_operacion"),
        F.when(F.col("event_type") == "error", 2).otherwise(1).alias("cod_estado_transaccion"),
        _map(OPERATION_CODES, kind).alias("cod_tipo_operacion"),
        F.col("event_type").alias("operacion"),
        F.lit("ATM").alias("canal"),
        F.concat(F.lit("CONV"), event % 3).alias("tipo_convenio"),
        F.concat(F.lit("ADQ"), event % 4).alias("adquiriente"),
        amount.alias("valor_transaccion"),
        (amount - F.when(event % 40 == 0, 5000.0).otherwise(0.0)).alias("valor_transaccion_original"),
        F.lit(1).alias("cantidad_tx"),
        F.lit(0).alias("duplicado"),
        F.date_add(F.to_date("ts"), F.when(event % 10 == 0, 1).otherwise(0)).alias("fecha_negocio"),
        F.concat(F.lit("2024/0"), F.floor((F.dayofmonth("ts") - 1) / 10) + 1).alias("mes_origen"),
    )


def machines(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    region = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    key = F.col("c_custkey")
    places = nation.join(F.broadcast(region), nation.n_regionkey == region.r_regionkey)  # 25 x 5 rows
    customer = load(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    located = F.when(key % 17 != 0, F.lit(1.0))
    return customer.join(F.broadcast(places), customer.c_nationkey == places.n_nationkey, "left").select(
        key.cast("string").alias("codigo"),
        (located * (4.0 + (key % 40) * 0.004)).alias("latitud"),
        (located * (-74.0 + F.floor(key / 40) * 0.004)).alias("longitud"),
        F.col("n_name").alias("municipio_dane"),
        F.col("r_name").alias("departamento"),
        (key % 3 == 0).alias("cierre_nocturno"),
        (key % 2 == 0).alias("cajero_adyacente_oficina"),
        F.when(key % 4 == 0, "06:00").when(key % 4 == 1, "18:00").alias("hora_apertura_atm"),
        F.when(key % 4 == 0, "22:00").when(key % 4 == 1, "02:00").alias("hora_cierre_atm"),
    )


def dispensed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dispensed_of(load(spark, sf_dir, "events"))


def dispensed_of(events: DataFrame) -> DataFrame:
    """Dispensing records of an events table or stream."""
    code = (F.col("event_id") % 10 + 1).cast("int")
    amount = F.round(F.col("value") * 10000, 0)
    n100 = F.floor(amount / 100000)
    n50 = F.floor((amount - n100 * 100000) / 50000)
    n20 = F.floor((amount - n100 * 100000 - n50 * 50000) / 20000)
    return events.select(
        "event_id",
        F.col("user_id").cast("string").alias("cod_cajero"),
        F.col("ts").cast("timestamp_ntz").alias("fecha_hora"),
        code.alias("cod_admin_efectivo"),
        F.coalesce(_map(ADMIN_CODES, code), F.lit("Desconocido")).alias("tipo_admin"),
        amount.alias("monto_total"),
        n20.cast("int").alias("billetes_20k"),
        n50.cast("int").alias("billetes_50k"),
        n100.cast("int").alias("billetes_100k"),
        *[F.lit(0).alias(f"billetes_{d}k") for d in (10, 5, 2, 1)],
    )


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup_transactions(transactions(spark, sf_dir))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return machine_profile(rollup(spark, sf_dir), ("basic",))


def scored_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bucket totals with calendar, machine z-score and a score of 20 points per unit of it."""
    rows = with_machine_z(with_bucket_calendar(bucket_totals(rollup(spark, sf_dir), with_baseline=True)))
    return rows.withColumn("score_anomalia", F.least(F.lit(100.0), 20 * F.abs("z_score_vs_cajero")))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets scored 30 or more, as alerts detected a quarter of an hour later."""
    z, score = F.col("z_score_vs_cajero"), F.col("score_anomalia")
    label = severity(score, z)
    rows = scored_buckets(spark, sf_dir).filter(score >= 30)
    return rows.select(
        F.col("cod_terminal").cast("string").alias("cod_cajero"),
        F.col("bucket_15min").alias("fecha_hora"),
        F.lit("isolation_forest").alias("tipo_anomalia"),
        label.alias("severidad"),
        score,
        F.col("monto_total_dispensado").alias("monto_dispensado"),
        expected_amount(F.col("monto_total_dispensado"), z).alias("monto_esperado"),
        F.abs(z).alias("desviacion_std"),
        F.concat(F.lit("Alerta "), label).alias("descripcion"),
        F.lit("z").alias("razones"),
        F.lit("z").alias("modelo_usado"),
        (F.col("bucket_15min") + F.expr("INTERVAL '15' MINUTE")).alias("fecha_deteccion"),
    ).select(*ALERT_COLUMNS)


def level_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same alerts with the other severity vocabulary."""
    names = {"critico": "Crítico", "alto": "Advertencia", "medio": "Sospechoso"}
    return alerts(spark, sf_dir).withColumn("severidad", _map(names, F.col("severidad")))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.least(F.lit(1.0), F.col("valor_transaccion") / 4_000_000)
    level = F.when(score >= 0.8, "Crítico").when(score >= 0.5, "Advertencia").otherwise("Sospechoso")
    return (
        transactions(spark, sf_dir)
        .select(F.col("id_tlf").alias("id_transaccion"), score.alias("score_final"), level.alias("nivel_anomalia"))
        .filter(F.col("score_final") >= 0.3)
    )


# -- the same tables in SQL ----------------------------------------------------------------------------------

NOTES = ["20k", "50k", "100k", "10k", "5k", "2k", "1k"]

CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "tx": (
        """
        SELECT event_id AS id_tlf, ts AS fecha_transaccion, CAST(user_id AS INTEGER) AS cod_terminal,
               CASE WHEN event_id % 50 = 0 THEN NULL WHEN event_id % 50 = 1 THEN ''
                    ELSE 'AUT' || (event_id % 7) END AS autorizador,
               CASE event_type WHEN 'purchase' THEN 'Retiro' WHEN 'click' THEN 'Avance'
                    WHEN 'signup' THEN 'Cambio De Pin' WHEN 'view' THEN 'Depositos' ELSE 'Retiro' END AS tipo_operacion,
               CASE WHEN event_type = 'error' THEN 2 ELSE 1 END AS cod_estado_transaccion,
               event_type AS operacion, 'ATM' AS canal, 'CONV' || (event_id % 3) AS tipo_convenio,
               'ADQ' || (event_id % 4) AS adquiriente,
               round(value * 10000) AS valor_transaccion,
               round(value * 10000) - CASE WHEN event_id % 40 = 0 THEN 5000 ELSE 0 END AS valor_transaccion_original,
               1 AS cantidad_tx, 0 AS duplicado,
               CAST(ts AS DATE) + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END AS fecha_negocio,
               '2024/0' || CAST((day(ts) - 1) // 10 + 1 AS VARCHAR) AS mes_origen
        FROM events""",
        (),
    ),
    "disp": (
        """
        SELECT *, time_bucket(INTERVAL '15 minutes', fecha_transaccion) AS fecha_transaccion_15min
        FROM tx WHERE tipo_operacion IN ('Retiro', 'Avance') AND cod_estado_transaccion = 1""",
        ("tx",),
    ),
    "mv": (
        """
        SELECT cod_terminal, fecha_transaccion_15min AS bucket_15min, tipo_operacion,
               count(*) AS num_transacciones, sum(valor_transaccion) AS monto_total_dispensado,
               avg(valor_transaccion) AS monto_promedio, max(valor_transaccion) AS monto_maximo,
               min(valor_transaccion) AS monto_minimo, stddev_samp(valor_transaccion) AS monto_std,
               avg(hour(fecha_transaccion)) AS hora_promedio,
               count(DISTINCT fecha_negocio) AS dias_unicos, max(fecha_transaccion) AS ultima_transaccion
        FROM disp GROUP BY ALL""",
        ("disp",),
    ),
    "bk": (
        """
        SELECT bucket_15min, cod_terminal, sum(monto_total_dispensado) AS monto_total_dispensado,
               CAST(sum(num_transacciones) AS BIGINT) AS num_transacciones
        FROM mv GROUP BY bucket_15min, cod_terminal""",
        ("mv",),
    ),
    "base": (
        """
        SELECT cod_terminal, avg(monto_total_dispensado) AS media, stddev_samp(monto_total_dispensado) AS des
        FROM mv GROUP BY cod_terminal""",
        ("mv",),
    ),
    "zb": (
        """
        SELECT bk.*, CAST(hour(bucket_15min) AS INTEGER) AS hora_del_dia,
               CAST(isodow(bucket_15min) AS INTEGER) AS dia_semana, CAST(month(bucket_15min) AS INTEGER) AS mes,
               isodow(bucket_15min) >= 6 AS es_fin_de_semana, day(bucket_15min) >= 28 AS es_fin_de_mes,
               (day(bucket_15min) BETWEEN 14 AND 16 OR day(bucket_15min) >= 29 OR day(bucket_15min) <= 1)
                   AS es_quincena,
               CASE WHEN des > 0 THEN (monto_total_dispensado - media) / des ELSE 0 END AS z_score_vs_cajero
        FROM bk LEFT JOIN base USING (cod_terminal)""",
        ("bk", "base"),
    ),
    "al": (
        """
        SELECT *, CASE WHEN (score_anomalia >= 80 AND desviacion_std >= 4) OR score_anomalia >= 85
                            OR desviacion_std >= 5 THEN 'critico'
                       WHEN score_anomalia >= 70 OR desviacion_std >= 3 THEN 'alto' ELSE 'medio' END AS severidad
        FROM (SELECT CAST(cod_terminal AS VARCHAR) AS cod_cajero, bucket_15min AS fecha_hora,
                     'isolation_forest' AS tipo_anomalia, least(100.0, 20 * abs(z_score_vs_cajero)) AS score_anomalia,
                     monto_total_dispensado AS monto_dispensado,
                     CASE WHEN z_score_vs_cajero = -1 THEN NULL
                          ELSE monto_total_dispensado / (1 + z_score_vs_cajero) END AS monto_esperado,
                     abs(z_score_vs_cajero) AS desviacion_std, 'z' AS razones, 'z' AS modelo_usado,
                     bucket_15min + INTERVAL '15 minutes' AS fecha_deteccion
              FROM zb)
        WHERE score_anomalia >= 30""",
        ("zb",),
    ),
    "lv": (
        """
        SELECT * REPLACE (CASE severidad WHEN 'critico' THEN 'Crítico' WHEN 'alto' THEN 'Advertencia'
                                         ELSE 'Sospechoso' END AS severidad) FROM al""",
        ("al",),
    ),
    "cj": (
        """
        SELECT CAST(c_custkey AS VARCHAR) AS codigo,
               CASE WHEN c_custkey % 17 <> 0 THEN 4.0::DOUBLE + (c_custkey % 40) * 0.004::DOUBLE END AS latitud,
               CASE WHEN c_custkey % 17 <> 0 THEN -74.0::DOUBLE + (c_custkey // 40) * 0.004::DOUBLE END AS longitud,
               n_name AS municipio_dane, r_name AS departamento,
               c_custkey % 3 = 0 AS cierre_nocturno, c_custkey % 2 = 0 AS cajero_adyacente_oficina,
               CASE c_custkey % 4 WHEN 0 THEN '06:00' WHEN 1 THEN '18:00' END AS hora_apertura_atm,
               CASE c_custkey % 4 WHEN 0 THEN '22:00' WHEN 1 THEN '02:00' END AS hora_cierre_atm
        FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey""",
        (),
    ),
    "de": (
        """
        SELECT event_id, CAST(user_id AS VARCHAR) AS cod_cajero, ts AS fecha_hora,
               CAST(event_id % 10 + 1 AS INTEGER) AS cod_admin_efectivo, round(value * 10000) AS monto_total,
               CAST(((m % 100000) % 50000) // 20000 AS INTEGER) AS billetes_20k,
               CAST((m % 100000) // 50000 AS INTEGER) AS billetes_50k, CAST(m // 100000 AS INTEGER) AS billetes_100k,
               0 AS billetes_10k, 0 AS billetes_5k, 0 AS billetes_2k, 0 AS billetes_1k
        FROM (SELECT *, CAST(round(value * 10000) AS BIGINT) AS m FROM events)""",
        (),
    ),
    "sc": (
        """
        SELECT id_tlf AS id_transaccion, least(1.0, valor_transaccion / 4000000) AS score_final,
               CASE WHEN least(1.0, valor_transaccion / 4000000) >= 0.8 THEN 'Crítico'
                    WHEN least(1.0, valor_transaccion / 4000000) >= 0.5 THEN 'Advertencia' ELSE 'Sospechoso' END
                   AS nivel_anomalia
        FROM tx WHERE least(1.0, valor_transaccion / 4000000) >= 0.3""",
        ("tx",),
    ),
}


def with_tables(names: str, body: str) -> str:
    """``body`` with the named common table expressions and those they need, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for needed in CTES[name][1]:
            visit(needed)
        if name not in order:
            order.append(name)

    for name in names.split():
        visit(name)
    joined = ",\n".join(f"{n} AS ({CTES[n][0]})" for n in order)
    return f"WITH {joined}\n{body}" if order else body


def rounded_sql(sql: str, columns: str, digits: int = 4) -> str:
    """``sql`` with the named columns rounded (and minus zero made zero)."""
    parts = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns.split())
    return f"SELECT * REPLACE ({parts}) FROM ({sql})"


def rounded(df: DataFrame, columns: str | None = None, digits: int = 4) -> DataFrame:
    """The same on the Spark side; without names all double columns."""
    names = columns.split() if columns else [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), digits) + F.lit(0.0) for c in names})
