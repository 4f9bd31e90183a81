"""Isolation forest on feature tables (Liu, Ting and Zhou, 2008).

Spark draws one small sample per tree by ranking row hashes, so the sample does
not depend on partitioning; each tree is grown in its own task; the node table
is small by construction and scores rows in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tillwatch.functions.numbers import finite
from tillwatch.plans.quantiles import exact_quantiles
from tillwatch.plans.strata import stratified_sample
from tillwatch.session import materialise

MAX_SAMPLE = 256
HASH_SPACE = 1 << 30
#: Rows that one task scores in training.
TASK_ROWS = 250_000
NODE_SCHEMA = "arbol int, nodo int, variable int, corte double, izquierda int, derecha int, filas int, hondura int"


def _hash_share(seed: int, *parts: Column | str) -> Column:
    """A number in [0, 1) that depends only on the seed and the given columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(HASH_SPACE)) / F.lit(float(HASH_SPACE))


def sample_rows(df: DataFrame, size: int, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Random sample of about ``size`` rows, the same for any partitioning; all rows when there are fewer."""
    total = df.count()
    return df if total <= size else df.filter(_hash_share(seed, *keys) < F.lit(size / total))


# -- preparation ---------------------------------------------------------------------------------------------


def as_numbers(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles: flags become 0/1, NaN and infinities become null."""
    types = dict(df.dtypes)
    return df.withColumns(
        {f: finite(F.col(f).cast("int") if types[f] == "boolean" else F.col(f)) for f in features}
    )


def fit_medians(numbers: DataFrame, features: Sequence[str]) -> dict[str, float]:
    medians = exact_quantiles(numbers, features, [0.5])
    return {f: 0.0 if medians[f][0] is None else float(medians[f][0]) for f in features}


def impute(numbers: DataFrame, values: dict[str, float]) -> DataFrame:
    return numbers.withColumns({f: F.coalesce(F.col(f), F.lit(v)) for f, v in values.items()})


def zero_fill(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Missing or non-finite features as 0, as done when a 15-minute file is scored."""
    return df.withColumns({f: F.coalesce(finite(F.col(f)), F.lit(0.0)) for f in features})


def fit_scaler(df: DataFrame, features: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per feature (a constant feature is only centred)."""
    row = df.agg(
        *[F.avg(f).alias(f"m_{f}") for f in features], *[F.stddev_pop(f).alias(f"s_{f}") for f in features]
    ).first()
    return {f: (float(row[f"m_{f}"] or 0.0), float(row[f"s_{f}"] or 0.0) or 1.0) for f in features}


def scale(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({f: (F.col(f) - F.lit(m)) / F.lit(s) for f, (m, s) in scaler.items()})


# -- trees ---------------------------------------------------------------------------------------------------


def _average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    harmonic = np.log(np.maximum(n - 1, 1)) + np.euler_gamma
    return np.where(n > 2, 2 * harmonic - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _grow(tree: int, x: np.ndarray, share: float, seed: int) -> pd.DataFrame:
    """Random splits of one sample until points are alone or the depth limit is met."""
    rng = np.random.default_rng([seed, tree])
    count = x.shape[1]
    usable = rng.choice(count, size=max(1, int(share * count)), replace=False)
    limit = math.ceil(math.log2(max(len(x), 2)))
    nodes: list[list] = []
    waiting = [(np.arange(len(x)), 0, -1, "")]
    while waiting:
        rows, depth, parent, side = waiting.pop()
        at = len(nodes)
        nodes.append([tree, at, -1, 0.0, -1, -1, len(rows), depth])
        if parent >= 0:
            nodes[parent][4 if side == "left" else 5] = at
        if depth >= limit or len(rows) < 2:
            continue
        low, high = x[rows][:, usable].min(axis=0), x[rows][:, usable].max(axis=0)
        varying = np.flatnonzero(high > low)
        if len(varying) == 0:
            continue
        pick = rng.choice(varying)
        cut = rng.uniform(low[pick], high[pick])
        left = x[rows, usable[pick]] <= cut
        if left.all():  # the draw met the upper end
            cut, left = low[pick], x[rows, usable[pick]] <= low[pick]
        nodes[at][2], nodes[at][3] = int(usable[pick]), float(cut)
        waiting.append((rows[~left], depth + 1, at, "right"))
        waiting.append((rows[left], depth + 1, at, "left"))
    return pd.DataFrame(
        nodes, columns=["arbol", "nodo", "variable", "corte", "izquierda", "derecha", "filas", "hondura"]
    )


def grow_trees(
    prepared: DataFrame, features: Sequence[str], keys: Sequence[str], trees: int, psi: int, share: float, seed: int
) -> DataFrame:
    """Node table of a forest: at most ``trees`` x (2 psi - 1) rows.

    Every row of the table may become a candidate of a few trees picked by hashes of its key,
    about 4 psi candidates per tree whatever the size of the table; a tree takes the psi candidates of lowest
    rank hash. A small table is offered whole to every tree.
    """
    features = list(features)
    total = prepared.count()
    per_row = 4 * psi * trees / max(total, 1)
    draws = math.ceil(per_row)
    # Fewer than one draw a row: so many rows draw once.
    pool = prepared if per_row >= 1 else prepared.filter(_hash_share(seed + 1, *keys) < F.lit(per_row))
    if draws >= trees / 2:
        drawn = F.sequence(F.lit(0), F.lit(trees - 1))
    else:
        picks = [F.pmod(F.xxhash64(F.lit(seed), F.lit(d), *keys), F.lit(trees)).cast("int") for d in range(draws)]
        drawn = F.array_distinct(F.array(*picks))
    picked = (
        pool.select(*keys, *features, F.explode(drawn).alias("arbol"))
        .withColumn(
            "_puesto",
            F.row_number().over(
                Window.partitionBy("arbol").orderBy(F.xxhash64(F.lit(seed + 2), "arbol", *keys), *keys)
            ),
        )
        .filter(F.col("_puesto") <= psi)
        .select("arbol", *keys, *features)
    )

    def grow(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(list(keys))
        return _grow(int(key[0]), rows[features].to_numpy(float), share, seed)

    return picked.groupBy("arbol").applyInPandas(grow, NODE_SCHEMA)


class _Paths:
    """Mean path length of rows through all trees, level by level over arrays."""

    def __init__(self, nodes: pd.DataFrame):
        self.trees = []
        for _, tree in nodes.sort_values(["arbol", "nodo"]).groupby("arbol"):
            leaf = tree["variable"].to_numpy() < 0
            self.trees.append(
                (
                    np.where(leaf, 0, tree["variable"].to_numpy()),
                    np.where(leaf, np.inf, tree["corte"].to_numpy()),
                    np.where(leaf, tree["nodo"], tree["izquierda"]).astype(np.int64),
                    np.where(leaf, tree["nodo"], tree["derecha"]).astype(np.int64),
                    tree["hondura"].to_numpy() + _average_path(tree["filas"].to_numpy()),
                    int(tree["hondura"].max()),
                )
            )

    def mean(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for variable, cut, left, right, length, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = np.where(x[rows, variable[at]] <= cut[at], left[at], right[at])
            total += length[at]
        return total / max(len(self.trees), 1)


@dataclass
class Forest:
    """A fitted forest: node table, preparation values and what it was fitted on."""

    features: list[str]
    medians: dict[str, float]
    scaler: dict[str, tuple[float, float]]
    nodes: pd.DataFrame
    psi: int
    offset: float = -0.5
    lowest: float = -1.0
    highest: float = 0.0
    metadata: dict = field(default_factory=dict)

    def raw_score(self) -> Column:
        """Score in [-1, 0] of rows whose features are prepared; lower is more anomalous."""
        nodes, normal = self.nodes, float(_average_path(np.array([self.psi]))[0]) or 1.0

        @F.pandas_udf("double")
        def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
            paths = _Paths(nodes)
            for columns in batches:
                x = np.column_stack([c.to_numpy(float) for c in columns])
                yield pd.Series(-np.exp2(-paths.mean(x) / normal))

        return score(*[F.col(f"_x_{f}") for f in self.features])

    def _prepared_inputs(self, df: DataFrame, fill_zero: bool) -> DataFrame:
        types = dict(df.dtypes)
        inputs = {}
        for f in self.features:
            value = finite(F.col(f).cast("int") if types[f] == "boolean" else F.col(f))
            filled = F.coalesce(value, F.lit(0.0 if fill_zero else self.medians[f]))
            mean, std = self.scaler[f]
            inputs[f"_x_{f}"] = (filled - F.lit(mean)) / F.lit(std)
        return df.withColumns(inputs)

    def transform(self, df: DataFrame, fill_zero: bool = False) -> DataFrame:
        """Add ``score_modelo``, ``es_anomalia`` and the 0-100 ``score_anomalia`` (100 = most anomalous)."""
        scored = self._prepared_inputs(df, fill_zero).withColumn("score_modelo", self.raw_score())
        scored = scored.drop(*[f"_x_{f}" for f in self.features])
        span = (self.highest - self.lowest) or 1.0
        inverted = (1 - (F.col("score_modelo") - F.lit(self.lowest)) / F.lit(span)) * 100
        return scored.withColumn("es_anomalia", F.col("score_modelo") < F.lit(self.offset)).withColumn(
            "score_anomalia", F.least(F.greatest(inverted, F.lit(0.0)), F.lit(100.0))
        )

    def save(self, spark: SparkSession, path: str) -> None:
        base = path.rstrip("/")
        spark.createDataFrame(self.nodes, NODE_SCHEMA).write.mode("overwrite").parquet(f"{base}/nodos")
        preparation = [
            (i, f, self.medians[f], *self.scaler[f]) for i, f in enumerate(self.features)
        ]
        spark.createDataFrame(
            preparation, "posicion int, variable string, mediana double, media double, desviacion double"
        ).write.mode("overwrite").parquet(f"{base}/preparacion")
        self.describe(spark).write.mode("overwrite").parquet(f"{base}/metadatos")

    def describe(self, spark: SparkSession) -> DataFrame:
        """The one-row metadata table."""
        m = self.metadata
        return spark.createDataFrame(
            [
                (
                    m.get("version", "2.0"),
                    m.get("total_registros_entrenamiento"),
                    m.get("contamination"),
                    m.get("random_state"),
                    m.get("fecha_datos_desde"),
                    m.get("fecha_datos_hasta"),
                    m.get("cajeros_unicos"),
                    self.psi,
                    self.offset,
                    self.lowest,
                    self.highest,
                )
            ],
            "version string, total_registros_entrenamiento bigint, contamination double, random_state int,"
            " fecha_datos_desde timestamp_ntz, fecha_datos_hasta timestamp_ntz, cajeros_unicos bigint,"
            " psi int, umbral double, score_minimo double, score_maximo double",
        )


def load_forest(spark: SparkSession, path: str) -> Forest:
    base = path.rstrip("/")
    nodes = spark.read.parquet(f"{base}/nodos").toPandas()  # trees x (2 psi - 1) rows at most
    rows = spark.read.parquet(f"{base}/preparacion").orderBy("posicion").collect()
    meta = spark.read.parquet(f"{base}/metadatos").first().asDict()
    return Forest(
        features=[r.variable for r in rows],
        medians={r.variable: r.mediana for r in rows},
        scaler={r.variable: (r.media, r.desviacion) for r in rows},
        nodes=nodes,
        psi=meta.pop("psi"),
        offset=meta.pop("umbral"),
        lowest=meta.pop("score_minimo"),
        highest=meta.pop("score_maximo"),
        metadata=meta,
    )


def training_summary(df: DataFrame, time: str = "bucket_15min", machine: str = "cod_terminal") -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("total_registros_entrenamiento"),
        F.min(time).alias("fecha_datos_desde"),
        F.max(time).alias("fecha_datos_hasta"),
        F.countDistinct(machine).alias("cajeros_unicos"),
    )


def fit_forest(
    df: DataFrame,
    features: Sequence[str],
    keys: Sequence[str],
    trees: int = 200,
    share: float = 0.8,
    contamination: float = 0.01,
    seed: int = 42,
    sample: int = 0,
    time: str = "bucket_15min",
    machine: str = "cod_terminal",
    strata: Sequence[str] = (),
) -> Forest:
    """Fit on all rows, or on about ``sample`` of them. The threshold is the ``contamination`` quantile of their scores.

    With ``strata``, such as month and machine, the sample has exactly ``sample`` rows, dealt over them in proportion.
    """
    features, keys = list(features), list(keys)
    if sample and strata:
        chosen = stratified_sample(df, strata, keys, sample, seed)
    else:
        chosen = sample_rows(df, sample, keys, seed) if sample else df
    extra = [c for c in (time, machine) if c not in keys and c not in features]
    # Spread by key: the rows are small in bytes but costly to score.
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, -(-chosen.count() // TASK_ROWS))
    spread = chosen.select(*keys, *extra, *features).repartition(tasks, *keys)
    numbers = materialise(as_numbers(spread, features), "training")
    summary: dict = training_summary(numbers, time, machine).first().asDict()
    medians = fit_medians(numbers, features)
    filled = impute(numbers, medians)
    scaler = fit_scaler(filled, features)
    total = int(summary["total_registros_entrenamiento"])
    psi = min(MAX_SAMPLE, total)
    nodes = grow_trees(scale(filled, scaler), features, keys, trees, psi, share, seed).toPandas()
    forest = Forest(features, medians, scaler, nodes, psi)
    scores = materialise(forest.transform(numbers).select("score_modelo"), "scores")
    forest.lowest, forest.highest = (float(v) for v in scores.agg(F.min("score_modelo"), F.max("score_modelo")).first())
    forest.offset = float(exact_quantiles(scores, ["score_modelo"], [contamination])["score_modelo"][0])
    forest.metadata = {
        **summary,
        "contamination": float(contamination),
        "random_state": seed,
        "version": "2.0",
        "fecha_entrenamiento": datetime.now(),
    }
    return forest


def fit_bucket_forest(features: DataFrame, contamination: float = 0.01, **options) -> Forest:
    """The bucket model: 200 trees, 80 % of the features per tree."""
    from tillwatch.schemas import BUCKET_MODEL_FEATURES

    return fit_forest(
        features,
        BUCKET_MODEL_FEATURES,
        ["cod_terminal", "bucket_15min"],
        **{"trees": 200, "share": 0.8, "contamination": contamination, **options},
    )


def fit_machine_forest(profile: DataFrame, contamination: float = 0.01, **options) -> Forest:
    """The machine model: 100 trees, all features, fitted on all machines."""
    from tillwatch.schemas import MACHINE_MODEL_FEATURES

    return fit_forest(
        profile,
        MACHINE_MODEL_FEATURES,
        ["cod_cajero"],
        **{
            "trees": 100,
            "share": 1.0,
            "contamination": contamination,
            "sample": 0,
            "time": "fecha_ultimo_dato",
            "machine": "cod_cajero",
            **options,
        },
    )


def training_check(scored: DataFrame) -> DataFrame:
    """Share flagged and the spread of the scores scaled to [0, 1]."""
    unit = F.col("score_anomalia") / 100
    return scored.agg(
        F.count(F.lit(1)).alias("registros"),
        F.count_if("es_anomalia").alias("anomalias"),
        (F.count_if("es_anomalia") / F.count(F.lit(1)) * 100).alias("pct_anomalias"),
        F.avg(unit).alias("score_promedio"),
        F.stddev_pop(unit).alias("score_std"),
        F.min(unit).alias("score_min"),
        F.max(unit).alias("score_max"),
    )
