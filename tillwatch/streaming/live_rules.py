"""The sequence and rate rules on transactions as they arrive.

Rates need what a machine did shortly before: keyed state holds its rows until the watermark has passed
them, and then counts over what lies before. A withdrawal after a PIN change is an interval join of two streams.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from tillwatch.operators.behaviour import KEY, TS, withdrawal
from tillwatch.operators.transactions import MAX_WITHDRAWAL
from tillwatch.plans.skew import micros
from tillwatch.schemas import PIN_CHANGE
from tillwatch.session import STATE_STORE

HITS = "regla string, id_tlf bigint, cod_terminal int, instante bigint, valor double"


class RateRule(NamedTuple):
    """More than so much within the past seconds: of PIN changes, of withdrawn money, or of transactions."""

    name: str
    of: str
    more_than: float
    seconds: int


RATE_RULES = [
    RateRule("cambios_pin", "cambio", 5, 3600),
    RateRule("retiro_grande", "retiro", MAX_WITHDRAWAL, 600),
    RateRule("velocidad", "todas", 10, 60),
]
ROWS = "instante bigint, id bigint, cambio boolean, retiro double, visto boolean"


def rate_hits(rows: pd.DataFrame, rules: list[RateRule], fresh: np.ndarray) -> pd.DataFrame:
    """The ``fresh`` rows of a machine (ordered by time) that meet a rule; rows of one time see each other."""
    found = []
    for rule in rules:
        amount = rows["retiro"].to_numpy() if rule.of == "retiro" else np.ones(len(rows))
        inside = {"cambio": rows["cambio"].to_numpy(bool), "retiro": rows["retiro"].notna().to_numpy(), "todas": np.ones(len(rows), bool)}[rule.of]
        at, amount, own = rows["instante"].to_numpy()[inside], amount[inside], rows[inside]
        sums = np.concatenate(([0.0], np.cumsum(amount)))
        value = sums[np.searchsorted(at, at, "right")] - sums[np.searchsorted(at, at - rule.seconds * 1_000_000, "left")]
        hit = (value > rule.more_than) & fresh[inside]
        found.append(pd.DataFrame({"regla": rule.name, "id_tlf": own["id"][hit], "instante": at[hit], "valor": value[hit]}))
    return pd.concat(found)


class LookBack(StatefulProcessor):
    """State: rows of a machine that are not yet final, and final ones that later rows still look back to.

    A row is final once the watermark has passed it, as nothing before it can arrive any more. Timers stand
    at the first row that is not, and, when there is none, at the time from which no row is needed.
    """

    def __init__(self, rules: list[RateRule]) -> None:
        self.rules, self.reach = rules, max(r.seconds for r in rules) * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("rows", ROWS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        arrived = pd.concat(list(rows))
        self.held.appendList([(int(at), int(i), bool(pin), None if pd.isna(paid) else float(paid), False) for at, i, pin, paid in zip(arrived["instante"], arrived["id_tlf"], arrived["cambio"], arrived["retiro"])])
        self.handle.registerTimer(-(-int(arrived["instante"].min()) // 1000))
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = pd.DataFrame(list(self.held.get()) if self.held.exists() else [], columns=["instante", "id", "cambio", "retiro", "visto"])
        rows = rows.sort_values("instante", kind="stable", ignore_index=True)
        final = rows["instante"] <= passed
        fresh = (final & ~rows["visto"].astype(bool)).to_numpy()
        rows["visto"] = final
        kept = rows[rows["instante"] > passed - self.reach]
        if len(kept):
            self.held.put([(int(at), int(i), bool(pin), None if pd.isna(paid) else float(paid), bool(seen)) for at, i, pin, paid, seen in kept.itertuples(index=False)])
            open_ = kept["instante"][~kept["visto"].astype(bool)]
            self.handle.registerTimer(-(-int(open_.min()) // 1000) if len(open_) else int(kept["instante"].max() + self.reach) // 1000 + 1)
        else:
            self.held.clear()
        if fresh.any():
            hits = rate_hits(rows[final], self.rules, fresh[final.to_numpy()])
            hits["cod_terminal"] = key[0]
            yield hits[["regla", "id_tlf", "cod_terminal", "instante", "valor"]]


def arriving(transactions: DataFrame, lateness: str) -> DataFrame:
    """Transactions with a watermark, each id once; those without id, machine or time are left out."""
    timed = transactions.withColumn(TS, F.col(TS).cast("timestamp")).dropna(subset=["id_tlf", KEY, TS])
    return timed.withWatermark(TS, lateness).dropDuplicatesWithinWatermark(["id_tlf"])


def live_rates(transactions: DataFrame, lateness: str = "10 minutes", rules: list[RateRule] | None = None) -> DataFrame:
    """Stream of (regla, id_tlf, cod_terminal, fecha_transaccion, valor): what meets a rate rule.

    Equal to ``frequent_pin_changes``, ``large_withdrawals`` and ``high_rate`` over all rows that were not later than ``lateness``;
    a row is told once the watermark has passed it. Later rows are dropped. A repeated id counts once, if it
    repeats within ``lateness``. The state of a machine is what it did within the longest rule and ``lateness``.
    """
    transactions.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = arriving(transactions, lateness).select(
        KEY,
        TS,
        "id_tlf",
        micros(TS).alias("instante"),
        F.coalesce(F.col("tipo_operacion") == PIN_CHANGE, F.lit(False)).alias("cambio"),
        F.when(withdrawal(), F.col("valor_transaccion")).alias("retiro"),
    )
    hits = rows.groupBy(KEY).transformWithStateInPandas(LookBack(rules or RATE_RULES), HITS, "Append", "EventTime")
    return hits.withColumn(TS, F.timestamp_micros("instante").cast("timestamp_ntz")).drop("instante")


def live_pin_withdrawals(transactions: DataFrame, lateness: str = "10 minutes", seconds: int = 300) -> DataFrame:
    """Stream of withdrawals less than ``seconds`` after the last PIN change at the machine, in the columns of ``live_rates``.

    An interval join of the two kinds of rows, with the watermark on both sides, so state is kept for ``seconds`` and ``lateness``
    only. ``valor`` is the seconds since the last change.
    """
    rows = arriving(transactions, lateness)
    changes = rows.where(F.col("tipo_operacion") == PIN_CHANGE).select(F.col(KEY).alias("_cajero"), F.col(TS).alias("cambio_pin"))
    paid = rows.where(withdrawal()).select("id_tlf", KEY, TS)
    near = (F.col(KEY) == F.col("_cajero")) & (F.col("cambio_pin") <= F.col(TS)) & (F.col("cambio_pin") > F.col(TS) - F.expr(f"INTERVAL {seconds} SECONDS"))
    # The time of the change as a number: a stream that is summed may have one time column with a watermark.
    met = paid.join(changes, near).select("id_tlf", KEY, TS, micros("cambio_pin").alias("cambio_pin"))
    last = met.groupBy("id_tlf", KEY, TS).agg(F.max("cambio_pin").alias("cambio_pin"))
    waited = (micros(TS) - F.col("cambio_pin")) / F.lit(1_000_000)
    return last.select(F.lit("pin_y_retiro").alias("regla"), "id_tlf", KEY, waited.alias("valor"), F.col(TS).cast("timestamp_ntz").alias(TS))


def maintain_live_hits(hits: DataFrame, target: str, checkpoint: str, every: str = "1 minute", once: bool = False) -> StreamingQuery:
    """Append hits to the table at ``target``, by day, each once."""
    writer = hits.withColumn("dia", F.to_date(TS)).writeStream.outputMode("append").format("parquet").partitionBy("dia")
    writer = writer.option("path", target).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()
