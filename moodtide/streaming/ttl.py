"""Runs that live for a time: keyed state that emits while a run is alive, and again when it has run out.

Each row of a run renews it until ``days`` after its own time. State is kept by run; a timer at the end of its life drops it once the watermark has passed. Late rows that would not renew a run change nothing; a run that
comes again after its end begins anew. State needs the RocksDB store (``with_store``); it is as large as the runs that are alive.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from moodtide.schemas import RUN_TTL_DAYS

OUTPUT = "run_id string, kind string, rows long, until timestamp"
_DAY = 86_400_000


def with_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Lives(StatefulProcessor):
    """A row "alive" for each batch that renews a run, with its rows so far and its end; a row "evicted" at that end."""

    def __init__(self, milliseconds: int):
        self.milliseconds = milliseconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.life = handle.getValueState("life", "rows long, until long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held, until = self.life.get() if self.life.exists() else (0, None)
        n, last = 0, None
        for part in rows:
            n += len(part)
            newest = int(part["ms"].max())
            last = newest if last is None else max(last, newest)
        end = last + self.milliseconds
        if until is None or end > until:
            if until is not None:
                self.handle.deleteTimer(until)
            self.handle.registerTimer(end)
            until = end
        self.life.update((held + n, until))
        yield self._row(key, "alive", held + n, until)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, until = self.life.get()
        self.life.clear()
        yield self._row(key, "evicted", held, until)

    @staticmethod
    def _row(key, kind: str, rows: int, until: int) -> pd.DataFrame:
        return pd.DataFrame({"run_id": [key[0]], "kind": [kind], "rows": [rows], "until": [pd.Timestamp(until, unit="ms")]})

    def close(self) -> None:
        pass


def lives(rows: DataFrame, days: float = RUN_TTL_DAYS, ts: str = "created_at", late: str = "1 hour") -> DataFrame:
    """run_id, kind ("alive" or "evicted"), rows and until of a stream of rows(run_id, ts)."""
    stamped = rows.withWatermark(ts, late).select("run_id", F.col(ts), F.unix_millis(ts).alias("ms"))
    return stamped.groupBy("run_id").transformWithStateInPandas(Lives(int(days * _DAY)), outputStructType=OUTPUT, outputMode="append", timeMode="eventtime")
