"""What becomes of streaming runs: a progress listener that keeps the state of each run in a table and alerts once.

A run is a named streaming query. After each batch its file below ``folder`` says when it began, when its last batch was, its batches and rows, and how it ended. ``check`` finds runs whose last batch
is too long ago; ``states`` reads the table: a run that has ended or is older than ``complete_minutes`` counts as complete.
"""

from __future__ import annotations

import datetime as dt
import json
import threading
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from moodtide.operators.runs import is_complete
from moodtide.sources.pages import _opened, _put

COMPLETE_MINUTES, STALL_MINUTES = 10, 35
SCHEMA = "run string, query_id string, began timestamp, last_batch timestamp, batches long, rows long, status string, alerts array<string>"


def _now() -> dt.datetime:
    return dt.datetime.now(dt.UTC)


class RunMonitor(StreamingQueryListener):
    """Alerts by ``alert(run, what)``, once for each run and each of: "empty first page", "stalled", "failed"."""

    def __init__(self, folder: str, alert: Callable[[str, str], None], stall_minutes: float = STALL_MINUTES):
        self.folder, self.alert, self.stall = folder, alert, dt.timedelta(minutes=stall_minutes)
        self.runs: dict[str, dict] = {}
        self.lock = threading.RLock()

    def _keep(self, r: dict) -> None:
        io, path = _opened(self.folder)
        io.create_dir(path, recursive=True)
        _put(io, f"{path}/{r['query_id']}.json", json.dumps(r).encode())

    def _tell(self, r: dict, what: str) -> None:
        if what not in r["alerts"]:
            r["alerts"].append(what)
            self.alert(r["run"], what)

    def onQueryStarted(self, event) -> None:
        with self.lock:
            at = str(event.id)
            old = self.runs.get(at, {"began": event.timestamp, "last_batch": event.timestamp, "batches": 0, "rows": 0, "alerts": []})
            self.runs[at] = old | {"run": event.name or at, "query_id": at, "status": "running"}
            self._keep(self.runs[at])

    def onQueryProgress(self, event) -> None:
        p = event.progress
        with self.lock:
            if (r := self.runs.get(str(p.id))) is None:
                return
            if r["batches"] == 0 and p.numInputRows == 0:
                self._tell(r, "empty first page")
            r |= {"last_batch": p.timestamp, "batches": r["batches"] + 1, "rows": r["rows"] + p.numInputRows}
            self._keep(r)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.lock:
            if (r := self.runs.get(str(event.id))) is None:
                return
            r["status"] = "failed" if event.exception else "finished"
            if event.exception:
                self._tell(r, "failed")
            self._keep(r)

    def check(self, now: dt.datetime | None = None) -> None:
        """Marks and tells of runs without a batch for too long; one that goes on later is running again."""
        with self.lock:
            for r in self.runs.values():
                if r["status"] in ("running", "stalled"):
                    late = (now or _now()) - dt.datetime.fromisoformat(r["last_batch"]) > self.stall
                    r["status"] = "stalled" if late else "running"
                    if late:
                        self._tell(r, "stalled")
                    self._keep(r)


def states(spark: SparkSession, folder: str, now: Column, complete_minutes: int = COMPLETE_MINUTES) -> DataFrame:
    """The table of runs, and whether each is complete."""
    rows = spark.read.schema(SCHEMA).option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSX").json(folder)
    return rows.withColumn("complete", F.col("status").isin("finished", "failed") | is_complete(F.col("began"), now, complete_minutes))
