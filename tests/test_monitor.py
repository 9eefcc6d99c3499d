"""The progress listener."""

import datetime as dt
from types import SimpleNamespace as N

from pyspark.sql import functions as F

from moodtide.streaming import monitor

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.UTC)


def at(minutes):
    return (T0 + dt.timedelta(minutes=minutes)).strftime("%Y-%m-%dT%H:%M:%S.000Z")


def test_states_and_alerts(spark, tmp_path):
    told = []
    m = monitor.RunMonitor(str(tmp_path / "runs"), lambda run, what: told.append((run, what)), stall_minutes=35)
    for name in ("a", "b", "c"):
        m.onQueryStarted(N(id=f"id-{name}", name=name, timestamp=at(0)))
    progress = lambda name, minute, rows: m.onQueryProgress(N(progress=N(id=f"id-{name}", timestamp=at(minute), numInputRows=rows)))
    progress("a", 1, 10)
    progress("a", 2, 0)
    progress("b", 1, 0)
    progress("b", 2, 7)
    m.onQueryTerminated(N(id="id-a", exception=None))
    m.onQueryTerminated(N(id="id-c", exception="boom"))
    m.check(T0 + dt.timedelta(minutes=30))
    m.check(T0 + dt.timedelta(minutes=60))
    m.check(T0 + dt.timedelta(minutes=61))
    rows = {r["run"]: r for r in monitor.states(spark, str(tmp_path / "runs"), F.lit(at(5)).cast("timestamp")).collect()}
    assert {k: (r["status"], r["batches"], r["rows"], r["complete"]) for k, r in rows.items()} == {"a": ("finished", 2, 10, True), "b": ("stalled", 2, 7, False), "c": ("failed", 0, 0, True)}
    assert told == [("b", "empty first page"), ("c", "failed"), ("b", "stalled")]
    progress("b", 62, 1)
    m.check(T0 + dt.timedelta(minutes=63))
    late = monitor.states(spark, str(tmp_path / "runs"), F.lit(at(64)).cast("timestamp")).where("run = 'b'").first()
    assert (late["status"], late["complete"], late["alerts"]) == ("running", True, ["empty first page", "stalled"])
