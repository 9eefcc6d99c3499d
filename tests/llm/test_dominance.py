"""Dominance counts against brute force and SQL."""

import datetime as dt
import random
import zlib

import pytest
from pyspark.sql import functions as F

from moodtide.llm import dominance, registry
from tests.oracle import rows_of, sql_rows


def brute(points):
    """(number, weight) above each (x, y, weight)."""
    full = [(x, y, w or 0) for x, y, w in points if x is not None and y is not None]
    return [(None, None) if x is None or y is None else (sum(a <= x and b > y for a, b, _ in full), sum(w for a, b, w in full if a <= x and b > y)) for x, y, _ in points]


@pytest.mark.parametrize("seed, spread", [(1, 5), (2, 40), (3, 10**12)])
def test_counts_against_brute_force(spark, seed, spread):
    r = random.Random(seed)
    points = [(r.choice([None, *[r.randrange(-spread, spread)] * 9]), r.choice([None, *[r.randrange(-9, 60)] * 9]), r.choice([None, 1, 2, 7])) for _ in range(400)]
    points += [(3, 3, 2)] * 200 + [(0, 59, 1)] * 150  # hot cells
    df = spark.createDataFrame([(i, *p, "t", 5) for i, p in enumerate(points)], "id int, x long, y long, weight long, node string, n long").repartition(5)
    got = {r["id"]: (r["n_above"], r["w_above"]) for r in dominance.dominance_counts(df).collect()}
    assert [got[i] for i in range(len(points))] == brute(points)


def test_odd_tables(spark):
    schema = "x long, y long, weight long, w_above string, cell_x int"
    assert dominance.dominance_counts(spark.createDataFrame([], schema)).collect() == []
    only_nulls = dominance.dominance_counts(spark.createDataFrame([(None, 1, 1, "a", 1), (1, None, 1, "b", 2)], schema))
    assert only_nulls.columns == ["x", "y", "weight", "cell_x", "n_above", "w_above"] and all(r["n_above"] is None for r in only_nulls.collect())


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_slots_and_levels_in_any_zone(spark, zone):
    times = [None, dt.datetime(1969, 12, 31, 23, 59, 59, 500000), dt.datetime(1970, 1, 1), dt.datetime(2024, 3, 10, 2, 30), dt.datetime(2024, 11, 3, 1, 30), dt.datetime(1900, 1, 1, 5, 1)]
    totals = [None, 0.0, 0.994, 0.995, 19.99, -0.005, -3.2, float("nan"), float("inf"), 1e300]
    rows = [(None if i == 5 else i, times[i % len(times)], totals[i % len(totals)], "n") for i in range(60)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, "sale_id long, sold_at timestamp_ntz, total double, level string")
        got = sorted(dominance.sale_points(df).collect(), key=lambda r: (r["sale_id"] is None, r["sale_id"] or 0))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    import math

    epoch = dt.datetime(1970, 1, 1)
    for r, (i, at, total, _) in zip(got, sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)), strict=True):
        assert r["slot"] == (None if at is None else math.floor((at - epoch) / dt.timedelta(seconds=1)) // 3600)
        assert r["level"] == (None if total is None or not abs(total) < 9e16 else math.floor(math.floor(100 * total + 0.5) / 100))
        assert r["rows"] == 1 + (0 if i is None else zlib.crc32(str(i).encode()) % 2)


def test_sql_says_the_same_on_a_larger_table(spark):
    folder = "/root/testdata/sf0.01"
    assert rows_of(registry.QUERIES["op11_dominance"](spark, folder)) == sql_rows(dominance.ORACLE, folder)


def test_no_single_task_and_no_unbounded_broadcast(spark):
    df = spark.range(1000).select(F.col("id").alias("x"), (F.col("id") % 7).alias("y"), F.lit(1).alias("weight"))
    plan = dominance.dominance_counts(df)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "Broadcast" not in plan
