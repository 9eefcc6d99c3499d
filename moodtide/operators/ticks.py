"""Axis ticks as generated rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _dates(spark: SparkSession, start: str, end: str, sequence: str) -> DataFrame:
    s, e = f"TIMESTAMP '{start}'", f"TIMESTAMP '{end}'"
    return spark.sql(f"SELECT explode({sequence.format(s=s, e=e)}) AS tick")


def midnights(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Midnights in [start, end]."""
    day = "date_trunc('DAY', {s})"
    first = f"CASE WHEN {day} = {{s}} THEN {{s}} ELSE {day} + INTERVAL 1 DAY END"
    rows = _dates(spark, start, end, f"filter(sequence({day}, {{e}}, INTERVAL 1 DAY), x -> x >= {first})")
    return rows.select(F.col("tick"))


def months(spark: SparkSession, start: str, end: str) -> DataFrame:
    """First days of the months from the first's to the one after the last's."""
    return _dates(spark, start, end, "sequence(trunc({s}, 'MM'), add_months(trunc({e}, 'MM'), 1), INTERVAL 1 MONTH)")


def stepped(spark: SparkSession, start: str, end: str, days: int) -> DataFrame:
    """Days from the first's midnight by steps, within [start, end]."""
    return _dates(spark, start, end, f"filter(sequence(date_trunc('DAY', {{s}}), {{e}}, INTERVAL {days} DAY), x -> x >= {{s}} AND x <= {{e}})").select(F.to_date("tick").alias("tick"))


def biweekly(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Fortnightly days that are no month's first."""
    return stepped(spark, start, end, 14).join(months(spark, start, end), "tick", "left_anti")


def weekly(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weekly days that are neither a month's first nor fortnightly."""
    taken = months(spark, start, end).union(stepped(spark, start, end, 14))
    return stepped(spark, start, end, 7).join(taken, "tick", "left_anti")
