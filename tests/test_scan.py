"""The prefix scan against plain windows."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from moodtide.operators.scan import scan


def test_scan_equals_windows(spark):
    r = random.Random(5)
    rows = [(r.choice(["a", "b", None, "hot", "hot", "hot"]), i, r.choice([None, r.randrange(-9, 99)]), r.random(), r.choice([None, "x", "y"])) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, i int, n int, d double, s string").repartition(5)
    order, grouped = Window.orderBy(F.desc("i")), Window.partitionBy("g").orderBy("i")
    got = scan(df, [F.desc("i")], sums=["n"], prevs=["s", "n"], row="row", parts=7)
    want = df.withColumn("row", F.row_number().over(order)).withColumn("run_n", F.coalesce(F.sum("n").over(order), F.lit(0))).withColumn("prev_s", F.lag("s").over(order)).withColumn("prev_n", F.lag("n").over(order))
    assert sorted(got.collect(), key=lambda x: x["i"]) == sorted(want.collect(), key=lambda x: x["i"])
    got = scan(df, ["g", "i"], by=["g"], sums=["n", "d"], prevs=["d"], parts=7)
    want = df.withColumn("run_n", F.coalesce(F.sum("n").over(grouped), F.lit(0))).withColumn("run_d", F.sum("d").over(grouped)).withColumn("prev_d", F.lag("d").over(grouped))
    for x, y in zip(sorted(got.collect(), key=lambda x: x["i"]), sorted(want.collect(), key=lambda x: x["i"]), strict=True):
        assert (x["i"], x["run_n"], x["prev_d"]) == (y["i"], y["run_n"], y["prev_d"]) and abs(x["run_d"] - y["run_d"]) < 1e-9


def test_scan_of_nothing_and_without_a_single_task(spark):
    empty = spark.createDataFrame([], "i int, n long")
    assert scan(empty, ["i"], sums=["n"], row="row").collect() == []
    plan = scan(spark.range(1000).withColumn("n", F.lit(1)), ["id"], sums=["n"], prevs=["id"], row="row")._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan
