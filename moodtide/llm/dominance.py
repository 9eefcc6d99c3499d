r"""op11: dominance counting by a distributed range tree.

A point is above another if its x is smaller than or equal to the other's and its y is strictly larger.

1. Points are added up to cells of equal (x, y): their number and their weight. A hot point is one cell after the partial sums.
2. x counts from its least value. A cell emits those of its dyadic ancestors (height h, x >> h) that can be part of a prefix: the left
   children. As a query it emits the canonical nodes that make up all x up to its own: one for each set bit of x + 1.
3. Cells of one node and y are added up. Nodes are sorted by falling y, queries before points of their own y, and a
   running sum of numbers and weights that begins again at each node gives each query what its node holds above it. The sums are a prefix scan over
   ranges of (node, y, x), so that a node is cut wherever it is large: the root is no single task.
4. A query's nodes are added up by cell, and cells are joined back to the rows; adaptive execution splits the rows of a hot cell.

Nothing that grows with the input goes through one task, to the driver or into a broadcast: the driver sees the least and greatest x, and a row for each range.

A null x or y: above none, its own counts are null. Every row is a point of its own, repeated rows and equal ids too. Rows without a sale_id are sales of one row each.
A total that is NaN, infinite or of 9e16 or more has no level. Other columns of the input stay as they are. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.llm import common
from moodtide.operators.scan import scan

#: Bits of a node's place in its height; heights stand above them.
PLACE_BITS = 56


def _above(cells: DataFrame, low: int, heights: int) -> DataFrame:
    """(x, y, n_above, w_above) of every cell(x, y, n, w); x - low has fewer than ``heights`` bits."""
    placed = cells.select("*", (F.col("x") - F.lit(low)).alias("at")).select("*", (F.col("at") + 1).alias("upto"))
    left = F.expr(f"filter(sequence(0, {heights - 1}), h -> shiftright(at, h) & 1L = 0L)")
    held = placed.select("*", F.explode(left).alias("h")).select(F.expr(f"shiftleft(cast(h as long), {PLACE_BITS}) | shiftright(at, h)").alias("node"), "y", "n", "w")
    held = held.groupBy("node", "y").agg(F.sum("n").alias("n"), F.sum("w").alias("w"))
    parts = F.expr(f"filter(sequence(0, {heights - 1}), h -> shiftright(upto, h) & 1L = 1L)")
    asked = placed.select("x", "y", "upto", F.explode(parts).alias("h")).select(F.expr(f"shiftleft(cast(h as long), {PLACE_BITS}) | (shiftright(upto, h) - 1L)").alias("node"), "y", "x")
    zero = F.lit(0).cast("long")
    both = asked.select("node", "y", "x", zero.alias("n"), zero.alias("w")).union(held.select("node", "y", F.lit(None).cast("long"), "n", "w"))
    rows = scan(both, ["node", F.desc("y"), F.asc_nulls_last("x")], by=["node"], sums=["n", "w"])
    return rows.where("x IS NOT NULL").groupBy("x", "y").agg(F.sum("run_n").alias("n_above"), F.sum("run_w").alias("w_above"))


def dominance_counts(points: DataFrame, x: str = "x", y: str = "y", weight: str = "weight", n_above: str = "n_above", w_above: str = "w_above") -> DataFrame:
    """points with n_above and w_above: number and weight of the points above each. x, y and weight are whole numbers; a null weight counts as 0.

    Columns of points that have these names give way to the new ones.
    """
    common.ship(points.sparkSession)
    p = points.select(F.col(x).cast("long").alias("x"), F.col(y).cast("long").alias("y"), F.coalesce(F.col(weight).cast("long"), F.lit(0)).alias("w")).where("x IS NOT NULL AND y IS NOT NULL")
    cells = common.written(p.groupBy("x", "y").agg(F.count("*").alias("n"), F.sum("w").alias("w")), "cells")
    low, high = cells.agg(F.min("x"), F.max("x")).first()
    if low is None:
        low = high = 0
    if high - low >= 1 << PLACE_BITS:
        raise ValueError(f"x spans more than 2**{PLACE_BITS} values")
    above = common.written(_above(cells, low, (high - low + 1).bit_length()), "above")
    common.discard(cells)
    gx, gy = common.fresh(points, "cell_x"), common.fresh(points, "cell_y")
    kept = [c for c in points.columns if c.lower() not in (n_above.lower(), w_above.lower())]
    left = points.select(*kept, F.col(x).cast("long").alias(gx), F.col(y).cast("long").alias(gy))
    # a hot cell's rows are the left side of a sort merge join, which adaptive execution splits
    return left.join(above.toDF(gx, gy, n_above, w_above).hint("merge"), [gx, gy], "left").select(*kept, n_above, w_above)


def slot_of(df: DataFrame, column: str) -> Column:
    """Hours since 1970 of a timestamp, one without a zone taken as UTC in any session zone."""
    if isinstance(df.schema[column].dataType, T.TimestampType):
        return F.expr(f"cast(floor(unix_seconds(`{column}`) / 3600) as long)")
    local = F.col(column).cast("timestamp_ntz")
    return F.unix_date(local.cast("date")).cast("long") * 24 + F.hour(local)


def level_of(total: Column) -> Column:
    """Whole currency units of the total rounded to cents, in doubles; null where it is no number of 64 bits."""
    cents = F.floor(100 * total.cast("double") + 0.5).cast("double")
    fits = F.abs(total.cast("double")) < 9e16  # false for infinities, and null or NaN below
    return F.when(fits & ~F.isnan(total.cast("double")), F.floor(cents / 100))


def sale_points(sales: DataFrame) -> DataFrame:
    """sale_id, slot, level and the rows that each sale stands for."""
    crc = F.crc32(F.col("sale_id").cast("string").cast("binary"))
    return sales.select("sale_id", slot_of(sales, "sold_at").alias("slot"), level_of(F.col("total")).alias("level"), (1 + F.coalesce(crc % 2, F.lit(0))).alias("rows"))


def op11_dominance(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = sale_points(common.table(spark, sf_dir, "sales"))
    return dominance_counts(points, "slot", "level", "rows", "n_sales", "n_rows").select("sale_id", "slot", "level", "n_sales", "n_rows")


ORACLE = """
WITH RECURSIVE byte(i, x, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM byte WHERE k < 8),
crc AS (SELECT list(x ORDER BY i) AS t FROM byte WHERE k = 8),
s AS (SELECT sale_id, floor(floor(epoch(sold_at)) / 3600)::BIGINT AS slot, floor(floor(100 * total + 0.5) / 100)::BIGINT AS level,
             1 + coalesce(xor(list_reduce(list_concat([4294967295], list_transform(string_split(sale_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
                                          lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 2, 0) AS n
      FROM sales, crc),
cells AS (SELECT slot, level, count(*) AS sales, sum(n) AS n FROM s WHERE slot IS NOT NULL AND level IS NOT NULL GROUP BY 1, 2),
above AS (SELECT q.slot, q.level, sum(p.sales)::BIGINT AS sales, sum(p.n)::BIGINT AS n FROM cells q JOIN cells p ON p.slot <= q.slot AND p.level > q.level GROUP BY 1, 2)
SELECT s.sale_id, s.slot, s.level, CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(above.sales, 0) END AS n_sales,
       CASE WHEN s.slot IS NOT NULL AND s.level IS NOT NULL THEN coalesce(above.n, 0) END AS n_rows
FROM s LEFT JOIN above USING (slot, level)
"""
