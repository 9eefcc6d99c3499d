"""Chart geometry as rows. The renderer (an SVG text) is a sink of few rows; nothing here draws."""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodtide.functions.sentiment import series_color
from moodtide.operators import series as Q
from moodtide.operators import ticks
from moodtide.schemas import COLOR_THRESHOLD


@dataclass(frozen=True)
class Canvas:
    width: float
    height: float
    padding: float
    left: float = 50.0
    bottom: float = 20.0

    @property
    def box(self) -> tuple[float, float, float, float]:
        """x, y, width and height of the plot."""
        return self.padding + self.left, self.padding, self.width - 2 * self.padding - self.left, self.height - 2 * self.padding - self.bottom


# The two canvases.
WEEKLY, YEARLY = Canvas(1200, 800, 80), Canvas(1500, 1000, 100, bottom=30.0)


# Dashes, and how far below the plot its ends are named. Colours are our own.
DASH, GAP, ENDS_BELOW = 8.0, 4.0, 50.0
COLORS = {"positive": "#2e8b57", "negative": "#b22222", "neutral": "#708090"}
BAND, GRID, AVERAGE = "#f2f2f2", "#cccccc", "#4169e1"


def y_of(value: Column, canvas: Canvas) -> Column:
    _, y, _, h = canvas.box
    return F.lit(y + h / 2) - ((value - F.col("center")) * F.col("scale") / 100) * (h / 2)


def _with_range(rows: DataFrame, series: DataFrame) -> DataFrame:
    return rows.crossJoin(F.broadcast(Q.y_range(series)))  # one row


def xy_points(series: DataFrame, canvas: Canvas = WEEKLY, v: str = "net_sentiment_percent") -> DataFrame:
    x, _, w, _ = canvas.box
    placed = _with_range(Q.with_position(series), series)
    return placed.select("timestamp", F.col(v).alias("value"), (F.lit(x) + F.col("position") * w).alias("x"), y_of(F.col(v), canvas).alias("y"), series_color(F.col(v)).alias("color"))


def grid_levels(series: DataFrame, canvas: Canvas = WEEKLY) -> DataFrame:
    """Levels at the least, centre and most, unless they lie in the neutral band; zero if in range; the centre always."""
    r = Q.y_range(series)
    named = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("level")) for k, c in (("min", F.col("y_min")), ("center", F.col("center")), ("max", F.col("y_max")), ("zero", F.lit(0.0)), ("center_line", F.col("center")))))
    rows = r.select("*", F.explode(named).alias("g")).select("g.kind", "g.level", "center", "scale", "y_min", "y_max")
    side = F.col("kind").isin("min", "center", "max")
    keep = F.when(side, (F.abs("level") > COLOR_THRESHOLD) | (F.col("level") == 0)).when(F.col("kind") == "zero", F.col("level").between(F.col("y_min"), F.col("y_max"))).otherwise(True)
    return rows.where(keep).select("kind", "level", y_of(F.col("level"), canvas).alias("y"))


def neutral_band(series: DataFrame, canvas: Canvas = WEEKLY) -> DataFrame:
    """The band from -10 to 10 clipped to the plot; its label's font where there is room."""
    _, y, w, h = canvas.box
    r = Q.y_range(series).withColumns({"top": F.greatest(F.lit(y), y_of(F.lit(COLOR_THRESHOLD), canvas)), "bottom": F.least(F.lit(y + h), y_of(F.lit(-COLOR_THRESHOLD), canvas))})
    tall = F.col("bottom") - F.col("top")
    font = F.when((tall >= 50) & (F.lit(w) >= 200), F.greatest(F.lit(20.0), F.least(F.lit(60.0), tall * 0.3)))
    return r.where("top < bottom").select("top", "bottom", tall.alias("height"), font.alias("font"))


def zone_labels(series: DataFrame, canvas: Canvas = WEEKLY) -> DataFrame:
    """Positive and negative zones beyond the neutral band, where they have room for their labels."""
    _, y, _, h = canvas.box
    font = max(16.0, min(40.0, h * 0.15))
    r = Q.y_range(series).withColumns({"up": y_of(F.lit(COLOR_THRESHOLD), canvas), "down": y_of(F.lit(-COLOR_THRESHOLD), canvas)})
    zones = F.array(
        F.struct(F.lit("Positive").alias("zone"), ((F.lit(y) + F.col("up")) / 2).alias("y"), (F.col("up") - y).alias("room"), (F.col("y_max") > COLOR_THRESHOLD).alias("there")),
        F.struct(F.lit("Negative").alias("zone"), ((F.col("down") + y + h) / 2).alias("y"), (F.lit(y + h) - F.col("down")).alias("room"), (F.col("y_min") < -COLOR_THRESHOLD).alias("there")),
    )
    return r.select(F.explode(zones).alias("z")).select("z.zone", "z.y", "z.room", "z.there").where(F.col("there") & (F.col("room") >= font)).select("zone", "y", F.lit(font).alias("font"))


def axis_labels(series: DataFrame, canvas: Canvas = WEEKLY) -> DataFrame:
    """Least, centre and most, and zero where it is in range and not the centre."""
    r = Q.y_range(series)
    named = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("level")) for k, c in (("min", F.col("y_min")), ("center", F.col("center")), ("max", F.col("y_max")), ("zero", F.lit(0.0)))))
    rows = r.select("*", F.explode(named).alias("g")).select("g.kind", "g.level", "center", "scale", "y_min", "y_max")
    keep = (F.col("kind") != "zero") | (F.lit(0.0).between(F.col("y_min"), F.col("y_max")) & (F.col("center") != 0))
    return rows.where(keep).select("kind", "level", y_of(F.col("level"), canvas).alias("y"))


def placed_ticks(tick_rows: DataFrame, series: DataFrame, canvas: Canvas = YEARLY) -> DataFrame:
    """x of each tick, those within the plot only."""
    x, _, w, _ = canvas.box
    t = F.unix_micros("timestamp")
    ends = series.agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    at = F.try_divide((F.unix_micros(F.col("tick").cast("timestamp")) - F.col("t0")).cast("double"), (F.col("t1") - F.col("t0")).cast("double"))
    return tick_rows.crossJoin(F.broadcast(ends)).select("tick", (F.lit(x) + at * w).alias("x")).where(F.col("x").between(x, x + w))  # one row of ends


def day_markers(series: DataFrame, canvas: Canvas = WEEKLY) -> DataFrame:
    """Weekday names at midnights if the series spans a day, else the clock at both ends."""
    x, _, w, _ = canvas.box
    t = "timestamp"
    ends = series.agg(F.min(t).alias("t0"), F.max(t).alias("t1"))
    long = F.unix_micros("t1") - F.unix_micros("t0") >= 86_400_000_000
    nights = F.filter(F.sequence(F.date_trunc("DAY", "t0"), F.col("t1"), F.expr("INTERVAL 1 DAY")), lambda d: d >= F.col("t0"))
    marks = F.when(long, F.transform(nights, lambda d: F.struct(d.alias("tick"), F.date_format(d, "EEE").alias("label")))).otherwise(F.transform(F.array("t0", "t1"), lambda d: F.struct(d.alias("tick"), F.date_format(d, "HH:mm").alias("label"))))
    at = F.try_divide((F.unix_micros("tick") - F.unix_micros("t0")).cast("double"), (F.unix_micros("t1") - F.unix_micros("t0")).cast("double"))
    return ends.select("t0", "t1", F.explode(marks).alias("m")).select("t0", "t1", "m.tick", "m.label").select("tick", "label", (F.lit(x) + at * w).alias("x"))


def average_line(series: DataFrame, canvas: Canvas = WEEKLY, v: str = "net_sentiment_percent") -> DataFrame:
    _, y, _, h = canvas.box
    return _with_range(series.agg(F.avg(v).alias("average")), series).select("average", y_of(F.col("average"), canvas).alias("y")).where(F.col("y").between(y, y + h))


def trend_line(series: DataFrame, sigma: float, canvas: Canvas = WEEKLY) -> DataFrame:
    x, _, w, _ = canvas.box
    smooth = Q.with_position(Q.gaussian_smooth(series, sigma), "ts")
    return _with_range(smooth, series).select("ts", "smoothed", (F.lit(x) + F.col("position") * w).alias("x"), y_of(F.col("smoothed"), canvas).alias("y"))


def extreme_labels(series: DataFrame, yearly: bool = False) -> DataFrame:
    """Labels of the lowest and highest points; weekly ones give way to the latest point's and to each other."""
    s = Q.series_stats(series)
    low = F.struct(F.lit("low").alias("kind"), F.col("lowest_ts").alias("ts"), F.col("lowest").alias("value"), (F.lit(yearly) | (F.col("lowest_ts") != F.col("current_ts"))).alias("show"))
    apart = F.col("highest") != F.col("lowest")
    high = F.struct(F.lit("high").alias("kind"), F.col("highest_ts").alias("ts"), F.col("highest").alias("value"), (apart & (F.lit(yearly) | (F.col("highest_ts") != F.col("current_ts")))).alias("show"))
    return s.select(F.explode(F.array(low, high)).alias("e")).select("e.kind", "e.ts", "e.value", "e.show").where("show").drop("show")


def yearly_ticks(series: DataFrame, start: str, end: str, canvas: Canvas = YEARLY) -> DataFrame:
    """Month, fortnightly and weekly ticks of a range, with their places."""
    spark = series.sparkSession
    out = None
    for kind, rows in (("month", ticks.months(spark, start, end)), ("biweekly", ticks.biweekly(spark, start, end)), ("weekly", ticks.weekly(spark, start, end))):
        part = placed_ticks(rows.select(F.to_date("tick").alias("tick")), series, canvas).select(F.lit(kind).alias("kind"), "tick", "x")
        out = part if out is None else out.union(part)
    return out


def start_end_labels(series: DataFrame, canvas: Canvas = YEARLY, v: str = "net_sentiment_percent") -> DataFrame:
    """Dates and values of the first and last point, below the plot at its ends."""
    x, y, w, h = canvas.box
    f = Q.first_last(series, v=v).where("first_ts IS NOT NULL")
    ends = F.array(
        F.struct(F.lit("start").alias("kind"), F.col("first_ts").alias("ts"), F.col("first_value").alias("value"), F.lit(x).alias("x"), F.lit(0.0).alias("anchor")),
        F.struct(F.lit("end").alias("kind"), F.col("last_ts").alias("ts"), F.col("last_value").alias("value"), F.lit(x + w).alias("x"), F.lit(1.0).alias("anchor")),
    )
    rows = f.select(F.explode(ends).alias("e")).select("e.*")
    return rows.select("kind", "ts", F.date_format("ts", "d MMM").alias("label"), "value", "x", F.lit(y + h + ENDS_BELOW).alias("y"), "anchor")


def dashes(lines: DataFrame, width: str, dash: float = DASH, gap: float = GAP) -> DataFrame:
    """Starts and ends (x0, x1) of the dashes of each line, by its width; the last one ends with the line."""
    count = F.greatest(F.ceil(F.col(width) / (dash + gap)), F.lit(0)).cast("int")
    at = (F.col("_i") * (dash + gap)).cast("double")
    out = lines.withColumn("_i", F.explode(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))))
    return out.select(*lines.columns, at.alias("x0"), F.least(at + dash, F.col(width).cast("double")).alias("x1"))


def lines_of(text: str, x: float, y: float, size: float, anchor: str = "middle") -> str:
    """SVG lines of a text around a point."""
    return "".join(f'<text x="{x:.1f}" y="{y + i * size * 1.2:.1f}" font-size="{size:.0f}" text-anchor="{anchor}">{html.escape(line)}</text>' for i, line in enumerate(text.split("\n")))


def svg(series: DataFrame, canvas: Canvas = WEEKLY, most_points: int = 5000, title: str = "", brand: str = "") -> str:
    """The series as an SVG text: neutral band, grid with dashes and labels, zones, average, coloured segments, points, ticks, extremes and
    the latest point. A sink: at most most_points rows come to the driver, more are refused; all else is a few rows.
    """
    rows = xy_points(series, canvas).orderBy("timestamp").limit(most_points + 1).collect()
    if not rows:
        raise ValueError("no data points provided")
    if len(rows) > most_points:
        raise ValueError(f"a chart holds at most {most_points} points")
    x, y, w, h = canvas.box
    at = [(x + w / 2 if r["x"] is None else r["x"], r["y"], COLORS[r["color"]], r["value"], r["timestamp"]) for r in rows]
    place = {r[4]: r for r in at}
    out = [f'<rect x="{x:.1f}" y="{r["top"]:.1f}" width="{w:.1f}" height="{r["height"]:.1f}" fill="{BAND}"/>' for r in neutral_band(series, canvas).collect()]
    for r in grid_levels(series, canvas).collect():
        dashes = f' stroke-dasharray="{DASH:.0f} {GAP:.0f}"' if r["kind"] in ("zero", "center_line") else ""
        out.append(f'<line x1="{x:.1f}" y1="{r["y"]:.1f}" x2="{x + w:.1f}" y2="{r["y"]:.1f}" stroke="{GRID}"{dashes}/>')
    out += [lines_of(f"{r['level']:.0f}%", x - 6, r["y"], 14, "end") for r in axis_labels(series, canvas).collect()]
    out += [lines_of(r["zone"], x + w / 2, r["y"], r["font"]) for r in zone_labels(series, canvas).collect()]
    out += [f'<line x1="{x:.1f}" y1="{r["y"]:.1f}" x2="{x + w:.1f}" y2="{r["y"]:.1f}" stroke="{AVERAGE}"/>' for r in average_line(series, canvas).collect()]
    out += [f'<line x1="{a[0]:.1f}" y1="{a[1]:.1f}" x2="{b[0]:.1f}" y2="{b[1]:.1f}" stroke="{a[2]}"/>' for a, b in zip(at, at[1:])]
    out += [f'<circle cx="{p[0]:.1f}" cy="{p[1]:.1f}" r="2" fill="{p[2]}"/>' for p in at]
    out += [lines_of(r["label"], x + w / 2 if r["x"] is None else r["x"], y + h + 16, 14) for r in day_markers(series, canvas).collect()]
    for r in extreme_labels(series).collect():
        p = place[r["ts"]]
        out.append(lines_of(f"{r['value']:.1f}%", p[0], p[1] + (18 if r["kind"] == "low" else -8), 14))
    last = at[-1]
    out.append(lines_of(f"Latest: {last[3]:.1f}%", last[0], last[1] - 8, 14, "end"))
    out += [lines_of(t, *where, 20) for t, where in ((title, (x + w / 2, y - 20)), (brand, (x + w / 2, canvas.height - 8))) if t]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{canvas.width:.0f}" height="{canvas.height:.0f}">{"".join(out)}</svg>'
