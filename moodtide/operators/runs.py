"""Operators on run states and stored history: listing, gaps, errors, joins, keyed changes."""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from moodtide.functions.text import gap_severity
from moodtide.operators.scan import scan
from moodtide.schemas import GAP_MINUTES, POST_CHARS, POSTS_PER_BATCH, RUNS_PER_DAY, STEPS


def _neighbours(runs: DataFrame, ts: str) -> DataFrame:
    """(run_id, from_ts, to_ts, gap_minutes) of each run and the one before it, by a prefix scan over ranges of time."""
    rows = scan(runs.select("run_id", F.col(ts).alias("to_ts")), ["to_ts", "run_id"], prevs=["to_ts"])
    return rows.select("run_id", F.col("prev_to_ts").alias("from_ts"), "to_ts", ((F.unix_micros("to_ts") - F.unix_micros("prev_to_ts")) / 6e7).alias("gap_minutes"))


def run_gaps(runs: DataFrame, ts: str = "created_at") -> DataFrame:
    """Gaps of over 35 minutes between runs in time order."""
    return _neighbours(runs, ts).where(F.col("gap_minutes") > GAP_MINUTES).withColumn("severity", gap_severity(F.col("gap_minutes")))


def max_gap(runs: DataFrame, ts: str = "created_at") -> DataFrame:
    """The largest gap and where it begins, the first of equals."""
    gaps = _neighbours(runs, ts).select("from_ts", F.col("gap_minutes").alias("gap")).where("gap IS NOT NULL")
    return gaps.agg(F.min(F.struct((-F.col("gap")).alias("g"), "from_ts")).alias("m")).select((-F.col("m.g")).alias("gap_minutes"), F.col("m.from_ts").alias("from_ts"))


def recent_runs(runs: DataFrame, now: Column) -> DataFrame:
    return runs.where(F.col("created_at") > now - F.expr("INTERVAL 24 HOURS"))


def run_count_check(runs: DataFrame, now: Column, expected: int = RUNS_PER_DAY) -> DataFrame:
    return recent_runs(runs, now).agg(F.count("*").alias("runs")).select("runs", (F.lit(expected) - F.col("runs")).alias("missing"), (F.col("runs") >= expected).alias("complete"))


def run_stats(runs: DataFrame, posts: DataFrame) -> DataFrame:
    """Stored totals against the posts there are."""
    counted = posts.groupBy("run_id").agg(F.count("*").alias("n"))
    return runs.join(counted, "run_id", "left").select("run_id", "total_posts_retrieved", F.coalesce("n", F.lit(0)).alias("actual_posts"))


def run_step_matrix(runs: DataFrame, found_only: bool = False) -> DataFrame:
    """Each run with each of the five steps; absent ones say so."""
    steps = F.broadcast(runs.sparkSession.createDataFrame([(s,) for s in STEPS], "step string"))  # five rows
    grid = runs.select("run_id").distinct().crossJoin(steps)
    out = grid.join(runs.select("run_id", "step", "status"), ["run_id", "step"], "inner" if found_only else "left")
    return out.select("run_id", "step", F.coalesce("status", F.lit("Not found")).alias("status"))


def poster_state(states: DataFrame) -> DataFrame:
    """The aggregator's state with the analyzer's sentiment."""
    left, right = states.where("step = 'aggregator'"), states.where("step = 'analyzer'")
    return left.drop("overall_sentiment", "net_sentiment_percentage").join(right.select("run_id", "overall_sentiment", "net_sentiment_percentage"), "run_id")


def step_or_fallback(states: DataFrame, step: str = "fetcher", fallback: str = "orchestrator") -> DataFrame:
    """One state for each run: the step's, else the fallback's."""
    some = states.where(F.col("step").isin(step, fallback))
    best = F.max_by(F.struct("step", "status"), (F.col("step") == step).cast("int"))
    return some.groupBy("run_id").agg(best.alias("b")).select("run_id", "b.step", "b.status")


def list_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.where("step = 'orchestrator'").orderBy(F.desc("created_at"), "run_id").limit(limit)


def point_get(states: DataFrame, run_id: str, step: str = "orchestrator") -> DataFrame:
    return states.where((F.col("run_id") == run_id) & (F.col("step") == step))


def errors(states: DataFrame) -> DataFrame:
    """States with an error, latest first, those without a time last and by creation."""
    return states.where(F.coalesce("error_message", F.lit("")) != "").orderBy(F.col("last_error_time").desc_nulls_last(), F.desc("created_at"), "run_id")


def run_duration_minutes(cutoff: str = "cutoff_time", updated: str = "updated_at") -> Column:
    return F.expr(f"timestampdiff(MINUTE, {cutoff}, {updated})")


def latest_state(states: DataFrame, changes: DataFrame) -> DataFrame:
    """States after keyed changes: the last ``updated_at`` of each (run_id, step), a change before a state of its time."""
    both = states.withColumn("_p", F.lit(0)).unionByName(changes.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    columns = [c for c in both.columns if c != "_p"]
    best = F.max_by(F.struct(*columns), F.struct("updated_at", "_p"))
    return both.groupBy(F.col("run_id").alias("_r"), F.col("step").alias("_s")).agg(best.alias("_b")).select("_b.*")


def run_id_gen(now_ns: int | None = None) -> str:
    """``run-<nanoseconds>`` of now."""
    return f"run-{time.time_ns() if now_ns is None else now_ns}"


def run_id_of(ts: Column) -> Column:
    """The id of a run that began at a time."""
    return F.concat(F.lit("run-"), (F.unix_micros(ts) * 1000).cast("string"))


def latest_of_run(states: DataFrame) -> DataFrame:
    """The state of each run that changed last."""
    best = F.max_by(F.struct(*states.columns), F.struct("updated_at", "step"))
    return states.groupBy(F.col("run_id").alias("_r")).agg(best.alias("_b")).select("_b.*")


def transition(states: DataFrame, base: DataFrame, values: DataFrame, now: Column, **fixed: str) -> DataFrame:
    """States after a change: base's rows take the columns of values(run_id, ...), fixed ones, and the time, and replace states of their run and step."""
    new = [c for c in values.columns if c != "run_id"]
    named = values.select("run_id", *(F.col(c).alias(f"_new_{c}") for c in new))
    changed = base.join(named, "run_id").withColumns({c: F.col(f"_new_{c}") for c in new} | {k: F.lit(v) for k, v in fixed.items()} | {"updated_at": now})
    return latest_state(states, changed.select(*dict.fromkeys([*states.columns, *new])))


def cursor_moved(states: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """After a page: values has run_id, current_cursor and has_more_posts. The fetcher's state, else the orchestrator's, becomes the fetcher's."""
    some = states.where(F.col("step").isin("fetcher", "orchestrator"))
    best = F.max_by(F.struct(*states.columns), (F.col("step") == "fetcher").cast("int"))
    base = some.groupBy(F.col("run_id").alias("_r")).agg(best.alias("_b")).select("_b.*")
    return transition(states, base, values, now, step="fetcher", status="fetching")


def analysed(states: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """After analysis: values has run_id, overall_sentiment and what else is known (top_posts)."""
    return transition(states, latest_of_run(states), values, now, step="aggregator", status="analyzed")


def top_post_set(states: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """After the summary went out: values has run_id, top_post_uri and top_post_cid; step and status stay."""
    return transition(states, latest_of_run(states), values, now)


def completed(states: DataFrame, values: DataFrame, now: Column) -> DataFrame:
    """After all: values has run_id."""
    return transition(states, latest_of_run(states), values, now, step="poster", status="completed")


def is_complete(created_at: Column, now: Column, minutes: int = 10) -> Column:
    """A run older than some minutes counts as complete, whatever its state says."""
    return F.unix_micros(now) - F.unix_micros(created_at) > minutes * 60_000_000


def batches(posts: DataFrame, size: int = POSTS_PER_BATCH) -> DataFrame:
    """Posts of each run in stored batches of at most size, under ids ``run#batchN``."""
    n = F.floor((F.row_number().over(Window.partitionBy("run_id").orderBy("seq")) - 1) / size)
    each = posts.withColumn("_n", n).groupBy("run_id", "_n").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", F.struct(*[c for c in posts.columns if c != "run_id"]).alias("p")))), lambda x: x["p"]).alias("posts"))
    return each.select("run_id", F.concat("run_id", F.lit("#batch"), F.col("_n").cast("string")).alias("post_id"), "posts")


def run_posts(items: DataFrame, run_id: str) -> DataFrame:
    """Posts of a run from batch rows and rows of the older shape (``post``)."""
    own = items.where((F.col("run_id") == run_id) & F.startswith(F.col("post_id"), F.lit(run_id + "#")))
    rows = F.coalesce("posts", F.array("post")) if "post" in items.columns else F.col("posts")
    return own.select(F.explode(rows).alias("p")).select("p.*")


def max_batch_index(items: DataFrame) -> DataFrame:
    n = F.regexp_extract("post_id", r"#batch(\d+)", 1).try_cast("int")
    return items.groupBy("run_id").agg(F.max(n).alias("max_batch"))


def history_for_run(history: DataFrame, run_id: str, after: Column) -> DataFrame:
    return history.where((F.col("run_id") == run_id) & (F.col("timestamp") >= after)).orderBy("timestamp")


def near_time(history: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows of history within less than a second of the wanted (run_id, at); an equi-join on run and on a second's cells."""
    cell = F.floor(F.unix_micros("at") / 1_000_000)
    w = wanted.select("run_id", "at", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    h = history.withColumn("cell", F.floor(F.unix_micros("timestamp") / 1_000_000))
    return h.join(w, ["run_id", "cell"]).where(F.abs(F.unix_micros("timestamp") - F.unix_micros("at")) < 1_000_000).drop("cell")


def without_rows(history: DataFrame, gone: DataFrame) -> DataFrame:
    return history.join(gone.select("run_id", "timestamp"), ["run_id", "timestamp"], "left_anti")


def missing_tables(wanted: DataFrame, manifest: DataFrame) -> DataFrame:
    """Each wanted table with its file, or null where the manifest lacks it."""
    entries = manifest.select(F.explode("tables").alias("t")).select(F.col("t.table_name").alias("table_name"), F.col("t.file_name").alias("file_name"))
    return wanted.join(entries, "table_name", "left")


def alive(rows: DataFrame, now: Column) -> DataFrame:
    """Rows whose ttl has not passed."""
    return rows.where(F.col("ttl").isNull() | (F.col("ttl") > F.unix_timestamp(now)))


def characters_left(text: Column) -> Column:
    return F.lit(POST_CHARS) - F.length(text)
