"""Row numbers, running sums and previous values over a total order of a whole table, by a distributed prefix scan.

1. The table is range-partitioned and sorted by the order (which has to be total, else equal rows stand in any order). Each task runs over
   its range in Arrow batches, from zero, and the result is written to the shared folder: ranges can't move afterwards.
2. What each range hands on (rows, sums, last values and its first and last group) is a row; their number is that of the
   shuffle partitions, whatever the input. They are folded on the driver and joined back.

With ``by``, which has to lead the order, sums and previous values start again in each group; a group may span many ranges, so no group
meets in one task. Nulls count as 0 in sums. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from moodtide.session import ship


def _running(v: np.ndarray, starts: np.ndarray, carry):
    """Inclusive sums of v that begin again at starts; carry goes to what stands before the first start."""
    total = np.cumsum(v)
    before = np.zeros(len(v), v.dtype)
    if len(starts):
        base = np.concatenate([[0], total])[starts]
        before[starts[0] :] = np.repeat(base, np.diff(np.append(starts, len(v))))
        total[: starts[0]] += carry
        return total - before
    return total + carry


def _local(sums: dict[str, bool], prevs: Sequence[str], schema: pa.Schema):
    """The scan of one range; sums maps names to whether they are whole numbers."""

    def run(batches):
        from pyspark import TaskContext

        part, at, group, head = TaskContext.get().partitionId(), 0, None, True
        carry, last = {c: 0 for c in sums}, {c: None for c in prevs}
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            g = b.column("_group").to_numpy()
            new = np.append(group is not None and g[0] != group, g[1:] != g[:-1])
            starts = np.flatnonzero(new)
            inside = np.zeros(n, bool) if not head else (np.arange(n) < starts[0] if len(starts) else np.ones(n, bool))
            head, group = head and not len(starts), g[-1]
            columns = [*b.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(at, at + n)), pa.array(inside)]
            for c, whole in sums.items():
                v = b.column(c).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64 if whole else np.float64)
                out = _running(v, starts, carry[c])
                carry[c] = out[-1]
                columns.append(pa.array(out))
            for c in prevs:
                kind = b.column(c).type
                shifted = pa.concat_arrays([pa.array([last[c]], kind), b.column(c).slice(0, n - 1)])
                columns.append(pc.if_else(pa.array(new), pa.scalar(None, kind), shifted))
                last[c] = b.column(c)[n - 1].as_py()
            at += n
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def scan(df: DataFrame, order: Sequence[Column | str], by: Sequence[str] = (), sums: Sequence[str] = (), prevs: Sequence[str] = (), row: str | None = None, parts: int | None = None) -> DataFrame:
    """df with ``row`` (from 1), ``run_<c>`` for c in sums and ``prev_<c>`` for c in prevs, all in the given order.

    sums are columns of whole numbers or doubles. row counts through all groups.
    """
    from moodtide.plans.files import written

    spark = df.sparkSession
    ship(spark)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = {c: isinstance(kinds[c], T.IntegralType) for c in sums}
    grouped = df.withColumn("_group", F.xxhash64(*by) if by else F.lit(0).cast("long"))
    ranged = grouped.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    schema = T.StructType([*grouped.schema.fields, T.StructField("_part", T.IntegerType()), T.StructField("_at", T.LongType()), T.StructField("_head", T.BooleanType())])
    schema = T.StructType([*schema.fields, *(T.StructField(f"run_{c}", T.LongType() if w else T.DoubleType()) for c, w in whole.items()), *(T.StructField(f"prev_{c}", kinds[c]) for c in prevs)])
    table = written(ranged.mapInArrow(_local(whole, prevs, pa.schema([(f.name, pa.null()) for f in schema.fields])), schema), "scan")
    ends = table.groupBy("_part").agg(
        F.count("*").alias("n"), F.min_by("_group", "_at").alias("first"), F.max_by(F.struct("_group", "_head", *(f"run_{c}" for c in sums), *(F.col(c).alias(f"last_{c}") for c in prevs)), "_at").alias("tail")
    )
    found = {r["_part"]: r for r in ends.collect()}  # a row for each range
    rows, before, group, carry, last = [], 0, None, dict.fromkeys(sums, 0), dict.fromkeys(prevs)
    for part in sorted(found):
        r = found[part]
        same = group is not None and r["first"] == group
        held = {c: carry[c] if same else (0 if whole[c] else 0.0) for c in sums}
        rows.append((part, before, *held.values(), same, *(last[c] if same else None for c in prevs)))
        before, group = before + r["n"], r["tail"]["_group"]
        carry = {c: r["tail"][f"run_{c}"] + (held[c] if r["tail"]["_head"] else 0) for c in sums}
        last = {c: r["tail"][f"last_{c}"] for c in prevs}
    names = T.StructType([
        T.StructField("_part", T.IntegerType()), T.StructField("_before", T.LongType()), *(T.StructField(f"_carry_{c}", T.LongType() if w else T.DoubleType()) for c, w in whole.items()),
        T.StructField("_same", T.BooleanType()), *(T.StructField(f"_last_{c}", kinds[c]) for c in prevs),
    ])
    joined = table.join(F.broadcast(spark.createDataFrame(rows, names)), "_part")
    first = F.col("_at") == 0
    return joined.select(
        *df.columns, *([(F.col("_at") + F.col("_before") + 1).alias(row)] if row else []),
        *((F.col(f"run_{c}") + F.when(F.col("_head"), F.col(f"_carry_{c}")).otherwise(0)).alias(f"run_{c}") for c in sums),
        *(F.when(first & F.col("_same"), F.col(f"_last_{c}")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in prevs),
    )
