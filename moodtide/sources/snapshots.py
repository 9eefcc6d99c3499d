"""A keyed table of snapshots: data files by key bucket, a log of versions, commits that detect conflicts.

``<path>/versions/<n>.json`` says which folders of data hold each bucket of keys in version n, and what the commit did. A commit writes its data files first, under a name of their own,
and then makes version n + 1 by a rename that fails where that version exists. A writer who loses the race looks at what others committed since its own version: if
they touched none of its buckets (appends touch none of each other's), it commits on top of them, else it fails with ``Conflict`` and nothing of it shows. Readers see whole versions only, and old ones stay readable.

Upserts and deletes rewrite the buckets of their keys alone; appends add files. The log of a version has an entry for each bucket, whatever the number of rows. Paths are Hadoop paths. Rows
whose key is null have a key like any other.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Conflict(Exception):
    """Another commit changed what this one was based on."""


@dataclass
class Snapshots:
    spark: SparkSession
    path: str

    # -- the log ---------------------------------------------------------------------------------------------------------

    def _fs(self):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), self.spark._jvm.org.apache.hadoop.fs

    def versions(self) -> list[int]:
        fs, hadoop = self._fs()
        at = hadoop.Path(f"{self.path}/versions")
        return sorted(int(n[:-5]) for f in fs.listStatus(at) if (n := f.getPath().getName()).endswith(".json") and n[:-5].isdigit()) if fs.exists(at) else []

    def entry(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known:
            raise ValueError(f"no table at {self.path}")
        version = known[-1] if version is None else version
        if version not in known:
            raise ValueError(f"{self.path} has no version {version}")
        rows = self.spark.read.text(f"{self.path}/versions/{version:012d}.json", wholetext=True).first()
        return json.loads(rows[0])

    def _publish(self, entry: dict) -> bool:
        """Makes a version unless it exists."""
        fs, hadoop = self._fs()
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        final, part = hadoop.Path(f"{self.path}/versions/{entry['version']:012d}.json"), hadoop.Path(f"{self.path}/versions/.{uuid.uuid4().hex}")
        out = fs.create(part, False)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(fs.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(part), fs.makeQualified(final), none)
        except Exception as e:
            if "FileAlreadyExistsException" not in str(e):
                raise
            fs.delete(part, False)
            return False
        return True

    def _commit(self, base: dict, operation: str, touched: dict[str, list[str]], added: dict[str, list[str]], details: dict) -> int:
        """Publishes base with the touched buckets' folders replaced and others added; the version."""
        while True:
            buckets = {k: v for k, v in base["buckets"].items() if k not in touched} | {k: v for k, v in touched.items() if v}
            for k, v in added.items():
                buckets[k] = [*buckets.get(k, []), *v]
            entry = base | {"version": base["version"] + 1, "buckets": buckets, "operation": operation, "touched": sorted({*touched, *added}), "rewrites": bool(touched), **details}
            if self._publish(entry):
                return entry["version"]
            for version in range(base["version"] + 1, self.versions()[-1] + 1):
                other = self.entry(version)
                if (touched or other["rewrites"]) and {*touched, *added} & {*other["touched"]}:
                    raise Conflict(f"version {version} ({other['operation']}) changed buckets of this {operation}")
                base = other

    # -- reading ---------------------------------------------------------------------------------------------------------

    def _schema(self, entry: dict) -> T.StructType:
        return T.StructType.fromJson(entry["schema"])

    def read(self, version: int | None = None, buckets: list[str] | None = None) -> DataFrame:
        entry = self.entry(version)
        return self._rows(entry, buckets)

    def _rows(self, entry: dict, buckets: list[str] | None = None) -> DataFrame:
        folders = [f"{self.path}/data/{f}" for k, v in entry["buckets"].items() if buckets is None or k in buckets for f in v]
        schema = self._schema(entry)
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def history(self) -> list[dict]:
        return [{k: e.get(k) for k in ("version", "operation", "rows")} for e in map(self.entry, self.versions())]

    # -- commits ---------------------------------------------------------------------------------------------------------

    def _bucket(self, keys: list[str], n: int) -> Column:
        return F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")

    def _write(self, df: DataFrame, entry: dict) -> dict[str, list[str]]:
        """Data files of df by bucket: the folders written."""
        name = uuid.uuid4().hex
        schema = self._schema(entry)
        rows = df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields)).withColumn("_bucket", self._bucket(entry["keys"], entry["n"]))
        rows.repartition(F.col("_bucket"), F.pmod(F.xxhash64(*schema.names), F.lit(8))).write.partitionBy("_bucket").parquet(f"{self.path}/data/{name}")
        fs, hadoop = self._fs()
        found = (f.getPath().getName() for f in fs.listStatus(hadoop.Path(f"{self.path}/data/{name}")) if f.isDirectory())
        return {b.partition("=")[2]: [f"{name}/{b}"] for b in found if b.startswith("_bucket=")}

    def create(self, schema: T.StructType, keys: list[str], buckets: int = 16) -> Snapshots:
        """Version 0, without rows."""
        entry = {"version": 0, "schema": json.loads(schema.json()), "keys": keys, "n": buckets, "buckets": {}, "operation": "create", "touched": [], "rewrites": False, "rows": 0}
        if not self._publish(entry):
            raise Conflict(f"{self.path} has a table already")
        return self

    def append(self, df: DataFrame) -> int:
        """Adds rows; their keys aren't looked at."""
        base = self.entry()
        added = self._write(df, base)
        n = self._rows(base | {"buckets": added}).count()
        return self._commit(base, "append", {}, added, {"rows": n})

    def upsert(self, df: DataFrame, order: str | None = None, base: int | None = None) -> int:
        """Replaces the rows of df's keys; of several rows of a key the last by ``order``. ``base`` is the version that df was made from."""
        entry = self.entry(base)
        keys = entry["keys"]
        columns = [f.name for f in self._schema(entry).fields]
        last = F.max_by(F.struct(*columns), F.col(order) if order else F.xxhash64(*columns)).alias("_r")
        new = df.groupBy(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(keys))).agg(last).select("_r.*")
        return self._rewrite(entry, new, new.select(*keys), "upsert")

    def delete(self, keys: DataFrame, base: int | None = None) -> int:
        """Removes the rows of the given keys."""
        entry = self.entry(base)
        return self._rewrite(entry, None, keys.select(*entry["keys"]), "delete")

    def _rewrite(self, entry: dict, new: DataFrame | None, gone: DataFrame, operation: str) -> int:
        keys = entry["keys"]
        touched = [str(r[0]) for r in gone.select(self._bucket(keys, entry["n"])).distinct().collect()]  # as many as there are buckets, at most
        if not touched:
            return entry["version"]
        old, other = self._rows(entry, touched), gone.distinct().toDF(*(f"_g{i}" for i in range(len(keys))))
        same = F.lit(True)
        for i, k in enumerate(keys):
            same &= old[k].eqNullSafe(other[f"_g{i}"])
        left = old.join(other, same, "left_anti")
        written = self._write(left if new is None else left.unionByName(new), entry)
        return self._commit(entry, operation, {b: written.get(b, []) for b in touched}, {}, {"rows": gone.distinct().count()})


def append_posts(posts: Snapshots, runs: Snapshots, batch: DataFrame, now: Column) -> tuple[int, int]:
    """Adds posts and what they add to the totals of their runs; the two versions. Runs that aren't there are left alone."""
    added = batch.groupBy("run_id").agg(F.count("*").alias("_n"))
    version = runs.entry()["version"]
    bumped = runs.read(version).join(added, "run_id").withColumns({"total_posts_retrieved": F.coalesce("total_posts_retrieved", F.lit(0)) + F.col("_n"), "updated_at": now}).drop("_n")
    return posts.append(batch), runs.upsert(bumped, base=version)
