"""A table in buckets of which a batch rewrites (or adds to) only those it touches.

Every write goes to a folder of its own version; a manifest names, for each
bucket, the versions that make up its rows. A batch reads the newest manifest
before its own, so a replay redoes exactly its first attempt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from progscan.operators.store import latest_per_key
from progscan.sources import manifest as M


class BucketStore:
    """Rows under ``root`` in buckets of the integer column ``bucket``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _state(self, before: int | None) -> dict:
        found = M.latest(self.spark, f"{self.root}/_buckets", before)
        return found[1] if found else {"schema": None, "buckets": {}}

    def versions(self, before: int | None = None) -> dict[int, list[str]]:
        """The versions of each bucket, oldest first."""
        return {int(b): v for b, v in self._state(before)["buckets"].items()}

    def read(self, before: int | None = None, buckets: list[int] | None = None) -> DataFrame | None:
        """The rows (of the given buckets), with the column ``bucket``; None if nothing is stored there."""
        state = self._state(before)
        return self._rows(state["schema"], [(b, v) for b, vs in state["buckets"].items()
                                            if buckets is None or int(b) in set(buckets) for v in vs])

    def _rows(self, schema: str | None, files: list[tuple]) -> DataFrame | None:
        if not files:
            return None
        return (self.spark.read.schema(StructType.fromJson(schema)).option("basePath", self.root)
                .parquet(*[f"{self.root}/v={v}/bucket={b}" for b, v in files]).drop("v"))

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/v={name}")

    def write(self, rows: DataFrame, version: int, replace: bool, compact=None, compact_after: int = 8) -> list[int]:
        """Store rows (with ``bucket``) as a version and return the touched buckets.

        ``replace``: the rows are all there is in their buckets; otherwise they
        are added, and buckets that have gathered ``compact_after`` versions are
        rewritten as ``compact`` of their rows.
        """
        state = self._state(version)
        self._write(rows, str(version))
        touched = sorted(r[0] for r in self.spark.read.schema(rows.schema).parquet(f"{self.root}/v={version}")
                         .select("bucket").distinct().collect())
        wide = state["schema"] or StructType().jsonValue()
        known = {f["name"] for f in wide["fields"]}
        schema = {**wide, "fields": wide["fields"] + [f for f in rows.schema.jsonValue()["fields"] if f["name"] not in known]}
        buckets, dropped = dict(state["buckets"]), []
        for b in map(str, touched):
            dropped += [(b, v) for v in buckets.get(b, [])] if replace else []
            buckets[b] = [str(version)] if replace else [*buckets.get(b, []), str(version)]
        full = [b for b in map(str, touched) if len(buckets[b]) > compact_after] if compact else []
        if full:
            old = [(b, v) for b in full for v in buckets[b]]
            self._write(compact(self._rows(schema, old)), f"{version}c")
            dropped += old
            buckets.update({b: [f"{version}c"] for b in full})
        M.publish(self.spark, f"{self.root}/_buckets", version, {"schema": schema, "buckets": buckets, "dropped": dropped})
        # what the version before has replaced is no longer read by a replay of this one
        prior = M.latest(self.spark, f"{self.root}/_buckets", version)
        for b, v in (prior[1]["dropped"] if prior else []):
            M.remove(self.spark, f"{self.root}/v={v}/bucket={b}")
        return touched


SNAPSHOT_BUCKETS = 64


class Snapshot:
    """B-4 kept up to date: the last observation of each key, as base and deltas per bucket of the key's hash.

    A batch adds only its own rows (the last one per key) to the buckets they
    fall into; reading merges a bucket's few versions. Full buckets are merged
    into one version, the others stay as they are.
    """

    def __init__(self, spark: SparkSession, root: str, key: list[str], order: list[str], buckets: int = SNAPSHOT_BUCKETS):
        self.store, self.key, self.order, self.buckets = BucketStore(spark, root), key, order, buckets

    def _last(self, rows: DataFrame) -> DataFrame:
        return latest_per_key(rows, self.key, self.order)

    def apply(self, rows: DataFrame, version: int, compact_after: int = 8) -> list[int]:
        bucket = F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")
        return self.store.write(self._last(rows).withColumn("bucket", bucket), version, False, self._last, compact_after)

    def read(self, before: int | None = None) -> DataFrame | None:
        rows = self.store.read(before)
        return None if rows is None else self._last(rows).drop("bucket")
