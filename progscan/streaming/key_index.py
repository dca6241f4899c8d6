"""Exact index of the stored keys of an insert-once table (J-4, B-1).

Every batch adds one *run* of its new keys. ``FANOUT`` runs of a level are
merged into one run of the next level, so there are only about
``FANOUT * log(batches)`` runs, whatever the stream's age, and each key is
rewritten once a level. A run of level L is cut into ``2 ** (BITS * L)`` slices
by the top bits of the key's hash and sorted by it, with a Parquet Bloom filter
on the hash: a batch opens the files of its keys' slices only. Keys are compared
as text; the hash only finds their files.

Each version of the list of runs is published as a manifest, and a batch reads
the newest one before its own, so a replay sees what the first attempt saw.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from progscan.operators.store import with_bloom
from progscan.sources import manifest as M

FANOUT = 8
BITS = 3
#: Deepest level; its runs are merged among themselves.
DEEPEST = 6
#: Slices of a batch's keys are listed up to this many; beyond it every file may hold one, so all are read.
LISTED = 4096

_SCHEMA = "h bigint, ix_name string, signature string, run string, slice int"


def key_hash() -> Column:
    return F.xxhash64("signature", "ix_name")


def _slice(h, level: int) -> Column:
    return F.shiftrightunsigned(h, 64 - BITS * level).cast("int") if level else F.lit(0)


class KeyIndex:
    """Keys ``(ix_name, signature)`` under the folder ``root``."""

    def __init__(self, spark: SparkSession, root: str, fanout: int = FANOUT):
        self.spark, self.root, self.fanout = spark, root.rstrip("/"), fanout

    def _runs(self, before: int | None) -> list[list]:
        """[level, run] pairs of the newest version before the given one."""
        found = M.latest(self.spark, f"{self.root}/_runs", before)
        return found[1]["runs"] if found else []

    def empty(self) -> bool:
        return M.latest(self.spark, f"{self.root}/_runs") is None

    def _read(self, level: int, runs: list[str]) -> DataFrame:
        base = f"{self.root}/level={level}"
        return (self.spark.read.schema(_SCHEMA).option("basePath", base)
                .parquet(*[f"{base}/run={r}" for r in runs]))

    def lookup(self, keys: DataFrame, before: int) -> DataFrame | None:
        """The indexed keys, out of the files that may hold one of ``keys``; None if nothing is indexed."""
        runs = self._runs(before)
        if not runs:
            return None
        deepest = max(level for level, _ in runs)
        # runs of level 0 have one slice
        rows = keys.select(_slice(key_hash(), deepest).alias("s")).distinct().limit(LISTED + 1).collect() if deepest else []
        parts = []
        for level in sorted({level for level, _ in runs}):
            part = self._read(level, [r for lv, r in runs if lv == level])
            if level and len(rows) <= LISTED:
                part = part.where(F.col("slice").isin(sorted({r["s"] >> (BITS * (deepest - level)) for r in rows})))
            parts.append(part.select("ix_name", "signature"))
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        return whole

    def _write(self, keys: DataFrame, level: int, run: str) -> None:
        rows = keys.select(key_hash().alias("h"), "ix_name", "signature").withColumn("slice", _slice(F.col("h"), level))
        if level:
            rows = rows.repartition("slice")
        (with_bloom(rows.sortWithinPartitions("slice", "h").write.mode("overwrite"), ["h"]).option("compression", "zstd")
         .partitionBy("slice").parquet(f"{self.root}/level={level}/run={run}"))

    def add(self, keys: DataFrame, version: int) -> None:
        """Add a batch's new keys and publish the version; merges what has become FANOUT runs of a level."""
        before = self._runs(version)
        runs = [*before, [0, str(version)]]
        self._write(keys, 0, str(version))
        level = 0
        while len(full := [r for lv, r in runs if lv == level]) >= self.fanout:
            target = min(level + 1, DEEPEST)
            merged = f"{version}" if target > level else f"{version}m"
            self._write(self._read(level, full), target, merged)
            runs = [x for x in runs if x[0] != level] + [[target, merged]]
            if target == level:
                break
            level += 1
        M.publish(self.spark, f"{self.root}/_runs", version, {"runs": runs, "merged": [x for x in before if x not in runs]})
        self._drop_unused(version)

    def _drop_unused(self, version: int) -> None:
        """Delete the runs that the previous version has merged: no replay of this version reads them any more once
        the next one is published, so they go one version later."""
        prior = M.latest(self.spark, f"{self.root}/_runs", version)
        for level, run in (prior[1].get("merged", []) if prior else []):
            M.remove(self.spark, f"{self.root}/level={level}/run={run}")
