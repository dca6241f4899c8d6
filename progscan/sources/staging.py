"""Written intermediate tables in the shared checkpoint folder.

Stand-in inputs (transactions, account dumps) and the stored tables of the
ingest jobs are written once per session-visible key and read back by the
jobs that query them -- the way a deployment reads its stored tables instead
of re-deriving them. The folder is the cluster's ``spark.checkpoint.dir``
(shared by all executors), never a machine-local path on a cluster. Writes
go to a fresh folder and are used only once Spark's ``_SUCCESS`` marker is
there, so a lost executor or a killed job never leaves a half table behind.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from progscan import __version__
from progscan.session import ensure_checkpoint_dir


def _code_digest() -> str:
    """Digest of the code that derives staged tables, so a changed derivation
    never reuses tables written by an older one (the checkpoint dir is shared)."""
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    h = hashlib.sha1()
    for rel in ("sources/derived.py", "operators/ingest.py", "operators/store.py", "plans/decode.py",
                "functions/binary.py", "functions/codec.py", "jobs/_base.py"):
        with open(os.path.join(here, rel), "rb") as fh:
            h.update(fh.read())
    return h.hexdigest()[:12]


def _source_key(spark: SparkSession, sf_dir: str) -> str:
    """Names the inputs as they are now: every file's path, length and time, on any file system."""
    p, fs = _fs(spark, sf_dir)
    parts = [str(fs.makeQualified(p)), __version__, _code_digest()]
    files, found = fs.listFiles(p, True), []
    while files.hasNext():
        f = files.next()
        found.append(f"{f.getPath()}:{f.getLen()}:{f.getModificationTime()}")
    return hashlib.sha1("|".join(parts + sorted(found)).encode()).hexdigest()[:16]


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence test through Hadoop's FileSystem API (the session's default one for plain paths)."""
    p, fs = _fs(spark, path)
    return bool(fs.exists(p))


def has_data(spark: SparkSession, path: str) -> bool:
    """Whether a table folder exists and holds a Parquet file; a failing store raises."""
    p, fs = _fs(spark, path)
    if not fs.exists(p):
        return False
    files = fs.listFiles(p, True)
    while files.hasNext():
        if files.next().getPath().getName().endswith(".parquet"):
            return True
    return False


def _complete(spark: SparkSession, path: str) -> bool:
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame],
           partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> DataFrame:
    """Return table ``name`` derived from ``sf_dir``, writing it on first use.

    The table is written to a unique folder and published with one rename, so
    concurrent callers never see (or overwrite) a half-written table; when two
    race, the first rename wins and the other copy is dropped.
    """
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/staged/{_source_key(spark, sf_dir)}/{name}"
    if not _complete(spark, path):
        df = build()
        if partition_by:
            # range partitioning on (partition columns, sort keys): a hot partition value
            # (one table with most rows) is split over many writer tasks by slot range,
            # and every file covers a narrow slot range (row-group and file skipping)
            df = df.repartitionByRange(*partition_by, *(sort_by or []))
        if sort_by:
            df = df.sortWithinPartitions(*sort_by)
        tmp = f"{path}.tmp-{uuid.uuid4().hex[:12]}"
        w = df.write.mode("overwrite")
        if partition_by:
            w = w.partitionBy(*partition_by)
        w.parquet(tmp)
        src, fs = _fs(spark, tmp)
        dst, _ = _fs(spark, path)
        fs.mkdirs(dst.getParent())
        # rename onto an existing folder would nest it: a finished copy wins
        if fs.exists(dst) or not fs.rename(src, dst):
            fs.delete(src, True)
    return spark.read.parquet(path)
