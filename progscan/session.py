"""Session construction and the shared checkpoint location."""

from __future__ import annotations

import os
import re
import tempfile
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings a job relies on. Applied by ``get_session`` and checked, not forced,
# when the caller hands us an existing session.
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


# The staged decode projections compile to large generated methods; HotSpot
# skips JIT-compiling methods over 8,000 bytecodes unless told otherwise, which
# leaves the hottest loop interpreted (about 40% slower decode here). Launch-time
# settings: on a cluster pass them with spark-submit.
JVM_CONF = {
    "spark.driver.extraJavaOptions": "-XX:-DontCompileHugeMethods",
    "spark.executor.extraJavaOptions": "-XX:-DontCompileHugeMethods",
}

# Starting points for a large cluster (about 100 TB of nested transaction
# Parquet). AQE re-plans at run time; these settings give it its targets.
#  * input: 256 MB splits -> ~400k scan tasks for 100 TB;
#  * the insert-ignore shuffle carries the decoded rows (tens of TB): start with
#    64k shuffle partitions (~0.5 GB each at 30 TB) and let AQE coalesce small ones;
#  * a skewed partition is split once it is 5x the median and over 512 MB;
#  * broadcast only below a measured 64 MB (AQE promotes/demotes at run time).
CLUSTER_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.shuffle.partitions": "65536",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "5",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
    "spark.sql.autoBroadcastJoinThreshold": "64m",
    "spark.sql.optimizer.nestedSchemaPruning.enabled": "true",
    "spark.sql.parquet.enableNestedColumnVectorizedReader": "true",
    "spark.sql.session.timeZone": "UTC",
}


def split_huge_methods(spark: SparkSession) -> None:
    """HotSpot leaves a method over 8,000 bytecodes interpreted (see ``JVM_CONF``, which a running session cannot take).
    With that limit Spark evaluates such projections in many small methods; a limit set by the caller stays."""
    key = "spark.sql.codegen.hugeMethodLimit"
    if spark.conf.get(key) == "65535":
        spark.conf.set(key, DEFAULT_CONF[key])


@contextmanager
def dropped_shuffles(spark: SparkSession):
    """Within, an execution's shuffle files go when it ends, not when the driver next collects garbage; streams that are
    started within keep to it. For jobs of many steps, each of which writes what the next ones read."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def apply_cluster_conf(spark: SparkSession) -> None:
    """Apply ``CLUSTER_CONF`` (runtime SQL settings) to an existing session."""
    for k, v in CLUSTER_CONF.items():
        spark.conf.set(k, v)


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "progscan") -> SparkSession:
    """Build (or reuse) a session with the settings the jobs assume.

    On a cluster, pass ``master=None`` and let spark-submit decide; tests pass
    ``local[N]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    for k, v in DEFAULT_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master:
        # our own local JVM; a deployment's memory and JVM options come from spark-submit
        b = b.config("spark.driver.memory", os.environ.get("PROGSCAN_DRIVER_MEMORY", "16g"))
        for k, v in JVM_CONF.items():
            b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared ``spark.checkpoint.dir``.

    Only when the session has none (local tests) do we set a scratch folder of
    our own; on a cluster the setting comes from the deployment and is shared
    by every executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not current:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="progscan-ckpt-", dir="/tmp")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for written intermediate tables, under the shared checkpoint dir."""
    import uuid

    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"
