"""Write semantics: insert-ignore, append, latest snapshot, history, checkpoint.

No MERGE-capable table format is assumed. History (append-only) is the
source of truth; the snapshot is an aggregate over it; insert-ignore is
"first row per key" followed by an anti join against what is stored.

Skew: every "one row per key" step is a ``row_number() = 1``, which Spark plans
with a group limit before the shuffle. A key that holds a third of the rows is
first reduced inside each map task, so no single task receives all its copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(df: DataFrame, key: list[str], order: list[str], last: bool = False) -> DataFrame:
    """One row per ``key``: the smallest (or largest) by ``order``, NULL counting as smallest.

    ``row_number() = 1`` is planned with a group limit below the exchange: every
    map task sends at most one row per key, and each row is carried once.
    """
    by = [F.col(c).desc_nulls_last() if last else F.col(c).asc_nulls_first() for c in order]
    w = Window.partitionBy(*key).orderBy(*by)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def may_be_first(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The rows that no row of their ``key`` precedes by ``order``, the first columns of an order: ``first_per_key`` by the
    whole order takes the same rows from these as from all. Planned like it, with a group limit below the exchange."""
    w = Window.partitionBy(*key).orderBy(*[F.col(c).asc_nulls_first() for c in order])
    return df.withColumn("__rk", F.rank().over(w)).where("__rk = 1").drop("__rk")


def insert_ignore(new: DataFrame, key: list[str], order: list[str], existing: DataFrame | None = None) -> DataFrame:
    """B-1 / B-3: rows to append so that the first row per key wins.

    ``existing`` is the stored table (or None); keys already stored are
    ignored, as ``INSERT OR IGNORE`` does.
    """
    first = first_per_key(new, key, order)
    if existing is not None:
        first = first.join(existing.select(*key), key, "left_anti")
    return first


def latest_per_key(history: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """B-4: snapshot = last observation per key by ``order`` (e.g. slot, arrival)."""
    return first_per_key(history, key, order, last=True)


def merge_present(history: DataFrame, key: list[str], order: list[str], value_cols: list[str]) -> DataFrame:
    """B-5 (Postgres variant): per column, the last value that was present (non-NULL)."""
    ordk = F.struct(*[F.col(c) for c in order])
    aggs = [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), ordk)).alias(c) for c in value_cols]
    aggs.append(F.max(ordk).alias("__ord"))
    out = history.groupBy(*key).agg(*aggs)
    return out.select(*key, *[F.col(f"__ord.{c}").alias(c) for c in order], *value_cols)


def checkpoint_max(rows: DataFrame, previous: int = 0, slot_col: str = "slot") -> DataFrame:
    """B-8: ``last_processed_slot`` = max(previous, max slot seen); starts at 0."""
    return rows.agg(F.greatest(F.coalesce(F.max(slot_col), F.lit(0)).cast("bigint"),
                               F.lit(previous).cast("bigint")).alias("last_processed_slot"))


def stored_text(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """B-9: values as stored by the reference -- ``String(v)`` or NULL."""
    cols = cols or df.columns
    return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])


# ------------------------------------------------------------ parquet sinks --

def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """B-2 / B-6: append-only sink."""
    w = df.write.mode("append")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


#: Buckets of the account key that a compacted history is partitioned by.
KEY_BUCKETS = 64


def _key_bucket(key, buckets: int):
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_history(history: DataFrame, path: str, key: str = "pubkey", order: tuple = ("slot", "seq"),
                  buckets: int = KEY_BUCKETS, options: dict | None = None) -> None:
    """History laid out for reads of one account: partitioned by the key's hash, sorted by key and slot, with Bloom
    filters on the key. A bucket that one account fills is split over several files by slot."""
    rows = history.withColumn("key_bucket", _key_bucket(F.col(key), buckets)).repartitionByRange("key_bucket", key, *order)
    with_bloom(rows.sortWithinPartitions("key_bucket", key, *order).write.mode("overwrite"), [key]) \
        .options(**(options or {})).partitionBy("key_bucket").parquet(path)


def history_of(history: DataFrame, value: str, key: str = "pubkey", buckets: int = KEY_BUCKETS) -> DataFrame:
    """C-8: the rows of one account of such a history: its bucket's folder, and there the row groups that may hold it."""
    return history.where((F.col("key_bucket") == _key_bucket(F.lit(value), buckets)) & (F.col(key) == F.lit(value))) \
        .drop("key_bucket")


#: As many signatures are looked up by equality, which row groups' Bloom filters answer; more are joined.
LOOKED_UP = 64


def by_signatures(table: DataFrame, signatures: list[str]) -> DataFrame:
    """H-3: rows of some signatures, by pushed equalities (Bloom filters and statistics skip the other row groups)."""
    wanted = list(dict.fromkeys(signatures))
    if len(wanted) > LOOKED_UP:
        listed = table.sparkSession.createDataFrame([(s,) for s in wanted], "signature string")
        return table.join(listed, "signature", "left_semi").select(*table.columns)
    cond = F.lit(False)
    for s in wanted:
        cond = cond | (F.col("signature") == F.lit(s))
    return table.where(cond)


SCHEMA_FOLDER = "_schema"


def _note_schema(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """I-5: keep the columns that any batch ever had, so that readers need no file footers."""
    from progscan.sources import manifest as M

    spark, folder = df.sparkSession, f"{path.rstrip('/')}/{SCHEMA_FOLDER}"
    found = M.latest(spark, folder)
    version, known = found if found else (0, {"columns": [], "partitions": ["batch_id", *partition_by]})
    have = {c["name"]: c["type"] for c in known["columns"]}
    now = df.schema.jsonValue()["fields"]
    for c in now:
        if have.get(c["name"], c["type"]) != c["type"]:
            raise ValueError(f"{path}: column {c['name']} is stored as {have[c['name']]}, not {c['type']}")
    added = [{**c, "nullable": True} for c in now if c["name"] not in have]
    if added or not found:
        M.publish(spark, folder, version + 1, {**known, "columns": known["columns"] + added})


def with_bloom(writer, columns: list[str]):
    """A Parquet writer that adds Bloom filters of the columns, for reads of single keys. A filter is as large as its row
    group's keys need; of a fixed size (1 MB) those of small files would outweigh their rows."""
    for c in columns:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    return writer.option("parquet.bloom.filter.adaptive.enabled", "true") if columns else writer


def overwrite_batch(df: DataFrame, path: str, batch_id: int, partition_by: list[str] | None = None,
                    bloom: list[str] | None = None) -> None:
    """Idempotent micro-batch write: each batch owns ``batch_id=<n>``; a replay rewrites it."""
    w = with_bloom(df.write.mode("overwrite"), bloom or []).option("compression", "zstd")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(f"{path.rstrip('/')}/batch_id={batch_id}")
    _note_schema(df, path, partition_by or [])


def read_table(spark, path: str, schema=None) -> DataFrame | None:
    """Read a batch table with all columns it ever had, or None if it holds no data yet.

    The columns come from the table's own manifest, so no footers are opened; a
    table written without one is read with schema merge. Only absence is None:
    a store that cannot be read raises."""
    from pyspark.sql.types import StructType

    from progscan.sources import manifest as M
    from progscan.sources.staging import has_data

    if not has_data(spark, path):
        return None
    found = M.latest(spark, f"{path.rstrip('/')}/{SCHEMA_FOLDER}") if schema is None else None
    if found:
        columns, parts = found[1]["columns"], found[1]["partitions"]
        batch = {"name": "batch_id", "type": "long", "nullable": True, "metadata": {}}
        last = [batch] + [c for p in parts for c in columns if c["name"] == p]
        schema = StructType.fromJson({"type": "struct", "fields": [c for c in columns if c["name"] not in parts] + last})
    r = spark.read if schema is not None else spark.read.option("mergeSchema", "true")
    return (r.schema(schema) if schema is not None else r).parquet(path)
