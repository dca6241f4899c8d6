"""Small versioned JSON documents beside a table: which files are current, which columns it has.

A version is published by one rename; readers take the newest one (or the newest
before a given version, so that a replayed batch sees what its first attempt
saw). Republishing a version replaces it. Only the newest few are kept.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import SparkSession

from progscan.sources.staging import _fs

KEPT = 16
_NAME = re.compile(r"manifest-(\d{12})\.json$")
#: Versions may be as low as this.
LOWEST = -(1 << 20)


def _versions(spark: SparkSession, folder: str) -> list[int]:
    p, fs = _fs(spark, folder)
    if not fs.exists(p):
        return []
    names = (m for m in (_NAME.search(s.getPath().getName()) for s in fs.listStatus(p)) if m)
    return sorted(int(m.group(1)) + LOWEST for m in names)


def _file(folder: str, version: int) -> str:
    return f"{folder.rstrip('/')}/manifest-{version - LOWEST:012d}.json"


def publish(spark: SparkSession, folder: str, version: int, payload: dict) -> None:
    tmp, fs = _fs(spark, f"{folder.rstrip('/')}/_tmp-{version - LOWEST}")
    out = fs.create(tmp, True)
    out.write(bytearray(json.dumps(payload, sort_keys=True).encode()))
    out.close()
    final, _ = _fs(spark, _file(folder, version))
    fs.delete(final, False)
    if not fs.rename(tmp, final):
        raise OSError(f"cannot publish {final}")
    for old in _versions(spark, folder)[:-KEPT]:
        fs.delete(_fs(spark, _file(folder, old))[0], False)


def latest(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int, dict] | None:
    """(version, payload) of the newest version, or of the newest one before ``before``; None if there is none."""
    known = [v for v in _versions(spark, folder) if before is None or v < before]
    if not known:
        return None
    p, fs = _fs(spark, _file(folder, known[-1]))
    stream = fs.open(p)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return known[-1], json.loads(text)


def remove(spark: SparkSession, path: str) -> None:
    p, fs = _fs(spark, path)
    fs.delete(p, True)
