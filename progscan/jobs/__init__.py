"""Jobs registered for the driver: ``QUERIES`` (Spark) and ``ORACLE`` (DuckDB SQL)."""

from progscan.jobs import (  # noqa: F401
    account_jobs, decode_jobs, ingest_jobs, quality_jobs, reads, schema_jobs, stream_jobs,
)
from progscan.jobs._base import ORACLE, QUERIES  # noqa: F401
