"""The driver contract: entry runs, every job has an oracle, a sample matches DuckDB at sf0.001."""

import os

import duckdb
import pytest

import __spark_entry__ as E
from tools.check_oracle import TABLES, _rows

SAMPLE = ["agg_sum_hour", "stats_instructions", "ix_dedup", "ev_decode", "decode_scalars", "decode_vec",
          "acc_changes", "acc_snapshot", "gap_by_slot", "late_rows", "idl_diff", "idl_as_of", "schema_tables",
          "metric_histogram", "recent_activity", "ix_page_next", "decode_defined_typed", "idl_upgrades",
          "agg_count_hour_basis", "agg_sum_total_decimal", "acc_merge_pg", "ix_accounts_instruction", "idl_extract"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["bucket", "value", "count"]
    assert df.count() > 0


def test_every_job_has_oracle():
    own = set(E.queries()) - set(E.LLM_QUERIES)
    assert own == set(E.oracle_sql()) - set(E.LLM_ORACLE)
    assert len(own) >= 80


@pytest.fixture(scope="module")
def duck(sf_small):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_small}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_job_matches_oracle(spark, duck, sf_small, name):
    df = E.queries()[name](spark, sf_small)
    res = duck.execute(E.oracle_sql()[name])
    dcols = [d[0] for d in res.description]
    assert sorted(df.columns) == sorted(dcols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(dcols, res.fetchall())
