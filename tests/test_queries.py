"""Registered queries against their SQL at the smallest scale."""

import importlib.util
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"
SOME = ("hourly_diffusion_alerts", "j2_nearest_met_as_of", "e2_dynamic_edges", "r1_recover", "r3_degradation", "snk1_partitioned_upsert",
        "src4_latest_payload", "src7_column_arrays", "snk6_codec", "w6_modelling_frame", "w7_rolling_features", "w15_serving_features",
        "f1_design_matrix", "f0a_archive_hours", "o5_merge_metrics", "st1_normalize_stream", "st2_hourly_collapse", "st3_rolling_history",
        "st4_hourly_features", "st8_audit_sink", "st9_bounded_replay", "st2_watermark_collapse", "st3_keyed_history", "d3_stream_deliveries",
        "j2_stream_weather", "snk6_schema_versions", "w11_sequences_day", "dt2_timestamp_from_parts")

spec = importlib.util.spec_from_file_location("check", ROOT / "check.py")
check = importlib.util.module_from_spec(spec)
spec.loader.exec_module(check)


def test_registration():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 120


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, name):
    df = entry.queries()[name](spark, SF)
    got = check.rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in check.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rel = con.sql(entry.oracle_sql()[name])
    assert got == check.rows(rel.columns, rel.fetchall()) and got[1]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
