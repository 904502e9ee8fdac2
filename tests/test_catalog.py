"""A spread of registered queries against DuckDB on the smallest tables."""
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from msgsieve.catalog.fixtures import TABLES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
SOME = ["flagship_high_risk_link_share", "P3_threats_page_filter", "W7_keyset_page", "J2_existing_matches", "J6_match_safe_senders", "J11_ip_geo", "J13_lookalike_domains",
        "J15_similar_messages", "D7_apply_grades", "F9_auth_columns", "F14_url_risk", "F22_findings", "F30_policy_verdict", "F33_screen_calls", "A13_psi", "A17_sender_profiles",
        "W3_grade_velocity", "W6_token_bucket_flags", "U2_directory", "R6_stream_dedup", "R8_stream_grade_velocity", "R10_stream_kpis"]


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return int(v) if v.__class__.__name__ == "Decimal" else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(norm(r[i]) for i in order) for r in rows), key=repr)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    assert rows_of(df.columns, df.collect()) == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_filters_reach_the_scan(spark, tmp_path):
    from msgsieve.sources import readers as rd, sinks  # noqa: F401
    spark.range(10).selectExpr("id", "concat('t', id % 2) account_sub").write.parquet(str(tmp_path / "m"))
    plan = rd.read_messages(spark, str(tmp_path / "m"), "t1")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(account_sub,t1)" in plan and "body" not in plan
