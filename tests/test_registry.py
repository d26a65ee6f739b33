import os

import pandas as pd
import pytest

import __spark_entry__
from jobscope.plans import queries as core

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or v is pd.NA or v != v:
        return None
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return v.isoformat() if hasattr(v, "isoformat") else v


def rows(pdf):
    return sorted((tuple(map(plain, r)) for r in pdf[sorted(pdf.columns)].astype(object).itertuples(index=False)), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["agg2_p80_history", "agg12_latest_checkpoint", "log9_estimate_eta", "join4_ckpt_overlaps", "join6_lineage", "join13_estimate_as_of", "chk3_diagnose_terminal", "chk6_illegal_transitions", "cap3_fit_matrix", "cap4_best_slot", "cap5_blocked_summary", "src4_read_log_lines", "str10_live_history"])
def test_twins_agree(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = core.QUERIES[name](spark, DATA).toPandas(), con.execute(core.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_rebalancing_considers_all_running_jobs(spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    got, want = core.QUERIES["cap9_rebalance_candidates"](spark, DATA).toPandas(), con.execute(core.ORACLE_SQL["cap9_rebalance_candidates"]).df()
    assert rows(got) == rows(want)
    best = con.execute("SELECT n_name, arg_max(o_orderkey, (600 + (o_orderkey * 7919) % 90000, o_orderkey)) FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderstatus = 'P' GROUP BY n_name").fetchall()
    assert len(got) > 0 and set(zip(got["source"], got["job_id"])) <= set(best)


def test_registry():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_imports_without_a_session():
    import subprocess
    import sys

    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    assert subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True).returncode == 0
