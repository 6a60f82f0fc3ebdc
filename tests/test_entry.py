import os
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from fleetlens.streaming import tumbling

SMALL = "/root/testdata/sf0.001"
HERE = Path(__file__).resolve().parents[1]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test data")
@pytest.mark.parametrize("name", ["q_hour_of_week_departures", "q_panel_dense", "q_inventory_walk", "q_bucket_bias", "q_matched_recovery", "q_displaced_summary", "q_od_probs", "q_mv_curve", "q_rank_targets", "q_policy_uniform", "q_policy_full_budget", "q_bootstrap_ci", "q_stream_tumbling"])
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SMALL):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMALL}/{f}'")
    df = entry.queries()[name](spark, SMALL)
    found = con.execute(entry.oracle_sql()[name])
    columns = sorted(df.columns)
    order = [[d[0] for d in found.description].index(c) for c in columns]
    shown = lambda x: round(x, 8) + 0.0 if isinstance(x, float) else x
    want = sorted(repr(tuple(shown(r[i]) for i in order)) for r in found.fetchall())
    assert sorted(repr(tuple(shown(r[c]) for c in columns)) for r in df.collect()) == want and want


def test_flagship_runs(spark):
    if os.path.isdir(SMALL):
        assert entry.entry(spark).columns[0] == "zone_agg"


def test_stream_waits_for_the_watermark(spark, tmp_path):
    spark.sql("SELECT timestamp '2025-01-01 08:01:00' AS started_at, 1L AS start_station_id UNION ALL SELECT timestamp '2025-01-01 08:14:00', 1L UNION ALL SELECT timestamp '2025-01-01 10:00:00', 2L").write.parquet(str(tmp_path / "in"))
    raw = spark.readStream.schema("started_at timestamp, start_station_id bigint").parquet(str(tmp_path / "in"))
    tumbling.run_available(tumbling.departures_stream(raw), str(tmp_path / "out"), str(tmp_path / "cp"))
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.station_id, r.departures) for r in got] == [(1, 2)]  # 10:00 is still open


def test_imports_without_the_llm_folders(tmp_path):
    import shutil

    for name in ("fleetlens", "__spark_entry__.py", "corpus_pipeline.py"):
        src = HERE / name
        if src.exists():
            (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    shutil.rmtree(tmp_path / "fleetlens/llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q) and len(q) > 60"
    for gone in (None, "corpus_pipeline.py"):
        (tmp_path / (gone or "none")).unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, check=True, timeout=120)


def test_faults_inside_llm_are_not_hidden(tmp_path):
    import shutil

    for name in ("fleetlens", "__spark_entry__.py"):
        src = HERE / name
        (shutil.copytree if src.is_dir() else shutil.copy)(src, tmp_path / name)
    if (tmp_path / "fleetlens/llm").is_dir():
        (tmp_path / "fleetlens/llm/queries.py").write_text("import not_there_at_all")
        run = subprocess.run([sys.executable, "-c", "import __spark_entry__"], cwd=tmp_path, env=os.environ | {"PYTHONPATH": ""}, capture_output=True, timeout=120)
        assert run.returncode and b"not_there_at_all" in run.stderr
