import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidemill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["bars_5m", "gap_flags", "bar_features", "kernel_r1_r2", "signals", "hurst_kn", "rolling_ou", "validate_ohlc", "expanding_median", "bt_config_matrix", "ou_priors_batch", "lead_lag", "logsig_depth2", "logsig_depth3", "signature_sweep", "kernel_fit_staged", "ou_pooled_speed", "bt_trades", "dc_events", "run_full_strategy", "run_fitted_strategy"]


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_belongs_to_a_query():
    assert entry.oracle_sql().keys() <= entry.queries().keys()
    assert catalog.FLAGSHIP in catalog.QUERIES and len(catalog.QUERIES) > 50


@pytest.mark.parametrize("name", CHECKED)
def test_rows_equal_the_sql(spark, sql, name):
    own = entry.queries()[name](spark, SF)
    found = sorted(map(str, ([r[c] for c in sorted(own.columns)] for r in own.collect())))
    result = sql.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    order = [names.index(c) for c in sorted(names)]
    assert sorted(names) == sorted(own.columns)
    assert found == sorted(str([r[i] for i in order]) for r in result.fetchall())


def test_queries_stand_alone_where_a_library_is_missing(monkeypatch):
    monkeypatch.setitem(sys.modules, "ahocorasick", None)
    for name in [m for m in sys.modules if m.startswith(("tidemill.llm", "corpus_pipeline"))]:
        monkeypatch.delitem(sys.modules, name)
    with pytest.warns(UserWarning, match="left out"):
        found = entry.queries()
    assert catalog.FLAGSHIP in found and not any(n.startswith("op") for n in found)


def test_the_library_stands_without_the_corpus_package():
    import pathlib

    for path in (pathlib.Path(entry.__file__).parent / "tidemill").rglob("*.py"):
        if "llm" not in path.parts:
            assert "llm" not in path.read_text().replace("(and, in ``llm``, for text corpora)", "")


def test_the_archive_for_workers_can_be_imported(tmp_path):
    import subprocess

    from tidemill.session import archive

    code = f"import sys; sys.path.insert(0, {archive(str(tmp_path))!r}); import tidemill.operators.running as r; print(r.__file__)"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
    assert "tidemill.zip" in done.stdout, done.stderr


def test_archive_stays_for_executors_that_start_later():
    """On a cluster executors fetch the archive from the driver's own file, after ``ship`` has returned and once an application."""
    import time
    import zipfile
    from concurrent.futures import ThreadPoolExecutor
    from types import SimpleNamespace

    from tidemill.session import ship

    sent: list[str] = []
    context = SimpleNamespace(environment={}, master="spark://host:7077", applicationId="app-of-this-test", addPyFile=lambda path: (time.sleep(0.1), sent.append(path)))
    session = SimpleNamespace(sparkContext=context)
    with ThreadPoolExecutor(4) as threads:
        assert list(threads.map(ship, [session] * 4)) == [session] * 4
    assert len(sent) == 1
    with zipfile.ZipFile(sent[0]) as found:
        assert "tidemill/session.py" in found.namelist()
