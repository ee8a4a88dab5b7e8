import json
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as contract
from tarn.sources.tables import TABLES, read_table

DATA = Path("/root/testdata")
REPO = Path(__file__).resolve().parents[1]
#: The queries of this part of the library; those of tarn.llm have their tests in tests/llm.
OWN = [
    name for name, f in contract.queries().items() if not f.__module__.startswith(("tarn.llm", "corpus_pipeline"))
]


def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def test_every_given_table_reads(spark):
    for name in TABLES:
        assert read_table(spark, str(DATA / "sf0.001"), name).columns


def test_unknown_table_is_refused(spark):
    with pytest.raises(ValueError, match="unknown table"):
        read_table(spark, str(DATA / "sf0.001"), "nope")


def test_entry_has_rows_and_stable_schema(spark):
    first, second = contract.entry(spark), contract.entry(spark)
    assert first.schema == second.schema
    assert first.count() > 0


def test_sql_only_for_registered_queries():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
@pytest.mark.parametrize("name", OWN)
def test_query_equals_sql(spark, name, sf):
    sf_dir = str(DATA / sf)
    got = contract.queries()[name](spark, sf_dir)
    want = duck(sf_dir).execute(contract.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(columns)
    got_rows = sorted(tuple(r) for r in got.select(*columns).collect())
    assert got_rows == sorted(want.fetchall())
    assert got_rows


def test_bench_prints_one_json_line():
    out = subprocess.run(
        [sys.executable, "bench.py"], cwd=REPO, text=True, check=True, timeout=1200,
        stdout=subprocess.PIPE,
        env={**os.environ, "BENCH_SF_DIR": str(DATA / "sf0.001"), "BENCH_CPUS": "2"},
    ).stdout
    assert len(out.splitlines()) == 1
    report = json.loads(out)
    assert set(report["queries"]) == set(contract.queries())
    assert report["unit"] == "sec" and report["sf"] == "0.001"


@pytest.mark.parametrize("missing", ["corpus_pipeline", "tarn.llm", "tarn.llm.queries"])
def test_the_rest_works_without_the_training_data_part(missing):
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; print(*e.queries(), *e.oracle_sql())"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, text=True, check=True, capture_output=True).stdout
    assert out.split() == 2 * OWN


def test_other_import_errors_are_not_swallowed():
    if len(contract.queries()) == len(OWN):
        pytest.skip("the training-data part is not here")
    code = "import sys; sys.modules['tarn.llm.common'] = None; import __spark_entry__"
    out = subprocess.run([sys.executable, "-c", code], cwd=REPO, text=True, capture_output=True)
    assert out.returncode and "tarn.llm.common" in out.stderr
