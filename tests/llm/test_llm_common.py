from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tarn.llm import common, queries

TABLES = ("documents", "benchmark", "labels", "pages", "embeddings")


def test_blocks():
    assert list(common.blocks([], 10)) == []
    assert list(common.blocks([0, 0, 4, 4, 4, 50, 1, 0], 10)) == [(0, 4), (4, 5), (5, 6), (6, 8)]
    assert list(common.blocks([99], 10)) == [(0, 1)]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/{sf}/{t}.parquet'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    got = queries.queries()[name](spark, f"/root/testdata/{sf}")
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_every_query_has_its_number():
    numbers = sorted(int(name[2:].split("_")[0]) for name in queries.queries())
    assert numbers == list(range(1, 14)) and set(queries.oracle_sql()) <= set(queries.queries())


def test_names_that_no_column_has():
    assert common.unused(["a", "b"], "c") == "c"
    assert common.unused(["C", "c_"], "c") == "c__"


def test_tables_go_with_what_they_were_stored_for(spark):
    def tables():
        return {p.name for p in Path(common.shared_folder(spark).removeprefix("file:")).glob("gone-*")}

    before = tables()
    with common.temporary(spark):
        with common.temporary(spark):
            common.stored(spark.range(3), "gone")
            stays = common.stored(spark.range(5), "gone", outlives=True)
            assert len(tables() - before) == 2
        assert len(tables() - before) == 1 and stays.count() == 5
    assert tables() == before
    common.stored(spark.range(2), "gone")
    assert len(tables() - before) == 1


def test_bitmap(spark):
    numbers = [0, 1, 7, 8, 32767, 32768, 65535, 65536 + 9, -1]
    bits = common.bitmap(spark.createDataFrame([(n,) for n in numbers], "n long"), F.col("n"), 65536)
    assert len(bits) == 8192
    assert {i for i in range(65536) if bits[i >> 3] >> (i & 7) & 1} == {n % 65536 for n in numbers}


def shuffled(frame, column):
    """The rows that shuffles of a column moved while the frame was computed; without adaptive plans."""
    frame._jdf.collectToPython()
    nodes, moved = [frame._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]
        if node.nodeName() == "Exchange" and f" {column}#" in f" {node.output().mkString(' ')}":
            moved += node.metrics().apply("shuffleRecordsWritten").value()
    return moved


@pytest.mark.parametrize("bits", [common.STAYING_BITS, 32768])
def test_rows_that_stay_are_not_shuffled(spark, monkeypatch, bits):
    """With few bits some rows share one; these are shuffled, and the result is the same."""
    monkeypatch.setattr(common, "STAYING_BITS", bits)
    docs = spark.range(6000).selectExpr("id doc_id", "repeat('x', 90) text", "id `a.b`", "-id part_of_bits", "-id BITS_kept", "-id bits_gone")
    rows, number = common.numbered(docs, "test")
    stay = common.stored(rows.where("doc_id % 3 <> 0").select(F.col(number).alias("row")), "test")
    names = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {n: spark.conf.get(n) for n in names}
    try:
        for n, value in names.items():
            spark.conf.set(n, value)
        found = common.staying(rows, number, stay)
        moved = shuffled(found, "text")
        assert found.columns == docs.columns
        want = sorted((i, "x" * 90, i, -i, -i, -i) for i in range(6000) if i % 3)
        assert sorted(map(tuple, found.collect())) == want
    finally:
        for n, value in old.items():
            spark.conf.set(n, value)
    # With 2^26 bits hardly any two of 6,000 rows share one; with 32,768 about 6 % of those that stay do.
    assert moved < 10 if bits > 32768 else 0 < moved < 1000


def test_all_rows_stay_or_go(spark):
    rows, number = common.numbered(spark.range(50).toDF("doc_id"), "test")
    every = rows.select(F.col(number).alias("row"))
    assert common.staying(rows, number, every).count() == 50
    assert common.staying(rows, number, every.where("false")).count() == 0
    assert common.staying(rows.where("false"), number, every.where("false")).count() == 0
