import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarn.llm import sharding as S
from tarn.llm.queries import op2_hypergeometric_sharding


@pytest.mark.parametrize("rows,shards", [(0, 8), (1, 8), (7, 8), (1000, 8), (1003, 3)])
def test_sizes_and_slots_are_exact(spark, rows, shards):
    docs = spark.range(rows).select(
        F.when(F.col("id") % 3 > 0, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 5 > 0, F.lit("the same text")).alias("text"),
        F.lit("old").alias("shard"),
        F.lit(1).alias("a.b"),
    )
    found = S.shard_rows(docs, shards).collect()
    assert len(found) == rows
    slots = {}
    for r in found:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(slots.get(s, [])) for s in range(shards)]
    assert max(sizes) - min(sizes) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    same = lambda frame: Counter(tuple(r) for r in frame)
    assert same((r.doc_id, r.text) for r in found) == same(docs.select("doc_id", "text").collect())


def test_query(spark):
    found = op2_hypergeometric_sharding(spark, "/root/testdata/sf0.001").collect()
    assert sorted(Counter(r.shard for r in found).values()) == [25] * 8
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: (r.size, r.text_crc32, r.law, r.grown_shard) for r in found} == {
        i: (len(t) + 1, zlib.crc32(t), "rows", None) for i, t in texts.items()
    }


def test_a_run_of_slots_is_a_partition(spark, monkeypatch):
    monkeypatch.setattr(S, "SLOTS_A_TASK", 7)
    found = S.shard_rows(spark.range(100), 3).withColumn("task", F.spark_partition_id()).collect()
    tasks = {}
    for r in found:
        tasks.setdefault(r.task, []).append((r.shard, r.slot // 7))
    assert len(tasks) == sum(-(-n // 7) for n in (34, 33, 33)) and all(len({*v}) == 1 for v in tasks.values())


def test_hypergeometric_law():
    rng = np.random.default_rng(0)
    got = np.array([S.hypergeometric(rng, 30, 70, 20) for _ in range(20000)])
    want = rng.hypergeometric(30, 70, 20, 20000)
    assert abs(got.mean() - 6) < 0.05 and abs(got.var() / want.var() - 1) < 0.05
    assert got.min() >= 0 and got.max() <= 20
    big = [S.hypergeometric(rng, 10**10, 7 * 10**10, 10**6) for _ in range(50)]
    assert abs(np.mean(big) - 125000) < 300


def test_matrix_sums():
    counts = [0, 5, 1, 1000, 17]
    matrix = S.communication_matrix(counts, 8, 3)
    assert [sum(line) for line in matrix] == counts
    assert sorted({sum(line[s] for line in matrix) for s in range(8)}) == [127, 128]


def test_places_are_uniform(spark):
    """Over many keys, each row of a small set is as likely in every place."""
    n, trials = 5, 4000
    frame = spark.range(n * trials).select((F.col("id") % n).alias("x"), F.floor(F.col("id") / n).alias("k"))
    found = frame.select("x", "k", S.permuted(F.col("x"), F.lit(n), F.col("k"), 1).alias("y")).collect()
    by_key = {}
    for r in found:
        by_key.setdefault(r.k, set()).add(r.y)
    assert all(v == set(range(n)) for v in by_key.values())
    counts = Counter((r.x, r.y) for r in found)
    chi = sum((counts[x, y] - trials / n) ** 2 / (trials / n) for x in range(n) for y in range(n))
    assert chi < 50  # 16 degrees of freedom
