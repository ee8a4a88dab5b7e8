import hashlib
import math
import random

import numpy as np
import pytest

from tarn.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, v int"


def slow_codes(rows, parts=4, entries=256, rounds=4):
    """What the contract says, from (id, vector, label) of one length, by comparing all entries."""
    rows = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    rows = [(i, [math.floor(1024 * float(np.float32(x))) for x in v], g) for i, v, g in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    n = len(rows[0][1]) if rows else 0
    cuts = [n * p // parts for p in range(parts + 1)]
    cut = [[v[a:b] for a, b in zip(cuts, cuts[1:])] for _, v, _ in rows]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def nearest(book, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = {}
            for c in cut:
                of.setdefault(nearest(book, c[p])[1], []).append(c[p])
            books[p] = [[sum(x) // len(of[k]) for x in zip(*of[k])] if k in of else e for k, e in enumerate(book)]
    found, by = [], {}
    for (i, _, g), c in zip(rows, cut):
        best = [nearest(b, x) for b, x in zip(books, c)]
        error = sum(d for d, _ in best)
        found.append((i, "".join(f"{k:02x}" for _, k in best), error, g))
        by[g] = by.get(g, 0) + error
    text = ",".join(str(x) for b in books for e in b for x in e)
    return [(i, c, e, by[g], hashlib.sha256(text.encode()).hexdigest()) for i, c, e, g in found]


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)
    out = V.codes(docs, **more).select("id", "code", "error", "label_error", "codebooks_sha256").collect()
    return sorted(map(tuple, out), key=repr)


@pytest.mark.parametrize("width,spread,entries", [(8, 0.2, 256), (8, 0.01, 20), (4, 0.003, 256), (10, 1.0, 7), (3, 0.1, 5), (8, 900.0, 256)])
def test_equals_brute_force(spark, width, spread, entries):
    """Also with many ties and unused entries, parts of unequal width and of none, and large components."""
    rng = random.Random(width)
    rows = [(i, [rng.gauss(0, spread) for _ in range(width)], rng.choice((None, 1, 2, 3))) for i in range(400)]
    rows += rng.choices(rows, k=60)  # repeated rows
    rows += [(None, rows[3][1], None), (None, rows[5][1], 1), (7, rows[9][1], 2), (-5, [0.0] * width, 1), (-4, [-0.0] * width, 1)]
    rows += [(900, None, 1), (901, [None] + [0.1] * (width - 1), 1), (-9, [float("nan")] * width, 1), (903, [float("-inf")] + [0.0] * (width - 1), 2)]
    assert found(spark, rows, entries=entries) == sorted(slow_codes(rows, entries=entries), key=repr)


def test_vectors_without_a_code(spark):
    rows = [(i, [i / 7, i / 11, -i / 3, 1.0], 1) for i in range(20)]
    odd = [(-3, [1.0], 1), (-2, [], 2), (50, [1e30, 0.0, 0.0, 0.0], 1), (51, [20_000.0, 0.0, 0.0, 0.0], None), (52, [-3e38] * 4, 2)]
    got = found(spark, rows + odd)
    want = slow_codes(rows + [odd[3]])  # 20,000 can be coded with four components
    digest = want[0][-1]
    want += [(-3, None, None, want[0][3], digest), (-2, None, None, None, digest), (50, None, None, want[0][3], digest), (52, None, None, None, digest)]
    assert got == sorted(want, key=repr)


def test_few_and_no_vectors(spark):
    assert found(spark, []) == [] and found(spark, [(1, None, 1)]) == []
    one = [(5, [0.5, 0.25, -0.5, 1.0], None)]
    assert found(spark, one) == slow_codes(one)
    assert [r[:4] for r in found(spark, [(5, [], 1)])] == [(5, "00000000", 0, 0)]


@pytest.mark.parametrize("largest", [2000, 2**26])
def test_search_is_exact_and_leaves_entries_out(largest):
    """In doubles and in integers; far clusters are not compared."""
    rng = np.random.default_rng(1)
    centres = rng.integers(-1000, 1000, (16, 8))
    entries = (centres[:, None] + rng.integers(-9, 9, (16, 16, 8))).reshape(-1, 8)
    entries[200] = entries[30]
    parts = np.concatenate((centres.repeat(50, axis=0) + rng.integers(-12, 12, (800, 8)), entries[:40]))
    apart = ((parts[:, None] - entries[None]) ** 2).sum(2)
    index, distance, compared = V.Codebook(entries, largest).nearest(parts)
    assert (index == apart.argmin(1)).all() and (distance == apart.min(1)).all()
    assert compared < 0.6 * apart.size
