import math
import random
import re
import zlib

import numpy as np
import pytest

from tarn.llm import quality as Q
from tarn.llm.linear import fit_logistic
from tarn.llm.queries import op1_weak_label_quality


def test_against_labels_that_it_never_saw(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in op1_weak_label_quality(spark, sf).collect()}
    assert len(found) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    good = [found[r.doc_id].kept for r in labels if r.quality == 1]
    junk = [found[r.doc_id].kept for r in labels if r.quality == 0]
    assert np.mean(good) > 0.995 and np.mean(junk) < 0.05


def test_expectation_maximisation_finds_the_accuracies():
    rng = random.Random(8)
    right = [(0.5, 0.98), (0.9, 0.95), (0.7, 0.9), (0.6, 0.99), (0.8, 0.97)]
    patterns = {}
    for _ in range(20_000):
        clean = rng.random() < 0.8
        votes = "".join("-" if rng.random() < 0.2 else str(int(clean == (rng.random() < r[clean]))) for r in right)
        patterns[votes] = patterns.get(votes, 0) + 1
    model = Q.estimate(patterns)
    assert abs(model.clean - 0.8) < 0.03
    assert np.abs(model.right - np.array(right)).max() < 0.06
    assert model.posterior("00000") < 0.01 < 0.99 < model.posterior("11111")


def test_linear_scorer_learns_soft_targets():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 2, (500, 6))
    target = 1 / (1 + np.exp(-(3.0 * x[:, 0] - 2.0 * x[:, 3] - 0.5)))
    row, index = np.nonzero(x)
    starts = np.searchsorted(row, np.arange(501))
    weights, bias = fit_logistic(index, np.ones(len(index)), starts, target, 6, 0.0, 2000)
    assert np.abs(weights - [3, 0, 0, -2, 0, 0]).max() < 0.05 and abs(bias + 0.5) < 0.05


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, " \n"), (2, "ok then."), (2, "ok then."), (3, "JUNK!! " * 50_000)]])
def test_odd_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, "x", 1, -7, [2], "p") for i, t in rows], "doc_id long, text string, votes string, __score int, VALUE int, index array<int>, place string")
    described = Q.described(docs)
    found = Q.scores(described, Q.fit(described)).collect()
    assert sorted(repr(r.id) for r in found) == sorted(repr(i) for i, _ in rows)
    assert all(not r.kept for r in found if r.id in (None, 1))
    left = Q.kept(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect()) == sorted(r.id for r in found if r.kept)
    assert all(tuple(r)[2:] == ("x", 1, -7, [2], "p") for r in left.collect())


def slow_score(text, model):
    """The scorer's decision from plain code: features counted word by word, weights added one by one."""
    words = text.split()
    if not words:
        return 0.0
    n, counts = len(words), {}

    def add(name, value):
        counts[zlib.crc32(name.encode()) % Q.SIZE] = counts.get(zlib.crc32(name.encode()) % Q.SIZE, 0.0) + value

    kinds = lambda w: "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in w)
    for w in words:
        add("shape " + re.sub(r"(.)\1+", r"\1+", kinds(w), flags=re.DOTALL), 1 / n)
    chars, letters = sum(map(len, words)), sum(c.isalpha() for w in words for c in w)
    add("doubled", sum(a == b for a, b in zip(words, words[1:])) / n)
    add("runs", sum(bool(re.search(r"([^\w.]|_)\1$", w)) for w in words) / n)
    add("plain", sum((w.rstrip()[:-1] if w[-1] in ".,;:!?" else w).isalpha() and (sum(map(str.isalpha, w)) == 1 or not w[1:].isupper()) for w in words) / n)
    add("bare", sum(not any(map(str.isalnum, w)) for w in words) / n)
    add("symbols", sum(not c.isalnum() and c not in ".,;:!?'\"()-’" for w in words for c in w) / chars)
    add("capitals", sum(c.isupper() for w in words for c in w) / letters if letters else 0.0)
    if n >= 40:
        add("top", max(words.count(w) for w in {*words}) / n)
        share = sum(len({*words[i : i + 1000]}) for i in range(0, n, 1000)) / n
        add(f"distinct {min(7, int(share * 8))} of {min(4, len(str(n)))}", 0.25)
    margin = model.bias + sum(model.weights[k] * v for k, v in counts.items())
    return 1 / (1 + math.exp(-min(max(margin, -30), 30)))


def test_query_equals_brute_force(spark):
    """Every document of a given table; the model is the query's, its application is plain code."""
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = Q.fit(Q.described(docs))
    got = {r.doc_id: r.score for r in op1_weak_label_quality(spark, sf).collect()}
    for r in docs.collect():
        assert abs(got[r.doc_id] - slow_score(r.text or "", model)) < 1e-4


def test_long_words_and_texts_are_read_whole():
    head = "ab" * 40
    assert Q.shape(head + "7") != Q.shape(head + "-") and Q.shape("x" * 100_000) == "a+"
    a, b = (Q.features(Q.Reader().traits(f"{'aB' * 50_000}{c} and more")) for c in "1!")
    assert sorted(a[0]) != sorted(b[0])
    paragraph = " ".join(f"w{i}" for i in range(100))
    repeated = Q.Reader().traits(paragraph + f" {paragraph}" * 499)
    assert repeated.n == 50_000 and abs(repeated.distinct - 0.1) < 1e-9
    assert Q.votes(repeated)[Q.LABELLERS.index("distinct words")] == Q.JUNK
    prose = Q.Reader().traits(" ".join(f"w{i}" for i in range(50_000)))
    assert Q.votes(prose)[Q.LABELLERS.index("distinct words")] == Q.CLEAN


def test_a_hot_text_does_not_fill_the_sample(spark):
    """Rows are taken one by one: of 6,000 equal rows and 6,000 others, about as many of each."""
    docs = spark.range(12_000).selectExpr("IF(id < 6000, NULL, id) AS doc_id", "IF(id < 6000, 'one and the same', concat('text ', id)) AS text")
    rows = Q.described(docs).where(f"place < {Q._PLACES // 10}")
    hot = rows.where("id IS NULL").count()
    assert 450 < hot < 750 and 450 < rows.count() - hot < 750
