import math
import re
import zlib

import numpy as np
import pytest

from tarn.llm import toxicity as X
from tarn.llm.queries import op9_naive_bayes_ngram_toxicity


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    ranks = np.empty(len(order))
    ranks[order] = np.arange(1, len(order) + 1)
    positive = labels == 1
    n = positive.sum()
    return (ranks[positive].sum() - n * (n + 1) / 2) / (n * (~positive).sum())


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    found = {r.doc_id: r for r in op9_naive_bayes_ngram_toxicity(spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if found[r.doc_id].held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    truth = np.array([r.toxic for r in labels])
    score = np.array([found[r.doc_id].score for r in labels])
    guess = np.array([found[r.doc_id].predicted for r in labels])
    caught = (guess & truth).sum()
    assert auc(score, truth) > 0.97
    assert caught / truth.sum() > 0.85 and caught / guess.sum() > 0.9
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.createDataFrame([(i, "bad word" if i % 2 else "nice thing") for i in range(900)], "doc_id long, text string")
    label = lambda flip: spark.createDataFrame(
        [(i, (i % 2) ^ (flip and zlib.crc32(str(i).encode()) % 5 == 0), 1) for i in range(900)], "doc_id long, toxic int, quality int"
    )
    a, b = X.fit(docs, label(0)), X.fit(docs, label(1))
    assert np.array_equal(a.weights, b.weights) and a.bias == b.bias
    bad, nice, none = X.score(["a bad one", "a nice one", ""], a)
    assert bad > nice and 0 <= none <= 1
    assert X.score(["a bad one"], a) == [bad] and X.score([], a) == []


def test_words_of_a_block():
    texts = ["", "One two ONE", "x", "élan two " + "long" * 50]
    block = X.Words(texts)
    for text, found in zip(texts, block.features()):
        sizes = [sum(max(0, len(w) + 3 - n) for n in X.ORDERS) for w in X.words(text)]
        assert len(found) == sum(sizes)
        assert sorted(found) == sorted(f for alone in [X.Words([text])] for f in alone.feature)


@pytest.mark.parametrize("rows,labels", [
    ([], []), ([(1, "x")], []), ([], [(1, 1)]), ([(None, None), (1, ""), (2, "a" * 100_000), (2, "dup"), (2, "dup")], [(2, 1), (2, 0), (None, 1), (1, None)]),
])
def test_odd_rows(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, label int")
    known = spark.createDataFrame([(i, t, "y") for i, t in labels], "doc_id long, toxic int, text string")
    found = X.scores(docs, X.fit(docs, known)).collect()
    assert sorted(repr(r.id) for r in found) == sorted(repr(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 for r in found)


def test_ratios_are_zero_where_nothing_is_known():
    toxic, other = np.array([0, 50, 0, 10]), np.array([0, 0, 500, 90])
    ratios = X.log_ratios(toxic, other, 100, 900)
    assert ratios[0] == 0 and ratios[1] > 2 and ratios[2] < -1 and ratios[3] == 0


def slow_score(text, model):
    """From plain code: the weights of the n-grams of each distinct word, one by one."""
    mask, total = 2**64 - 1, model.bias
    for w in {*re.findall(r"[^\W\d_]+", text.lower())}:
        marked = f"<{w}>"
        for order in (3, 4, 5, 6):
            for i in range(len(marked) - order + 1):
                rolling = 0
                for c in marked[i : i + order]:
                    rolling = (rolling * 0x100000001B3 + ord(c)) & mask
                mixed = ((rolling ^ (rolling >> 29)) * 0x9E3779B97F4A7C15) & mask
                total += model.weights[(mixed >> 40) % X.SIZE]
    return 1 / (1 + math.exp(-min(max(total, -30), 30)))


def test_query_equals_brute_force(spark):
    """Every document of a given table; the model is the query's, its application is plain code."""
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    model = X.fit(docs, labels)
    got = {r.doc_id: (r.score, r.predicted) for r in op9_naive_bayes_ngram_toxicity(spark, sf).collect()}
    for r in docs.collect():
        want = slow_score(r.text or "", model)
        assert abs(got[r.doc_id][0] - want) < 1e-6 and got[r.doc_id][1] == (got[r.doc_id][0] >= 0.5)


def test_the_sample_is_bounded_in_entries(spark, monkeypatch):
    docs = spark.createDataFrame([(i, "bad word here" if i % 2 else "nice thing here") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2000)], "doc_id long, toxic int")
    sizes, fit = [], X.fit_logistic
    monkeypatch.setattr(X, "fit_logistic", lambda index, *more: sizes.append(len(index)) or fit(index, *more))
    X.fit(docs, labels)
    monkeypatch.setattr(X, "FIT_ENTRIES", sizes[0] // 10)
    X.fit(docs, labels)
    assert 0.05 * sizes[0] < sizes[1] < 0.15 * sizes[0]


def test_a_block_of_words_takes_little_memory():
    """A megabyte of words that are nearly all different; its numbers have four bytes each."""
    text = " ".join("".join(chr(97 + (i * k) % 26) for k in (1, 3, 7, 11, 17, 19, 23)) + chr(97 + i % 26) * (i % 5) for i in range(100_000))
    block = X.Words([text])
    assert block.owner.dtype == block.feature.dtype == np.int32
    assert len(block.owner) == len(block.feature) and block.feature.max() < X.SIZE


def test_counts_come_in_batches(spark, monkeypatch):
    """As many as without, over several batches of a task and blocks of a batch."""
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 26)} thing {'bad' if i % 2 else 'nice'}") for i in range(300)], "doc_id long, text string")
    rows = docs.selectExpr("text", "int(doc_id % 2) label").coalesce(2)
    want = X._counts(rows)
    monkeypatch.setattr(X, "COUNTS_AT_ONCE", 7)
    monkeypatch.setattr(X, "WORD_BYTES", 50)
    got = X._counts(rows)
    assert all(np.array_equal(a, b) for a, b in zip(want, got)) and want[2:] == (150, 150)
    assert want[0].max() > 100
