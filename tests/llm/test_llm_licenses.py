import random
import re
import time

from tarn.llm import licenses as L
from tarn.llm.queries import op13_positional_license_scan


def words(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def slow_places(text):
    """(label, base, start, n, score) of every template at every place, without an index."""
    w, out = words(text), []
    for t in L.TEMPLATES:
        place, first = t.phrases[0]
        for s in range(len(w) - len(first) + 1):
            if w[s : s + len(first)] != first:
                continue
            start = s - place
            near = lambda p, x: " ".join(w[max(0, start + p - L.SLACK) : max(0, start + p + len(x) + L.SLACK)])  # noqa: E731, B023
            if all(f" {' '.join(x)} " in f" {near(p, x)} " for p, x in t.phrases[1:]):
                same = sum(0 <= start + k < len(w) and w[start + k] == x for k, x in enumerate(t.words))
                out.append((t.label, t.base, start, len(t.words), same / len(t.words)))
    return sorted(out)


def some_texts(rng):
    texts = [None, "", " \n--!", "MIT license", "MITK license", "Kernel cc-by-nc. CC BY", "Licensed under CC BY-NC 4.0.", "mit licenses", "mitlicense", "MIT Licenſe", "É" * 9]
    full = [" ".join(t.words) for t in L.TEMPLATES]
    texts += full + [t.title() for t in full] + [t[5:] for t in full] + [t[:-9] for t in full]
    parts = sorted({w for t in L.TEMPLATES for w in t.words}) + full + ["house", "évening", "GNU", "K"]
    for n in (3, 20, 200):
        texts += [rng.choice((" ", "-", ", ")).join(rng.choices(parts, k=n)) for _ in range(40)]
    for t in full:  # words lost, put in or replaced
        w = t.split()
        for _ in range(4):
            i = rng.randrange(len(w))
            texts.append(" ".join(w[:i] + rng.choice(([], ["x"], w[i : i + 1] * 2)) + w[i + rng.randrange(2) :]))
    return texts


def test_equals_brute_force(spark):
    texts = some_texts(random.Random(7))
    texts += texts[:30]
    docs = spark.createDataFrame(
        [(None if i % 9 == 0 else i // 2, t, "x", 1, i) for i, t in enumerate(texts)],
        "doc_id long, text string, words string, `a.b` int, posted int",
    )
    got = [(r.id, r.n_words, sorted(map(tuple, r.found))) for r in L.licenses(docs).collect()]
    want = [(None if i % 9 == 0 else i // 2, len(words(t)), slow_places(t)) for i, t in enumerate(texts)]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    labels = {x[0] for _, _, found in want for x in found}
    assert labels == {t.label for t in L.TEMPLATES}
    assert L.licenses(docs.limit(0)).collect() == []


def test_what_is_looked_up_decides_no_result(spark, monkeypatch):
    texts = some_texts(random.Random(8))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for n, common in ((1, {}), (9, {}), (2, {"license": 10**9, "gnu": 10**6, "mit": 10**8})):
        monkeypatch.setattr(L, "LOOKED_UP", n)
        monkeypatch.setattr(L, "document_frequencies", lambda rows, wanted, common=common: common)
        assert [sorted(map(tuple, r.found)) for r in L.licenses(docs).orderBy("id").collect()] == [slow_places(t) for t in texts]


def test_rare_words_come_first(spark):
    rows = spark.createDataFrame([(["MIT", "License", "license"],), (["license"],), ([],), (["Kernel", "by"],)], "words array<string>")
    frequency = L.document_frequencies(rows, ["by", "kernel", "license", "mit"])
    assert frequency == {"license": 2, "mit": 1, "by": 1}
    rare = dict(zip((t.label for t in L.BASE), L.rare_words(L.BASE, {"gnu": 3, "general": 2, "public": 9, "license": 9, "by": 8, "cc": 1})))
    assert rare["gpl"] == [("general", 1), ("gnu", 0), ("public", 2)] and rare["cc-by"][0] == ("cc", 0)


def test_a_text_full_of_licence_words_takes_linear_time(spark):
    took = []
    for n in (5_000, 40_000):
        docs = spark.createDataFrame([(1, "gnu general public license the mit license " * n)], "doc_id long, text string")
        start = time.perf_counter()
        (row,) = L.licenses(docs).collect()
        took.append(time.perf_counter() - start)
        assert row.n_words == 7 * n and len(row.found) == 2 * n
    assert took[1] < 16 * took[0] + 5


def test_no_python_on_the_executors(spark):
    plan = op13_positional_license_scan(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan
