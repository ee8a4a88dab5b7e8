import hashlib
import random
import tracemalloc

import pytest

from tarn.llm import exact_dedup as X

SCHEMA = "doc_id long, text string, id string, body string, fingerprint int"


def brute_force(rows):
    groups = {}
    for number, (doc_id, text) in enumerate(rows):
        body = (text or "").translate({ord(c): None for c in " \t\n\x0b\x0c\r"})
        order = (-len(text or ""), doc_id is None, doc_id or 0, number)
        groups.setdefault(body, []).append((order, doc_id, body))
    out = []
    for body, members in groups.items():
        first = min(members)
        for m in members:
            out.append((m[1], first[1], len(members), m is first, hashlib.sha256(body.encode()).hexdigest()))
    return sorted(map(repr, out))


def result(spark, rows, **options):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in rows], SCHEMA)
    found = X.exact_groups(docs, **options).select("id", "keep_id", "group_size", "kept", "text_sha256")
    return sorted(repr(tuple(r)) for r in found.collect())


ROWS = (
    [(i, "the same text é") for i in range(40, 60)]
    + [(100 + i, "the  same\ttext é" + " " * (i % 4)) for i in range(9)]
    + [(1, None), (2, ""), (3, " \n"), (4, "\x00"), (5, "\x00\x00"), (None, "lone"), (None, ""), (6, " ")]
    + [(7, "twice"), (7, "twice"), (7, "twice"), (None, "nulls"), (None, "nulls")]
    + [(200, "ab" * 300_000), (201, "ab" * 300_000), (202, "ab" * 299_999 + "ac"), (203, " ")]
)


def test_equals_brute_force(spark):
    assert result(spark, ROWS) == brute_force(ROWS)


def test_empty_table(spark):
    assert result(spark, []) == []


def test_weak_fingerprints_collide_and_are_told_apart(spark):
    rows = [(i, f"text {i % 37}") for i in range(200)] + list(ROWS)
    assert result(spark, rows, moduli=((3, 2), (2, 1))) == brute_force(rows)


@pytest.mark.parametrize("prime,base", X.MODULI)
def test_fingerprints_compose(prime, base):
    rng = random.Random(1)
    data = bytes(rng.randrange(256) for _ in range(5000))
    index = X.MODULI.index((prime, base))
    whole = X.fingerprints([data])[index][0]
    assert whole == sum(b * pow(base, len(data) - 1 - i, prime) for i, b in enumerate(data)) % prime
    for at in (0, 1, 1023, 1024, 1025, 4999, 5000):
        a, b = (X.fingerprints([part])[index][0] for part in (data[:at], data[at:]))
        assert X.joined(a, b, len(data) - at, prime, base) == whole


def test_streaming_comparison():
    n = X.COMPARED_AT_ONCE
    a = b"x" * (3 * n)
    assert X.same(a, bytes(a)) and X.same(b"", b"")
    assert not X.same(a, a[:-1]) and not X.same(a, a[:-1] + b"y") and not X.same(a, b"y" + a[1:])


@pytest.mark.parametrize("size", [0, 1, 1023, 1024, 1025, 1024 * 1024, 1024 * 1024 + 1, 3 * 1024 * 1024 + 5])
def test_a_fingerprint_is_that_of_the_whole_number(size):
    """Short, long and sliced bodies, alone and beside others."""
    body = random.Random(size).randbytes(size)
    want = [0, 0]
    for b in body[: 1 << 20] if size <= 1025 else b"":
        want = [(w * base + b) % prime for w, (prime, base) in zip(want, X.MODULI)]
    if size > 1025:
        half = size // 3
        a, b = X.fingerprints([body[:half]]), X.fingerprints([body[half:]])
        want = [X.joined(x[0], y[0], size - half, prime, base) for x, y, (prime, base) in zip(a, b, X.MODULI)]
    assert [f[0] for f in X.fingerprints([body])] == want
    assert [f[1] for f in X.fingerprints([b"x" * 5000, body, b"", b"yy"])] == want


def test_a_long_text_takes_little_memory():
    """Below six times the text, which is there already."""
    text = "some words of it " * 1_200_000
    work = X._describe(X.MODULI)()
    tracemalloc.start()
    work([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5 * len(text)
