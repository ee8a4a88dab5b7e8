import random
import zlib
from collections import Counter

import pytest

from tarn.llm import spelling as S

LETTERS = "abcdefghijklmnopqrstuvwxyzàé×ÿ"


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def slow_variants(rows):
    """What the contract says, from (id, text), by comparing all pairs of words."""
    n = Counter()
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            if c.isascii() and c.isalpha() or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
                n[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
                run = ""
    n = {w: k for w, k in n.items() if k >= 2 and len(w) >= 7}
    form, close = {}, {}
    for w in n:
        close[w] = [v for v in n if near(w, v)]
        best = min(close[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(close[w]), n.get(form[w]))
    return out


def some_rows(rng):
    words = ["".join(rng.choice(LETTERS) for _ in range(rng.randrange(6, 11))) for _ in range(60)]
    words += ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa", "aaaabaaa", "ÀÉÀÉÀÉÀ", "x" * 5000, "x" * 5001]
    for w in words[:40]:
        for _ in range(6):
            i, c = rng.randrange(len(w)), rng.choice(LETTERS)
            words.append(rng.choice((w[:i] + w[i + 1 :], w[:i] + c + w[i:], w[:i] + c + w[i + 1 :])))
    rows = [(None, None), (1, ""), (2, "7 ... !"), (None, "a null id is empty")]
    for i in range(300):
        text = [rng.choice(words[: rng.choice((8, 60, len(words)))]) for _ in range(rng.randrange(30))]
        rows.append((rng.choice((i, i, -i, None)), rng.choice((" ", "\n", "; ", "5")).join(w.upper() if rng.random() < 0.1 else w for w in text)))
    return rows + rows[20:40]


def found(docs):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in S.variants(docs).collect()}


@pytest.mark.parametrize("alphabets,shared", [((8, 16, 32, 128), 2.0), ((2,), 1e9), ((1,), 1e9), ((128,), 0.0)])
def test_equals_brute_force(spark, monkeypatch, alphabets, shared):
    """Also where reduced words hold many words, or one alone."""
    rows = some_rows(random.Random(3))
    monkeypatch.setattr(S, "ALPHABETS", alphabets)
    monkeypatch.setattr(S, "SHARED", shared)
    monkeypatch.setattr(S, "PLACES_AT_ONCE", 64)
    monkeypatch.setattr(S, "COUNTED_AT_ONCE", 50)
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = found(docs)
    assert got == slow_variants(rows)
    assert any(f and f != r for f, r, *_ in got.values()) or any(f for f, *_ in got.values())


def test_forms_are_followed_to_the_last(spark):
    rows = [(2, "lettersabcd " * 300 + "lettersabce " * 25 + "lettersabfe " * 2)]
    assert all(zlib.crc32(f"2:{w}".encode()) % 31 for w in rows[0][1].split())
    got = found(spark.createDataFrame(rows, "doc_id long, text string"))
    assert got == slow_variants(rows) and got["lettersabfe"][:2] == ("lettersabce", "lettersabcd")


def test_an_empty_table(spark):
    assert S.variants(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@pytest.mark.parametrize("size", [1, 2, 5])
def test_a_neighbourhood_is_full_and_has_each_word_once(size):
    rng = random.Random(size)
    symbols = S.alphabet({c: 1 for c in LETTERS}, size)
    words = ["".join(rng.choice(LETTERS) for _ in range(n)) for n in (1, 2, 5, 9)] + ["aaaa", "ababab"]
    letter = {int(symbols[ord(c)]): c for c in LETTERS}  # one letter for each symbol
    part = S.Reduced(words, symbols)
    for i, w in enumerate(words):
        got = [int(k) for number, keys in part.neighbours(size) for n, k in zip(number, keys) if n == i]
        r = [int(symbols[ord(c)]) for c in w]
        want = {tuple(r)} | {tuple(r[:p] + r[p + 1 :]) for p in range(len(r))}
        want |= {tuple(r[:p] + [s] + r[p + d :]) for p in range(len(r) + 1) for s in range(1, size + 1) for d in (0, 1)}
        hashed = [int(k) for k in S.Reduced(["".join(letter[s] for s in x) for x in want], symbols).keys()]
        assert sorted(got) == sorted(hashed) and len(set(got)) == len(got)
