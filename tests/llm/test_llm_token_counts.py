import random

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tarn.llm import token_counts as K
from tarn.llm.queries import op3_transducer_token_counts

PATH = P.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def counter():
    with open(PATH, encoding="utf-8") as file:
        return K.Counter(file.read())


def expected(text):
    return len(LIBRARY.encode(text or "", add_special_tokens=False).ids)


def texts():
    rng = random.Random(1)
    odd = "abetho  '\n\té ñ漢字\x1c \xa0\x85 12!?#.,-\x00😀́İſ's'll'reΣσß<|>Ǆ½²Ⅷ"
    out = ["", " ", "a", "it's we'LL they're 'tis ''s \"'s a's 1's x'r x're 'r", "ΑΣ ΟΔΟΣ Σ", "'", "''", "'r'e"]
    out += ["<|endoftext|>a<|startoftext|>", "hello<|endoftext|>world", "<|endoftext|><|endoftext|>", "<|endoftext"]
    out += ["".join(rng.choice(odd) for _ in range(rng.randrange(1, 300))) for _ in range(400)]
    out += ["".join(rng.choice("thesinganderouxüß") for _ in range(rng.randrange(1, 30))) for _ in range(1000)]
    return [*out, "a" * 1000, "ab" * 3000, "it's 12 o'clock! " * 20_000, "'" * 700, "x" * 255 + "'ll", "x" * 254 + "'ve y"]


def test_counts_equal_the_library(counter):
    found = counter.count(texts())
    assert [(t[:50], n) for t, n in zip(texts(), found)] == [(t[:50], expected(t)) for t in texts()]


def test_dropping_compiled_states_changes_nothing(counter, monkeypatch):
    want = counter.count(texts())
    monkeypatch.setattr(K, "KEPT_STATES", 50)
    monkeypatch.setattr(K, "KEPT_PAIRS", 50)
    got = [counter.count([t])[0] for t in texts()]
    assert got == want


@pytest.mark.parametrize("chunk", [1, 2, 7, 256])
def test_chunk_maps_compose(chunk, monkeypatch):
    """Chunks of any length mark the same starts as one run over all characters."""
    line = K.BREAK.join(K.normalised(t) for t in texts()[:200]) + K.BREAK
    points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kinds = K._classes()[points]
    monkeypatch.setattr(K, "CHUNK", len(points))
    whole = K.word_starts(points, kinds)
    monkeypatch.setattr(K, "CHUNK", chunk)
    assert np.array_equal(K.word_starts(points, kinds), whole)


def test_other_tokenizers_are_refused():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as file, pytest.raises((ValueError, KeyError, TypeError)):
        K.Counter(file.read())


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, "a b"), (1, "a b"), (2, "x " * 3000)]])
def test_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, n_tokens int")
    found = K.token_counts(docs, PATH).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(
        repr((i, len((t or "").encode()), expected(t), expected(t) > 2048)) for i, t in rows
    )


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op3_transducer_token_counts(spark, sf).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in found} == {
        i: (len(t.encode()), expected(t)) for i, t in text.items()
    }
