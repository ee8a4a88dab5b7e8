import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from tarn.llm import byte_bpe as B
from tarn.llm.queries import op10_merge_replay_bpe

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = B.read_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def texts():
    rng = random.Random(6)
    alphabet = "abetho  '\n\té ñ漢字\x1c \xa0\x85 12!?#.,-\x00😀́İſ's'll"
    out = ["", " ", "  ", "a", " a", "a  b", "a\n  b", "\xa0  b", "it's we'LL", "<|endoftext|>", "aaaaaaaaaaaaa", "x " * 5]
    out += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(1, 300))) for _ in range(300)]
    return [*out, "ab" * 5_000, "the quick brown fox. " * 5_000]


def test_ids_equal_the_library():
    encoder, tokens = B.Encoder(RANKS, P.PATTERN), sorted(RANKS, key=RANKS.get)
    found = encoder.encode(texts())
    for text, ids in zip(texts(), found):
        want = LIBRARY.encode_ordinary(text)
        assert ids == b"".join(i.to_bytes(4, "little") for i in want)
        assert B.decode(ids, tokens) == text.encode()


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(B, "KEPT_PIECES", 20)
    encoder = B.Encoder(RANKS, P.PATTERN)
    assert [encoder.encode([t])[0] for t in texts()] == B.Encoder(RANKS, P.PATTERN).encode(texts())


@pytest.mark.parametrize("rows", [[], [(None, None), (1, ""), (1, "a"), (1, "a"), (2, "Hé llo\n")]])
def test_rows(spark, rows):
    docs = spark.createDataFrame([(i, t, 0, "") for i, t in rows], "doc_id long, text string, n_tokens int, ids string")
    found = B.encode_and_decode(docs, PATH, P.PATTERN).collect()
    assert sorted(repr((r.id, bytes(r.decoded).decode(), r.n_tokens)) for r in found) == sorted(
        repr((i, t or "", len(LIBRARY.encode_ordinary(t or "")))) for i, t in rows
    )


def test_query_equals_the_library(spark):
    sf = "/root/testdata/sf0.001"
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op10_merge_replay_bpe(spark, sf).collect()
    assert len(found) == len(text)
    for r in found:
        ids = LIBRARY.encode_ordinary(text[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(b"".join(i.to_bytes(4, "little") for i in ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text[r.doc_id].encode()).hexdigest()
