"""Byte-level BPE encoding and decoding by merge replay over distinct pieces.

A pattern splits texts into pieces. The distinct pieces that a Python worker has
not met yet are laid out as one sequence of byte tokens, and an inverted index
lists for each adjacent pair where it stands. The pairs are then replayed in
rank order: a merge visits its listed positions, joins each that still holds the
pair, and enters the two pairs that the new token forms with its neighbours.
Nothing else is looked at again. Each distinct piece is so encoded once, and
texts are put together from the pieces' ids.

The corpus that is replayed together is that of a block of texts: one shared
table of all pieces would have to be joined back to every word of every text.
What a Python worker keeps for its next block or task is bounded: pieces are
forgotten when there are over KEPT_PIECES of them, or over KEPT_BYTES in them.

The rank file is read on the driver and broadcast; a vocabulary has a fixed
size, whatever the data.

Defined cases: a null text counts as empty and gives no ids. No text is ever
cut. Rows, repeated ones too, stay as they are. An empty table gives an empty
result.
"""

from __future__ import annotations

import base64
import heapq
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarn.llm.common import id_and_text, kept_in_worker, map_texts

KEPT_PIECES, KEPT_BYTES, KEPT_PAIRS = 300_000, 16_000_000, 250_000
WHITE = " \t\n\r\x0b\x0c"
#: White space and the text up to the next white space: the pattern never matches across the end of one.
SEGMENT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: Other characters that some rules count as white space; texts that hold one are split by the pattern alone.
_ODD = (*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ODD_SPACE = re.compile("[" + "".join(map(chr, _ODD)) + "]")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from lines of base64 and rank."""
    with open(path, "rb") as file:
        return {base64.b64decode(t): int(n) for t, n in (line.split() for line in file if line.strip())}


class Vocabulary:
    """Ranks of tokens, which are also their ids, and of pairs of tokens."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.size = max(ranks.values()) + 1
        self.tokens = [b""] * self.size
        for token, n in ranks.items():
            self.tokens[n] = token
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs: dict[int, int] = {}

    def rank(self, pair: int) -> int:
        """The rank of a pair left * size + right, or -1 if the two don't merge."""
        found = self.pairs.get(pair)
        if found is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs = {}
            left, right = divmod(pair, self.size)
            found = self.pairs[pair] = self.ranks.get(self.tokens[left] + self.tokens[right], -1)
        return found


class _Index:
    """From each pair that merges to the positions where it has come to stand; and the pairs by rank."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.where, self.queue = vocabulary, {}, []

    def enter(self, left: np.ndarray, right: np.ndarray, positions: np.ndarray) -> None:
        pairs = left * self.vocabulary.size + right
        order = np.argsort(pairs, kind="stable")
        pairs, positions = pairs[order], positions[order]
        fresh = np.ones(len(pairs), dtype=bool)
        np.not_equal(pairs[1:], pairs[:-1], out=fresh[1:])
        edges = np.flatnonzero(fresh)
        for pair, start, stop in zip(pairs[edges].tolist(), edges.tolist(), [*edges[1:].tolist(), len(pairs)]):
            rank = self.vocabulary.rank(pair)
            if rank >= 0:
                if pair not in self.where:
                    self.where[pair] = []
                    heapq.heappush(self.queue, (rank, pair))
                self.where[pair].append(positions[start:stop])

    def take(self) -> tuple[int, int, np.ndarray]:
        """The pair of the lowest rank: its rank, the pair, and its positions."""
        rank, pair = heapq.heappop(self.queue)
        found = self.where.pop(pair)
        return rank, pair, np.concatenate(found) if len(found) > 1 else found[0]


def replay(pieces: list[bytes], vocabulary: Vocabulary) -> list[bytes]:
    """The ids of each piece, as little-endian unsigned 32-bit integers."""
    whole = [vocabulary.ranks.get(p) for p in pieces]  # a piece that is a token needs no merges
    rest = [p for p, n in zip(pieces, whole) if n is None]
    sizes = np.array([len(p) for p in rest], dtype=np.int64)
    ends = np.cumsum(sizes)
    token = vocabulary.of_byte[np.frombuffer(b"".join(rest), dtype=np.uint8)]
    after, before = np.arange(1, len(token) + 1), np.arange(-1, len(token) - 1)
    after[ends - 1], before[ends - sizes] = -1, -1
    index = _Index(vocabulary)
    at = np.flatnonzero(after >= 0)
    index.enter(token[at], token[at + 1], at)
    while index.queue:
        merged, pair, at = index.take()
        a, b = divmod(pair, vocabulary.size)
        follow = after[at]
        at = at[(token[at] == a) & (follow >= 0) & (token[follow] == b)]  # elsewhere a neighbour took one of them
        if a == b:  # listed for either token, perhaps; of overlapping places, every other one from the left
            taken, last = [], -1
            for i in sorted(set(at.tolist())):
                if i != last:
                    taken.append(i)
                    last = after[i]
            at = np.array(taken, dtype=np.int64)
        if not at.size:
            continue
        absorbed = after[at]
        right = after[absorbed]
        token[at], token[absorbed], after[at] = merged, -1, right
        has = right >= 0
        before[right[has]] = at[has]
        left = before[at]
        index.enter(token[at[has]], token[right[has]], at[has])
        has = left >= 0
        index.enter(token[left[has]], token[at[has]], left[has])
    alive = token >= 0
    packed = token[alive].astype("<u4").tobytes()
    stops = (4 * np.concatenate(([0], np.cumsum(alive)))[ends]).tolist() if rest else []
    cuts = iter(zip([0, *stops], stops))
    out = []
    for n in whole:
        if n is None:
            start, stop = next(cuts)
            out.append(packed[start:stop])
        else:
            out.append(n.to_bytes(4, "little"))
    return out


class Encoder:
    """Encodes blocks of texts; keeps what it has learnt of pieces for the next block."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.vocabulary, self.split = Vocabulary(ranks), regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.size = 0

    def _learn(self, segments: set[str]) -> None:
        parts = {s: self.split(s) for s in segments}
        pieces = list({p for found in parts.values() for p in found})
        ids = dict(zip(pieces, replay([p.encode() for p in pieces], self.vocabulary)))
        for segment, found in parts.items():
            self.known[segment] = known = ids[found[0]] if len(found) == 1 else b"".join([ids[p] for p in found])
            self.size += len(segment) + len(known)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.known) > KEPT_PIECES or self.size > KEPT_BYTES:
            self.known, self.size = {}, 0
        parts = [self.split(t) if ODD_SPACE.search(t) else SEGMENT.findall(t) for t in texts]
        self._learn({s for found in parts for s in found if s not in self.known})
        known = self.known
        return [b"".join([known[s] for s in found]) for found in parts]


def decode(ids: bytes, tokens: list[bytes]) -> bytes:
    """The bytes that little-endian ids stand for."""
    return b"".join([tokens[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


def encode_and_decode(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, ids (binary, little-endian unsigned 32-bit), n_tokens, decoded (binary)."""
    known = read_ranks(ranks_path)
    ranks, name = docs.sparkSession.sparkContext.broadcast(known), (hash(frozenset(known.items())), pattern)

    def make():
        encoder = kept_in_worker(name, lambda: Encoder(ranks.value, pattern))
        tokens = encoder.vocabulary.tokens

        def work(texts):
            ids = encoder.encode(texts)
            return {
                "ids": ids,
                "n_tokens": [len(i) // 4 for i in ids],
                "decoded": [decode(i, tokens) for i in ids],
            }

        return work

    fields = [
        T.StructField("ids", T.BinaryType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("decoded", T.BinaryType()),
    ]
    return map_texts(id_and_text(docs, id_col, text_col), fields, make)
