"""Token counts by a compiled finite-state tokenizer.

The tokenizer (lower case, no white space, BPE with word ends) becomes two
deterministic transducers that count tokens without making them.

The splitter reads character classes and marks where a word starts. It has six
states, so what a chunk of text does to the state is one of a few dozen maps
from states to states. These maps are numbered, with a table of their products.
All chunks of a block of texts are reduced to their maps side by side; a
parallel prefix scan composes the maps and gives each chunk its entry state;
then all chunks are run side by side from there. A huge text is many chunks like
any others.

The word transducer reads a word's bytes. Its state holds what the tokens of all
continuations can depend on: the longest end of the word so far that may begin
a token, and, at each boundary in it where a token may begin, the last token of
the best split before it. A token may follow another where BPE on the two alone leaves both as they are; so each
state and byte have one next state, and the transition carries the change of
the token count (which may be negative when tokens merge). The last byte of a
word takes a final transition. Transitions are compiled when a text first needs
them, and kept in tables that all words of a block step through side by side.

Memory is bounded: blocks have a bounded size, and a task drops the compiled
transitions between blocks when there are over KEPT_STATES states.

Defined cases: a null text counts as empty and has no tokens. The two special
strings inside a text count one token each, as the library has it by default.
Rows, repeated ones too, stay as they are. An empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

import json
import re
import sys
import unicodedata
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import id_and_text, kept_in_worker, map_texts

LIMIT = 2048
CHUNK = 256
KEPT_STATES = 250_000
KEPT_PAIRS = 1_000_000
WORD_END = "</w>"
UNKNOWN = -32768
#: The only split pattern that is compiled here (a fixed value).
SPLIT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Stands between texts; no text can hold a lone surrogate.
BREAK = "\udfff"

LETTER, NUMBER, SPACE, OTHER, SHORT_FORM, LONG_FORM, RESET, NOTHING = range(8)
START, IN_LETTERS, DONE, IN_OTHER, ONE_MORE, TWO_MORE = range(6)


def _transition(state: int, kind: int) -> tuple[int, bool]:
    """The next state, and whether this character starts a word."""
    if kind == NOTHING:
        return state, False
    if kind in (SPACE, RESET):
        return START, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if state == ONE_MORE:
        return DONE, False
    if kind == LETTER:
        return IN_LETTERS, state != IN_LETTERS
    if kind == NUMBER:
        return DONE, True
    if state == IN_OTHER:
        return IN_OTHER, False
    return {OTHER: IN_OTHER, SHORT_FORM: ONE_MORE, LONG_FORM: TWO_MORE}[kind], True


NEXT = np.array([[_transition(s, k)[0] for k in range(8)] for s in range(6)], dtype=np.uint8)
STARTS = np.array([[_transition(s, k)[1] for k in range(8)] for s in range(6)], dtype=bool)


@cache
def _state_maps() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each character class its map's number; products of maps; where each map takes START."""
    of_class = [tuple(int(NEXT[s, k]) for s in range(6)) for k in range(8)]
    maps = list(dict.fromkeys(of_class))
    for f in maps:
        for g in of_class:
            if (fg := tuple(g[s] for s in f)) not in maps:
                maps.append(fg)
    number = {f: i for i, f in enumerate(maps)}
    product = np.array([[number[tuple(g[s] for s in f)] for g in maps] for f in maps], dtype=np.uint16)
    return (
        np.array([number[f] for f in of_class], dtype=np.uint16),
        product,
        np.array([f[START] for f in maps], dtype=np.uint8),
    )


@cache
def _classes() -> np.ndarray:
    """The class of each code point."""
    kinds = np.full(sys.maxunicode + 1, OTHER, dtype=np.uint8)
    for c in range(sys.maxunicode + 1):
        major = unicodedata.category(chr(c))[0]
        if major in "LN":
            kinds[c] = LETTER if major == "L" else NUMBER
    spaces = [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
    kinds[spaces] = SPACE
    kinds[ord(BREAK)] = RESET
    return kinds


def normalised(text: str) -> str:
    """NFC, then each character in lower case by itself."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()


def word_starts(points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where words start in a sequence of code points of the given classes."""
    number, product, from_start = _state_maps()
    n = len(points)
    after = np.concatenate((points[1:], [0, 0])).astype(np.uint32)
    quote = np.flatnonzero(points == ord("'"))
    if quote.size:
        kinds = kinds.copy()
        one, two = after[quote], after[quote + 1]
        kinds[quote[np.isin(one, [ord(c) for c in "stmd"])]] = SHORT_FORM
        for a, b in ("re", "ve", "ll"):
            kinds[quote[(one == ord(a)) & (two == ord(b))]] = LONG_FORM
    chunks = -(-n // CHUNK)
    padded = np.full(chunks * CHUNK, NOTHING, dtype=np.uint8)
    padded[:n] = kinds
    by_place = np.ascontiguousarray(padded.reshape(chunks, CHUNK).T)
    total = number[by_place[0]]
    for place in by_place[1:]:
        total = product[total, number[place]]
    step = 1
    while step < chunks:  # inclusive prefix scan
        total = np.concatenate((total[:step], product[total[:-step], total[step:]]))
        step *= 2
    state = np.concatenate(([START], from_start[total[:-1]])).astype(np.uint8)
    marks = np.empty((CHUNK, chunks), dtype=bool)
    for i, place in enumerate(by_place):
        marks[i] = STARTS[state, place]
        state = NEXT[state, place]
    return np.flatnonzero(marks.T.reshape(-1)[:n])


class WordTransducer:
    """Counts the BPE tokens of words; compiled as words need it."""

    def __init__(self, merges: list[tuple[str, str]]):
        shown = _byte_characters()
        self.shown = shown
        self.rank = {pair: i for i, pair in enumerate(merges)}
        self.tokens = {*shown, *(c + WORD_END for c in shown), *(a + b for a, b in merges)}
        #: What of a token's letters can stand before its last one.
        self.beginnings = {t[:i] for t in (t.removesuffix(WORD_END) for t in self.tokens) for i in range(len(t))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = ("", (None,), (0,))
        self.states, self.number = [start], {start: 0}
        self.bytes: list[int] = []  # the byte of each column of the tables
        self.column = np.full(256, -1, dtype=np.int64)
        self.next, self.change, self.final = self._tables(1024, 64)

    @staticmethod
    def _tables(states: int, columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Next state, change of the count, and change by a word's last byte; with marks where nothing is compiled."""
        shape = (states, columns)
        return np.full(shape, -1, np.int32), np.zeros(shape, np.int16), np.full(shape, UNKNOWN, np.int16)

    def _grow(self, states: int, columns: int) -> None:
        tables = self._tables(states, columns)
        for new, old in zip(tables, (self.next, self.change, self.final)):
            new[: old.shape[0], : old.shape[1]] = old
        self.next, self.change, self.final = tables

    def _columns(self, data: np.ndarray) -> np.ndarray:
        """Each byte's column; bytes that are new get one."""
        for byte in np.flatnonzero(np.bincount(data, minlength=256)).tolist():
            if self.column[byte] < 0:
                self.column[byte] = len(self.bytes)
                self.bytes.append(byte)
        if len(self.bytes) > self.next.shape[1]:
            self._grow(self.next.shape[0], min(256, 2 * len(self.bytes)))
        return self.column[data]

    def merged(self, symbols: list[str]) -> list[str]:
        """BPE, the lowest rank first."""
        while len(symbols) > 1:
            best = min(range(len(symbols) - 1), key=lambda i: self.rank.get((symbols[i], symbols[i + 1]), 1 << 30))
            pair = (symbols[best], symbols[best + 1])
            if pair not in self.rank:
                break
            out, i = [], 0
            while i < len(symbols):
                if i + 1 < len(symbols) and (symbols[i], symbols[i + 1]) == pair:
                    out.append(pair[0] + pair[1])
                    i += 2
                else:
                    out.append(symbols[i])
                    i += 1
            symbols = out
        return symbols

    def _follows(self, last: str | None, token: str, final: bool) -> bool:
        """Whether a best split may have these two tokens in a row."""
        known = self.pairs.get((last, token))
        if known is None:
            if len(self.pairs) > KEPT_PAIRS:
                self.pairs = {}
            letters = list(token.removesuffix(WORD_END) if final else token)
            if final:
                letters[-1] += WORD_END
            before = list(last) if last else []
            known = self.merged(before + letters) == ([last] if last else []) + [token]
            self.pairs[last, token] = known
        return known

    def _last_token(self, state: tuple, letter: str, final: bool) -> tuple[str, int]:
        """The last token after one more letter, and the count then, against the count in the state."""
        end, lasts, counts = state
        text = end + letter
        for i in range(len(text) - 1, -1, -1):
            token = text[i:] + WORD_END if final else text[i:]
            if token in self.tokens and self._follows(lasts[i], token, final):
                return token, counts[i] + 1
        raise AssertionError("a single byte is always a token")

    def _compile(self, state: int, column: int) -> None:
        letter, old = self.shown[self.bytes[column]], self.states[state]
        token, count = self._last_token(old, letter, False)
        text, lasts, counts = old[0] + letter, (*old[1], token), (*old[2], count)
        # Only boundaries where a token may begin and reach beyond the end so far can matter again.
        live = [text[i:] in self.beginnings for i in range(len(text) + 1)]
        skip = live.index(True)
        new = (
            text[skip:],
            tuple(t if x else "" for t, x in zip(lasts[skip:], live[skip:])),
            tuple(c - count if x else 0 for c, x in zip(counts[skip:], live[skip:])),
        )
        number = self.number.get(new)
        if number is None:
            number = self.number[new] = len(self.states)
            self.states.append(new)
            if number >= len(self.next):
                self._grow(2 * len(self.next), self.next.shape[1])
        self.next[state, column] = number
        self.change[state, column] = count

    def count(self, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The tokens of each word data[start : start + length]."""
        if len(self.states) > KEPT_STATES:
            self.reset()
        read = self._columns(data)
        width = self.next.shape[1]
        order = np.argsort(-lengths, kind="stable")
        at, size = starts[order], lengths[order]
        state = np.zeros(len(order), dtype=np.int64)
        total = np.zeros(len(order), dtype=np.int64)
        # How many words have over k + 1 bytes: those that step on from byte k.
        longer = np.searchsorted(-size, -np.arange(2, int(size[0]) + 1 if len(size) else 1), side="right")
        for k, m in enumerate(longer.tolist()):
            key = state[:m] * width + read[at[:m] + k]
            found = self.next.reshape(-1)[key]
            if (found < 0).any():
                for missing in np.unique(key[found < 0]).tolist():
                    self._compile(*divmod(missing, width))
                found = self.next.reshape(-1)[key]
            total[:m] += self.change.reshape(-1)[key]
            state[:m] = found
        key = state * width + read[at + size - 1]
        found = self.final.reshape(-1)[key]
        if (found == UNKNOWN).any():
            for missing in np.unique(key[found == UNKNOWN]).tolist():
                s, column = divmod(missing, width)
                letter = self.shown[self.bytes[column]]
                self.final[s, column] = self._last_token(self.states[s], letter, True)[1]
            found = self.final.reshape(-1)[key]
        out = np.empty(len(order), dtype=np.int64)
        out[order] = total + found
        return out


def _byte_characters() -> list[str]:
    """The character that stands for each byte in the vocabulary: itself if it is printable, else the next free one."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(free)) for b in range(256)]


class Counter:
    """Counts the tokens of texts as the library does with the given tokenizer file."""

    def __init__(self, spec: str):
        self.specials, merges = _read(spec)
        self.words = WordTransducer(merges)

    def count(self, texts: list[str]) -> list[int]:
        found = np.zeros(len(texts), dtype=np.int64)
        parts, owner = [], []
        for i, text in enumerate(texts):
            if "<|" in text and (pieces := self.specials.split(text))[1:]:
                found[i] += len(pieces) - 1
            else:
                pieces = [text]
            parts += [normalised(p) for p in pieces]
            owner += [i] * len(pieces)
        line = BREAK.join(parts) + BREAK
        points = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        kinds = _classes()[points]
        starts = word_starts(points, kinds)
        if not starts.size:
            return found.tolist()
        breaks = np.flatnonzero((kinds == SPACE) | (kinds == RESET))
        ends = np.minimum(
            np.concatenate((starts[1:], [len(points)])), breaks[np.searchsorted(breaks, starts)]
        )
        data = np.frombuffer(line.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        widths = 1 + (points >= 0x80).view(np.int8) + (points >= 0x800).view(np.int8) + (points >= 0x10000).view(np.int8)
        offsets = np.concatenate(([0], np.cumsum(widths, dtype=np.int64)))
        counts = self.words.count(data, offsets[starts], offsets[ends] - offsets[starts])
        resets = np.flatnonzero(kinds == RESET)
        of_part = np.bincount(np.searchsorted(resets, starts), weights=counts, minlength=len(parts))
        np.add.at(found, owner, of_part.astype(np.int64))
        return found.tolist()


def _read(spec: str) -> tuple[re.Pattern, list[tuple[str, str]]]:
    """The special strings and the merges; refuses a tokenizer that is not of this kind."""
    whole = json.loads(spec)
    model, before = whole["model"], whole["pre_tokenizer"]["pretokenizers"]
    kinds = [n["type"] for n in whole["normalizer"]["normalizers"]]
    specials = whole["added_tokens"]
    if not (
        model["type"] == "BPE"
        and model["end_of_word_suffix"] == WORD_END
        and not model["continuing_subword_prefix"]
        and not model["ignore_merges"]
        and kinds == ["NFC", "Replace", "Lowercase"]
        and [b["type"] for b in before] == ["Split", "ByteLevel"]
        and before[0]["pattern"] == {"Regex": SPLIT_PATTERN}
        and not any(s["normalized"] or s["lstrip"] or s["rstrip"] or s["single_word"] for s in specials)
        and all(s["content"].startswith("<|") for s in specials)
    ):
        raise ValueError("this tokenizer is of another kind")
    merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
    return re.compile("|".join(re.escape(s["content"]) for s in specials)), merges


def token_counts(
    docs: DataFrame, tokenizer_path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of docs: id, n_bytes (UTF-8), n_tokens, over_limit."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = file.read()
    _read(spec)
    shared, name = docs.sparkSession.sparkContext.broadcast(spec), hash(spec)

    def make():
        counter = kept_in_worker(("token counts", name), lambda: Counter(shared.value))

        def work(texts):
            return {"n_bytes": [len(t.encode()) for t in texts], "n_tokens": counter.count(texts)}

        return work

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())]
    return map_texts(id_and_text(docs, id_col, text_col), fields, make).withColumn(
        "over_limit", F.col("n_tokens") > F.lit(limit)
    )
