"""Spelling variants by the one-edit neighbourhoods of words in a reduced alphabet.

Words are counted over all texts. Two words are near if they differ by exactly
one inserted, deleted or replaced code point. A word's form is its near word of
largest count, if that is at least RATIO times its own; its root is the last
word that forms lead to.

Finding the near words:

1. Letters are dealt to a few symbols, about equally frequent, and each word is
   rewritten in them. The alphabet is the smallest of ALPHABETS in which words
   share their reduced word with at most SHARED words on average, themselves
   included; the last one keeps every letter apart. So no reduced word holds an
   unbounded share of the vocabulary, and every choice finds all near words.
2. Each reduced word gives its full one-edit neighbourhood: itself and every
   deletion, replacement and insertion of a symbol, as 64-bit hashes that follow
   from sums over the word's beginning, in the same time for words of any length.
   Words that are near have reduced words that are equal or one edit apart.
3. The neighbourhoods are joined with the reduced vocabulary, each pair from one
   side. A bitmap of the reduced vocabulary, of MOST_BITS at most, keeps other
   neighbours out of the shuffle.
4. Pairs are verified on the words themselves.

A word has at most so many near words as letters and places allow, however large
the vocabulary. Forms have counts that grow RATIO-fold at each step, so roots
come from a few joins that double the steps.

Defined cases: a null text has no words; a null id counts as an empty one in the
hash that damages words. Repeated rows count again. Very long texts and words are
read whole. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import bitmap, blocks, cut, id_and_text

LEAST_LETTERS, LEAST_COUNT, RATIO = 7, 2, 10
#: A run is damaged if this divides its hash.
DAMAGED = 31
#: Distinct words that a task counts before it passes them on.
COUNTED_AT_ONCE = 300_000
#: The last alphabet has a symbol for each letter there is.
ALPHABETS, SHARED = (8, 16, 32, 128), 2.0
LEAST_BITS, MOST_BITS, BITS_A_WORD = 1 << 20, 1 << 28, 32
#: Places in words whose neighbours are made at once, for an alphabet of eight; fewer for larger ones.
PLACES_AT_ONCE = 1 << 15
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def runs(text: str) -> list[str]:
    """The runs of at least LEAST_LETTERS letters, A-Z in lower case."""
    return _RUN.findall(text.encode().lower().decode())  # bytes' lower() acts on ASCII alone


_RUN = re.compile(f"[a-zÀ-ÿ]{{{LEAST_LETTERS},}}")


def counted(texts: Iterator[tuple[str, str]]) -> Counter:
    """How often each word occurs in texts given with their ids; damaged runs lose a letter."""
    found: Counter = Counter()
    for key, text in texts:
        start = zlib.crc32(f"{key}:".encode())
        for word, n in Counter(runs(text)).items():
            h = zlib.crc32(word.encode(), start)
            if h % DAMAGED == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
                if len(word) < LEAST_LETTERS:
                    continue
            found[word] += n
    return found


def vocabulary(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(word, n) of all words with LEAST_COUNT occurrences."""
    rows = id_and_text(docs, id_col, text_col)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_pydict({"word": pa.array(found.keys(), pa.string()), "n": pa.array(found.values(), pa.int64())})
            found.clear()
            return out

        for batch in batches:
            keys, texts = batch.columns
            for i, j in blocks(pc.binary_length(texts).to_pylist()):
                found.update(counted(zip(keys.slice(i, j - i).to_pylist(), texts.slice(i, j - i).to_pylist())))
                if len(found) > COUNTED_AT_ONCE:
                    yield passed_on()
        yield passed_on()

    counts = rows.select(F.coalesce(F.col("id").cast("string"), F.lit("")).alias("key"), "text").mapInArrow(
        count, "word string, n long"
    )
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def alphabet(letters: dict[str, int], size: int) -> np.ndarray:
    """The symbol (1..size) of each code point below 256; the most frequent letters go to the lightest symbols."""
    weights, symbols = [0] * size, np.ones(256, np.uint64)
    for letter, n in sorted(letters.items(), key=lambda x: (-x[1], x[0])):
        lightest = weights.index(min(weights))
        weights[lightest] += n
        symbols[ord(letter)] = lightest + 1
    return symbols


class Reduced:
    """Words rewritten in a reduced alphabet, side by side."""

    def __init__(self, words: list[str], symbols: np.ndarray):
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.symbol = symbols[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.word = np.repeat(np.arange(len(words)), self.lengths)
        self.place = np.arange(len(self.symbol)) - self.starts[self.word]
        most = int(self.lengths.max(initial=0)) + 1
        self.power = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(most, _BASE, np.uint64))))
        # Sums over all words, from which those within a word are differences.
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.symbol * self.power[self.place])))
        self.begun = self.sums[self.starts]
        self.whole = self.sums[self.starts + self.lengths] - self.begun

    def keys(self) -> np.ndarray:
        """A hash for each reduced word."""
        return mixed(self.whole, self.lengths)

    def neighbours(self, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(number of a word, hash of a neighbour): each reduced word itself, and all that are one edit away, once."""
        number = np.arange(len(self.lengths))
        yield number, self.keys()
        choices = np.arange(1, size + 1, dtype=np.uint64)
        step = PLACES_AT_ONCE * 8 // size
        for a in range(0, len(self.symbol), step):
            at = np.arange(a, min(a + step, len(self.symbol)))
            word, place, own = self.word[at], self.place[at], self.symbol[at]
            power, whole, length = self.power[place], self.whole[word], self.lengths[word]
            before = self.sums[at] - self.begun[word]
            after = whole - before - own * power
            # Of a run of one symbol, the first is deleted; a symbol is inserted behind the run, not in it.
            first = (place == 0) | (own != self.symbol[at - 1])
            yield word[first], mixed(before + after * np.uint64(_INVERSE), length - 1)[first]
            other = choices[None, :] != own[:, None]
            rows = np.broadcast_to(word[:, None], other.shape)[other]
            replaced = whole[:, None] + (choices[None, :] - own[:, None]) * power[:, None]
            yield rows, mixed(replaced, length[:, None])[other]
            inserted = before[:, None] + choices[None, :] * power[:, None] + ((after + own * power) * np.uint64(_BASE))[:, None]
            yield rows, mixed(inserted, length[:, None] + 1)[other]
        last = self.whole[:, None] + choices[None, :] * self.power[self.lengths][:, None]
        yield np.repeat(number, size), mixed(last, self.lengths[:, None] + 1).ravel()


def mixed(sums: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a polynomial sum and a length."""
    x = sums + np.asarray(length).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(_BASE)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def reduced(words: DataFrame, letters: dict[str, int]) -> tuple[DataFrame, np.ndarray, int]:
    """(word, n, key of the reduced word), the symbols and their number."""
    total = words.count()
    for size in ALPHABETS:
        symbols = alphabet(letters, size)

        def keyed(batches: Iterator[pa.RecordBatch], symbols=symbols) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keys = Reduced(batch.column("word").to_pylist(), symbols).keys()
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], ["word", "n", "key"])

        found = cut(words.select("word", "n").mapInArrow(keyed, "word string, n long, key long"))
        sizes = found.groupBy("key").agg(F.count("*").alias("c"))
        shared = sizes.agg(F.sum(F.col("c") * F.col("c"))).first()[0] or 0
        if shared <= SHARED * total or size == ALPHABETS[-1]:
            return found, symbols, size
    raise AssertionError


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n) of all near words, both ways, from (word, n)."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    known, symbols, size = reduced(words, {r[0]: r[1] for r in letters.collect() if r[0]})  # some 90 letters at most
    wanted = BITS_A_WORD * known.count()
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (wanted - 1).bit_length() if wanted else 0))
    there = words.sparkSession.sparkContext.broadcast(bitmap(known, F.col("key"), bits))

    def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(there.value, np.uint8)
        for batch in batches:
            words, counts = batch.column("word"), batch.column("n")
            for i, j in blocks(pc.binary_length(words).to_pylist(), PLACES_AT_ONCE):
                part = Reduced(words.slice(i, j - i).to_pylist(), symbols)
                own = part.keys()
                for number, key in part.neighbours(size):
                    at = key & (bits - 1)
                    hit = (held[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
                    hit &= key >= own[number]  # the other side finds the rest
                    taken = pa.array(number[hit] + i)
                    yield pa.RecordBatch.from_arrays(
                        [words.take(taken), counts.take(taken), pa.array(key[hit]), pa.array((key == own[number])[hit])],
                        ["word", "n", "key", "equal"],
                    )

    pairs = known.mapInArrow(neighbours, "word string, n long, key long, equal boolean").join(
        known.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key"
    )
    # Words of one reduced word find each other from both sides.
    pairs = pairs.where((~F.col("equal") | (F.col("word") < F.col("near"))) & (F.levenshtein("word", "near", 1) == 1))
    ways = F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))
    return pairs.select(F.inline(ways))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) from (word, form): the last word that forms lead to."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    while True:
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        now = after.select("word", "root")
        if after.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = cut(vocabulary(docs, id_col, text_col))
    best = near_words(words).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct(-F.col("near_n"), F.col("near"))).alias("best")
    )
    large = -F.col("best.col1") >= RATIO * F.col("n")
    found = cut(
        words.join(best, "word", "left").select(
            "word",
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(large, F.col("best.near")).alias("form"),
            F.when(large, -F.col("best.col1")).alias("form_n"),
        )
    )
    return found.join(roots(found.where("form IS NOT NULL")), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
