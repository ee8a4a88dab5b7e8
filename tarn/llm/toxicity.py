"""Toxicity scores by a character n-gram linear classifier with naive Bayes log-count ratios.

Features are the character n-grams of a text's words, with marks at the words'
ends, hashed. A feature's value is how often it stands in the text's distinct
words, scaled by the feature's naive Bayes log-count ratio: the logarithm of
how much more often toxic training texts hold it than others, smoothed toward
equality. Ratios are counted over all training rows. Features whose ratio lies
within DULL of zero say nothing and are left out. A logistic regression on the
scaled features is fitted on at most about FIT_ROWS training rows with about
FIT_ENTRIES features, taken one by one by a hash of ids and row numbers, so that a
hot id comes as often as others, and gives the weights.

So a text's score is a sum over its distinct words; a block of texts hashes the
n-grams of its distinct words together.

Training rows are those whose label is known and whose id is not held out; an id
is held out if crc32(id as text) mod 5 is 0. Only texts enter a score. Without
training rows of both labels the score is their share of label 1, or 0.

Defined cases: a null or empty text has no words and is scored by the bias
alone. A row with a null id is scored, and counts as not held out (it has no
label). Of several labels of one id the largest counts. Repeated rows are
scored alike. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import blocks, column, cut, id_and_text, map_texts, small_batches, stored, temporary
from tarn.llm.linear import fit_logistic, probability

ORDERS = (3, 4, 5, 6)
SIZE = 1 << 18
SMOOTHING, DULL = 30.0, 1.0
FIT_ROWS, FIT_ENTRIES = 20_000, 30_000_000
RIDGE, ROUNDS = 1e-4, 1000
FOLDS = 5
BITMAP_BITS = 1 << 26
#: Bytes of texts that are counted together, and features of a batch that a task returns.
WORD_BYTES, COUNTS_AT_ONCE = 1_000_000, 1 << 15
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str) -> set[str]:
    """The distinct words of a text: runs of letters, in lower case."""
    return set(_WORD.findall(text.lower()))


class Words:
    """The distinct words of a block of texts, with their hashed n-grams."""

    def __init__(self, texts: list[str]):
        self.of_text = [words(t) for t in texts]
        self.number = {w: i for i, w in enumerate(set().union(*self.of_text))}
        lengths = np.fromiter((len(w) + 2 for w in self.number), np.int64, len(self.number))
        points = np.frombuffer("".join([f"<{w}>" for w in self.number]).encode("utf-32-le"), np.uint32)
        points = np.concatenate((points, np.zeros(max(ORDERS), np.uint32))).astype(np.uint64)
        n = int(lengths.sum())
        word = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        # Characters from here to the word's end.
        left = (np.repeat(np.cumsum(lengths), lengths) - np.arange(n)).astype(np.int32)
        rolling = np.zeros(n, np.uint64)
        self.owner, self.feature = [], []
        for order in range(1, max(ORDERS) + 1):
            rolling = rolling * np.uint64(0x100000001B3) + points[order - 1 : order - 1 + n]
            if order in ORDERS:
                mixed = (rolling ^ (rolling >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
                fits = left >= order
                self.owner.append(word[fits])
                self.feature.append((mixed[fits] >> np.uint64(40)).astype(np.int32) % np.int32(SIZE))
        self.owner, self.feature = np.concatenate(self.owner), np.concatenate(self.feature)

    def sums(self, weights: np.ndarray) -> dict[str, float]:
        """For each word the sum of its n-grams' weights."""
        totals = np.bincount(self.owner, weights=weights[self.feature], minlength=len(self.number))
        return dict(zip(self.number, totals.tolist()))

    def features(self) -> Iterator[np.ndarray]:
        """For each text the n-grams of its words, as often as they stand there."""
        order = np.argsort(self.owner, kind="stable")
        feature, sizes = self.feature[order], np.bincount(self.owner, minlength=len(self.number))
        starts = np.cumsum(sizes) - sizes
        for found in self.of_text:
            own = np.fromiter((self.number[w] for w in found), np.int64, len(found))
            n = sizes[own]
            yield feature[np.repeat(starts[own] - np.cumsum(n) + n, n) + np.arange(n.sum())]


@dataclass
class Model:
    weights: np.ndarray  # of each hashed feature, its ratio included
    bias: float


def held_out(id_column: Column) -> Column:
    return F.coalesce(F.crc32(id_column.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def _training(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, row, label) of the rows to learn from; row is a number.

    A bitmap of the labelled ids, of BITMAP_BITS at most, goes to the scan of
    the texts, so that hardly any other text is shuffled to the labels.
    """
    known = cut(
        labels.select(column(id_col).alias("id"), column(label_col).cast("int").alias("label"))
        .where(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.max("label").alias("label"))
    )
    place = F.pmod(F.xxhash64("id"), F.lit(BITMAP_BITS)).alias("place")
    part, bit = F.floor(F.col("place") / 32768).alias("part"), F.col("place") % 32768
    bitmap = known.select(place).groupBy(part).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    rows = (
        id_and_text(docs, id_col, text_col, F.monotonically_increasing_id())
        .where(~held_out(F.col("id")))
        .select("id", "text", "row", place)
        .withColumn("part", part)
        .join(F.broadcast(bitmap), "part")
        .where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1)
        .select("id", "text", "row")
    )
    return rows.join(known.hint("merge"), "id")


def _counts(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Over all rows: for each feature, the toxic and other texts that hold it; and the texts of each kind.

    Each task adds up its own rows; Spark adds up the tasks. SIZE rows at most
    reach the driver.
    """

    def count(batches):
        held = np.zeros((2, SIZE + 1), dtype=np.int64)  # the last place counts the texts
        seen = np.zeros(SIZE, dtype=bool)
        for batch in batches:
            texts, labels = batch.column("text"), batch.column("label").to_pylist()
            for i, j in blocks(pc.binary_length(texts).to_pylist(), WORD_BYTES):
                for found, label in zip(Words(texts.slice(i, j - i).to_pylist()).features(), labels[i:j]):
                    seen[found] = True
                    at = np.flatnonzero(seen)
                    held[label, at] += 1
                    held[label, SIZE] += 1
                    seen[at] = False
        found = np.flatnonzero(held.any(axis=0))
        for i in range(0, len(found), COUNTS_AT_ONCE):
            at = found[i : i + COUNTS_AT_ONCE]
            yield pa.RecordBatch.from_arrays(
                [pa.array(at), pa.array(held[1, at]), pa.array(held[0, at])], names=["feature", "toxic", "other"]
            )

    small_batches(rows.sparkSession)
    sums = (
        rows.select("text", "label")
        .mapInArrow(count, "feature long, toxic long, other long")
        .groupBy("feature")
        .agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
        .toArrow()
    )
    out = np.zeros((2, SIZE + 1), dtype=np.int64)
    at = sums.column("feature").to_numpy()
    out[1, at], out[0, at] = sums.column("toxic").to_numpy(), sums.column("other").to_numpy()
    return out[1, :SIZE], out[0, :SIZE], int(out[1, SIZE]), int(out[0, SIZE])


def log_ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int) -> np.ndarray:
    """Naive Bayes log-count ratios; the smoothing splits as the labels do, so that an unseen feature gets zero."""
    share = n_toxic / (n_toxic + n_other)
    ratio = np.log((toxic + SMOOTHING * share) / share) - np.log((other + SMOOTHING * (1 - share)) / (1 - share))
    return np.where(np.abs(ratio) < DULL, 0.0, ratio)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
) -> Model:
    """The classifier that the labelled, not held out rows give."""
    rows = _training(docs, labels, id_col, text_col, label_col)
    toxic, other, n_toxic, n_other = _counts(rows)
    if not n_toxic or not n_other:
        return Model(np.zeros(SIZE), 30.0 if n_toxic else -30.0)
    ratios = log_ratios(toxic, other, n_toxic, n_other)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    places = 1 << 20
    wanted = min(places, max(1, round(places * fit_rows / (n_toxic + n_other))))

    def describe():
        ratio = shared.value

        def work(texts):
            index, value = [], []
            for found in Words(texts).features():
                at, n = np.unique(found[ratio[found] != 0], return_counts=True)
                index.append(at.astype(np.int32))
                value.append((n * ratio[at]).astype(np.float32))
            return {"index": index, "value": value}

        return work

    fields = [
        T.StructField("index", T.ArrayType(T.IntegerType())),
        T.StructField("value", T.ArrayType(T.FloatType())),
    ]
    chosen = F.pmod(F.xxhash64("id", "row"), F.lit(places))
    sample = map_texts(rows.withColumn("place", chosen).where(F.col("place") < wanted), fields, describe)
    with temporary(docs.sparkSession):
        sample = stored(sample, "toxicity")
        entries = sample.agg(F.sum(F.size("index"))).first()[0] or 0
        if entries > FIT_ENTRIES:
            sample = sample.where(F.col("place") < max(1, wanted * FIT_ENTRIES // entries))
        sample = sample.toArrow().sort_by([("id", "ascending"), ("row", "ascending")])
    index = sample.column("index").combine_chunks()
    starts = np.concatenate(([0], np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False))))
    values = sample.column("value").combine_chunks().flatten().to_numpy().astype(np.float64)
    weights, bias = fit_logistic(
        index.flatten().to_numpy(), values, starts, sample.column("label").to_numpy().astype(float), SIZE, RIDGE, ROUNDS
    )
    return Model(weights * ratios, bias)


def score(texts: list[str], model: Model) -> list[float]:
    found = Words(texts)
    known = found.sums(model.weights)
    return [probability(model.bias + sum(map(known.__getitem__, own))) for own in found.of_text]


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model = shared.value
        return lambda texts: {"score": score(texts, model)}

    found = map_texts(id_and_text(docs, id_col, text_col), [T.StructField("score", T.DoubleType())], make)
    return found.select(
        "id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
