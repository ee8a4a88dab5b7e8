"""Quality classifier from weak labels.

Overlapping heuristic labellers each vote on a text: clean, junk, or nothing.
How good they are is not known beforehand. Expectation-maximisation estimates,
over the votes of all documents, the share of clean documents and how often
each labeller is right on clean and on junk documents; these give each pattern
of votes a posterior probability of being clean. A vote of nothing says nothing.

The posteriors then label the texts for a linear scorer on hashed features: the
shapes of a text's words with the share of words that have them, and how much
it repeats itself. The scorer decides, also where labellers abstain or disagree.

Patterns of votes are counted over all documents; as there are at most 3 to the
number of labellers, the counts that reach the driver are bounded. The scorer
is fitted on at most about FIT_ROWS documents, taken one by one by a hash of their
row numbers, so that a hot id or text comes as often as others.

Defined cases: a null, empty or blank text has nothing to keep and gets quality
0. Null ids, repeated rows and very long texts and words are scored as they stand,
whole; how many words are distinct is counted within successive windows of a text.
An empty table gives an empty result. Other columns are not read, and pass through
`kept`, whatever their names.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import bitmap, column, cut, id_and_text, kept_in_worker, map_texts, unused
from tarn.llm.linear import fit_logistic, probability

SIZE = 1 << 12
FIT_ROWS, RIDGE = 20_000, 1e-5
THRESHOLD = 0.5
KEPT_WORDS = 200_000
#: Bits of the bitmap of rejected texts (8 MB).
BITMAP_BITS = 1 << 26
#: Words of so many characters are read each time, and not remembered.
LONG_WORD = 64
#: Words of a window within which a text's words are distinct or not.
WINDOW = 1000
#: Weak prior of the labellers' accuracy, as counts of right and wrong votes.
PRIOR_RIGHT, PRIOR_WRONG = 8.0, 2.0
EM_ROUNDS = 60

LABELLERS = (
    "symbols", "capitals", "doubled words", "distinct words", "bare marks", "trailing runs", "plain words", "sentences",
    "word length", "top word",
)
CLEAN, JUNK, NOTHING = "1", "0", "-"


@dataclass
class Traits:
    """What labellers and features look at; shares are of a text's words."""

    n: int
    shapes: dict[str, float]
    symbols: float
    capitals: float
    doubled: float
    distinct: float
    bare: float
    runs: float
    plain: float
    ends: float
    length: float
    top: float


def shape(word: str) -> str:
    """Letters, capitals and digits as a, A and 0, other characters as they are; repeats once, with a +."""
    out, last, more = [], "", False
    for c in word:
        kind = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if kind != last:
            out.append(kind)
            last, more = kind, False
        elif not more:
            out.append("+")
            more = True
    return "".join(out)


def distinct_share(words: list[str]) -> float:
    """The share of words that are new within their window of WINDOW words, so that long texts are judged like short ones."""
    return sum(len({*words[i : i + WINDOW]}) for i in range(0, len(words), WINDOW)) / len(words)


class Reader:
    """Takes the traits of texts; remembers what it knows of words."""

    def __init__(self):
        self.known: dict[str, tuple] = {}
        self.shapes: dict[str, str] = {}  # one string for each shape

    def _word(self, word: str) -> tuple:
        """Shape; symbols, letters and capitals in it; whether it is bare, ends in a run of marks, is plain, ends a sentence; length."""
        letters = sum(map(str.isalpha, word))
        alnum = sum(map(str.isalnum, word))
        symbols = len(word) - alnum - sum(word.count(c) for c in ".,;:!?'\"()-’")
        last = word[-1]
        run = len(word) > 1 and last == word[-2] and not last.isalnum() and last != "."
        plain = (word[:-1] if last in ".,;:!?" else word).isalpha() and (letters == 1 or not word[1:].isupper())
        form = shape(word)
        if len(word) < LONG_WORD:
            form = self.shapes.setdefault(form, form)
        found = (
            form, symbols, letters, sum(map(str.isupper, word)), alnum == 0, run, plain,
            last in ".!?", len(word),
        )
        if len(word) < LONG_WORD:
            self.known[word] = found
        return found

    def traits(self, text: str) -> Traits | None:
        """None for a text without words."""
        words = text.split()
        n = len(words)
        if not n:
            return None
        if len(self.known) > KEPT_WORDS:
            self.known, self.shapes = {}, {}
        counts, known = Counter(words), self.known
        shapes: dict[str, int] = {}
        symbols = letters = capitals = bare = runs = plain = ends = chars = 0
        for word, k in counts.items():
            found = known.get(word) or self._word(word)
            shapes[found[0]] = shapes.get(found[0], 0) + k
            symbols += k * found[1]
            letters += k * found[2]
            capitals += k * found[3]
            bare += k * found[4]
            runs += k * found[5]
            plain += k * found[6]
            ends += k * found[7]
            chars += k * found[8]
        return Traits(
            n=n,
            shapes={s: k / n for s, k in shapes.items()},
            symbols=symbols / chars,
            capitals=capitals / letters if letters else 0.0,
            doubled=sum(map(eq, words, words[1:])) / n,
            distinct=distinct_share(words),
            bare=bare / n,
            runs=runs / n,
            plain=plain / n,
            ends=ends / n,
            length=chars / n,
            top=max(counts.values()) / n,
        )


def _between(value: float, clean: float, junk: float) -> str:
    """Clean up to one bound, junk from the other on, nothing between."""
    return CLEAN if value <= clean else JUNK if value >= junk else NOTHING


def votes(t: Traits) -> str:
    """A letter for each labeller, in their order; on few words most say nothing."""
    some, many = t.n >= 12, t.n >= 40
    return "".join(
        (
            _between(t.symbols, 0.03, 0.08) if some else NOTHING,
            _between(t.capitals, 0.25, 0.6) if some else NOTHING,
            _between(t.doubled, 0.03, 0.2) if t.n >= 8 else NOTHING,
            _between(-t.distinct, -0.4, -0.2) if many else NOTHING,
            _between(t.bare, 0.03, 0.15) if some else NOTHING,
            _between(t.runs, 0.02, 0.2) if some else NOTHING,
            _between(-t.plain, -0.85, -0.6) if some else NOTHING,
            _between(-t.ends, -0.02, -0.0005) if many else NOTHING,
            _between(abs(t.length - 6.5), 4.5, 9.0) if t.n >= 10 else NOTHING,
            _between(t.top, 0.12, 0.3) if many else NOTHING,
        )
    )


def features(t: Traits) -> tuple[list[int], list[float]]:
    """Hashed features and their values, in 0..1."""
    named = {f"shape {s}": v for s, v in t.shapes.items()}
    named["doubled"] = t.doubled
    named["runs"] = t.runs
    named["plain"] = t.plain
    named["bare"] = t.bare
    named["symbols"] = t.symbols
    named["capitals"] = t.capitals
    if t.n >= 40:
        named["top"] = t.top
        named[f"distinct {min(7, int(t.distinct * 8))} of {min(4, len(str(t.n)))}"] = 0.25
    found: dict[int, float] = {}
    for name, value in named.items():
        at = zlib.crc32(name.encode()) % SIZE
        found[at] = found.get(at, 0.0) + value
    return list(found), list(found.values())


@dataclass
class LabelModel:
    clean: float  # share of clean documents
    right: np.ndarray  # for each labeller, how often it is right on junk and on clean documents

    def posterior(self, pattern: str) -> float:
        """The probability that a document with these votes is clean."""
        odds = np.log(self.clean) - np.log(1 - self.clean)
        for vote, (on_junk, on_clean) in zip(pattern, self.right):
            if vote == CLEAN:
                odds += np.log(on_clean) - np.log(1 - on_junk)
            elif vote == JUNK:
                odds += np.log(1 - on_clean) - np.log(on_junk)
        return probability(odds)


def estimate(patterns: dict[str, int]) -> LabelModel:
    """Expectation-maximisation over the counts of patterns of votes."""
    names = sorted(patterns)
    counts = np.array([patterns[p] for p in names], dtype=float)
    said = np.array([[{CLEAN: 1, JUNK: 0, NOTHING: -1}[v] for v in p] for p in names]).reshape(len(names), -1)
    # To begin with, what any labeller calls junk is taken for junk; each looks for another kind of it.
    clean = np.where((said == 0).any(1), 0.1, 0.95)
    share, right = 0.9, np.full((said.shape[1], 2), 0.8)
    for _ in range(EM_ROUNDS):
        share = (counts @ clean + PRIOR_RIGHT) / (counts.sum() + PRIOR_RIGHT + PRIOR_WRONG)
        for j in range(said.shape[1]):
            for value, weight in ((0, counts * (1 - clean)), (1, counts * clean)):
                spoke = weight @ (said[:, j] >= 0)
                agreed = weight @ (said[:, j] == value)
                right[j, value] = (agreed + PRIOR_RIGHT) / (spoke + PRIOR_RIGHT + PRIOR_WRONG)
        model = LabelModel(share, right)
        clean = np.array([model.posterior(p) for p in names])
    return LabelModel(share, right.copy())


@dataclass
class Model:
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, index: list[int], value: list[float]) -> float:
        return probability(self.bias + float(self.weights[index] @ np.array(value, dtype=float)))


_PLACES = 1 << 20
_FIELDS = [
    T.StructField("votes", T.StringType()),
    T.StructField("index", T.ArrayType(T.IntegerType())),
    T.StructField("value", T.ArrayType(T.FloatType())),
]


def _describe(texts: list[str]) -> dict[str, list]:
    """Votes, null for a text without words, and features."""
    reader = kept_in_worker("quality", Reader)
    found = [reader.traits(t) for t in texts]
    hashed = [features(t) if t else ([], []) for t in found]
    return {
        "votes": [votes(t) if t else None for t in found],
        "index": [h[0] for h in hashed],
        "value": [h[1] for h in hashed],
    }


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, votes, features, and a place in the order of the sample; kept without lineage."""
    rows = id_and_text(docs, id_col, text_col).withColumn("place", _place())
    return cut(map_texts(rows, _FIELDS, lambda: _describe))


def _place() -> Column:
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(_PLACES))


def fit(rows: DataFrame, fit_rows: int = FIT_ROWS) -> Model:
    """The label model of all described rows, and the scorer that its posteriors give."""
    rows = rows.where("votes IS NOT NULL")
    patterns = {r["votes"]: r["n"] for r in rows.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    if not patterns:
        return Model(LabelModel(0.9, np.full((len(LABELLERS), 2), 0.8)), np.zeros(SIZE), 0.0)
    labels = estimate(patterns)
    wanted = min(_PLACES, max(1, round(_PLACES * fit_rows / sum(patterns.values()))))
    chosen = rows.where(F.col("place") < wanted).select("votes", "index", "value", "place")
    sample = chosen.orderBy("place", "votes").toArrow()
    index = sample.column("index").combine_chunks()
    posterior = {p: labels.posterior(p) for p in patterns}
    weights, bias = fit_logistic(
        index.flatten().to_numpy(),
        sample.column("value").combine_chunks().flatten().to_numpy().astype(np.float64),
        np.concatenate(([0], np.cumsum(index.value_lengths().to_numpy(zero_copy_only=False)))),
        np.array([posterior[p] for p in sample.column("votes").to_pylist()]),
        SIZE,
        RIDGE,
        rounds=600,
    )
    return Model(labels, weights, bias)


def scores(rows: DataFrame, model: Model) -> DataFrame:
    """One row per described row: id, score (0 to 1, higher: cleaner), posterior (of the votes), kept."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType(
        [rows.schema["id"], T.StructField("score", T.DoubleType()), T.StructField("posterior", T.DoubleType())]
    )

    def score(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        model, arrow, posterior = shared.value, to_arrow_schema(schema), {None: 0.0}
        for batch in batches:
            voted = batch.column("votes").to_pylist()
            for v in {*voted} - {*posterior}:
                posterior[v] = model.labels.posterior(v)
            found = zip(voted, batch.column("index").to_pylist(), batch.column("value").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id").cast(arrow.field("id").type),
                    pa.array([model.score(i, v) if p else 0.0 for p, i, v in found], pa.float64()),
                    pa.array([posterior[v] for v in voted], pa.float64()),
                ],
                schema=arrow,
            )

    found = rows.select("id", "votes", "index", "value").mapInArrow(score, schema)
    return found.withColumn("kept", F.col("score") >= THRESHOLD)


def kept(docs: DataFrame, text_col: str = "text", fit_rows: int = FIT_ROWS) -> DataFrame:
    """The rows of docs, all columns, that a scorer fitted on docs doesn't reject.

    What the scorer rejects is known once it is fitted, by hashes of the texts. A
    bitmap of them, of fixed size, goes with the second pass over the texts, which
    describes and scores again only what hits it.
    """
    texts = docs.select(column(text_col).cast("string").alias("text")).withColumn("place", _place())

    def describe(texts: list[str]) -> dict[str, list]:
        return _describe(texts) | {"id": [text_hash(t) for t in texts]}

    rows = cut(map_texts(texts, [T.StructField("id", T.LongType()), *_FIELDS], lambda: describe))
    model = fit(rows, fit_rows)
    rejected = scores(rows, model).where(~F.col("kept"))
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model, bitmap(rejected, F.col("id"), BITMAP_BITS)))
    name = unused(docs.columns, "score")

    def make():
        model, hits = shared.value

        def work(texts: list[str]) -> dict[str, list]:
            at = [text_hash(t) % BITMAP_BITS for t in texts]
            again = [i for i, k in enumerate(at) if hits[k >> 3] >> (k & 7) & 1]
            out, found = [1.0] * len(texts), _describe([texts[i] for i in again])
            for i, voted, index, value in zip(again, found["votes"], found["index"], found["value"]):
                out[i] = model.score(index, np.float32(value)) if voted else 0.0
            return {name: out}

        return work

    found = map_texts(docs, [T.StructField(name, T.DoubleType())], make, text_col, keep_text=True)
    return found.where(column(name) >= THRESHOLD).select(*map(column, docs.columns))


def text_hash(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text.encode()) >> 1
