"""Benchmark decontamination with a generalised suffix automaton of the items' words.

The items' words become integers and all items enter one suffix automaton. A
document's words run through it once; at each word the automaton knows the
longest run of words ending there that some item holds. Where that run reaches
`window` words, its last words are a window of an item, and are hit. An item of
fewer words is a window as a whole. Walking suffix links to the state of
exactly that length tells which items hold the window.

Only stretches of words that all occur in items, and are long enough, run
through the automaton; a word that no item holds ends every match anyway.

The automaton is broadcast, so its size is bounded: the items are dealt into
parts of at most ITEM_WORDS words (one larger item makes a part of its own),
each part makes an automaton, and the documents pass once for each part, adding
to what was hit.

Words are runs of digits, letters and characters beyond ASCII, with A-Z in
lower case. Defined cases: a null or empty text has no words; an item without
words never occurs; words of items with a null id are hit, but such items are
not listed; repeated items count once by id. A document id may repeat or be
null. Empty tables give empty results, and no items leave every document clean.
Other columns are not read by `contamination`, and pass through `decontaminated`.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import column, id_and_text, map_texts, stored, unused

WINDOW = 10
ITEM_WORDS = 200_000
#: Share of a document's words that may be hit before the whole document goes.
COVERAGE = 0.5
_IN_WORD = [0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 for b in range(256)]
#: For each byte: itself in a word, A-Z in lower case, or a space.
_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if _IN_WORD[b] else 0x20 for b in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_FIELDS = {
    "n_words": T.LongType(),
    "longest": T.LongType(),
    "spans": _SPANS,
    "items": T.ArrayType(T.StringType()),
}


def words(text: str) -> list[bytes]:
    return text.encode().translate(_BYTES).split()


class Automaton:
    """A suffix automaton of items' words that knows which items hold a window."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        coded = [(i, [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in ws]) for i, ws in items if ws]
        for _, ws in coded:
            last = 0
            for w in ws:
                last = self._extend(last, w)
        self.sizes = sorted({min(len(ws), window) for _, ws in coded})
        self.holders: dict[tuple[int, int], set[str | None]] = {}
        for item, ws in coded:
            size, state = min(len(ws), window), 0
            for i, w in enumerate(ws):
                state = self.next[state][w]
                if i + 1 >= size:
                    self.holders.setdefault((self._suffix(state, size), size), set()).add(item)

    def _extend(self, last: int, word: int) -> int:
        """The state of the sequence of `last` followed by word."""
        if word in self.next[last]:
            known = self.next[last][word]
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        state = self._add({}, self.length[last] + 1, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = state
            last = self.link[last]
        if last >= 0:
            known = self.next[last][word]
            fits = self.length[known] == self.length[last] + 1
            self.link[state] = known if fits else self._split(last, known, word)
        return state

    def _add(self, follow: dict[int, int], length: int, link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, last: int, known: int, word: int) -> int:
        """A state of its own for the shorter sequences of `known`."""
        state = self._add(dict(self.next[known]), self.length[last] + 1, self.link[known])
        self.link[known] = state
        while last >= 0 and self.next[last].get(word) == known:
            self.next[last][word] = state
            last = self.link[last]
        return state

    def _suffix(self, state: int, size: int) -> int:
        """The state that holds the last `size` words of what has led to state."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def scan(self, text_words: list[bytes]) -> tuple[int, list[tuple[int, int]], set[str | None]]:
        """The longest match, the spans of hit words, and the items with a window in the words."""
        n, spans, found, longest = len(text_words), [], set(), 0
        if not self.sizes or n < self.sizes[0]:
            return 0, spans, found
        get = self.vocabulary.get
        coded = np.fromiter((get(w, -1) for w in text_words), dtype=np.int64, count=n)
        edges = np.flatnonzero(np.diff(np.concatenate(([0], (coded >= 0).view(np.int8), [0]))))
        hit = None
        for start, stop in edges.reshape(-1, 2).tolist():
            if stop - start < self.sizes[0]:
                continue
            state = length = 0
            for i, w in enumerate(coded[start:stop].tolist(), start):
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.length[state]
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
                if length > longest:
                    longest = length
                for size in self.sizes:
                    if size > length:
                        break
                    holders = self.holders.get((self._suffix(state, size), size))
                    if holders:
                        found |= holders
                        hit = np.zeros(n, dtype=np.int8) if hit is None else hit
                        hit[i - size + 1 : i + 1] = 1
        if hit is not None:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit, [0]))))
            spans = [tuple(x) for x in edges.reshape(-1, 2).tolist()]
        return longest, spans, found


def _parts(items: DataFrame, id_col: str, text_col: str, part_words: int) -> Iterator[list[tuple]]:
    """The items with words, in parts of bounded size; one part at a time is on the driver."""

    def work(texts):
        found = [words(t) for t in texts]
        return {"n": [len(f) for f in found], "words": [b" ".join(f) for f in found]}

    rows = id_and_text(items, id_col, text_col).select(F.col("id").cast("string"), "text").distinct()
    fields = [T.StructField("n", T.LongType()), T.StructField("words", T.BinaryType())]
    rows = map_texts(rows, fields, lambda: work).where("n > 0")
    if (rows.agg(F.sum("n")).first()[0] or 0) <= part_words:
        yield [(r.id, bytes(r.words).split()) for r in rows.select("id", "words").collect()]
        return
    # Hash buckets of a tenth of a part on average, then runs of buckets that fit together.
    buckets = -(-10 * rows.agg(F.sum("n")).first()[0] // part_words)
    rows = stored(rows.withColumn("bucket", F.pmod(F.xxhash64("words", "id"), F.lit(buckets))), "items")
    sizes = sorted(tuple(r) for r in rows.groupBy("bucket").agg(F.sum("n")).collect())
    runs, size = [[]], 0
    for bucket, n in sizes:
        if runs[-1] and size + n > part_words:
            runs.append([])
            size = 0
        runs[-1].append(bucket)
        size += n
    for run in runs:
        some = rows.where(F.col("bucket").between(run[0], run[-1]))
        yield [(r.id, bytes(r.words).split()) for r in some.select("id", "words").collect()]


def _marked(
    docs: DataFrame, items: DataFrame, text_col: str, item_cols: tuple[str, str], window: int, part_words: int, keep_text: bool
) -> tuple[DataFrame, dict[str, str]]:
    """docs with the columns of _FIELDS, and the names that these have among the columns of docs."""
    spark, parts = docs.sparkSession, _parts(items, *item_cols, part_words)
    names = {n: unused(docs.columns, n) for n in _FIELDS}
    earlier = {n: unused([*docs.columns, *names.values()], f"{n}_before") for n in _FIELDS}
    fields = [T.StructField(names[n], kind) for n, kind in _FIELDS.items()]
    last = next(parts)
    seen = 0
    while last is not None:
        part, last = last, next(parts, None)
        shared = spark.sparkContext.broadcast(Automaton(part, window))

        def make(shared=shared):
            automaton = shared.value

            def work(texts):
                out = {name: [] for name in names.values()}
                for text in texts:
                    found = words(text)
                    longest, spans, held = automaton.scan(found)
                    for name, value in zip(out, (len(found), longest, spans, sorted(held - {None}))):
                        out[name].append(value)
                return out

            return work

        if seen:
            docs = docs.withColumnsRenamed({names[n]: earlier[n] for n in names})
        docs = map_texts(docs, fields, make, text_col, keep_text=keep_text or last is not None)
        if seen:
            both = {n: (column(names[n]), column(earlier[n])) for n in names}
            docs = docs.withColumns(
                {
                    names["longest"]: F.greatest(*both["longest"]),
                    names["spans"]: F.concat(*both["spans"]),
                    names["items"]: F.array_union(*both["items"]),
                }
            ).drop(*earlier.values())
        if last is not None:
            docs = stored(docs, "decontamination")
        seen += 1
    return docs, names


def _covered(spans: Column) -> Column:
    """The number of words in the union of spans."""
    none = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("stop"))

    def add(done: Column, span: Column) -> Column:
        more = F.greatest(F.lit(0).cast("long"), span.stop - F.greatest(span.start, done.stop))
        return F.struct((done.n + more).alias("n"), F.greatest(done.stop, span.stop).alias("stop"))

    return F.aggregate(F.array_sort(spans), none, add).n


def contamination(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_cols: tuple[str, str] = ("item_id", "text"),
    window: int = WINDOW,
    part_words: int = ITEM_WORDS,
) -> DataFrame:
    """One row per row of docs: id, n_words, n_hit, longest (match), spans (of hit words), items (ids, sorted as strings)."""
    rows, _ = _marked(id_and_text(docs, id_col, text_col), items, "text", item_cols, window, part_words, False)
    return rows.select(
        "id",
        "n_words",
        _covered(F.col("spans")).alias("n_hit"),
        "longest",
        F.array_sort("spans").alias("spans"),
        F.array_sort("items").alias("items"),
    )


def without_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without its words number start to stop of each span, and what stands between those words."""
    found = [m.span() for m in _WORD.finditer(text)]
    kept, at = [], 0
    for start, stop in sorted(spans):
        kept.append(text[at : max(at, found[start][0])])
        at = max(at, found[stop - 1][1])
    return "".join([*kept, text[at:]])


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_cols: tuple[str, str] = ("item_id", "text"),
    window: int = WINDOW,
    coverage: float = COVERAGE,
    part_words: int = ITEM_WORDS,
) -> DataFrame:
    """docs, all columns, without hit spans.

    A document of whose words a larger share than `coverage` is hit goes as a
    whole; with 0 every document with a hit does. Clean texts stay as they are.
    """
    rows, names = _marked(docs, items, text_col, item_cols, window, part_words, True)
    spans = column(names["spans"])
    rows = rows.where(_covered(spans) <= column(names["n_words"]) * F.lit(coverage))

    @F.udf(T.StringType(), useArrow=True)
    def cut_out(text, spans):
        return without_words(text, [(s[0], s[1]) for s in spans]) if spans else text

    text = column(text_col)
    if coverage > 0:
        text = cut_out(text, spans)
    return rows.withColumn(text_col, text).select(*map(column, docs.columns))
