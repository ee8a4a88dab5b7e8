"""Product codes of vectors; each part finds its codebook's nearest entry by Orchard search.

Components become integers, floor(SCALE * x), and vectors are cut into parts. The
codebook of each part starts with that part of the vectors of the smallest ids.
A round assigns every part to the nearest entry and replaces each entry by the
componentwise floor of the mean of its parts; entries without parts stay.

Orchard search keeps for every entry the list of all entries, nearest first.
From some entry c at distance d from the part, it goes down c's list; an entry
that is nearer to the part is jumped to, and the search goes on in that entry's
list. Beyond twice d in c's list no entry can be nearer, by the triangle
inequality, so the search ends there. Entries that were compared are marked and
not compared again. Here the parts of a block that are at one entry go down its
list together, ENTRIES_AT_ONCE at a step, starting from the nearest of a few
entries that are spread over the codebook. Distances are exact integers; of
equal ones the lower index counts, so lists are left only strictly beyond twice d.

A task adds up its parts by entry, so that a round moves at most one row for each
task, entry and place, and gathers one codebook on the driver: parts x entries x
width numbers, however many vectors there are. Every vector is coded.

Defined cases: vectors that are null or hold null, NaN or infinite components are
dropped. Vectors of another length than most have no code: a null code and error;
so have those with components too large for exact distances in 64 bits (from
about 11,500 on, with 64 components and 256 entries). A length that the parts
don't divide is cut as evenly as can be. Null ids come after all others, and
equal ids are ordered by their vectors. Repeated rows each count. Null labels
form one group. Fewer vectors than entries make smaller codebooks. An empty table
gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import column, cut, stored

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Entries of a list that are compared at a step, and entries to start from.
ENTRIES_AT_ONCE, HEADS = 64, 32
#: Vectors that are searched together.
ROWS_AT_ONCE = 1 << 15
_INT32 = 2**31 - 1


class Codebook:
    """Entries, with every entry's list of all entries by distance."""

    def __init__(self, entries: np.ndarray, largest: int):
        """largest: bounds the absolute components of entries and parts."""
        self.k, width = entries.shape
        # Distance and index in one number: k * distance + index. Doubles are exact up to 2^53, and multiply faster.
        self.kind = np.float64 if 4 * largest * largest * max(1, width) * self.k < 2**53 else np.int64
        self.entries = entries.astype(self.kind)
        self.squares = (self.entries * self.entries).sum(1)
        apart = self.squares[:, None] + self.squares[None, :] - 2 * (self.entries @ self.entries.T)
        self.order = np.argsort(apart, axis=1, kind="stable")
        self.reach = np.take_along_axis(apart, self.order, axis=1)
        self.heads = np.unique(np.linspace(0, self.k - 1, min(HEADS, self.k)).astype(np.int64))

    def _ranked(self, parts: np.ndarray, squares: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """k * distance + index, from each part to each chosen entry."""
        found = parts @ self.entries[chosen].T
        found *= -2
        found += squares[:, None]
        found += self.squares[chosen]
        found *= self.k
        found += chosen
        return found

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each part its nearest entry's index and squared distance; and how many comparisons that took."""
        parts = parts.astype(self.kind)
        squares = (parts * parts).sum(1)
        best = self._ranked(parts, squares, self.heads).min(axis=1)
        marked = np.zeros((len(parts), self.k), dtype=bool)
        marked[:, self.heads] = True
        compared, moving = marked.sum(), np.arange(len(parts))
        while moving.size:
            at = (best[moving] % self.k).astype(np.int64)
            by = np.argsort(at, kind="stable")
            edges = np.flatnonzero(np.diff(at[by])) + 1
            jumped = []
            for left in np.split(moving[by], edges):
                entry = int(best[left[0]] % self.k)
                order, reach = self.order[entry], self.reach[entry]
                for start in range(0, self.k, ENTRIES_AT_ONCE):
                    # Squared, twice the distance is four times it.
                    left = left[reach[start] <= 4 * (best[left] // self.k)]
                    if not left.size:
                        break
                    chosen = order[start : start + ENTRIES_AT_ONCE]
                    fresh = ~marked[left[:, None], chosen]
                    some = fresh.any(axis=1)
                    if not some.any():
                        continue
                    rows = left[some]
                    compared += int(fresh.sum())
                    ranked = self._ranked(parts[rows], squares[rows], chosen)
                    marked[rows[:, None], chosen] = True
                    found = np.where(fresh[some], ranked, np.inf if self.kind is np.float64 else np.iinfo(np.int64).max).min(axis=1)
                    better = found < best[rows]
                    if better.any():
                        best[rows[better]] = found[better]
                        jumped.append(rows[better])
                        some[some] = better
                        left = left[~some]
            moving = np.concatenate(jumped) if jumped else moving[:0]
        whole = best.astype(np.int64)
        return whole % self.k, whole // self.k, int(compared)


def edges(length: int, parts: int) -> list[int]:
    return [length * i // parts for i in range(parts + 1)]


def _integers(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The rows (id, label, vector) that count, with integer components; a null vector where one is too large for 32 bits."""
    vectors = batch.column(2)
    flat, lengths = vectors.flatten(), pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    lengths = np.nan_to_num(lengths).astype(np.int64)  # a null has no components
    value = pc.fill_null(flat.cast(pa.float64(), safe=False), float("nan")).to_numpy(zero_copy_only=False)
    value = np.floor(value * SCALE)
    row = np.repeat(np.arange(len(lengths)), lengths)
    kept = vectors.is_valid().to_numpy(zero_copy_only=False)
    kept[row[~np.isfinite(value)]] = False
    large = np.zeros(len(lengths), dtype=bool)
    large[row[np.abs(np.nan_to_num(value)) > _INT32]] = True
    stays = kept & ~large
    body = value[stays[row]].astype(np.int32)
    ends = np.concatenate(([0], np.cumsum(np.where(stays, lengths, 0)))).astype(np.int32)
    made = pa.ListArray.from_arrays(pa.array(ends), pa.array(body), mask=pa.array(~stays))
    out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), made], ["id", "label", "v"])
    return out.filter(pa.array(kept))


def _matrices(batches: Iterator[pa.RecordBatch], length: int, largest: int) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """Rows in blocks; which of them can be coded; and those rows' components."""
    held, n = [], 0

    def block() -> tuple[pa.Table, np.ndarray, np.ndarray]:
        rows = pa.Table.from_batches(held).combine_chunks()
        vectors = rows.column("v").combine_chunks()
        vectors = vectors.chunk(0) if isinstance(vectors, pa.ChunkedArray) else vectors
        lengths = np.nan_to_num(pc.list_value_length(vectors).to_numpy(zero_copy_only=False), nan=-1).astype(np.int64)
        fits = lengths == length
        some = vectors.filter(pa.array(fits)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(int(fits.sum()), length)
        small = (np.abs(some) <= largest).all(axis=1)
        fits[fits] = small
        return rows, fits, some[small]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= ROWS_AT_ONCE:
                yield block()
                held, n = [], 0
    if held:
        yield block()


def refined(rows: DataFrame, books: list[np.ndarray], length: int, largest: int) -> list[np.ndarray]:
    """The codebooks after one round."""
    cuts = edges(length, len(books))
    shared = rows.sparkSession.sparkContext.broadcast(books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b, largest) for b in shared.value]
        totals = [np.zeros((b.k, b.entries.shape[1] + 1), np.int64) for b in found]
        for _, _, vectors in _matrices(batches, length, largest):
            for book, total, a, b in zip(found, totals, cuts, cuts[1:]):
                entry = book.nearest(vectors[:, a:b])[0]
                by = np.argsort(entry, kind="stable")
                own, starts = np.unique(entry[by], return_index=True)
                counted = np.concatenate((vectors[:, a:b], np.ones((len(vectors), 1), np.int64)), axis=1)[by]
                if len(own):
                    total[own] += np.add.reduceat(counted, starts, axis=0)
        for part, total in enumerate(totals):
            used = np.flatnonzero(total[:, -1])
            places = total.shape[1]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used) * places, part, np.int32)),
                    pa.array(np.repeat(used, places).astype(np.int32)),
                    pa.array(np.tile(np.arange(places, dtype=np.int32), len(used))),
                    pa.array(total[used].ravel()),
                ],
                ["part", "entry", "place", "total"],
            )

    added = rows.mapInArrow(sums, "part int, entry int, place int, total long")
    after = [b.copy() for b in books]
    totals = [np.zeros((len(b), b.shape[1] + 1), np.int64) for b in books]
    for part, entry, place, total in added.groupBy("part", "entry", "place").agg(F.sum("total")).collect():
        totals[part][entry, place] = total
    for book, total in zip(after, totals):
        used = total[:, -1] > 0
        book[used] = total[used, :-1] // total[used, -1:]
    return after


def coded(rows: DataFrame, books: list[np.ndarray], length: int, largest: int) -> DataFrame:
    """(id, label, code, error) of all rows."""
    cuts = edges(length, len(books))
    shared = rows.sparkSession.sparkContext.broadcast(books)
    schema = T.StructType(
        [rows.schema["id"], rows.schema["label"], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [Codebook(b, largest) for b in shared.value]
        for rows, fits, vectors in _matrices(batches, length, largest):
            entries, error = np.zeros((len(vectors), len(found)), np.int64), np.zeros(len(vectors), np.int64)
            for i, (book, a, b) in enumerate(zip(found, cuts, cuts[1:])):
                entries[:, i], apart, _ = book.nearest(vectors[:, a:b])
                error += apart
            codes, errors = np.full(len(fits), None, dtype=object), np.zeros(len(fits), np.int64)
            codes[fits] = ["".join(f"{e:02x}" for e in line) for line in entries.tolist()]
            errors[fits] = error
            out = pa.table([rows.column("id"), rows.column("label"), pa.array(codes, pa.string()), pa.array(errors, mask=~fits)], ["id", "label", "code", "error"])
            yield from out.to_batches()

    return rows.mapInArrow(code, schema)


def codebook_text(books: list[np.ndarray]) -> str:
    """All entries' components, by part, entry and place."""
    return ",".join(str(x) for book in books for x in book.ravel().tolist())


def codes(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> DataFrame:
    """One row per vector that counts: id, label, code, error, label_error (summed over its label), codebooks_sha256."""
    given = vectors.select(
        column(id_col).alias("id"), column(label_col).alias("label"), column(vector_col).cast("array<double>").alias("v")
    )
    schema = T.StructType([given.schema["id"], given.schema["label"], T.StructField("v", T.ArrayType(T.IntegerType()))])
    # Written once, as all rounds read it.
    rows = stored(given.mapInArrow(lambda batches: map(_integers, batches), schema), "vectors")
    low, high = F.array_min("v"), F.array_max("v")
    lengths = (
        rows.where("v IS NOT NULL")
        .groupBy(F.size("v").alias("length"))
        .agg(F.count("*").alias("n"), F.max(F.greatest(-low.cast("long"), high)).alias("largest"))
    )
    usual = lengths.orderBy(F.desc("n"), F.desc("length")).first()
    length, there = (usual["length"], usual["largest"] or 0) if usual else (0, 0)
    largest = min(there, int((2**61 / (max(1, length) * max(1, entries))) ** 0.5))
    first = (
        rows.where((F.size("v") == length) & F.coalesce((low >= -largest) & (high <= largest), F.lit(True)))
        .orderBy(F.col("id").isNull(), "id", "v")
        .limit(entries)
        .toArrow()
    )
    start = np.array(first.column("v").to_pylist(), dtype=np.int64).reshape(first.num_rows, length)
    cuts = edges(length, parts)
    books = [start[:, a:b] for a, b in zip(cuts, cuts[1:])]
    if len(start):
        for _ in range(rounds):
            books = refined(rows, books, length, largest)
        found = cut(coded(rows, books, length, largest))
    else:
        found = rows.select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    sums = found.groupBy(F.col("label").alias("of")).agg(F.try_sum("error").alias("label_error"))
    digest = hashlib.sha256(codebook_text(books).encode()).hexdigest()
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select(
        "id", "label", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256")
    )
