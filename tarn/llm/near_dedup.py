"""Near-duplicates by the Jaccard similarity of word shingles; SimHash fingerprints and pivot tables discard pairs.

Two texts are linked if the sets of their five-word shingles have a Jaccard
similarity of 0.8 or more, and linked texts form one component. Their
fingerprints then differ in about a sixth of the bits, and no block of bits needs
to agree; so other keys say which pairs to look at:

1. Texts with one set of shingles become one unit. A unit has BANDS keys, each of
   MIN_HASHES min-hashes of its set. Two units at a similarity of 0.8 share none
   with a probability of 3e-6, less above. Units that share no key with any other
   are done; only the texts of the rest are looked at again.
2. The shingles of those units are ordered by how many of the units hold them.
   Of a set of n, the n - ceil(0.8 n) + 1 rarest are its prefix; sets with a
   similarity of 0.8 have a common shingle in their prefixes. That is exact, and
   texts that share only a template have none, as their own words are rarer.
   Units that are connected by common shingles of prefixes form a loose group, a
   superset of the components.
3. Loose groups are verified, a group in a task. Pairs with a common shingle in
   their prefixes, by the order within the task, that are not connected yet are
   candidates. Their fingerprints have 64 * WORDS bits. A table of the distances
   to pivots, members of the group, discards the pairs that differ by more than
   RADIUS anywhere, as their fingerprints then do too; the distance itself discards
   more. The rest is decided by the sets of 64-bit hashes. At 0.8, RADIUS is
   passed with a probability of about 2e-7 for sets of four and five, and less than
   1e-12 for large ones.
4. The sets and fingerprints of a group with more shingles than PART_SHINGLES are
   stored once. The group is dealt into parts that are verified apart. The
   components found there are joined through one unit of each, that most like
   what its members have in common. What is left is compared across components:
   the largest one is dealt into parts, and the units outside it go to each of
   them and to each other's; pairs of one part are compared once.

Defined cases: a null or blank text has the empty set, and all such texts are
linked; a shorter text is one shingle. Of a component, the row with the smallest
id stays, a null id last; of repeated rows, one. An empty table gives an empty
result. All columns pass through, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import blocks, id_and_text, map_texts, nothing_kept, numbered, staying, stored, temporary
from tarn.llm.simhash import components

SHINGLE = 5
#: A fingerprint's words of 64 bits, and how many of its bits may differ.
WORDS, RADIUS = 16, 256
#: The least Jaccard similarity, as a fraction.
LEAST = (4, 5)
BANDS, MIN_HASHES = 24, 4
#: Shingles of a part of a loose group, and of the groups that are handed to a task at once.
PART_SHINGLES, BIN_SHINGLES = 200_000, 200_000
PIVOTS = 32
#: Hashes of a set whose bits are counted at once: as many as a byte counts.
HASHES_AT_ONCE = 255
#: Shingles of a group, those held most, that are bits of its members; a multiple of 64.
COMMON = 512
BITMAP_BITS = 1 << 26
_DRAW = np.random.default_rng(42).integers(0, 2**64, (3, BANDS * MIN_HASHES), dtype=np.uint64)
_TURNS = np.random.default_rng(43).integers(0, 2**64, WORDS, dtype=np.uint64) | np.uint64(1)
_PLACES = np.random.default_rng(44).integers(0, 2**64, SHINGLE + 1, dtype=np.uint64) | np.uint64(1)
_FACTORS, _TERMS, _MIX = _DRAW[0] | np.uint64(1), _DRAW[1], _DRAW[2] | np.uint64(1)


def shingle_set(text: str) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles, made of the hashes of their words; a shorter text is one."""
    import xxhash

    words = text.encode().lower().split()  # both act on ASCII alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(1, len(words) - SHINGLE + 1)
    found = np.zeros(n, dtype=np.uint64)
    for place in range(min(SHINGLE, len(words))):
        found += hashes[place : place + n] * _PLACES[place]
    found ^= found >> np.uint64(32)
    found *= _PLACES[SHINGLE]
    found ^= found >> np.uint64(29)
    found.sort()
    new = np.ones(n, dtype=bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have the least Jaccard similarity; empty ones do."""
    up, down = LEAST
    if down * min(len(a), len(b)) < up * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return down * both >= up * (len(a) + len(b) - both)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band of min-hashes of a set."""
    least = np.full(len(_FACTORS), 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(hashes), 512):
        part = hashes[at : at + 512, None] * _FACTORS
        part += _TERMS
        np.minimum(least, part.min(axis=0), out=least)
    return (least * _MIX).reshape(BANDS, MIN_HASHES).sum(axis=1, dtype=np.uint64)


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """A row of WORDS words for each non-empty set: the bits that are set in over half of its hashes, hashed anew for each word."""
    out = np.zeros((len(sets), WORDS), dtype=np.uint64)
    others = np.roll(_TURNS, 1)
    for place, hashes in enumerate(sets):
        ones = np.zeros(64 * WORDS, dtype=np.int64)
        for at in range(0, len(hashes), HASHES_AT_ONCE):
            x = hashes[at : at + HASHES_AT_ONCE, None] * _TURNS
            x ^= x >> np.uint64(32)
            x *= others
            x ^= x >> np.uint64(29)
            bits = np.unpackbits(x.astype("<u8", copy=False).view(np.uint8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.uint8)
        out[place] = np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _describe(texts: list[str]) -> dict[str, list]:
    import xxhash

    nothing_kept()
    sets = [shingle_set(t) for t in texts]
    return {
        "same": [xxhash.xxh128_digest(s.tobytes()) for s in sets],
        "size": [len(s) for s in sets],
        "keys": [band_keys(s).view(np.int64) for s in sets],
    }


_FIELDS = [
    T.StructField("same", T.BinaryType()),
    T.StructField("size", T.LongType()),
    T.StructField("keys", T.ArrayType(T.LongType())),
]


def _written(df: DataFrame) -> DataFrame:
    """df as a table, so that plans start anew and Spark knows sizes; it goes when the stage's result is known."""
    return stored(df, "near-dedup")


def _texts_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted, rows of (row, ...), with their texts; a bitmap of fixed size keeps other texts out of the shuffle."""
    place = F.pmod(F.xxhash64("row"), F.lit(BITMAP_BITS)).alias("place")
    part, bit = F.floor(F.col("place") / 32768).alias("part"), F.col("place") % 32768
    bits = _written(wanted.select(place).groupBy(part).agg(F.bitmap_construct_agg(bit).alias("bits")))
    byte = F.conv(F.hex(F.substring("bits", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = (
        texts.select("row", "text", place)
        .withColumn("part", part)
        .join(F.broadcast(bits), "part")
        .where(F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1)
        .select("row", "text")
    )
    return found.join(wanted.hint("merge"), "row")


def prefix_length(size):
    """How many of a set's rarest elements another set must meet to have the least similarity; for columns and arrays."""
    up, down = LEAST
    return size - (up * size + down - 1) // down + 1


def _live(units: DataFrame) -> DataFrame:
    """The rows of units that share a key with another one."""
    keyed = units.select("row", F.posexplode("keys").alias("which", "key"))
    shared = _written(keyed.groupBy("which", "key").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    return _written(keyed.join(shared, ["which", "key"]).select("row").distinct())


def _shingles(texts: DataFrame) -> DataFrame:
    """(row, size, h): the distinct shingles of each text, with their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts = batch.column("row"), batch.column("text")
            for i, j in blocks(pc.binary_length(texts).to_pylist()):
                sets = [shingle_set(t) for t in texts.slice(i, j - i).to_pylist()]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(rows.slice(i, j - i).to_numpy(), sizes)),
                        pa.array(np.repeat(sizes, sizes)),
                        pa.array(np.concatenate(sets).view(np.int64)),
                    ],
                    ["row", "size", "h"],
                )

    return texts.select("row", "text").mapInArrow(run, "row long, size long, h long")


def _prefixes(texts: DataFrame, live: DataFrame) -> DataFrame:
    """(row, h): the shingles of each live unit's prefix that another one holds."""
    with temporary(texts.sparkSession):  # the table of all shingles goes first
        shingles = _written(_shingles(_texts_of(texts, live)))
        shared = _written(shingles.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"))
        held = shingles.join(shared, "h").groupBy("row", "size")
        held = held.agg(F.sort_array(F.collect_list(F.struct("n", "h"))).alias("held"))
        up, down = LEAST
        # The shingles that no other unit holds come first.
        alone = F.col("size") - F.size("held")
        wanted = F.col("size") - F.floor((F.col("size") * up + (down - 1)) / down) + 1 - alone
        first = F.slice("held", F.lit(1), F.greatest(F.lit(0), wanted).cast("int"))
        found = held.select("row", F.explode(first).alias("x")).select("row", "x.h")
        return stored(found, "near-dedup", outlives=True)


def _loose_groups(prefixes: DataFrame) -> DataFrame:
    """(row, root) of the units that a common shingle in prefixes connects to others."""
    least = _written(prefixes.groupBy("h").agg(F.count("*").alias("n"), F.min("row").alias("v")).where("n > 1").drop("n"))
    edges = _written(prefixes.join(least, "h").select(F.col("row").alias("u"), "v").distinct())
    roots = components(edges)
    return roots.select(F.col("u").alias("row"), "root").unionByName(roots.select(F.col("root").alias("row"), "root").distinct())


class Group:
    """The members of a group in a task: non-empty sets, and who is connected.

    Members of one side are not compared with each other, unless that side is BOTH.
    """

    BOTH = 2

    def __init__(self, sets: list[np.ndarray], component: np.ndarray, side: np.ndarray | None = None, fps: np.ndarray | None = None):
        self.sets, self.fps, n = sets, fingerprints(sets) if fps is None else fps, len(sets)
        self.side = np.full(n, self.BOTH) if side is None else side
        self.sizes = np.array([len(s) for s in sets], dtype=np.int64)
        first, self.root = np.unique(component, return_index=True, return_inverse=True)[1:]
        self.root = first[self.root]
        self.ones = first  # one member of each component
        pivots = np.unique(np.linspace(0, n - 1, min(n, PIVOTS)).astype(np.int64))
        self.table = np.stack([distances(self.fps, self.fps[p]) for p in pivots], axis=1).astype(np.int16)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.element, self.count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)[1:]
        self.owner = np.repeat(np.arange(n), self.sizes)
        # What several members hold: bits for the COMMON held most, the rest as it is.
        rank = np.full(len(self.count), COMMON)
        top = np.argsort(-self.count, kind="stable")[:COMMON]
        rank[top] = np.arange(len(top))
        rank[self.count == 1] = COMMON + 1
        rank = rank[self.element]
        bits = np.zeros((n, COMMON), dtype=bool)
        bits[self.owner[rank < COMMON], rank[rank < COMMON]] = True
        self.bits = np.packbits(bits, axis=1).view(np.uint64)
        self.rest, of = self.element[rank == COMMON], self.owner[rank == COMMON]
        self.rest_sizes = np.bincount(of, minlength=n)
        self.rest_starts = np.cumsum(self.rest_sizes) - self.rest_sizes
        self.mark = np.zeros(len(self.count), dtype=bool)
        self.seen = self.discarded = 0

    def near(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Which pairs sizes, pivots and fingerprints leave."""
        up, down = LEAST
        a, b = self.sizes[i], self.sizes[j]
        left = down * np.minimum(a, b) >= up * np.maximum(a, b)
        self.seen += (seen := int(left.sum()))
        left[left] = np.abs(self.table[i[left]] - self.table[j[left]]).max(axis=1) <= RADIUS
        self.discarded += seen - int(left.sum())
        left[left] = distances(self.fps[i[left]], self.fps[j[left]]) <= RADIUS
        return left

    def compare(self, i: int, others: np.ndarray) -> np.ndarray:
        """Those of the others whose sets are like that of i; the rest of a set is gone through only if its bits leave that open."""
        up, down = LEAST
        both = np.bitwise_count(self.bits[others] & self.bits[i]).sum(axis=1, dtype=np.int64)
        least = -(-up * (self.sizes[others] + self.sizes[i]) // (up + down))
        unsure = (both < least) & (both + np.minimum(self.rest_sizes[others], self.rest_sizes[i]) >= least)
        if unsure.any():
            at, sizes = self.rest_starts[others[unsure]], self.rest_sizes[others[unsure]]
            before = np.cumsum(sizes) - sizes
            flat = np.repeat(at - before, sizes) + np.arange(sizes.sum())
            own = self.rest[self.rest_starts[i] : self.rest_starts[i] + self.rest_sizes[i]]
            self.mark[own] = True
            both[unsure] += np.add.reduceat(self.mark[self.rest[flat]], before, dtype=np.int64)
            self.mark[own] = False
        return others[both >= least]

    def candidates(self) -> list[np.ndarray]:
        """For each shingle that is in the prefixes of several members, those members."""
        element, count, owner = self.element, self.count, self.owner
        order = np.lexsort((element, count[element], owner))
        place = np.arange(len(owner)) - np.repeat(self.starts, self.sizes)
        first = (place < np.repeat(prefix_length(self.sizes), self.sizes)) & (count[element[order]] > 1)
        element, owner = element[order][first], owner[first]
        order = np.argsort(element, kind="stable")
        edges = np.flatnonzero(np.diff(element[order])) + 1
        return [m for m in np.split(owner[order], edges) if len(m) > 1]

    def middle(self, members: np.ndarray) -> int:
        """The member whose set is most like what over half of the members hold."""
        if len(members) < 3:
            return members[0]
        sizes = self.sizes[members]
        before = np.cumsum(sizes) - sizes
        flat = self.element[np.repeat(self.starts[members] - before, sizes) + np.arange(sizes.sum())]
        held, count = np.unique(flat, return_counts=True)
        held = held[2 * count > len(members)]
        self.mark[held] = True
        both = np.add.reduceat(self.mark[flat], before, dtype=np.int64)
        self.mark[held] = False
        return members[np.argmax(both / (sizes + len(held) - both))]

    def verified(self) -> list[tuple[int, int]]:
        """(member, another of its component) for a member of each component that was joined to another."""
        found = self.candidates()
        if not found:
            return []
        lists = np.repeat(np.arange(len(found)), [len(m) for m in found])
        holders = np.concatenate(found)
        lists, ends = lists[np.argsort(holders, kind="stable")], np.cumsum(np.bincount(holders, minlength=len(self.sets)))
        # Members that hold much of what others hold come first, the first of them of the largest component. What it is
        # connected to is left out; all others are compared with each that hasn't been, and isn't connected to them.
        order = np.argsort(-np.add.reduceat(self.count[self.element], self.starts) / self.sizes, kind="stable")
        large = np.bincount(self.root).argmax()
        hub = order[self.root[order] == large][0]
        wanted, done = np.zeros(len(self.sets), dtype=bool), np.zeros(len(self.sets), dtype=bool)
        for i in [hub, *order.tolist()]:
            if done[i] or i != hub and self.root[i] == self.root[hub]:
                continue
            done[i] = True
            own = lists[ends[i - 1] if i else 0 : ends[i]].tolist()
            if not own:
                continue
            for k in own:
                wanted[found[k]] = True
            others = np.flatnonzero(wanted & ~done & (self.root != self.root[i]) & ((self.side != self.side[i]) | (self.side == self.BOTH)))
            wanted[:] = False
            others = others[self.near(np.full(len(others), i), others)]
            if others.size and (linked := self.compare(i, others)).size:
                roots = np.append(self.root[linked], self.root[i])
                to = np.arange(len(self.sets))
                to[roots] = roots.min()
                self.root = to[self.root]
        joined = []
        by = self.ones[np.argsort(self.root[self.ones], kind="stable")]
        for members in np.split(by, np.flatnonzero(np.diff(self.root[by])) + 1):
            if len(members) > 1:
                joined += [(i, m) for m in [int(self.middle(members))] for i in members.tolist() if i != m]
        return joined


_SET_FIELDS = [T.StructField("shingles", T.BinaryType()), T.StructField("fp", T.BinaryType())]


def _sets(texts: list[str]) -> dict[str, list]:
    sets = [shingle_set(t) for t in texts]
    return {"shingles": [s.astype("<u8").tobytes() for s in sets], "fp": [f.astype("<u8").tobytes() for f in fingerprints(sets)]}


def _links(members: DataFrame, bodies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges (u, v) that connect what is linked within each group, from members (row, size, component, side, g).

    bodies adds the texts, or shingles and fp, to rows. Of a component that was found here, all v are the same.
    """
    members = _written(members)
    bins = max(1, -(-(members.agg(F.sum("size")).first()[0] or 0) // BIN_SHINGLES))
    grouped = bodies(members).withColumn("bin", F.pmod(F.col("g"), F.lit(bins)))

    def of_bin(found: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, rows in found.groupby("g", sort=False):
            rows, fps = rows.sort_values("row"), None
            row = rows["row"].to_numpy()
            if "text" in rows:
                sets = [shingle_set(t) for t in rows["text"]]
            else:
                sets = [np.frombuffer(b, dtype="<u8") for b in rows["shingles"]]
                fps = np.stack([np.frombuffer(b, dtype="<u8") for b in rows["fp"]])
            group = Group(sets, rows["component"].to_numpy(), rows["side"].to_numpy(), fps)
            out += [(row[a], row[b]) for a, b in group.verified()]
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return _written(grouped.groupBy("bin").applyInPandas(of_bin, "u long, v long"))


def _joined(members: DataFrame, links: DataFrame) -> DataFrame:
    """members with the smallest row of their component, which is a member too."""
    roots = components(links).withColumnsRenamed({"u": "row", "root": "least"})
    return _written(
        members.join(roots, "row", "left").withColumn("component", F.coalesce("least", "row")).drop("least")
    )


def _parts(size):
    return F.greatest(F.lit(1), F.ceil(size / PART_SHINGLES)).cast("int")


def _part(parts, turn: int):
    return F.pmod(F.xxhash64("row", F.lit(turn)), parts)


def _alone(rows: DataFrame, g) -> DataFrame:
    """Members (row, size, component, side, g) that nothing connects yet, from rows (row, size, ...)."""
    return rows.select("row", "size", F.col("row").alias("component"), F.lit(Group.BOTH).alias("side"), g.alias("g"))


def _verified_links(texts: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges between rows that connect what is linked, from placed (row, root, size)."""
    sizes = _written(placed.groupBy("root").agg(_parts(F.sum("size")).alias("parts")))
    placed = _written(placed.join(sizes, "root"))
    links = _links(_alone(placed.where("parts = 1"), F.xxhash64("root")), lambda members: _texts_of(texts, members))
    large = placed.where("parts > 1")
    if large.isEmpty():
        return links
    sets = _written(map_texts(_texts_of(texts, large.select("row")), _SET_FIELDS, lambda: _sets))

    def bodies(members):
        return sets.join(members, "row")

    found = _links(_alone(large, F.xxhash64("root", _part(F.col("parts"), 0))), bodies)
    inner, turn = found, 0
    ones = large.drop("parts").join(found.select(F.col("v").alias("row")).distinct(), "row")
    while True:
        # One unit of each component of a group that was dealt into parts; they are dealt anew while that joins many.
        turn += 1
        sizes = ones.groupBy("root").agg(_parts(F.sum("size")).alias("parts"), F.count("*").alias("n")).where("n > 1")
        ones = _written(ones.join(_written(sizes), "root"))
        found = _links(_alone(ones, F.xxhash64("root", _part(F.col("parts"), turn))), bodies)
        inner = _written(inner.unionByName(found))
        if ones.where("parts > 1").isEmpty() or 4 * found.count() < ones.count():
            break
        ones = ones.drop("parts", "n").join(found.select(F.col("u").alias("row")), "row", "left_anti")
    return links.unionByName(inner).unionByName(_links_across(_joined(large.drop("parts"), inner), bodies))


def _links_across(members: DataFrame, bodies: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Edges between components of one group, from members (row, root, size, component)."""
    by = members.groupBy("root", "component").agg(F.sum("size").alias("all"))
    largest = by.groupBy("root").agg(F.max(F.struct("all", "component")).alias("most"), F.sum("all").alias("total"))
    largest = _written(largest.where("total > most.all"))
    largest = largest.select(
        "root", F.col("most.component").alias("large"), _parts(F.col("most.all")).alias("inner"), _parts(F.col("total") - F.col("most.all")).alias("outer")
    )
    members = members.join(largest, "root")
    inside = F.col("component") == F.col("large")
    own = F.when(inside, _part(F.col("inner"), -1)).otherwise(_part(F.col("outer"), -2)).cast("int")

    def every(parts: str, side, *g):
        return F.transform(F.sequence(F.lit(0), F.col(parts) - 1), lambda i: F.struct(side(i).cast("int").alias("side"), F.xxhash64("root", *[x(i) for x in g]).alias("g")))

    def named(name: str):
        return lambda i: F.lit(name)

    def mine(i):
        return F.col("own")

    # A part of the largest component meets every outer part; outer parts meet each other too.
    of_inner = every("outer", lambda i: F.lit(0), named("inner"), mine, lambda i: i)
    with_inner = every("inner", lambda i: F.lit(1), named("inner"), lambda i: i, mine)
    with_outer = every(
        "outer",
        lambda i: F.when(i == F.col("own"), Group.BOTH).otherwise((i < F.col("own")).cast("int")),
        named("outer"), lambda i: F.least(i, "own"), lambda i: F.greatest(i, "own"),
    )
    groups = F.when(inside, of_inner).otherwise(F.concat(with_inner, with_outer))
    return _links(members.withColumn("own", own).select("row", "size", "component", F.inline(groups)), bodies)


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The row of docs with the smallest id, with all its columns, for each component; of repeated rows, one."""
    rows, number = numbered(docs, "near-dedup")
    given = id_and_text(rows, id_col, text_col, number)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    with temporary(docs.sparkSession):
        units = _written(
            map_texts(given, _FIELDS, lambda: _describe)
            .groupBy("same")
            .agg(F.min(order).alias("first"), F.first("size").alias("size"), F.first("keys").alias("keys"))
            .select("first", F.col("first.row").alias("row"), "size", "keys")
        )
        texts = given.select("row", "text")
        groups = _loose_groups(_prefixes(texts, _live(units)))
        placed = _written(units.select("row", "size").join(groups, "row"))
        roots = components(_verified_links(texts, placed)).withColumnRenamed("u", "row")
        stay = (
            units.select("first", "row")
            .join(roots, "row", "left")
            .groupBy(F.coalesce("root", "row"))
            .agg(F.min("first").alias("first"))
            .select(F.col("first.row").alias("row"))
        )
        stay = stored(stay, "near-dedup", outlives=True)
    return staying(rows, number, stay)
