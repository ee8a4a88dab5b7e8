"""Near-duplicates by SimHash, with pivot distance tables.

A text's fingerprint has 64 bits; a bit is set if it is set in over half of the
hashes of the text's word shingles. Texts whose fingerprints differ in at most
`radius` bits are linked, and linked texts form one component.

Finding the links among distinct fingerprints:

1. The bits fall into blocks. Fingerprints within the radius agree on some set
   of (blocks - radius) whole blocks, so each fingerprint goes once to the
   bucket of every such set. More blocks, and so longer keys, are taken as the
   number of fingerprints grows; every choice finds all links.
2. A bucket of more than SPLIT fingerprints is dealt into parts, and each pair
   of parts becomes a bucket of its own. No task gets an unbounded bucket.
3. In a bucket, each fingerprint has a table row of Hamming distances to many
   reference fingerprints. By the triangle inequality, a pair whose rows differ
   by more than the radius anywhere is discarded. The rest is verified.
4. A bucket returns the edges of a spanning forest of its links, at most one
   for each fingerprint, never all pairs.

Components of the forests come from alternating large-star and small-star
steps, each one a few joins on edges kept in the shared folder.

Defined cases: a null or blank text has no words and the fingerprint zero,
which links like any other. Repeated rows and equal ids each get a row. A null
id is never the smallest of a component with other ids. An empty table gives an
empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import cut, id_and_text, map_texts, numbered, staying, stored, temporary

SHINGLE, SEED, RADIUS = 4, 42, 4
SPLIT, BIN_ROWS = 2048, 20_000
#: Many reference fingerprints: multiples of an odd 64-bit constant.
REFERENCES = np.array([(i * 0x9E3779B97F4A7C15) % 2**64 for i in range(1, 33)], dtype=np.uint64)


def shingle_hashes(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """A hash for each of the text's word shingles, in order; one for a shorter text, none without words."""
    import xxhash

    words = text.encode().lower().split()  # both act on ASCII alone
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(line, SEED)], dtype=np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - shingle + 1].tolist(), ends[shingle - 1 :].tolist())
    return np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, len(words) - shingle + 1)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes, unsigned."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(rows: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """rows without their text and with its fingerprint fp, as a signed long."""

    def work(texts):
        found = np.array([fingerprint(t, shingle) for t in texts], dtype=np.uint64)
        return {"fp": found.view(np.int64)}

    return map_texts(rows, [T.StructField("fp", T.LongType())], lambda: work)


def block_count(n: int, radius: int) -> int:
    """Blocks so that an even spread puts a few of n fingerprints in a bucket."""
    count = radius + 2
    while count < 2 * radius and n > 8 * 2 ** (64 * (count - radius) / count):
        count += 1
    return count


def _bucket_keys(fp: Column, radius: int, count: int) -> Column:
    """An array of one key for each set of blocks that may agree."""
    edges = [64 * i // count for i in range(count + 1)]
    keys = []
    for number, chosen in enumerate(combinations(range(count), count - radius)):
        mask = sum(((1 << edges[i + 1]) - (1 << edges[i])) for i in chosen)
        signed = mask - 2**64 if mask >= 2**63 else mask
        keys.append(F.struct(F.lit(number).alias("which"), fp.bitwiseAND(F.lit(signed)).alias("key")))
    return F.array(*keys)


def forest(
    values: np.ndarray, groups: np.ndarray, radius: int, alike: Callable[[int, int], bool] | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Edges (value, value) of a spanning forest of each group's links; with alike, edges of places in values.

    alike has the last word on two places within the radius; it is not asked about what is already connected.
    """
    order = np.lexsort((values, groups))
    x, g = values[order].view(np.uint64), groups[order]
    n = len(x)
    table = np.bitwise_count(x[:, None] ^ REFERENCES[None, :]).astype(np.int8)
    end = np.searchsorted(g, g, side="right")
    root, active, step = np.arange(n), np.arange(n), 0
    while True:
        step += 1
        active = active[active + step < end[active]]
        if not active.size:
            break
        i, j = active, active + step
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
        for c in range(table.shape[1]):
            if not i.size:
                break
            near = np.abs(table[i, c] - table[j, c]) <= radius
            i, j = i[near], j[near]
        if i.size:
            near = np.bitwise_count(x[i] ^ x[j]) <= radius
            i, j = i[near], j[near]
        if i.size:
            for a, b in zip(i.tolist(), j.tolist()):
                at = order[a], order[b]
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                if a != b and (alike is None or alike(*at)):
                    root[max(a, b)] = min(a, b)
            while not np.array_equal(root, up := root[root]):
                root = up
    leaf = np.nonzero(root != np.arange(n))[0]
    ends = order if alike else x.view(np.int64)
    return ends[leaf], ends[root[leaf]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between the distinct values of column fp; together they connect what is linked."""
    n = distinct.count()
    keyed = distinct.select("fp", F.explode(_bucket_keys(F.col("fp"), radius, block_count(n, radius))).alias("b"))
    return bucket_links(keyed.select("fp", "b.which", "b.key"), radius)


def bucket_links(keyed: DataFrame, radius: int) -> DataFrame:
    """Edges (u, v) that connect the fingerprints within the radius among those of one bucket (which, key)."""
    sizes = cut(
        keyed.groupBy("which", "key")
        .agg(F.count("*").alias("size"))
        .where("size > 1")
        .withColumn("parts", F.ceil(F.col("size") / SPLIT).cast("int"))
    )
    total = sizes.agg(F.sum(F.col("size") * F.col("parts"))).first()[0] or 0
    bins = max(1, -(-total // BIN_ROWS))
    part = F.pmod(F.hash("fp", F.lit(7)), F.col("parts"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    grouped = (
        keyed.join(sizes, ["which", "key"])
        .select("fp", "which", "key", part.alias("part"), other.alias("other"))
        .select("fp", F.xxhash64("which", "key", F.least("part", "other"), F.greatest("part", "other")).alias("g"))
        .withColumn("bin", F.pmod(F.col("g"), F.lit(bins)))
    )

    def of_bin(rows: pd.DataFrame) -> pd.DataFrame:
        u, v = forest(rows["fp"].to_numpy(), rows["g"].to_numpy(), radius)
        return pd.DataFrame({"u": u, "v": v})

    return grouped.groupBy("bin").applyInPandas(of_bin, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every u that has an edge and isn't itself the smallest of its component.

    Each step is written as a table: plans start anew, and Spark knows sizes.
    """

    def state(df):
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())

    def written(df, outlives=False):
        return stored(df, "components", outlives)

    with temporary(edges.sparkSession):
        now = written(
            edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
        )
        before, after = None, state(now)
        while before != after and after[0]:
            both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
            # Written apart, so that the join's sides are plain exchanges, of which Spark can split that of a hub.
            least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")))
            large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
            large = written(large)
            least = written(large.groupBy("u").agg(F.min("v").alias("m")))
            small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            now = written(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
            before, after = after, state(now)
        return written(now.withColumnRenamed("v", "root"), outlives=True)


def _rooted(rows: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Rows of (id, text, ...) without the text and with fp, the root of its component and the component's smallest id."""
    rows = cut(fingerprints(rows, shingle))
    distinct = rows.groupBy("fp").agg(F.min("id").alias("first_id"))
    roots = components(links(distinct.select("fp"), radius)).withColumnRenamed("u", "fp")
    of_fp = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = cut(of_fp.groupBy("root").agg(F.min("first_id").alias("component_id")))
    classes = of_fp.join(smallest, "root").select("fp", "root", "component_id")
    return rows.join(classes, "fp")


def near_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """One row per row of docs: id, fingerprint (16 hex digits), component_id (the component's smallest id)."""
    return _rooted(id_and_text(docs, id_col, text_col), shingle, radius).select(
        "id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def kept(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
) -> DataFrame:
    """The row of docs with the smallest id, with all its columns, for each component; of repeated rows, one."""
    rows, number = numbered(docs, "simhash")
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("row"))
    stay = (
        _rooted(id_and_text(rows, id_col, text_col, number), shingle, radius)
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(F.col("first.row").alias("row"))
    )
    return staying(rows, number, stay)
