"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Shuffling all rows uniformly and cutting the result into shards sends, from
partition p to shard s, a number of rows that follows a multivariate
hypergeometric law. That matrix is drawn first, exactly, from the partitions'
row counts. Then three steps give every row its place:

1. permute locally: a row's index in its partition is sent through a
   pseudo-random permutation of the partition, and the matrix row cuts the
   result into runs, one for each shard;
2. exchange: the run of partition p starts in shard s behind those of the
   partitions before p, so every row knows its index in the shard;
3. permute again: that index is sent through a permutation of the shard, which
   gives its slot, and each run of SLOTS_A_TASK slots of a shard is a partition.

Both permutations are swap-or-not networks: each round maps x to k - x or
leaves it, as a hash of the pair decides. That is a permutation of 0..n-1 for
every n, computed for each row alone, so nothing is sorted or gathered to be
numbered, and a hot key, source or text cannot make a hot task.

Rows are first written to the shared folder, so that the counts and the later
passes see the same partitions, also when an executor is lost in between. Only
the partitions' counts reach the driver.

Law `rows`: shards' row counts differ by at most one; shard sizes and slots are
exact. All other columns pass through, whatever their names; `shard` and `slot`
replace columns of those names. Null ids and texts and repeated rows are rows like any others. An empty
table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarn.llm.common import column, stored

ROUNDS = 40
SLOTS_A_TASK = 10_000
#: Runs that may be broadcast, of some 50 bytes each: enough for 100,000 partitions and 8 shards.
BROADCAST_RUNS = 1_000_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, drawn: int) -> int:
    """How many of `drawn` balls taken from good + bad are good; exact for any size."""
    low, high = max(0, drawn - bad), min(drawn, good)
    if low == high:
        return low
    total = good + bad
    mode = min(high, max(low, (drawn + 1) * (good + 1) // (total + 2)))
    sd = (drawn * good / total * bad / total * (total - drawn) / max(1, total - 1)) ** 0.5
    reach = int(40 * sd) + 40  # beyond it lies less than a double can tell from zero
    a, b = max(low, mode - reach), min(high, mode + reach)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log(good - k) + np.log(drawn - k) - np.log(k + 1) - np.log(bad - drawn + k + 1)
    logs = np.concatenate(([0.0], np.cumsum(ratio)))
    weights = np.cumsum(np.exp(logs - logs.max()))
    return a + int(np.searchsorted(weights, rng.random() * weights[-1], side="right"))


def communication_matrix(counts: list[int], shards: int, seed: int) -> list[list[int]]:
    """Rows from each partition to each shard; row sums are counts, column sums differ by at most one."""
    rng = np.random.default_rng(seed)
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    matrix = []
    for count in counts:
        line, left, space = [], count, sum(room)
        for s in range(shards):
            space -= room[s]
            n = hypergeometric(rng, room[s], space, left)
            line.append(n)
            left -= n
        room = [r - n for r, n in zip(room, line)]
        matrix.append(line)
    return matrix


def permuted(x: Column, n: Column, key: Column, seed: int) -> Column:
    """x's place in a pseudo-random permutation of 0..n-1 that belongs to key."""

    def swap_or_not(at: Column, turn: Column) -> Column:
        pivot = F.pmod(F.xxhash64(F.lit(seed), key, turn), n)
        other = F.pmod(pivot - at, n)
        flip = F.xxhash64(F.lit(seed), key, turn, F.greatest(at, other)) % 2 == 0
        return F.when(flip, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x, swap_or_not)


def shard_rows(docs: DataFrame, shards: int = 8, seed: int = 0) -> DataFrame:
    """docs with shard (0..shards-1) and slot (0.. without gaps in each shard), dealt out in that order."""
    spark = docs.sparkSession
    docs = docs.drop("shard", "slot")
    # A row goes as one value, so that no column of it can clash. The number of a row holds its partition in the
    # upper bits and its index there in the lower 33.
    whole = F.struct(*map(column, docs.columns)) if docs.columns else F.struct(F.lit(None).alias("none"))
    rows = stored(docs.select(whole.alias("doc"), F.monotonically_increasing_id().alias("number")), "sharding")
    rows = rows.select(
        "doc",
        F.shiftrightunsigned("number", 33).alias("part"),
        F.col("number").bitwiseAND(F.lit((1 << 33) - 1)).alias("index"),
    )
    counts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.count("*")).collect())  # one row a partition
    matrix = communication_matrix([n for _, n in counts], shards, seed)
    sizes = [sum(line[s] for line in matrix) for s in range(shards)]
    plan, before = [], [0] * shards
    for (part, count), line in zip(counts, matrix):
        start = 0
        for s in range(shards):
            plan.append((part, count, s, start, start + line[s], before[s], sizes[s]))
            start, before[s] = start + line[s], before[s] + line[s]
    # A row for each partition: its count, and its runs.
    runs = (
        spark.createDataFrame(plan, "part long, n long, shard int, start long, stop long, before long, size long")
        .where("stop > start")
        .groupBy("part", "n")
        .agg(F.collect_list(F.struct("shard", "start", "stop", "before", "size")).alias("runs"))
    )
    if len(plan) <= BROADCAST_RUNS:
        runs = F.broadcast(runs)  # else a join on the partitions, none of which holds many rows
    placed = (
        rows.join(runs, "part")
        .withColumn("at", permuted(F.col("index"), F.col("n"), F.col("part"), seed))
        .withColumn("run", F.filter("runs", lambda r: (r.start <= F.col("at")) & (F.col("at") < r.stop))[0])
        .withColumn("slot", F.col("at") - F.col("run.start") + F.col("run.before"))
    )
    slot = permuted(F.col("slot"), F.col("run.size"), -1 - F.col("run.shard").cast("long"), seed)
    chunks = [-(-n // SLOTS_A_TASK) for n in sizes]
    first = F.array(*[F.lit(sum(chunks[:s])) for s in range(shards)])
    dealt = placed.select("doc", "run.shard", slot.alias("slot"))
    chunk = F.get(first, F.col("shard")) + F.floor(F.col("slot") / SLOTS_A_TASK)
    dealt = dealt.repartitionById(max(1, sum(chunks)), chunk.cast("int")).sortWithinPartitions("slot")
    return dealt.select("doc.*", "shard", "slot") if docs.columns else dealt.select("shard", "slot")
