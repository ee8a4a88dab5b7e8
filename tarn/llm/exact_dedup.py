"""Exact deduplication by composable polynomial fingerprints.

Texts are equal when they are identical after deleting the six ASCII white
space characters. Each text is cut into chunks; a chunk's fingerprint is its
bytes read as digits of a number in two bases, modulo two primes. Fingerprints
compose: that of `ab` is fp(a) * base^len(b) + fp(b), so the chunks of a huge
text are hashed side by side and joined in any grouping.

Equal fingerprints are not taken for equal texts: the texts are compared chunk
by chunk with the smallest text of their fingerprint, and those that differ go
to another round among themselves until none is left.

Only fingerprints of all rows are shuffled. For the comparison, a bitmap of
fixed size of the fingerprints that occur more than once is sent to the tasks,
which pass on the texts that hit it; a false hit costs a comparison of a text
with itself. Nothing that grows with the data reaches the driver. A hot
fingerprint meets its one representative in a plain join, whose large side
Spark splits.

Defined cases: a null text counts as empty, and all empty texts are equal. A
null id comes after every other id in ties. Of repeated rows with one id,
exactly one is kept. An empty table gives an empty result. Other columns are
not read, and pass through `kept`, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.llm.common import bitmap, blocks, cut, id_and_text, map_texts, nothing_kept, numbered, staying, stored, temporary

#: (prime, base): primes below 2^31, so that a product of two residues fits 62 bits.
MODULI = ((2147483647, 1000003), (2147483629, 69069))
CHUNK = 1024
#: Chunks that are hashed at once; their numbers take eight times their bytes.
SLICE = 1024
WHITE_SPACE = b" \t\n\x0b\x0c\r"
FINGERPRINT = ("n_bytes", "h1", "h2")
#: Bits of the bitmap of repeated fingerprints (8 MB).
BITMAP_BITS = 1 << 26
COMPARED_AT_ONCE = 1 << 16


def normalised(text: str) -> bytes:
    return text.encode().translate(None, WHITE_SPACE)


def chunk_fingerprints(matrix: np.ndarray, prime: int, base: int) -> np.ndarray:
    """The fingerprint of each row of bytes, halves joined level by level; leading zeros don't count."""
    m, shift = matrix.astype(np.uint64), base
    while m.shape[1] > 1:
        m = (m[:, 0::2] * np.uint64(shift) + m[:, 1::2]) % np.uint64(prime)
        shift = shift * shift % prime
    return m[:, 0]


def joined(left: int, right: int, right_length: int, prime: int, base: int) -> int:
    """The fingerprint of two pieces' concatenation."""
    return (left * pow(base, right_length, prime) + right) % prime


def fingerprint(body: bytes, prime: int, base: int) -> int:
    """The fingerprint of one body, joined from those of slices of SLICE chunks; the first chunk is the short one."""
    head = len(body) % CHUNK
    first = np.frombuffer(body[:head].rjust(CHUNK, b"\0"), dtype=np.uint8).reshape(1, CHUNK)
    value = int(chunk_fingerprints(first, prime, base)[0])
    chunks = np.frombuffer(body, dtype=np.uint8, offset=head).reshape(-1, CHUNK)
    shift = pow(base, CHUNK, prime)
    for at in range(0, len(chunks), SLICE):
        part, own = chunks[at : at + SLICE], 0
        for c in chunk_fingerprints(part, prime, base).tolist():
            own = (own * shift + c) % prime
        value = joined(value, own, len(part) * CHUNK, prime, base)
    return value


def fingerprints(bodies: list[bytes], moduli=MODULI) -> list[list[int]]:
    """For each modulus, the fingerprint of every body; short bodies side by side, a long one in slices."""
    short = [b for b in bodies if len(b) <= SLICE * CHUNK]
    counts = [max(1, -(-len(b) // CHUNK)) for b in short]
    out = []
    for prime, base in moduli:
        shift, found = pow(base, CHUNK, prime), []
        for i, j in blocks(counts, SLICE):
            # The first chunk of a body is the short one; zeros on its left change nothing.
            matrix = np.frombuffer(
                b"".join(b.rjust(n * CHUNK, b"\0") for b, n in zip(short[i:j], counts[i:j])), dtype=np.uint8
            ).reshape(-1, CHUNK)
            chunks, at = chunk_fingerprints(matrix, prime, base).tolist(), 0
            for n in counts[i:j]:
                value = 0
                for c in chunks[at : at + n]:
                    value = (value * shift + c) % prime
                found.append(value)
                at += n
        of_short = iter(found)
        out.append([next(of_short) if len(b) <= SLICE * CHUNK else fingerprint(b, prime, base) for b in bodies])
    return out


def same(a: bytes, b: bytes) -> bool:
    """Whether two bodies are equal, looking at one chunk of each at a time."""
    if len(a) != len(b):
        return False
    a, b = memoryview(a), memoryview(b)
    return all(
        a[i : i + COMPARED_AT_ONCE] == b[i : i + COMPARED_AT_ONCE] for i in range(0, len(a), COMPARED_AT_ONCE)
    )


def _describe(moduli):
    def work(texts):
        nothing_kept()
        bodies = [normalised(t) for t in texts]
        h1, h2 = fingerprints(bodies, moduli)
        return {
            "n_points": [len(t) for t in texts],
            "n_bytes": [len(b) for b in bodies],
            "h1": h1,
            "h2": h2,
            "text_sha256": [hashlib.sha256(b).hexdigest() for b in bodies],
        }

    return lambda: work


def _bodies(moduli, hits):
    """Fingerprints, and the bodies whose fingerprint may occur more than once."""

    def make():
        bits = np.frombuffer(hits.value, dtype=np.uint8)

        def work(texts):
            bodies = [normalised(t) for t in texts]
            h1, h2 = fingerprints(bodies, moduli)
            at = np.array(h1, dtype=np.int64) % BITMAP_BITS
            hit = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1
            return {
                "n_bytes": [len(b) for b in bodies],
                "h1": h1,
                "h2": h2,
                "body": [b if x else None for b, x in zip(bodies, hit.tolist())],
            }

        return work

    return make


def _differing(members: DataFrame) -> DataFrame:
    """The members whose body differs from the smallest body of their fingerprint."""
    # Stored apart, so that the join's sides are plain exchanges, of which Spark can split a hot one.
    first = stored(members.groupBy(*FINGERPRINT).agg(F.min("body").alias("first_body")), "exact-dedup")
    pairs = members.join(first, list(FINGERPRINT))

    def differ(batches):
        import pyarrow as pa

        for batch in batches:
            a, b = batch.column("body").to_pylist(), batch.column("first_body").to_pylist()
            yield batch.filter(pa.array([not same(x, y) for x, y in zip(a, b)], type=pa.bool_())).select(
                [*FINGERPRINT, "body"]
            )

    return pairs.mapInArrow(differ, members.schema)


def exact_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None, moduli=MODULI
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, text_sha256, its fingerprint and number.

    Of equal texts, the row with the most code points stays, then the smallest
    id, then the smallest number (of row_col, or given here). Weak moduli change
    the number of comparison rounds, never the result.
    """
    rows = id_and_text(docs, id_col, text_col)
    longs = [T.StructField(n, T.LongType()) for n in ("n_points", *FINGERPRINT)]
    given = id_and_text(docs, id_col, text_col, row=row_col or F.monotonically_increasing_id())
    known = cut(map_texts(given, [*longs, T.StructField("text_sha256", T.StringType())], _describe(moduli)))
    spark = docs.sparkSession
    repeated = known.groupBy(*FINGERPRINT).agg(F.count("*").alias("n")).where("n > 1")
    hits = spark.sparkContext.broadcast(bitmap(repeated, F.col("h1"), BITMAP_BITS))
    known = known.withColumn("round", F.lit(0))
    with temporary(spark):  # what is known of the rows does not depend on the bodies
        members = stored(
            map_texts(
                rows.select("text"), [*longs[1:], T.StructField("body", T.BinaryType())], _bodies(moduli, hits)
            ).where("body IS NOT NULL"),
            "exact-dedup",
        )
        turn, left = 1, cut(_differing(members))
        while not left.isEmpty():
            found = left.select(*FINGERPRINT, F.sha2("body", 256).alias("text_sha256")).distinct()
            known = cut(
                known.join(found.withColumn("again", F.lit(turn)), [*FINGERPRINT, "text_sha256"], "left")
                .withColumn("round", F.coalesce("again", "round"))
                .drop("again")
            )
            turn, left = turn + 1, cut(_differing(left))
    same_text = [*FINGERPRINT, "round"]
    order = F.struct(-F.col("n_points"), F.col("id").isNull(), F.col("id"), F.col("row"))
    groups = cut(known.groupBy(*same_text).agg(F.count("*").alias("group_size"), F.min(order).alias("first")))
    return known.join(groups, same_text).select(
        "id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("first.row")).alias("kept"),
        "text_sha256",
        *FINGERPRINT,
        "row",
    )


def kept(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of docs, with all its columns, for each group of equal texts."""
    rows, number = numbered(docs, "exact-dedup")
    with temporary(docs.sparkSession):
        stay = exact_groups(rows, id_col, text_col, number).where("kept").select("row")
        stay = stored(stay, "exact-dedup", outlives=True)
    return staying(rows, number, stay)
