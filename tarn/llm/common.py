"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarn.sources.tables import read_table

#: Texts handed to a function at once hold about so many bytes; one longer text goes alone.
BLOCK_BYTES = 2_000_000

#: Texts of an Arrow batch.
BATCH_ROWS = 2000

#: Bits of each of the two bitmaps of rows that stay and go (8 MB); a power of two from 32768 on.
STAYING_BITS = 1 << 26


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only for a local session without it."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not re.match(r"local(\[|$)", sc.master or ""):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="shared-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder without its lineage.

    For narrow rows; Spark deletes the files when the result is no longer
    referenced, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: For each open temporary(), the paths of the tables stored in it.
_TEMPORARY: list[list[str]] = []


def stored(df: DataFrame, label: str, outlives: bool = False) -> DataFrame:
    """df, written once as a compressed table in the shared folder and read back.

    For wide rows. The table goes with the innermost temporary() around the call,
    or with the next one if it outlives that; without one it stays, like any file
    of that folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    holders = _TEMPORARY[:-1] if outlives else _TEMPORARY
    if holders:
        holders[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def deleted(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of the shared folder, by Spark's own file systems."""
    jvm = spark._jvm
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[list[str]]:
    """What is stored within is deleted at the end; so nothing that is read later may depend on it."""
    paths: list[str] = []
    _TEMPORARY.append(paths)
    try:
        yield paths
    finally:
        _TEMPORARY.pop()
        deleted(spark, paths)


def unused(names: Iterable[str], wanted: str) -> str:
    """wanted, or with underscores behind it, so that none of the names equals it; Spark doesn't tell cases apart."""
    taken = {n.lower() for n in names}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


def numbered(docs: DataFrame, label: str) -> tuple[DataFrame, str]:
    """docs with a number for each row, stored so that the numbers hold in every pass, and the number's column."""
    name = unused(docs.columns, "row_number")
    return stored(docs.withColumn(name, F.monotonically_increasing_id()), label), name


def staying(rows: DataFrame, name: str, stay: DataFrame) -> DataFrame:
    """The numbered rows whose number is in the column row of stay, without the number.

    Two bitmaps of fixed size, of the hashed numbers that stay and of those that
    go, decide nearly all rows where they are read. Only rows whose bit is in both
    are shuffled, and joined with stay.
    """
    place = F.pmod(F.xxhash64(name), F.lit(STAYING_BITS))
    part, bit = F.floor(place / 32768).cast("int"), F.pmod(place, F.lit(32768))
    of, kept, gone = (unused(rows.columns, n) for n in ("part_of_bits", "bits_kept", "bits_gone"))
    # At most STAYING_BITS / 32768 rows of 8 KB; every row's part is among them.
    bits = (
        rows.select(name)
        .join(stay.select(F.col("row").alias(name), F.lit(True).alias("stays")), name, "left")
        .groupBy(part.alias(of))
        .agg(
            F.bitmap_construct_agg(F.when(F.col("stays"), bit)).alias(kept),
            F.bitmap_construct_agg(F.when(F.col("stays").isNull(), bit)).alias(gone),
        )
    )
    bits = stored(bits, "staying")

    def held(found: str) -> Column:
        byte = F.conv(F.hex(F.substring(found, F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.call_function("shiftright", byte, (bit % 8).cast("int")).bitwiseAND(1) == 1

    marked = rows.withColumn(of, part).join(F.broadcast(bits), of).where(held(kept))
    sure = marked.where(~held(gone)).select(*[column(c) for c in rows.columns])
    unsure = marked.where(held(gone)).select(*[column(c) for c in rows.columns])
    # An inner join: Spark would push a semi join below the bitmaps, and shuffle all rows.
    unsure = unsure.join(stay.select(F.col("row").alias(name)).distinct(), name)
    return sure.drop(name).union(unsure.drop(name))


def column(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def id_and_text(df: DataFrame, id_col: str, text_col: str, row: Column | str | None = None) -> DataFrame:
    """Only (id, text) and perhaps row, so that no other column of df can clash or be read; a null text is empty."""
    more = [] if row is None else [(column(row) if isinstance(row, str) else row).alias("row")]
    return df.select(
        column(id_col).alias("id"), F.coalesce(column(text_col).cast("string"), F.lit("")).alias("text"), *more
    )


#: What a Python worker keeps for its next tasks: one thing, so that stages don't add up.
_KEPT: dict[object, object] = {}


def kept_in_worker(key: object, make: Callable[[], object]) -> object:
    """make()'s result, from an earlier task of this Python worker if the last key was the same."""
    if key not in _KEPT:
        _KEPT.clear()
        _KEPT[key] = make()
    return _KEPT[key]


def nothing_kept() -> None:
    """For functions that keep nothing: what an earlier stage has learnt doesn't add to what they need."""
    _KEPT.clear()


def blocks(sizes: list[int], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Runs [i, j) whose sizes add up to about `most`; a larger one stands alone or ends a run."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield start, len(sizes)


def bitmap(rows: DataFrame, number: Column, bits: int) -> bytes:
    """Bits `number mod bits` of all rows; bits / 8 bytes however many rows there are. bits: a power of two from 32768 on."""
    bit = F.pmod(number, F.lit(bits))
    parts = (
        rows.select(bit.alias("bit"))
        .groupBy(F.floor(F.col("bit") / 32768).cast("int").alias("part"))
        .agg(F.bitmap_construct_agg((F.col("bit") % 32768).cast("long")).alias("bits"))
    )
    out = bytearray(bits // 8)
    for part, held in parts.collect():  # at most bits / 32768 rows of 4 KB
        out[part * 4096 : part * 4096 + len(held)] = held
    return bytes(out)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS texts at most, unless the session has a number of its own: executors hold several at once."""
    name, usual = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000"
    if spark.conf.get(name, usual) == usual:
        spark.conf.set(name, str(BATCH_ROWS))


def map_texts(
    df: DataFrame,
    fields: list[T.StructField],
    make: Callable[[], Callable[[list[str]], dict[str, list]]],
    text_col: str = "text",
    keep_text: bool = False,
) -> DataFrame:
    """df with the columns that a function of its texts returns, and without the text unless it is kept.

    make() runs once in each task and returns that function; it gets whole
    texts, a null as an empty one, in blocks of bounded size. Columns of df
    with the names of new ones are replaced.
    """
    names = [f.name for f in fields]
    df = df.drop(*[n for n in names if n != text_col])
    others = [f for f in df.schema.fields if f.name != text_col or keep_text]
    schema, at = T.StructType(others + fields), df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        work, arrow = make(), to_arrow_schema(schema)
        for batch in batches:
            texts = batch.column(at)
            kept = [batch.column(i) for i in range(batch.num_columns) if i != at or keep_text]
            for i, j in blocks(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                out = work([x or "" for x in texts.slice(i, j - i).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [c.slice(i, j - i).cast(f.type) for c, f in zip(kept, arrow)]
                    + [pa.array(out[n], type=arrow.field(n).type) for n in names],
                    schema=arrow,
                )

    small_batches(df.sparkSession)
    # Any column name will do, also one with dots.
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).mapInArrow(run, schema)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)
