"""Pieces that the operators share: tables, shared storage, grouped Arrow batches."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Let the session's Arrow batches have ``rows`` rows, where it has Spark's default of 10,000: those of long texts take too much memory."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, str(rows))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the queries; they run in batches that suit texts."""
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset, a local session gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(base)
    return base


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of plans that nothing refers to any more: it acts when the driver collects its garbage."""
    for _ in range(2):  # what the first round finds can hold what the second finds
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def saved(df: DataFrame, name: str, **options) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: cuts the lineage, and survives the loss of executors. ``options`` are the writer's."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """``df``, written with a column that numbers its rows, and the name of that column."""
    name = fresh("_row", df)
    return saved(df.withColumn(name, F.monotonically_increasing_id()), "rows", compression="zstd"), name


def fresh(name: str, df: DataFrame) -> str:
    """``name``, with as many underscores as it takes to be no column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def share_of(hashed, most: float, n: int):
    """Whether a 64-bit hash is in the share ``most`` / ``n`` of all hashes: so of n rows about ``most`` are, however many n is."""
    if n <= most:
        return F.lit(True)
    return hashed < F.lit(-(1 << 63) + max(1, int((1 << 64) * most / n)))


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary()).to_pylist()


def bounded_blocks(postings: DataFrame, keys: list[str], member: str, limit: int, hint: str | None = None) -> DataFrame:
    """Split the groups of ``postings`` that have over ``limit`` rows, so that no task holds a whole hot group.

    Adds side, lo and hi. A group of n rows has ceil(n / limit) sides, dealt by the hash of ``member``; rows are
    repeated so that for any lo <= hi, the rows with this lo and hi are those of both sides. So any two rows of a
    group meet, in groups of about 2 * limit rows at most. Groups of one row go. ``hint``: how the sizes are joined.
    """
    size = postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    size = size.hint(hint) if hint else size
    sides = F.ceil(F.col("_n") / F.lit(limit)).cast("int")
    return (
        postings.join(size, keys)
        .withColumn("_sides", sides)
        .withColumn("side", F.pmod(F.xxhash64(member), F.col("_sides")).cast("int"))
        .withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_sides") - 1)))
        .withColumn("lo", F.least("side", "_other"))
        .withColumn("hi", F.greatest("side", "_other"))
        .drop("_n", "_sides", "_other")
    )


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Yield each run of rows with equal ``keys`` (not null, integers) of sorted batches, also of runs over several batches."""
    held: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        cuts = [0, *(np.flatnonzero((ids[:, 1:] != ids[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
        for start, stop in zip(cuts, cuts[1:]):
            key = tuple(ids[:, start].tolist())
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, stop - start))
            last = key
    if held:
        yield pa.Table.from_batches(held)
