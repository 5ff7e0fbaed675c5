"""What the operators of this subpackage share: tables, checkpoints, Arrow helpers."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, which all executors share.

    Where a session of one machine (a local master, as in tests) names none, it gets one of its own; elsewhere
    that is an error, as no folder of the driver's is one of the executors'.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="packetlake-checkpoint-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a few longs that are broadcast at most; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def broadcast_if_small(df: DataFrame) -> DataFrame:
    """``df``, a checkpointed table of a few longs, marked for broadcast where it has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like ``names`` that no column of ``df`` has, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]


def per_batch(df: DataFrame, make: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``df.mapInArrow`` of a function of one batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := make(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, mod ``modulus``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def split_exchange(key: str) -> Column:
    """``key`` such that a later join on it exchanges this side anew.

    A side that comes out of an aggregate is already partitioned by its key, and adaptive execution
    can split a hot key only where both sides of a join come straight from an exchange.
    """
    return F.col(key).bitwiseXOR(F.lit(0).cast("long")).alias(key)
