"""A session with the settings that the operators assume."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

#: Timestamps are read and compared in UTC; adaptive execution sizes shuffles and splits hot keys at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
#: Bytes of code up to which the JVM compiles a method: longer ones run interpreted, several times as long.
METHOD_LIMIT, LONGEST_METHOD = "spark.sql.codegen.hugeMethodLimit", "8000"


def session(app: str = "packetlake", **settings: str) -> SparkSession:
    """The active session or a new one; ``settings`` by name, with dots as double underscores."""
    builder = SparkSession.builder.appName(app)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a session of one machine gets one where it names none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="packetlake-"))
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, its lineage cut."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a folder of its own in the shared folder and read again: what several readers need is made once.

    Unlike ``cut``, readers read only the columns and row groups that they need. The folder stays until the shared folder is cleared.
    While it is written, code of a stage that is too long for the JIT (``LONGEST_METHOD``) is compiled in parts.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid4().hex}"
    before = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, LONGEST_METHOD)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(METHOD_LIMIT, before)
    return spark.read.schema(df.schema).parquet(path)
