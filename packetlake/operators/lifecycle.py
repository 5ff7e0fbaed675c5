"""Changes to stored tables: insert-or-ignore, upsert, deletion by job, reprocessing.

Tables are folders of Parquet partitioned by job_id, so that what concerns a job touches that job's folder
only. The relational part of each change is a DataFrame function; ``replace_jobs`` writes its result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def new_rows(stored: DataFrame, incoming: DataFrame, *keys: str) -> DataFrame:
    """What an insert that ignores known keys adds: one row for each key that is not stored. A null key never is known."""
    return incoming.dropDuplicates(list(keys)).join(stored.select(*keys), list(keys), "left_anti")


def upserted(stored: DataFrame, incoming: DataFrame, *keys: str, order: str) -> DataFrame:
    """The table after an upsert: of each key the incoming row with the greatest ``order``, else the stored rows.

    Keys of the incoming rows are met in a shuffle by key; stored rows without an incoming one stay as they are.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))
    last = incoming.withColumn("_rank", rank).where("_rank = 1").drop("_rank")
    return stored.join(last.select(*keys), list(keys), "left_anti").unionByName(last)


def without_jobs(stored: DataFrame, *jobs: int) -> DataFrame:
    """The table without the jobs' rows; rows of no job stay."""
    return stored.where(~F.coalesce(F.col("job_id").isin(*jobs), F.lit(False)))


def replace_jobs(rows: DataFrame, path: str) -> None:
    """Writes ``rows`` in place of those jobs' folders; other jobs' folders stay."""
    rows.repartition("job_id", F.pmod(F.xxhash64(*rows.columns), F.lit(16))).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("job_id").parquet(path)


def job_states(changes: DataFrame, now: str, stale: str = "1 hour") -> DataFrame:
    """(job_id, status, changed_at): each job's last status; one that has been running for longer than ``stale`` has failed."""
    last = changes.groupBy("job_id").agg(F.max_by("status", "changed_at").alias("status"), F.max("changed_at").alias("changed_at"))
    old = F.col("changed_at").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {stale}")
    return last.withColumn("status", F.when((F.col("status") == "running") & old, "failed").otherwise(F.col("status")))
