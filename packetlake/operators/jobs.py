"""Processing of jobs: decode, detect, correlate, and replace a job's tables as one.

Each run writes its tables to a folder of its own. Which run holds for which job is told by manifests,
numbered files that are put in place by a rename: readers see all tables of the run before or all of the run after, and a
run that fails, at whatever point, leaves the ones before it as they were.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import stored
from . import correlate, decoders, detect

#: What a job's tables are made of: flows of its packets, and what flows tell.
TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "flows": lambda flows: flows,
    "alerts": lambda flows: detect.run(flows, list(detect.RULES)),
    "calls": correlate.calls_from_flows,
    "profiles": correlate.subscribers,
    "sessions": correlate.sessions,
    "cross_sessions": correlate.cross_sessions,
}


def _files(spark: SparkSession, path: str):
    """The file system of a path, and the class of its paths."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark._jsc.hadoopConfiguration()), make


def manifest(spark: SparkSession, path: str) -> tuple[int, dict[str, dict]]:
    """(number, {job: run}) of the last manifest under ``path``; (0, {}) where there is none."""
    fs, make = _files(spark, path)
    folder = make(f"{path}/manifests")
    if not fs.exists(folder):
        return 0, {}
    numbers = [int(n) for f in fs.listStatus(folder) if (n := f.getPath().getName().removesuffix(".json")).isdigit()]
    if not numbers:
        return 0, {}
    text = spark.read.text(f"{path}/manifests/{max(numbers)}.json", wholetext=True).first()[0]
    return max(numbers), json.loads(text)


def _commit(spark: SparkSession, path: str, runs: dict[str, dict | None]) -> None:
    """Puts the next manifest in place. Where another one was quicker, its changes are taken in and the next number is tried."""
    fs, make = _files(spark, path)
    while True:
        number, known = manifest(spark, path)
        merged = {k: v for k, v in (known | runs).items() if v is not None}
        draft = make(f"{path}/manifests/_{uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(merged).encode()))
        out.close()
        target = make(f"{path}/manifests/{number + 1}.json")
        if not fs.exists(target) and fs.rename(draft, target):
            return
        fs.delete(draft, False)


def process(packets: DataFrame, path: str, tables: dict[str, Callable[[DataFrame], DataFrame]] | None = None, names: list[str] | None = None) -> str:
    """Decodes, judges and correlates the jobs of ``packets`` and replaces those jobs' tables under ``path``; the run's name.

    Rows go to folders of the run by table and job; rules, which look at all flows together, run for each job. Doing the same again, also after
    a failure, gives the same tables under another run. Jobs without packets keep what they have.
    """
    spark = packets.sparkSession
    run = f"run-{datetime.now(UTC):%Y%m%dT%H%M%S}-{uuid4().hex[:8]}"
    jobs = sorted(r.job_id for r in packets.select("job_id").distinct().collect())
    flows = stored(decoders.decode(packets, names))
    for name, make in (tables or TABLES).items():
        for job in jobs:
            rows = make(flows.where(F.col("job_id") == job)).drop("job_id")
            rows.write.mode("overwrite").parquet(f"{path}/runs/{run}/{name}/job_id={job}")
    _commit(spark, path, {str(j): {"run": run, "tables": sorted(tables or TABLES)} for j in jobs})
    return run


def current(spark: SparkSession, path: str, table: str) -> DataFrame:
    """The rows of a table of all jobs, each as of its last whole run."""
    _, runs = manifest(spark, path)
    folders = [f"{path}/runs/{r['run']}/{table}/job_id={job}" for job, r in sorted(runs.items()) if table in r["tables"]]
    if not folders:
        raise ValueError(f"no job has a table {table}")
    rows = spark.read.option("recursiveFileLookup", "true").parquet(*folders)
    return rows.withColumn("job_id", F.regexp_extract("_metadata.file_path", r"/job_id=(-?\d+)/", 1).cast("long"))


def delete(spark: SparkSession, path: str, *jobs: int) -> None:
    """Takes jobs out of the manifest; their files go with ``clean``."""
    _commit(spark, path, {str(j): None for j in jobs})


def clean(spark: SparkSession, path: str) -> list[str]:
    """Deletes the runs that no job of the last manifest names, such as those that failed; not while a run is being written."""
    _, runs = manifest(spark, path)
    held = {r["run"] for r in runs.values()}
    fs, make = _files(spark, path)
    folder = make(f"{path}/runs")
    gone = [] if not fs.exists(folder) else [f.getPath().getName() for f in fs.listStatus(folder) if f.getPath().getName() not in held]
    for name in gone:
        fs.delete(make(f"{path}/runs/{name}"), True)
    return sorted(gone)
