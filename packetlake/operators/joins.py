"""Interval joins as equi-joins on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A bucket of a level is so many times as wide as one of the level below; an interval is no longer than one of its level.
WIDER, LEVELS = 8, 12
#: Pairs that one shard of a bucket compares on average; buckets with more are split.
PAIRS = 1 << 22
SHARDS = 4096


def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def interval_join(left: DataFrame, right: DataFrame, pad_seconds: float = 0.0, bucket_seconds: int = 60, keys: list[str] | None = None, left_prefix: str = "l_", right_prefix: str = "r_", pairs: int = PAIRS) -> DataFrame:
    """Pairs of rows whose [start_time, end_time] come within ``pad_seconds`` of each other, on equal ``keys``.

    A bare inequality would compare every pair. Instead each row goes to the buckets that its interval
    covers, rows meet by bucket, the exact test follows, and a pair counts in its first common bucket
    only. Intervals of any length are exact: those longer than a bucket go up to a level where a
    bucket is as long, 8 times as wide as the level below, and each side visits all levels that either side
    uses. So a row stands in a few buckets at most, whatever its length, and is shuffled so many times.

    A bucket in which more than ``pairs`` pairs would be compared is split: its left rows are dealt to
    shards by a hash, its right rows are copied to each. Rows of both sides are counted by bucket for that,
    before anything is joined, so that a minute with a third of all rows spreads over many tasks. Buckets
    to be split are few (each has the square root of ``pairs`` rows at least), so they are broadcast.

    Columns get prefixes. Rows with a null time match none.
    """
    keys = keys or []
    pad = int(pad_seconds * 1e6 / 2)
    width = bucket_seconds * 1_000_000

    def spans(df: DataFrame, prefix: str) -> DataFrame:
        named = [F.col(c).alias(f"{prefix}{c}") for c in df.columns]
        out = df.where("start_time is not null and end_time is not null").select(*named, _micros(F.col("start_time")).alias(f"{prefix}_a"), _micros(F.col("end_time")).alias(f"{prefix}_b"))
        size = F.greatest(F.lit(0), F.col(f"{prefix}_b") - F.col(f"{prefix}_a")) / width
        level = F.ceil(F.log(float(WIDER), F.greatest(size, F.lit(1e-9))))
        return out.withColumn(f"{prefix}_level", F.least(F.lit(LEVELS), F.greatest(F.lit(0), level)).cast("int"))

    a, b = spans(left, left_prefix), spans(right, right_prefix)
    levels = F.broadcast(a.select(F.col(f"{left_prefix}_level").alias("_level")).union(b.select(F.col(f"{right_prefix}_level"))).distinct())  # 13 rows at most

    def buckets(df: DataFrame, prefix: str) -> DataFrame:
        # A row stands at its own level and is looked up at the wider ones; what is longer stands at a wider one.
        own = df.join(levels, F.col("_level") >= F.col(f"{prefix}_level"))
        size = F.lit(width) * F.pow(F.lit(WIDER), F.col("_level")).cast("long")
        at = lambda t: F.floor(t / size).cast("long")
        first = at(F.col(f"{prefix}_a") - pad)
        last = at(F.greatest(F.col(f"{prefix}_a"), F.col(f"{prefix}_b")) + pad)
        out = own.withColumns({f"{prefix}_first": first, "_bucket": F.explode(F.sequence(first, last))})
        return out.withColumns({f"_k{i}": F.col(f"{prefix}{k}") for i, k in enumerate(keys)})

    cell = ["_level", "_bucket", *[f"_k{i}" for i in range(len(keys))]]
    x, y = buckets(a, left_prefix), buckets(b, right_prefix)
    counted = x.groupBy(*cell).agg(F.count("*").alias("_n")).join(y.groupBy(*cell).agg(F.count("*").alias("_m")), cell)
    shards = F.least(F.lit(SHARDS).cast("double"), F.col("_n").cast("double"), F.ceil(F.col("_n").cast("double") * F.col("_m") / pairs)).cast("int")
    hot = counted.where(F.col("_n").cast("double") * F.col("_m") > pairs).select(*cell, shards.alias("_shards"))
    n = F.coalesce("_shards", F.lit(1))
    hot = F.broadcast(hot)
    x = x.join(hot, cell, "left").withColumn("_shard", F.pmod(F.xxhash64(*[f"{left_prefix}{c}" for c in left.columns if not dict(left.dtypes)[c].startswith("map")]), n).cast("int")).drop("_shards")
    y = y.join(hot, cell, "left").withColumn("_shard", F.explode(F.sequence(F.lit(0), n - 1))).drop("_shards")
    exact = (F.col(f"{left_prefix}_a") - pad < F.col(f"{right_prefix}_b") + pad) & (F.col(f"{right_prefix}_a") - pad < F.col(f"{left_prefix}_b") + pad)
    once = (F.col("_bucket") == F.greatest(f"{left_prefix}_first", f"{right_prefix}_first")) & (F.col("_level") == F.greatest(f"{left_prefix}_level", f"{right_prefix}_level"))
    met = x.join(y, [*cell, "_shard"]).where(exact & once)
    return met.select(*[f"{left_prefix}{c}" for c in left.columns], *[f"{right_prefix}{c}" for c in right.columns])
