"""Mixing sources to target weights by Poisson replication and a global shuffle."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Rates beyond this are the sum of several equal draws, so that exp(-rate) stays a normal number.
MOST_AT_ONCE = 256
#: The table of rates is broadcast where it has at most this many sources.
MOST_BROADCAST = 10_000


def hashed(*parts: Column) -> Column:
    """52 bits of the MD5 of the parts, joined by colons, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long")


def identity(doc_id: Column, text: Column) -> Column:
    """What a document's draws hash: its id, or the MD5 of its text where that is null."""
    return F.coalesce(doc_id.cast("string"), F.md5(F.coalesce(text, F.lit(""))))


def poisson_cdf(rate: Column) -> Column:
    """The distribution function at 0, 1, 2, ... as far as its tail is beyond a double's precision."""
    end = F.ceil(rate + 12 * F.sqrt(rate) + 20).cast("int")
    first = F.exp(-rate)
    grown = F.aggregate(
        F.sequence(F.lit(1), end),
        F.struct(first.alias("p"), first.alias("sum"), F.array(first).alias("cdf")),
        lambda a, j: F.struct((a["p"] * rate / j).alias("p"), (a["sum"] + a["p"] * rate / j).alias("sum"), F.concat(a["cdf"], F.array(a["sum"] + a["p"] * rate / j)).alias("cdf")),
    )
    return grown["cdf"]


def source_rates(docs: DataFrame, targets: Mapping[str, float] | None = None, exponent: float = 0.7, epochs: float = 1.0) -> DataFrame:
    """(source, n, rate): a row per source, null included, and its mean number of copies of a document.

    A source's weight is ``targets[source]``, or else its number of documents to the power ``exponent``,
    both as shares of their own sum: the listed ones get their share of 1 (or all where all are listed),
    the others share the rest. The rates make ``epochs`` times the number of documents in the mean.
    """
    sizes = cut(docs.groupBy("source").agg(F.count("*").alias("n")))
    weight = F.pow(F.col("n").cast("double"), F.lit(float(exponent)))
    listed = F.lit(None).cast("double")
    if targets:
        if min(targets.values()) < 0:
            raise ValueError("a target weight is negative")
        listed = F.create_map(*[F.lit(x) for kv in targets.items() for x in (kv[0], float(kv[1]))])[F.col("source")]
    weighed = sizes.select("source", "n", listed.alias("listed"), weight.alias("free"))
    sums = weighed.agg(F.sum("n").alias("n"), F.sum("listed").alias("listed"), F.sum(F.when(F.col("listed").isNull(), F.col("free"))).alias("free")).first()
    total, given, free = sums["n"] or 0, sums["listed"] or 0.0, sums["free"] or 0.0
    rest = max(0.0, 1.0 - given) if free else 0.0
    share = F.when(F.col("listed").isNotNull(), F.col("listed") / F.lit(given + rest or 1.0)).otherwise(F.col("free") / F.lit(free or 1.0) * F.lit(rest / (given + rest) if given + rest else 0.0))
    return weighed.select("source", "n", (share * F.lit(float(epochs) * total) / F.col("n")).alias("rate"))


def mix(docs: DataFrame, targets: Mapping[str, float] | None = None, exponent: float = 0.7, epochs: float = 1.0, seed: int = 0, copy: str = "copy", order: str = "shuffle_key") -> DataFrame:
    """All columns of ``docs``, each row as often as its draw says, in a random order over all files.

    A document's draw inverts the Poisson distribution of its source's rate at a hash of the seed and its
    id (of its text where the id is null): the same at every run and partitioning. ``copy`` numbers its
    copies from 1; rows are sorted by ``order``, a hash of seed, id and copy. Equal ids draw alike, so
    repeated rows are copied alike. Null text stays null; a null source is a source of its own; columns
    that clash with ``copy`` or ``order`` keep their names and ours get an underscore before. No
    documents, no rows.
    """
    copy, order, rate, cdf, key = fresh(docs, copy, order, "_rate", "_cdf", "_key")
    rates = cut(source_rates(docs, targets, exponent, epochs).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / MOST_AT_ONCE)).cast("int")).select(F.col("source").alias(rate), "parts", poisson_cdf(F.col("rate") / F.col("parts")).alias(cdf)).withColumnRenamed("parts", key))
    few = rates.count() <= MOST_BROADCAST
    joined = docs.join(F.broadcast(rates) if few else rates, docs["source"].eqNullSafe(rates[rate]))
    parts, name = F.col(key), identity(F.col("doc_id"), F.col("text"))
    draws = F.transform(F.sequence(F.lit(1), parts), lambda k: hashed(F.lit(str(seed)), name, k.cast("string")) / F.lit(float(1 << 52)))
    copies = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col(cdf), lambda c: c <= u)))
    # A generator isn't run for an empty array: documents with no copy go here.
    out = joined.withColumn(key, copies).where(F.col(key) > 0).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(key)))).withColumn(order, hashed(F.lit(f"{seed}-order"), name, F.col(copy).cast("string")))
    sort = [order, "doc_id", copy]
    return out.select(*docs.columns, copy, order).repartitionByRange(*sort).sortWithinPartitions(*sort)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = """
WITH sizes AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
rates AS (
  SELECT source, pow(CAST(n AS DOUBLE), 0.7) / (SELECT sum(pow(CAST(n AS DOUBLE), 0.7)) FROM sizes) * (SELECT sum(n) FROM sizes) / n AS rate
  FROM sizes),
cdf AS (
  SELECT source, j, sum(exp(-rate + j * ln(rate) - lgamma(j + 1))) OVER (PARTITION BY source ORDER BY j) AS c
  FROM rates, (SELECT unnest(generate_series(0, 60)) AS j)),
draws AS (
  SELECT *, CAST('0x' || substr(md5('0:' || doc_id || ':1'), 1, 13) AS BIGINT) / 4503599627370496.0 AS u FROM documents),
copies AS (
  SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, (SELECT count(*) FROM cdf WHERE cdf.source = d.source AND c <= u) AS k FROM draws d),
each AS (SELECT *, unnest(generate_series(1, k)) AS copy FROM copies WHERE k > 0)
SELECT doc_id, text, lang, source, n_chars, CAST(copy AS INTEGER) AS copy,
  CAST('0x' || substr(md5('0-order:' || doc_id || ':' || copy), 1, 13) AS BIGINT) AS shuffle_key
FROM each
"""
