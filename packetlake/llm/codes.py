"""Vector code compression: weighted Lloyd over the distinct parts of vectors."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, table
from .vectors import matrix, padded, whole, widest

PARTS, ENTRIES, ROUNDS = 16, 64, 2


def nearest(values: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry, the lower index of equally near ones. All sums are whole numbers, so exact."""
    distance = (values**2).sum(axis=1)[:, None] - 2 * values @ book.T + (book**2).sum(axis=1)
    at = distance.argmin(axis=1)
    return at, distance[np.arange(len(at)), at].astype(np.int64)


def _by_position(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(position, rows, values) of the rows of a batch of (position, part, ...)."""
    positions, values = batch.column("position").to_numpy(), matrix(batch.column("part"), width)
    for p in np.unique(positions).tolist():
        rows = np.flatnonzero(positions == p)
        yield p, rows, values[rows]


def first_entries(vectors: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """(part, entry, component): the parts of the vectors of the smallest ids, null last; equal ids by their components."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).select("v").collect()
    return np.array([r.v for r in rows], np.float64).reshape(len(rows), parts, width).transpose(1, 0, 2)


def improved(distinct: DataFrame, books: np.ndarray) -> np.ndarray:
    """One round: each entry becomes the mean of the parts nearest to it, rounded down; unused ones stay.

    ``distinct`` are (position, part, n). Each task adds up the weighted components of its rows and gives one
    row for each entry; what reaches the driver is as long as the codebooks.
    """
    parts, entries, width = books.shape
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            for p, rows, values in _by_position(batch, width):
                at, _ = nearest(values, shared.value[p])
                np.add.at(sums[p], at, values.astype(np.int64) * n[rows, None])
                np.add.at(counts[p], at, n[rows])
        p, e = np.nonzero(counts)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))], ["p", "e", "n", "sums"])

    told = distinct.mapInArrow(run, "p long, e long, n long, sums array<long>")
    total = told.groupBy("p", "e").agg(F.sum("n").alias("n"), *[F.sum(F.get("sums", i)).alias(f"s{i}") for i in range(width)]).collect()
    out = books.copy()
    for r in total:
        out[r.p, r.e] = [r[f"s{i}"] // r.n for i in range(width)]
    return out


def assigned(distinct: DataFrame, books: np.ndarray) -> DataFrame:
    """(position, part, entry int, distance long) of (position, part)."""
    width = books.shape[2]
    shared = distinct.sparkSession.sparkContext.broadcast(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            entry, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
            for p, rows, values in _by_position(batch, width):
                entry[rows], distance[rows] = nearest(values, shared.value[p])
            yield pa.RecordBatch.from_arrays([batch.column("position"), batch.column("part"), pa.array(entry), pa.array(distance)], ["position", "part", "entry", "distance"])

    return distinct.select("position", "part").mapInArrow(run, "position int, part array<int>, entry int, distance long")


def compress(embeddings: DataFrame, vector: str = "embedding", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = 256) -> tuple[DataFrame, np.ndarray]:
    """(the kept rows of ``embeddings`` with ``codes`` array<int> and ``error`` long, the codebooks (part, entry, component)).

    Components become floor(scale * x). Vectors are cut into ``parts`` equal parts (zeros are put behind
    those that are shorter than the longest, or that don't divide), and each position has a codebook of at most
    256 entries that starts as the parts of the vectors of the smallest ids. Equal parts of a position
    are one distinct row with a weight; the rounds run over those, and the codes and squared distances
    are joined back to the vectors. Only codebooks reach the driver.

    Rows whose vector is null or holds a null or non-finite component are dropped; repeated rows each stay; a
    null id is the largest. Fewer rows than entries make smaller codebooks. Columns called like ours get ours
    with an underscore before. No rows, no result and codebooks without entries.
    """
    codes, error, v, row = fresh(embeddings, "codes", "error", "_v", "_row")
    kept = embeddings.withColumn(v, whole(F.col(vector), scale)).where(F.col(v).isNotNull())
    # Row numbers are of no order, but must not change when a lost task is run again: they are written.
    kept = cut(kept.withColumn(row, F.monotonically_increasing_id()))
    n, widest_row = widest(kept, v)
    width = -(-widest_row // parts)
    vectors = kept.select(F.col("vec_id"), padded(F.col(v), width * parts).alias("v"), F.col(row).alias("row"))
    placed = vectors.select("row", F.posexplode(F.array(*[F.slice("v", i * width + 1, width) for i in range(parts)])).alias("position", "part"))
    distinct = cut(placed.groupBy("position", "part").agg(F.count("*").alias("n")))
    books = first_entries(vectors, parts, entries, width)
    if not n:
        return kept.select(*embeddings.columns, F.array().cast("array<int>").alias(codes), F.lit(0).cast("long").alias(error)), books
    for _ in range(rounds):
        books = improved(distinct, books)
    found = placed.join(assigned(distinct, books), ["position", "part"])
    whole_codes = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("position", "entry")))["entry"].alias("codes"), F.sum("distance").alias("error"))
    out = kept.join(whole_codes.select(F.col("row").alias(row), F.col("codes").alias(codes), F.col("error").alias(error)), row)
    return out.select(*embeddings.columns, codes, error), books


def restored(coded: DataFrame, books: np.ndarray, codes: str = "codes", vector: str = "restored", scale: int = 256) -> DataFrame:
    """Adds the vectors that the codes stand for, as array<double>; they hold the padding too."""
    entries = F.array(*[F.array(*[F.array(*[F.lit(int(x)) for x in entry]) for entry in book]) for book in books])
    parts = F.transform(codes, lambda e, i: F.get(F.get(entries, i), e))
    return coded.withColumn(vector, F.transform(F.flatten(parts), lambda x: x / F.lit(float(scale))))


def with_label_error(coded: DataFrame, label: str = "label", error: str = "error", into: str = "label_error") -> DataFrame:
    """Adds the error summed over equal labels, nulls together. Sums are made before the shuffle; a hot label is only one sum."""
    unknown = F.col(label).isNull()
    sums = cut(coded.groupBy(unknown.alias("_none"), F.coalesce(F.col(label), F.lit(0)).alias("_label")).agg(F.sum(error).alias(into)))
    keyed = coded.withColumns({"_none": unknown, "_label": F.coalesce(F.col(label), F.lit(0))})
    return keyed.join(broadcast_if_small(sums), ["_none", "_label"]).drop("_none", "_label")


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = compress(table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding"))
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    code = F.array_join(F.transform("codes", lambda x: F.lpad(F.lower(F.hex(x)), 2, "0")), "")
    narrow = cut(coded.select("vec_id", "label", code.alias("code"), "error"))
    return with_label_error(narrow).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _oracle(rounds: int = ROUNDS) -> str:
    """The same in SQL: one step for each round, over distinct parts as well."""
    steps = """
kept as (
  select row_number() over () as r, vec_id, label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), placed as (
  select r, vec_id, p, v[p * (len(v) // 16) + 1 : (p + 1) * (len(v) // 16)] as part from kept, range(16) t(p)
), parts as (
  select p, part, count(*) as n from placed group by p, part
), book0 as (
  select p, row_number() over (partition by p order by vec_id) - 1 as e, part as entry from placed
  where r in (select r from kept order by vec_id limit 64)
)"""
    for k in range(rounds + 1):
        steps += f""", near{k} as (
  select p, part, any_value(n) as n, min((list_inner_product(part, part) - 2 * list_inner_product(part, entry) + list_inner_product(entry, entry))::bigint * 64 + e) as found
  from parts join book{k} using (p) group by p, part
)"""
        if k < rounds:
            steps += f""", mean{k} as (
  select p, e, i, floor(sum(n * x) / sum(n)) as x
  from (select p, found % 64 as e, n, unnest(part) as x, unnest(range(len(part))) as i from near{k}) group by p, e, i
), book{k + 1} as (
  select p, e, coalesce(m.entry, b.entry) as entry from book{k} b left join (select p, e, list(x order by i) as entry from mean{k} group by p, e) m using (p, e)
)"""
    return f"""with {steps}, coded as (
  select r, vec_id, string_agg(printf('%02x', found % 64), '' order by p) as code, sum(found // 64)::bigint as error
  from placed join near{rounds} using (p, part) group by r, vec_id
), digest as (
  select sha256(string_agg(x::bigint::varchar, ',' order by p, e, i)) as codebooks_sha256 from (select p, e, unnest(entry) as x, unnest(range(len(entry))) as i from book{rounds})
)
select coded.vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error, codebooks_sha256 from coded join kept using (r), digest
"""


ORACLE = _oracle()
