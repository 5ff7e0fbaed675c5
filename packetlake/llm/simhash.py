"""SimHash near-duplicates by pivot distance tables."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, split_exchange, table
from .components import connected_components

SEED = 42
#: Blocks of a fingerprint's bits, as (shift, width).
BLOCKS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Distances to this many reference fingerprints are kept, nine in each of two longs, seven bits each.
PIVOTS, PER_LONG, BITS = 18, 9, 7
#: Fingerprints of one key that one cell holds on average; larger keys are dealt to several cells.
CELL = 1024


def pivots() -> list[int]:
    """Reference fingerprints from a rule: XXH64 of the numbers from 0."""
    return [xxhash.xxh64_intdigest(str(i), SEED) for i in range(PIVOTS)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingle_hashes(data: bytes, shingle_words: int) -> np.ndarray:
    """XXH64 of each word shingle of UTF-8 text, A-Z lower-cased, repeats included; of all words where they are fewer."""
    words = data.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle_words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[:-1].tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, (ends[shingle_words - 1 :] - 1).tolist(), strict=False)], "<u8")


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half the hashes; zero for none."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):  # bounded for very long texts
        ones += np.unpackbits(hashes[k : k + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprint(data: bytes, shingle_words: int) -> int:
    """SimHash of the word shingles of UTF-8 text; zero without words."""
    return majority(shingle_hashes(data, shingle_words))


def fingerprints(docs: DataFrame, shingle_words: int = 3) -> DataFrame:
    """(doc_id long, fp long) of every whole text of ``docs``; null text is empty, its fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [signed(fingerprint((t or "").encode(), shingle_words)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def block_keys(fp: Column) -> Column:
    """One key for each two of the five blocks: of five blocks at least two agree where at most three bits differ."""
    block = lambda k: F.shiftrightunsigned(fp, BLOCKS[k][0]).bitwiseAND(F.lit((1 << BLOCKS[k][1]) - 1))
    return F.array(*[F.lit(n << 26) + F.shiftleft(block(i), 13) + block(j) for n, (i, j) in enumerate(combinations(range(len(BLOCKS)), 2))])


def pivot_table(distinct: DataFrame) -> DataFrame:
    """Adds the Hamming distances of ``fp`` to all pivots, packed into the longs ``near`` and ``far``."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(p)))).cast("long") for p in pivots()]
    pack = lambda some: sum((F.shiftleft(d, BITS * k) for k, d in enumerate(some)), F.lit(0).cast("long"))
    return distinct.withColumns({"near": pack(distance[:PER_LONG]), "far": pack(distance[PER_LONG:])})


def coordinates(near: np.ndarray, far: np.ndarray) -> np.ndarray:
    shifts = np.arange(PER_LONG, dtype=np.int64) * BITS
    return np.concatenate([(x[:, None] >> shifts) & ((1 << BITS) - 1) for x in (near, far)], axis=1).astype(np.int8)


def groups(fps: np.ndarray, at: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Positions of the fingerprints of each group joined by steps of at most ``max_bits``, if it has two or more.

    Groups are searched breadth-first. No coordinate of two fingerprints of a step differs by more than
    ``max_bits`` (triangle inequality): the others are discarded by their maximum coordinate difference,
    and the survivors' bits are compared.
    """
    out = []
    left, bits = np.arange(len(fps)), fps.view(np.uint64)  # bitwise_count of a signed number counts its absolute value
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        found = list(queue)
        while queue and len(left):
            x = queue.pop()
            close = np.abs(at[left] - at[x]).max(axis=1) <= max_bits
            close[close] = np.bitwise_count(bits[left[close]] ^ bits[x]) <= max_bits
            if close.any():
                met = left[close]
                found += met.tolist()
                queue += met.tolist()
                left = left[~close]
        if len(found) > 1:
            out.append(np.array(found))
    return out


def star(node: np.ndarray, found: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links of each group's nodes to its smallest one."""
    return [node[g] for g in found], [np.full(len(g), node[g].min()) for g in found]


def deal(keyed: DataFrame, parts: Column, *carried: str) -> DataFrame:
    """Rows of (key, node, parts, ...) dealt to cells of their key, sorted by key and cell.

    Nodes of a key with several parts are dealt to that many shards by a hash, and each shard meets each
    other in a cell of their own: every two nodes of a key meet in some cell.
    """
    shard = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    cells = F.when(F.col("parts") == 1, F.array(F.lit(0))).otherwise(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.least(j, F.col("shard")) * F.col("parts") + F.greatest(j, F.col("shard"))))
    dealt = keyed.withColumn("parts", parts.cast("int")).withColumn("shard", shard).withColumn("cell", F.explode(cells))
    return dealt.select("key", "cell", "node", *carried).repartition("key", "cell").sortWithinPartitions("key", "cell")


def links(prints: DataFrame, keys: Column, max_bits: int) -> DataFrame:
    """(a, b) long: links between the nodes of (node, fp) that share one of their ``keys``.

    They join all that are within ``max_bits`` of another under the same key into the right components.
    A key with many nodes is dealt to cells, so that no task holds a whole key. A cell links each group to
    its smallest node: as many links as fingerprints, not as pairs.
    """
    keyed = pivot_table(prints.select("node", "fp", keys.alias("keys"))).select("node", "fp", "near", "far", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select(split_exchange("key"), "size")
    met = deal(keyed.join(sizes, "key"), F.ceil(F.col("size") / F.lit(CELL)), "fp", "near", "far")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "cell", "node", "fp", "near", "far")]
            if rest is not None:
                now = [np.concatenate(x) for x in zip(rest, now, strict=True)]
            if not len(now[0]):
                continue
            breaks = np.flatnonzero((np.diff(now[0]) != 0) | (np.diff(now[1]) != 0)) + 1
            last = int(breaks[-1]) if len(breaks) else 0
            rest = [x[last:] for x in now]
            yield solve([x[:last] for x in now], breaks)
        if rest is not None:
            yield solve(rest, np.array([], np.int64))

    def solve(now: list[np.ndarray], breaks: np.ndarray) -> pa.RecordBatch:
        bounds = [0, *breaks[breaks < len(now[0])].tolist(), len(now[0])]
        at = coordinates(now[4], now[5])
        a, b = [], []
        for i, j in zip(bounds, bounds[1:], strict=False):
            if j - i > 1:
                one, two = star(now[2][i:j], groups(now[3][i:j], at[i:j], max_bits))
                a += one
                b += two
        none = np.array([], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [none])), pa.array(np.concatenate(b or [none]))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def fingerprint_links(distinct: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links that join all fingerprints of ``fp`` within ``max_bits``, 3 at most, into the right components."""
    if max_bits > 3:
        raise ValueError("the block keys are exact for at most 3 differing bits")
    return links(distinct.select(F.col("fp").alias("node"), "fp"), block_keys(F.col("fp")), max_bits)


def near_duplicates(docs: DataFrame, shingle_words: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, fp long, component_id (smallest doc_id reachable by links).

    Documents with equal fingerprints are linked, so all without words (null, empty or white space; the
    fingerprint is zero) form one group with any other of fingerprint zero. Repeated rows each give a
    row. A null doc_id never is a component_id unless its component has no other. Extra columns are
    ignored. No documents, no rows.
    """
    prints = cut(fingerprints(docs, shingle_words))
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    roots = connected_components(fingerprint_links(distinct, max_bits))
    rooted = distinct.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id")).select(split_exchange("root"), "component_id")
    named = rooted.select("fp", "root").join(least, "root").select(split_exchange("fp"), "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, max_bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
