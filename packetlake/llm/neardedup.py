"""Near-duplicate documents by SimHash and pivot distance tables, MinHash bands for the rest, and the shingles they share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, split_exchange
from .components import connected_components
from .linededup import document_keys
from .simhash import SEED, block_keys, deal, links, majority, shingle_hashes, signed, star

#: Shingles of five words; texts that share 0.8 of theirs are near copies.
SHINGLE_WORDS, SIMILARITY = 5, 0.8
#: Candidates differ in at most this many bits of their SimHash: the block keys find all such pairs.
MAX_BITS = 3
#: Or they share one of BANDS keys of ROWS minima: at 0.8 all but one pair in 5,000 do.
BANDS, ROWS = 16, 4
#: Documents and shingles that one cell of a group holds on average.
CELL_DOCUMENTS, CELL_SHINGLES = 512, 1 << 20
_MULTIPLIERS = np.array([xxhash.xxh64_intdigest(f"minimum {i}", SEED) | 1 for i in range(BANDS * ROWS)], np.uint64)


def band_keys(hashes: np.ndarray) -> list[int]:
    """A key for each band of minima of the hashes under multiplication."""
    least = np.full(BANDS * ROWS, np.uint64(2**64 - 1))
    for k in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[k : k + 4096, None] * _MULTIPLIERS).min(axis=0))
    return [signed(xxhash.xxh64_intdigest(least[k : k + ROWS].tobytes(), k)) for k in range(0, len(least), ROWS)]


def sketches(docs: DataFrame, shingle_words: int) -> DataFrame:
    """(k1, k2, node, fp, keys, shingles): per document a hash of its words, the SimHash of its set of shingles, its band keys and the set's size.

    Of a set, so that a phrase repeated in one of two copies doesn't part their fingerprints.
    """
    k1, k2 = document_keys(F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, fps, keys, sizes = [], [], [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode()
                hashes = np.unique(shingle_hashes(data, shingle_words))
                nodes.append(signed(xxhash.xxh64_intdigest(b" ".join(data.lower().split()), SEED)))
                fps.append(signed(majority(hashes)))
                keys.append(band_keys(hashes))
                sizes.append(len(hashes))
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(nodes, pa.int64()), pa.array(fps, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], ["k1", "k2", "node", "fp", "keys", "shingles"])

    return docs.select(k1.alias("k1"), k2.alias("k2"), F.col("text").cast("string").alias("text")).mapInArrow(run, "k1 long, k2 long, node long, fp long, keys array<long>, shingles long")


def fingerprint_links(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of nodes of (node, fp): ((node, fp, first) with the smallest node of each fingerprint, (a, b) links of these within MAX_BITS).

    Fingerprints under one block key are discarded by the largest difference of their distances to the pivots,
    and the survivors' bits are compared.
    """
    first = nodes.groupBy("fp").agg(F.min("node").alias("first"))
    return nodes.select("node", "fp").join(first.select(split_exchange("fp"), "first"), "fp"), links(first.select(F.col("first").alias("node"), "fp"), block_keys(F.col("fp")), MAX_BITS)


def band_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links of the nodes of (node, keys) to the smallest node of each key that they share with another.

    Rows of one node may be several, of the keys of all that it stands for.
    """
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    ends = keyed.groupBy("key").agg(F.min("node").alias("b"), F.max("node").alias("most")).where("b < most")
    return keyed.join(ends.select(split_exchange("key"), "b"), "key").select(F.col("node").alias("a"), "b").where("a != b")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """(a, b): links that join the nodes of (node, fp, keys) whose fingerprints are within MAX_BITS, or that share a band.

    Bands are the way for what the fingerprints leave apart: a node hangs on the smallest one that its fingerprint
    links it to, and only bands of several of these link anything.
    """
    of, close = fingerprint_links(nodes.select("node", "fp"))
    of, close = cut(of), cut(close.where("a != b").distinct())
    least = close.groupBy("a").agg(F.min("b").alias("b"))
    stands = of.join(least.select(split_exchange("a"), "b").withColumnRenamed("a", "first"), "first", "left").select("node", F.coalesce("b", "first").alias("stand"))
    bands = band_links(nodes.select("node", "keys").join(stands.select(split_exchange("node"), "stand"), "node").select(F.col("stand").alias("node"), "keys"))
    return of.where("node != first").select(F.col("node").alias("a"), F.col("first").alias("b")).unionByName(close).unionByName(bands)


def alike(sets: list[np.ndarray], similarity: float) -> list[np.ndarray]:
    """Positions of the sets of each group joined by steps of at least ``similarity``, if it has two or more.

    From each set reached, those not reached yet whose size rules it out are discarded; what the rest
    share is counted from the places of each shingle.
    """
    sizes = np.array([len(x) for x in sets])
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    out = []
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        found = list(queue)
        while queue and len(left):
            x = queue.pop()
            near = left[np.minimum(sizes[left], sizes[x]) >= similarity * np.maximum(sizes[left], sizes[x]) - 1e-9]
            if not len(near):
                continue
            lo, hi = np.searchsorted(every, sets[x], "left"), np.searchsorted(every, sets[x], "right")
            n = hi - lo
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
            shared = np.bincount(owner[places], minlength=len(sets))[near]
            met = near[shared >= similarity * (sizes[near] + sizes[x] - shared) - 1e-9]
            if len(met):
                found += met.tolist()
                queue += met.tolist()
                left = np.setdiff1d(left, met, assume_unique=True)
        if len(found) > 1:
            out.append(np.array(found))
    return out


def verified_links(docs: DataFrame, members: DataFrame, shingle_words: int, similarity: float) -> DataFrame:
    """(a, b): links between nodes of (k1, k2, node, key) of one key whose texts are alike.

    Every node's text is read once. A key, a group of candidates, is dealt to cells by the documents and
    shingles it has, and a cell links each group to its smallest node.
    """
    k1, k2 = document_keys(F.col("doc_id"), F.col("text"))
    sized = members.join(docs.select(k1.alias("k1"), k2.alias("k2"), F.coalesce("text", F.lit("")).cast("string").alias("text")).dropDuplicates(["k1", "k2"]), ["k1", "k2"])
    sums = members.groupBy("key").agg(F.count("*").alias("documents"), F.sum("shingles").alias("shingles")).select(split_exchange("key"), "documents", "shingles")
    parts = F.greatest(F.ceil(F.col("documents") / CELL_DOCUMENTS), F.ceil(F.col("shingles") / CELL_SHINGLES))
    met = deal(sized.select("key", "node", "text").join(sums, "key"), parts, "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "cell", "node", "text")), strict=True):
                if row[:2] != cell:
                    if len(rows) > 1:
                        yield solve(rows)
                    cell, rows = row[:2], []
                rows.append((row[2], np.unique(shingle_hashes(row[3].encode(), shingle_words))))
        if len(rows) > 1:
            yield solve(rows)

    def solve(rows: list[tuple]) -> pa.RecordBatch:
        node = np.array([r[0] for r in rows], np.int64)
        none = np.array([], np.int64)
        a, b = star(node, alike([r[1] for r in rows], similarity))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], ["a", "b"])

    return met.mapInArrow(run, "a long, b long")


def near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """(k1, k2, w1, w2): the key of every document and that of the document that stands for its group."""
    prints = cut(sketches(docs, shingle_words))
    # Texts of the same words are one node.
    nodes = prints.groupBy("node").agg(F.min(F.struct("k1", "k2")).alias("k"), F.first("fp").alias("fp"), F.first("keys").alias("keys"), F.first("shingles").alias("shingles"))
    groups = connected_components(candidate_links(nodes))
    member = groups.select("node", F.col("root").alias("key")).join(nodes.select(split_exchange("node"), "k", "shingles"), "node").select("k.k1", "k.k2", "node", "key", "shingles")
    members = cut(member)
    roots = connected_components(verified_links(docs, members, shingle_words, similarity))
    of = prints.select("k1", "k2", "node").join(roots.select("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    winners = of.groupBy("root").agg(F.min(F.struct("k1", "k2")).alias("w")).select(split_exchange("root"), "w.k1", "w.k2")
    return of.join(winners.toDF("root", "w1", "w2"), "root").select("k1", "k2", "w1", "w2")


def dedup_near_copies(docs: DataFrame, shingle_words: int = SHINGLE_WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs``, all their columns, of which one stays of each group of near copies.

    Documents are alike whose sets of word shingles (A-Z lower-cased) have a Jaccard similarity of at
    least ``similarity``; a group is what is joined by such steps, and its document of the smallest id
    stays (null ids last, then by a hash of the text). Candidates are within MAX_BITS of each other's SimHash, told by
    the pivot distance tables, or share a band of minima, or are joined by such steps: to
    compare all documents would take the square of their number. Each is verified against the
    shingles themselves, so that documents that are not alike stay. Texts of the same words are copies,
    also those of fewer words than a shingle, and all without words (null, empty). Of repeated rows one
    stays. No documents, no rows.
    """
    a, b, n = fresh(docs, "_k1", "_k2", "_n")
    stay = near_copies(docs, shingle_words, similarity).where("k1 = w1 and k2 = w2").select(F.col("k1").alias(a), F.col("k2").alias(b)).distinct()
    k1, k2 = document_keys(docs["doc_id"], docs["text"])
    kept = docs.withColumns({a: k1, b: k2}).join(stay, [a, b], "left_semi")
    return kept.withColumn(n, F.row_number().over(Window.partitionBy(a, b).orderBy(F.lit(1)))).where(F.col(n) == 1).select(*docs.columns)
