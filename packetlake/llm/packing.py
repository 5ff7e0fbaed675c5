"""Packing token pieces into sequences: shortest pack first over the histogram of lengths."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LONGEST, END = 1024, 0
#: The added token of ``byte_bpe_50k.json``, its last id.
END_MARK = "<|endoftext|>"
#: Parts of a length that are numbered apart, so that no task holds all pieces of a common length.
SALTS = 1024


def encoder(path: str | None = None) -> tiktoken.Encoding:
    """The byte-level BPE of 50k ids, from its rank file.

    The ids are those of ``byte_bpe_50k.json`` without added special tokens (a test compares them); the rank
    file is the same vocabulary and several times faster to apply. The literal end mark in a text is one
    id, as in that file, where the text is encoded with ``allowed_special="all"``.
    """
    import public_tokenizers

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={END_MARK: len(ranks)})


def pieces(docs: DataFrame, longest: int = LONGEST, path: str | None = None) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens): each document's ids and a last 0, cut every ``longest`` ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder(path).encode, allowed_special="all")
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
        for batch in batches:
            columns: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), END], "<u4")
                for start in range(0, len(ids), longest):
                    part = ids[start : start + longest]
                    for c, x in zip(columns, (doc_id, start, len(part), zlib.crc32(part), len(ids)), strict=True):
                        c.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def shortest_pack_first(histogram: dict[int, int], longest: int = LONGEST) -> list[tuple[int, tuple[int, ...]]]:
    """[(count, lengths)]: packing patterns that hold all lengths of the histogram.

    Lengths are placed longest first. All packs of one pattern are one entry; a length goes to the
    pattern with the most room left, as many at a time as that has packs, and splits it.
    """
    by_room: dict[int, dict[tuple[int, ...], int]] = {}
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            room = max((r for r in by_room if r >= length), default=None)
            if room is None:  # new packs, each filled with this length: one by one, the next would go to the last pack opened
                each = longest // length
                grown = [((length,) * each, left // each), ((length,) * (left % each), 1 if left % each else 0)]
                left = 0
            else:
                pattern = next(iter(by_room[room]))
                packs = by_room[room].pop(pattern)
                taken = min(packs, left)
                if packs > taken:
                    by_room[room][pattern] = packs - taken
                if not by_room[room]:
                    del by_room[room]
                grown = [((*pattern, length), taken)]
                left -= taken
            for pattern, n in grown:
                if n:
                    same = by_room.setdefault(longest - sum(pattern), {})
                    same[pattern] = same.get(pattern, 0) + n
    return [(n, pattern) for room in sorted(by_room) for pattern, n in by_room[room].items()]


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, list[int], list[int], list[int]]]:
    """Per length: first ranks, first sequences and offsets of the runs of ranks that one place of one pattern takes."""
    out: dict[int, tuple[list[int], list[int], list[int]]] = {}
    taken: dict[int, int] = {}
    first = 0
    for count, pattern in patterns:
        offset = 0
        for length in pattern:
            for x, v in zip(out.setdefault(length, ([], [], [])), (taken.get(length, 0), first, offset), strict=True):
                x.append(v)
            taken[length] = taken.get(length, 0) + count
            offset += length
        first += count
    return [(length, *x) for length, x in out.items()]


def pack(cut_pieces: DataFrame, longest: int = LONGEST) -> DataFrame:
    """Adds sequence_id and offset to pieces of (doc_id, start, length, ids_crc32, doc_tokens).

    Only the histogram (a number per length) reaches the driver, and the patterns that come back are
    bounded by the lengths, not by the pieces. Pieces are numbered within their length: in parts dealt by
    a hash, each part after the sum of the parts before it.
    """
    spark = cut_pieces.sparkSession
    salted = cut(cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SALTS)).cast("int")))
    sizes = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r.length: r.n for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = slots(shortest_pack_first(histogram, longest))
    places = spark.createDataFrame(rows, "length long, ranks array<long>, sequences array<long>, offsets array<long>")
    before = sizes.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "start", "ids_crc32", "doc_tokens")) - 1
    ranked = salted.withColumn("within", within).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    run = F.size(F.filter("ranks", lambda r: r <= F.col("rank"))) - 1
    placed = ranked.join(F.broadcast(places), "length").withColumn("run", run)  # a row for each of at most `longest` lengths
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.get("sequences", "run") + F.col("rank") - F.get("ranks", "run")).alias("sequence_id"), F.get("offsets", "run").alias("offset"),
    )


def pack_documents(docs: DataFrame, longest: int = LONGEST, path: str | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids and a closing 0 are cut every ``longest`` ids; the pieces fill sequences of at most
    ``longest`` ids without gaps. Null text is empty: one piece, the 0. Repeated rows are packed each for
    itself; a null doc_id stays null; other columns are ignored. No documents, no rows. Texts are
    tokenized whole.
    """
    return pack(pieces(docs, longest, path), longest)


def op10_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
