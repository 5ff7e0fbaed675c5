"""Document fingerprints by winnowing rolling k-gram hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

#: Code points of a gram, and grams of a window: any match of GRAM + WINDOW - 1 code points is found.
GRAM, WINDOW = 16, 16
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i mod 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((_BASE, _INVERSE)):
            _powers[k] = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(2 * n, b), dtype=np.uint64)])
    return _powers[0][:n], _powers[1][:n]


def gram_hashes(points: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of each run of ``gram`` code points, rolled by prefix sums mod 2**64 and then mixed.

    A shorter sequence that isn't empty is one gram.
    """
    gram = min(gram, len(points))
    if not gram:
        return np.zeros(0, np.uint64)
    up, down = _power(len(points))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)])
    h = (sums[gram:] - sums[:-gram]) * down[: len(points) - gram + 1]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def window_minima(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of each ``window`` neighbours, the rightmost of equals; ascending, each once.

    The minima of windows of 1, 2, 4, ... are joined in pairs: as many passes as the window has bits.
    """
    window = min(window, len(h))
    if not window:
        return np.zeros(0, np.int64)
    at, width = np.arange(len(h)), 1
    while width < window:
        step = min(width, window - width)
        left, right = at[:-step], at[step:]
        at = np.where(h[right] <= h[left], right, left)
        width += step
    return at[np.concatenate([[True], at[1:] != at[:-1]])]


def winnow(text: str, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of a whole text."""
    h = gram_hashes(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), gram)
    at = window_minima(h, window)
    return at, h[at]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sets of hashes, each sorted and distinct; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def digest(at: np.ndarray, h: np.ndarray) -> str:
    return hashlib.sha256(at.astype("<i8").tobytes() + h.astype("<u8").tobytes()).hexdigest()


def fingerprints(docs: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """(doc_id, positions array<long>, hashes array<long>): the winnowed fingerprints of every whole text.

    Null text is empty and has none; a null doc_id stays null; repeated rows each give a row; a text
    shorter than a gram has one. Equal texts have equal fingerprints.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [winnow(t or "", gram, window) for t in batch.column("text").to_pylist()]
            lists = [pa.array([x[k].view(np.int64) for x in found], pa.list_(pa.int64())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "positions", "hashes"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, positions array<long>, hashes array<long>")


class _Doc:
    """A text with what is computed from it once."""

    def __init__(self, doc_id: int | None, text: str):
        self.doc_id, self.text = doc_id, text
        at, h = winnow(text)
        self.fingerprint, self.hashes = digest(at, h), np.unique(h)

    def beside(self, follower: _Doc) -> tuple:
        cut_off = len(self.text) // 2
        edited = self.text[: len(self.text) - cut_off] + follower.text[:cut_off]
        at, h = winnow(edited)
        sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        return self.doc_id, len(self.text), sha, self.fingerprint, digest(at, h), likeness(self.hashes, np.unique(h)), likeness(self.hashes, follower.hashes)


_FIELDS = (("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double"))
_EDGE = (("edge", "int"), ("part", "int"), ("edge_text", "string"))
_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "double": pa.float64()}


def _batch(rows: list[tuple], fields: tuple) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def edited_likeness(docs: DataFrame) -> DataFrame:
    """Per document: its fingerprint, that of its edited text, and how like it the edited and the next text are.

    The edited text has its last floor(n/2) code points replaced by the first as many, or all, of the
    next document in descending doc_id (the first follows the last; equal ids in order of a hash of
    their texts, null ids last). Null text is empty. Repeated rows each give a row. A lone document
    follows itself. No documents, no rows.

    Documents are sorted by range into parts in order, and each task walks its part with one document in hand. Only
    the first and last of each part (two rows a task) are joined afterwards.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("order", F.xxhash64("text"))
    keys = [F.col("doc_id").desc_nulls_last(), F.col("order").asc()]

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of all but a part's last document; the first with edge 0 and the last with edge 1 for the join."""
        held, part = None, TaskContext.get().partitionId()
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text")), strict=True):
                now = _Doc(doc_id, text)
                if held is None:
                    rows.append((doc_id, *[None] * 6, 0, part, text))
                else:
                    rows.append((*held.beside(now), None, None, None))
                held = now
            yield _batch(rows, _FIELDS + _EDGE)
        if held is not None:
            yield _batch([(held.doc_id, *[None] * 6, 1, part, held.text)], _FIELDS + _EDGE)

    ddl = lambda fields: ", ".join(f"{n} {t}" for n, t in fields)
    walked = cut(keyed.repartitionByRange(*keys).sortWithinPartitions(*keys).mapInArrow(walk, ddl(_FIELDS + _EDGE)))
    edges = walked.where("edge is not null").select("doc_id", "edge", "part", "edge_text")
    # A number a task, in order: no text is in this one window.
    parts = edges.where("edge = 0").select("part")
    after = parts.select("part", F.coalesce(F.lead("part").over(Window.orderBy("part")), F.first("part").over(Window.orderBy("part"))).alias("following"))
    heads = edges.where("edge = 0").select(F.col("part").alias("following"), F.col("edge_text").alias("next_text"))
    tails = edges.where("edge = 1").select("part", "doc_id", F.col("edge_text").alias("text")).join(after, "part")

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _batch([_Doc(d, t).beside(_Doc(None, n)) for d, t, n in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "next_text")), strict=True)], _FIELDS)

    last = tails.join(heads, "following").select("doc_id", "text", "next_text").mapInArrow(pair, ddl(_FIELDS))
    return walked.where("edge is null").select(*[n for n, _ in _FIELDS]).unionByName(last)


def op8_winnow_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(table(spark, sf_dir, "documents"))
