"""Benchmark decontamination: windows of test words looked up in documents."""

from __future__ import annotations

from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh, per_batch, table, texts

#: Words of a window.
WINDOW = 10
#: What one broadcast set holds at most: windows (one for each item that has it) and bytes of their words. More are looked up set by set.
ENTRIES, BYTES = 1 << 18, 1 << 25
#: Bytes of text that are cut into words at a time; a longer word is taken whole.
CHUNK = 1 << 20
#: Odd numbers of the rolling hashes, and bits of a hash that the filter before the set looks at.
IN_WORD, IN_WINDOW, FILTER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 18

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Words:
    """Words of texts: lower-cased bytes (a zero byte after each text), where each word starts and ends, and a hash of each."""

    def __init__(self, of: list[bytes]) -> None:
        self.bytes = _LOWER[np.frombuffer(b"\0".join([*of, b""]), np.uint8)]
        sizes = np.fromiter(map(len, of), np.int64, len(of)) + 1
        self.text_at = np.concatenate([[0], np.cumsum(sizes)])
        inside = _WORD[self.bytes]
        edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edge = np.concatenate([[0], edge])
        self.start, self.end = edge[::2], edge[1::2]  # the last byte is no word's
        self.hash = np.zeros(len(self.start), np.uint64)
        at = 0
        while at < len(self.start):
            to = max(at + 1, int(np.searchsorted(self.end, self.start[at] + CHUNK)))
            self.hash[at:to] = self._hashes(at, to)
            at = to
        #: Words before each text, and the text of each word.
        self.before = np.searchsorted(self.start, self.text_at)
        self.text = np.repeat(np.arange(len(of)), np.diff(self.before))

    def _hashes(self, at: int, to: int) -> np.ndarray:
        first, length = int(self.start[at]), self.end[at:to] - self.start[at:to]
        within = np.concatenate([[0], np.cumsum(length)])
        place = np.arange(within[-1]) - np.repeat(within[:-1], length)
        values = self.bytes[first : int(self.end[to - 1])][_WORD[self.bytes[first : int(self.end[to - 1])]]].astype(np.uint64) + np.uint64(1)
        found = np.add.reduceat(values * powers(IN_WORD, int(length.max()))[place], within[:-1])
        found = (found ^ (found >> np.uint64(32))) * IN_WINDOW
        return found ^ (found >> np.uint64(29))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """First words and hashes of all windows of ``n`` words."""
        many = max(0, len(self.start) - n + 1)
        total = np.zeros(many, np.uint64)
        for j, power in enumerate(powers(IN_WINDOW, n)):
            total += self.hash[j : j + many] * power
        total ^= total >> np.uint64(31)
        total *= IN_WORD
        whole = self.text[:many] == self.text[n - 1 : n - 1 + many]
        return np.flatnonzero(whole), total[whole]

    def words(self, first: int, n: int) -> bytes:
        return b" ".join(self.bytes[a:b].tobytes() for a, b in zip(self.start[first : first + n], self.end[first : first + n], strict=True))


def encoded(batch: pa.RecordBatch, column: str) -> list[bytes]:
    return [t.encode() for t in texts(batch, column)]


def item_windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(words binary, n int, hash long, item string): the distinct windows of each item's text.

    An item of fewer words than ``n``, but not none, is one window. Null text has no words; an item of null id keeps its windows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), encoded(batch, "text"), strict=True):
                of = Words([text])
                if size := min(n, len(of.start)):
                    first, hashes = of.windows(size)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([of.words(i, size) for i in first.tolist()], pa.binary()), pa.array(np.full(len(first), size, np.int32)), pa.array(hashes.view(np.int64)), pa.array([item] * len(first), pa.string())],
                        ["words", "n", "hash", "item"],
                    )

    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string")).mapInArrow(run, "words binary, n int, hash long, item string").distinct()


class Lookup:
    """One set of windows: sorted hashes by length, the words behind each hash, and the items that have them."""

    def __init__(self, rows: list) -> None:
        self.items: dict[bytes, list[str | None]] = {}
        by: dict[int, set[int]] = {}
        for r in rows:
            self.items.setdefault(bytes(r.words), []).append(r.item)
            by.setdefault(r.n, set()).add(r.hash)
        self.hashes = {n: np.sort(np.array(list(h), np.int64).view(np.uint64)) for n, h in by.items()}

    def hits(self, of: Words) -> Iterator[tuple[int, int, list[str | None]]]:
        """(first word, words, items) of each window of the set; equal hashes are verified by their words."""
        for n, known in self.hashes.items():
            filled = np.zeros(1 << FILTER, bool)
            filled[known >> np.uint64(64 - FILTER)] = True
            first, hashes = of.windows(n)
            near = filled[hashes >> np.uint64(64 - FILTER)]
            first, hashes = first[near], hashes[near]
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            for i in first[known[at] == hashes].tolist():
                if (items := self.items.get(of.words(i, n))) is not None:
                    yield i, n, items


def _runs(marked: np.ndarray) -> np.ndarray:
    """Bounds of the runs of true values: each first place, and the place after each last one."""
    return np.flatnonzero(np.diff(np.concatenate([[0], marked.astype(np.int8), [0]])))


def _spans(of: Words, text: int, words: np.ndarray) -> list[int]:
    """Code points of a text that runs of its words take, from the first word's start to the last one's end."""
    at = int(of.text_at[text])
    code_points = np.concatenate([[0], np.cumsum((of.bytes[at : int(of.text_at[text + 1])] & 0xC0) != 0x80)])
    own = int(of.before[text])
    return [int(x) for a, b in words.reshape(-1, 2).tolist() for x in (code_points[of.start[own + a] - at], code_points[of.end[own + b - 1] - at])]


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", entries: int = ENTRIES, size: int = BYTES) -> DataFrame:
    """``docs`` with n_words and n_hit (long), items (array<string>, sorted) and spans (array<long>).

    Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased. Any ``n`` consecutive
    words of an item (all of a shorter one) are looked for in whole texts; words inside an occurrence are
    hit. ``items`` are those with an occurrence; ``spans`` are the code points, start and end by turns,
    that each run of hit words takes. Documents aren't shuffled. The windows of the benchmark are counted:
    up to ``entries`` of them and ``size`` bytes are broadcast as one set, more as several sets that
    the documents pass one after the other.

    Null text has no words, null counts as empty; an item of null id hits words but isn't listed; equal items
    and rows count each for what they are (equal ids are listed once). Columns called like ours get ours
    with an underscore before. Without an item nothing is hit.
    """
    spark = docs.sparkSession
    windows = cut(item_windows(benchmark, n))
    count, held = windows.agg(F.count("*"), F.coalesce(F.sum(F.length("words") + F.coalesce(F.length("item"), F.lit(0))), F.lit(0))).first()
    sets = max(1, -(-count // entries), -(-held // size))
    names = fresh(docs, "n_words", "n_hit", "items", "spans", "_hit_words")
    kinds = (T.LongType(), T.LongType(), T.ArrayType(T.StringType()), T.ArrayType(T.LongType()), T.ArrayType(T.LongType()))
    arrow = (pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64()))
    own = docs.columns
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, k) for c, k in zip(names, kinds, strict=True)]])
    out = docs
    for k in range(sets):
        rows = windows.where(F.pmod(F.xxhash64("words", "item"), F.lit(sets)) == k).collect()  # bounded: see entries and size
        known = spark.sparkContext.broadcast(rows)

        def look(batch: pa.RecordBatch, known=known, key=uuid4().hex, before=k > 0) -> pa.RecordBatch:
            if key not in _lookups:
                _lookups.clear()
                _lookups[key] = Lookup(known.value)
            found: tuple[list, ...] = ([], [], [], [], [])
            of_batch = encoded(batch, text)
            earlier = [batch.column(names[4]).to_pylist(), batch.column(names[2]).to_pylist()] if before else None
            at = 0
            while at < len(of_batch):  # some texts at a time
                to, total = at, 0
                while to < len(of_batch) and (to == at or total + len(of_batch[to]) <= CHUNK):
                    total += len(of_batch[to])
                    to += 1
                of = Words(of_batch[at:to])
                _mark(of, _lookups[key], [x[at:to] for x in earlier] if earlier else None, found)
                at = to
            arrays = [batch.column(c) for c in own] + [pa.array(x, t) for x, t in zip(found, arrow, strict=True)]
            return pa.RecordBatch.from_arrays(arrays, [*own, *names])

        out = per_batch(out, look, schema)
    return out.drop(names[4])


#: The set that a worker has unpacked last.
_lookups: dict[str, Lookup] = {}


def _mark(of: Words, lookup: Lookup, earlier: list | None, found: tuple[list, ...]) -> None:
    many = len(of.text_at) - 1
    steps = np.zeros(len(of.start) + 1, np.int64)
    items: dict[int, set[str]] = {}
    for first, n, names in lookup.hits(of):
        steps[first] += 1
        steps[first + n] -= 1
        items.setdefault(int(of.text[first]), set()).update(x for x in names if x is not None)
    marked = np.cumsum(steps[:-1]) > 0
    for text in range(many):
        a, b = int(of.before[text]), int(of.before[text + 1])
        own = marked[a:b]
        listed = items.get(text, set())
        if earlier:
            listed |= set(earlier[1][text])
            for x, y in zip(earlier[0][text][::2], earlier[0][text][1::2], strict=True):
                own[x:y] = True
        runs = _runs(own) if own.any() else np.zeros(0, np.int64)
        for column, x in zip(found, (b - a, int(own.sum()), sorted(listed), _spans(of, text, runs) if len(runs) else [], runs.tolist()), strict=True):
            column.append(x)


def remove_spans(marked: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """``marked`` with the code points of ``spans`` taken out of ``text``; null stays null."""
    kinds = {f.name: f.dataType for f in marked.schema.fields}
    names = marked.columns
    schema = T.StructType([T.StructField(c, kinds[c]) for c in names])

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for whole, bounds in zip(batch.column(text).to_pylist(), batch.column(spans).to_pylist(), strict=True):
            if whole is not None and bounds:
                edges = [0, *bounds, len(whole)]
                whole = "".join(whole[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
            out.append(whole)
        return pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(c).type) if c == text else batch.column(c) for c in names], names)

    return per_batch(marked, run, schema)


def remove_documents(marked: DataFrame, most: float = 0.0, n_words: str = "n_words", n_hit: str = "n_hit") -> DataFrame:
    """The rows whose share of hit words is at most ``most``."""
    return marked.where(F.col(n_hit) <= F.col(n_words) * F.lit(most))


def op12_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = contamination(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


ORACLE = r"""
with b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w
  from benchmark where text is not null
), windows as (
  select distinct item_id, k, array_to_string(w[i:i + k - 1], ' ') as words
  from (select item_id, w, k, unnest(range(1, len(w) - k + 2)) as i from (select *, least(len(w), 10) as k from b where len(w) > 0))
), d as (
  select row_number() over () as r, doc_id,
    coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w
  from documents
), placed as (
  select r, k, i, array_to_string(w[i:i + k - 1], ' ') as words
  from (select r, w, k, unnest(range(1, len(w) - k + 2)) as i from d, (select distinct k from windows) where len(w) >= k)
), hits as (
  select r, k, i, item_id from placed join windows using (k, words)
), hit as (
  select r, count(distinct j) as n_hit from (select r, unnest(range(i, i + k)) as j from (select distinct r, k, i from hits)) group by r
), listed as (
  select r, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct r, item_id::varchar as item from hits where item_id is not null) group by r
)
select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (r) left join listed using (r)
"""
