"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, fresh, remainder, table
from .linededup import document_keys

#: Letters and what Python counts among word characters beside digits.
WORD = re.compile(r"[^\W\d_]+")
LONGEST = 4
SMOOTH = 0.1
#: A posterior counts at most so many words' evidence: beyond, it says what so many words of the text's kind would.
EVIDENCE = 12
#: Logs are whole numbers of this part, so that sums don't depend on their order.
GRAIN = 1 << 20
#: Words and n-grams that every task gets, the most frequent. The others are joined: this changes no result.
CACHED = 200_000
UNKNOWN = "und"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters; the letters alone where marks or numerals are in every run; none without a letter."""
    runs = WORD.findall((text or "").lower())
    words = [w for w in runs if w.isalpha()]
    if not words and runs:
        words = [w for w in ("".join(filter(str.isalpha, r)) for r in runs) if w]
    return words


def grams_of(word: str, n: int) -> list[str]:
    framed = f" {word} "
    return [framed[i : i + n] for i in range(len(framed) - n + 1) if n > 1 or framed[i] != " "]


def _counted(found: dict[str, Counter], key: str) -> Iterator[pa.RecordBatch]:
    for lang, c in found.items():
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([lang] * len(c), pa.string()), pa.array(list(c.values()), pa.int64())], [key, "lang", "n"])


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, lang, n) over all rows of (text, lang): counted in the tasks first, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = defaultdict(Counter)
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                counts[lang].update(words_of(text))
            yield from _counted(counts, "word")

    return labelled.mapInArrow(run, "word string, lang string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))


def gram_counts(counts: DataFrame) -> DataFrame:
    """(gram, lang, n) of the n-grams of 1 to LONGEST characters in all words of (word, lang, n), in part sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter] = defaultdict(Counter)
            for word, lang, k in zip(*(batch.column(c).to_pylist() for c in ("word", "lang", "n")), strict=True):
                c = found[lang]
                for n in range(1, LONGEST + 1):
                    for g in grams_of(word, n):
                        c[g] += k
            yield from _counted(found, "gram")

    return counts.mapInArrow(run, "gram string, lang string, n long")


def by_language(counts: DataFrame, key: str, langs: list[str]) -> DataFrame:
    """(key, total, n0, n1, ...): a row per key, its counts in the order of ``langs``."""
    own = [F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
    return counts.groupBy(key).agg(F.sum("n").alias("total"), *own)


@dataclass
class Table:
    """(key, l0, l1, ...): log frequencies of all keys by language, and the part of them that tasks get."""

    rest: DataFrame
    cache: list[str]
    logs: np.ndarray

    @property
    def shared(self) -> tuple[dict[str, int], np.ndarray]:
        """(place by key, logs [places + 1, languages], zero in the last)."""
        return {k: i for i, k in enumerate(self.cache)}, np.concatenate([self.logs, np.zeros((1, self.logs.shape[1]), np.int64)])


def _split(logs: DataFrame, key: str, langs: list[str], cached: int) -> Table:
    """The classes of highest totals that have at most ``cached`` keys together go to the tasks.

    A class holds totals within one part in 64 of a doubling, so that a histogram of classes stays small for
    any corpus. Where the highest class has more keys, none goes, and none is frequent enough to matter.
    """
    own = [f"l{i}" for i in range(len(langs))]
    least, kept = None, 0
    for r in sorted(logs.groupBy("class").count().collect(), reverse=True):
        if kept + r["count"] > cached:
            break
        least, kept = r["class"], kept + r["count"]
    if not kept:
        return Table(logs.select(key, *own), [], np.zeros((0, len(langs)), np.int64))
    found = logs.where(F.col("class") >= least).select(key, *own).toArrow()
    return Table(logs.where(F.col("class") < least).select(key, *own), found.column(key).to_pylist(), np.stack([found.column(c).to_numpy() for c in own], axis=1))


@dataclass
class Model:
    langs: list[str]
    words: Table
    grams: Table


def train(labelled: DataFrame, cached: int = CACHED) -> Model:
    """A model of all rows of (text, lang); rows with a null lang or text teach nothing.

    All words of all rows are counted and all are kept, in tables; ``cached`` bounds what tasks get beside them
    and changes no result. There are as many columns as languages.
    """
    counts = cut(word_counts(labelled.where("lang is not null and text is not null").select(F.col("text").cast("string"), F.col("lang").cast("string"))))
    langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
    own = [f"n{i}" for i in range(len(langs))]
    of_class = F.floor(F.log2(F.col("total").cast("double")) * 64).alias("class")
    sums = [F.sum(c).alias(c) for c in own]
    words = by_language(counts, "word", langs)
    totals = words.agg(F.count("*").alias("v"), *sums).first()
    log = lambda n, total: F.round((F.log(F.col(n) + SMOOTH) - F.log(total)) * GRAIN).cast("long").alias(f"l{n[1:]}")
    word_logs = cut(words.select("word", of_class, *[log(c, F.lit((totals[c] or 0) + SMOOTH * (totals.v + 1))) for c in own]))
    grams = cut(by_language(gram_counts(counts), "gram", langs).withColumn("size", F.length("gram")))
    sizes = {r["size"]: r for r in grams.groupBy("size").agg(F.count("*").alias("v"), *sums).collect()}

    def of_size(c: str) -> Column:
        out = F.lit(1.0)
        for n, r in sizes.items():
            out = F.when(F.col("size") == n, F.lit(float(r[c] + SMOOTH * (r.v + 1)))).otherwise(out)
        return out

    gram_logs = cut(grams.select("gram", of_class, *[log(c, of_size(c)) for c in own]))
    return Model(langs, _split(word_logs, "word", langs, cached), _split(gram_logs, "gram", langs, cached))


def _texts(docs: DataFrame, *keys: Column) -> DataFrame:
    return docs.select(*keys, F.col("text").cast("string").alias("text"))


def unseen_words(docs: DataFrame, model: Model) -> DataFrame:
    """(word): each word of ``docs`` once that the model hasn't seen."""
    shared = docs.sparkSession.sparkContext.broadcast(model.words.shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value[0]
        for batch in batches:
            found: set[str] = set()
            for text in batch.column("text").to_pylist():
                found.update(words_of(text))
            yield pa.RecordBatch.from_arrays([pa.array([w for w in found if w not in known], pa.string())], ["word"])

    return _texts(docs).mapInArrow(run, "word string").distinct().join(model.words.rest.select("word"), "word", "left_anti")


def backed_off(words: DataFrame, model: Model) -> DataFrame:
    """(word, l0, l1, ...): mean logs of the longest n-grams of each distinct word of which any is known; zero where none is.

    N-grams that tasks know are summed there. Only the longest size with such ones, and the sizes above it,
    can decide: what is unknown of these is joined to the other n-grams.
    """
    shared = words.sparkSession.sparkContext.broadcast(model.grams.shared)
    own = [f"l{i}" for i in range(len(model.langs))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        for batch in batches:
            word, size, gram, times, sums = [], [], [], [], []
            for w in batch.column("word").to_pylist():
                for n in range(min(LONGEST, len(w) + 2), 0, -1):
                    grams = grams_of(w, n)
                    at = np.fromiter(map(known.get, grams, repeat(-1)), np.int64, len(grams))
                    rare = Counter(compress(grams, (at < 0).tolist()))
                    hits = int((at >= 0).sum())
                    word += [w] * (len(rare) + 1)
                    size += [n] * (len(rare) + 1)
                    gram += ["", *rare]
                    times += [hits, *rare.values()]
                    sums += [logs[at].sum(axis=0), *[logs[-1]] * len(rare)]
                    if hits:
                        break
            columns = np.array(sums, np.int64).reshape(-1, len(own))
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.string()), pa.array(size, pa.int32()), pa.array(gram, pa.string()), pa.array(times, pa.int64()), *[pa.array(columns[:, j]) for j in range(len(own))]], ["word", "size", "gram", "times", *[f"s{c[1:]}" for c in own]])

    rows = words.mapInArrow(run, "word string, size int, gram string, times long, " + ", ".join(f"s{c[1:]} long" for c in own))
    # The rows of what tasks know have no n-gram: they go round the join, each to an own key.
    keyed = rows.withColumn("key", F.when(F.col("gram") == "", F.concat(F.lit("\n"), "word")).otherwise(F.col("gram")))
    met = keyed.join(model.grams.rest.withColumnRenamed("gram", "key"), "key", "left")
    lone = F.col("gram") == ""
    n = F.when(lone | F.col(own[0]).isNotNull(), F.col("times")).otherwise(0)
    each = met.groupBy("word", "size").agg(F.sum(n).alias("n"), *[F.sum(F.when(lone, F.col(f"s{c[1:]}")).otherwise(F.col("times") * F.coalesce(c, F.lit(0)))).alias(c) for c in own])
    best = each.groupBy("word").agg(F.max_by(F.struct("n", *own), F.when(F.col("n") > 0, F.col("size"))).alias("b"))
    return best.select("word", *[F.coalesce(F.round(F.col(f"b.{c}") / F.col("b.n")), F.lit(0)).cast("long").alias(c) for c in own])


def predictions(docs: DataFrame, model: Model) -> DataFrame:
    """(k2, doc_id, same, lang_pred, score): by hash of the text and id, for ``same`` rows of a document each."""
    spark = docs.sparkSession
    _, k2 = document_keys(F.col("doc_id"), F.col("text"))
    keys = [k2.alias("k2"), F.col("doc_id").cast("long").alias("doc_id")]
    if not model.langs:
        return docs.select(*keys, F.lit(1).cast("long").alias("same"), F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    own = [f"l{i}" for i in range(len(model.langs))]
    others = model.words.rest.unionByName(backed_off(unseen_words(docs, model), model))
    shared = spark.sparkContext.broadcast(model.words.shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each word of a text that isn't known, after one with what the known ones add."""
        known, logs = shared.value
        number = 0
        for batch in batches:
            lengths, words, times, first = [], [], [], []
            for text, key in zip(batch.column("text").to_pylist(), batch.column("k2").to_pylist(), strict=True):
                found = words_of(text)
                at = np.fromiter(map(known.get, found, repeat(-1)), np.int64, len(found))
                rare = Counter(compress(found, (at < 0).tolist()))
                words.append(f"\n{key}")  # no word has a line break
                words += rare
                times.append(len(found))
                times += rare.values()
                lengths.append(1 + len(rare))
                first.append(logs.take(at, axis=0).sum(axis=0))
            starts = np.cumsum(lengths) - lengths
            sums = np.zeros((len(words), len(own)), np.int64)
            sums[starts] = first
            is_first = np.zeros(len(words), bool)
            is_first[starts] = True
            row = np.repeat((number + np.arange(len(lengths))) % (1 << 20), lengths)  # rows of one document in a task stay apart
            number += len(lengths)
            at = pa.array(np.repeat(np.arange(len(lengths)), lengths))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k).take(at) for k in ("k2", "doc_id")], pa.array(row), pa.array(words, pa.string()), pa.array(times, pa.int64()), pa.array(is_first), *[pa.array(sums[:, j]) for j in range(len(own))]],
                ["k2", "doc_id", "row", "word", "times", "first", *[f"s{j}" for j in range(len(own))]],
            )

    rows = _texts(docs, *keys).mapInArrow(run, "k2 long, doc_id long, row long, word string, times long, first boolean, " + ", ".join(f"s{j} long" for j in range(len(own))))
    met = rows.join(others, "word", "left")
    add = lambda c: F.sum(F.col(f"s{c[1:]}") + F.when(F.col("first"), 0).otherwise(F.col("times") * F.coalesce(c, F.lit(0)))).alias(c)
    each = met.groupBy("k2", "doc_id", "row").agg(F.sum(F.col("first").cast("long")).alias("same"), F.sum(F.when(F.col("first"), F.col("times")).otherwise(0)).alias("n"), *[add(c) for c in own])
    mean = F.array(*[F.col(c) / F.greatest("n", F.lit(1)) * F.least(F.col("n") / F.col("same"), F.lit(EVIDENCE)) / GRAIN for c in own])
    best = F.array_max("mean")
    lang = F.get(F.array(*[F.lit(lang) for lang in model.langs]), (F.array_position("mean", best) - 1).cast("int"))
    posterior = 1 / F.aggregate("mean", F.lit(0.0), lambda a, x: a + F.exp(x - best))
    none = F.col("n") == 0
    return each.withColumn("mean", mean).select("k2", "doc_id", "same", F.when(none, UNKNOWN).otherwise(lang).alias("lang_pred"), F.when(none, 0.0).otherwise(posterior).alias("score"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for each row of ``docs``: the language and its posterior, of at most EVIDENCE words.

    A word counts by its log frequency in each language; a word that the model hasn't seen by the mean of its
    longest n-grams of which any was seen, one without any alike for all. ``und`` with score 0 where the
    text is null or has no letter, or nothing was learned. Only the text is read, whole. Ties go to the
    language that sorts first. A null doc_id stays null, repeated rows each give a row with equal values, other
    columns are ignored. No documents, no rows.
    """
    found = predictions(docs, model)
    return found.select("doc_id", "lang_pred", "score", F.explode(F.array_repeat(F.lit(0), F.col("same").cast("int"))).alias("copy")).drop("copy")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all their columns, whose language is found with a posterior of at least ``least``.

    Null texts, texts without a letter, and all rows where nothing was learned go; repeated rows stay or go
    together; a null doc_id is no reason to go. Columns of any name are kept. No documents, no rows.
    """
    a, b = fresh(docs, "_k1", "_k2")
    k1, k2 = document_keys(docs["doc_id"], docs["text"])
    rejected = predictions(docs, model).where((F.col("lang_pred") == UNKNOWN) | (F.col("score") < least))
    gone = broadcast_if_small(cut(rejected.select(document_keys(F.col("doc_id"), F.lit(""))[0].alias(a), F.col("k2").alias(b)).distinct()))
    return docs.withColumns({a: k1, b: k2}).join(gone, [a, b], "left_anti").select(*docs.columns)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(docs.where(~held_out))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
