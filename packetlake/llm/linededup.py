"""Line dedup by winnowing over line hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, table

#: Words: nothing shorter is a match, and any repeated run of so many is found.
NOISE, GUARANTEE = 30, 50
_LAST = 2**63 - 1


def document_keys(doc_id: Column, text: Column) -> tuple[Column, Column]:
    """The order of documents: by id, null last, then by a hash of the text."""
    return F.coalesce(doc_id.cast("long"), F.lit(_LAST)), F.xxhash64(F.coalesce(text, F.lit("")))


def line_arrays(docs: DataFrame) -> DataFrame:
    """(k1, k2, n_lines, lines): per document, number, hash and words of each line that isn't blank.

    Rows of the same id and text are one document.
    """
    k1, k2 = document_keys(F.col("doc_id"), F.col("text"))
    line = lambda x, i: F.struct(i.alias("line"), F.xxhash64(x).alias("h"), F.when(F.trim(x) == "", 0).otherwise(F.length(F.trim(x)) - F.length(F.replace(F.trim(x), F.lit(" "), F.lit(""))) + 1).alias("words"))
    found = docs.select(k1.alias("k1"), k2.alias("k2"), F.transform(F.split(F.col("text"), "\n"), line).alias("all"))
    found = found.select("k1", "k2", F.size("all").alias("n_lines"), F.filter("all", lambda x: x["words"] > 0).alias("lines")).where(F.size("lines") > 0)
    return found.groupBy("k1", "k2").agg(F.first("n_lines").alias("n_lines"), F.first("lines").alias("lines"))


def selected_grams(arrays: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> DataFrame:
    """(k1, k2, p, gram): the fingerprints.

    A gram is the hash of the fewest lines from line ``p`` on that have ``noise`` words. From each line
    that ``guarantee`` words follow, the least of the grams that surely end within those words is
    selected, the rightmost of equals: any run of lines with so many words holds a selected gram, and
    holds the same one wherever it stands.
    """
    lines = arrays.select("k1", "k2", F.posexplode("lines").alias("p", "x")).select("k1", "k2", "p", "x.h", "x.words")
    doc = Window.partitionBy("k1", "k2")
    placed = lines.withColumn("s", F.sum("words").over(doc.orderBy("p")) - F.col("words"))
    ahead = lambda words: doc.orderBy("s").rangeBetween(0, words - 1)
    grams = placed.withColumns({"gram": F.when(F.sum("words").over(ahead(noise)) >= noise, F.xxhash64(F.collect_list("h").over(ahead(noise)))), "enough": F.sum("words").over(ahead(guarantee)) >= guarantee})
    least = F.min(F.when(F.col("gram").isNotNull(), F.struct("gram", (-F.col("p")).alias("q")))).over(ahead(guarantee - noise + 1))
    return grams.withColumn("least", least).where("enough").select("k1", "k2", (-F.col("least.q")).alias("p"), F.col("least.gram").alias("gram")).distinct()


def repeated_lines(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE) -> tuple[DataFrame, DataFrame]:
    """(the line arrays, (k1, k2, line) of all lines to delete).

    Each selected gram is joined to its first position. Two documents are laid over each other as the two
    positions say, once for each such offset, and the match is extended to all neighbouring lines that
    agree. No gram's positions are paired with each other.
    """
    arrays = cut(line_arrays(docs))
    selected = cut(selected_grams(arrays, noise, guarantee))
    firsts = selected.groupBy("gram").agg(F.min(F.struct("k1", "k2", "p")).alias("f"), F.count("*").alias("n")).where("n > 1")
    firsts = firsts.select(F.col("gram").bitwiseXOR(F.lit(0).cast("long")).alias("gram"), F.col("f.k1").alias("f1"), F.col("f.k2").alias("f2"), F.col("f.p").alias("fp"))
    seeds = cut(selected.join(firsts, "gram").where("not (k1 = f1 and k2 = f2 and p = fp)").select("k1", "k2", "p", "f1", "f2", (F.col("p") - F.col("fp")).alias("shift")))
    pair = ["k1", "k2", "f1", "f2", "shift"]
    own = arrays.select("k1", "k2", F.col("lines").alias("own"))
    first = arrays.select(F.col("k1").alias("f1"), F.col("k2").alias("f2"), F.col("lines.h").alias("theirs"))
    laid = seeds.select(*pair).distinct().join(own, ["k1", "k2"]).join(first, ["f1", "f2"])
    low, high = F.greatest(F.lit(0), F.col("shift")), F.least(F.size("own"), F.size("theirs") + F.col("shift")) - 1
    agree = F.filter(F.sequence(low, high), lambda i: F.get(F.col("own"), i)["h"] == F.get(F.col("theirs"), i - F.col("shift")))
    same = laid.select(*pair, F.explode(agree).alias("p"), "own").select(*pair, "p", F.get(F.col("own"), F.col("p"))["line"].alias("line"))
    met = same.withColumn("seed", F.lit(0)).unionByName(seeds.select(*pair, "p", F.lit(None).cast("int").alias("line"), F.lit(1).alias("seed"))).groupBy(*pair, "p").agg(F.max("line").alias("line"), F.max("seed").alias("seed"))
    runs = met.withColumn("run", F.col("p") - F.row_number().over(Window.partitionBy(*pair).orderBy("p")))
    gone = runs.withColumn("seed", F.max("seed").over(Window.partitionBy(*pair, "run"))).where("seed = 1")
    return arrays, gone.select("k1", "k2", "line").distinct()


def dedup_lines(docs: DataFrame, noise: int = NOISE, guarantee: int = GUARANTEE, lines: str = "n_lines", deleted: str = "n_deleted") -> DataFrame:
    """All rows and columns of ``docs`` with repeated runs of lines deleted from ``text``, and two counts.

    Lines end with "\\n". A run of consecutive lines (blank ones aside) that stands at an earlier place,
    in an earlier document or the same one, is deleted from the later place if it has ``guarantee`` words
    (words are parted by spaces); none with fewer than ``noise`` words is; between the two it depends on
    its hashes. Documents are ordered by id (null last), then by a hash of the text, and a match is
    extended against the first place of its fingerprint, so that every deleted line stands at some earlier
    place that is kept. Blank lines stay.

    Null text stays null, with 0 lines; empty text has 1; a text may become empty. Rows of the same id and
    text are treated alike, as one document. Columns called like a count get ours with an underscore
    before. No documents, no rows.
    """
    arrays, gone = repeated_lines(docs, noise, guarantee)
    lines, deleted, a, b, keep = fresh(docs, lines, deleted, "_k1", "_k2", "_keep")
    # Flags for all lines of the documents that lose some, so that filtering a text takes one pass.
    hit = arrays.join(gone.select("k1", "k2").distinct(), ["k1", "k2"], "left_semi").select("k1", "k2", F.explode(F.sequence(F.lit(0), F.col("n_lines") - 1)).alias("line"))
    flags = hit.withColumn("keep", F.lit(True)).unionByName(gone.withColumn("keep", F.lit(False))).groupBy("k1", "k2", "line").agg(F.min("keep").alias("keep"))
    flags = flags.groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("line", "keep")))["keep"].alias(keep)).select(F.col("k1").alias(a), F.col("k2").alias(b), keep)
    k1, k2 = document_keys(docs["doc_id"], docs["text"])
    joined = docs.withColumns({a: k1, b: k2}).join(flags, [a, b], "left")
    kept = F.filter(F.split("text", "\n"), lambda x, i: F.get(F.col(keep), i))
    text = F.when(F.col(keep).isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))
    counts = {
        lines: F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long"),
        deleted: F.when(F.col(keep).isNull(), 0).otherwise(F.size(F.filter(keep, lambda x: ~x))).cast("long"),
    }
    return joined.select(*[text.alias(c) if c == "text" else F.col(c) for c in docs.columns], *[v.alias(k) for k, v in counts.items()])


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", "text")
