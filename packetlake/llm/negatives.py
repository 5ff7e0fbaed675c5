"""Hard negatives by ball trees: branch and bound over inner products."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table
from .vectors import LARGEST, matrix, padded, whole, widest

#: Numbers and rows of the vectors that one tree's part holds on average, and anchors that meet a part in one task.
NUMBERS, ROWS, ANCHORS = 1 << 20, 1 << 14, 1 << 16
#: Rows of a leaf, and anchors that walk a tree together.
LEAF, TOGETHER = 128, 1024
#: More than the rows of any part: hash-dealt parts hold about ROWS.
SPAN = 1 << 18
NONE = np.iinfo(np.int64).min
assert LARGEST * SPAN < 1 << 63


class Tree:
    """A ball tree over rows of a part: rows are put in an order in which each ball is a slice of them."""

    def __init__(self, x: np.ndarray, at: np.ndarray) -> None:
        self.at = at.copy()
        self.nodes: list[tuple[int, int, int, int]] = []  # start, end, and the two balls inside or -1
        self.centres: list[np.ndarray] = []
        self.radii: list[float] = []
        self._grow(x, 0, len(at))
        self.x, self.centre, self.radius = x[self.at], np.array(self.centres), np.array(self.radii)
        self.size = np.linalg.norm(self.centre, axis=1)

    def _grow(self, x: np.ndarray, start: int, end: int) -> int:
        own = x[self.at[start:end]]
        centre = own.mean(axis=0)
        far = np.linalg.norm(own - centre, axis=1)
        number = len(self.nodes)
        self.nodes.append((start, end, -1, -1))
        self.centres.append(centre)
        self.radii.append(float(far.max()))
        if end - start > LEAF:
            one = own[far.argmax()]
            other = own[np.linalg.norm(own - one, axis=1).argmax()]
            half = (end - start) // 2
            self.at[start:end] = self.at[start:end][np.argpartition(own @ (other - one), half)]
            left = self._grow(x, start, start + half)
            self.nodes[number] = (start, end, left, self._grow(x, start + half, end))
        return number


class Part:
    """The trees of one part: one for each label with more rows than a leaf, one for the rows of all others."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels, x = ids[order], labels[order], x[order]
        values, where, n = np.unique(self.labels, return_inverse=True, return_counts=True)
        few = np.flatnonzero((n <= LEAF)[where])
        self.trees = [(int(values[k]), Tree(x, np.flatnonzero(where == k))) for k in np.flatnonzero(n > LEAF)]
        if len(few):
            self.trees.append((None, Tree(x, few)))

    def search(self, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> np.ndarray:
        """(query, window, k): keys of the first ``k`` rows within each window [low, high] of scores, NONE where there are fewer.

        A key is the score and, under it, the place of the row's id from the end: larger keys come first.
        """
        best = np.full((*low.shape, k), NONE)
        length = np.linalg.norm(q, axis=1)
        for label, tree in self.trees:
            asked = np.arange(len(q)) if label is None else np.flatnonzero((labels == label) == same)
            stack = [(0, asked)]
            while stack:
                node, asked = stack.pop()
                middle, slack = q[asked] @ tree.centre[node], length[asked] * tree.radius[node]
                slack += 1 + 1e-11 * length[asked] * (tree.size[node] + tree.radius[node])  # rounding
                kth = best[asked].min(axis=2) // SPAN
                # A ball stays only if its highest score reaches the window and the current kth, and its lowest doesn't exceed the window.
                open_ = ((middle + slack)[:, None] >= np.maximum(low[asked], kth)) & ((middle - slack)[:, None] <= high[asked])
                asked = asked[open_.any(axis=1)]
                if not len(asked):
                    continue
                start, end, left, right = tree.nodes[node]
                if left < 0:
                    self._leaf(tree, start, end, asked, ids, labels, q, low, high, best, same)
                else:  # the ball with the higher scores is searched first: it raises the kth
                    nearer = (q[asked] @ (tree.centre[left] - tree.centre[right])).sum() > 0
                    stack += [(right, asked), (left, asked)] if nearer else [(left, asked), (right, asked)]
        return best

    def _leaf(self, tree: Tree, start: int, end: int, asked: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, low: np.ndarray, high: np.ndarray, best: np.ndarray, same: bool) -> None:
        at = tree.at[start:end]
        scores = np.rint(q[asked] @ tree.x[start:end].T).astype(np.int64)
        keys = scores * SPAN + (SPAN - 1 - at)
        fits = ((labels[asked][:, None] == self.labels[at]) == same) & (ids[asked][:, None] != self.ids[at])
        k = best.shape[2]
        for w in range(low.shape[1]):
            found = fits & (scores >= low[asked, w, None]) & (scores <= high[asked, w, None]) & (keys > best[asked, w].min(axis=1)[:, None])
            some = np.flatnonzero(found.any(axis=1))
            if len(some):
                both = np.concatenate([best[asked[some], w], np.where(found[some], keys[some], NONE)], axis=1)
                best[asked[some], w] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]


def participants(embeddings: DataFrame, vector: str = "embedding", scale: int = 256) -> DataFrame:
    """(vec_id long, label long, v array<int>): one row for each id with a label and a vector of finite numbers."""
    kept = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col(vector), scale).alias("v"))
    return kept.dropna().groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.*")


def _search(rows: DataFrame, anchors: DataFrame, k: int, same: bool, width: int, parts: int, blocks: int) -> DataFrame:
    """(anchor_id, place, other_id, score): each part's first ``k`` rows for each window of each anchor.

    ``rows`` are (vec_id, label, v); ``anchors`` have ``windows`` too, an array of (low, high), as many for
    each. Rows are dealt to parts by a hash of their id and meet the anchors in blocks: a task holds one
    part's rows and walks its trees with the anchors as they come.
    """
    windows = "array<struct<low: long, high: long>>"
    data = rows.select("vec_id", "label", "v", F.lit(None).cast(windows).alias("windows"), F.lit(0).alias("kind"), F.pmod(F.xxhash64("vec_id"), F.lit(parts).cast("long")).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    asked = anchors.select("vec_id", "label", "v", "windows", F.lit(1).alias("kind"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"))
    cells = data.unionByName(asked).withColumn("cell", F.col("part") * blocks + F.col("block")).drop("part", "block")
    dealt = cells.repartition(min(2 * parts * blocks, 1 << 14), "cell").sortWithinPartitions("cell", "kind")

    def answer(part: Part, batch: pa.RecordBatch) -> pa.RecordBatch:
        ids, labels, q = batch.column("vec_id").to_numpy(), batch.column("label").to_numpy(), matrix(batch.column("v"), width)
        flat = batch.column("windows").flatten()
        low, high = (c.to_numpy(zero_copy_only=False).reshape(len(ids), -1) for c in flat.flatten())
        keys = part.search(ids, labels, q, low, high, k, same)
        i, w, j = np.nonzero(keys != NONE)
        found = keys[i, w, j]
        return pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(w.astype(np.int32)), pa.array(part.ids[SPAN - 1 - found % SPAN]), pa.array(found // SPAN)], ["anchor_id", "place", "other_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held, part = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells, kinds = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            breaks = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0)) + 1
            for i, j in pairwise([0, *breaks.tolist(), batch.num_rows]):
                if cells[i] != cell:
                    cell, held, part = cells[i], [], None
                if kinds[i] == 0:
                    held.append(batch.slice(i, j - i))
                elif held:
                    if part is None:
                        part = Part(*(np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("vec_id", "label")), np.concatenate([matrix(b.column("v"), width) for b in held]))
                    for at in range(i, j, TOGETHER):
                        yield answer(part, batch.slice(at, min(TOGETHER, j - at)))

    return dealt.select("cell", "kind", "vec_id", "label", "v", "windows").mapInArrow(run, "anchor_id long, place int, other_id long, score long")


def hard_negatives(rows: DataFrame, anchor_step: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, cell: int | None = None) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows of (vec_id, label, v).

    Anchors are the rows whose id is divisible by ``anchor_step``. A row's score is its inner product with the
    anchor; higher ones come first, of equal ones the smaller id. An anchor's positives are the first other
    rows of its label; for each, the negatives are the first rows of another label whose score is ``least``
    to ``most`` hundredths of the positive's (none for a negative score, as no score lies between).

    Every row is searched: per-part ball trees bound the scores in each ball from both sides, and balls
    outside the window, or strictly beneath the current last of the first ones, are passed over. ``rows`` is
    checkpointed; vectors of fewer components count as if zeros followed. ``cell`` sets the rows of a part
    (by default as many as make 2^20 numbers); it changes no result. Ids are keys: ``participants`` gives
    one row for each. No rows, no result.
    """
    rows = cut(rows)
    n, width = widest(rows)
    rows = rows.withColumn("v", padded(F.col("v"), width))
    cell = cell or max(64, min(ROWS, NUMBERS // max(width, 1)))
    anchors = rows.where(F.col("vec_id") % anchor_step == 0)
    parts, blocks = max(1, -(-n // cell)), max(1, -(-anchors.count() // ANCHORS))
    bound = F.lit(1 << 62)
    all_scores = F.array(F.struct((-bound).alias("low"), bound.alias("high")))
    met = _search(rows, anchors.withColumn("windows", all_scores), positives, True, width, parts, blocks)
    place = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("score"), "other_id"))
    chosen = cut(met.withColumn("rank", place).where(F.col("rank") <= positives).select("anchor_id", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"), (F.col("rank") - 1).alias("place")))
    # low: the least whole number of which 100 times reaches least * score; high: the largest of which it doesn't exceed most * score.
    hundredth = lambda x: F.expr(f"({x} - pmod({x}, 100L)) div 100")  # noqa: E731  rounded down
    low, high = -hundredth(f"(-{least}L * positive_score)"), hundredth(f"({most}L * positive_score)")
    windows = chosen.withColumn("window", F.struct("place", low.alias("low"), high.alias("high"))).groupBy("anchor_id").agg(F.array_sort(F.collect_list("window")).alias("found"))
    # As many windows for each anchor: one that holds no score stands for a positive that isn't there.
    none = F.struct(bound.alias("low"), (-bound).alias("high"))
    full = F.transform(F.sequence(F.lit(0), F.lit(positives - 1)), lambda i: F.coalesce(F.struct(F.get("found", i)["low"].alias("low"), F.get("found", i)["high"].alias("high")), none))
    full = F.transform(full, lambda w: F.when(w["low"].isNull(), none).otherwise(w))
    asked = anchors.join(windows.withColumn("windows", full).select(F.col("anchor_id").alias("vec_id"), "windows"), "vec_id")
    others = _search(rows, asked, negatives, False, width, parts, blocks)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "other_id"))
    ranked = others.withColumn("rank", rank).where(F.col("rank") <= negatives)
    return ranked.join(chosen, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id, label or vector, or a null or non-finite component, take no part; an id counts once."""
    rows = participants(table(spark, sf_dir, "embeddings"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", shifted))


ORACLE = """
with kept as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0
), scored as (
  select a.vec_id as anchor_id, b.vec_id as other_id, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
  from kept a join kept b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0
), positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5
)
select anchor_id, positive_id, (row_number() over place)::integer as rank, other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window place as (partition by anchor_id, positive_id order by score desc, other_id)
qualify row_number() over place <= 10
"""
