"""Language-model scores: a causal self-attention model of subword ids in numpy, beside a unigram base."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, remainder, table
from .linededup import document_keys
from .packing import encoder

#: Ids, the last one before a text's start and at its end.
VOCABULARY, EDGE = 50_257, 50_256
EDGES = np.array([EDGE], np.int32)
#: Positions of a window, and how many of them, its last, are scored: the others are context only.
WINDOW, STEP = 32, 24
CONTEXT = WINDOW - STEP
#: Width of the attention; classes of ids that the model tells apart; the most frequent ids, each a class of its own.
WIDTH, CLASSES, ALONE = 16, 48, 24
#: Width of what a position asks and answers by.
KEY = 8
#: Neighbours, the most frequent ids, by which the places of all ids are told.
NEIGHBOURS = 32
#: Fitting: ids of a block of training texts, windows of a step, learning rate.
BLOCK, BATCH, RATE = 1 << 20, 128, 0.05
#: Weights are summed over blocks as whole numbers of this size: sums that don't depend on their order.
GRAIN = 2.0**-24
#: Ids whose windows are held at once; a multiple of STEP.
HELD = STEP * 10_000
#: Words whose counts every task gets, the most frequent; the others are joined.
FREQUENT = 200_000
#: Bytes of texts whose words are looked up at once.
TOGETHER = 1 << 23
SMOOTH = 0.1
#: A float's exponent starts at this bit, and 1.0 is that many of them.
UNIT, ZERO = 1 << 23, np.float32(127 << 23)
SCALE = np.float32(UNIT * KEY**-0.5)


def places(counts: np.ndarray, beside: np.ndarray) -> np.ndarray:
    """float32 [ids, WIDTH]: where ids that stand beside the same neighbours are near each other.

    ``beside`` [ids, neighbours] counts neighbours of each id. Its rows as roots of shares are turned to
    their principal axes, weighted by the ids' counts, and stretched to the same deviation; the last coordinate
    is the log of the count.
    """
    share = np.sqrt((beside + 0.01) / (beside + 0.01).sum(axis=1, keepdims=True))
    weight = np.sqrt(counts / counts.sum())
    weight /= weight.sum()
    share -= weight @ share
    _, axes = np.linalg.eigh((share * weight[:, None]).T @ share)
    axes = axes[:, ::-1][:, : WIDTH - 1]
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1, 1)  # signs are arbitrary otherwise
    out = np.zeros((len(counts), WIDTH))
    out[:, : axes.shape[1]] = share @ axes
    out[:, -1] = np.log(counts)
    out -= weight @ out
    deviation = np.sqrt(weight @ out**2)
    return np.round(out / np.where(deviation > 1e-9, deviation, 1), 4).astype(np.float32)


def classes(counts: np.ndarray, before: np.ndarray, turns: int = 8) -> np.ndarray:
    """int64 [ids]: the class of each id: the most frequent alone, the others by weighted means of what stands before them."""
    n = min(CLASSES, len(counts))
    order = np.argsort(-counts, kind="stable")
    alone = order[: min(ALONE, n - 1)]
    rest = order[len(alone) :]
    at, weight = places(counts, before)[rest], np.sqrt(counts[rest])
    k = n - len(alone)
    means = at[:k].astype(np.float64)
    for _ in range(turns):
        near = ((means**2).sum(axis=1) - 2 * at @ means.T).argmin(axis=1)
        sums = np.stack([np.bincount(near, weight * at[:, j], k) for j in range(at.shape[1])], axis=1)
        sizes = np.bincount(near, weight, k)[:, None]
        means = np.where(sizes > 0, sums / np.maximum(sizes, 1e-9), means)
    out = np.zeros(len(counts), np.int64)
    out[alone] = np.arange(len(alone))
    out[rest] = len(alone) + near
    return out


def power(bits: np.ndarray, out: np.ndarray) -> np.ndarray:
    """2**x, between whole x by straight lines, for x given as UNIT * x + ZERO: the number's own bits, written to ``out``, int32."""
    np.copyto(out, bits, casting="unsafe")
    return out.view(np.float32)


def slopes(powers: np.ndarray, out: np.ndarray) -> np.ndarray:
    """The slopes of ``power`` where it has these values, written to ``out``, which may be the same."""
    np.bitwise_and(powers.view(np.int32), np.int32(-UNIT), out=out.view(np.int32))
    return out


class Attention:
    """One causal self-attention layer over windows of ids.

    The next id's probability is that of its class, which the layer gives, times its share of its class.
    Where ids stand (their inputs), classes, shares and how often a class follows another are counted; the layer
    adds to the logs of the latter and is fitted. Before fitting it adds nothing. Both where it looks and
    the classes' odds are ``power`` of linear functions over their sum: as exp would be, at a tenth of its time.
    """

    def __init__(self, counts: np.ndarray, place: np.ndarray, of: np.ndarray, follow: np.ndarray, seed: int = 0):
        """``counts``: of ids, 1 at least; ``place``, ``of``: their places and classes; ``follow`` [class, class]: how often the second follows the first."""
        rng = np.random.default_rng(seed)
        self.place, self.of = place, of.astype(np.int32)
        totals = np.bincount(of, counts, len(follow))
        self.share = np.log2(counts / totals[of])
        prior = np.maximum(totals, 1) / np.maximum(totals, 1).sum()
        odds = (follow + 5 * prior) / (follow.sum(axis=1, keepdims=True) + 5)
        whole = np.floor(np.log2(odds))
        self.follow = ((whole + odds / 2**whole - 1) * UNIT + ZERO).astype(np.float32)
        normal = lambda *shape: (rng.standard_normal(shape) * shape[-2] ** -0.5).astype(np.float32)
        self.weights = {"position": normal(WINDOW, WIDTH) * np.float32(0.3), "project": normal(WIDTH, 2 * KEY + 2 * WIDTH), "out": np.zeros((WIDTH, len(follow)), np.float32)}
        below = np.tril(np.ones((WINDOW, WINDOW), bool))[CONTEXT:]
        self.low, self.high = (np.where(below, ZERO + bound, 0).astype(np.float32) for bound in (-60 * UNIT, 60 * UNIT))
        self.rooms = {}

    def room(self, name: str, *shape: int, kind: type = np.float32) -> np.ndarray:
        """An array to write to, the same one for each batch, so that memory is neither asked for nor given back."""
        held = self.rooms.get((name, kind))
        if held is None or len(held) < shape[0] or held.shape[1:] != shape[1:]:
            held = self.rooms[name, kind] = np.empty(shape, kind)
        return held[: shape[0]]

    def look(self, windows: np.ndarray) -> dict[str, np.ndarray]:
        """What the layer computes of ids [n, WINDOW], up to the odds of the classes at the scored positions; valid until the next call.

        What a position asks of another is ``x @ ask @ answer.T @ x.T``, and a mean of projected values is the projected
        mean: so only scored positions are projected, and the others are met as they stand.
        """
        w, n = self.weights, len(windows)
        rows, project, room = n * STEP, w["project"], partial(self.room, kind=np.result_type(*w.values()).type)
        x = self.place.take(windows, axis=0, out=self.room("x", n, WINDOW, WIDTH), mode="clip")
        x += w["position"]
        both = room("both", n, STEP, 2 * WIDTH)  # means of what is looked at, and the positions themselves
        both[..., WIDTH:] = x[:, CONTEXT:]
        flat = both.reshape(rows, -1)
        ask = np.matmul(flat[:, WIDTH:], project[:, :KEY] @ project[:, KEY : 2 * KEY].T * SCALE, out=room("ask", rows, WIDTH))
        s = np.matmul(ask.reshape(n, STEP, -1), x.transpose(0, 2, 1), out=room("s", n, STEP, WINDOW))
        s += ZERO
        np.maximum(s, self.low, out=s)
        np.minimum(s, self.high, out=s)  # nothing of later positions
        p = power(s, self.room("p", n, STEP, WINDOW, kind=np.int32))
        total = np.matmul(p.reshape(rows, -1), np.ones(WINDOW, np.float32), out=room("total", rows)).reshape(n, STEP, 1)
        np.divide(np.matmul(p, x, out=room("y", n, STEP, WIDTH)), total, out=both[..., :WIDTH])
        h = np.matmul(flat, project[:, 2 * KEY :].reshape(WIDTH, 2, WIDTH).transpose(1, 0, 2).reshape(2 * WIDTH, WIDTH), out=room("h", rows, WIDTH))
        bent = np.abs(h, out=room("bent", rows, WIDTH))
        bent += 1
        h /= bent
        number = self.follow.shape[1]
        z = np.matmul(h, w["out"] * UNIT, out=room("z", rows, number))
        z += self.follow.take(self.of.take(windows[:, CONTEXT:].ravel()), axis=0, out=self.room("classes", rows, number), mode="clip")
        odds = power(z, self.room("odds", rows, number, kind=np.int32))
        return {"x": x, "both": both, "ask": ask, "p": p, "total": total, "bent": bent, "h": h, "odds": odds, "sum": odds @ np.ones(number, np.float32)}

    def log_probabilities(self, windows: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Logs to base 2 of the probabilities of ids [n, STEP], the next ones of the scored positions of ids [n, WINDOW]."""
        c, goal = self.look(windows), targets.ravel()
        odds = c["odds"]
        found = odds.ravel().take(np.arange(0, odds.size, odds.shape[1]) + self.of.take(goal))
        return (np.log2(found / c["sum"]) + self.share.take(goal)).reshape(targets.shape)

    def gradients(self, windows: np.ndarray, targets: np.ndarray, counted: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss (natural) where ``counted``, by the weights."""
        w, c = self.weights, self.look(windows)
        n, rows, odds, x, p, total = len(windows), len(windows) * STEP, c["odds"], c["x"], c["p"], c["total"]
        room, flat, project = partial(self.room, kind=c["h"].dtype.type), c["both"].reshape(rows, -1), w["project"]
        asked, answered, value, own = project[:, :KEY], project[:, KEY : 2 * KEY], project[:, 2 * KEY : -WIDTH], project[:, -WIDTH:]
        dz = slopes(odds, self.room("classes", *odds.shape))
        goal = np.arange(0, odds.size, odds.shape[1]) + self.of.take(targets.ravel())
        dz.ravel()[goal] -= dz.ravel().take(goal) / odds.ravel().take(goal) * c["sum"]
        dz *= (counted.ravel() * np.float32(1 / max(1, counted.sum())) / c["sum"])[:, None]
        dh = np.matmul(dz, w["out"].T, out=room("dh", rows, WIDTH))
        dh /= c["bent"]
        dh /= c["bent"]
        mixed = flat.T @ dh
        da = np.matmul(dh, value.T, out=room("da", rows, WIDTH)).reshape(n, STEP, -1)
        da /= total
        shared = np.multiply(da, c["both"][..., :WIDTH], out=room("y", n, STEP, WIDTH)).reshape(rows, -1) @ np.ones(WIDTH, np.float32)
        ds = np.matmul(da, x.transpose(0, 2, 1), out=room("s", n, STEP, WINDOW))
        ds -= shared.reshape(n, STEP, 1)  # of the sum that all positions share
        position = p.reshape(rows, -1).T @ da.reshape(rows, -1)
        ds *= slopes(p, p)
        position += ds.reshape(rows, -1).T @ c["ask"] * np.float32(1 / UNIT)
        y = np.matmul(ds, x, out=room("y", n, STEP, WIDTH))
        y *= SCALE / UNIT
        met = flat[:, WIDTH:].T @ y.reshape(rows, -1)
        each = np.ones(n, np.float32)
        position[CONTEXT:] += (each @ y.reshape(n, -1)).reshape(STEP, -1) @ (answered @ asked.T) + (each @ dh.reshape(n, -1)).reshape(STEP, -1) @ own.T
        return {"position": position, "project": np.concatenate([met @ answered, met.T @ asked, mixed[:WIDTH], mixed[WIDTH:]], axis=1), "out": c["h"].T @ dz}

    def fit(self, windows: np.ndarray, targets: np.ndarray, counted: np.ndarray, past: dict[str, np.ndarray]) -> None:
        """One pass of Adagrad over the windows, in their order; ``past`` goes on from the passes before."""
        for i in range(0, len(windows), BATCH):
            for k, g in self.gradients(windows[i : i + BATCH], targets[i : i + BATCH], counted[i : i + BATCH]).items():
                past[k] += g * g
                self.weights[k] -= RATE * g / np.sqrt(past[k])
            np.clip(self.weights["out"], -2, 2, out=self.weights["out"])  # keeps the odds within what floats hold

    def unfitted(self) -> tuple[Attention, dict[str, np.ndarray]]:
        """(a copy whose weights may change, sums of squared gradients before the first step)."""
        out = Attention.__new__(Attention)
        out.__dict__ = self.__dict__ | {"weights": {k: v.copy() for k, v in self.weights.items()}, "rooms": {}}
        return out, {k: np.full(v.shape, 1e-6, np.float32) for k, v in self.weights.items()}


def cut_windows(lines: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(windows, targets, counted, line): overlapping windows of lines of CONTEXT + 1 ids before and ids that are each a target once."""
    sizes = np.array([len(x) for x in lines]) - CONTEXT - 1
    number = -(-sizes // STEP)
    width = number * STEP + CONTEXT + 1
    ends = np.cumsum(width)
    every = np.full(ends[-1], EDGE, np.int32)
    for x, at in zip(lines, (ends - width).tolist(), strict=True):
        every[at : at + len(x)] = x
    line = np.repeat(np.arange(len(lines)), number)
    order = np.arange(len(line)) - np.repeat(np.cumsum(number) - number, number)
    first = (ends - width)[line] + order * STEP
    counted = (order * STEP)[:, None] + np.arange(STEP) < sizes[line][:, None]
    return sliding_window_view(every, WINDOW)[first], sliding_window_view(every, STEP)[first + CONTEXT + 1], counted, line


def lines_of(ids: np.ndarray) -> list[np.ndarray]:
    """A text's ids and its end, edges before, cut every HELD ids with what stands before them: windows are those of the whole."""
    whole = np.full(len(ids) + CONTEXT + 2, EDGE, np.int32)
    whole[CONTEXT + 1 : -1] = ids
    return [whole[k : k + HELD + CONTEXT + 1] for k in range(0, len(ids) + 1, HELD)]


def held_together(texts: Iterable[np.ndarray]) -> Iterator[tuple[list[np.ndarray], list[int]]]:
    """(lines, the text each belongs to, numbered from 0): of about HELD ids together, also where one text has more."""
    lines, of, size = [], [], 0
    for i, t in enumerate(texts):
        for x in lines_of(t):
            lines.append(x)
            of.append(i)
            size += len(x)
            if size > HELD:
                yield lines, of
                lines, of, size = [], [], 0
    if lines:
        yield lines, of


def score_texts(model: Attention, texts: list[np.ndarray]) -> np.ndarray:
    """log10 probabilities of texts given as ids."""
    total = np.zeros(len(texts))
    for lines, of in held_together(texts):
        windows, targets, counted, line = cut_windows(lines)
        text = np.array(of)[line]
        for i in range(0, len(windows), BATCH):
            part = slice(i, i + BATCH)
            logs = np.where(counted[part], model.log_probabilities(windows[part], targets[part]), 0)
            np.add.at(total, text[part], logs.sum(axis=1, dtype=np.float64))
    return total * math.log10(2)


def _binary(docs: DataFrame, *keys) -> DataFrame:
    """Keys and the text as bytes; null stays null."""
    return docs.select(*keys, F.col("text").cast("string").cast("binary").alias("text"))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(A-Z lower-cased words of all texts, the text each is of), parted by white space of ASCII; null has none."""
    texts = pc.ascii_trim_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    full = np.flatnonzero(pc.binary_length(texts).fill_null(0))
    lists = pc.ascii_split_whitespace(texts.take(pa.array(full)))
    return lists.flatten(), np.repeat(full.astype(np.int32), np.diff(lists.offsets))


def sliced(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows, about TOGETHER bytes at once."""
    for batch in batches:
        rows = max(1, batch.num_rows * TOGETHER // max(1, batch.nbytes))
        yield from (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of ``docs``, A-Z lower-cased: counted in the tasks first, then summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = words_of(batch.column("text"))[0].value_counts()
            yield pa.RecordBatch.from_arrays([counts.field("values"), counts.field("counts")], ["word", "n"])

    return _binary(docs).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def tokenized(docs: DataFrame) -> DataFrame:
    """(k1, k2, doc_id, n, ids): document key, id, number of ids and the lower-cased whole text's ids, two bytes each, of every row."""
    k1, k2 = document_keys(F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = partial(encoder().encode_to_numpy, disallowed_special=())  # a literal end mark is text
        for batch in batches:
            ids = [encode(t.lower().decode()).astype("<u2") if t else np.zeros(0, "<u2") for t in batch.column("text").to_pylist()]
            sizes = np.array([len(x) for x in ids], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(sizes), pa.array([x.tobytes() for x in ids], pa.binary())], ["k1", "k2", "doc_id", "n", "ids"])

    return _binary(docs, k1.alias("k1"), k2.alias("k2"), F.col("doc_id").cast("long")).mapInArrow(run, "k1 long, k2 long, doc_id long, n long, ids binary")


def _read(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    return (np.frombuffer(x.as_buffer(), "<u2").astype(np.int32) for x in batch.column("ids"))


def _summed(tokens: DataFrame, size: int, of: Callable[[np.ndarray], Iterable[np.ndarray]]) -> np.ndarray:
    """How often each number below ``size`` is among those that ``of`` makes of texts (ids between two edges): counted in the tasks, then summed.

    ``size`` is bounded by the vocabulary, whatever the corpus.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(size, np.int64), [], 0

        def add() -> None:
            for x in of(np.concatenate(held).astype(np.int64)):
                total[:] += np.bincount(x, minlength=size)

        for batch in batches:
            for ids in _read(batch):
                held += [EDGES, ids]
                n += len(ids)
                if n > 1 << 21:
                    add()
                    held, n = [], 0
        if held:
            held.append(EDGES)
            add()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["at", "n"])

    counts = np.zeros(size, np.int64)
    found = tokens.select("ids").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    counts[found.column("at").to_numpy()] = found.column("n").to_numpy()
    return counts


def train(tokens: DataFrame) -> Attention:
    """A model of the texts of (k1, k2, n, ids): all their ids are counted, and its layer is fitted on all of them.

    Texts are dealt by a hash to blocks of about BLOCK ids, as many as the corpus needs, and sorted within. Each
    block fits the layer from the same start, text after text, and the weights become the mean over blocks. So
    neither partitions nor lost executors change the model. What reaches the driver is bounded by the vocabulary.
    """
    counts = _summed(tokens, VOCABULARY, lambda line: (line[1:],)) + 1
    column = np.full(VOCABULARY, NEIGHBOURS)
    column[np.argsort(-counts, kind="stable")[:NEIGHBOURS]] = np.arange(NEIGHBOURS)
    each = NEIGHBOURS + 1
    beside = _summed(tokens, VOCABULARY * 2 * each, lambda line: (line[1:] * (2 * each) + column[line[:-1]], line[:-1] * (2 * each) + each + column[line[1:]]))
    beside = beside.reshape(VOCABULARY, 2 * each)
    of = classes(counts, beside[:, :each])
    number = int(of.max()) + 1
    follow = _summed(tokens, number * number, lambda line: (of[line[:-1]] * number + of[line[1:]],)).reshape(number, number)
    model = Attention(counts, places(counts, beside), of, follow)
    return fitted(model, tokens, max(1, round(int(counts.sum() - VOCABULARY) / BLOCK)))


def fitted(model: Attention, tokens: DataFrame, blocks: int) -> Attention:
    """The model with the mean of the weights that ``blocks`` parts of the texts lead to."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        start = shared.value
        sums, n = {k: np.zeros(v.shape, np.int64) for k, v in start.weights.items()}, 0
        rows = (row for batch in batches for row in zip(batch.column("block").to_pylist(), _read(batch), strict=True))
        for _, texts in groupby(rows, lambda row: row[0]):
            own, past = start.unfitted()
            for lines, _ in held_together(ids for _, ids in texts):
                windows, targets, counted, _ = cut_windows(lines)
                order = np.random.default_rng(len(windows)).permutation(len(windows))
                own.fit(windows[order], targets[order], counted[order], past)
            for k, total in sums.items():
                total += np.round((own.weights[k].astype(np.float64) - start.weights[k]) / GRAIN).astype(np.int64)
            n += 1
        if n:
            flat = np.concatenate([*[x.ravel() for x in sums.values()], [n]])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["at", "change"])

    block = F.pmod(F.xxhash64("k1", "k2"), F.lit(blocks)).cast("int").alias("block")
    dealt = tokens.select(block, "k1", "k2", "ids").repartition(min(blocks, 1 << 14), "block").sortWithinPartitions("block", "k1", "k2")
    found = dealt.mapInArrow(run, "at long, change long").groupBy("at").agg(F.sum("change").alias("change")).orderBy("at").toArrow()
    changes = found.column("change").to_numpy()
    if len(changes):
        mean, at = changes[:-1] / changes[-1] * GRAIN, 0
        for k, w in model.weights.items():
            model.weights[k] = (w + mean[at : at + w.size].reshape(w.shape)).astype(np.float32)
            at += w.size
    shared.unpersist()
    return model


def base_scores(docs: DataFrame, counts: DataFrame, texts: int, frequent: int = FREQUENT) -> tuple[DataFrame, int]:
    """((k1, k2, n_tokens, n_known, base_score) per document key, training tokens).

    The unigram model is that of ``counts`` (word, n) over all words of ``texts`` training documents. The
    counts of at most ``frequent`` words, the most frequent classes, go to all tasks; the other words, none of which is hot, are joined.
    """
    counts = counts.withColumn("class", F.floor(F.log2(F.col("n").cast("double")) * 64))
    each = sorted(counts.groupBy("class").agg(F.count("*").alias("v"), F.sum("n").alias("n")).collect(), reverse=True)
    tokens, distinct = sum(r.n for r in each) + texts, sum(r.v for r in each) + (texts > 0)
    least, kept = None, 0
    for r in each:
        if kept + r.v > frequent:
            break
        least, kept = r["class"], kept + r.v
    hot = counts.where(F.col("class") >= least).select("word", "n").toArrow().combine_chunks() if kept else None
    frequent_words = hot.column("word").combine_chunks() if kept else pa.array([], pa.string())
    logs = np.append(np.log10(hot.column("n").to_numpy() + SMOOTH), 0.0) if kept else np.zeros(1)
    shared = docs.sparkSession.sparkContext.broadcast((frequent_words, logs))
    end = math.log10(texts + SMOOTH)
    k1, k2 = document_keys(F.col("doc_id"), F.col("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, logs = shared.value
        for batch in sliced(batches):
            words, of = words_of(batch.column("text"))
            number = np.bincount(of, minlength=batch.num_rows)
            at = pc.index_in(words, value_set=known).fill_null(len(known)).to_numpy()
            sums = np.bincount(of, logs.take(at), batch.num_rows) + end
            other = np.flatnonzero(at == len(known))
            rare = words.take(pa.array(other)).dictionary_encode()
            each = max(1, len(rare.dictionary))
            pairs, times = np.unique(of[other].astype(np.int64) * each + rare.indices.to_numpy(), return_counts=True)
            found = number - np.bincount(of[other], minlength=batch.num_rows) + (texts > 0)
            # A document's first row has what its frequent words add. No word has a space, so it meets none.
            first = pa.array([" %d" % key for key in batch.column("k2").to_pylist()], pa.string())
            spread = lambda x: pa.array(np.concatenate([x, np.zeros(len(pairs), x.dtype)]))  # noqa: E731  zero but in first rows
            keys = [pa.array(np.concatenate([x, x[pairs // each]])) for x in (batch.column(k).to_numpy() for k in ("k1", "k2"))]
            yield pa.RecordBatch.from_arrays(
                [*keys, pa.concat_arrays([first, rare.dictionary.take(pa.array(pairs % each))]), pa.array(np.concatenate([np.zeros(batch.num_rows, np.int64), times])), spread(sums), spread(found), spread(number + 1)],
                ["k1", "k2", "word", "times", "logs", "found", "tokens"],
            )

    rows = _binary(docs, k1.alias("k1"), k2.alias("k2")).mapInArrow(run, "k1 long, k2 long, word string, times long, logs double, found long, tokens long")
    others = counts.where(F.col("class") < least) if kept else counts
    met = rows.join(others.select("word", "n"), "word", "left")
    added = F.when(F.col("times") == 0, F.col("logs")).otherwise(F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + SMOOTH))
    each = met.groupBy("k1", "k2").agg(
        F.sum(F.when(F.col("times") == 0, 1).otherwise(0)).alias("same"), F.sum("tokens").alias("tokens"),
        F.sum(F.col("found") + F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("found"), F.sum(added).alias("logs"),
    )
    whole = F.log10(F.lit(tokens + SMOOTH * (distinct + 1)))
    per = lambda c: F.expr(f"{c} div same")  # noqa: E731  rows of the same id and text were summed together
    return each.select("k1", "k2", per("tokens").alias("n_tokens"), per("found").alias("n_known"), (F.col("logs") / F.col("same") - per("tokens") * whole).alias("base_score")), tokens


def model_scores(tokens: DataFrame, model: Attention) -> DataFrame:
    """(k1, k2, doc_id, score): the log10 probability of every whole text of (k1, k2, doc_id, ids), its end included."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = score_texts(shared.value, list(_read(batch)))
                yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), batch.column("doc_id"), pa.array(scores)], ["k1", "k2", "doc_id", "score"])

    return tokens.select("k1", "k2", "doc_id", "ids").mapInArrow(run, "k1 long, k2 long, doc_id long, score double")


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_tokens, n_known, train_tokens, base_score and score, of models of ``training``.

    ``base_score`` is the unigram log10 probability of the words and one end, ``score`` the attention
    model's of the lower-cased text's ids and the end. Null text is empty; a null doc_id stays null;
    repeated rows each give a row, with equal values; other columns are ignored. No training documents:
    nothing is known, and every id is as likely as any other. No documents, no rows.
    """
    return _score(docs, training, cut(tokenized(docs)), cut(tokenized(training)))


def _score(docs: DataFrame, training: DataFrame, tokens: DataFrame, training_tokens: DataFrame) -> DataFrame:
    words, texts = cut(word_counts(training)), training.count()
    base, learned = base_scores(docs, words, texts)
    joined = model_scores(tokens, train(training_tokens)).join(base, ["k1", "k2"])
    return joined.select("doc_id", "n_tokens", "n_known", F.lit(learned).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 10) == 0
    tokens = cut(tokenized(docs))  # counted, fitted and scored
    return _score(docs, docs.where(~held_out), tokens, tokens.where(~held_out)).withColumn("held_out", held_out)
