"""Chat formatting with minimum-cost repair of roles."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, table

#: Roles that are written otherwise.
ALIASES = {"human": "user", "prompter": "user", "customer": "user", "gpt": "assistant", "bot": "assistant", "ai": "assistant", "model": "assistant", "developer": "system"}
ROLES = ("system", "user", "assistant")
#: States of the automaton: before any turn, and after a turn of each role. A conversation is at most one
#: system turn, then user and assistant by turns, the user first and the assistant last.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: {"system": SYSTEM, "user": USER}, SYSTEM: {"user": USER}, USER: {"assistant": ASSISTANT}, ASSISTANT: {"user": USER}}
STATE = {"system": SYSTEM, "user": USER, "assistant": ASSISTANT}
#: What a repair costs.
MERGE, RELABEL, INSERT, UNKNOWN = 1.0, 4.0, 2.0, 0.5
#: Turn numbers of one chunk: a long conversation is repaired in chunks, and no task holds it whole.
CHUNK = 256


def moves(role: str | None) -> list[list[tuple[float, int, str, str, tuple[str, ...]]]]:
    """For each state, the ways to take a turn of ``role``: (cost, next state, action, its role, roles inserted before).

    A turn is kept or relabelled where the automaton lets its new role follow, merged into the turn
    before it if that has the role, or has empty turns of the missing roles inserted before it.
    """
    out: list[list[tuple[float, int, str, str, tuple[str, ...]]]] = []
    for state in range(4):
        ways = []
        for new in ROLES:
            known = role in ROLES
            change = 0.0 if new == role else RELABEL if known else UNKNOWN
            name = "keep" if new == role else "relabel"
            if new in NEXT[state]:
                ways.append((change, NEXT[state][new], name, new, ()))
            if STATE[new] == state:
                ways.append((change + MERGE, state, "merge", new, ()))
            for between in ("user", "assistant"):
                if between in NEXT[state] and new in NEXT[NEXT[state][between]]:
                    ways.append((change + INSERT, NEXT[NEXT[state][between]][new], name, new, (between,)))
        out.append(ways)
    return out


_MOVES = {r: moves(r) for r in (*ROLES, None)}
#: Cost to end in each state: an empty answer is appended where a user turn is last, a whole empty exchange after none.
END_COST = {START: 2 * INSERT, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0.0}
END_ROLES = {START: ("user", "assistant"), SYSTEM: ("user", "assistant"), USER: ("assistant",), ASSISTANT: ()}


def canonical(role: str | None) -> str | None:
    low = (role or "").strip().lower()
    low = ALIASES.get(low, low)
    return low if low in ROLES else None


def _step(role: str | None) -> np.ndarray:
    out = np.full((4, 4), np.inf)
    for state, ways in enumerate(_MOVES[role]):
        for cost, to, *_ in ways:
            out[state, to] = min(out[state, to], cost)
    return out


_STEPS = {r: _step(r) for r in _MOVES}


def joined_costs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least costs over two stretches in a row: the product of minima and sums."""
    return (a[:, :, None] + b[None]).min(axis=1)


def costs(roles: list[str | None]) -> np.ndarray:
    """[4, 4]: the least cost of taking all the turns from each state to each state."""
    total = np.where(np.eye(4) == 1, 0.0, np.inf)
    for role in roles:
        total = joined_costs(total, _STEPS[role])
    return total


def best_path(roles: list[str | None], start: int, end: int) -> list[tuple[float, int, str, str, tuple[str, ...]]]:
    """The moves of least cost from one state to another; of equal ones, the first listed."""
    total = np.full(4, np.inf)
    total[start] = 0.0
    back = []
    for role in roles:
        now, came = np.full(4, np.inf), {}
        for state, ways in enumerate(_MOVES[role]):
            for way in ways:
                if total[state] + way[0] < now[way[1]]:
                    now[way[1]] = total[state] + way[0]
                    came[way[1]] = (state, way)
        back.append(came)
        total = now
    path = []
    for came in reversed(back):
        end, way = came[end]
        path.append(way)
    return path[::-1]


def header(role: str) -> str:
    return f"<|im_start|>{role}\n"


FOOTER = "<|im_end|>\n"
_MARK = re.compile(r"<(\\*)\|")


def escaped(text: str) -> str:
    """A text in which no mark of the rendering stands: a backslash is put into ``<|``, one more where some are there already."""
    return _MARK.sub(r"<\1\\|", text)


def unescaped(text: str) -> str:
    """What ``escaped`` was given."""
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def _runs(batches: Iterator[pa.RecordBatch], names: list[str], n: int) -> Iterator[list[tuple]]:
    """Runs of sorted rows that agree in their first ``n`` fields, each whole, over the borders of batches."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if row[:n] != key:
                if rows:
                    yield rows
                key, rows = row[:n], []
            rows.append(row)
    if rows:
        yield rows


def _batch(rows: list[tuple], fields: dict[str, pa.DataType]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, fields.values(), strict=True)], list(fields))


def _written(rows: Iterator[tuple], fields: dict[str, pa.DataType]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == 4096:
            yield _batch(held, fields)
            held = []
    if held:
        yield _batch(held, fields)


def _borders(matrices: list[np.ndarray], enter: int, leave: int) -> list[int]:
    """The states between stretches on a way of least cost from one state to another."""
    left = np.where(np.arange(4) == leave, 0.0, np.inf)
    after = [left]
    for x in reversed(matrices[1:]):
        left = (x + left).min(axis=1)
        after.append(left)
    states = [enter]
    for x, left in zip(matrices, reversed(after), strict=True):
        states.append(int((x[states[-1]] + left).argmin()))
    return states


_CONV = ["none", "c"]
_KEY = {"none": pa.bool_(), "c": pa.int64(), "part": pa.int64()}
_MATRIX = _KEY | {"m": pa.list_(pa.float64())}
_STATES = _KEY | {"enter": pa.int32(), "leave": pa.int32(), "first": pa.bool_(), "final": pa.bool_()}
_SEGMENT = {"conv_id": pa.int64(), "turn": pa.int64(), "seq": pa.int64(), "action": pa.string(), "role": pa.string(), "old_role": pa.string(), "cost": pa.float64(), "text": pa.string(), "segment": pa.string()}
_DDL = {pa.bool_(): "boolean", pa.int64(): "long", pa.int32(): "int", pa.string(): "string", pa.float64(): "double", pa.list_(pa.float64()): "array<double>"}


def _ddl(fields: dict[str, pa.DataType]) -> str:
    return ", ".join(f"{n} {_DDL[t]}" for n, t in fields.items())


def _square(m: list[float]) -> np.ndarray:
    return np.array(m).reshape(4, 4)


def _part(number: str, chunk: int) -> Column:
    return F.expr(f"({number} - pmod({number}, {chunk}L)) div {chunk}L")


def _levels(matrices: DataFrame, chunk: int) -> DataFrame:
    """(none, c, part, enter, leave, first, final): the states around each chunk on a way of least cost.

    Up a tree, matrices of ``chunk`` chunks in a row are joined until a conversation has one; down again,
    each node's two states give those between its children. No task holds more than ``chunk`` of them.
    """
    levels = [matrices]
    farthest = matrices.agg(F.max(F.abs("part"))).first()[0] or 0
    while farthest:
        farthest //= chunk
        up = _part("part", chunk) if farthest else F.lit(0).cast("long")

        def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _written(((*g[0][:3], reduce(joined_costs, [_square(r[3]) for r in g]).ravel().tolist()) for g in _runs(batches, [*_CONV, "up", "m"], 3)), _MATRIX)

        below = levels[-1].withColumn("up", up)
        levels.append(cut(below.repartition(*_CONV, "up").sortWithinPartitions(*_CONV, "up", "part").mapInArrow(join, _ddl(_MATRIX))))

    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = np.array([END_COST[s] for s in range(4)])
        return _written(((*g[0][:3], START, int((_square(g[0][3])[START] + ends).argmin()), True, True) for g in _runs(batches, list(_MATRIX), 3)), _STATES)

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g in _runs(batches, [*_CONV, "up", "part", "m", "enter", "leave", "first", "final"], 3):
                states = _borders([_square(r[4]) for r in g], g[0][5], g[0][6])
                for i, r in enumerate(g):
                    yield (*r[:2], r[3], states[i], states[i + 1], r[7] and i == 0, r[8] and i == len(g) - 1)

        return _written(rows(), _STATES)

    states = levels[-1].mapInArrow(top, _ddl(_STATES))
    for depth in range(len(levels) - 2, -1, -1):
        up = _part("part", chunk) if depth < len(levels) - 2 else F.lit(0).cast("long")
        parents = states.withColumnRenamed("part", "up")
        met = levels[depth].withColumn("up", up).join(parents, [*_CONV, "up"])
        states = met.repartition(*_CONV, "up").sortWithinPartitions(*_CONV, "up", "part").mapInArrow(down, _ddl(_STATES))
    return states


#: Segments that one turn makes at most, those that end the conversation included.
_EACH = 8


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds ``rank``: the row's place in its conversation, from 0.

    Rows are dealt to ranges of their order, so that a conversation of any length spreads over tasks, also if
    its turns have one number or none. A range holds the end of one conversation and the start of another; how
    many rows of its first conversation stand in the ranges before it is counted from a row for each range.
    """
    order = [*_CONV, "t", "old_role", "text", "id"]
    kinds = dict(rows.dtypes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, n = None, 0
        for batch in batches:
            ranks = []
            for now in zip(*(batch.column(c).to_pylist() for c in _CONV), strict=True):
                conv, n = now, n + 1 if now == conv else 0
                ranks.append(n)
            yield batch.append_column("rank", pa.array(ranks, pa.int64()))

    dealt = rows.withColumn("id", F.monotonically_increasing_id())  # tells equal rows apart, in whichever order
    dealt = dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("id").withColumn("dealt", F.spark_partition_id())
    # Written: the bounds of the ranges are drawn from samples, and a task that runs again must not meet others.
    local = cut(dealt.mapInArrow(count, ", ".join(f"{c} {kinds[c]}" for c in rows.columns) + ", dealt int, rank long"))
    runs = local.groupBy("dealt", *_CONV).agg(F.count("*").alias("n"))
    conv, run = F.struct(*_CONV), F.struct(*_CONV, "n")
    ends = runs.groupBy("dealt").agg(F.min_by(run, conv).alias("first"), F.max_by(run, conv).alias("last")).orderBy("dealt").collect()
    before, last, held = [], None, 0
    for r in ends:
        first = (r["first"]["none"], r["first"]["c"])
        here = held if first == last else 0
        before.append((r["dealt"], *first, here))
        end = (r["last"]["none"], r["last"]["c"])
        held, last = (here if end == first else 0) + r["last"]["n"], end
    places = F.broadcast(rows.sparkSession.createDataFrame(before, "dealt int, first_none boolean, first_c long, before long"))  # a row for each range
    goes_on = (F.col("none") == F.col("first_none")) & (F.col("c") == F.col("first_c"))
    found = local.join(places, "dealt").withColumn("rank", F.col("rank") + F.when(goes_on, F.col("before")).otherwise(0))
    return found.drop("dealt", "first_none", "first_c", "before")


def repair(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Segments of all conversations, repaired at the least cost and rendered.

    ``turns`` has conv_id, turn, role and text; other columns are ignored. A row per segment:
    conv_id, turn, seq, action (keep, relabel, merge, insert), role (the new one), old_role, cost, text and
    segment. A conversation's segments joined by ``seq`` are its rendering: each message has a
    header, its text and a footer, and a merged turn continues the message before it after a line break. In
    segments the marks of headers and footers that stand in a text are escaped (``unescaped`` takes that back).

    Roles are compared trimmed and lower-cased, usual aliases included; any other and null are unknown
    and cheap to relabel. Null text is empty. Turns go by number (null last), equal ones by role and text;
    repeated rows are turns of their own, and so usually merged. A null conv_id is a conversation of its
    own. Where several repairs cost the same one is taken by a fixed order. No turns, no rows.

    The cost of taking a chunk of turns between any two states is a matrix, and the least cost of chunks
    in a row is their product of minima and sums: chunks are solved apart, then the states between them,
    then the moves within each. Chunks are made of ``chunk`` turns by their rank in the conversation: no task holds
    more of it, whatever its turns' numbers are.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("old_role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    after_all = (rows.agg(F.max("turn")).first()[0] or 0) + 1
    keyed = rows.select(F.col("conv_id").isNull().alias("none"), F.coalesce("conv_id", F.lit(0)).alias("c"), F.col("turn").isNull().alias("no_turn"), F.coalesce("turn", F.lit(after_all)).alias("t"), "old_role", "text")
    ranked = _ranked(keyed).withColumn("part", _part("rank", chunk))
    keys = [*_CONV, "part"]

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _written(((*g[0][:3], costs([canonical(r[3]) for r in g]).ravel().tolist()) for g in _runs(batches, [*keys, "old_role"], 3)), _MATRIX)

    dealt = ranked.select(*keys, "rank", "old_role").repartition(*keys).sortWithinPartitions(*keys, "rank").select(*keys, "old_role")
    states = _levels(cut(dealt.mapInArrow(solve, _ddl(_MATRIX))), chunk)
    wanted = [*keys, "t", "no_turn", "old_role", "text", "enter", "leave", "first", "final", "rank"]

    def render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for g in _runs(batches, wanted, 3):
                yield from segments(g)

        return _written(rows(), _SEGMENT)

    joined = ranked.join(states, keys).select(*wanted)
    return joined.repartition(*keys).sortWithinPartitions(*keys, "rank").mapInArrow(render, _ddl(_SEGMENT))


def segments(group: list[tuple]) -> list[tuple]:
    """The segments of a chunk's turns (none, c, part, t, no_turn, old_role, text, enter, leave, first, final, rank)."""
    none, conv, _, _, _, _, _, enter, leave, first, final, _ = group[0]
    conv_id = None if none else conv
    out: list[tuple] = []
    opened, seq, turn = not first, 0, None
    path = best_path([canonical(r[5]) for r in group], enter, leave)
    for (_, _, _, t, no_turn, old, text, *_, rank), (cost, _, action, role, inserted) in zip(group, path, strict=True):
        seq, turn = _EACH * rank, None if no_turn else t
        for extra in inserted:
            out.append((conv_id, turn, seq, "insert", extra, None, INSERT, "", (FOOTER if opened else "") + header(extra)))
            opened, seq = True, seq + 1
        start = "\n" if action == "merge" else (FOOTER if opened else "") + header(role)
        out.append((conv_id, turn, seq, action, role, old, cost - INSERT * len(inserted), text, start + escaped(text)))
        opened = True
    if final:
        for extra in END_ROLES[leave]:
            seq += 1
            out.append((conv_id, turn, seq, "insert", extra, None, INSERT, "", FOOTER + header(extra)))
        out[-1] = (*out[-1][:-1], out[-1][-1] + FOOTER)
    return out


def conversations(segments: DataFrame) -> DataFrame:
    """(conv_id, rendered, cost): the segments of each conversation joined, for conversations that fit a row."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "segment")))
    return segments.groupBy("conv_id").agg(F.array_join(parts["segment"], "").alias("rendered"), F.sum("cost").alias("cost"))


def op5_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(table(spark, sf_dir, "conversations"))
