"""Messages of TCP streams: segments in order, overlaps trimmed, cut by the protocol's own lengths.

A direction is walked with one message in hand. Where no head stands (a stream caught midway, bytes lost, a
body without a length), the walk goes on at the next plausible head; what it passes over is handed on as
it is, so that no bytes are lost and no message after them either.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tracker import unwrapped

# The ports whose streams are cut into messages, by the way they are cut.
FRAMED = {
    "text": [5060, 5061, 80, 8080, 8000, 8888, 3000],
    "tls": [443, 8443, 993, 995, 465, 636],
    "diameter": [3868],
    "ajp": [8009],
}
#: Bytes of a message that are kept: of a longer one the first so many, with its whole length in payload_len.
LARGEST = 1 << 20
#: Bytes of a first line at most; a line that isn't ended by then starts no message.
LINE = 8192
#: Bytes of a record of TLS at most: a ciphertext and what may be added to it.
RECORD = 16384 + 2048
_DIRECTION = ["job_id", "src_ip", "src_port", "dst_ip", "dst_port"]
_METHOD = rb"(?:GET|POST|PUT|DELETE|HEAD|OPTIONS|PATCH|TRACE|CONNECT|INVITE|ACK|BYE|CANCEL|REGISTER|PRACK|SUBSCRIBE|NOTIFY|PUBLISH|INFO|REFER|MESSAGE|UPDATE)"
_HEAD = re.compile(rb"(?:HTTP/1\.[01]|SIP/2\.0) \d{3}[ \r]|" + _METHOD + rb" [^\s]+ (?:HTTP/1\.[01]|SIP/2\.0)\r?\n")
_BEGUN = re.compile(rb"(?:[A-Z]{1,12}|" + _METHOD + rb" [^\s]*(?: [A-Z/0-9.]{0,8})?|(?:HTTP|SIP)(?:/[0-9.]{0,3}(?: \d{0,3})?)?)\r?\Z")
_LENGTH = re.compile(rb"(?im)^(?:content-length|l)[ \t]*:[ \t]*(\d+)")
_CHUNKED = re.compile(rb"(?im)^transfer-encoding[ \t]*:[^\r\n]*chunked")
_UPGRADE = re.compile(rb"(?im)^upgrade[ \t]*:[ \t]*websocket")

#: What stands at the start of some bytes: ("skip", n) bytes that start no message, ("message", n), or ("wait", None).
Found = tuple[str, int | None]


def _chunks(data: bytes, at: int) -> int | None:
    """Where a chunked body that starts at ``at`` ends; None if it goes on, -1 if it isn't one."""
    while True:
        line = data.find(b"\r\n", at, at + 64)
        if line < 0:
            return None if len(data) - at < 64 else -1
        try:
            size = int(data[at:line].split(b";")[0].strip(), 16)
        except ValueError:
            return -1
        at = line + 2
        if size == 0:  # trailers, up to an empty line
            while True:
                line = data.find(b"\r\n", at)
                if line < 0:
                    return None
                if line == at:
                    return at + 2
                at = line + 2
        at += size + 2
        if at > len(data):
            return None


def text(data: bytes) -> Found:
    """A message of a text protocol: its head, and the body by length or by chunks."""
    head = _HEAD.search(data)
    if head is None:
        begun = _BEGUN.search(data, max(len(data) - LINE, 0))  # a first line that isn't whole yet
        if begun is None:
            return "skip", len(data)
        return ("skip", begun.start()) if begun.start() else ("wait", None)
    if head.start():
        return "skip", head.start()
    end = data.find(b"\r\n\r\n")
    if end < 0:
        return "wait", None
    if _CHUNKED.search(data, 0, end + 2):
        stop = _chunks(data, end + 4)
        return ("message", end + 4) if stop == -1 else ("wait", None) if stop is None else ("message", stop)
    found = _LENGTH.search(data, 0, end + 2)
    return "message", end + 4 + (int(found.group(1)) if found else 0)


def websocket(data: bytes) -> Found:
    """A frame: two bytes, a longer length and a mask where they say so, and the payload."""
    if len(data) < 2:
        return "wait", None
    size, at = data[1] & 127, 2
    if size > 125:
        more = 2 if size == 126 else 8
        if len(data) < 2 + more:
            return "wait", None
        size, at = int.from_bytes(data[2 : 2 + more], "big"), 2 + more
    return "message", at + (4 if data[1] & 128 else 0) + size


def _binary(head: int, size: Callable[[bytes], int | None], mark: bytes) -> Callable[[bytes], Found]:
    """Messages with a head of ``head`` bytes, of which ``size`` gives the whole length, or None where none stands."""
    search = re.compile(mark, re.DOTALL)

    def stands(data: bytes, at: int) -> bool | None:
        """Whether a message stands there whole, with another or nothing behind it; None if it may go on."""
        n = size(data[at : at + head])
        if n is None or n < head:
            return False
        if at + n > len(data):
            return None
        after = data[at + n : at + n + head]
        return len(after) < head or size(after) is not None

    def of(data: bytes) -> Found:
        if len(data) < head:
            return "wait", None
        n = size(data[:head])
        if n is not None and n >= head:
            return "message", n
        maybe = len(data)
        for m in search.finditer(data, 1):
            found = None if m.start() + head > len(data) else stands(data, m.start())
            if found:
                return "skip", m.start()
            if found is None:
                maybe = min(maybe, m.start())
        return "skip", maybe

    return of


def _tls(d: bytes) -> int | None:
    n = 5 + int.from_bytes(d[3:5], "big")
    return n if d[0] in (20, 21, 22, 23) and d[1] == 3 and d[2] <= 4 and n <= 5 + RECORD else None


def _diameter(d: bytes) -> int | None:
    n = int.from_bytes(d[1:4], "big")
    return n if d[0] == 1 and n % 4 == 0 and n >= 20 and d[4] & 15 == 0 else None


def _ajp(d: bytes) -> int | None:
    return 4 + int.from_bytes(d[2:4], "big") if d[:2] in (b"\x12\x34", b"AB") else None


#: Bytes of a head and the length that it tells, of binary protocols.
SIZES: dict[str, tuple[int, Callable[[bytes], int | None]]] = {"tls": (5, _tls), "diameter": (20, _diameter), "ajp": (4, _ajp)}
FRAMERS: dict[str, Callable[[bytes], Found]] = {
    "text": text,
    "tls": _binary(*SIZES["tls"], rb"[\x14-\x17]\x03"),
    "diameter": _binary(*SIZES["diameter"], rb"\x01"),
    "ajp": _binary(*SIZES["ajp"], rb"\x12\x34|AB"),
    "websocket": websocket,
}
#: The bytes of a message, its whole length, and what the first and last piece carried.
Message = tuple[bytes, int, object, object]


class Stream:
    """One direction of a connection. ``add`` and ``end`` give the messages that are whole, or left."""

    def __init__(self, framer: str, largest: int = LARGEST) -> None:
        self.framer, self.largest = framer, largest
        self.held, self.size, self.owed, self.asked = bytearray(), None, 0, False
        self.pieces: list[tuple[int, object]] = []  # bytes of each piece that are still held, and what came with it

    def add(self, data: bytes, carried: object) -> list[Message]:
        out: list[Message] = []
        if not data:
            return out
        if self.owed:  # the rest of a message of which enough is kept
            gone = min(self.owed, len(data))
            self.owed -= gone
            data = data[gone:]
        if not self.held:
            data = self._whole(data, carried, out)
        if not data:
            return out
        self.held += data
        self.pieces.append((len(data), carried))
        while self.held:
            if self.size is None:
                kind, n = self._found(bytes(self.held))
                if kind == "wait":
                    if len(self.held) <= self.largest:
                        break
                    kind, n = "skip", len(self.held)  # a body in chunks, or a head, that doesn't end: the next head is searched
                if kind == "skip":
                    out.append(self._take(n, n))
                    continue
                self.size = n
            if len(self.held) < min(self.size, self.largest + 1):
                break
            kept = min(len(self.held), self.size)
            self.owed = self.size - kept
            if self.size > self.largest:
                out.append(self._take(kept, self.size, self.largest))
            else:
                out.append(self._take(kept, self.size))
        return out

    def _whole(self, data: bytes, carried: object, out: list[Message]) -> bytes:
        """Adds the messages that stand whole in a piece, where nothing is held, to ``out``; the bytes after them."""
        at, there = 0, len(data)
        if self.framer in SIZES:
            head, size = SIZES[self.framer]
            while there - at >= head:
                n = size(data[at : at + head])
                if n is None or not head <= n <= self.largest or at + n > there:
                    break
                out.append((data[at : at + n], n, carried, carried))
                at += n
            return data[at:]
        while data:
            kind, n = self._found(data)
            if kind == "wait" or n > min(len(data), self.largest):
                break
            out.append((self._told(data[:n]), n, carried, carried))
            data = data[n:]
        return data

    def _found(self, data: bytes) -> Found:
        if self.framer == "text" and self.asked and not 65 <= data[0] <= 90:  # no letter: the upgrade was taken
            self.framer = "websocket"
        return FRAMERS[self.framer](data)

    def _told(self, out: bytes) -> bytes:
        """``out``, after noting whether it asks for an upgrade."""
        if self.framer == "text" and _HEAD.match(out):
            self.asked = bool(_UPGRADE.search(out, 0, max(out.find(b"\r\n\r\n"), 0) + 2))
        return out

    def _take(self, n: int, size: int, most: int | None = None) -> Message:
        out, self.size = bytes(self.held[:n]), None
        del self.held[:n]
        first = last = self.pieces[0][1]
        while n:
            there, carried = self.pieces[0]
            last = carried
            taken = min(there, n)
            n -= taken
            if taken == there:
                self.pieces.pop(0)
            else:
                self.pieces[0] = (there - taken, carried)
        return self._told(out)[:most], size, first, last

    def end(self) -> list[Message]:
        """What is left at a gap or at the end."""
        left = [self._take(len(self.held), len(self.held), self.largest)] if self.held else []
        self.owed, self.size = 0, None
        return left


def in_order(packets: DataFrame) -> DataFrame:
    """TCP packets with payload of framed ports: place in their direction, what is new of them, and whether bytes before are missing."""
    near = lambda ports: F.col("src_port").isin(ports) | F.col("dst_port").isin(ports)
    kind = F.coalesce(*[F.when(near(ports), name) for name, ports in FRAMED.items()])
    own = packets.where("protocol = 'TCP' and payload_len > 0").withColumn("framer", kind).where("framer is not null")
    way = Window.partitionBy(*_DIRECTION)
    placed = own.withColumn("first", F.min_by("seq", "frame_number").over(way)).withColumn("pos", unwrapped(F.col("seq"), F.col("first"))).drop("first")
    ends = way.orderBy("pos", "frame_number").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max(F.col("pos") + F.col("payload_len")).over(ends)
    skip = F.greatest(F.lit(0), F.coalesce(F.col("before") - F.col("pos"), F.lit(0)))
    met = placed.withColumn("before", before).withColumn("skip", skip.cast("int"))
    fresh = met.where(F.col("skip") < F.col("payload_len"))
    gap = F.coalesce(F.col("pos") > F.col("before"), F.lit(False))
    return fresh.withColumns({"payload": F.expr("substring(payload, skip + 1)"), "gap": gap}).drop("before", "skip")


def listed(column: pa.Array) -> list:
    return column.to_pylist() if column.null_count else column.to_numpy(zero_copy_only=False).tolist()


def begun(keys: list[pa.Array]) -> list[bool]:
    """Whether a row's values differ from the row's before it; those of the first row don't count."""
    out = np.zeros(len(keys[0]), bool)
    for k in keys:
        value = k.dictionary_encode().indices.fill_null(-1).to_numpy()
        out[1:] |= value[1:] != value[:-1]
    return out.tolist()


def messages(packets: DataFrame, largest: int = LARGEST) -> DataFrame:
    """Rows like ``packets`` and ``part``, one per message: the fields of the packet that it starts in, with its whole payload.

    A message has the time of the packet that completes it; ``part`` counts the messages that start in the
    same packet, from 0. Bytes after a gap start anew, and what was before the gap, or is left at the end,
    is handed on incomplete, as are bytes between two messages. Of a message of more than ``largest`` bytes the first
    so many are kept, and payload_len is the length that its head says; the messages after it are whole. A
    stream is walked in order with one message in hand, in the task that has its direction.
    """
    columns = list(packets.columns)
    kinds = dict(packets.dtypes)
    ordered = in_order(packets).repartition(*_DIRECTION).sortWithinPartitions(*_DIRECTION, "pos", "frame_number")

    told = [c for c in columns if c != "payload"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, stream, frame, part, held = None, None, None, 0, None
        payloads, sizes, firsts, lasts, parts = found = [], [], [], [], []  # rows of the first and the last packet

        def cut(messages: list[Message]) -> None:
            nonlocal frame, part
            for data, size, first, last in messages:
                part = part + 1 if frames[first] == frame else 0
                frame = frames[first]
                payloads.append(data), sizes.append(size), firsts.append(first), lasts.append(last), parts.append(part)

        def out(rows: pa.Table) -> pa.RecordBatch:
            first, last = pa.array(firsts, pa.int64()), pa.array(lasts, pa.int64())
            own = {"payload": pa.array(payloads, pa.binary()), "payload_len": pa.array(sizes, rows.schema.field("payload_len").type), "timestamp": rows["timestamp"].chunk(0).take(last), "part": pa.array(parts, pa.int32())}
            for x in found:
                x.clear()
            return pa.RecordBatch.from_arrays([own[c] if c in own else rows[c].chunk(0).take(first) for c in [*columns, "part"]], [*columns, "part"])

        for batch in filter(len, batches):
            # Packets of which bytes are held stand before the batch, without their payload.
            rows = pa.Table.from_batches([batch.select(told)] if held is None else [held, batch.select(told)]).combine_chunks()
            frames, before, keys = listed(rows["frame_number"].chunk(0)), len(rows) - len(batch), [batch.column(c) for c in _DIRECTION]
            begins = begun(keys)
            begins[0] = tuple(k[0].as_py() for k in keys) != key
            for i, (starts, gap, data, framer) in enumerate(zip(begins, *(listed(batch.column(c)) for c in ("gap", "payload", "framer")), strict=True), before):
                if starts:
                    if stream and stream.held:
                        cut(stream.end())
                    stream, frame = Stream(framer, largest), None
                elif gap:
                    cut(stream.end())
                cut(stream.add(data, i))
            key = tuple(k[len(batch) - 1].as_py() for k in keys)
            if payloads:
                yield out(rows)
            held = rows.take([k for _, k in stream.pieces]).combine_chunks().to_batches()[0] if stream.pieces else None
            stream.pieces = [(n, k) for k, (n, _) in enumerate(stream.pieces)]
        if held is not None:
            rows = pa.Table.from_batches([held])
            frames = listed(rows["frame_number"].chunk(0))
            cut(stream.end())
            yield out(rows)

    return ordered.mapInArrow(run, ", ".join(f"{c} {kinds[c]}" for c in columns) + ", part int")


def with_messages(packets: DataFrame) -> DataFrame:
    """``packets`` with those of framed streams replaced by the streams' messages; ``part`` is 0 for the others."""
    near = F.lit(False)
    for ports in FRAMED.values():
        near = near | F.col("src_port").isin(ports) | F.col("dst_port").isin(ports)
    framed = (F.col("protocol") == "TCP") & (F.col("payload_len") > 0) & near
    return packets.where(~framed).withColumn("part", F.lit(0)).unionByName(messages(packets))
