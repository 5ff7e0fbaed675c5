"""Walking captures: the records of a file, or of a part of it, by offset.

A capture has no index. A part in the middle of a file is entered by a guess, the first offset from which a
chain of plausible heads starts, and the guess is proven by the part before it: its walk must end there.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

#: The marks of classic captures by byte order and fraction, and of next-generation blocks.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\xc3\xd4": (">", False), b"\xa1\xb2\x3c\x4d": (">", True)}
SECTION, INTERFACE, PACKET = 0x0A0D0D0A, 1, 6
#: Blocks that a chain of plausible heads may hold: sections, interfaces, packets, names, statistics, secrets.
BLOCKS = (SECTION, INTERFACE, 2, 3, 4, 5, PACKET, 10)
#: What a file that is no capture, or stops being one, raises.
BROKEN = (ValueError, IndexError, struct.error)
#: Heads of a chain, bytes of a record at most, seconds that it may be away from the file's first one, bytes read at a time.
CHAIN, LARGEST_RECORD, APART, READ = 4, 1 << 18, 366 * 86400, 1 << 22


class Source:
    """Bytes of a file by offset, read in blocks."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int) -> None:
        self.read_at, self.size, self.start, self.block = read_at, size, 0, b""

    @classmethod
    def of(cls, data) -> Source:
        """A file that is in memory."""
        out = cls(lambda at, n: data[at : at + n], len(data))
        out.block = data
        return out

    def get(self, at: int, n: int) -> bytes:
        """The ``n`` bytes from ``at`` on; fewer at the file's end."""
        n = max(0, min(n, self.size - at))
        if at < self.start or at + n > self.start + len(self.block):
            self.start, self.block = at, self.read_at(at, min(max(n, READ), self.size - at))
        return bytes(self.block[at - self.start : at - self.start + n])


def _resolution(options: bytes, order: str) -> int:
    at = 0
    while at + 4 <= len(options):
        code, size = struct.unpack_from(f"{order}2H", options, at)
        if code == 9:
            x = options[at + 4]
            return 2 ** (x & 127) if x & 128 else 10**x
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


class Walk:
    """The records that start in [at, stop). ``state`` is what is known of the file there: byte order, link types, units of time.

    Iterating gives (microseconds, link type, offset, length) of each frame. Then ``at`` is where the next
    record starts, ``cut`` whether the file breaks off in a record, and ``state`` what is known there.
    """

    def __init__(self, source: Source, state: dict, at: int, stop: int) -> None:
        self.source, self.state, self.at, self.stop, self.cut = source, json.loads(json.dumps(state)), at, stop, False

    def __iter__(self) -> Iterator[tuple[int, int, int, int]]:
        return self._blocks() if self.state["blocks"] else self._records()

    def _records(self) -> Iterator[tuple[int, int, int, int]]:
        order, nano, link = self.state["order"], self.state["nano"], self.state["link"]
        source, head = self.source, struct.Struct(f"{order}4I")
        while self.at < self.stop:
            data = source.get(self.at, 16)
            if len(data) < 16:
                self.cut = True
                return
            seconds, part, size, _ = head.unpack(data)
            if self.at + 16 + size > source.size:
                self.cut = True
                return
            yield seconds * 1_000_000 + (part // 1000 if nano else part), link, self.at + 16, size
            self.at += 16 + size

    def _blocks(self) -> Iterator[tuple[int, int, int, int]]:
        source, state = self.source, self.state
        while self.at < self.stop:
            data = source.get(self.at, 12)
            if len(data) < 12:
                self.cut = True
                return
            if data[:4] == b"\x0a\x0d\x0d\x0a":
                state["order"], state["links"] = ("<" if data[8:] == b"\x4d\x3c\x2b\x1a" else ">"), []
            order = state["order"]
            kind, size = struct.unpack_from(f"{order}2I", data)
            if size < 12 or self.at + size > source.size:
                self.cut = True
                return
            if kind == INTERFACE:
                body = source.get(self.at, size)
                state["links"].append([struct.unpack_from(f"{order}H", body, 8)[0], _resolution(body[16:-4], order)])
            elif kind == PACKET:
                interface, high, low, kept, _ = struct.unpack(f"{order}5I", source.get(self.at + 8, 20))
                if interface >= len(state["links"]):
                    raise ValueError("packet of an interface that is not described")
                link, per_second = state["links"][interface]
                yield (high << 32 | low) * 1_000_000 // per_second, link, self.at + 28, min(kept, size - 32)
            self.at += size


def head(source: Source) -> tuple[dict, int]:
    """(state, offset of the first record) of a file. Raises ValueError where it is no capture."""
    data = source.get(0, 24)
    if data[:4] == b"\x0a\x0d\x0d\x0a":
        return {"blocks": True, "order": "<", "links": []}, 0
    if data[:4] not in CLASSIC or len(data) < 24:
        raise ValueError("not a packet capture")
    order, nano = CLASSIC[data[:4]]
    snap, link = struct.unpack_from(f"{order}2I", data, 16)
    return {"blocks": False, "order": order, "nano": nano, "link": link & 0xFFFF, "most": max(snap, LARGEST_RECORD)}, 24


def usual_state(source: Source) -> dict:
    """What is known after the file's leading blocks: in nearly all files that holds to the end."""
    state, at = head(source)
    if state["blocks"]:
        walk = Walk(source, state, at, source.size)
        for _ in walk:  # the first packet
            break
        return walk.state
    return state


def _plausible(source: Source, state: dict, at: int, first: int) -> int | None:
    """Where the record that may start at ``at`` ends; None if none does."""
    if state["blocks"]:
        data = source.get(at, 8)
        if len(data) < 8:
            return None
        kind, size = struct.unpack(f"{state['order']}2I", data)
        if kind not in BLOCKS or size < 12 or size % 4 or at + size > source.size:
            return None
        return at + size if source.get(at + size - 4, 4) == data[4:] else None
    data = source.get(at, 16)
    if len(data) < 16:
        return None
    seconds, part, kept, sent = struct.unpack(f"{state['order']}4I", data)
    fits = part < (1_000_000_000 if state["nano"] else 1_000_000) and kept <= sent and kept <= state["most"] and abs(seconds - first) <= APART
    return at + 16 + kept if fits and at + 16 + kept <= source.size else None


def entry(source: Source, state: dict, start: int, stop: int) -> int | None:
    """The first offset in [start, stop) from which a chain of plausible heads runs, or the file's end is met."""
    first = 0
    if not state["blocks"] and source.size >= 40:
        first = struct.unpack(f"{state['order']}I", source.get(24, 4))[0]
    for at in range(start, stop):
        end: int | None = at
        for _ in range(CHAIN):
            end = _plausible(source, state, end, first)
            if end is None or end == source.size:
                break
        if end is not None:
            return at
    return None
