"""Frames that capture agents send, spooled to files: the codec, and a source of batches for batch and stream.

A session is what one connection carried, in files named ``<session>.<number>``: its bytes one after the
other, cut anywhere. A frame is a length in 4 bytes, high first, and that many bytes of JSON, plain or
compressed. The first one of a session is the agent's greeting, the others are batches of packets; a batch without
packets is a heartbeat.
"""

from __future__ import annotations

import base64
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..schemas import PACKET, columns
from .pcap import BATCH, parse

#: Fixed value: bytes of a frame's content at most.
LARGEST = 8 * 1024 * 1024
#: Bytes of frames that one task reads at least, where there are more, and bytes that a trigger looks ahead in each session.
PART, AHEAD = 32 << 20, 256 << 20
#: Where a session ends for good.
NEVER = 1 << 62
BATCHES = """session string, at long, agent_id string, agent_host string, interface string, seq long, dropped long,
packets array<struct<ns: long, link: int, length: long, data: binary>>, error string"""
_FILE = re.compile(r"(.+)\.(\d+)$")


def encode(message: dict, compress: bool = False) -> bytes:
    """A frame of a greeting or a batch."""
    data = json.dumps(message).encode()
    data = zlib.compress(data) if compress else data
    return len(data).to_bytes(4, "big") + data


def decode(content: bytes) -> dict:
    """The message of a frame's content, compressed or not. Raises ValueError where it is none."""
    if content[:1] == b"x":  # of a compressed stream; JSON starts with a brace or white space
        unpacked = zlib.decompressobj()
        try:
            content = unpacked.decompress(content)
        except zlib.error as e:
            raise ValueError(str(e)) from e
        if not unpacked.eof:
            raise ValueError("compressed data is cut off")
    message = json.loads(content)
    if not isinstance(message, dict):
        raise ValueError("not a message")
    return message


class Spool:
    """The sessions of a folder and their bytes, by the folder's URI or path."""

    def __init__(self, path: str) -> None:
        from pyarrow import fs

        self.store, self.folder = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), re.sub("^file:", "", path))

    def sessions(self) -> dict[str, list[tuple[str, int]]]:
        """(file, bytes) of each session's files in order of their numbers, up to the first that is missing."""
        from pyarrow import fs

        found: dict[str, dict[int, tuple[str, int]]] = {}
        for f in self.store.get_file_info(fs.FileSelector(self.folder, recursive=False)):
            if f.is_file and (m := _FILE.match(f.base_name)):
                found.setdefault(m.group(1), {})[int(m.group(2))] = (f.path, f.size)
        out = {}
        for session, files in found.items():
            n = min(files)
            out[session] = []
            while n in files:
                out[session].append(files[n])
                n += 1
        return out


class Bytes:
    """The bytes of a session, over its files."""

    def __init__(self, spool: Spool, files: list[tuple[str, int]]) -> None:
        self.spool, self.files, self.size = spool, files, sum(n for _, n in files)
        self.open, self.file = None, None

    def get(self, at: int, n: int) -> bytes:
        out = b""
        for path, size in self.files:
            if at < size and n > 0:
                if self.open != path:
                    self.open, self.file = path, self.spool.store.open_input_file(path)
                part = self.file.read_at(min(n, size - at), at)
                out, n, at = out + part, n - len(part), at + len(part)
            at -= size
            if at < 0:
                at = 0
        return out


def ends(data: Bytes, at: int, stop: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether a length is bad) of the frames from ``at`` on that are there whole. After a bad length nothing can be read."""
    while at + 4 <= min(data.size, stop):
        n = int.from_bytes(data.get(at, 4), "big")
        if n == 0 or n > LARGEST:
            yield at, NEVER, True
            return
        if at + 4 + n > data.size:
            return
        yield at, at + 4 + n, False
        at += 4 + n


def _rows(data: Bytes, session: str, start: int, stop: int) -> Iterator[tuple]:
    """Batches, and what is no batch with its error, of the frames in [start, stop)."""
    agent: dict = {}
    for at, end, _ in ends(data, 0, 5):  # the greeting, which may be before this part
        try:
            agent = decode(data.get(at + 4, end - at - 4)).get("agent") or {}
        except ValueError:
            pass
    who = (agent.get("id"), agent.get("hostname"), agent.get("iface"))
    for at, end, bad in ends(data, start, stop):
        try:
            if bad:
                n = int.from_bytes(data.get(at, 4), "big")
                raise ValueError("empty message" if n == 0 else f"message too large: {n} bytes")
            message = decode(data.get(at + 4, end - at - 4))
            if at == 0 and "agent" in message:
                continue
            packets = [(int(p["ts_ns"]), int(p.get("link_type") or 1), int(p.get("len") or 0), base64.b64decode(p.get("data") or "")) for p in message.get("packets") or []]
            yield session, at, message.get("agent_id") or who[0], who[1], who[2], message.get("seq"), message.get("drops") or 0, packets, None
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            yield session, at, *who, None, None, None, str(e) or type(e).__name__
        if bad:
            return


@dataclass
class Part(InputPartition):
    session: str
    start: int
    stop: int


class _Reader:
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.part, self.ahead = int(options.get("partbytes", PART)), int(options.get("maxbytespertrigger", AHEAD))

    def parts(self, start: dict[str, int], stop: dict[str, int] | None) -> list[Part]:
        """Parts of whole frames, at least ``part`` bytes each where there are as many."""
        spool = Spool(self.path)
        out = []
        for session, files in sorted(spool.sessions().items()):
            data = Bytes(spool, files)
            first = start.get(session, 0)
            limit = NEVER if stop is None else stop.get(session, 0)
            last = first
            for _, end, _ in ends(data, first, limit):
                last = end
                if last - first >= self.part:
                    out.append(Part(session, first, last))
                    first = last
            if last > first:
                out.append(Part(session, first, last))
        return out

    def read(self, partition: Part) -> Iterator[tuple]:
        spool = Spool(self.path)
        return _rows(Bytes(spool, spool.sessions()[partition.session]), partition.session, partition.start, partition.stop)


class BatchReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Part]:
        return self.parts({}, None)


class StreamReader(_Reader, DataSourceStreamReader):
    """Offsets are the bytes of each session up to the end of its last whole frame: one that is cut between files is read when its rest is there."""

    def __init__(self, options: dict) -> None:
        super().__init__(options)
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        spool = Spool(self.path)
        for session, files in spool.sessions().items():
            data, at = Bytes(spool, files), self.seen.get(session, 0)
            for _, end, _ in ends(data, at, at + self.ahead):
                at = end
            self.seen[session] = at
        return dict(self.seen)

    def partitions(self, start: dict, end: dict) -> list[Part]:
        return self.parts(start, end)

    def commit(self, end: dict) -> None:
        self.seen = {k: max(v, end.get(k, 0)) for k, v in self.seen.items()}


class AgentFrames(DataSource):
    """``spark.read`` or ``spark.readStream`` of format "agent_frames": option path, and partBytes and maxBytesPerTrigger."""

    @classmethod
    def name(cls) -> str:
        return "agent_frames"

    def schema(self) -> str:
        return BATCHES

    def _options(self) -> dict:
        return {k.lower(): v for k, v in self.options.items()}

    def reader(self, schema) -> BatchReader:
        return BatchReader(self._options())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(self._options())


def read_agents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The batches of all sessions that are spooled under ``path``; frames that can't be read have an error."""
    spark.dataSource.register(AgentFrames)
    return spark.read.format("agent_frames").options(path=path, **options).load()


def stream_agents(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The same as a stream: files may be added, and the last one of a session may grow."""
    spark.dataSource.register(AgentFrames)
    return spark.readStream.format("agent_frames").options(path=path, **options).load()


def broken(batches: DataFrame) -> DataFrame:
    """(session, at, agent_id, error) of the frames that can't be read; after a bad length nothing of a session can."""
    return batches.where("error is not null").select("session", "at", "agent_id", "error")


def totals(batches: DataFrame) -> DataFrame:
    """(agent_id, packets, bytes, dropped, timestamp) of each batch, as ``live.agent_totals`` takes them. A heartbeat has no packets and no time."""
    count = F.size("packets").cast("long")
    size = F.aggregate("packets", F.lit(0).cast("long"), lambda s, p: s + p["length"])
    last = F.array_max(F.transform("packets", lambda p: p["ns"]))
    return batches.where("error is null").select("agent_id", count.alias("packets"), size.alias("bytes"), "dropped", F.timestamp_micros(F.floor(last / 1000).cast("long")).alias("timestamp"))


def packets(batches: DataFrame) -> DataFrame:
    """The IP packets of the batches, with agent_id and agent_host; a session is a job of its own.

    The job is the CRC of the session's name. A frame's number is made of where its batch starts in the session and of
    its place in it: unique and in order, with gaps.
    """
    fields = columns(f"{PACKET}, agent_id string, agent_host string")
    arrow = {"long": pa.int64(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string(), "int": pa.int32(), "binary": pa.binary()}

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [n for n, _ in fields])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            rows = []
            for r in b.to_pylist():
                for i, p in enumerate(r["packets"]):
                    if found := parse(p["ns"] // 1000, p["link"], p["data"]):
                        rows.append((r["job_id"], (r["at"] << 16) + i, *found, r["agent_id"], r["agent_host"]))
                    if len(rows) == BATCH:
                        yield batch(rows)
                        rows = []
            if rows:
                yield batch(rows)

    own = batches.where("error is null and size(packets) > 0").select(F.crc32("session").alias("job_id"), "at", "packets", "agent_id", "agent_host")
    return own.mapInArrow(run, f"{PACKET}, agent_id string, agent_host string")
