"""Packet captures as a DataFrame."""

from __future__ import annotations

import ipaddress
import json
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import PACKET, columns
from ..session import cut
from . import capture

#: Link types, and bytes before the network layer.
ETHERNET, RAW, COOKED, COOKED2 = 1, (12, 101, 228, 229), 113, 276
PROTOCOLS = {6: "TCP", 17: "UDP", 132: "SCTP", 1: "ICMP", 58: "ICMPv6"}
BATCH = 4096
#: Bytes of a file that one task walks, and bytes that a row can hold.
RANGE, LARGEST_FILE = 1 << 26, (1 << 31) - 1


def frames(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(microseconds, link type, bytes) of each frame of a classic or next-generation capture; stops where it is cut off."""
    source = capture.Source.of(data)
    state, at = capture.head(source)
    for micros, link, offset, size in capture.Walk(source, state, at, len(data)):
        yield micros, link, source.get(offset, size)


def network_layer(link: int, frame: bytes) -> bytes | None:
    if link == ETHERNET:
        at, kind = 14, frame[12:14]
        while kind in (b"\x81\x00", b"\x88\xa8"):
            kind, at = frame[at + 2 : at + 4], at + 4
        return frame[at:] if kind in (b"\x08\x00", b"\x86\xdd") else None
    if link in RAW:
        return frame
    return frame[16:] if link == COOKED else frame[20:] if link == COOKED2 else None


def parse(micros: int, link: int, frame: bytes) -> tuple | None:
    """A frame's fields after frame_number, or None if it isn't IP."""
    ip = network_layer(link, frame)
    if not ip or len(ip) < 20:
        return None
    if ip[0] >> 4 == 4:
        head, total = (ip[0] & 15) * 4, struct.unpack_from(">H", ip, 2)[0]
        ip_id, ttl, proto = struct.unpack_from(">H", ip, 4)[0], ip[8], ip[9]
        src, dst, body = ip[12:16], ip[16:20], ip[head : total or None]
    elif ip[0] >> 4 == 6 and len(ip) >= 40:
        ip_id, ttl, proto, src, dst, body = 0, ip[7], ip[6], ip[8:24], ip[24:40], ip[40 : 40 + struct.unpack_from(">H", ip, 4)[0]]
    else:
        return None
    name = PROTOCOLS.get(proto)
    if name is None:
        return None
    sport = dport = seq = ack = flags = 0
    payload = body
    if name == "TCP" and len(body) >= 20:
        sport, dport, seq, ack, offset, flags = struct.unpack_from(">HHIIBB", body)
        payload, flags = body[(offset >> 4) * 4 :], flags & 63
    elif name in ("UDP", "SCTP") and len(body) >= (8 if name == "UDP" else 12):
        sport, dport = struct.unpack_from(">HH", body)
        payload = body[8:] if name == "UDP" else body[12:]
    elif name.startswith("ICMP") and len(body) >= 8:
        sport, dport, payload = body[0], body[1], body[8:]
    return micros, str(ipaddress.ip_address(src)), str(ipaddress.ip_address(dst)), sport, dport, name, len(frame), payload, len(payload), seq, ack, flags, ttl, ip_id, frame


def _captures(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap*").option("recursiveFileLookup", "true").load(path)


def _open(path: str) -> tuple[capture.Source, pa.NativeFile]:
    """A file by its URI, for reading anywhere in it."""
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    file = store.open_input_file(name)
    return capture.Source(lambda at, n: file.read_at(n, at), file.size()), file


def can_split(path: str) -> bool:
    """Whether the tasks can open the file themselves; else Spark hands it to them whole."""
    try:
        _open(path)[1].close()
    except (OSError, ValueError, NotImplementedError, pa.ArrowException):
        return False
    return True


INDEX = "file string, start long, stop long, first long, end long, frames long, low long, high long, earliest long, state string, after string, cut boolean, error string"


def _indexed(source: capture.Source, start: int, stop: int, first: int | None, state: dict | None) -> dict:
    """The index row of a part of a file; ``first`` and ``state`` are where and how to walk it, if they are known."""
    out = {"start": start, "stop": stop, "first": first, "end": None, "frames": 0, "low": None, "high": None, "earliest": None, "state": None, "after": None, "cut": False, "error": None}
    walk = None
    try:
        if state is None:
            state, at = capture.head(source)
            if start == 0:
                first = at
            else:
                state = capture.usual_state(source)
                first = capture.entry(source, state, start, stop)
        out |= {"first": first, "state": json.dumps(state)}
        if first is None:
            return out
        walk = capture.Walk(source, state, first, stop)
        for micros, *_ in walk:
            out["frames"] += 1
            out["earliest"] = micros if out["earliest"] is None else out["earliest"]
            out["low"] = micros if out["low"] is None else min(out["low"], micros)
            out["high"] = micros if out["high"] is None else max(out["high"], micros)
        out["cut"] = walk.cut
    except capture.BROKEN as e:
        out["error"] = str(e) or type(e).__name__
    if walk is not None:
        out |= {"end": walk.at, "after": json.dumps(walk.state)}
    return out


def _index(parts: DataFrame) -> DataFrame:
    """Index rows of parts (file, start, stop, first, state, and content where files come whole)."""
    whole = "content" in parts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[t]) for n, t in columns(INDEX)])
        for b in batches:
            names = ("file", "start", "stop", "first", "state")
            for i, (file, start, stop, first, state) in enumerate(zip(*(b.column(c).to_pylist() for c in names), strict=True)):
                source, opened = (capture.Source.of(memoryview(b.column("content")[i].as_buffer())), None) if whole else _open(file)
                found = _indexed(source, start, stop, first, json.loads(state) if state else None)
                if opened:
                    opened.close()
                yield pa.RecordBatch.from_pylist([{"file": file} | found], schema)

    return parts.mapInArrow(run, INDEX)


def _spread(parts: DataFrame, n: int) -> DataFrame:
    return parts.repartition(max(1, min(n, 10_000)), "file", "start")


def _walked(spark: SparkSession, path: str, size: int) -> tuple[dict[str, list[dict]], DataFrame | None]:
    """({file: index rows in order, proven}, the files with their content where tasks can't open them).

    All parts are walked at once, each from a guessed record. A part is proven if the walk of the parts
    before it ends at its first record (or beyond the part) with what it took for known; what isn't
    is walked again from there. A wrong guess, as inside a capture that a capture carries, so costs a walk
    and changes no result. The driver holds a row for each part.
    """
    files = _captures(spark, path).where(F.col("length") > 0)
    listed = files.select("path", "length").collect()  # as Spark's own listing
    split = all(can_split(r.path) for r in listed[:1])
    none = {"first": F.lit(None).cast("long"), "state": F.lit(None).cast("string")}
    if split:
        starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
        parts = files.select(F.col("path").alias("file"), "length", starts.alias("start")).select("file", "start", F.least("length", F.col("start") + size).alias("stop")).withColumns(none)
        found = _index(_spread(parts, sum(-(-r.length // size) for r in listed))).collect()
        content = None
    else:
        content = files.where(F.col("length") <= LARGEST_FILE).select(F.col("path").alias("file"), F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"), "content").withColumns(none)
        found = _index(content).collect()
    by: dict[str, list[dict]] = {}
    for r in sorted((r.asDict() for r in found), key=lambda r: (r["file"], r["start"])):
        by.setdefault(r["file"], []).append(r)
    while again := [x for rows in by.values() if (x := _unproven(rows))]:
        parts = spark.createDataFrame([(r["file"], r["start"], r["stop"], first, state) for r, first, state in again], "file string, start long, stop long, first long, state string")
        for r in _index(_spread(parts, len(again))).collect():
            by[r.file] = [r.asDict() if x["start"] == r.start else x for x in by[r.file]]
    return by, content


def _unproven(rows: list[dict]) -> tuple[dict, int, str] | None:
    """The first part whose walk doesn't follow from those before it, and where and how to walk it. Parts past a break are emptied."""
    at, state, over = rows[0]["end"], rows[0]["after"], rows[0]["error"] is not None or rows[0]["cut"] or rows[0]["end"] is None
    for r in rows[1:]:
        if over or at >= r["stop"]:
            r.update(first=None, frames=0, low=None, high=None, earliest=None, error=None, cut=False)
            continue
        if r["first"] != at or r["state"] != state:
            return r, at, state
        at, state, over = r["end"], r["after"], r["error"] is not None or r["cut"]
    return None


def _ordered(by: dict[str, list[dict]]) -> list[dict]:
    """The parts with frames, with what is before them: frames of the job (``base``), the file's latest time, and the group of files.

    Files come in order of their first frame's time, then of their names. Files whose times overlap are one
    group; ``merge`` says that their frames must be put in order.
    """
    spans = []
    for file, rows in by.items():
        kept = [r for r in rows if r["frames"]]
        if kept:
            spans.append((kept[0]["earliest"], file, kept, min(r["low"] for r in kept), max(r["high"] for r in kept)))
    groups: list[list[tuple]] = []
    latest = None
    for span in sorted(spans):
        if latest is not None and min(span[0], span[3]) <= latest:
            groups[-1].append(span)
        else:
            groups.append([span])
        latest = span[4] if latest is None else max(latest, span[4])
    out, number, total = [], 0, 0
    for g, group in enumerate(groups):
        base = total
        for _, _, rows, *_ in group:
            high, place = None, 0
            for r in rows:
                out.append(r | {"base": base if len(group) > 1 else total, "place": place, "before": high, "number": number, "group": g, "merge": len(group) > 1})
                place += r["frames"]
                total += r["frames"]
                high = r["high"] if high is None else max(high, r["high"])
            number += 1
            if len(group) == 1:
                base = total
    # With one file a group, base + place is the number: base counts the frames before the part, place those of its file.
    return [r | ({"base": r["base"] - r["place"]} if not r["merge"] else {}) for r in out]


_PARSED = f"{PACKET}, file string, place long, at long, number long, group long, base long, is_ip boolean"


def _rows(source: capture.Source, part: dict) -> Iterator[tuple]:
    """A row for each frame of a part; other than IP packets only where frames are to be merged."""
    state = json.loads(part["state"])
    latest, place = part["before"], part["place"]
    empty = (None,) * 15
    try:
        for micros, link, offset, size in capture.Walk(source, state, part["first"], part["stop"]):
            place += 1
            latest = micros if latest is None else max(latest, micros)
            found = parse(micros, link, source.get(offset, size))
            if found or part["merge"]:
                yield part["job_id"], part["base"] + place, *(found or empty), part["file"], place, latest, part["number"], part["group"], part["base"], found is not None
    except capture.BROKEN:
        return  # listed by capture_files


def _batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    arrow = {"long": pa.int64(), "timestamp_ntz": pa.timestamp("us"), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = columns(_PARSED)
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, arrow[t]) for c, (_, t) in zip(zip(*held, strict=True), fields, strict=True)], [n for n, _ in fields])

    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield batch()
            held = []
    if held:
        yield batch()


def _numbered(frames_: DataFrame, groups: dict[int, int]) -> DataFrame:
    """Frames of overlapping files, numbered by time. ``groups`` has the frames of each group.

    They are dealt to ranges of time and sorted there; a range's numbers follow those of the ranges before
    it. Within a file the order of its frames is kept: a frame counts as not earlier than those before it.
    """
    spark = frames_.sparkSession

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield b.append_column("rank", pa.array(range(n, n + b.num_rows), pa.int64()))
            n += b.num_rows

    order = ["group", "at", "number", "place"]
    dealt = frames_.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("dealt", F.spark_partition_id())
    schema = ", ".join(f"{c} {t}" for c, t in dealt.dtypes)
    # Bounds of ranges are drawn from samples: written, they stay the same for a task that runs again.
    ranked = cut(dealt.mapInArrow(count, f"{schema}, rank long"))
    before, total = [], 0
    for r in ranked.groupBy("dealt").count().orderBy("dealt").collect():
        before.append((r.dealt, total))
        total += r["count"]
    first, total = [], 0
    for g, n in sorted(groups.items()):
        first.append((g, total))
        total += n
    found = ranked.join(F.broadcast(spark.createDataFrame(before, "dealt int, before long")), "dealt").join(F.broadcast(spark.createDataFrame(first, "group long, first long")), "group")
    return found.withColumn("frame_number", F.col("base") + F.col("before") + F.col("rank") - F.col("first") + 1)


def read_pcap(spark: SparkSession, path: str, job_id: int = 0, part_size: int = RANGE) -> DataFrame:
    """The IP packets of all captures under ``path``, numbered from 1 in order of time: one job, in however many files.

    Files are walked in parts of ``part_size`` bytes, each by a task that opens the file itself (through
    Arrow's file systems); rows and numbers are those of a sequential reader at any size. Where only Spark
    reaches the store, files come whole, one to a task, and those larger than a row can hold (2 GiB) are left
    out; ``capture_files`` lists them. A first pass counts the frames of each part. Files follow each other by
    the time of their first frames; frames of files that overlap in time are sorted. Frames that aren't IP
    count, but give no row. ``file`` names the file. A file that is no capture gives no packets, one that
    breaks off those before the break.
    """
    by, content = _walked(spark, path, part_size)
    parts = [r | {"job_id": job_id} for r in _ordered(by)]
    names = [n for n, _ in columns(f"{PACKET}, file string")]
    if not parts:
        return spark.createDataFrame([], f"{PACKET}, file string")
    if content is None:
        keys = "file string, start long, stop long, first long, state string, base long, place long, before long, number long, group long, merge boolean, job_id long"
        rows = spark.createDataFrame([tuple(r[n] for n, _ in columns(keys)) for r in parts], keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.to_pylist():
                    source, file = _open(part["file"])
                    yield from _batches(_rows(source, part))
                    file.close()

        found = _spread(rows, len(parts)).mapInArrow(run, _PARSED)
    else:
        known = {r["file"]: r for r in parts}

        def run_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for file, data in zip(b.column("file").to_pylist(), b.column("content"), strict=True):
                    if file in known:
                        yield from _batches(_rows(capture.Source.of(memoryview(data.as_buffer())), known[file]))

        found = content.select("file", "content").mapInArrow(run_whole, _PARSED)
    merged: dict[int, int] = {}
    for r in parts:
        if r["merge"]:
            merged[r["group"]] = merged.get(r["group"], 0) + r["frames"]
    if not merged:
        return found.select(*names)
    several = F.col("group").isin(*merged)
    return found.where(~several).select(*names).unionByName(_numbered(found.where(several), merged).where("is_ip").select(*names))


def capture_files(spark: SparkSession, path: str, largest: int | None = None, part_size: int = RANGE) -> DataFrame:
    """(file, length, frames, error) of each file under ``path``; null error: it was read to its end.

    A file of more than ``largest`` bytes isn't opened, nor is one larger than a row can hold where tasks can't
    open files themselves; empty ones aren't listed. An error is for the caller to act on (refuse the upload, split the
    file); nothing is dropped in silence.
    """
    files = _captures(spark, path).where(F.col("length") > 0).select("path", "length")
    listed = {r.path: r.length for r in files.collect()}
    allowed = LARGEST_FILE if listed and not can_split(next(iter(listed))) else None
    most = min([x for x in (largest, allowed) if x is not None], default=None)
    by = _walked(spark, path, part_size)[0] if any(most is None or n <= most for n in listed.values()) else {}
    rows = []
    for file, length in listed.items():
        if most is not None and length > most:
            rows.append((file, length, None, "larger than allowed"))
        else:
            rows.append((file, length, sum(r["frames"] for r in by[file]), next((r["error"] for r in by[file] if r["error"]), None)))
    return spark.createDataFrame(rows, "file string, length long, frames long, error string")


def stream_pcap(spark: SparkSession, path: str, job_id: int = 0, files_per_batch: int = 100) -> DataFrame:
    """The same of a spool folder, as a stream: captures are read once, as they arrive (finished files moved in whole).

    Files come as they arrive, so frames are numbered from 1 in each file; measures of streams go by time.
    """
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.pcap*").option("maxFilesPerTrigger", files_per_batch).load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, data in zip(b.column("path").to_pylist(), b.column("content"), strict=True):
                source = capture.Source.of(memoryview(data.as_buffer()))
                try:
                    state, first = capture.head(source)
                except capture.BROKEN:
                    continue
                part = {"file": file, "state": json.dumps(state), "first": first, "stop": source.size, "base": 0, "place": 0, "before": None, "number": 0, "group": 0, "merge": False, "job_id": job_id}
                yield from _batches(_rows(source, part))

    return files.select("path", "content").mapInArrow(run, _PARSED).select(*[n for n, _ in columns(f"{PACKET}, file string")])


def with_protocol(packets: DataFrame) -> DataFrame:
    """Adds app_protocol by port, for display."""
    near = lambda *p: F.col("src_port").isin(*p) | F.col("dst_port").isin(*p)
    return packets.withColumn("app_protocol", F.when(near(5060, 5061), "SIP").when(near(80, 8080, 8000, 8888, 3000), "HTTP").when(near(443, 8443), "HTTPS").when(near(993, 995, 465, 636), "TLS").when(near(3868), "Diameter").when(near(53, 5353), "DNS").otherwise(""))
