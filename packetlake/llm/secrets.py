"""Secret scans: sliding-window entropy per character class, beside three plain patterns."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import per_batch, table, texts

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
#: Each run is matched whole, so that asking for the length in the pattern keeps the same matches.
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "entropy_hex", "entropy_base64", "entropy_base64url")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Class: (its runs, least entropy in bits of a window of WINDOW characters).
WINDOW = 20
CLASSES = {
    "entropy_hex": (re.compile(r"[0-9A-Fa-f]{20,}"), 3.0),
    "entropy_base64": (re.compile(r"[A-Za-z0-9+/]{20,}"), 3.9),
    "entropy_base64url": (re.compile(r"[A-Za-z0-9_-]{20,}"), 3.9),
}
#: Dense spans that overlap one of these are no secrets.
ALLOWED = (
    re.compile(r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"),  # UUID
    re.compile(r"example|placeholder|changeme|your[_-]?(key|token|secret)|x{6,}", re.IGNORECASE),
    re.compile(r"0123456789|abcdefghij|ABCDEFGHIJ|9876543210"),  # alphabets and sequences
)
_GAIN = [0.0]


def _gain(count: int) -> float:
    """What a character class's sum of c*log2(c) gains when a count rises to ``count``."""
    while len(_GAIN) <= count:
        c = len(_GAIN)
        _GAIN.append(c * log2(c) - ((c - 1) * log2(c - 1) if c > 1 else 0.0))
    return _GAIN[count]


def dense_windows(run: str, least: float, window: int = WINDOW) -> list[tuple[int, int]]:
    """Merged spans of the windows of ``run`` with at least ``least`` bits of Shannon entropy.

    The window's counts and their sum of c*log2(c) are updated by the character that enters and the
    one that leaves: a step costs the same for any window.
    """
    counts: Counter[str] = Counter()
    total, out = 0.0, []
    for i, c in enumerate(run):
        counts[c] += 1
        total += _gain(counts[c])
        if i >= window:
            gone = run[i - window]
            total -= _gain(counts[gone])
            counts[gone] -= 1
        if i + 1 >= window and log2(window) - total / window >= least - 1e-9:
            start = i + 1 - window
            if out and start <= out[-1][1]:
                out[-1][1] = i + 1
            else:
                out.append([start, i + 1])
    return [(a, b) for a, b in out]


def mixed(s: str) -> bool:
    return any("a" <= c <= "z" for c in s) and any("A" <= c <= "Z" for c in s) and any("0" <= c <= "9" for c in s)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    low = text.lower()
    out = []
    if any(k in low for k in KEYWORDS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans, in order and apart."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def touches(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether one of ``spans``, in order and apart, overlaps [start, end)."""
    i = bisect_left(spans, (end,))
    return i > 0 and spans[i - 1][1] > start


def entropy_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of dense candidates that overlap neither an allow-list match nor a base span.

    A hexadecimal span needs a digit and a letter; the wider classes need a digit and letters of either
    case, and give way to a span of a class listed before them. Spans are looked up in order: the time grows
    with the text and the logarithm of its spans.
    """
    out: list[tuple[str, int, int]] = []
    known = merged([(a, b) for _, a, b in base])
    for m in CANDIDATE.finditer(text):
        whole = m.group()
        if not any(c.isdigit() for c in whole):
            continue
        allowed = merged([(m.start() + a.start(), m.start() + a.end()) for p in ALLOWED for a in p.finditer(whole)])
        own: list[tuple[int, int]] = []
        for kind, (runs, least) in CLASSES.items():
            for r in runs.finditer(whole):
                for a, b in dense_windows(r.group(), least):
                    start, end = m.start() + r.start() + a, m.start() + r.start() + b
                    found = text[start:end]
                    good = any(c.isalpha() for c in found) and any(c.isdigit() for c in found) if kind == "entropy_hex" else mixed(found)
                    if good and not any(touches(x, start, end) for x in (known, allowed, own)):
                        out.append((kind, start, end))
                        insort(own, (start, end))
    return out


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, base and added: array of (kind, start, end), by start then kind.

    Positions count code points, ends are exclusive. Base kinds are ``assign``, ``access`` and ``hex``;
    the others come from entropy. Null text is empty and has no spans; a null doc_id stays null; repeated
    rows each give a row; other columns are ignored. A text of any length is scanned whole.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, added = [], []
        order = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in sorted(spans, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))]
        for text in texts(batch):
            found = base_spans(text)
            base.append(order(found))
            added.append(order(entropy_spans(text, found)))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    span = "array<struct<kind:string,start:long,end:long>>"
    return per_batch(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), scan, f"doc_id long, base {span}, added {span}")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))
    write = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    rank = F.array(*[F.lit(k) for k in KINDS])
    by_start = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise((F.array_position(rank, a["kind"]) - F.array_position(rank, b["kind"])).cast("int"))
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(write(F.col("base")), 256).alias("base_sha256"), write(F.array_sort(F.concat("base", "added"), by_start)).alias("spans"))
