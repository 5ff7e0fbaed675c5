"""Captures built here, read back, decoded and judged."""

import datetime as dt
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from packetlake.operators import decoders, detect
from packetlake.sources import wire
from packetlake.sources.pcap import capture_files, read_pcap

T0 = dt.datetime(2024, 1, 1, 10, tzinfo=dt.timezone.utc).timestamp()


def frame(src, dst, sport, dport, payload=b"", proto=17, flags=0, seq=1, ack=0, ttl=64):
    if proto == 17:
        body = struct.pack(">4H", sport, dport, 8 + len(payload), 0) + payload
    elif proto == 6:
        body = struct.pack(">HHIIBBHHH", sport, dport, seq, ack, 80, flags, 1024, 0, 0) + payload
    elif proto == 132:
        body = struct.pack(">HHII", sport, dport, 0, 0) + payload
    else:
        body = struct.pack(">BBHI", sport, dport, 0, 0) + payload
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(body), 7, 0, ttl, proto, 0) + bytes(map(int, src.split("."))) + bytes(map(int, dst.split(".")))
    return bytes(12) + b"\x08\x00" + ip + body


def pcap(frames):
    return struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1) + b"".join(struct.pack("<4I", int(T0 + t), int(round((T0 + t) % 1 * 1e6)), len(f), len(f)) + f for t, f in frames)


def pcapng(frames):
    block = lambda kind, body: struct.pack("<2I", kind, 12 + (n := (len(body) + 3) // 4 * 4)) + body.ljust(n, b"\0") + struct.pack("<I", 12 + n)
    out = block(0x0A0D0D0A, struct.pack("<IHHq", 0x1A2B3C4D, 1, 0, -1)) + block(1, struct.pack("<HHI", 1, 0, 65535))
    for t, f in frames:
        us = int(round((T0 + t) * 1e6))
        out += block(6, struct.pack("<5I", 0, us >> 32, us & 0xFFFFFFFF, len(f), len(f)) + f)
    return out


def sip_message(start, call, cseq="INVITE"):
    return f"{start}\r\nFrom: <sip:a@x>\r\nTo: <sip:b@x>\r\nCall-ID: {call}\r\nCSeq: 1 {cseq}\r\n\r\n".encode()


def question(name, ident, kind=1):
    return struct.pack(">6H", ident, 0x100, 1, 0, 0, 0) + b"".join(bytes([len(x)]) + x.encode() for x in name.split(".")) + b"\0" + struct.pack(">2H", kind, 1)


def rtp_packet(i, ssrc):
    return struct.pack(">BBHII", 0x80, 0, i, 160 * i, ssrc) + bytes(160)


def load(spark, tmp_path, frames, write=pcap):
    (tmp_path / "x.pcap").write_bytes(write(frames))
    return read_pcap(spark, str(tmp_path)).cache()


def judged(packets, tmp_path):
    decoders.decode(packets).write.parquet(f"{tmp_path}/flows")
    flows = packets.sparkSession.read.parquet(f"{tmp_path}/flows")
    found = detect.run(flows).collect()
    return Counter(r.type for r in flows.collect()), Counter(r.rule for r in found), {r.title for r in found}


@pytest.mark.parametrize("write", [pcap, pcapng])
def test_fields_of_both_formats(spark, tmp_path, write):
    r = load(spark, tmp_path, [(0.25, frame("10.0.0.1", "8.8.8.8", 1234, 80, b"hello", 6, 24, 77, 88, 63)), (1, bytes(12) + b"\x08\x06" + bytes(40))], write).collect()
    assert [(x.frame_number, x.timestamp, x.src_ip, x.dst_ip, x.src_port, x.dst_port, x.protocol, bytes(x.payload), x.seq, x.ack, x.flags, x.ttl, x.ip_id) for x in r] == [(1, dt.datetime(2024, 1, 1, 10, 0, 0, 250000), "10.0.0.1", "8.8.8.8", 1234, 80, "TCP", b"hello", 77, 88, 24, 63, 7)]


def test_sip_call(spark, tmp_path):
    a, b = "10.0.0.1", "10.0.0.2"
    rows = [(0, frame(a, b, 5060, 5060, sip_message("INVITE sip:b@x SIP/2.0", "c1")))]
    rows += [(1 + i, frame(b, a, 5060, 5060, sip_message(f"SIP/2.0 {s}", "c1"))) for i, s in enumerate(("180 Ringing", "200 OK"))]
    rows += [(3, frame(a, b, 5060, 5060, sip_message("ACK sip:b@x SIP/2.0", "c1", "ACK")))]
    rows += [(5 + i, frame(a, b, 49152, 49154, rtp_packet(i, 0xAABBCC01))) for i in range(20)] + [(5 + i, frame(b, a, 49154, 49152, rtp_packet(i, 0xAABBCC02))) for i in range(20)]
    rows += [(35, frame(a, b, 5060, 5060, sip_message("BYE sip:b@x SIP/2.0", "c1", "BYE"))), (36, frame(b, a, 5060, 5060, sip_message("SIP/2.0 200 OK", "c1", "BYE")))]
    types, rules, titles = judged(load(spark, tmp_path, sorted(rows, key=lambda x: x[0])), tmp_path)
    assert types == {"SIP": 1, "RTP": 2, "UDP": 2}
    assert rules == {"rtp_jitter": 2, "qos_degradation": 2, "protocol_mismatch": 2, "unusual_port": 1}
    assert {"High Jitter (593.5ms)", "QoS Degradation (est. MOS 1.3)", "Unusual SIP Port (0 -> 0)", "Protocol Mismatch (port 5060)"} == titles


def test_invite_flood(spark, tmp_path):
    rows = [(i / 10, frame("10.1.1.1", "10.0.0.2", 5060, 5060, sip_message("INVITE sip:b@x SIP/2.0", f"c{i}"))) for i in range(25)]
    types, rules, _ = judged(load(spark, tmp_path, rows), tmp_path)
    assert types == {"SIP": 25, "UDP": 1}
    assert rules == {"protocol_mismatch": 2, "sip_invite_flood": 1, "traffic_concentration": 2, "unusual_port": 1}


def test_dns_tunnel(spark, tmp_path):
    rows = [(i / 10, frame("10.0.0.1", "8.8.8.8", 10000 + i, 53, question(f"{'abcdefghijkmnpqrstuvwxyz0123456789ABCDEFGHJKLMNPQRST'[i % 5:46 + i % 5]}{i:02d}.evil.com", i + 1))) for i in range(12)]
    types, rules, titles = judged(load(spark, tmp_path, rows), tmp_path)
    assert types == {"DNS": 12, "UDP": 12}
    assert rules == {"dns_errors": 12, "protocol_mismatch": 12, "dns_dga": 12, "dns_tunneling": 1, "repeated_failures": 1, "traffic_concentration": 2}
    assert "DNS Tunneling: evil.com (score=6)" in titles


def test_dns_generated_names(spark, tmp_path):
    names = ["xk3mq9p2r7n5t8y", "b7vn2kq8zx4mw1p", "q9zt5hx2lv7kd3m", "w4rj8yc6nb1sg0f", "m2pd7xk9vq3tz5l"]
    _, rules, _ = judged(load(spark, tmp_path, [(i / 5, frame("10.0.0.1", "8.8.8.8", 20000 + i, 53, question(f"{n}.ru", i + 1))) for i, n in enumerate(names)]), tmp_path)
    assert rules == {"dns_errors": 5, "protocol_mismatch": 5, "dns_dga": 5, "repeated_failures": 1, "traffic_concentration": 2}


def test_http_login(spark, tmp_path):
    a, b = ("10.0.0.1", "10.0.0.2", 4000, 80), ("10.0.0.2", "10.0.0.1", 80, 4000)
    post, ok = b"POST /login HTTP/1.1\r\nHost: x\r\nContent-Length: 3\r\n\r\na=b", b"HTTP/1.1 200 OK\r\nContent-Length: 2\r\n\r\nok"
    rows = [frame(*a, proto=6, flags=2, seq=0), frame(*b, proto=6, flags=18, seq=0, ack=1), frame(*a, proto=6, flags=16, seq=1, ack=1), frame(*a, post, 6, 24, 1, 1), frame(*b, ok, 6, 24, 1, 1 + len(post)), frame(*a, proto=6, flags=17, seq=1 + len(post), ack=1 + len(ok)), frame(*b, proto=6, flags=17, seq=1 + len(ok), ack=2 + len(post))]
    packets = load(spark, tmp_path, [(i / 100, f) for i, f in enumerate(rows)])
    types, rules, _ = judged(packets, tmp_path)
    assert types == {"HTTP": 1, "TCP": 1} and not rules
    r = decoders.http(packets).first()
    assert (r.method, r.status_code, r.is_error, r.latency_ms) == ("POST", 200, False, 10.0)


def test_nothing(spark, tmp_path):
    assert judged(load(spark, tmp_path, []), tmp_path) == (Counter(), Counter(), set())


def test_unknown_payloads_are_transport_flows(spark, tmp_path):
    packets = load(spark, tmp_path, [(0, frame("10.0.0.1", "10.0.0.2", 5000, 1883, b"\x10\x0c\x00\x04MQTT", 6, 24)), (1, frame("10.0.0.1", "10.0.0.2", 8, 0, b"ping", 1)), (2, frame("10.0.0.2", "10.0.0.1", 0, 0, b"ping", 1))])
    assert Counter(r.type for r in decoders.decode(packets).collect()) == {"TCP": 1, "ICMP": 1}


def test_mobile_core_messages(spark, tmp_path):
    tlv = lambda kind, body: struct.pack(">BHB", kind, len(body), 0) + body
    ies = tlv(1, bytes.fromhex("00011032547698f0")[:8]) + tlv(71, b"\x08internet") + tlv(79, b"\x01\x0a\x00\x00\x05") + tlv(2, b"\x48\x00")
    create = struct.pack(">BBHIBBBB", 0x48, 33, 8 + len(ies), 0x1234, 0, 0, 1, 0) + ies
    avp = lambda code, body: struct.pack(">IB", code, 64) + (8 + len(body)).to_bytes(3, "big") + body.ljust((len(body) + 3) // 4 * 4, b"\0")
    avps = avp(263, b"s;1") + avp(268, struct.pack(">I", 5001)) + avp(1, b"001010000000001")
    dia = b"\x01" + (20 + len(avps)).to_bytes(3, "big") + b"\x00" + (316).to_bytes(3, "big") + struct.pack(">III", 16777251, 1, 1) + avps
    session = struct.pack(">BBHQI", 0x21, 51, 17, 9, 256) + struct.pack(">HHB", 19, 1, 72)
    rows = [frame("1.1.1.1", "2.2.2.2", 2123, 2123, create), frame("1.1.1.1", "2.2.2.2", 3868, 4000, dia, 6, 24), frame("1.1.1.1", "2.2.2.2", 8805, 8805, session), frame("1.1.1.1", "2.2.2.2", 2152, 2152, struct.pack(">BBHI", 0x30, 255, 0, 0xABC)), frame("1.1.1.1", "2.2.2.2", 36412, 1, b"\x00\x0c\x40", 132), frame("1.1.1.1", "2.2.2.2", 38412, 1, bytes(16) + b"\x00\x0f\x40\x01", 132)]
    packets = load(spark, tmp_path, [(i, f) for i, f in enumerate(rows)])
    by = {r.type: r for r in decoders.decode(packets, ["gtp", "diameter", "pfcp", "s1ap", "ngap"]).collect()}
    assert (by["GTP"].message_type, by["GTP"].teid, by["GTP"].cause_code, by["GTP"].is_error, by["GTP"].imsi, by["GTP"].apn, by["GTP"].ue_ip) == ("Create Session Response", "0x00001234", 72, True, "001001234567890"[:0] + wire.bcd(bytes.fromhex("00011032547698f0")), "internet", "10.0.0.5")
    assert (by["GTPU"].teid, by["GTPU"].message_type) == ("0x00000abc", "G-PDU")
    assert (by["Diameter"].command, by["Diameter"].result_code, by["Diameter"].is_error, by["Diameter"].imsi) == ("Update-Location", 5001, True, "001010000000001")
    assert (by["PFCP"].message_type, by["PFCP"].cause_code, by["PFCP"].is_error) == ("Session Establishment Response", 72, True)
    assert by["S1AP"].message_type == "InitialUEMessage" and by["NGAP"].message_type == "InitialUEMessage"


def test_dns_answers_and_tls_hello(spark, tmp_path):
    name = b"\x03www\x07example\x03com\x00"
    answer = struct.pack(">6H", 5, 0x8180, 1, 2, 0, 0) + name + struct.pack(">2H", 1, 1) + b"\xc0\x0c" + struct.pack(">HHIH", 5, 1, 60, 4) + b"\x01a\xc0\x10" + b"\xc0\x0c" + struct.pack(">HHIH", 1, 1, 60, 4) + bytes([1, 2, 3, 4])
    assert wire.dns(answer) == (5, True, "www.example.com", "A", "NOERROR", ["a.example.com", "1.2.3.4"])
    assert wire.dns(b"\0" * 11) is None
    sni = struct.pack(">HBH", 6, 0, 3) + b"a.b"
    ext = struct.pack(">2H", 0, len(sni)) + sni + struct.pack(">2H", 43, 3) + b"\x02\x03\x04"
    hello = b"\x03\x03" + bytes(32) + b"\x00" + struct.pack(">H3H", 6, 0x1301, 0x0A0A, 0xC02F) + b"\x01\x00" + struct.pack(">H", len(ext)) + ext
    record = b"\x16\x03\x01" + struct.pack(">H", 4 + len(hello)) + b"\x01" + len(hello).to_bytes(3, "big") + hello
    packets = load(spark, tmp_path, [(0, frame("1.1.1.1", "2.2.2.2", 4000, 443, record, 6, 24)), (1, frame("1.1.1.1", "2.2.2.2", 9, 53, question("a.b.c", 5))), (1.05, frame("2.2.2.2", "1.1.1.1", 53, 9, answer))])
    r = decoders.tls(packets).first()
    assert (r.sni, r.tls_version, r.dst_port, len(r.ja3_hash)) == ("a.b", "TLS 1.3", 443, 32)
    d = decoders.dns(packets).first()
    assert (d.query_name, d.latency_ms, d.reply_code, d.answers, d.is_error) == ("a.b.c", 50.0, "NOERROR", ["a.example.com", "1.2.3.4"], False)
    assert packets.where(F.col("protocol") == "UDP").count() == 2


def test_files_that_are_no_captures_are_listed_and_the_others_read(spark, tmp_path):
    one = [(0, frame("10.0.0.1", "10.0.0.2", 1000, 2000, b"x")), (1, frame("10.0.0.1", "10.0.0.2", 1000, 2000, b"y"))]
    (tmp_path / "good.pcap").write_bytes(pcap(one))
    (tmp_path / "text.pcap").write_bytes(b"no capture at all, but some bytes of text")
    (tmp_path / "empty.pcap").write_bytes(b"")
    lost = pcapng(one)
    at = lost.index(struct.pack("<I", 6), 28)
    (tmp_path / "lost.pcapng").write_bytes(lost[: at + 8] + struct.pack("<I", 9) + lost[at + 12 :])
    found = {r.file.rsplit("/", 1)[1]: r for r in capture_files(spark, str(tmp_path)).collect()}
    assert {f: r.frames for f, r in found.items()} == {"good.pcap": 2, "text.pcap": 0, "lost.pcapng": 0}  # the file source passes over empty files
    assert [f for f, r in found.items() if r.error is None] == ["good.pcap"]
    assert Counter(r.file.rsplit("/", 1)[1] for r in read_pcap(spark, str(tmp_path)).collect()) == {"good.pcap": 2}
    limited = capture_files(spark, str(tmp_path), largest=10).where("length > 10").collect()
    assert len(limited) == 3 and all(r.error == "larger than allowed" and r.frames is None for r in limited)


def exchange(n=40):
    """A connection with four requests, and other traffic: frames of one capture in order of time."""
    a, b = ("10.0.0.1", "10.0.0.2", 4000, 80), ("10.0.0.2", "10.0.0.1", 80, 4000)
    rows, seq, ack = [], 1, 1
    for i in range(n):
        asked = f"GET /{i} HTTP/1.1\r\n\r\n".encode()
        told = f"HTTP/1.1 {(200, 404, 500, 201)[i % 4]} x\r\nContent-Length: {i}\r\n\r\n".encode() + bytes(i)
        rows += [(i, frame(*a, asked, 6, 24, seq, ack)), (i + 0.1, bytes(12) + b"\x08\x06" + bytes(30)), (i + 0.5, frame(*b, told[:20], 6, 24, ack, seq + len(asked))), (i + 0.6, frame(*b, told[20:], 6, 24, ack + 20, seq + len(asked)))]
        rows += [(i + 0.7, frame("10.0.0.1", "10.0.0.2", 5000, 6000, rtp_packet(i, 9)))]
        seq, ack = seq + len(asked), ack + len(told)
    return rows


def shown(packets):
    return sorted(map(str, packets.drop("file").collect()))


@pytest.mark.parametrize("write", [pcap, pcapng])
def test_any_part_size_gives_what_a_sequential_reader_gives(spark, tmp_path, write):
    rows = exchange(12)
    inner = pcap([(i / 10, frame("9.9.9.9", "8.8.8.8", 1, 2, b"inner")) for i in range(30)])  # a capture that a packet carries
    rows = sorted([*rows, (5.05, frame("10.0.0.3", "10.0.0.4", 21, 22, inner + pcapng([(0, frame("9.9.9.9", "8.8.8.8", 1, 2, b"inner"))] * 20)))], key=lambda r: r[0])
    data = write(rows) if write is pcap else write(rows[:20]) + write(rows[20:])  # two sections
    (tmp_path / "x.pcap").write_bytes(data + b"\x01\x02\x03")
    want = shown(read_pcap(spark, str(tmp_path)))
    assert len(want) == 12 * 4 + 1
    for size in (37, 100, 333, 1000, len(data) - 1):
        assert shown(read_pcap(spark, str(tmp_path), part_size=size)) == want, size
        assert [r.frames for r in capture_files(spark, str(tmp_path), part_size=size).collect()] == [len(rows)]


@pytest.mark.parametrize("deal", [lambda i, n: i * 3 // n, lambda i, n: i % 2, lambda i, n: (i * 7919) % 3])
def test_several_files_are_one_capture(spark, tmp_path, deal):
    from packetlake.operators import reassembly, tracker

    rows = exchange(8)
    for folder in ("one", "more"):
        (tmp_path / folder).mkdir()
    (tmp_path / "one" / "x.pcap").write_bytes(pcap(rows))
    files = {}
    for i, r in enumerate(rows):
        files.setdefault(deal(i, len(rows)), []).append(r)
    for k, part in files.items():
        (tmp_path / "more" / f"{9 - k}.pcap").write_bytes(pcap(part))
    one, more = (read_pcap(spark, str(tmp_path / f)).cache() for f in ("one", "more"))
    assert shown(more) == shown(one)
    for made in (lambda p: decoders.decode(p, ["http", "rtp", "transport"]), tracker.track, reassembly.messages):
        assert shown(made(more)) == shown(made(one))
    latency = {r.flow_id: (r.status_code, r.latency_ms) for r in decoders.http(reassembly.with_messages(more)).collect()}
    assert latency["http-1"] == (200, 600.0) and {x[1] for x in latency.values()} == {600.0}


def test_files_that_only_spark_reaches_come_whole(spark, tmp_path, monkeypatch):
    from packetlake.sources import pcap as module

    rows = exchange(5)
    for k in range(2):
        (tmp_path / f"{k}.pcap").write_bytes(pcap(rows[k::2]))
    want = shown(read_pcap(spark, str(tmp_path)))
    monkeypatch.setattr(module, "can_split", lambda path: False)
    assert shown(read_pcap(spark, str(tmp_path))) == want
    assert {r.frames for r in capture_files(spark, str(tmp_path)).collect()} == {12, 13}
