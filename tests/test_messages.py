"""Message parsers on bytes, reassembly on split streams, and rules from packets to alerts."""

import struct

import pytest

from packetlake.operators import decoders, detect, reassembly
from packetlake.plans import all_queries
from packetlake.sources import messages
from tests.oracle import compare, connect
from tests.test_capture import frame, load, sip_message

SF = "/root/testdata/sf0.001"


def test_what_stands_at_the_start():
    whole = b"POST / HTTP/1.1\r\nContent-Length: 4\r\n\r\nabcd"
    text, tls, diameter, ajp = (reassembly.FRAMERS[k] for k in ("text", "tls", "diameter", "ajp"))
    assert text(whole + b"GET") == text(whole[:-1]) == ("message", len(whole)) and text(whole[:20]) == text(b"POS") == text(b"HTTP/1.1 2") == ("wait", None)
    assert text(b"\x81\x05hello") == ("skip", 7) and text(b"tail\r\n" + whole) == ("skip", 6) and text(b"tail" + whole) == ("skip", 4) and text(b"tail\nGET /a") == ("skip", 5)
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: gzip, chunked\r\n\r\n3;x\r\nabc\r\n0\r\nA: b\r\n\r\n"
    assert text(chunked + b"HTTP/1.1 404 No\r\n\r\n") == ("message", len(chunked)) and all(text(chunked[:k]) == ("wait", None) for k in range(1, len(chunked)))
    record = b"\x16\x03\x03\x00\x02ab"
    assert tls(record + b"\x17") == ("message", 7) and tls(b"\x16\x03\x03\x00\x09ab") == ("message", 14) and tls(b"lost \x16\x03 bytes" + record + record) == ("skip", 13)
    assert tls(b"nothing at all") == ("skip", 14) and tls(b"\x16\x03\x03") == ("wait", None)
    assert diameter(b"\x01\x00\x00\x14" + bytes(20)) == ("message", 20) and diameter(b"\x01" * 9 + b"\x01\x00\x00\x14" + bytes(16)) == ("skip", 9)
    assert ajp(b"AB\x00\x02\x05\x01zz") == ("message", 6)


def pieces(framer, data, size, largest=reassembly.LARGEST):
    stream, out = reassembly.Stream(framer, largest), []
    for k in range(0, len(data), size):
        out += stream.add(data[k : k + size], k)
    return [(d, n) for d, n, _, _ in [*out, *stream.end()]]


REQUESTS = [b"GET /%d HTTP/1.1\r\nContent-Length: %d\r\n\r\n" % (i, i) + b"x" * i for i in range(5)]
CHUNKS = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nGET \r\n0\r\n\r\n"


@pytest.mark.parametrize("size", [1, 2, 7, 33, 10_000])
def test_streams_caught_midway_lose_no_message(size):
    for before in (b"", b"rest of a body that started before\r\n", b"\x00\x01 binary GET rest"):
        found = [d for d, _ in pieces("text", before + REQUESTS[0] + CHUNKS + b"".join(REQUESTS[1:]), size)]
        assert [d for d in found if d.startswith((b"GET /", b"HTTP"))] == [REQUESTS[0], CHUNKS, *REQUESTS[1:]] and b"".join(found) == before + REQUESTS[0] + CHUNKS + b"".join(REQUESTS[1:])
    records = [b"\x17\x03\x03" + struct.pack(">H", n) + bytes(n) for n in (3, 300, 0, 40)]
    assert [d for d, _ in pieces("tls", b"end of a record" + b"".join(records), size)][-4:] == records
    commands = [b"\x01" + (20 + 4 * n).to_bytes(3, "big") + bytes(16 + 4 * n) for n in range(4)]
    assert [d for d, _ in pieces("diameter", b"\x02" * 23 + b"".join(commands), size)][-4:] == commands


@pytest.mark.parametrize("size", [1, 5, 1000])
def test_frames_after_an_upgrade(size):
    asked = b"GET /ws HTTP/1.1\r\nUpgrade: websocket\r\n\r\n"
    frames = [b"\x81\x85\1\2\3\4hello", b"\x82\x7e\x01\x00" + bytes(256), b"\x88\x00"]
    assert [d for d, _ in pieces("text", asked + b"".join(frames), size)] == [asked, *frames]
    assert [d for d, _ in pieces("text", asked + REQUESTS[2] + REQUESTS[3], size)] == [asked, REQUESTS[2], REQUESTS[3]]  # refused


@pytest.mark.parametrize("size", [9, 64, 5000])
def test_long_messages_keep_their_first_bytes_and_those_after_them_are_whole(size):
    long = b"POST /l HTTP/1.1\r\nContent-Length: 1900\r\n\r\n" + b"GET /0 HTTP/1.1\r\n\r\n" * 100
    endless = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"64\r\n" + b"y" * 100 + b"\r\n"
    found = pieces("text", REQUESTS[1] + long + REQUESTS[2], size, 128)
    assert found == [(REQUESTS[1], len(REQUESTS[1])), (long[:128], len(long)), (REQUESTS[2], len(REQUESTS[2]))]
    assert (REQUESTS[3], len(REQUESTS[3])) in pieces("text", endless * 3 + REQUESTS[3], size, 128)


def test_messages_of_a_segment_have_ids_of_their_own(spark, tmp_path):
    command = lambda n: b"\x01" + (20).to_bytes(3, "big") + b"\x80" + (316).to_bytes(3, "big") + struct.pack(">III", 16777251, n, n)
    packets = load(spark, tmp_path, [(0, frame("10.0.0.1", "10.0.0.2", 5000, 3868, b"rest" + command(1) + command(2) + command(3)[:9], 6, 24, 1)), (1, frame("10.0.0.1", "10.0.0.2", 5000, 3868, command(3)[9:], 6, 24, 1 + 4 + 40 + 9))])
    assert sorted(r.flow_id for r in decoders.decode(packets, ["diameter"]).collect()) == ["diameter-1.1", "diameter-1.2", "diameter-1.3"]


def test_jobs_are_apart(spark, tmp_path):
    from packetlake.operators import tracker

    ask, told = b"GET / HTTP/1.1\r\n\r\n", b"HTTP/1.1 200 OK\r\n\r\n"
    one = load(spark, tmp_path, [(i / 10, frame("10.0.0.1", "10.0.0.2", 5000, 80, ask, 6, 24, 1 + len(ask) * (i // 2)) if i % 2 == 0 else frame("10.0.0.2", "10.0.0.1", 80, 5000, told, 6, 24, 1 + len(told) * (i // 2))) for i in range(6)])
    both = one.unionByName(one.withColumn("job_id", one.job_id + 1))
    for made in (tracker.track, lambda p: decoders.decode(p, ["http", "transport"])):
        alone = sorted(map(str, made(one).drop("job_id").collect()))
        for job in (0, 1):
            assert sorted(map(str, made(both).where(f"job_id = {job}").drop("job_id").collect())) == alone


@pytest.mark.parametrize("name", ["decode_segments", "decode_tls", "decode_http2", "decode_nas5g", "decode_gtp", "decode_pfcp", "decode_ngap", "decode_snmp", "decode_ajp", "decode_websocket", "decode_http", "decode_sip", "decode_dns"])
def test_decoders_against_the_fields_of_their_bytes(spark, name):
    queries, sql = all_queries()
    assert compare(queries[name](spark, SF), connect(SF).sql(sql[name])) > 0


def alerts_of(spark, tmp_path, frames, decode, *rules):
    packets = load(spark, tmp_path, [(i / 100, f) for i, f in enumerate(frames)])
    flows = decoders.decode(packets, [decode])
    return sorted(r.title for r in detect.run(flows, list(rules)).collect())


def hello(kind, rest):
    body = b"\x03\x03" + b"\x11" * 32 + b"\0" + rest
    body = bytes([kind]) + len(body).to_bytes(3, "big") + body
    return b"\x16\x03\x03" + struct.pack(">H", len(body)) + body


TLS_RULES = ("tls_downgrade", "tls_weak_cipher", "tls_ja3", "tls_self_signed")
CLIENT = hello(1, b"\0\x02\x13\x01\x01\0\0\0")


def test_a_clean_connection_raises_nothing_and_a_lone_hello_neither(spark, tmp_path):
    clean = [frame("10.0.0.9", "9.9.9.9", 5000, 443, CLIENT, 6, 24, 1), frame("9.9.9.9", "10.0.0.9", 443, 5000, hello(2, b"\xc0\x2f\0"), 6, 24, 1), frame("10.0.0.8", "9.9.9.9", 5000, 443, CLIENT, 6, 24, 1)]
    assert alerts_of(spark, tmp_path, clean, "tls", *TLS_RULES) == []


def test_weak_cipher_and_own_certificate_over_segments(spark, tmp_path):
    name = lambda t: b"\x55\x04\x03\x0c" + bytes([len(t)]) + t
    body = name(b"own") + name(b"own")
    certificate = b"\x16\x03\x03" + struct.pack(">H", len(body) + 4) + b"\x0b" + len(body).to_bytes(3, "big") + body
    answer = hello(2, b"\x00\x05\0") + certificate
    rows = [frame("10.0.0.9", "9.9.9.9", 5000, 443, hello(1, b"\0\x02\0\x05\x01\0" + b"\0\x0e" + b"\0\0\0\x0a\0\x08\0\0\x05a.com"), 6, 24, 1)]
    rows += [frame("9.9.9.9", "10.0.0.9", 443, 5000, answer[k : k + 30], 6, 24, 1 + k) for k in (60, 0, 30, 90)]
    found = alerts_of(spark, tmp_path, rows, "tls", *TLS_RULES)
    assert "Self-Signed Cert: a.com (9.9.9.9)" in found and any(t.startswith("No Forward Secrecy") for t in found) and not any("null" in t for t in found)


def test_core_network_rules_fire_from_packets(spark, tmp_path):
    nas = [frame("10.0.0.1", "10.0.0.2", 38412, 38412, b"\0\4\x40\1\x7e\0\x5a\x15", 132) for _ in range(12)]
    assert alerts_of(spark, tmp_path, nas, "nas5g", "nas_auth_failures") == ["NAS Authentication Failure Storm"]


def test_session_and_service_rules_fire_from_packets(spark, tmp_path):
    sessions = [frame("10.0.0.1", "10.0.0.2", 38412, 38412, b"\0\4\x40\1\x2e\5\1\xc1\xff\xff", 132) for _ in range(101)]
    assert alerts_of(spark, tmp_path, sessions, "nas5g", "pdu_session_flood") == ["PDU Session Establishment Flood"]


def test_dropping_rules_and_failing_services(spark, tmp_path):
    ie = lambda k, v: struct.pack(">2H", k, len(v)) + v
    drop = [frame("10.0.0.1", "10.0.0.2", 8805, 8805, struct.pack(">BBHQI", 0x21, 50, 0, 7, 256) + ie(3, ie(44, b"\1"))) for _ in range(3)]
    assert alerts_of(spark, tmp_path, drop, "pfcp", "pfcp_drop_rate") == ["PFCP High DROP Action Rate"]


def test_registrations_at_the_repository_function(spark, tmp_path):
    path = b"/nnrf-nfm/v1/x"
    block = b"\x42\x03PUT\x44" + bytes([len(path)]) + path + b"\x48\x03503"
    payload = len(block).to_bytes(3, "big") + b"\x01\x04\0\0\0\1" + block
    rows = [frame("10.0.0.1", "10.0.0.2", 5000 + i, 7777, payload, 6, 24) for i in range(51)]
    assert alerts_of(spark, tmp_path, rows, "http2", "nf_registration_storm", "sbi_error_rate") == ["NF Registration Storm", "SBI High 5xx Error Rate"]


def test_a_call_over_segments(spark, tmp_path):
    text = sip_message("INVITE sip:b@x SIP/2.0", "c9")
    rows = [(i / 10, frame("10.0.0.1", "10.0.0.2", 5060, 5060, text[k : k + 25], 6, 24, 1 + k)) for i, k in enumerate(range(0, len(text), 25))]
    flows = decoders.decode(load(spark, tmp_path, rows), ["sip"]).collect()
    assert [(r.flow_id, r.method, r.packets) for r in flows] == [("c9", "INVITE", 1)]


def test_foreign_bytes_give_nothing():
    for parse in (messages.gtp, messages.pfcp, messages.nas5g, messages.http2, messages.snmp, messages.ajp, messages.websocket, messages.rtcp, messages.tls_records, messages.concealed_imsi):
        for data in (b"", b"\0", b"\xff" * 40, b"text of some kind"):
            try:
                parse(data)
            except (IndexError, ValueError, struct.error):
                pass
