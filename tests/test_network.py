import socket
import time

from logloom.plans import derive
from logloom.plans.grammar import Library
from logloom.sources import lines, network, sinks

LINE = b"1772627811.611 5 10.0.0.1 TCP_HIT/200 7 GET http://x/%d - h t"


def free_port(kind):
    with socket.socket(socket.AF_INET, kind) as s:
        s.bind(("127.0.0.1", 0))
        return s.getsockname()[1]


def until(condition, seconds=40):
    end = time.time() + seconds
    while not condition() and time.time() < end:
        time.sleep(0.2)
    return condition()


def test_gate_counts_what_it_refuses():
    gate = network.Gate("udp", "udp/1", frozenset({"a"}), 10, 2)
    for data, peer in [(b"x\r\n", "a"), (b"x", "b"), (b"x" * 11, "a"), (b" \n", "a"), (b"y", "a"), (b"z", "a")]:
        gate.admit(data, peer, block=False)
    assert gate.counts == {"accepted": 3, "unknown_source": 1, "oversize": 1, "lost": 1}
    assert [r[0] for r in gate.taken(10, 0.01)] == [b"x", b"y"]


def test_batches_are_kept_until_they_are_committed():
    port = free_port(socket.SOCK_DGRAM)
    reader = network.Reader({"port": str(port), "maxrows": "2"})
    reader.listen()
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        for k in range(3):
            s.sendto(b"line %d\n" % k, ("127.0.0.1", port))
    until(lambda: reader.gate.waiting.qsize() == 3, 5)
    rows, end = reader.read({"at": 0})
    rows2, end2 = reader.read(end)
    assert [r[0] for r in rows] == [b"line 0", b"line 1"] and end == {"at": 2} and [r[0] for r in rows2] == [b"line 2"]
    assert [r[0] for r in reader.readBetweenOffsets({"at": 0}, end2)] == [b"line 0", b"line 1", b"line 2"]
    reader.commit(end)
    assert [r[0] for r in reader.readBetweenOffsets({"at": 2}, end2)] == [b"line 2"] and list(reader.kept) == [2]
    reader.open.close()


def test_tcp_lines_become_rows_of_a_stream(spark):
    spark.dataSource.register(network.Syslog)
    port = free_port(socket.SOCK_STREAM)
    stream = spark.readStream.format("syslog").option("protocol", "tcp").option("port", port).option("maxBytes", 200).load()
    q = stream.writeStream.format("memory").queryName("received").start()

    def connected():
        try:
            return socket.create_connection(("127.0.0.1", port), timeout=1)
        except OSError:
            return None

    peer = None
    end = time.time() + 40
    while peer is None and time.time() < end:
        peer = connected()
        time.sleep(0.2)
    peer.sendall(b"\n".join([LINE % 1, b"x" * 5000, b"", LINE % 2 + b"\r", b"\xff\xfe last"]))
    peer.close()
    assert until(lambda: spark.table("received").count() == 3)
    q.stop()
    got = spark.table("received").collect()
    assert sorted(bytes(r.payload) for r in got) == sorted([LINE % 1, LINE % 2, b"\xff\xfe last"]) and got[0].env.listener == f"tcp/{port}"


def test_posted_bodies_and_datagrams_out(spark):
    bodies = spark.createDataFrame([(1, bytearray(LINE % 1 + b"\r\n\n" + LINE % 2)), (2, bytearray(b"\x00\x0a0\n")), (3, None)], "n int, body binary")
    rows = lines.posted(bodies)
    assert sorted((r.n, bytes(r.payload)) for r in rows.collect()) == [(1, LINE % 1), (1, LINE % 2), (2, b"\x00"), (2, b"0")]
    from logloom.operators import archive

    events = derive.events(derive.derive(archive.identified(lines.enveloped(rows.drop("n"), "http")).selectExpr("*", "0 AS stratum"), Library()))
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        s.settimeout(5)
        assert sum(r.sent for r in sinks.send_cef(events, *s.getsockname()).collect()) == 2
        assert s.recv(65536).startswith(b"CEF:0|Squid|")
