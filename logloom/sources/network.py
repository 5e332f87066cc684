"""Syslog over UDP and TCP as a streaming source: spark.dataSource.register(Syslog), then readStream.format("syslog").

The socket is opened where Spark runs the reader. Deliveries wait in a bounded queue; a full one holds TCP senders
back, while datagrams that find it full are counted as lost, as the network loses them anyway. A batch is kept until
Spark has committed it, so it can be read again.
"""

from __future__ import annotations

import queue
import socket
import socketserver
import threading
import time
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from logloom.sources.lines import CHANNELS, CUT_AT, MAX_BYTES

SCHEMA = "payload binary, env struct<channel:tinyint,peer:string,listener:string,received_ns:bigint,truncated:boolean>"


class Gate:
    """Who may deliver, and how much at once; what was refused is counted."""

    def __init__(self, protocol: str, listener: str, allow: frozenset[str], max_bytes: int, waiting: int):
        self.channel, self.listener, self.allow, self.max_bytes = CHANNELS[f"syslog_{protocol}"], listener, allow, max_bytes
        self.waiting: queue.Queue = queue.Queue(waiting)
        self.counts = dict.fromkeys(("accepted", "unknown_source", "oversize", "lost"), 0)

    def admit(self, data: bytes, peer: str, block: bool) -> None:
        payload = data.rstrip(b"\r\n")
        outcome = "unknown_source" if self.allow and peer not in self.allow else "oversize" if len(data) > self.max_bytes else "accepted"
        if outcome == "accepted" and payload.strip():
            row = (payload, (self.channel, peer, self.listener, time.time_ns(), len(data) >= CUT_AT))
            try:
                self.waiting.put(row, block=block)
            except queue.Full:
                outcome = "lost"
        self.counts[outcome] += 1

    def taken(self, most: int, wait_s: float) -> list[tuple]:
        """What waits, up to so many; of nothing, what comes within the time."""
        rows: list[tuple] = []
        try:
            while len(rows) < most:
                rows.append(self.waiting.get(block=not rows, timeout=wait_s))
        except queue.Empty:
            pass
        return rows


def _datagrams(gate: Gate, host: str, port: int) -> socket.socket:
    listening = socket.socket(socket.AF_INET, socket.SOCK_DGRAM)
    listening.bind((host, port))

    def run() -> None:
        while True:
            try:
                data, (peer, _) = listening.recvfrom(65_536)
            except OSError:  # closed
                return
            gate.admit(data, peer, block=False)

    threading.Thread(target=run, daemon=True).start()
    return listening


def _connections(gate: Gate, host: str, port: int) -> socketserver.BaseServer:
    class Lines(socketserver.StreamRequestHandler):
        def handle(self) -> None:
            # a line is read up to the limit and a byte: what is longer is refused whole, however long it gets
            while data := self.rfile.readline(gate.max_bytes + 1):
                size, ended = len(data), data.endswith(b"\n")
                while not ended and size > gate.max_bytes and (more := self.rfile.readline(65_536)):
                    ended = more.endswith(b"\n")
                gate.admit(data, self.client_address[0], block=True)

    class Server(socketserver.ThreadingTCPServer):
        allow_reuse_address, daemon_threads = True, True

    server = Server((host, port), Lines)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    return server


class Reader(SimpleDataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        protocol, host, port = options.get("protocol", "udp"), options.get("host", "127.0.0.1"), int(options["port"])
        if protocol not in ("udp", "tcp"):
            raise ValueError(f"no protocol {protocol}")
        allow = frozenset(p.strip() for p in options.get("allow", "").split(",") if p.strip())
        self.address, self.protocol, self.allow = (host, port), protocol, allow
        self.max_bytes, self.size = int(options.get("maxbytes", MAX_BYTES)), int(options.get("waiting", 100_000))
        self.most, self.wait_s = int(options.get("maxrows", 50_000)), float(options.get("waitms", 200)) / 1000
        self.kept: dict[int, list[tuple]] = {}
        self.gate, self.open = None, None

    def listen(self) -> None:
        """Spark makes readers that it never reads from, and sends copies of them to tasks; the socket belongs to the one
        that is read from."""
        if self.open is None:
            self.gate = Gate(self.protocol, f"{self.protocol}/{self.address[1]}", self.allow, self.max_bytes, self.size)
            self.open = (_datagrams if self.protocol == "udp" else _connections)(self.gate, *self.address)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"gate": None, "open": None, "kept": {}}

    def initialOffset(self) -> dict:
        return {"at": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        self.listen()
        rows = self.gate.taken(self.most, self.wait_s)
        if rows:
            self.kept[start["at"]] = rows
        return iter(rows), {"at": start["at"] + len(rows)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:
        rows = [r for at in sorted(self.kept) if start["at"] <= at < end["at"] for r in self.kept[at]]
        return iter(rows)

    def commit(self, end: dict) -> None:
        for at in [a for a, rows in self.kept.items() if a + len(rows) <= end["at"]]:
            del self.kept[at]


class Syslog(DataSource):
    """Options: protocol (udp or tcp), host, port, allow (peers, by commas), maxBytes, maxRows, waiting, waitMs."""

    @classmethod
    def name(cls) -> str:
        return "syslog"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema) -> Reader:
        return Reader({k.lower(): v for k, v in self.options.items()})
