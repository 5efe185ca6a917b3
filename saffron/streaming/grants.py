"""One rate for the calls of all tasks, wherever they run: a service on the driver grants them.

A task holds one connection to the service and asks on it before each call; the service answers when its token bucket and
its slots allow (see limiter.Limiter), so the rate and the number of calls at once are those of all tasks together,
whether 4 or 400 run. A slot comes back when the task reports its call's end, or when its connection breaks, as it does
with a lost executor. Only those who know the service's secret are answered. Grants are a line each way, so a driver gives
some thousands a second, far above what providers allow.
"""

from __future__ import annotations

import hmac
import secrets
import socket
import socketserver
import threading
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import SparkSession

from .limiter import Limiter, TokenBucket

ASK, DONE, GO = b"ask\n", b"done\n", b"go\n"


class _Handler(socketserver.StreamRequestHandler):
    disable_nagle_algorithm = True  # else a line waits some 40 ms for the answer to the one before

    def handle(self) -> None:
        if not hmac.compare_digest(self.rfile.readline(200).strip(), self.server.secret.encode()):
            return
        while self.rfile.readline(20) == ASK:
            with self.server.limiter.call():
                self.wfile.write(GO)
                if self.rfile.readline(20) != DONE:
                    return


class _Server(socketserver.ThreadingTCPServer):
    daemon_threads, allow_reuse_address, request_queue_size = True, True, 512


@dataclass(frozen=True)
class Client:
    """What a task needs to know; it is sent with the task's code."""

    host: str
    port: int
    secret: str

    @contextmanager
    def connected(self):
        """Gives call(), a context for one call at a time."""
        with socket.create_connection((self.host, self.port)) as link, link.makefile("rb") as answers:
            link.setsockopt(socket.IPPROTO_TCP, socket.TCP_NODELAY, 1)
            link.sendall(self.secret.encode() + b"\n")

            @contextmanager
            def call():
                link.sendall(ASK)
                if answers.readline(20) != GO:
                    raise ConnectionError("the driver's grants have ended")
                try:
                    yield
                finally:
                    link.sendall(DONE)

            yield call


class Grants:
    """The service; it ends with the driver or by stop()."""

    def __init__(self, spark: SparkSession, rate_per_minute: float, at_once: int, burst: int | None = None):
        bucket = TokenBucket.per_minute(rate_per_minute) if burst is None else TokenBucket(rate_per_minute / 60, burst)
        host = spark.sparkContext.getConf().get("spark.driver.host") or socket.gethostname()
        # a driver behind another address binds to all of its own
        self.server = _Server((spark.sparkContext.getConf().get("spark.driver.bindAddress") or host, 0), _Handler)
        self.server.limiter, self.server.secret = Limiter(bucket, at_once), secrets.token_hex(16)
        self.client = Client(host, self.server.server_address[1], self.server.secret)
        threading.Thread(target=self.server.serve_forever, daemon=True).start()

    def stop(self) -> None:
        self.server.shutdown()
        self.server.server_close()


_running: dict[tuple, Grants] = {}


def shared(spark: SparkSession, rate_per_minute: float, at_once: int) -> Client:
    """The session's service of a rate and a number of slots, which all its jobs share."""
    key = (spark.sparkContext.applicationId, rate_per_minute, at_once)
    if key not in _running:
        _running[key] = Grants(spark, rate_per_minute, at_once)
    return _running[key].client
