"""What the tasks of one job agree on while it runs: who works on a partition, and when the next call may be made.

The driver holds both, for the time of one action, behind an authenticated socket at ``spark.driver.host``; a task keeps
one connection. A partition belongs to the attempt whose connection claimed it first; another attempt of it, be it a retry
or a speculative copy, waits until that connection closes, which it does when the attempt ends, however it ends. Calls of
all tasks draw from one token bucket, so that tasks that are done leave their share to the others.
"""

from __future__ import annotations

import secrets
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass
from multiprocessing.connection import Client, Connection, Listener

from pyspark.sql import SparkSession


class Bucket:
    """A token bucket: ``rate`` calls a second, up to max(1, rate) of them at once; rate 0 sets no limit. Calls are given
    out in turn: ``reserve`` returns the seconds that a call has to wait."""

    def __init__(self, rate: float, clock: Callable[[], float] = time.monotonic):
        self.rate, self.size, self.clock = rate, max(1.0, rate), clock
        self.tokens, self.at, self.lock = self.size, clock(), threading.Lock()

    def reserve(self) -> float:
        if not self.rate:
            return 0.0
        with self.lock:
            now = self.clock()
            self.tokens = min(self.size, self.tokens + (now - self.at) * self.rate) - 1
            self.at = now
            return max(0.0, -self.tokens / self.rate)


@dataclass(frozen=True)
class Address:
    """Where and with what a task reports; goes to the tasks."""

    host: str
    port: int
    key: bytes

    def connect(self) -> Lease:
        return Lease(Client((self.host, self.port), authkey=self.key))


class Lease:
    """A task's connection; closing it gives up its claim."""

    def __init__(self, connection: Connection, sleep: Callable[[float], None] = time.sleep):
        self.connection, self.sleep = connection, sleep

    def claim(self, part: int) -> None:
        """Returns once no other connection holds the partition."""
        self.connection.send(("claim", part))
        self.connection.recv()

    def wait(self) -> float:
        """Sleeps until the next call may be made; returns for how long."""
        self.connection.send(("call", 0))
        pause = self.connection.recv()
        if pause:
            self.sleep(pause)
        return pause

    def close(self) -> None:
        self.connection.close()

    def __enter__(self) -> Lease:
        return self

    def __exit__(self, *_) -> None:
        self.close()


class Coordinator:
    """The driver's side, as a context around the action."""

    def __init__(self, rate: float, host: str = "127.0.0.1"):
        self.bucket, self.claims, self.free = Bucket(rate), set(), threading.Condition()
        self.open: set[Connection] = set()
        key = secrets.token_bytes(32)
        self.listener = Listener(("", 0), backlog=512, authkey=key)
        self.address, self.ended = Address(host, self.listener.address[1], key), False

    @classmethod
    def of(cls, spark: SparkSession, rate: float) -> Coordinator:
        return cls(rate, spark.conf.get("spark.driver.host", "127.0.0.1"))

    def __enter__(self) -> Coordinator:
        threading.Thread(target=self._accept, daemon=True).start()
        return self

    def __exit__(self, *_) -> None:
        with self.free:
            self.ended = True
            self.free.notify_all()
            for connection in self.open:
                connection.close()
        self.listener.close()

    def _accept(self) -> None:
        while not self.ended:
            try:
                connection = self.listener.accept()
            except Exception:  # a stranger without the key, or the end
                continue
            threading.Thread(target=self._serve, args=(connection,), daemon=True).start()

    def _serve(self, connection: Connection) -> None:
        mine: set[int] = set()
        self.open.add(connection)
        try:
            while True:
                what, part = connection.recv()
                if what == "call":
                    connection.send(self.bucket.reserve())
                    continue
                with self.free:
                    while part in self.claims and not self.ended:
                        self.free.wait(1.0)
                        if connection.poll():  # whoever waits says nothing: the other end is gone
                            return
                    self.claims.add(part)
                    mine.add(part)
                connection.send(True)
        except (EOFError, OSError):
            pass
        finally:
            with self.free:
                self.claims -= mine
                self.open.discard(connection)
                self.free.notify_all()
