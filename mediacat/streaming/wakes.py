"""A list of messages as a streaming source, whose batches say when to run a pass.

Offsets count the messages that ever came: those taken off the list, a number that the list's
service keeps, and those that wait. A batch is begun at the start of a query, when messages
came, or when none came for some seconds (the sweep). Its messages are taken off only when the
next batch is planned, after its pass, so a restart loses none; all that wait cause one pass,
and those that arrive during a pass exactly one more. An error of the service is waited for in
the source and then tried again; the sweep goes on meanwhile.
"""

from __future__ import annotations

import socket
import time
from collections.abc import Iterator
from typing import Protocol
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

# Seconds to wait after an error of the service, its usual port.
BACK_OFF, PORT = 5.0, 6379
SCHEMA = "messages long, swept boolean"


class Messages(Protocol):
    """A list of messages; it is sent to the source's process."""

    def counts(self) -> tuple[int, int]:
        """How many messages were taken so far, and how many wait."""

    def take(self, n: int) -> None:
        """Takes the n oldest messages, and counts them as taken in the same step."""


class RedisList:
    """A list of a Redis service by url (redis://[:password@]host[:port][/number]); the number of messages taken is its key `<queue>:taken`."""

    def __init__(self, url: str, queue: str, timeout: float = 5.0):
        u = urlparse(url)
        if u.scheme != "redis" or not u.hostname:
            raise ValueError(f"not a redis url: {u.scheme}://{u.hostname or ''}")
        self.host, self.port, self.queue, self.timeout = u.hostname, u.port or PORT, queue, timeout
        self.first = []
        if u.password:
            self.first.append(["AUTH", *([unquote(u.username)] if u.username else []), unquote(u.password)])
        if number := u.path.strip("/"):
            self.first.append(["SELECT", number])

    def _ask(self, *commands: list) -> list:
        """Answers of commands that are carried out together."""
        lines = [*self.first, ["MULTI"], *commands, ["EXEC"]]
        with socket.create_connection((self.host, self.port), self.timeout) as s, s.makefile("rb") as answers:
            for words in lines:
                parts = [str(w).encode() for w in words]
                s.sendall(b"*%d\r\n" % len(parts) + b"".join(b"$%d\r\n%s\r\n" % (len(p), p) for p in parts))
            return [_answer(answers) for _ in lines][-1]

    def counts(self) -> tuple[int, int]:
        taken, waiting = self._ask(["GET", f"{self.queue}:taken"], ["LLEN", self.queue])
        return int(taken or 0), int(waiting)

    def take(self, n: int) -> None:
        self._ask(["LTRIM", self.queue, n, -1], ["INCRBY", f"{self.queue}:taken", n])


def _answer(lines):
    line = lines.readline()
    if not line.endswith(b"\r\n"):
        raise ConnectionError("the service closed the connection")
    kind, rest = line[:1], line[1:-2]
    if kind == b"-":
        raise ConnectionError(rest.decode("utf-8", "replace"))
    if kind == b"$":
        return None if rest == b"-1" else lines.read(int(rest) + 2)[:-2]
    if kind == b"*":
        return [_answer(lines) for _ in range(int(rest))]
    return int(rest) if kind == b":" else rest


class Span(InputPartition):
    def __init__(self, messages: int, swept: bool):
        self.messages, self.swept = messages, swept


class Reader(DataSourceStreamReader):
    def __init__(self, messages: Messages, seconds: float, back_off: float = BACK_OFF):
        self.messages, self.seconds, self.back_off = messages, seconds, back_off
        self.offset: dict | None = None
        self.idle: float | None = None

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seen": 0, "begun": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        """The last offset until there is a reason for a batch. The first call behind a batch comes when its pass is over, where the wait for the sweep begins."""
        now = time.time()
        try:
            seen = sum(self.messages.counts())
        except OSError:
            time.sleep(self.back_off)
            seen = self.offset["seen"] if self.offset else 0
        if self.offset and self.idle is None:
            self.idle = now
        if self.offset is None or seen > self.offset["seen"] or now - self.idle >= self.seconds:
            self.offset, self.idle = {"seen": seen, "begun": int(now * 1000)}, None
        return self.offset

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [] if start == end else [Span(max(0, end["seen"] - start["seen"]), end["seen"] == start["seen"])]

    def read(self, partition: Span) -> Iterator[tuple]:
        yield (partition.messages, partition.swept)

    def commit(self, end: dict) -> None:
        try:
            taken, waiting = self.messages.counts()
            if (n := min(end["seen"] - taken, waiting)) > 0:
                self.messages.take(n)
        except OSError:
            return  # they are taken with the next batch


def stream(spark: SparkSession, messages: Messages, seconds: float, back_off: float = BACK_OFF) -> DataFrame:
    """messages (how many came), swept (none came): a row for each time that a pass is due."""

    class Wakes(DataSource):
        @classmethod
        def name(cls) -> str:
            return "mediacat_wakes"

        def schema(self) -> str:
            return SCHEMA

        def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
            return Reader(messages, seconds, back_off)

    spark.dataSource.register(Wakes)
    return spark.readStream.format("mediacat_wakes").load()
