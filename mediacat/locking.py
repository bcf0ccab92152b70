"""A lock with a lifetime: one run at a time on a destination, on any file system that runs share.

All that a lock needs is in `Files`: create a file only if there is none, read it, remove it.
`LocalFiles` is for one machine, `HadoopFiles` for destinations that several drivers reach.
"""

from __future__ import annotations

import json
import os
import socket
import uuid
from dataclasses import dataclass
from datetime import UTC, datetime, timedelta
from typing import Protocol

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

LOCK = ".transcoder.lock"


class Files(Protocol):
    def create(self, name: str, text: str) -> bool:
        """Writes a new file; False if there is one already."""

    def read(self, name: str) -> str | None:
        """The file's text; None if there is none."""

    def remove(self, name: str) -> None:
        """Removes the file if it is there."""


@dataclass
class LocalFiles:
    root: str

    def create(self, name: str, text: str) -> bool:
        path = os.path.join(self.root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        try:
            fd = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o644)
        except FileExistsError:
            return False
        with os.fdopen(fd, "w") as f:
            f.write(text)
        return True

    def read(self, name: str) -> str | None:
        try:
            with open(os.path.join(self.root, name)) as f:
                return f.read()
        except FileNotFoundError:
            return None

    def remove(self, name: str) -> None:
        try:
            os.unlink(os.path.join(self.root, name))
        except FileNotFoundError:
            pass


class HadoopFiles:
    """Files under a root of a Hadoop file system."""

    def __init__(self, spark: SparkSession, root: str):
        jvm = spark.sparkContext._jvm
        self._path = lambda name: jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}")
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._text = lambda stream: jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")

    def create(self, name: str, text: str) -> bool:
        try:
            stream = self._fs.create(self._path(name), False)
        except Py4JJavaError:
            if self._fs.exists(self._path(name)):
                return False
            raise
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def read(self, name: str) -> str | None:
        try:
            stream = self._fs.open(self._path(name))
        except Py4JJavaError:
            if not self._fs.exists(self._path(name)):
                return None
            raise
        try:
            return self._text(stream)
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self._fs.delete(self._path(name), False)


@dataclass
class Lock:
    files: Files
    name: str
    worker_id: str

    @property
    def path(self) -> str:
        return os.path.join(getattr(self.files, "root", ""), self.name)

    def release(self) -> None:
        """Removes the lock if it is still this worker's."""
        if (body := _body(self.files, self.name)) and body.get("workerId") == self.worker_id:
            self.files.remove(self.name)

    def __enter__(self) -> Lock:
        return self

    def __exit__(self, *exc) -> None:
        self.release()


def _body(files: Files, name: str) -> dict | None:
    text = files.read(name)
    if text is None:
        return None
    try:
        return json.loads(text)
    except ValueError:
        return {}


def read(path: str) -> dict | None:
    """Body of a lock file of this machine; empty if it does not parse, None if there is none."""
    return _body(LocalFiles(os.path.dirname(path)), os.path.basename(path))


def is_live(body: dict, now: datetime) -> bool:
    """Younger than its lifetime; a body without a readable start is stale."""
    try:
        started = datetime.fromisoformat(body["startedAt"])
        return (now - started).total_seconds() < float(body["lockTtlSeconds"])
    except (KeyError, ValueError, TypeError):
        return False


def _put(files: Files, name: str, ttl: float, runtime: float, platform: str, now: datetime) -> Lock | None:
    body = {"workerId": uuid.uuid4().hex, "platform": platform, "hostname": socket.gethostname(), "startedAt": now.isoformat(), "expectedEndBy": (now + timedelta(seconds=runtime)).isoformat(), "lockTtlSeconds": ttl}
    return Lock(files, name, body["workerId"]) if files.create(name, json.dumps(body, indent=2)) else None


def acquire_on(files: Files, ttl: float, runtime: float = 3600.0, platform: str = "local", name: str = LOCK, now: datetime | None = None) -> Lock | None:
    """The lock, or None while another run holds a live one. A stale lock is taken over; one that vanishes meanwhile is tried for once more."""
    now = now or datetime.now(UTC)
    if lock := _put(files, name, ttl, runtime, platform, now):
        return lock
    body = _body(files, name)
    if body is not None:
        if is_live(body, now):
            return None
        files.remove(name)
    return _put(files, name, ttl, runtime, platform, now)


def acquire(root: str, ttl: float, runtime: float = 3600.0, platform: str = "local", name: str = LOCK, now: datetime | None = None) -> Lock | None:
    """`acquire_on` for a folder of this machine."""
    return acquire_on(LocalFiles(root), ttl, runtime, platform, name, now)
