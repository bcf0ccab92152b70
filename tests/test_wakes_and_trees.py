"""A message list that wakes passes; output trees put in two phases."""

import os
import socketserver
import threading
import time

import pytest
from pyspark.sql import functions as F

from mediacat.functions import keys
from mediacat.sources import trees
from mediacat.streaming import trigger, wakes


class _Service(socketserver.ThreadingTCPServer):
    """What of a Redis service the source needs: lists, counters, transactions."""

    daemon_threads = allow_reuse_address = True

    def __init__(self):
        self.waiting, self.taken, self.broken, self.log, self.lock = [], 0, False, [], threading.Lock()
        super().__init__(("127.0.0.1", 0), _Talk)
        threading.Thread(target=self.serve_forever, daemon=True).start()

    @property
    def url(self):
        return f"redis://:secret@127.0.0.1:{self.server_address[1]}/2"

    def push(self, *names):
        with self.lock:
            self.waiting += names


class _Talk(socketserver.StreamRequestHandler):
    def handle(self):
        s, asked = self.server, []
        while line := self.rfile.readline():
            words = []
            for _ in range(int(line[1:])):
                n = int(self.rfile.readline()[1:])
                words.append(self.rfile.read(n + 2)[:-2].decode())
            s.log.append(words)
            if s.broken:
                self.wfile.write(b"-LOADING not now\r\n")
            elif words[0] == "EXEC":
                with s.lock:
                    said = [self.one(w) for w in asked]
                self.wfile.write(b"*%d\r\n" % len(said) + b"".join(said))
            elif words[0] in ("AUTH", "SELECT", "MULTI"):
                self.wfile.write(b"+OK\r\n")
            else:
                asked.append(words)
                self.wfile.write(b"+QUEUED\r\n")

    def one(self, words):
        s = self.server
        if words[0] == "GET":
            return b"$%d\r\n%d\r\n" % (len(str(s.taken)), s.taken) if s.taken else b"$-1\r\n"
        if words[0] == "LLEN":
            return b":%d\r\n" % len(s.waiting)
        if words[0] == "LTRIM":
            s.waiting = s.waiting[int(words[2]) :]
            return b"+OK\r\n"
        s.taken += int(words[2])
        return b":%d\r\n" % s.taken


@pytest.fixture
def service():
    s = _Service()
    yield s
    s.shutdown()
    s.server_close()


def _until(what, seconds=60):
    end = time.time() + seconds
    while not what():
        assert time.time() < end, "it did not happen in time"
        time.sleep(0.05)


def test_a_list_of_messages(service):
    box = wakes.RedisList(service.url, "transcode:requests")
    assert box.counts() == (0, 0)
    service.push("a", "b", "c")
    assert box.counts() == (0, 3)
    box.take(2)
    assert box.counts() == (2, 1) and service.waiting == ["c"]
    assert service.log[0] == ["AUTH", "secret"] and service.log[1] == ["SELECT", "2"]
    service.broken = True
    with pytest.raises(ConnectionError, match="LOADING"):
        box.counts()
    for bad in ("http://x", "redis://", "x"):
        with pytest.raises(ValueError):
            wakes.RedisList(bad, "q")


class _Box:
    def __init__(self):
        self.taken, self.waiting, self.down = 0, 0, False

    def counts(self):
        if self.down:
            raise OSError("gone")
        return self.taken, self.waiting

    def take(self, n):
        self.taken, self.waiting = self.taken + n, self.waiting - n


def test_offsets_by_messages_and_by_sweeps(monkeypatch):
    now, slept = [1000.0], []
    monkeypatch.setattr(wakes.time, "time", lambda: now[0])
    monkeypatch.setattr(wakes.time, "sleep", slept.append)
    box = _Box()
    r = wakes.Reader(box, 900)
    zero, first = r.initialOffset(), r.latestOffset()
    assert first != zero and [(p.messages, p.swept) for p in r.partitions(zero, first)] == [(0, True)]
    assert r.latestOffset() == first and r.partitions(first, first) == []
    now[0] += 899
    assert r.latestOffset() == first
    box.waiting = 3
    woken = r.latestOffset()
    assert [(p.messages, p.swept) for p in r.partitions(first, woken)] == [(3, False)] and list(r.read(r.partitions(first, woken)[0])) == [(3, False)]
    now[0] += 5000  # a long pass, in which one more comes
    box.waiting += 1
    more = r.latestOffset()
    assert more["seen"] == 4
    r.commit(woken)
    r.commit(woken)
    assert (box.taken, box.waiting) == (3, 1)
    assert r.latestOffset() == more  # the taken ones are not new, and the wait begins here
    now[0] += 900
    assert r.latestOffset()["seen"] == 4 and r.latestOffset() != more
    box.down = True
    kept = r.latestOffset()
    r.commit(kept)
    assert kept["seen"] == 4 and slept == [5.0] and box.waiting == 1
    assert wakes.Reader(box, 900).latestOffset()["seen"] == 0  # a pass at the start, whatever the service says
    box.down = False
    again = wakes.Reader(box, 900)  # after a restart
    assert again.latestOffset()["seen"] == 4
    again.commit(more)
    assert (box.taken, box.waiting) == (4, 0)


def test_messages_wake_passes_and_a_restart_loses_none(spark, service, tmp_path):
    box, mark = wakes.RedisList(service.url, "q"), str(tmp_path / "mark")
    passes, gate = [], threading.Event()
    gate.set()

    def run():
        passes.append(len(service.waiting))
        gate.wait(60)
        return {}

    query = trigger.serve(spark, run, queue=box, poll=3600, checkpoint=mark)
    try:
        _until(lambda: len(passes) == 1)  # at the start
        gate.clear()
        service.push("a", "b")
        _until(lambda: len(passes) == 2)
        service.push("c")
        service.push("d")  # both arrive in the second pass
        gate.set()
        _until(lambda: len(passes) == 3)
        time.sleep(3)
        assert len(passes) == 3 and service.waiting == ["c", "d"] and service.taken == 2
        service.push("e")
        _until(lambda: len(passes) == 4)
    finally:
        query.stop()
    service.push("f")
    query = trigger.serve(spark, run, queue=box, poll=3600, checkpoint=mark)
    try:
        _until(lambda: len(passes) >= 5)
        time.sleep(2)
        _until(lambda: service.taken >= 4)
    finally:
        query.stop()
    assert service.taken + len(service.waiting) == 6


def test_sweeps_go_on_without_messages(spark, service, tmp_path):
    passes = []
    query = trigger.serve(spark, lambda: passes.append(1) or {}, queue=wakes.RedisList(service.url, "q"), poll=1, checkpoint=str(tmp_path / "mark"))
    try:
        _until(lambda: len(passes) >= 3)
    finally:
        query.stop()


# trees
def _tree(root, names):
    for n in names:
        os.makedirs(os.path.dirname(f"{root}/{n}"), exist_ok=True)
        with open(f"{root}/{n}", "w") as f:
            f.write(n)


NAMES = ["master.m3u8", "360p/index.m3u8", *[f"360p/seg_{i:05d}.m4s" for i in range(40)]]


def test_the_playlist_comes_last(tmp_path):
    _tree(tmp_path, NAMES)
    sent, at_once, most, lock = [], [0], [0], threading.Lock()

    def put(path, key, kind):
        with lock:
            at_once[0] += 1
            most[0] = max(most[0], at_once[0])
        time.sleep(0.005)
        with lock:
            at_once[0] -= 1
            sent.append((key, kind))

    assert trees.put_tree(str(tmp_path), "by-id/c/", put, concurrency=4) == sorted(NAMES)
    assert sent[-1] == ("by-id/c/master.m3u8", "application/vnd.apple.mpegurl") and sorted(k for k, _ in sent) == sorted("by-id/c/" + n for n in NAMES)
    assert 1 < most[0] <= 4


def test_the_first_error_cancels_the_rest(tmp_path):
    _tree(tmp_path, NAMES)
    there, asked, lock = set(), [], threading.Lock()

    def put(path, key, kind):
        with lock:
            asked.append(key)
        time.sleep(0.01)
        if key.endswith("seg_00003.m4s"):
            raise OSError("no room")
        with lock:
            there.add(key)

    with pytest.raises(OSError, match="no room"):
        trees.put_tree(str(tmp_path), "t/", put, there.discard, concurrency=4)
    assert not there and len(asked) < len(NAMES) / 2 and "t/master.m3u8" not in asked
    os.remove(tmp_path / "master.m3u8")
    asked.clear()
    with pytest.raises(FileNotFoundError):
        trees.put_tree(str(tmp_path), "t/", put)
    assert asked == []


def test_trees_of_contents(spark, tmp_path):
    out, work = tmp_path / "out", tmp_path / "work"
    names = NAMES[:6]

    def make(source, cid, folder):
        if source == "b.mp4":
            raise RuntimeError("exit 1: no stream")
        for n in names:
            os.makedirs(os.path.dirname(f"{folder}/{n}"), exist_ok=True)
            with open(f"{folder}/{n}", "w") as f:
                f.write(source)

    def put(path, key, kind):
        if key == "by-id/c3/360p/seg_00002.m4s":
            raise OSError("no room")
        os.makedirs(os.path.dirname(f"{out}/{key}"), exist_ok=True)
        with open(path) as a, open(f"{out}/{key}", "w") as b:
            b.write(a.read())

    contents = spark.createDataFrame([(f"{n}.mp4", f"c{i}") for i, n in enumerate("abxd")], "source_key string, content_id string")
    rows = trees.encoded(contents, make, put, str(work), lambda key: os.remove(f"{out}/{key}"), tasks=3).collect()
    assert sorted((r["content_id"], r["rel_path"]) for r in rows if r["rel_path"]) == [(c, n) for c in ("c0", "c2") for n in sorted(names)]
    assert sorted((r["content_id"], r["error"]) for r in rows if r["error"]) == [("c1", "exit 1: no stream"), ("c3", "no room")]
    found = [os.path.relpath(os.path.join(at, f), out) for at, _, fs in os.walk(out) for f in fs]
    assert sorted(found) == sorted(f"by-id/{c}/{n}" for c in ("c0", "c2") for n in names)
    assert os.listdir(work) == []
    assert trees.encoded(contents.limit(0), make, put, str(work), tasks=1).count() == 0


def test_content_types_of_single_names(spark):
    names = [*NAMES[:3], "a.mp4", "b.ts", "c.vtt", "d.json", "e", "f.M3U8"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", keys.content_type(F.col("n")).alias("t")).collect()
    assert {r["n"]: r["t"] for r in rows} == {n: trees.kind_of(n) for n in names}
