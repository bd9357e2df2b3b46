import json
import math
import random
import struct

import pytest

from tests.test_store_and_ingest import NODES, PODS, SHAPES, SUMMARY
from tideql.plans import discovery
from tideql.plans.compiler import instant
from tideql.sources import binary_snapshot as snap
from tideql.sources import poll
from tideql.streaming.collector import Collector, merged


class Fake:
    def __init__(self):
        self.docs = {poll.NODES_PATH: NODES, poll.PODS_PATH: PODS, poll.SUMMARY_PATH.format(node="n1"): SUMMARY}
        self.calls = []

    def get(self, path):
        self.calls.append(path)
        if path not in self.docs:
            raise OSError(f"GET {path} returned 500")
        return json.dumps(self.docs[path])


def test_settings():
    assert poll.Config.from_env({}) == poll.Config()
    got = poll.Config.from_env({"SCRAPE_INTERVAL_SECONDS": "0", "RETENTION_HOURS": "x", "SNAPSHOT_PATH": " ", "POD_REFRESH_INTERVAL_SECONDS": "7"})
    assert got == poll.Config(scrape_seconds=1, pod_refresh_seconds=7)
    with pytest.raises(RuntimeError):
        poll.Client.in_cluster({})
    assert poll.Client("https://x", "/none").base == "https://x"


def test_the_pod_list_is_held():
    fake, pods = Fake(), poll.Pods(300)
    for now, fetches in ((0, 1), (299, 1), (300, 2), (310, 2)):
        pods.current(fake, now)
        assert len(fake.calls) == fetches
    pods.stale = True
    pods.current(fake, 311)
    assert len(fake.calls) == 3 and not pods.stale
    del fake.docs[poll.PODS_PATH]
    pods.stale = True
    assert json.loads(pods.current(fake, 312)) == PODS and pods.failures
    with pytest.raises(OSError):
        poll.Pods(300).current(fake, 0)


def test_passes_prunes_and_failures(spark, tmp_path):
    fake = Fake()
    c = Collector(spark, fake, poll.Config(retention_seconds=100), str(tmp_path / "s"), now=1000)
    c.tick(1000)
    c.tick(1000)  # the same second again adds nothing
    n, total = discovery.stats(c.store).first()
    assert n == total == 22 and c.pods.stale  # a container without an image is in the summary
    del fake.docs[poll.NODES_PATH]
    c.tick(1060)
    assert tuple(discovery.stats(c.store).first()) == (22, 22)
    c.tick(1101)  # all are too old, though the pass failed again
    assert tuple(discovery.stats(c.store).first()) == (0, 0)
    fake.docs[poll.NODES_PATH] = NODES
    clock = iter([1130.0, 1131.0])
    assert c.run(1, clock=lambda: next(clock), sleep=lambda s: None) is c.store
    assert [r["v"] for r in instant(c.store, 'up{instance="n2"}', 1130).collect()] == [0.0]
    again = Collector(spark, fake, poll.Config(retention_seconds=100), str(tmp_path / "s"), now=1140)
    assert discovery.stats(again.store).first()["samples"] == 22
    both = merged([c.store.rows, c.store.rows])
    assert both.rows.count() == 22


def test_bad_answers_and_the_cadence_of_snapshots(spark, tmp_path):
    class Raw(Fake):
        raw = {}

        def get(self, path):
            return self.raw.get(path) or super().get(path)

    fake, path = Raw(), tmp_path / "s"
    c = Collector(spark, fake, poll.Config(retention_seconds=1000, snapshot_seconds=100), str(path), now=1000)
    snapshots = lambda: sorted(p.name for p in path.iterdir() if p.name.startswith("snapshot-")) if path.exists() else []
    fake.raw = {poll.NODES_PATH: "<html>"}
    c.tick(1000)
    assert discovery.stats(c.store).first()["samples"] == 0 and snapshots() == []
    fake.raw = {poll.PODS_PATH: "<html>"}
    c.tick(1010)  # no pod list is held yet
    assert discovery.stats(c.store).first()["samples"] == 0
    fake.raw = {poll.SUMMARY_PATH.format(node="n1"): "<html>"}
    c.tick(1020)
    assert {r["v"] for r in instant(c.store, "up", 1020).collect()} == {0.0} and snapshots() == []
    fake.raw = {poll.PODS_PATH: '{"items": [{}]}'}
    c.pods.stale = True
    c.tick(1030)  # the list held goes on
    n = discovery.stats(c.store).first()["samples"]
    assert c.pods.failures and n > 20 and snapshots() == []
    c.tick(1100)
    assert len(snapshots()) == 1 and discovery.stats(c.store).first()["samples"] > n
    c.tick(1150)
    assert len(snapshots()) == 1
    c.tick(1200)
    c.tick(1300)
    assert len(snapshots()) == 2  # the current one and the one before
    total = discovery.stats(c.store).first()["samples"]
    c.stop()
    assert c.run(5, clock=lambda: 1310.0, sleep=lambda s: None) is c.store
    again = Collector(spark, fake, poll.Config(retention_seconds=1000), str(path), now=1310)
    assert discovery.stats(again.store).first()["samples"] == total
    assert [p.name for p in path.iterdir() if p.name.startswith("tail-")] == []


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def zig(n):
    return varint((n << 1) ^ (n >> 63) if n >= 0 else ((-n) << 1) - 1)


def stream(values, runs):
    if not runs:
        return b"\x00" + b"".join(map(zig, values))
    groups = []
    for v in values:
        if groups and groups[-1][0] == v:
            groups[-1][1] += 1
        else:
            groups.append([v, 1])
    return b"\x01" + varint(len(groups)) + b"".join(zig(v) + varint(k) for v, k in groups)


def chunk(samples, scale, runs):
    steps = [b - a for (a, _), (b, _) in zip(samples, samples[1:])]
    body = stream(steps, runs)
    if scale is None:
        body += b"\x01" + b"".join(struct.pack("<d", v) for _, v in samples)
    else:
        whole = [round(v * 10**scale) for _, v in samples]
        deltas = [b - a for a, b in zip(whole, whole[1:])]
        body += b"\x00" + bytes([scale]) + zig(whole[0]) + stream([b - a for a, b in zip([0, *deltas], deltas)], runs)
    return struct.pack("<qqII", samples[0][0], samples[-1][0], len(samples), len(body)) + body


def file_of(series, version=2):
    out = b"LMD1" + struct.pack("<HI", version, len(series))
    text = lambda s: struct.pack("<H", len(s.encode())) + s.encode()
    for labels, chunks, head in series:
        out += struct.pack("<H", len(labels)) + b"".join(text(k) + text(v) for k, v in labels.items())
        if version == 2:
            out += struct.pack("<I", len(chunks)) + b"".join(chunks)
        out += struct.pack("<I", len(head)) + b"".join(struct.pack("<qd", t, v) for t, v in head)
    return out


def timed(values, first=1_700_000_000):
    return [(first + 30 * i, v) for i, v in enumerate(values)]


def test_binary_snapshots(spark, tmp_path):
    bits = lambda s: [(t, struct.pack("<d", v)) for t, v in s]
    for values in SHAPES:
        for runs in (False, True):
            data = chunk(timed(values), None, runs)
            assert bits(snap.chunk_samples(*struct.unpack("<qqII", data[:24])[:3], data[24:])) == bits(timed(values))
    data = chunk(timed([i / 1000 - 3 for i in range(99)]), 3, True)
    assert bits(snap.chunk_samples(*struct.unpack("<qqII", data[:24])[:3], data[24:])) == bits(timed([round(i - 3000) / 1000.0 for i in range(99)]))
    whole = file_of([({"__name__": "m", "k": "é"}, [chunk(timed(SHAPES[1]), 0, True)], timed([1.5, 2.5], 1_700_010_000)), ({"__name__": "n"}, [], [(5, 1.0), (5, 2.0), (4, 3.0), (6, math.inf)])])
    (tmp_path / "a.bin").write_bytes(whole)
    (tmp_path / "b.bin").write_bytes(file_of([({"__name__": "old"}, [], timed([7.0, 8.0]))], 1))
    rows = snap.read(spark, str(tmp_path)).collect()
    assert len(rows) == 30 + 2 + 2 + 2 and {r["metric"] for r in rows} == {"m", "n", "old"}
    assert sorted((r["t"], r["v"]) for r in rows if r["metric"] == "n") == [(5, 1.0), (6, math.inf)]
    assert {tuple(r["labels"].items()) for r in rows if r["metric"] == "m"} == {(("k", "é"),)}
    assert snap.read(spark, str(tmp_path), cutoff=1_700_010_000).count() == 2


def test_damaged_snapshots_are_told_or_read_as_series():
    whole = file_of([({"__name__": "m"}, [chunk(timed(SHAPES[1][:9]), 0, True)], timed([1.5], 1_700_010_000))])
    for bad in (b"", b"LMD1", b"XXXX" + whole[4:], whole[:-3], whole[:30], b"LMD1" + b"\x09\x00" + whole[6:]):
        with pytest.raises(snap.Corrupt):
            list(snap.samples(bad))
    rng = random.Random(0)
    for i in range(len(whole)):
        changed = bytearray(whole)
        changed[i] ^= rng.choice((0x01, 0x80))
        try:
            for _, got in snap.samples(bytes(changed)):
                assert all(a[0] < b[0] for a, b in zip(got, got[1:]))
        except snap.Corrupt:
            pass
