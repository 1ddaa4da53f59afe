from __future__ import annotations

import gzip
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from clonarium.llm.warc import GZIP, VERSION, _pieces, candidates, exits, member, reachable, read_warc, record, round_trip

SCHEMA = "page_id long, url string, html string, digest string"


def pages():
    trap = "x\r\n\r\n" + record(999, "http://trap", b"inner", "0" * 40, None).decode() + "\r\n\r\n"
    big = "é" * 700
    return [
        (1, "http://a", "small", "d"), (2, "http://a", "small", "d"), (3, None, None, None), (4, "http://b", "", None), (5, "u\r\nv", trap, "d"), (6, "http://c", trap + "y" * 3000 + trap, "d"),
        *[(100 + i, "http://copy", big, "d") for i in range(40)], (7, "http://e", "a" * 999, "d"), (8, "http://e", "a" * 999, "d"), (9, "http://f", "b" * 1000, "d"), (10, "http://f", "b" * 1000, "d"),
        (11, "http://g", "long " * 400_000, "d"), (None, "http://h", "no id", "d"), (None, None, None, None), (None, "http://h", "b" * 1000, "d"), (None, "http://i", "z" * 2000, "d"), (None, "http://j", "z" * 2000, "d"),
        # one id with several payloads: one that stands elsewhere, one of its own, one that is small
        (12, "http://k", "b" * 1000, "d"), (12, "http://k", "q" * 3000, "d"), (12, "http://k", "small", "d"), (5, "http://l", "q" * 3000, "d"), (13, "http://m", "WARC/1.1\r\n" * 200, "d"), (14, "http://n/WARC/1.1", "", "d"),
    ]


@pytest.mark.parametrize("compress", [True, False])
def test_round_trip(spark, compress):
    groups = defaultdict(list)
    for p, _, html, _ in pages():
        groups[(html or "").encode()].append(p)
    want = Counter()
    for payload, ids in groups.items():
        last = max((p for p in ids if p is not None), default=None)
        for p in ids:
            again = len(payload) >= 1000 and last is not None and p != last
            want[(p, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if again else "response", last if again else None)] += 1
    got = round_trip(spark.createDataFrame(pages(), SCHEMA), compress).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == want
    # Every payload is in some response.
    assert {r.payload for r in got if r.record_type == "response"} == {(h or "").encode() for _, _, h, _ in pages()}
    assert all(r.payload == b"" for r in got if r.record_type == "revisit")


@pytest.mark.parametrize("compress", [True, False])
@pytest.mark.parametrize("split", [3001, 20_000])
def test_files_of_several_splits(spark, tmp_path, compress, split):
    """Records, and traps of all kinds, over many splits: also records longer than a split and marks at its borders."""
    rng = random.Random(split)
    trap = record(999, "http://trap", b"inner" * 20, "0" * 40, None)
    gz = gzip.compress(b"no record") + member(trap)
    rows = []
    for i in range(60):
        body = [b"%d " % i + bytes(rng.choices(b"abc \r\n", k=rng.randrange(400))), trap * rng.randrange(4), gz * rng.randrange(2), b"WARC/1.1\r\n" * rng.randrange(3), b"WARC/1.1\r\nContent-Length: 99999\r\n\r\n" * rng.randrange(2), b"\x1f\x8b\x08"]
        rng.shuffle(body)
        data = b"".join(body) + (bytes(rng.choices(range(256), k=9000)) if i % 40 == 7 else b"")
        rows.append((i, f"http://x/{i}/WARC/1.1" if i % 9 == 0 else "http://x", data))
    archive = b"".join((member if compress else lambda x: x)(record(i, u, d, hashlib.sha1(d).hexdigest(), None)) for i, u, d in rows)
    (tmp_path / "part-0").write_bytes(archive)
    (tmp_path / "part-1").write_bytes(b"no archive " + archive)
    (tmp_path / "part-2").write_bytes(archive[: len(archive) // 2])
    key = "spark.sql.files.maxPartitionBytes"
    spark.conf.set(key, split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        parts = _pieces(spark, f"file://{tmp_path}", GZIP if compress else VERSION).rdd.getNumPartitions()
        got = read_warc(spark, f"file://{tmp_path}", compress).collect()
    finally:
        spark.conf.unset(key)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert parts > 2 * len(archive) // split
    whole = Counter((r.page_id, r.url, bytes(r.payload)) for r in got)
    half = sum(1 for end in np.cumsum([len((member if compress else lambda x: x)(record(i, u, d, hashlib.sha1(d).hexdigest(), None))) for i, u, d in rows]) if end <= len(archive) // 2)
    assert whole == Counter((i, u, d) for i, u, d in rows) + Counter((i, u, d) for i, u, d in rows[:half])


def test_heads_inside_payloads_are_not_reached():
    inner = record(2, "u", b"inner", "0" * 40, None)
    data = record(1, "u", b"before " + inner + b" after", "0" * 40, None) + record(3, "u", b"", "0" * 40, None)
    starts, nexts, found = candidates(data, False)
    assert len(found) == 3
    assert [f[0]["warc-page-id"] for f, ok in zip(found, reachable(starts, nexts), strict=True) if ok] == ["1", "3"]


def test_members_are_standard_gzip_and_end_in_a_zero_byte():
    for payload in (b"", b"abc", b"a" * (1 << 24)):
        m = member(payload)
        assert m[-1] == 0 and gzip.decompress(m) == payload
    stored = member(member(b"inside")) + member(b"next")
    starts, nexts, found = candidates(stored, True)
    assert [f for f, ok in zip(found, reachable(starts, nexts), strict=True) if ok] == [member(b"inside"), b"next"]


def test_exits():
    starts, nexts = np.array([0, 5, 9, 12, 20]), np.array([9, 7, 20, 99, 40])
    assert exits(starts, nexts).tolist() == [40, 7, 40, 99, 40]
    assert exits(starts[:0], nexts[:0]).tolist() == []


def test_pointer_jumping():
    starts = np.arange(0, 1000, 10)
    nexts = starts + 20
    assert np.flatnonzero(reachable(starts, nexts)).tolist() == list(range(0, 100, 2))
    assert not reachable(np.array([5]), np.array([9])).any()
    assert VERSION == b"WARC/1.1\r\n"


def test_empty_table(spark):
    assert round_trip(spark.createDataFrame([], SCHEMA)).collect() == []
