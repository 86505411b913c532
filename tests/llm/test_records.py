"""Sharding and WARC."""

import base64
import hashlib
import random
import zlib

import pytest

from langatlas.llm import sharding, warc
from langatlas.session import scratch_path
from tests.llm.helpers import documents, edge_rows, frame

PAGES = "page_id bigint, url string, html string, digest string, id int, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "d", 1, "p") for i, u, h in rows], PAGES).repartition(3)


def test_lpt_takes_the_least_loaded():
    assert sharding.lpt([7, 5, 4, 3, 1], [0, 0, 0]) == [0, 1, 2, 2, 1]
    assert sharding.lpt([1, 1], [0, 0, 5], turn=1) == [1, 0]


@pytest.mark.parametrize("rows", [edge_rows(), documents()], ids=["edge", "given"])
def test_shards_hold_whole_groups_and_gapless_slots(spark, rows):
    got = sharding.shard_documents(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))
                  for i, t in rows)
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in got) == want
    slots, shard_of = {}, {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert shard_of.setdefault((r["text_crc32"], r["size"]), r["shard"]) == r["shard"]
        assert r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_levels_and_buckets_end_level(spark):
    r = random.Random(4)
    rows = [(i, "x" * r.randint(1, 40) + str(i)) for i in range(3000)] + [
        (5000 + i, "y" * 2000) for i in range(6)]
    groups = spark.createDataFrame([(t, (len(t) + 16) * n) for t, n in {
        t: sum(u == t for _, u in rows) for _, t in rows}.items()], "gid string, bytes bigint")
    placed = sharding.schedule_groups(groups, 4, groups_per_shard=20)
    loads = dict(placed.join(groups, "gid").groupBy("shard").sum("bytes").collect())
    assert len(loads) == 4 and max(loads.values()) - min(loads.values()) < 200


def test_no_documents_no_shards(spark):
    assert sharding.shard_documents(frame(spark, [])).collect() == []


def expected(rows, least=0):
    first = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= least:
            first[h or ""] = max(first.get(h or "", i), i)
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        to = first.get(h or "")
        revisit = to is not None and to != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def page_rows():
    r = random.Random(3)
    parts = ["\r", "\n", "\r\n", "a", "é", "漢", "🙂", "WARC/1.1\r\n", "\r\n\r\n", "\x00"]
    return [(i, f"http://x/{i}?q=ä b\r\n", "".join(r.choice(parts) for _ in range(
        r.choice([0, 1, 2, 3, 5, 200])))) for i in range(300)] + [
        (900, None, None), (901, "", ""), (None, "http://y", "lost"), (None, "u", None),
        (902, "u", "twice"), (902, "u", "twice"), (903, "u", "x" * 100_000)]


@pytest.mark.parametrize("chunk", [8, 1000, warc.CHUNK_BYTES])
def test_archives_read_back(spark, chunk):
    path = scratch_path(spark, "warc")
    warc.write_warc(pages(spark, page_rows()), path, chunk_bytes=chunk)
    got = warc.read_warc(spark, path)
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(page_rows())
    chunks = warc.read_warc_chunks(spark, path).where("record_id = '903'").orderBy("chunk").collect()
    assert b"".join(bytes(c["payload"]) for c in chunks) == b"x" * 100_000
    assert [c["chunk"] for c in chunks] == list(range(-(-100_000 // chunk)))
    assert [c["payload_digest"] is None for c in chunks] == [True] * (len(chunks) - 1) + [False]


def test_short_payloads_are_responses(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(pages(spark, page_rows()), path, min_revisit_bytes=4)
    got = sorted((tuple(r) for r in warc.read_warc(spark, path).collect()), key=str)
    assert got == expected(page_rows(), least=4)


def test_no_pages_no_records(spark):
    path = scratch_path(spark, "warc")
    warc.write_warc(pages(spark, []), path)
    assert warc.read_warc(spark, path).collect() == []


def test_a_changed_payload_is_noticed():
    record = next(warc.record_chunks("1", "u", b"abc", "A" * 32, None, "2020-01-01T00:00:00Z", 100))
    with pytest.raises(ValueError, match="differs"):
        list(warc.ChunkParser().feed(record.encode() + warc.BREAK))
