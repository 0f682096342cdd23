"""Media columns, WARC archives and sharding: exact round trips and laws."""

import base64
import gzip
import hashlib
import heapq
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.llm import media
from quern.llm.media import crc16, media_round_trip, parse_header, parse_stream, read_payload, write_stream
from quern.llm.sharding import longest_first, lpt_shards
from quern.llm.warc import parse_record, read_records, warc_round_trip, write_archives


def test_media_round_trip(docs, empty, texts):
    got = {}
    rows = media_round_trip(docs).collect()
    for r in rows:
        got[r.doc_id] = r
    assert len(rows) == len(texts)
    for i, t in texts:
        raw = (t or "").encode()
        payload = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-16:])
        stored = write_stream(payload)
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r.samples == 1152 * len(r.seek_offsets) and r.sample_rate == 48000
    assert media_round_trip(empty).count() == 0


def test_stream_holds_what_was_written():
    for n in (0, 1, 192, 937, 938, 5000, 100_000):
        payload = bytes(i * 7 % 251 for i in range(n))
        track = parse_stream(write_stream(payload))
        assert read_payload(write_stream(payload), track) == payload
        assert track.bad == 0 and track.resyncs == 0 and track.table == "Xing" and track.table_frames == len(track.seek)


def test_parser_resynchronises_and_counts_bad_checksums():
    clean = write_stream(bytes(3000))
    track = parse_stream(clean)
    cut = track.seek[1]
    broken = clean[:cut] + b"\xff\xfajunk in between\xff\xe0" + clean[cut:]
    again = parse_stream(broken)
    assert again.resyncs == 1 and again.skipped == len(broken) - len(clean) and len(again.seek) == len(track.seek)
    flipped = bytearray(clean)
    flipped[track.seek[2] + 8] ^= 1  # in the side data that the checksum covers
    assert parse_stream(bytes(flipped)).bad == 1
    tagged = clean + b"TAG" + b"title".ljust(30, b"\0") + bytes(95)
    assert parse_stream(tagged).tags["id3v1_title"] == "title" and parse_stream(tagged).samples == track.samples
    assert parse_stream(b"").seek == [] and parse_stream(b"no audio" * 50).seek == []


def test_headers():
    assert parse_header(b"\xff\xfb\x90\x00").size == 417 and parse_header(b"\xff\xfb\x90\x00").samples == 1152  # 128 kbit/s, 44.1 kHz
    assert parse_header(b"\xff\xf3\x40\xc0").samples == 576 and parse_header(b"\xff\xf3\x40\xc0").version == 2
    assert parse_header(b"\xff\xfb\xf0\x00") is None and parse_header(b"\xff\xfb\x00\x00") is None and parse_header(b"abcd") is None
    assert crc16(b"123456789") == 0xAEE7


def test_vbri_table():
    frame = media._FRAME[960]
    first = bytearray(frame + bytes(960 - len(frame)))
    first[36:40] = b"VBRI"
    first[46:54] = (4000).to_bytes(4, "big") + (2).to_bytes(4, "big")
    track = parse_stream(bytes(first) + 2 * (frame + bytes(960 - len(frame))))
    assert (track.table, track.table_frames, track.table_bytes, len(track.seek)) == ("VBRI", 2, 4000, 2)


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(5, "http://a/\r\nx", "<p>é</p>"), (3, "http://b", "<p>é</p>"), (9, None, "<p>é</p>"), (1, "u", None), (2, "u", ""), (4, "u", "x" * 300_000),
            (None, "n", "<p>é</p>"), (None, "n", "alone"), (7, "d", "twice"), (7, "d", "twice"), (8, "d", "twice")]
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, path string").repartition(3)


def test_warc(pages):
    raw = [(r.page_id, (r.html or "").encode()) for r in pages.collect()]
    least = {}
    for i, b in raw:
        if i is not None:
            least[b] = min(i, least.get(b, i))
    number = Counter(b for _, b in raw)
    wanted = []
    for i, b in raw:
        first = least.get(b) if number[b] > 1 else None
        revisit = first is not None and i != first
        wanted.append((i, len(b), b32(b), "revisit" if revisit else "response", first if revisit else None))
    got = [tuple(r) for r in warc_round_trip(pages).collect()]
    assert sorted(map(str, got)) == sorted(map(str, wanted))
    assert warc_round_trip(pages.limit(0)).count() == 0


def test_warc_index_reads_single_records(pages, tmp_path):
    index = write_archives(pages, str(tmp_path))
    rows = index.collect()
    for r in rows:
        with open(r.path, "rb") as file:
            file.seek(r.offset)
            fields, http, payload = parse_record(gzip.decompress(file.read(r.length)))
        assert fields["WARC-Payload-Digest"] == f"sha1:{r.digest}" and fields["WARC-Type"] == r.record_type
        assert (int(http["Content-Length"]) == len(payload)) == (r.record_type == "response" or not int(http["Content-Length"]))
    one = read_records(index.filter("page_id = 4")).collect()
    assert [(x.page_id, x.payload_bytes) for x in one] == [(4, 300_000)]


def test_warc_small_payloads_may_all_be_responses(pages, tmp_path):
    index = write_archives(pages, str(tmp_path), min_bytes=8)
    assert {r.record_type for r in index.filter("page_id in (1, 2, 7, 8)").collect()} == {"response"}
    assert index.filter("record_type = 'revisit'").count() == 3


def test_longest_first_is_the_heap_schedule():
    sizes = [(s, k) for k, s in enumerate([9, 7, 6, 5, 5, 4, 1])]
    heap, wanted = [(0, s) for s in range(3)], {}
    for size, key in sorted(sizes, key=lambda x: (-x[0], str(x[1]))):
        load, shard = heapq.heappop(heap)
        wanted[key] = shard
        heapq.heappush(heap, (load + size, shard))
    assert longest_first(sizes, 3) == wanted


def test_sharding(spark, docs, empty, texts):
    rows = lpt_shards(docs, shards=4, slot_parts=3).collect()
    assert len(rows) == len(texts)
    by_text, slots = defaultdict(set), defaultdict(list)
    for r in rows:
        by_text[r.text_crc32, r.size].add(r.shard)
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sorted((r.doc_id or 10**9, r.size, r.text_crc32) for r in rows) == sorted((i or 10**9, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in texts)
    assert lpt_shards(empty).count() == 0


def test_shards_are_balanced_with_many_small_groups(spark):
    frame = spark.range(20_000).select(F.col("id").alias("doc_id"), F.expr("CASE WHEN id % 3 = 0 THEN 'hot' ELSE repeat(concat('t', id), 1 + CAST(id % 17 AS INT)) END").alias("text"))
    loads = {r.shard: r.b for r in lpt_shards(frame).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    assert len(loads) == 16 and max(loads.values()) / min(loads.values()) < 1.01


def test_media_query_returns_seek_offsets(spark):
    from quern.llm.queries import op2_media_columns

    rows = op2_media_columns(spark, "/root/testdata/sf0.001").select("samples", "seek_offsets").collect()
    assert rows and all(r.samples == 1152 * len(r.seek_offsets) for r in rows)


def test_vbri_mark_in_a_frame_without_room_for_the_table():
    frame = bytes((0xFF, 0xF3, 0x14, 0xC0)) + bytes(20)  # MPEG-2 layer III, 8 kbit/s at 24 kHz: 24 bytes
    data = bytearray(frame * 2)
    data[36:40] = b"VBRI"
    track = parse_stream(bytes(data))
    assert track.table == "" and track.seek == [0, 24]
    assert parse_stream(bytes(data[:40])).seek == [0]


def test_small_groups_are_dealt_as_the_heap_deals_them():
    from quern.llm.sharding import deal_class

    for n, size in ((1, 5.0), (7, 3.0), (1000, 2.5), (12, 100.0)):
        loads = [9.0, 0.0, 4.0, 30.0]
        heap = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(heap)
        counts = deal_class(heap, n, size)
        plain = [(load, shard) for shard, load in enumerate(loads)]
        heapq.heapify(plain)
        wanted = [0] * 4
        for _ in range(n):
            load, shard = plain[0]
            wanted[shard] += 1
            heapq.heapreplace(plain, (load + size, shard))
        assert sum(counts) == n and all(abs(a - b) <= 1 for a, b in zip(counts, wanted))
        assert sorted(heap) == sorted((loads[s] + counts[s] * size, s) for s in range(4)) or all(abs(x - y) < 1e-6 for (x, _), (y, _) in zip(sorted(heap, key=lambda h: h[1]), ((loads[s] + counts[s] * size, s) for s in range(4))))


def test_shard_loads_are_near_those_of_a_plain_heap(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sizes = defaultdict(int)
    for r in docs.select("text").collect():
        sizes[r.text or ""] += len((r.text or "").encode()) + 1
    place = longest_first([(n, t) for t, n in sizes.items()], 16)
    plain = defaultdict(int)
    for t, n in sizes.items():
        plain[place[t]] += n
    loads = {r.shard: r.b for r in lpt_shards(docs).groupBy("shard").agg(F.sum("size").alias("b")).collect()}
    mean = sum(plain.values()) / 16
    assert max(loads.values()) / mean < max(plain.values()) / mean + 0.002
