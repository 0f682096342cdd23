"""Media columns of MPEG audio: a writer that carries bytes losslessly in frames, and a parser of any such stream."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import arrow_map, batch_of, materialize, texts_of

#: Fixed values of the MPEG audio header: kbit/s by index for (MPEG-1, layer) and (MPEG-2 or 2.5, layer), and rates.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        value = byte << 8
        for _ in range(8):
            value = (value << 1 ^ (0x8005 if value & 0x8000 else 0)) & 0xFFFF
        table.append(value)
    return table


_CRC, _known_crc = _crc_table(), {}


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, start 0xFFFF. Headers repeat, so results are kept."""
    value = _known_crc.get(data)
    if value is None:
        value = 0xFFFF
        for byte in data:
            value = (value << 8 & 0xFF00) ^ _CRC[value >> 8 ^ byte]
        if len(_known_crc) < 100_000:
            _known_crc[data] = value
    return value


@dataclass
class Header:
    """One frame header's fields."""

    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    bitrate: int
    rate: int
    mono: bool
    size: int
    samples: int
    side: int


def parse_header(raw: bytes) -> Header | None:
    """The header in four bytes, or None if they are none. Free-format frames have no size of their own: none."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3)
    index, rate_index = raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or raw[3] & 3 == 2:
        return None
    bitrate = BITRATES[1 if version == 3 else 2, layer][index] * 1000
    rate, padding, mono = RATES[version][rate_index], raw[2] >> 1 & 1, raw[3] >> 6 == 3
    if layer == 1:
        samples, size = 384, (12 * bitrate // rate + padding) * 4
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * bitrate // rate + padding
    side = 0 if layer != 3 else (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return Header(version, layer, not raw[1] & 1, bitrate, rate, mono, size, samples, side)


@dataclass
class Track:
    """What a stream holds."""

    tags: dict[str, str] = field(default_factory=dict)
    seek: list[int] = field(default_factory=list)  # offset of each audio frame
    bodies: list[tuple[int, int]] = field(default_factory=list)  # begin and end of what follows each frame's side data
    samples: int = 0
    rate: int = 0
    layer: int = 0
    table: str = ""  # Xing, Info or VBRI
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes = b""
    checked: int = 0
    bad: int = 0
    resyncs: int = 0
    skipped: int = 0


def _syncsafe(raw: bytes) -> int:
    return raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Text frames of a tag at the beginning; where the tag ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    end, at, synced = min(10 + _syncsafe(data[6:10]), len(data)), 10, data[3] >= 4
    while at + 10 <= end and data[at] != 0:
        name = data[at : at + 4].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if synced else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + 10 : min(at + 10 + size, end)]
        if name[0] == "T" and body:
            coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8")
            text = body[1:].decode(coding, "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            tags[key] = value
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0)


def _vbr_table(data: bytes, at: int, head: Header, track: Track) -> bool:
    """Reads a variable-bitrate table if the frame holds one."""
    spot = at + 4 + 2 * head.protected + head.side
    name = data[spot : spot + 4]
    if name in (b"Xing", b"Info"):
        flags, spot = int.from_bytes(data[spot + 4 : spot + 8], "big"), spot + 8
        for bit, attribute in ((1, "table_frames"), (2, "table_bytes")):
            if flags & bit:
                setattr(track, attribute, int.from_bytes(data[spot : spot + 4], "big"))
                spot += 4
        track.toc = data[spot : spot + 100] if flags & 4 else b""
        track.table = name.decode()
        return True
    if data[at + 36 : at + 40] == b"VBRI" and head.size >= 54:  # a shorter frame has no room for the table
        track.table_bytes, track.table_frames = struct.unpack(">II", data[at + 46 : at + 54])
        track.table = "VBRI"
        return True
    return False


def parse_stream(data: bytes) -> Track:
    """Tags, table, checksums, exact length and the offset of every frame.

    A frame counts if another of the same version, layer and rate, a tag or the end follows it; otherwise the parser
    goes on from the next sync byte and counts a resynchronisation.
    """
    track = Track()
    at = begin = _id3v2(data, track.tags)
    end = len(data)
    if end - 128 >= begin and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for name, low, high in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            track.tags.setdefault(f"id3v1_{name}", data[end + low : end + high].rstrip(b"\0 ").decode("latin-1"))
    like = None
    in_step = True
    while at + 4 <= end:
        head = parse_header(data[at : at + 4])
        good = head is not None and at + head.size <= end and (like is None or (head.version, head.layer, head.rate) == like)
        if good and not in_step and at + head.size < end:
            after = parse_header(data[at + head.size : at + head.size + 4])
            good = after is not None and (after.version, after.layer, after.rate) == (head.version, head.layer, head.rate)
        if not good:
            track.resyncs += in_step
            in_step = False
            spot = data.find(b"\xff", at + 1, end)
            track.skipped += (spot if spot >= 0 else end) - at
            at = spot if spot >= 0 else end
            continue
        in_step = True
        body = at + 4 + 2 * head.protected + head.side
        if head.protected and head.layer == 3:
            track.checked += 1
            covered = data[at + 2 : at + 4] + data[at + 6 : body]
            track.bad += crc16(covered) != int.from_bytes(data[at + 4 : at + 6], "big")
        first = like is None
        like = head.version, head.layer, head.rate
        track.rate, track.layer = head.rate, head.layer
        if not (first and _vbr_table(data, at, head, track)):
            track.seek.append(at)
            track.bodies.append((body, at + head.size))
            track.samples += head.samples
        at += head.size
    if in_step and at < end:
        track.skipped += end - at
    return track


#: The writer's frames: MPEG-1 layer III, 48 kHz, mono, with checksums. A frame's size in bytes is 3 x kbit/s.
_HEAD = {3 * k: bytes((0xFF, 0xFA, i << 4 | 0x04, 0xC0)) for i, k in enumerate(BITRATES[1, 3]) if i}
_OVERHEAD = 4 + 2 + 17
_FRAME = {
    size: head + crc16(head[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) for size, head in _HEAD.items()
}
_SIZES = sorted(_HEAD)


def _text_frame(key: str, value: str) -> bytes:
    body = b"\x03" + key.encode() + b"\0" + value.encode()
    return b"TXXX" + bytes((0, 0, len(body) >> 7, len(body) & 127, 0, 0)) + body


def write_stream(payload: bytes) -> bytes:
    """payload as the ancillary data of silent frames, behind a tag with its length and a Xing table.

    Frames are of the largest bitrate but the last, which takes the least that suffices.
    """
    full = _SIZES[-1]
    room, frames, seek, at = full - _OVERHEAD, [], [], 0
    for k in range(0, len(payload), room):
        part = payload[k : k + room]
        size = full if len(part) == room else next(s for s in _SIZES if s - _OVERHEAD >= len(part))
        frames.append(_FRAME[size] + part + bytes(size - _OVERHEAD - len(part)))
        seek.append(at)
        at += size
    table = 144
    toc = bytes(min(255, 256 * (table + seek[len(seek) * p // 100]) // (table + at)) if seek else 0 for p in range(100))
    xing = _FRAME[table] + b"Xing" + struct.pack(">III", 7, len(frames), table + at) + toc
    tag = _text_frame("payload_bytes", str(len(payload)))
    return b"ID3\x04\0\0" + bytes((0, 0, len(tag) >> 7, len(tag) & 127)) + tag + xing.ljust(table, b"\0") + b"".join(frames)


def read_payload(data: bytes, track: Track) -> bytes:
    """What write_stream carried."""
    joined = b"".join(data[a:b] for a, b in track.bodies)
    return joined[: int(track.tags["payload_bytes"])]


def pad(text: bytes, unit: int = 192) -> bytes:
    """text with spaces up to a positive multiple of unit."""
    return text.ljust(max(1, -(-len(text) // unit)) * unit, b" ")


_FEATURES = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_bytes", pa.int64()),
        ("payload_bytes", pa.int64()),
        ("payload_sha256", pa.string()),
        ("tail_crc32", pa.int64()),
        ("media_bytes", pa.int64()),
        ("media_sha256", pa.string()),
        ("feature", pa.string()),
        ("samples", pa.int64()),
        ("sample_rate", pa.int32()),
        ("seek_offsets", pa.list_(pa.int64())),
    ]
)


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media: each text's padded UTF-8 bytes as an MPEG audio stream. Null texts are empty."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
        for batch in batches:
            raw = [t.encode() for t in texts_of(batch)]
            yield batch_of(out, [batch.column("doc_id"), list(map(len, raw)), [write_stream(pad(r)) for r in raw]])

    picked = docs.select(F.col("doc_id").cast("long"), "text")
    return arrow_map(picked, encode, "doc_id long, n_bytes long, media binary")


def audio_features(stored: DataFrame) -> DataFrame:
    """Parses stored streams: digests of payload and stream, exact samples and rate, and the seek offset of each frame."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in _FEATURES]
            for doc_id, n_bytes, media in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                track = parse_stream(media)
                payload = read_payload(media, track)
                ms = -(-1000 * track.samples // track.rate)
                feature = (
                    f"mpeg-layer{track.layer} frames={len(track.seek)} samples={track.samples} ms={ms} table={track.table}:"
                    f"{track.table_frames}/{track.table_bytes} crc={track.checked - track.bad}/{track.checked} "
                    f"resyncs={track.resyncs} seek={track.seek[0]}..{track.seek[-1]}"
                )
                values = (
                    doc_id, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]),
                    len(media), hashlib.sha256(media).hexdigest(), feature, track.samples, track.rate, track.seek,
                )
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield batch_of(_FEATURES, rows)

    ddl = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string, samples long, sample_rate int, seek_offsets array<long>"
    )
    return arrow_map(stored.select("doc_id", "n_bytes", "media"), parse, ddl)


def media_round_trip(docs: DataFrame) -> DataFrame:
    """Writes the media column to shared storage, reads it back and parses it.

    Null texts are empty and carry 192 spaces. Repeated rows each give a row, null doc_ids stay null, an empty table
    gives no rows, and other columns are not read. No shuffle.
    """
    return audio_features(materialize(media_column(docs), "media"))
