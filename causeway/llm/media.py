"""MPEG audio columns: bytes stored in audio frames, and a parser for MPEG audio streams.

The encoder writes MPEG-1 Layer III frames (48 kHz, mono, 224 kbit/s, CRC-protected) of silence whose ancillary data
carry 576 payload bytes each, after an ID3v2 tag and a variable-bitrate table. The parser takes any MPEG-1/2/2.5 stream
of layers I to III: it skips tags, finds frame headers again after foreign bytes, reads Xing/Info and VBRI tables,
verifies checksums and gives exact durations and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sliced, whole_text

UNIT = 576
#: Fixed values of the MPEG audio standard: kbit/s by (MPEG-1?, layer), Hz by version bits, samples a frame.
KBITS = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}
SAMPLES = {(True, 1): 384, (True, 2): 1152, (True, 3): 1152, (False, 1): 384, (False, 2): 1152, (False, 3): 576}

FRAME, SIDE = 672, 17
HEADER = bytes([0xFF, 0xFA, 0xC4, 0xC0])  # MPEG-1 Layer III, CRC, 224 kbit/s, 48 kHz, no padding, mono
HEADER_PLAIN = bytes([0xFF, 0xFB, 0xC4, 0xC0])  # the same without CRC, for the table's frame


@dataclass(frozen=True)
class Header:
    version: int
    layer: int
    crc: bool
    kbits: int
    hertz: int
    length: int
    samples: int
    channels: int
    side: int
    bound: int


@lru_cache(maxsize=4096)
def header(raw: bytes) -> Header | None:
    """A frame header of four bytes; None if they are none (free format, which has no length, included)."""
    if len(raw) < 4 or raw[0] != 0xFF or raw[1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = raw[1] >> 3 & 3, 4 - (raw[1] >> 1 & 3), raw[2] >> 4, raw[2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or raw[3] & 3 == 2:
        return None
    one, mono = version == 3, raw[3] >> 6 == 3
    kbits, hertz, samples, pad = KBITS[one, layer][rate], HERTZ[version][hz], SAMPLES[one, layer], raw[2] >> 1 & 1
    length = (12 * kbits * 1000 // hertz + pad) * 4 if layer == 1 else samples // 8 * kbits * 1000 // hertz + pad
    return Header(version, layer, not raw[1] & 1, kbits, hertz, length, samples, 1 if mono else 2, (17 if mono else 32) if one else (9 if mono else 17), 4 * (raw[3] >> 4 & 3) + 4 if raw[3] >> 6 == 1 else 32)


@lru_cache(maxsize=1)
def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32) << 8
    for _ in range(8):
        table = np.where(table & 0x8000, table << 1 ^ 0x8005, table << 1) & 0xFFFF
    return table


def crc16(rows: np.ndarray) -> np.ndarray:
    """The standard's CRC-16 (polynomial 0x8005, start 0xFFFF) of each row of bytes."""
    table, crc = _crc_table(), np.full(len(rows), 0xFFFF, np.uint32)
    for column in rows.T:
        crc = (crc << 8 & 0xFFFF) ^ table[crc >> 8 ^ column]
    return crc


#: Fixed values of the standard: bits of a subband's allocation in Layer II, as (bits, subbands), by table.
ALLOCATION = {
    "a": [(4, 11), (3, 12), (2, 4)],
    "b": [(4, 11), (3, 12), (2, 7)],
    "c": [(4, 2), (3, 6)],
    "d": [(4, 2), (3, 10)],
    "low": [(4, 4), (3, 7), (2, 19)],
}


def _allocation(h: Header) -> list[int]:
    """The bits of each subband's allocation."""
    if h.layer == 1:
        return [4] * 32
    each = h.kbits // h.channels
    if h.version != 3:
        name = "low"
    elif each <= 48:
        name = "d" if h.hertz == 32000 else "c"
    else:
        name = "a" if each <= 80 or h.hertz == 48000 else "b"
    return [bits for bits, n in ALLOCATION[name] for _ in range(n)]


def protected_bits(data: bytes, at: int, h: Header) -> list[int] | None:
    """What the checksum of a frame of Layer I or II covers: two header bytes, the allocations and, in Layer II, the
    scale factor selection; None if the frame is too short for them."""
    raw = data[at + 6 : at + h.length]
    value, size, place = int.from_bytes(raw, "big"), 8 * len(raw), 0

    def take(n: int) -> int:
        nonlocal place
        place += n
        return value >> size - place & (1 << n) - 1 if place <= size else 0

    selected = 0
    for band, bits in enumerate(_allocation(h)):
        found = [take(bits) for _ in range(h.channels if band < h.bound else 1)]
        selected += 2 * (sum(map(bool, found)) if band < h.bound or h.channels == 1 else h.channels * bool(found[0]))
    take(selected if h.layer == 2 else 0)
    if place > size:
        return None
    head = int.from_bytes(data[at + 2 : at + 4], "big")
    return [head >> i & 1 for i in range(15, -1, -1)] + [value >> size - 1 - i & 1 for i in range(place)]


def crc16_bits(bits: list[int]) -> int:
    """The same checksum of single bits."""
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if crc >> 15 ^ b else 0)
    return crc


@dataclass
class Stream:
    tags: list[str] = field(default_factory=list)
    table: str = ""
    table_frames: int = -1
    table_bytes: int = -1
    #: The table's seek points: byte offsets in the stream, evenly spaced in time from its start.
    seek_points: list[int] = field(default_factory=list)
    skipped: int = 0
    resyncs: int = 0
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    crc_checked: int = 0
    crc_bad: int = 0

    @property
    def samples(self) -> int:
        return sum(h.samples for h in self.headers)

    @property
    def seconds(self) -> tuple[int, int]:
        """The exact duration as a fraction (numerator, denominator) of seconds."""
        from fractions import Fraction

        total = sum((Fraction(h.samples, h.hertz) * n for h, n in self._kinds().items()), Fraction(0))
        return total.numerator, total.denominator

    def _kinds(self) -> dict[Header, int]:
        from collections import Counter

        return Counter(self.headers)

    def seek(self, milliseconds: int) -> int:
        """The byte offset of the frame that plays at a time; -1 beyond the end."""
        at = 0.0
        for offset, h in zip(self.offsets, self.headers):
            at += 1000 * h.samples / h.hertz
            if milliseconds < at:
                return offset
        return -1


def _table(stream: Stream, data: bytes, at: int, h: Header) -> bool:
    """Read a Xing/Info or VBRI table from the first frame."""
    for place in {at + 4 + h.side, at + 6 + h.side}:
        if data[place : place + 4] in (b"Xing", b"Info"):
            stream.table, flags, p = data[place : place + 4].decode(), int.from_bytes(data[place + 4 : place + 8], "big"), place + 8
            if flags & 1:
                stream.table_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                stream.table_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4 and len(data) >= p + 100 and stream.table_bytes >= 0:
                stream.seek_points = [at + x * stream.table_bytes // 256 for x in data[p : p + 100]]
            return True
    if data[at + 36 : at + 40] == b"VBRI":
        stream.table, stream.table_bytes, stream.table_frames = "VBRI", int.from_bytes(data[at + 46 : at + 50], "big"), int.from_bytes(data[at + 50 : at + 54], "big")
        entries, scale, size = (int.from_bytes(data[p : p + 2], "big") for p in (at + 54, at + 56, at + 58))
        place = at + h.length
        for p in range(at + 62, at + 62 + entries * size, size or 1):
            if size in (1, 2, 3, 4) and p + size <= at + h.length:
                stream.seek_points.append(place)
                place += int.from_bytes(data[p : p + size], "big") * scale
        return True
    return False


def _ends(data: bytes, at: int) -> bool:
    """Do whole frames, one after another from ``at``, fill the stream to its last byte?"""
    while at < len(data):
        h = header(data[at : at + 4])
        if h is None:
            return False
        at += h.length
    return at == len(data)


def parse(data: bytes) -> Stream:
    """Frames, tags, table and checksums of a stream; bytes of no frame are counted as skipped, never an error."""
    stream, at, end, first = Stream(), 0, len(data), True
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = sum((b & 0x7F) << s for b, s in zip(data[at + 6 : at + 10], (21, 14, 7, 0)))
        stream.tags.append(f"ID3v2.{data[at + 3]}")
        at += 10 + size + 10 * bool(data[at + 5] & 0x10)
    tagged = end - at >= 128 and data[end - 128 : end - 125] == b"TAG"
    end -= 128 * tagged
    synced, checks = True, {}
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if tagged and h is not None and at + h.length > end and _ends(data, at):  # the tag's place is within a frame
            tagged, end = False, len(data)
        if h is not None and at + h.length <= end and (synced or at + h.length == end or header(data[at + h.length : at + h.length + 4]) is not None):
            synced = True
            if first and h.layer == 3 and _table(stream, data, at, h):
                first = False
            else:
                first = False
                stream.offsets.append(at)
                stream.headers.append(h)
                if h.crc and h.layer == 3:
                    checks.setdefault(h.side, []).append(at)
                elif h.crc:
                    bits = protected_bits(data, at, h)
                    stream.crc_checked += 1
                    stream.crc_bad += bits is None or crc16_bits(bits) != int.from_bytes(data[at + 4 : at + 6], "big")
            at += h.length
            continue
        if synced:
            stream.resyncs += 1
            synced = False
        nearest = data.find(b"\xff", at + 1, end)
        nearest = end if nearest < 0 else nearest
        stream.skipped += nearest - at
        at = nearest
    stream.skipped += max(0, end - at)
    if tagged:
        stream.tags.append("ID3v1")
    raw = np.frombuffer(data, np.uint8)
    for side, places in checks.items():
        at_all = np.array(places)[:, None]
        rows = raw[at_all + np.array([2, 3, *range(6, 6 + side)])]
        good = crc16(rows) == (raw[at_all[:, 0] + 4].astype(np.uint32) << 8 | raw[at_all[:, 0] + 5])
        stream.crc_checked += len(good)
        stream.crc_bad += int((~good).sum())
    return stream


def encode(payload: bytes) -> bytes:
    """An MPEG stream that holds ``payload``, whose length is a multiple of 576."""
    n = len(payload) // UNIT
    frames = np.zeros((n, FRAME), np.uint8)
    frames[:, :4] = np.frombuffer(HEADER, np.uint8)
    mark = int(crc16(np.frombuffer(HEADER[2:] + bytes(SIDE), np.uint8)[None, :])[0])
    frames[:, 4], frames[:, 5] = mark >> 8, mark & 255
    frames[:, 6 + SIDE : 6 + SIDE + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    title = b"TIT2" + struct.pack(">IH", 8, 0) + b"\x00payload"
    tag = b"ID3\x03\x00\x00" + bytes([0, 0, 0, len(title)]) + title
    toc = bytes(256 * i // 100 for i in range(100))
    table = (HEADER_PLAIN + bytes(SIDE) + b"Info" + struct.pack(">III", 7, n, (n + 1) * FRAME) + toc).ljust(FRAME, b"\x00")
    return tag + table + frames.tobytes()


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The payload in a stream's frames, read from the stored bytes."""
    if not stream.offsets:
        return b""
    raw, at = np.frombuffer(data, np.uint8), np.array(stream.offsets)
    if len(at) * FRAME == int(at[-1]) - int(at[0]) + FRAME:
        return raw[at[0] : at[0] + len(at) * FRAME].reshape(-1, FRAME)[:, 6 + SIDE : 6 + SIDE + UNIT].tobytes()
    return raw[at[:, None] + np.arange(6 + SIDE, 6 + SIDE + UNIT)].tobytes()


def padded(raw: bytes) -> bytes:
    return raw + b"\xff" * (-len(raw) % UNIT if raw else UNIT)


def feature(stream: Stream) -> str:
    """What the parser found, as one line."""
    top, bottom = stream.seconds
    kinds = sorted({(h.version, h.layer, h.hertz, h.channels, h.kbits) for h in stream.headers})
    shown = ",".join(f"v{v}L{layer}-{hz}Hz-{ch}ch-{kb}k" for v, layer, hz, ch, kb in kinds)
    seeks = ",".join(map(str, stream.offsets[::64]))
    return f"{shown} frames={len(stream.offsets)} samples={stream.samples} seconds={top}/{bottom} crc={stream.crc_checked - stream.crc_bad}/{stream.crc_checked} table={stream.table}:{stream.table_frames} tags={'+'.join(stream.tags)} resyncs={stream.resyncs} seek={seeks}"


def store_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media (binary): every text's UTF-8 bytes as an MPEG stream; null and empty texts are one unit of 255s."""

    def run(batches):
        for batch in sliced(batches, 200):
            raw = [t.encode("utf-8") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, raw)), pa.int64()), pa.array([encode(padded(r)) for r in raw], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(key), whole_text(text).alias("text")).mapInArrow(run, f"doc_id {df.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """Columns of any table with MPEG streams in ``media`` (null: an empty stream): frames, samples, duration, checksums, frame offsets."""
    from pyspark.sql.types import ArrayType, LongType, StringType, StructType

    kept = [f for f in df.schema.fields if f.name not in ("frames", "samples", "duration_us", "crc_bad", "skipped", "feature", "frame_offsets", media)]
    schema = StructType([*kept])
    for name in ("frames", "samples", "duration_us", "crc_bad", "skipped"):
        schema = schema.add(name, LongType())
    schema = schema.add("feature", StringType()).add("frame_offsets", ArrayType(LongType()))
    names = [f.name for f in kept]

    def run(batches):
        for batch in sliced(batches, 200):
            found = [parse(x or b"") for x in batch.column(batch.schema.get_field_index(media)).to_pylist()]
            new = [pa.array([len(s.offsets) for s in found], pa.int64()), pa.array([s.samples for s in found], pa.int64()), pa.array([s.seconds[0] * 1_000_000 // s.seconds[1] for s in found], pa.int64()), pa.array([s.crc_bad for s in found], pa.int64()), pa.array([s.skipped for s in found], pa.int64()), pa.array([feature(s) for s in found], pa.string()), pa.array([s.offsets for s in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), *new], names=schema.names)

    return df.select(*names, media).mapInArrow(run, schema)


def digest_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store every text as an MPEG stream, read the stored bytes back and describe both. Null texts are empty ones; equal
    texts give equal values, repeated rows a row each; other columns are not read; an empty table has no rows.

    The two halves of :func:`store_texts` and :func:`read_media` run in one pass, so a stream lives only while its row is worked on.
    """

    def run(batches):
        sha = lambda b: hashlib.sha256(b).hexdigest()
        for batch in sliced(batches, 500):
            rows = []
            for t in batch.column(1).to_pylist():
                raw = t.encode("utf-8")
                media = encode(padded(raw))
                stream = parse(media)
                back = payload_of(media, stream)
                rows.append((len(raw), len(back), sha(back), zlib.crc32(back[-32:]), len(media), sha(media), feature(stream)))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds))], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), whole_text(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
