import hashlib
import random
import zlib

import pytest
from paths import SMALL

from causeway.llm import media, queries, sharding


@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 1152, 5000, 40000])
def test_round_trip(size):
    payload = media.padded(random.Random(size).randbytes(size).replace(b"\xff", b"\xfe"))
    stream = media.parse(data := media.encode(payload))
    assert media.payload_of(data, stream) == payload and len(payload) % 576 == 0 and payload
    n = len(payload) // 576
    assert len(stream.offsets) == stream.table_frames == n and stream.table_bytes == 672 * (n + 1) and stream.crc_bad == stream.skipped == 0 and stream.crc_checked == n
    assert stream.seconds[0] * 48000 == 1152 * n * stream.seconds[1] and stream.seek(24 * (n - 1)) == stream.offsets[-1] and stream.seek(24 * n) == -1


def test_resync_tags_and_bad_checksums():
    payload = media.padded(b"hello" * 500)
    clean = media.encode(payload)
    first = media.parse(clean).offsets[1]
    noisy = clean[:first] + b"junk\xff\xfbmore junk" + clean[first:] + b"TAG" + bytes(125)
    stream = media.parse(noisy)
    assert stream.resyncs == 1 and stream.skipped == 15 and stream.tags == ["ID3v2.3", "ID3v1"] and media.payload_of(noisy, stream) == payload
    broken = bytearray(clean)
    broken[first + 8] ^= 1
    assert media.parse(bytes(broken)).crc_bad == 1
    assert media.parse(b"").offsets == [] and media.parse(b"\xff" * 50).offsets == [] and media.parse(b"ID3").skipped == 3


def test_headers():
    h = media.header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.kbits, h.hertz, h.length, h.samples, h.channels) == (128, 44100, 417, 1152, 2)
    h = media.header(bytes([0xFF, 0xF3, 0x80, 0xC0]))  # MPEG-2 layer III, 64 kbit/s, 22.05 kHz
    assert (h.kbits, h.hertz, h.length, h.samples) == (64, 22050, 208, 576)
    assert media.header(bytes([0xFF, 0xFF, 0x40, 0x00])).length == (12 * 128000 // 44100) * 4
    assert media.header(b"\xff\xfb\xf0\x00") is None and media.header(b"\xff\xfb") is None


def test_vbri_and_variable_rates():
    def frame(kbits_index, body=b""):
        raw = bytes([0xFF, 0xFB, kbits_index << 4, 0xC0])
        return (raw + body).ljust(media.header(raw).length, b"\0")

    table = frame(9, bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (3).to_bytes(4, "big"))
    stream = media.parse(table + frame(5) + frame(9) + frame(14))
    assert stream.table == "VBRI" and stream.table_frames == 3 and stream.table_bytes == 5000 and [h.kbits for h in stream.headers] == [64, 128, 320]


    entries = frame(9, bytes(32) + b"VBRI" + bytes(6) + (5000).to_bytes(4, "big") + (3).to_bytes(4, "big") + bytes([0, 2, 0, 3, 0, 2, 0, 1, 0, 50, 0, 70]))
    assert media.parse(entries + frame(5) + frame(9)).seek_points == [417, 417 + 150]


def test_info_table_gives_seek_points():
    data = media.encode(media.padded(b"x" * 576 * 500))
    stream = media.parse(data)
    at = data.index(b"Info") - 4 - media.SIDE
    assert stream.table == "Info" and len(stream.seek_points) == 100 and stream.seek_points[:2] == [at, at + 2 * 672 * 501 // 256] and max(stream.seek_points) < len(data)


def crc_by_division(bits):
    """The remainder of the bits, begun with ones, by the polynomial, as one long division."""
    value = int("".join(map(str, bits)) + "0" * 16, 2) ^ 0xFFFF << len(bits)
    for i in range(len(bits) + 15, 15, -1):
        if value >> i & 1:
            value ^= 0x18005 << i - 16
    return value


# header bytes, and the bits that the checksum covers after the header when the allocation is all zero, and when one subband's is one
CASES = [
    (b"\xff\xfe\x80\xc0", 128, 0),  # Layer I, mono: 32 subbands of 4 bits
    (b"\xff\xfe\x80\x00", 256, 0),  # Layer I, stereo
    (b"\xff\xfe\x80\x50", 4 * (2 * 8 + 24), 0),  # Layer I, joint stereo from subband 8
    (b"\xff\xfc\xa4\x00", 2 * 88, 2),  # Layer II, 192 kbit/s at 48 kHz: 27 subbands
    (b"\xff\xfc\xc0\x00", 2 * 94, 2),  # Layer II, 256 kbit/s at 44.1 kHz: 30 subbands
    (b"\xff\xfc\x24\xc0", 26, 2),  # Layer II, 48 kbit/s mono at 48 kHz: 8 subbands
    (b"\xff\xfc\x28\xc0", 38, 2),  # Layer II, 48 kbit/s mono at 32 kHz: 12 subbands
    (b"\xff\xf4\x84\xc0", 75, 2),  # MPEG-2 Layer II, mono
]


@pytest.mark.parametrize("head, covered, selection", CASES)
def test_checksums_of_layers_one_and_two(head, covered, selection):
    h = media.header(head)
    for first in (0, 1):
        body = bytearray(h.length - 6)
        body[0] = first << 4  # the first subband of the first channel
        n = covered + selection * first
        bits = [int(b) for b in f"{int.from_bytes(head[2:], 'big'):016b}" + "".join(f"{b:08b}" for b in body)[:n]]
        frame = head + crc_by_division(bits).to_bytes(2, "big") + bytes(body)
        stream = media.parse(frame * 3)
        assert (stream.crc_checked, stream.crc_bad, len(stream.offsets)) == (3, 0, 3)
        wrong = bytearray(frame * 3)
        wrong[6 + (n - 1) // 8] ^= 128 >> (n - 1) % 8  # the last bit that is covered
        beyond = bytearray(frame * 3)
        beyond[6 + (n + 8) // 8] ^= 1
        assert media.parse(bytes(wrong)).crc_bad == 1 and media.parse(bytes(beyond)).crc_bad == 0


def test_media_columns(spark, docs):
    stored = media.store_texts(docs(None, "", "ünï" * 400, "ünï" * 400))
    read = {r.doc_id: r for r in media.read_media(stored.withColumnRenamed("n_bytes", "frames")).collect()}
    assert read[0].frames == 1 and read[2].feature == read[3].feature and read[2].duration_us == 24000 * read[2].frames and len(read[2].frame_offsets) == read[2].frames
    assert media.read_media(stored.selectExpr("doc_id", "cast(null as binary) as media")).first().frames == 0 and media.digest_texts(docs("a").limit(0)).count() == 0


def test_media_repeats_and_clashes(spark, docs):
    table = docs("same", "same", "long " * 40_000, ids=[1, 1, 2]).selectExpr("*", "'x' as media_bytes", "1 as feature")
    rows = media.digest_texts(table).collect()
    assert len(rows) == 3 and len({r[1:] for r in rows}) == 2 and max(r.n_bytes for r in rows) == 200_000


def test_media_query(spark):
    got = {r.doc_id: r for r in queries.op6_mpeg_media(spark, SMALL).collect()}
    for d in spark.read.parquet(f"{SMALL}/documents.parquet").collect():
        raw = d.text.encode()
        full = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        r = got[d.doc_id]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r.media_sha256 == hashlib.sha256(media.encode(full)).hexdigest()


def test_sharding_equals_sql(spark, duck, same):
    for limit in (1 << 14, 1 << 17, 1 << 20):
        df = sharding.shard(spark.read.parquet(f"{SMALL}/documents.parquet"), limit)
        assert same(df, duck.sql(sharding.shard_sql(limit))) == 200
        sizes = {}
        for r in df.collect():
            sizes.setdefault(r.shard_id, []).append(r.n_bytes)
        assert all(sum(s) <= limit or len(s) == 1 for s in sizes.values())


def test_sharding_edges(spark, docs, tmp_path):
    table = docs("x" * 500, "y" * 10, None, "", "z" * 10, "same", "same", ids=[1, 2, 3, 4, 5, 6, 6]).withColumn("depth", sharding.F.lit("clash"))
    rows = sharding.shard(table, 20).collect()
    assert len(rows) == 7 and {r.n_bytes for r in rows if r.doc_id in (3, 4)} == {0} and len({r.shard_id for r in rows if r.doc_id == 6}) == 1
    assert len([r for r in rows if r.shard_id == next(x.shard_id for x in rows if x.doc_id == 1)]) == 1
    assert sharding.shard(table.limit(0), 20).count() == 0
    for name in ("h", "cell", "bytes", "_id"):
        assert sorted(r[:] for r in sharding.shard(table.withColumnRenamed("doc_id", name), 20, key=name).collect()) == sorted(r[:] for r in rows)
    sharding.write_shards(table, str(tmp_path / "out"), 1000)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 7


@pytest.mark.parametrize("units", [1, 3])
def test_tag_within_a_payload(units):
    """'TAG' where an ID3v1 tag would begin, 128 bytes before the end, is payload; a real tag after it is still a tag."""
    payload = bytearray(b"x" * 576 * units)
    payload[-55:-52] = b"TAG"
    data = media.encode(bytes(payload))
    assert data[-128:-125] == b"TAG" and payload[576 * (units - 1) + 521 :][:3] == b"TAG"
    stream = media.parse(data)
    assert media.payload_of(data, stream) == payload and stream.tags == ["ID3v2.3"] and len(stream.offsets) == units and stream.skipped == 0
    more = data + b"TAG" + bytes(125)
    stream = media.parse(more)
    assert media.payload_of(more, stream) == payload and stream.tags == ["ID3v2.3", "ID3v1"] and stream.skipped == 0
