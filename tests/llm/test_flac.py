import hashlib
import tracemalloc
import zlib

import numpy as np
import pytest

from tessera.llm import flac, queries

TEXTS = [b"", b"a", b"a" * 575, b"a" * 576, b"The and attion to thanedble the, anea. " * 300, bytes(range(256)) * 9, b"\x00\xff" * 3000, "çàé ü 😀".encode() * 500, b"x" * 5000]


def payloads():
    rng = np.random.default_rng(0)
    noise = [rng.integers(0, 256, 5760).astype(np.uint8).tobytes(), (np.sin(np.arange(57600) / 7) * 100 + 128).astype(np.uint8).tobytes()]
    spikes = np.zeros(2880, dtype=np.uint8) + 128
    spikes[::500] = 255
    return [flac.padded(t) for t in TEXTS] + noise + [spikes.tobytes()]


def test_round_trip_and_offsets():
    want = payloads()
    media = flac.encode(want)
    got = flac.decode(media)
    assert [p for p, _ in got] == want
    assert all(o == list(range(0, len(p), 576)) for p, o in got)
    assert len(media[-2]) < 0.5 * len(want[-2])  # a tone is predicted


def test_streams_without_seek_table_decode_alike():
    want = payloads()
    bare = []
    for s in flac.encode(want):
        size = int.from_bytes(s[43:46], "big")
        bare.append(s[:4] + b"\x80" + s[5:42] + s[46 + size :])
    assert [p for p, _ in flac.decode(bare)] == want


def test_slabs_do_not_change_streams(monkeypatch):
    want = payloads()
    media = flac.encode(want)
    monkeypatch.setattr(flac, "ENCODE_FRAMES", 7)
    monkeypatch.setattr(flac, "DECODE_FRAMES", 5)
    monkeypatch.setattr(flac, "SEEK_POINTS", 3)
    cut = flac.encode(want)
    assert [p for p, _ in flac.decode(cut)] == [p for p, _ in flac.decode(media)] == want
    assert [s for s, p in zip(cut, want, strict=True) if len(p) <= 3 * 576] == [s for s, p in zip(media, want, strict=True) if len(p) <= 3 * 576]


def test_a_text_of_20_mb_in_bounded_memory():
    payload = flac.padded(b"The and attion to thanedble the, anea. " * 512_000)
    tracemalloc.start()
    (pcm, offsets), = flac.decode(flac.encode([payload]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert pcm == payload and offsets[-1] == len(payload) - 576
    assert peak < 20 * len(payload)


def test_seek_point_leads_to_its_block():
    payload = payloads()[4]
    s = flac.encode([payload])[0]
    size = int.from_bytes(s[43:46], "big")
    point = s[46 + 5 * 18 : 46 + 6 * 18]
    sample, offset = int.from_bytes(point[:8], "big"), int.from_bytes(point[8:16], "big")
    frames, numbers, _ = flac.decode_frames(s, [46 + size + offset])
    assert sample == 5 * 576 and numbers.tolist() == [5]
    assert (frames[0] + flac.LEVEL).astype(np.uint8).tobytes() == payload[sample : sample + 576]


def test_damage_is_found():
    s = bytearray(flac.encode([payloads()[4]])[0])
    s[-100] ^= 4
    with pytest.raises(ValueError):
        flac.decode([bytes(s)])


def test_checksums_by_bits():
    data = bytes(range(1, 200))
    for bits, poly in ((8, 0x07), (16, 0x8005)):
        crc = 0
        for b in data:
            crc ^= b << bits - 8
            for _ in range(8):
                crc = (crc << 1 ^ poly if crc >> bits - 1 else crc << 1) & (1 << bits) - 1
        got = flac.crc8(data) if bits == 8 else int(flac.crc16(np.frombuffer(data, np.uint8), np.array([0]), np.array([len(data)]))[0])
        assert got == crc


def test_large_frame_numbers():
    for n in (0, 127, 128, 2047, 2048, 65535, 65536, 2_000_000):
        head = flac.frame_header(n) + b"\x00\x05\x00\x00"
        assert flac._headers(head, [0])[1].tolist() == [n]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text.encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op3_flac(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        p = flac.padded(texts[r.doc_id])
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(texts[r.doc_id]), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))


def test_null_text_extra_columns_and_empty_table(spark):
    docs = spark.createDataFrame([(1, None, "m"), (None, "é", "m"), (1, None, "m")], "doc_id long, text string, media string")
    rows = flac.from_media(flac.to_media(docs)).collect()
    assert sorted(len(r.pcm) for r in rows) == [576] * 3
    assert flac.from_media(flac.to_media(docs.limit(0))).count() == 0
