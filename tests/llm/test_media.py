"""Media columns: exact round trips, the files' structure, shots."""

import hashlib
import zlib

import numpy as np
import pytest
from cases import TEXTS, documents

from millrace.llm import media


@pytest.mark.parametrize("raw", [b"", b"a", b"x" * 64, bytes(range(256)) * 9, b"\xff" * 5000, np.random.default_rng(0).bytes(20_000)])
def test_round_trip(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw)
    data = media.encode_avi(payload)
    film = media.decode_avi(data)
    assert film.payload == payload and np.allclose(film.histograms.sum(axis=1), 1)
    names = [n for n, _, _ in media.riff_chunks(data, 12, len(data))]
    assert names == [b"hdrl", b"INFO", b"movi", b"idx1"]


def test_damage_is_seen():
    data = bytearray(media.encode_avi(media.padded(b"x" * 3000)))
    data[data.index(b"\xff\xdb") + 1] = 0xC4
    with pytest.raises(ValueError):
        media.decode_avi(bytes(data))
    with pytest.raises(ValueError):
        media.encode_avi(b"abc")


def test_shots():
    rng = np.random.default_rng(1)
    per = media.BLOCK * media.BLOCKS
    scenes = [rng.integers(lo, lo + 40, n * per, dtype=np.uint8).tobytes() for lo, n in ((0, 12), (120, 9), (200, 11))]
    payload, clips = media.analyse(media.encode_avi(b"".join(scenes)))
    assert [(a, b) for a, b, _ in clips] == [(0, 480), (480, 840), (840, 1280)]
    assert len(payload) == 32 * per


def test_first_frame_can_be_a_shot():
    per = media.BLOCK * media.BLOCKS
    shots = lambda raw: [(a, b) for a, b, _ in media.analyse(media.encode_avi(raw))[1]]
    assert shots(b"a" * per + b"\xc8" * per) == [(0, 40), (40, 80)]
    assert shots(b"a" * per + b"\xc8" * 9 * per) == [(0, 40), (40, 400)]
    assert shots(b"a" * 2 * per) == [(0, 80)]


def plain_pixels(coefficients, quant):
    """A block's samples by the definition of the inverse DCT."""
    c = lambda k: 1 / np.sqrt(2) if k == 0 else 1
    out = np.zeros((8, 8))
    for k, (v, u) in enumerate(media.ZIGZAG):
        for y in range(8):
            for x in range(8):
                out[y, x] += c(u) * c(v) / 4 * coefficients[k] * quant[k] * np.cos((2 * x + 1) * u * np.pi / 16) * np.cos((2 * y + 1) * v * np.pi / 16)
    return np.clip(np.rint(out + 128), 0, 255)


def foreign_jpeg(rng, height, width, factors, interval, bright=0):
    """A baseline JPEG with Huffman and quantization tables of its own, and its components' coefficients and table."""
    symbols = list(dict.fromkeys([0x00, 0x01, 0x11, 0x02, 0xF0, *(s for s in range(256) if 1 <= s % 16 <= 4)]))
    dht = bytes([0, 1, 1, 1, 1] + [0] * 5 + [min(40, len(symbols) - 4), max(0, len(symbols) - 44)] + [0] * 4) + bytes(symbols)
    codes, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(dht[length - 1]):
            codes[dht[at]] = f"{code:0{length}b}"
            code, at = code + 1, at + 1
        code <<= 1
    size_codes = {s: f"{s:04b}" for s in range(12)}
    dc = bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12))
    quant = rng.integers(1, 30, 64)
    wide, high = max(h for h, _ in factors), max(v for _, v in factors)
    across, down = -(-width // (8 * wide)), -(-height // (8 * high))
    found = [np.zeros((down * v, across * h, 64), int) for h, v in factors]
    for f in found:
        f[..., 0] = rng.integers(-20, 20, f.shape[:2]) + bright
        f[..., 1:] = rng.integers(-9, 10, (*f.shape[:2], 63)) * (rng.random((*f.shape[:2], 63)) < 0.1)
        f[0, 0, 63] = 5
    bits_of = lambda v, n: "" if not n else f"{v if v > 0 else v + (1 << n) - 1:0{n}b}"
    out, bits, last = b"", "", [0] * len(factors)

    def flush():
        raw = "".join([bits, "1" * (-len(bits) % 8)])
        return bytes(int(raw[i : i + 8], 2) for i in range(0, len(raw), 8)).replace(b"\xff", b"\xff\0")

    for unit in range(across * down):
        if interval and unit and unit % interval == 0:
            out, bits, last = out + flush() + bytes([0xFF, 0xD0 + (unit // interval - 1) % 8]), "", [0] * len(factors)
        for i, (h, v) in enumerate(factors):
            for k in range(h * v):
                block = found[i][unit // across * v + k // h, unit % across * h + k % h].tolist()
                n = abs(block[0] - last[i]).bit_length()
                bits += size_codes[n] + bits_of(block[0] - last[i], n)
                last[i], run = block[0], 0
                for x in block[1:]:
                    if not x:
                        run += 1
                        continue
                    while run > 15:
                        bits, run = bits + codes[0xF0], run - 16
                    n = abs(x).bit_length()
                    bits, run = bits + codes[16 * run + n] + bits_of(x, n), 0
                if run:
                    bits += codes[0x00]
    segment = media._segment
    head = b"\xff\xd8" + segment(0xE0, b"JFIF\0 and more") + segment(0xFE, b"a comment") + segment(0xDB, b"\x02" + bytes(quant.tolist()))
    head += segment(0xC0, bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([len(factors)]) + b"".join(bytes([i + 1, h << 4 | v, 2]) for i, (h, v) in enumerate(factors)))
    head += segment(0xC4, b"\x01" + dc + b"\x13" + dht) + (segment(0xDD, interval.to_bytes(2, "big")) if interval else b"")
    head += segment(0xDA, bytes([len(factors)]) + b"".join(bytes([i + 1, 0x13]) for i in range(len(factors))) + b"\0\x3f\0")
    return head + out + flush() + b"\xff\xd9", found, quant


@pytest.mark.parametrize("factors,interval", [([(1, 1)], 0), ([(1, 1)], 3), ([(2, 2), (1, 1), (1, 1)], 0), ([(2, 1), (1, 1), (1, 1)], 2)])
def test_a_foreign_jpeg_is_decoded(factors, interval):
    frame, found, quant = foreign_jpeg(np.random.default_rng(4), 37, 50, factors, interval)
    planes = media.decode_frame(frame)
    assert [p.shape for p in planes] == [(-(-37 * v // max(y for _, y in factors)), -(-50 * h // max(x for x, _ in factors))) for h, v in factors]
    for plane, blocks in zip(planes, found, strict=True):
        for r, c in ((0, 0), (1, 1)):
            want = plain_pixels(blocks[r, c], quant)
            got = plane[8 * r : 8 * r + 8, 8 * c : 8 * c + 8]
            assert np.abs(got - want[: got.shape[0], : got.shape[1]]).max() <= 1  # rounding
    for damaged in (b"GIF89a", frame[:200], frame.replace(b"\xff\xc0", b"\xff\xc2"), frame[: len(frame) // 2]):
        with pytest.raises(ValueError):
            media.decode_frame(damaged)


@pytest.mark.parametrize("absolute", [False, True])
def test_a_foreign_film_has_clips(spark, absolute):
    frames = [foreign_jpeg(np.random.default_rng(1 if i < 7 else 2), 32, 48, [(2, 2), (1, 1), (1, 1)], 0, bright=-40 if i < 7 else 60)[0] for i in range(12)]
    frames.insert(3, b"")
    movi = b"movi" + b"".join(media._chunk(b"00dc", f) + media._chunk(b"01wb", b"sound") for f in frames)
    headers = media._chunk(b"LIST", b"hdrl" + media._chunk(b"avih", (20_000).to_bytes(4, "little") + bytes(52)))
    index, at = b"", 4 + (12 + len(headers) + 8 if absolute else 0)
    for f in frames:
        index += b"00dc" + (16).to_bytes(4, "little") + at.to_bytes(4, "little") + len(f).to_bytes(4, "little")
        index += b"01wb" + bytes(4) + at.to_bytes(4, "little") + (5).to_bytes(4, "little")
        at += 8 + len(f) + len(f) % 2 + 14
    body = b"AVI " + headers + media._chunk(b"LIST", movi) + media._chunk(b"idx1", index)
    film = b"RIFF" + len(body).to_bytes(4, "little") + body
    payload, clips = media.analyse(film)
    assert payload is None and [(a, b) for a, b, _ in clips] == [(0, 160), (160, 260)]
    table = spark.createDataFrame([(1, film), (2, None)], "doc_id long, media binary")
    assert [(r.doc_id, r.clip, r.start_ms, r.end_ms) for r in media.clips(table).collect()] == [(1, 0, 0, 160), (1, 1, 160, 260)]


def test_documents(spark):
    docs = documents(spark)
    got = {}
    for r in media.digest(docs).collect():
        got.setdefault(r.doc_id, []).append(r)
    assert sum(map(len, got.values())) == len(TEXTS)
    for i, t, *_ in TEXTS:
        raw = (t or "").encode()
        payload = media.padded(raw)
        for r in got[i]:
            found = media.analyse(media.encode_avi(payload))[1]
            feature = f"clips={len(found)};" + ",".join(f"{a}-{b}:{d:.4f}" for a, b, d in found)
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), feature)
    files = media.store(docs).collect()
    assert {hashlib.sha256(bytes(r.media)).hexdigest() for r in files} == {r.media_sha256 for x in got.values() for r in x}
    clips = media.clips(media.store(docs)).collect()
    assert {r.doc_id for r in clips} == {i for i, *_ in TEXTS} and all(r.end_ms > r.start_ms for r in clips)
    assert media.digest(documents(spark, [])).count() == 0
