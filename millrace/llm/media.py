"""AVI motion-JPEG: payloads in intra frames, RIFF indexes, and shots by adaptive histogram differences.

The format's unit is a DCT coefficient: each 8x8 block of a baseline JPEG frame holds 64 payload bytes as
its 64 quantized coefficients, so nothing is lost.  A restart marker after each block makes the DC value
absolute.  Both Huffman tables hold one symbol (no run, eight bits), so byte v is stored as the eight
magnitude bits of a coefficient.

A file's frames are found by way of the ``idx1`` index.  Any baseline JPEG is decoded (``decode_frame``): Huffman codes of the
frame's own tables, dequantizing, inverse DCT, one to four components, sampling factors, restart intervals.  Frames of the form
that ``encode_avi`` writes take the same steps for all their blocks at once.  Progressive frames, 12-bit samples
and frames that leave their tables out are refused (ValueError).

Shots end where the difference of successive frames' histograms of first-component pixels (luma) exceeds the mean plus ``SIGMAS``
deviations of the differences before it; the first difference is held against those after it, and an only
one against ``LEAST`` alone.  Blocks that only fill up a payload's last frame don't count.

A null text counts as empty; an empty payload is padded to 64 zero bytes; null and repeated ids are carried
along; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm._scratch import small_batches
from millrace.llm._words import utf8

BLOCK = 64
#: Frame's width and height in samples, and blocks in it.
SIDE, BLOCKS = 32, 16
FRAME_MS = 40
BINS = 32
#: Deviations above the mean, the differences looked back on, and the least difference that can end a shot: twice what
#: chance gives between frames of a thousand pixels, sqrt(BINS / (pi * 1024)).
SIGMAS, LOOK_BACK, LEAST = 3.0, 8, 0.2


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


_ONE_CODE = bytes([0, 0, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 0, 0, 0, 0x08])  # one code of eight bits: no run, size 8
HEADER = (
    b"\xff\xd8"
    + _segment(0xDB, b"\x00" + bytes([1]) * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\x01\x11\x00")
    + _segment(0xC4, b"\x00" + _ONE_CODE)
    + _segment(0xC4, b"\x10" + _ONE_CODE)
    + _segment(0xDD, struct.pack(">H", 1))
    + _segment(0xDA, b"\x01\x01\x00\x00\x3f\x00")
)
_HEAD = np.frombuffer(HEADER, dtype=np.uint8)
_SCAN = BLOCKS * (2 * BLOCK + 2)


def padded(raw: bytes) -> bytes:
    return raw + b"\0" * (BLOCK if not raw else -len(raw) % BLOCK)


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def encode_avi(payload: bytes) -> bytes:
    """payload: a positive multiple of 64 bytes."""
    if not payload or len(payload) % BLOCK:
        raise ValueError("the payload's length must be a positive multiple of 64")
    per = BLOCK * BLOCKS
    n = -(-len(payload) // per)
    values = np.zeros(n * per, dtype=np.uint8)
    values[: len(payload)] = np.frombuffer(payload, dtype=np.uint8)
    scan = np.zeros((n, BLOCKS, 2 * BLOCK + 2), dtype=np.uint8)
    scan[:, :, 1 : 2 * BLOCK : 2] = values.reshape(n, BLOCKS, BLOCK)
    scan[:, :, -2] = 0xFF
    scan[:, :, -1] = 0xD0 + np.arange(BLOCKS) % 8
    scan[:, -1, -1] = 0xD9  # the last marker ends the image
    scan = scan.reshape(n, _SCAN)
    if b"\xff" in payload:
        frames = []
        for row in scan:
            stuffed = (row == 0xFF) & (np.arange(_SCAN) % (2 * BLOCK + 2) < 2 * BLOCK)
            flat = np.repeat(row, 1 + stuffed)
            flat[np.cumsum(1 + stuffed)[stuffed] - 1] = 0
            frames.append(HEADER + flat.tobytes())
        sizes = np.array([len(f) for f in frames])
        movi = b"movi" + b"".join(_chunk(b"00dc", f) for f in frames)
    else:
        size = len(HEADER) + _SCAN
        block = np.zeros((n, 8 + size + (size & 1)), dtype=np.uint8)
        block[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), dtype=np.uint8)
        block[:, 8 : 8 + len(HEADER)] = _HEAD
        block[:, 8 + len(HEADER) : 8 + size] = scan
        sizes = np.full(n, size)
        movi = b"movi" + block.tobytes()
    step = 8 + sizes + (sizes & 1)
    index = np.zeros((n, 4), dtype="<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1] = 0x10  # every frame is a key frame
    index[:, 2] = 4 + np.cumsum(step) - step
    index[:, 3] = sizes
    avih = struct.pack("<14I", FRAME_MS * 1000, 0, 0, 0x10, n, 0, 1, int(sizes.max()), SIDE, SIDE, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, FRAME_MS, 1000, 0, n, int(sizes.max()), -1, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", SIDE * SIDE, 0, 0, 0, 0)
    header = b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf))
    info = b"INFO" + _chunk(b"ICMT", b"payload bytes %d\0" % len(payload))
    body = b"AVI " + _chunk(b"LIST", header) + _chunk(b"LIST", info) + _chunk(b"LIST", movi) + _chunk(b"idx1", index.tobytes())
    return b"RIFF" + struct.pack("<I", len(body)) + body


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of each chunk's body; a list's name is its type and its body follows it."""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        begin, stop = at + 8, at + 8 + size
        if stop > end:
            raise ValueError("a RIFF chunk runs over its parent's end")
        if name in (b"RIFF", b"LIST"):
            yield data[begin : begin + 4], begin + 4, stop
        else:
            yield name, begin, stop
        at = stop + (size & 1)


#: Row and column of a block's coefficients in the order of the stream: along diagonals, in turn down and up.
ZIGZAG = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))


def _basis() -> np.ndarray:
    """Pixels (rows of 64) of each coefficient in the order of the stream."""
    wave = np.cos(np.outer(2 * np.arange(8) + 1, np.arange(8)) * np.pi / 16) / 2
    wave[:, 0] /= np.sqrt(2)
    return np.stack([np.outer(wave[:, r], wave[:, c]).reshape(64) for r, c in ZIGZAG]).astype(np.float32)


BASIS = _basis()


def pixels(coefficients: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """The blocks' 64 samples, row by row, by dequantizing and inverse DCT."""
    return np.clip(np.rint((coefficients * quant).astype(np.float32) @ BASIS + 128), 0, 255).astype(np.uint8)


@dataclass
class Header:
    """What a frame's segments say before its entropy-coded data, which begin at ``scan``."""

    height: int
    width: int
    parts: list[tuple[int, int, int, int]]  # component, horizontal and vertical sampling factor, quantization table
    order: list[tuple[int, int, int]]  # component, DC table, AC table
    quant: dict[int, np.ndarray]
    tables: dict[int, bytes]
    interval: int
    scan: int


def read_header(frame: bytes) -> Header:
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    at, tables, quant, interval, size = 2, {}, {}, 0, None
    while at + 4 <= len(frame):
        if frame[at] != 0xFF:
            raise ValueError("a JPEG marker is missing")
        marker = frame[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        length = struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + length]
        if marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("not a JPEG of 8-bit samples")
            size = height, width, [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            raise ValueError("not a baseline JPEG")
        while body and marker == 0xDB:
            wide = body[0] >> 4
            quant[body[0] & 15] = np.frombuffer(body, dtype=">u2" if wide else "u1", count=64, offset=1).astype(np.int64)
            body = body[1 + 64 * (1 + wide) :]
        while body and marker == 0xC4:
            n = 17 + sum(body[1:17])
            tables[body[0]], body = body[1:n], body[n:]
        if marker == 0xDD:
            interval = struct.unpack(">H", body)[0]
        if marker == 0xDA:
            order = [(body[1 + 2 * i], body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15) for i in range(body[0])]
            if size is None or len(order) != len(size[2]) or any(p[3] not in quant for p in size[2]) or any(dc not in tables or 16 + ac not in tables for _, dc, ac in order):
                raise ValueError("a JPEG without its tables, or in several scans")
            return Header(*size, order, quant, tables, interval, at + 2 + length)
        at += 2 + length
    raise ValueError("a JPEG without image data")


def _codes(table: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol, codes counting up from length to length."""
    out, code, at = {}, 0, 16
    for length in range(1, 17):
        for _ in range(table[length - 1]):
            out[length, code] = table[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.bits, self.at = np.unpackbits(np.frombuffer(data, dtype=np.uint8)).tolist(), 0

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.one()
            if (length, code) in codes:
                return codes[length, code]
        raise ValueError("a code that the Huffman tables don't hold")

    def one(self) -> int:
        if self.at >= len(self.bits):
            raise ValueError("a JPEG's data end too early")
        self.at += 1
        return self.bits[self.at - 1]

    def value(self, size: int) -> int:
        v = 0
        for _ in range(size):
            v = v << 1 | self.one()
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _intervals(scan: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers, without stuffed zeros."""
    out, begin, at = [], 0, 0
    while (at := scan.find(b"\xff", at)) >= 0 and at + 1 < len(scan):
        if scan[at + 1] == 0 or scan[at + 1] == 0xFF:
            at += 1 + (scan[at + 1] == 0)
            continue
        out.append(scan[begin:at].replace(b"\xff\0", b"\xff"))
        begin = at = at + 2
        if not 0xD0 <= scan[at - 1] <= 0xD7:
            return out
    return [*out, scan[begin:].replace(b"\xff\0", b"\xff")]


def decode_frame(frame: bytes) -> list[np.ndarray]:
    """Each component's samples, as many as its sampling factors give it of the frame's size."""
    head = read_header(frame)
    factors = {i: (h, v) for i, h, v, _ in head.parts}
    wide, high = max(h for h, _ in factors.values()), max(v for _, v in factors.values())
    across, down = -(-head.width // (8 * wide)), -(-head.height // (8 * high))
    if len(head.parts) == 1:  # a single component is not interleaved
        factors = {head.parts[0][0]: (1, 1)}
        wide = high = 1
        across, down = -(-head.width // 8), -(-head.height // 8)
    codes = {k: _codes(t) for k, t in head.tables.items()}
    found = {i: np.zeros((down * v, across * h, 64), dtype=np.int64) for i, (h, v) in factors.items()}
    units, per = across * down, head.interval or across * down
    for n, data in enumerate(_intervals(frame[head.scan :])[: -(-units // per)]):
        bits, last = _Bits(data), dict.fromkeys(factors, 0)
        for unit in range(n * per, min(units, (n + 1) * per)):
            for i, dc, ac in head.order:
                h, v = factors[i]
                for k in range(h * v):
                    block = found[i][unit // across * v + k // h, unit % across * h + k % h]
                    last[i] += bits.value(bits.symbol(codes[dc]))
                    block[0], at = last[i], 1
                    while at < 64:
                        run, size = divmod(bits.symbol(codes[16 + ac]), 16)
                        if not size and run < 15:
                            break  # the rest of the block is zero
                        at += run
                        if at > 63:
                            raise ValueError("a JPEG block with too many coefficients")
                        block[at] = bits.value(size)
                        at += 1
    out = []
    for i, _, _, q in head.parts:
        h, v = factors[i]
        rows, columns = found[i].shape[:2]
        plane = pixels(found[i].reshape(-1, 64), head.quant[q]).reshape(rows, columns, 8, 8).swapaxes(1, 2).reshape(rows * 8, columns * 8)
        out.append(plane[: -(-head.height * v // high), : -(-head.width * h // wide)])
    return out


def _is_own(head: Header) -> bool:
    return head.tables == {0x00: _ONE_CODE, 0x10: _ONE_CODE} and head.interval == 1 and len(head.parts) == 1 and (head.height, head.width) == (SIDE, SIDE)


def decode_scan(scan: np.ndarray) -> np.ndarray:
    """Coefficient bytes of one own frame's entropy-coded data."""
    marks = np.flatnonzero(scan[:-1] == 0xFF)
    scan = np.delete(scan, marks[scan[marks + 1] == 0] + 1).reshape(BLOCKS, 2 * BLOCK + 2)
    return _coefficients(scan[None])[0]


def _coefficients(scan: np.ndarray) -> np.ndarray:
    if scan[:, :, 0 : 2 * BLOCK : 2].any() or (scan[:, :, -2] != 0xFF).any():
        raise ValueError("a code that the Huffman tables don't hold")
    return scan[:, :, 1 : 2 * BLOCK : 2].reshape(len(scan), -1)


def _stored(payload: np.ndarray, quant: np.ndarray) -> np.ndarray:
    """Pixels of own frames: a byte's eight bits are those of a coefficient of that size."""
    value = payload.astype(np.int16)
    return pixels(np.where(value < 128, value - 255, value).reshape(-1, BLOCK), quant).reshape(payload.shape)


@dataclass
class Film:
    payload: bytes | None  # of own files
    histograms: np.ndarray  # one row per frame, each with sum 1
    frame_ms: float


def _histogram(samples: np.ndarray) -> np.ndarray:
    return np.bincount(samples.reshape(-1) >> 3, minlength=BINS) / max(samples.size, 1)


def decode_avi(data: bytes) -> Film:
    (kind, at, end), *_ = riff_chunks(data, 0, len(data))
    if kind != b"AVI ":
        raise ValueError("not an AVI file")
    found = {name: (a, b) for name, a, b in riff_chunks(data, at, end)}
    length = next((int(data[a:b].rstrip(b"\0").split()[-1]) for name, a, b in riff_chunks(data, *found[b"INFO"]) if name == b"ICMT"), None) if b"INFO" in found else None
    micros = next(struct.unpack_from("<I", data, a)[0] for name, a, b in riff_chunks(data, *found[b"hdrl"]) if name == b"avih")
    index = np.frombuffer(data, dtype="<u4", count=(found[b"idx1"][1] - found[b"idx1"][0]) // 16 * 4, offset=found[b"idx1"][0]).reshape(-1, 4)
    index = index[np.isin(index[:, 0] >> 16, [int.from_bytes(x, "little") for x in (b"dc", b"db")])]  # video only
    begin, sizes = index[:, 2].astype(np.int64) + 8, index[:, 3].astype(np.int64)
    if not sizes.any():
        return Film(None, np.zeros((0, BINS)), micros / 1000)
    if data[begin[0] - 8 : begin[0] - 4] != int(index[0, 0]).to_bytes(4, "little"):  # places count from the file's begin, or else from the list's name
        begin += found[b"movi"][0] - 4
    one = int(np.argmax(sizes > 0))
    head = read_header(data[begin[one] : begin[one] + sizes[one]])
    raw = np.frombuffer(data, dtype=np.uint8)
    if not _is_own(head) or length is None:
        rows = []
        for b, s in zip(begin.tolist(), sizes.tolist(), strict=True):  # an empty frame repeats the one before it
            rows.append(_histogram(decode_frame(data[b : b + s])[0]) if s else rows[-1] if rows else np.zeros(BINS))
        return Film(None, np.stack(rows), micros / 1000)
    first = head.scan
    if (sizes == first + _SCAN).all():  # nothing was stuffed: all frames at once
        frames = raw[begin[:, None] + np.arange(sizes[0])]
        if (frames[:, :first] != frames[0, :first]).any():
            raise ValueError("frames differ in their headers")
        stored = _coefficients(frames[:, first:].reshape(-1, BLOCKS, 2 * BLOCK + 2))
    else:
        stored = np.stack([decode_scan(raw[b + first : b + s]) for b, s in zip(begin.tolist(), sizes.tolist(), strict=True)])
    n, per = stored.shape
    samples = _stored(stored, head.quant[head.parts[0][3]]).reshape(-1)[:length]
    counts = np.bincount((samples >> 3) + np.repeat(np.arange(n) * BINS, per)[:length], minlength=n * BINS).reshape(n, BINS)
    return Film(stored.tobytes()[:length], counts / np.maximum(counts.sum(axis=1, keepdims=True), 1), micros / 1000)


def differences(histograms: np.ndarray) -> np.ndarray:
    """Between 0 and 1 for each frame and the one before it."""
    return np.abs(np.diff(histograms, axis=0)).sum(axis=1) / 2


def shots(diff: np.ndarray, frames: int) -> list[tuple[int, int]]:
    """First and past-last frame of each shot."""
    cuts = [0]
    for i, d in enumerate(diff.tolist()):
        near = diff[max(0, i - LOOK_BACK) : i] if i else diff[1 : 1 + LOOK_BACK]
        if d >= LEAST and (not len(near) or d > near.mean() + SIGMAS * near.std() + 1e-9):
            cuts.append(i + 1)
    return list(zip(cuts, [*cuts[1:], frames], strict=True))


def analyse(data: bytes) -> tuple[bytes | None, list[tuple[int, int, float]]]:
    """The payload read back (None for a file of another kind), and clips: start_ms, end_ms, difference at their start (0 for the first)."""
    film = decode_avi(data)
    diff = differences(film.histograms)
    clips = [(round(a * film.frame_ms), round(b * film.frame_ms), float(diff[a - 1]) if a else 0.0) for a, b in shots(diff, len(film.histograms))]
    return film.payload, clips if len(film.histograms) else []


def _texts(column: pa.Array) -> Iterator[bytes]:
    data, at = utf8(column)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield data[a:b].tobytes()


def store(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One AVI file per row: doc_id, media (binary)."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("media", T.BinaryType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([encode_avi(padded(x)) for x in _texts(batch.column(1))], pa.binary())], schema=arrow)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def clips(media: DataFrame, *, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Timed clip rows of AVI files: doc_id, clip, start_ms, end_ms, difference.  A null file has none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(media.sparkSession)
    schema = T.StructType([T.StructField(id_col, media.schema[id_col].dataType), T.StructField("clip", T.LongType()), T.StructField("start_ms", T.LongType()), T.StructField("end_ms", T.LongType()), T.StructField("difference", T.DoubleType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows = [(i, c, *clip) for i, x in enumerate(batch.column(1).to_pylist()) if x is not None for c, clip in enumerate(analyse(x)[1])]
            at, *rest = zip(*rows, strict=True) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, f.type) for x, f in zip(rest, list(arrow)[1:], strict=True))], schema=arrow)

    return media.select(id_col, media_col).mapInArrow(run, schema)


def digest(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``store`` and ``clips`` in one pass, with digests in place of the bytes.

    doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    small_batches(docs.sparkSession)
    long, text = T.LongType(), T.StringType()
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), *(T.StructField(n, t) for n, t in (("n_bytes", long), ("payload_bytes", long), ("payload_sha256", text), ("tail_crc32", long), ("media_bytes", long), ("media_sha256", text), ("feature", text)))])
    arrow = to_arrow_schema(schema)

    def one(raw: bytes) -> tuple:
        data = encode_avi(padded(raw))
        payload, found = analyse(data)
        feature = f"clips={len(found)};" + ",".join(f"{a}-{b}:{d:.4f}" for a, b, d in found)
        return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature

    def run(batches):
        for batch in batches:
            rows = [one(x) for x in _texts(batch.column(1))]
            columns = zip(*rows, strict=True) if rows else ((),) * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, f.type) for x, f in zip(columns, list(arrow)[1:], strict=True))], schema=arrow)

    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
