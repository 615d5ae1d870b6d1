"""FLAC columns: bytes as lossless 8-bit audio, and back to PCM blocks with seekable offsets.

All frames of a batch are coded side by side in numpy: each step handles one sample of every frame.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, functions as F

BLOCK = 576
#: The fixed predictors' coefficients, latest sample first, and the sizes that block codes 1 to 5 stand for.
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608}
#: Of the encoder: residual partitions as a power of two, order and shift of its own linear predictors.
PARTS, ORDER, SHIFT = 2, 4, 6
#: The byte that is sample zero: text lies around it, so its residuals are small. Samples are bytes less this, modulo 256.
LEVEL = 106
#: Bytes of payload taken from a batch at a time, and frames of these coded and decoded side by side, whatever a text's size.
CHUNK, ENCODE_FRAMES, DECODE_FRAMES = 1_200_000, 512, 2048
#: Seek points of one metadata block.
SEEK_POINTS = 900_000


def _crc_table(poly: int, bits: int, feed: int) -> np.ndarray:
    """The CRC of every value of `feed` bits, for a register of `bits` bits that starts at zero."""
    crc = np.arange(1 << feed, dtype=np.int64) << max(0, bits - feed)
    for _ in range(feed):
        crc = np.where(crc >> (bits - 1) & 1, crc << 1 ^ poly, crc << 1) & ((1 << bits) - 1)
    return crc


@lru_cache(maxsize=1)
def _crc16_table() -> np.ndarray:
    return _crc_table(0x8005, 16, 16).astype(np.uint16)


@lru_cache(maxsize=1)
def _crc8_table() -> list[int]:
    return _crc_table(0x07, 8, 8).tolist()


def crc16(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-16 of many ranges of data, two bytes a step; leading zeros don't change it, so ranges end together."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint16)
    width = int((ends - starts).max() + 1) // 2 * 2
    at = ends[:, None] + np.arange(-width, 0)
    rows = np.where(at >= starts[:, None], data[np.maximum(at, 0)], 0).astype(np.uint8)
    words = np.ascontiguousarray(rows.reshape(len(starts), -1, 2)[:, :, 0].astype(np.uint16) << 8 | rows.reshape(len(starts), -1, 2)[:, :, 1]).T
    table, crc = _crc16_table(), np.zeros(len(starts), dtype=np.uint16)
    for word in words:
        crc = table[crc ^ word]
    return crc


def crc8(data: bytes) -> int:
    crc, table = 0, _crc8_table()
    for b in data:
        crc = table[crc ^ b]
    return crc


def _coded_number(n: int) -> bytes:
    if n < 0x80:
        return bytes([n])
    more = next(k for k in range(1, 7) if n < 1 << (5 * k + 6))
    tail = [0x80 | n >> 6 * i & 0x3F for i in range(more - 1, -1, -1)]
    return bytes([(0xFF00 >> more + 1) & 0xFF | n >> 6 * more, *tail])


@lru_cache(maxsize=4096)
def frame_header(n: int) -> bytes:
    """Frame n of fixed blocks of 576 samples, mono, 8 bits, the rate of the stream."""
    head = b"\xff\xf8\x20\x02" + _coded_number(n)
    return head + bytes([crc8(head)])


def _zigzag(x: np.ndarray) -> np.ndarray:
    return np.where(x < 0, -2 * x - 1, 2 * x)


def _predictors(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each frame (row): quantised coefficients of order ORDER from its autocorrelation, and whether they fit 8 bits."""
    x = s.astype(np.float64)
    r = np.stack([np.einsum("ij,ij->i", x[:, : BLOCK - k], x[:, k:]) for k in range(ORDER + 1)], axis=1)
    lag = np.abs(np.subtract.outer(np.arange(ORDER), np.arange(ORDER)))
    matrix = r[:, lag] + np.eye(ORDER) * (r[:, :1, None] * 1e-9 + 1e-3)
    coefs = np.rint(np.linalg.solve(matrix, r[:, 1:, None])[:, :, 0] * (1 << SHIFT))
    fits = (np.abs(coefs) < 128).all(axis=1)
    return np.where(fits[:, None], coefs, 0).astype(np.int64), fits


def _residuals(s: np.ndarray, coefs: np.ndarray, shift: int) -> np.ndarray:
    order = coefs.shape[1]
    guess = np.zeros((len(s), BLOCK - order), dtype=np.int64)
    for i in range(order):
        guess += coefs[:, i : i + 1] * s[:, order - 1 - i : BLOCK - 1 - i]
    return s[:, order:] - (guess >> shift)


def _rice(residual: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parameter of each partition, and value and bits of each residual's code (the unary zeros in the bits only)."""
    v = _zigzag(residual)
    parts = 1 << PARTS
    padded = np.concatenate((np.zeros((len(v), order), dtype=np.int64), v), axis=1).reshape(len(v), parts, -1)
    mean = padded.sum(axis=2) / np.maximum(1, padded.shape[2] - np.where(np.arange(parts) == 0, order, 0))
    k = np.clip(np.ceil(np.log2(np.maximum(mean * np.log(2), 1e-9))), 0, 14).astype(np.int64)
    each = np.repeat(k, padded.shape[2], axis=1)[:, order:]
    return k, (1 << each) | (v & ((1 << each) - 1)), (v >> each) + 1 + each


def _write_bits(values: np.ndarray, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of values (below 2^16) in the given numbers of bits: all bytes, and the bytes of each row."""
    ends = np.cumsum(bits, axis=1)
    size = (ends[:, -1] + 7) >> 3
    base = np.cumsum(size) - size
    last = ends - 1
    at = (base[:, None] + (last >> 3) + 2).ravel()
    shifted = (values << (7 - (last & 7))).ravel()
    n = int(size.sum()) + 3
    out = sum(np.bincount(at - back, weights=shifted >> 8 * back & 0xFF, minlength=n)[:n] for back in range(3))
    return out[2 : n - 1].astype(np.uint8), size


def _encode_frames(s: np.ndarray) -> list[bytes]:
    """Subframes of the rows of s (signed samples)."""
    n = len(s)
    own, fits = _predictors(s)
    choices = [(order, np.tile(np.array(c, dtype=np.int64), (n, 1)) if order else np.zeros((n, 0), dtype=np.int64), 0) for order, c in enumerate(FIXED)]
    choices.append((ORDER, own, SHIFT))
    coded, cost = [], np.empty((len(choices) + 1, n))
    for i, (order, coefs, shift) in enumerate(choices):
        k, value, bits = _rice(_residuals(s, coefs, shift), order)
        coded.append((k, value, bits))
        cost[i] = bits.sum(axis=1) + 8 * order + (8 * ORDER + 9) * (i == len(FIXED))
    cost[len(FIXED)][~fits] = np.inf
    cost[-1] = 8 * BLOCK
    best = cost.argmin(axis=0)
    best[(s == s[:, :1]).all(axis=1)] = -1
    out: list[bytes] = [b""] * n
    for i, (order, coefs, _) in enumerate(choices):
        rows = np.flatnonzero(best == i)
        if not len(rows):
            continue
        k, value, bits = (x[rows] for x in coded[i])
        linear = i == len(FIXED)
        columns: list[tuple[np.ndarray | int, int]] = [((0x20 | (order - 1)) << 1 if linear else (0x08 | order) << 1, 8)]
        columns += [(s[rows, t] & 0xFF, 8) for t in range(order)]
        if linear:
            columns += [(7, 4), (SHIFT, 5), *((coefs[rows, t] & 0xFF, 8) for t in range(order))]
        columns.append((PARTS, 6))
        head_v = np.stack([np.broadcast_to(c, len(rows)) for c, _ in columns], axis=1)
        head_b = np.tile(np.array([b for _, b in columns]), (len(rows), 1))
        values, widths, at = [head_v], [head_b], 0
        for p in range(1 << PARTS):
            end = (p + 1) * (BLOCK >> PARTS) - order
            values += [k[:, p : p + 1], value[:, at:end]]
            widths += [np.full((len(rows), 1), 4), bits[:, at:end]]
            at = end
        data, size = _write_bits(np.concatenate(values, axis=1), np.concatenate(widths, axis=1))
        whole, ends = data.tobytes(), np.cumsum(size)
        for r, a, b in zip(rows.tolist(), (ends - size).tolist(), ends.tolist(), strict=True):
            out[r] = whole[a:b]
    for r in np.flatnonzero(best == len(choices)).tolist():
        out[r] = b"\x02" + s[r].astype(np.int8).tobytes()
    for r in np.flatnonzero(best == -1).tolist():
        out[r] = b"\x00" + s[r, :1].astype(np.int8).tobytes()
    return out


def _samples(payload: bytes) -> np.ndarray:
    return (np.frombuffer(payload, dtype=np.uint8) - np.uint8(LEVEL)).view(np.int8)


def _frames(samples: np.ndarray, numbers: np.ndarray) -> Iterator[bytes]:
    """Whole frames of the rows of samples, some at a time."""
    for at in range(0, len(samples), ENCODE_FRAMES):
        part = samples[at : at + ENCODE_FRAMES].astype(np.int64)
        bodies = [frame_header(i) + body for i, body in zip(numbers[at : at + ENCODE_FRAMES].tolist(), _encode_frames(part), strict=True)]
        ends = np.cumsum([len(b) for b in bodies])
        crcs = crc16(np.frombuffer(b"".join(bodies), dtype=np.uint8), np.concatenate(([0], ends[:-1])), ends)
        yield from (b + struct.pack(">H", crc) for b, crc in zip(bodies, crcs.tolist(), strict=True))


def encode(payloads: list[bytes]) -> list[bytes]:
    """A FLAC stream of each payload (a positive multiple of 576 bytes): samples are the bytes less LEVEL.

    The seek table has a point for every frame, so any sample offset leads to its frame's bytes. What is coded at
    once is bounded by ENCODE_FRAMES, however long a payload is.
    """
    counts = [len(p) // BLOCK for p in payloads]
    numbers = np.concatenate([np.arange(c) for c in counts]) if counts else np.empty(0, dtype=np.int64)
    coded = _frames(_samples(b"".join(payloads)).reshape(-1, BLOCK), numbers)
    out = []
    for payload, c in zip(payloads, counts, strict=True):
        frames = [*islice(coded, c)]
        sizes = [len(f) for f in frames]
        info = struct.pack(">HH", BLOCK, BLOCK) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big")
        info += (44100 << 44 | 7 << 36 | len(payload)).to_bytes(8, "big") + hashlib.md5(_samples(payload).tobytes()).digest()
        starts = np.cumsum([0, *sizes[:-1]])
        points = [struct.pack(">QQH", i * BLOCK, o, BLOCK) for i, o in enumerate(starts.tolist())]
        # A metadata block holds at most 2^24 - 1 bytes; a longer seek table is cut into several.
        tables = [b"".join(points[at : at + SEEK_POINTS]) for at in range(0, len(points), SEEK_POINTS)]
        heads = [bytes([3 | 128 * (i == len(tables) - 1)]) + len(t).to_bytes(3, "big") for i, t in enumerate(tables)]
        out.append(b"fLaC" + b"\x00" + len(info).to_bytes(3, "big") + info + b"".join(h + t for h, t in zip(heads, tables, strict=True)) + b"".join(frames))
    return out


class Bits:
    """Bit positions in one buffer, one for each frame, read side by side."""

    def __init__(self, data: bytes, starts: np.ndarray) -> None:
        self.data = data + bytes(16)
        self.words = np.ndarray((len(data) + 8,), dtype=">u8", buffer=self.data, strides=(1,))
        self.at = starts.astype(np.int64) * 8

    def peek(self, rows: np.ndarray | slice) -> np.ndarray:
        """The next 57 bits at least, at the top of a word."""
        at = self.at[rows]
        return self.words[np.minimum(at >> 3, len(self.words) - 1)].astype(np.uint64) << (at & 7).astype(np.uint64)

    def take(self, n: int, rows: np.ndarray | slice) -> np.ndarray:
        out = (self.peek(rows) >> np.uint64(64 - n)).astype(np.int64)
        self.at[rows] += n
        return out

    def signed(self, n: int, rows: np.ndarray | slice) -> np.ndarray:
        x = self.take(n, rows)
        return x - ((x >> n - 1 & 1) << n)

    def rice(self, k: np.ndarray, rows: np.ndarray | slice) -> np.ndarray:
        w = self.peek(rows)
        top = w >> np.uint64(11)
        zeros = 53 - np.frexp(top.astype(np.float64))[1].astype(np.int64)
        far = np.flatnonzero((top == 0) | (zeros + 1 + k > 57))
        if len(far):  # a long unary part: count its zeros word by word
            more = np.zeros(len(w), dtype=np.int64)
            where = np.arange(len(self.at))[rows]
            while len(far):
                if (self.at[where[far]] > 8 * len(self.data)).any():
                    raise ValueError("a residual runs past the stream's end")
                word = self.peek(where[far]) >> np.uint64(11)
                run = np.where(word == 0, 48, np.minimum(48, 53 - np.frexp(word.astype(np.float64))[1].astype(np.int64)))
                self.at[where[far]] += run
                more[far] += run
                far = far[run == 48]
            w = self.peek(rows)
            zeros = 53 - np.frexp((w >> np.uint64(11)).astype(np.float64))[1].astype(np.int64)
        else:
            more = 0
        low = (w << (zeros + 1).astype(np.uint64)) >> (63 - k).astype(np.uint64) >> np.uint64(1)
        self.at[rows] += zeros + 1 + k
        v = (zeros + more) << k | low.astype(np.int64)
        return v >> 1 ^ -(v & 1)


def _headers(data: bytes, starts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Block size, frame or sample number and first byte of the subframe of each frame; the header's CRC is checked."""
    sizes, numbers, subs = [], [], []
    for at in starts:
        if data[at] != 0xFF or data[at + 1] & 0xFE != 0xF8 or data[at + 3] & 0xF0 or (data[at + 3] >> 1 & 7) not in (0, 1):
            raise ValueError("not a frame of a mono 8-bit stream")
        code, rate, pos = data[at + 2] >> 4, data[at + 2] & 15, at + 4
        lead = data[pos]
        more = 0 if lead < 0x80 else 7 - (lead ^ 0xFF).bit_length()
        number = lead if lead < 0x80 else lead & (0x3F >> more)
        for i in range(1, more + 1):
            number = number << 6 | data[pos + i] & 0x3F
        pos += more + 1
        if code in (6, 7):
            size = int.from_bytes(data[pos : pos + code - 5], "big") + 1
            pos += code - 5
        else:
            size = BLOCK_CODES[code] if code < 8 else 256 << code - 8
        pos += {12: 1, 13: 2, 14: 2}.get(rate, 0)
        if crc8(data[at:pos]) != data[pos]:
            raise ValueError("frame header fails its CRC-8")
        sizes.append(size)
        numbers.append(number)
        subs.append(pos + 1)
    return np.array(sizes), np.array(numbers), np.array(subs)


def _predicted(bits: Bits, samples: np.ndarray, rows: np.ndarray, kinds: np.ndarray) -> None:
    """Decode the rows whose subframes are predicted, sample by sample for all of them."""
    size = samples.shape[1]
    linear = kinds >= 32
    order = np.where(linear, kinds - 31, kinds - 8)
    most = int(order.max())
    coefs, shift = np.zeros((most, len(rows)), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
    for t in range(most):
        warm = np.flatnonzero(order > t)
        samples[rows[warm], t] = bits.signed(8, rows[warm])
    own = np.flatnonzero(linear)
    if len(own):
        width = bits.take(4, rows[own]) + 1
        shift[own] = bits.signed(5, rows[own])
        for w in np.unique(width).tolist():
            for t in range(most):
                part = own[(width == w) & (order[own] > t)]
                coefs[t, part] = bits.signed(w, rows[part])
    for o in range(1, 5):
        part = np.flatnonzero(~linear & (order == o))
        if len(part):
            coefs[:o, part] = np.array(FIXED[o])[:, None]
    if bits.take(2, rows).any():
        raise ValueError("residuals with 5-bit parameters aren't supported")
    span = size >> bits.take(4, rows)
    k, raw = np.zeros(len(rows), dtype=np.int64), np.full(len(rows), -1)
    spans = np.unique(span).tolist()
    done = np.zeros((size, len(rows)), dtype=np.int64)
    for t in range(most):
        done[t] = samples[rows, t]
    all_rows: np.ndarray = rows
    for t in range(size):
        live = slice(None) if t >= most else np.flatnonzero(order <= t)
        here = all_rows[live]
        if t <= most or any(t % x == 0 for x in spans):
            new = np.flatnonzero((order == t) | (order < t) & (t % span == 0))
            if len(new):
                k[new] = bits.take(4, rows[new])
                escaped = new[k[new] == 15]
                raw[new] = -1
                raw[escaped] = bits.take(5, rows[escaped])
        if (raw >= 0).any():
            part = np.arange(len(rows))[live]
            residual = np.zeros(len(rows), dtype=np.int64)
            plain = part[raw[part] < 0]
            residual[plain] = bits.rice(k[plain], rows[plain])
            for w in np.unique(raw[part]).tolist():
                if w > 0:
                    held = part[raw[part] == w]
                    residual[held] = bits.signed(w, rows[held])
            residual = residual[live]
        else:
            residual = bits.rice(k[live], here)
        guess = np.zeros(len(here), dtype=np.int64)
        for i in range(min(t, most)):
            guess += coefs[i, live] * done[t - 1 - i, live]
        done[t, live] = residual + (guess >> shift[live])
    samples[rows] = done.T


def decode_frames(data: bytes, starts: list[int]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Signed samples and number of each frame, and where each ends; raises ValueError if a checksum fails."""
    sizes, numbers, subs = _headers(data, starts)
    out: list[np.ndarray] = [np.empty(0)] * len(starts)
    bits = Bits(data, subs)
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        head = bits.take(8, rows)
        kinds = head >> 1 & 63
        if (head & 1).any() or not ((kinds < 2) | (kinds >= 32) | (kinds >= 8) & (kinds <= 12)).all():
            raise ValueError("wasted bits or a reserved subframe")
        samples = np.zeros((len(starts), size), dtype=np.int64)
        same = rows[kinds == 0]
        samples[same] = bits.signed(8, same)[:, None]
        for t in range(size) if (kinds == 1).any() else ():
            samples[rows[kinds == 1], t] = bits.signed(8, rows[kinds == 1])
        if (kinds >= 8).any():
            _predicted(bits, samples, rows[kinds >= 8], kinds[kinds >= 8])
        for r in rows.tolist():
            out[r] = samples[r]
    ends = (bits.at + 7) >> 3
    whole = np.frombuffer(bits.data, dtype=np.uint8)
    wanted = whole[ends].astype(np.uint16) << 8 | whole[ends + 1]
    if (crc16(whole, np.array(starts), ends) != wanted).any():
        raise ValueError("frame fails its CRC-16")
    return out, numbers, ends + 2


def decode(streams: list[bytes]) -> list[tuple[bytes, list[int]]]:
    """PCM bytes of each stream (samples plus LEVEL) and the sample offset of each of its blocks.

    Where the seek table has a point for every frame, DECODE_FRAMES are decoded at once; else one frame of every
    stream at a time, each starting where the last ended. Header CRC-8, frame CRC-16 and MD5 are verified.
    """
    data, base = b"".join(streams), np.cumsum([0, *(len(s) for s in streams)])
    infos, waiting = [], []
    for i, s in enumerate(streams):
        if s[:4] != b"fLaC":
            raise ValueError("not a FLAC stream")
        at, points, info = 4, b"", b""
        while True:
            kind, size = s[at], int.from_bytes(s[at + 1 : at + 4], "big")
            body = s[at + 4 : at + 4 + size]
            info, points = (body, points) if kind & 127 == 0 else (info, points + body) if kind & 127 == 3 else (info, points)
            at += 4 + size
            if kind & 128:
                break
        total = int.from_bytes(info[10:18], "big") & (1 << 36) - 1
        listed = sorted(p for p in struct.iter_unpack(">QQH", points) if p[0] != (1 << 64) - 1)
        full = sum(p[2] for p in listed) == total
        infos.append((total, info[18:34]))
        waiting += [(i, int(base[i]) + at + p[1]) for p in listed] if full else [(i, int(base[i]) + at)]
    blocks: list[list[np.ndarray]] = [[] for _ in streams]
    got = [0] * len(streams)
    while waiting:
        last = {}
        for at in range(0, len(waiting), DECODE_FRAMES):
            part = waiting[at : at + DECODE_FRAMES]
            low = part[0][1]
            high = waiting[at + DECODE_FRAMES][1] if at + DECODE_FRAMES < len(waiting) else len(data)
            samples, _, ends = decode_frames(data[low:high], [a - low for _, a in part])
            for (i, _), x, e in zip(part, samples, ends.tolist(), strict=True):
                blocks[i].append(x.astype(np.int8))
                got[i] += len(x)
                last[i] = low + e
        waiting = [(i, e) for i, e in last.items() if got[i] < infos[i][0]]
    out = []
    for own, (_, md5) in zip(blocks, infos, strict=True):
        signed = np.concatenate(own)
        if hashlib.md5(signed.tobytes()).digest() != md5:
            raise ValueError("samples fail the stream's MD5")
        out.append(((signed.view(np.uint8) + np.uint8(LEVEL)).tobytes(), np.cumsum([0, *(len(x) for x in own[:-1])]).tolist()))
    return out


def padded(text: bytes) -> bytes:
    return text + b"\xff" * (BLOCK - len(text) % BLOCK if len(text) % BLOCK or not text else 0)


def _feature(pcm: bytes) -> str:
    energy = crossings = peak = 0
    for at in range(0, len(pcm), 1 << 20):  # each part begins with the last byte of the one before
        x = np.frombuffer(pcm[max(0, at - 1) : at + (1 << 20)], dtype=np.uint8).astype(np.int32) - 128
        signs, own = x >= 0, x[1 if at else 0 :]
        crossings += int((signs[1:] != signs[:-1]).sum())
        energy, peak = energy + int((own * own).sum(dtype=np.int64)), max(peak, int(np.abs(own).max()))
    return f"energy={energy};crossings={crossings};peak={peak}"


def _by_size(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """Slices of a binary column of about CHUNK bytes each (a longer value is one by itself), and where they start."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(column):
        stop, held = at + 1, int(sizes[at])
        while stop < len(column) and held + sizes[stop] <= CHUNK:
            held += int(sizes[stop])
            stop += 1
        yield at, column.slice(at, stop - at).to_pylist()
        at = stop


def to_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text's UTF-8 as a FLAC stream, padded with 255 to a positive multiple of 576.

    A null text counts as empty. Rows stay as they are, repeated ones included; other columns are left out, whatever
    their names. An empty table gives none. Memory is bounded by the longest text, which is coded in slabs of frames.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _by_size(b.column("text").cast(pa.large_binary())):
                sizes = pa.array([len(t) for t in part], pa.int64())
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), sizes, pa.array(encode([padded(t) for t in part]), pa.binary())], ["doc_id", "n_bytes", "media"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("n_bytes"), F.lit(b"").alias("media")).schema)


def from_media(stored: DataFrame) -> DataFrame:
    """stored(media, ...): adds pcm (all blocks), block_offsets (each block's first sample) and feature, and drops media.

    Other columns stay. A damaged stream raises an error.
    """
    rest = [c for c in stored.columns if c != "media"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, part in _by_size(b.column("media")):
                done = decode(part)
                columns = [b.column(c).slice(at, len(part)) for c in rest]
                columns += [pa.array([p for p, _ in done], pa.binary()), pa.array([o for _, o in done], pa.list_(pa.int64())), pa.array([_feature(p) for p, _ in done])]
                yield pa.RecordBatch.from_arrays(columns, [*rest, "pcm", "block_offsets", "feature"])

    schema = stored.select(*rest, F.lit(b"").alias("pcm"), F.expr("cast(array() as array<long>)").alias("block_offsets"), F.lit("").alias("feature")).schema
    return stored.select(*rest, "media").mapInArrow(run, schema)
