"""Token files: concatenated ids with Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm.packing import in_doc_order, part_starts
from tessera.llm.tokens import chunks, plain_texts
from tessera.storage import cut

MAGIC, HEAD = b"EFTK", "<QQqII"
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 20
#: Ids of documents in a segment lie within so much of each other, so that differences fit 64 bits.
SPAN = 1 << 62
#: One position is stored for so many documents, from which select() counts on.
SAMPLE = 64
#: For each byte the places of its ones, the lowest first.
PLACES = np.argsort(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little") == 0, axis=1, kind="stable")


class EliasFano:
    """Non-decreasing integers in [0, universe) in about 2 + log2(universe / n) bits each.

    The low bits are stored as they are; the high bits in unary, as ones in a bit vector. select(i) finds the
    i-th one from the nearest sampled position and puts the low bits behind it.
    """

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> EliasFano:
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        low = (values[:, None] >> np.arange(low_bits)) & 1 if low_bits else np.zeros((n, 0), dtype=np.int64)
        ones = (values >> low_bits) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, dtype=np.uint8)
        high[ones] = 1
        return cls(n, low_bits, np.packbits(low.astype(np.uint8).ravel(), bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        return struct.pack("<IBIII", self.n, self.low_bits, len(self.low), len(self.high), len(self.samples)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: memoryview) -> EliasFano:
        n, low_bits, a, b, c = struct.unpack_from("<IBIII", data)
        at = struct.calcsize("<IBIII")
        whole = np.frombuffer(data, dtype=np.uint8, offset=at)
        return cls(n, low_bits, whole[:a], whole[a : a + b], whole[a + b : a + b + 4 * c].view("<u4"))

    def _low(self, i: np.ndarray) -> np.ndarray:
        bit = i[:, None] * self.low_bits + np.arange(self.low_bits)
        return (((self.low[bit >> 3] >> (bit & 7)) & 1).astype(np.int64) << np.arange(self.low_bits)).sum(axis=1)

    def select(self, i: int) -> int:
        """The i-th value, reading a few bytes after the sample before it."""
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        one = 8 * byte + (word & -word).bit_length() - 1
        return (one - i) << self.low_bits | int(self._low(np.array([i]))[0])

    def selects(self, i: np.ndarray) -> np.ndarray:
        """select() of many numbers: their bytes by the ones up to each byte, their places in these by a table."""
        upto = np.cumsum(np.bitwise_count(self.high), dtype=np.int64)
        byte = np.searchsorted(upto, i, side="right")
        one = 8 * byte + PLACES[self.high[byte], i - upto[byte] + np.bitwise_count(self.high[byte])]
        return (one - i) << self.low_bits | self._low(i)

    def values(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        i = np.arange(self.n)
        return (ones - i) << self.low_bits | self._low(i)


def write_segment(ids: list[bytes], names: list[int | None]) -> bytes:
    """One segment: magic, number of ids, null names, first name, sizes; names less the first, each document's end, the ids as 16 bits.

    names ascend, nulls first. Names and ends are Elias-Fano encoded, so that nothing holds 64 bits for each document.
    """
    known = np.array([n for n in names if n is not None], dtype=np.int64)
    first = int(known[0]) if len(known) else 0
    coded = EliasFano.of(known - first, int(known[-1]) - first + 1).to_bytes() if len(known) else b""
    ends = np.cumsum([len(x) // 2 for x in ids])
    marks = EliasFano.of(ends, int(ends[-1]) + 1).to_bytes()
    body = b"".join(ids)
    return MAGIC + struct.pack(HEAD, len(body) // 2, len(names) - len(known), first, len(coded), len(marks)) + coded + marks + body


class Segment:
    """A segment's documents by number, without decoding the rest."""

    def __init__(self, data: memoryview) -> None:
        if bytes(data[:4]) != MAGIC:
            raise ValueError("not a token segment")
        n, self.nulls, self.first, coded, marks = struct.unpack_from(HEAD, data, 4)
        at = 4 + struct.calcsize(HEAD)
        self.names = EliasFano.from_bytes(data[at : at + coded]) if coded else None
        self.ends = EliasFano.from_bytes(data[at + coded : at + coded + marks])
        self.ids = np.frombuffer(data, dtype="<u2", offset=at + coded + marks, count=n)

    def name(self, i: int) -> int | None:
        """The doc_id of document i."""
        return None if i < self.nulls else self.first + self.names.select(i - self.nulls)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.select(i - 1) if i else 0 : self.ends.select(i)]


def write_token_files(docs: DataFrame, path: str, end_id: int = 1) -> DataFrame:
    """Token segments of all documents in ascending doc_id (null first; ties by text), as a table of the shared folder.

    A row is a segment: part, number, at (the part's ids before), n, data, which holds the doc_ids too. A segment closes after
    SEGMENT_IDS ids, so no row grows with the corpus. Spark's writer commits the rows, so that a lost executor
    leaves no half file, and any file system that Spark reads will do. A null text counts as empty: its end id only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = plain_texts(path), np.array([end_id], dtype="<u2").tobytes()
        part, number, at = TaskContext.get().partitionId(), 0, 0
        held: list[bytes] = []
        names: list[int | None] = []
        least: int | None = None
        size = 0

        def close() -> pa.RecordBatch:
            columns = [[part], [number], [at], [size], [write_segment(held, names)]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "number", "at", "n", "data"])

        for b in batches:
            for first, texts in chunks(b.column("text")):
                own = b.column("doc_id").slice(first, len(texts)).to_pylist()
                for name, ids in zip(own, encoder.texts(texts), strict=True):
                    if held and (size >= SEGMENT_IDS or (name is not None and least is not None and name - least >= SPAN)):
                        yield close()
                        number, at, size, held, names, least = number + 1, at + size, 0, [], [], None
                    held.append(ids + end)
                    names.append(name)
                    least = name if least is None else least
                    size += len(ids) // 2 + 1
        if held:
            yield close()

    rows = in_doc_order(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInArrow(run, "part long, number long, at long, n long, data binary"), "token-files")


def read_documents(segments: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, found in the stored segments by selects()."""
    bases = part_starts(segments.select("part", "n"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                segment = Segment(memoryview(b.column("data")[i].as_buffer()))
                ends = segment.ends.selects(np.arange(segment.ends.n))
                starts = np.concatenate(([0], ends[:-1]))
                wide = segment.ids.astype("<u4")
                crcs = [zlib.crc32(wide[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                offset = b.column("at")[i].as_py() + b.column("base")[i].as_py()
                names = pa.array([None] * segment.nulls, pa.int64())
                if segment.names:
                    names = pa.concat_arrays([names, pa.array(segment.first + segment.names.selects(np.arange(segment.names.n)))])
                yield pa.RecordBatch.from_arrays([names, pa.array(starts + offset), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    rows = segments.join(F.broadcast(bases), "part").select("at", "base", "data")
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
