"""Packing: concatenate and cut, with global offsets from two-pass prefix sums over partition totals."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from tessera.llm.tokens import byte_texts, chunks, releasing
from tessera.storage import cut


def in_doc_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text) dealt by ranges of doc_id and sorted, null ids first; nulls of text are empty."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")


def part_starts(rows: DataFrame) -> DataFrame:
    """rows(part, n): (part, base), the sum of n over all earlier parts. One row for each partition only."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return totals.select("part", F.coalesce(before, F.lit(0)).cast("long").alias("base"))


def token_table(docs: DataFrame, path: str, end_id: int = 0) -> DataFrame:
    """(part, at, doc_id, n, ids) in the order of doc_id; at counts the partition's ids before. Pass one.

    ids are little-endian 16 bits, with end_id after each document. Written to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = byte_texts(path), np.array([end_id], dtype="<u2").tobytes()
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            for first, texts in chunks(b.column("text")):
                ids = [x + end for x in encoder.texts(texts)]
                n = np.array([len(x) // 2 for x in ids], dtype=np.int64)
                starts = at + np.cumsum(n) - n
                at += int(n.sum())
                columns = [pa.array(np.full(len(n), part)), pa.array(starts), b.column("doc_id").slice(first, len(n)), pa.array(n), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["part", "at", "doc_id", "n", "ids"])

    rows = in_doc_order(docs)
    zero = F.lit(0).cast("long")
    schema = rows.select(zero.alias("part"), zero.alias("at"), "doc_id", zero.alias("n"), F.lit(b"").alias("ids")).schema
    return cut(rows.mapInArrow(releasing(run), schema), "tokens")


def _crc(ids: pa.Buffer | bytes) -> int:
    """CRC-32 of 16-bit ids as little-endian 32 bits."""
    return zlib.crc32(np.frombuffer(ids, dtype="<u2").astype("<u4"))


def pack(docs: DataFrame, path: str, length: int = 1024, end_id: int = 0, crc: bool = False) -> DataFrame:
    """Pieces of all documents in windows of `length` ids: doc_id, start, length, doc_tokens, sequence_id, offset, ids.

    With crc, ids_crc32 as well, as by with_crc() but in the same pass.

    Documents follow each other in the order of doc_id (null first; ties by text) and windows are cut without
    regard to their borders, so only the last one can be short. start counts the document's ids before the
    piece, offset the window's. A null text counts as empty and has its end id only.
    """
    table = token_table(docs, path, end_id)
    based = table.join(F.broadcast(part_starts(table.select("part", "n"))), "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            first = b.column("at").to_numpy() + b.column("base").to_numpy()
            n = b.column("n").to_numpy()
            pieces = (first + n - 1) // length - first // length + 1
            row = np.repeat(np.arange(len(n)), pieces)
            nth = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            window = first[row] // length + nth
            begin = np.maximum(first[row], window * length)
            stop = np.minimum((first + n)[row], (window + 1) * length)
            start = begin - first[row]
            held = b.column("ids")
            ids = [held[r].as_buffer()[2 * s : 2 * e].to_pybytes() for r, s, e in zip(row.tolist(), start.tolist(), (stop - first[row]).tolist(), strict=True)]
            columns = [b.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(stop - begin), pa.array(n[row]), pa.array(window), pa.array(begin - window * length), pa.array(ids, pa.binary())]
            if crc:
                columns.append(pa.array([_crc(x) for x in ids], pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    zero = F.lit(0).cast("long")
    names = ("start", "length", "doc_tokens", "sequence_id", "offset")
    schema = based.select("doc_id", *(zero.alias(x) for x in names), "ids", *[zero.alias("ids_crc32")] * crc).schema
    return based.select("doc_id", "at", "base", "n", "ids").mapInArrow(releasing(run), schema)


def with_crc(pieces: DataFrame, keep_ids: bool = False) -> DataFrame:
    """pieces with ids_crc32, over the ids as little-endian 32 bits, in place of the ids or beside them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            crcs = [_crc(x.as_buffer()) for x in b.column("ids")]
            kept = b.schema.names if keep_ids else b.schema.names[:-1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(crcs, pa.int64())], [*kept, "ids_crc32"])

    rest = [c for c in pieces.columns if c != "ids"]
    rows = pieces.select(*rest, "ids")
    return rows.mapInArrow(run, rows.select(*rest, *["ids"] * keep_ids, F.lit(0).cast("long").alias("ids_crc32")).schema)


def sequences(pieces: DataFrame, length: int = 1024, pad_id: int = 0) -> DataFrame:
    """(sequence_id, ids array<int>): whole windows, padded to `length` unless their size is a power of two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for parts in b.column("parts"):
                ids = np.frombuffer(b"".join(p["ids"].as_py() for p in parts), dtype="<u2").astype(np.int32)
                short = length - len(ids) if len(ids) & (len(ids) - 1) else 0
                out.append(np.concatenate((ids, np.full(short, pad_id, dtype=np.int32))))
            yield pa.RecordBatch.from_arrays([b.column("sequence_id"), pa.array(out, pa.list_(pa.int32()))], ["sequence_id", "ids"])

    whole = pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return whole.mapInArrow(run, "sequence_id long, ids array<int>")
