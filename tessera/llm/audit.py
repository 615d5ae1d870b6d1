"""Filter interaction audit: packed bitmaps of filters, labels and parts; AND-NOT and popcount for every set of filters that may run before."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.storage import cut, small_side

#: Rows behind one row of the bitmap index.
CHUNK = 8192
#: Parts whose counts a task holds before it hands them on.
HELD_PARTS = 4096


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, A, B, C, D, E, good, toxic) of every row of docs: which filters its whole text fails, and its labels.

    Null texts and languages count as empty. E, a smaller doc_id has the same text, takes null ids as the largest; rows that
    share doc_id and text don't fail it by each other. Texts meet as SHA-256 digests, summed before they are shuffled,
    and only digests of several rows come back, so a large group of copies is spread as its rows are. A document is good or
    toxic if any of its rows in labels says so; labels of no document and null labels count for nothing.
    Other columns of either table are left out, and an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    rows = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text")).withColumn("words", words)
    n = F.size("words")
    capitals = F.length("text") - F.length(F.regexp_replace("text", "[A-Z]+", ""))
    rows = rows.select(
        "doc_id",
        "part",
        (n < 200).alias("A"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 50 * n.cast("long")).alias("B"),
        (100 * capitals.cast("long") > 3 * F.length("text").cast("long")).alias("C"),
        F.col("text").rlike("[#$%&*|]").alias("D"),
        F.unhex(F.sha2("text", 256)).alias("digest"),
    )
    rows = cut(rows, "filtered")
    firsts = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").drop("n"), "firsts")
    yes = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False)))
    marks = cut(labels.where("doc_id is not null").groupBy("doc_id").agg(yes("quality").alias("good"), yes("toxic").alias("toxic")).where("good or toxic"), "marks")
    met = rows.join(small_side(firsts, 64), "digest", "left").join(small_side(marks, 24), "doc_id", "left")
    again = F.col("first").isNotNull() & (F.col("doc_id").isNull() | (F.col("doc_id") > F.col("first")))
    return met.select("part", *"ABCD", again.alias("E"), *(F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")))


def bitmap_index(rows: DataFrame, filters: list[str], labels: list[str]) -> DataFrame:
    """(n, filters array<binary>, labels array<binary>, parts array<struct<part, bits>>) of up to CHUNK rows each.

    Bit k of a map, first bit highest, is that of the chunk's row k. rows has part and boolean columns named by filters
    and labels; null is false.
    """

    def packed(column: pa.Array) -> bytes:
        return np.packbits(column.fill_null(False).to_numpy(zero_copy_only=False)).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, CHUNK):
                b = whole.slice(at, CHUNK)
                names = b.column("part").dictionary_encode()
                codes = names.indices.to_numpy(zero_copy_only=False)
                parts = [{"part": name, "bits": np.packbits(codes == k).tobytes()} for k, name in enumerate(names.dictionary.to_pylist())]
                row = {"n": b.num_rows, "filters": [packed(b.column(c)) for c in filters], "labels": [packed(b.column(c)) for c in labels], "parts": parts}
                yield pa.RecordBatch.from_pylist([row], schema)

    bits = pa.list_(pa.binary())
    schema = pa.schema([("n", pa.int64()), ("filters", bits), ("labels", bits), ("parts", pa.list_(pa.struct([("part", pa.string()), ("bits", pa.binary())])))])
    chosen = rows.select(F.coalesce("part", F.lit("")).alias("part"), *filters, *labels)
    return chosen.mapInArrow(run, "n long, filters array<binary>, labels array<binary>, parts array<struct<part: string, bits: binary>>")


def counts_of(filters: np.ndarray, labels: np.ndarray, part: np.ndarray) -> np.ndarray:
    """counts[set, 0] of a part's rows that fail no filter of the set, counts[set, 1 + k] of those with label k too.

    Filter k is bit k of a set's number; the maps are packed rows of the same length.
    """
    failing = np.zeros((1 << len(filters), filters.shape[1]), dtype=np.uint8)
    for s in range(1, len(failing)):
        low = (s & -s).bit_length() - 1
        failing[s] = failing[s & (s - 1)] | filters[low]
    left = part & ~failing
    return np.stack([np.bitwise_count(m).sum(1, dtype=np.int64) for m in (left, *(left & x for x in labels))], 1)


def prefix_counts(index: DataFrame) -> DataFrame:
    """(part, before, counts array<long>) of every set of filters, by number: rows of the part that it leaves, then those with each label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            columns = [[p for p, c in held.items() for _ in c], [s for c in held.values() for s in range(len(c))], [row.tolist() for c in held.values() for row in c]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.list_(pa.int64()))], ["part", "before", "counts"])

        for b in batches:
            for row in b.to_pylist():
                size = (row["n"] + 7) // 8
                maps = [np.frombuffer(b"".join(row[c]), np.uint8).reshape(-1, size) for c in ("filters", "labels")]
                for p in row["parts"]:
                    found = counts_of(*maps, np.frombuffer(p["bits"], np.uint8))
                    held[p["part"]] = held[p["part"]] + found if p["part"] in held else found
                if len(held) >= HELD_PARTS:
                    yield out()
        if held:
            yield out()

    return index.mapInArrow(run, "part string, before int, counts array<long>")


def interactions(counts: DataFrame, filters: str, labels: list[str]) -> DataFrame:
    """A row for every part, order of the filters and step, from prefix_counts() with one letter for each filter.

    Columns part, filter_order, step, kept, removed, redundant, unique_fails, a <label>_lost for each label, and shapley:
    what the step's filter removes, summed over all orders.
    """
    width = 1 + len(labels)
    sums = counts.groupBy("part", "before").agg(*[F.sum(F.col("counts")[k]).alias(f"c{k}") for k in range(width)])
    one = sums.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("before", *[f"c{k}" for k in range(width)]))).alias("sets"))  # as many as sets of filters
    every = (1 << len(filters)) - 1
    steps = []
    for order in permutations(filters):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << filters.index(name)
            steps.append({"filter_order": "".join(order), "step": step, "name": name, "own": own, "before": before, "others": every ^ own})
            before |= own
    plan = F.from_json(F.lit(json.dumps(steps)), "array<struct<filter_order:string,step:int,name:string,own:int,before:int,others:int>>")
    rows = one.select("part", "sets", F.explode(plan).alias("s")).select("part", "sets", "s.*")

    def left(number: Column, k: int = 0) -> Column:
        return F.get("sets", number)[f"c{k}"]

    own, before = F.col("own"), F.col("before")
    after = before + own
    gone = left(before) - left(after)
    out = rows.select(
        "part",
        "filter_order",
        "step",
        "name",
        left(after).alias("kept"),
        gone.alias("removed"),
        (left(F.lit(0)) - left(own) - gone).alias("redundant"),
        (left(F.col("others")) - left(F.lit(every))).alias("unique_fails"),
        *((left(before, k) - left(after, k)).alias(f"{label}_lost") for k, label in enumerate(labels, 1)),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "name"))).drop("name")  # a row for each order


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """interactions() of the filters A to E over all documents; see failures() for nulls, ties and repeated rows."""
    marks = ["good", "toxic"]
    index = bitmap_index(failures(docs, labels), list("ABCDE"), marks)
    return interactions(prefix_counts(cut(index, "bitmaps")), "ABCDE", marks)
