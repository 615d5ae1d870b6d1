"""Ranked lexical search as a blocked sparse product: item-term multiplicities times term-document impacts in 64-bit integers."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from tessera.llm.tokens import chunks
from tessera.storage import cut

#: Letters and digits of ASCII, A-Z lower-cased, and all bytes beyond ASCII make terms; other bytes part them.
TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if c > 0x7F or chr(c).isalnum() else 0x20 for c in range(256))
#: Documents of a block, and postings after which a block ends early.
BLOCK, BLOCK_POSTINGS = 4096, 1 << 21
#: Bytes of item texts whose terms one pass over the documents looks for. More items take further passes.
ITEM_BYTES = 2 << 20
#: Groups into which the candidates of one item are dealt before the last ranking.
SALTS = 64


def terms(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(TABLE).split()


def term_blocks(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """Blocks of the term-document matrix, with term frequencies, for the terms of a sorted vocabulary.

    A row has doc_ids and lengths (terms with repeats) of up to BLOCK documents, documents with a term (n_docs) and all
    their terms (n_terms), and postings by term: terms (numbers in the vocabulary, ascending), df, and as little-endian
    arrays rows (16 bits, numbers in the block) and tf (32 bits).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: k for k, t in enumerate(vocabulary)}
        ids: list[pa.Array] = []
        lengths: list[int] = []
        rows: list[int] = []
        found: list[int] = []
        tf: list[int] = []

        def out() -> pa.RecordBatch:
            term, row, times = np.array(found, np.int32), np.array(rows, "<u2"), np.array(tf, "<u4")
            order = np.argsort(term, kind="stable")
            distinct, df = np.unique(term, return_counts=True)
            values = [pa.concat_arrays(ids), pa.array(lengths, pa.int64()), pa.array(distinct, pa.int32()), pa.array(df, pa.int64())]
            columns = [pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values]
            columns += [pa.array([np.count_nonzero(lengths)], pa.int64()), pa.array([sum(lengths)], pa.int64())]
            columns += [pa.array([x[order].tobytes()], pa.binary()) for x in (row, times)]
            for x in (ids, lengths, rows, found, tf):
                x.clear()
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "lengths", "terms", "df", "n_docs", "n_terms", "rows", "tf"])

        for b in batches:
            for first, texts in chunks(b.column("text")):
                for at, text in enumerate(texts, first):
                    words = terms(text)
                    own = Counter(words)
                    held = own.keys() & number.keys()
                    ids.append(b.column("doc_id").slice(at, 1))
                    found += [number[t] for t in held]
                    tf += [own[t] for t in held]
                    rows += [len(lengths)] * len(held)
                    lengths.append(len(words))
                    if len(lengths) == BLOCK or len(rows) >= BLOCK_POSTINGS:
                        yield out()
        if lengths:
            yield out()

    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    none = F.array().cast("array<long>")
    zero = F.lit(0).cast("long")
    schema = texts.select(F.array("doc_id").alias("doc_ids"), none.alias("lengths"), none.cast("array<int>").alias("terms"), none.alias("df"), zero.alias("n_docs"), zero.alias("n_terms"), F.lit(b"").alias("rows"), F.lit(b"").alias("tf")).schema
    return texts.mapInArrow(run, schema)


class Best:
    """The k best scores of each item so far; later candidates below the last of them can't rank."""

    def __init__(self, items: int, k: int) -> None:
        self.scores = np.zeros((items, k), dtype=np.int64)

    def chosen(self, item: int, scores: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Up to k positions of scores over 0 that may rank, by score and then by place."""
        held, k = self.scores[item], self.scores.shape[1]
        at = np.flatnonzero(scores >= max(1, held[0]))
        if len(at) > k:
            at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
        at = at[np.lexsort((place[at], -scores[at]))][:k]
        if len(at):
            self.scores[item] = np.sort(np.concatenate([held, scores[at]]))[-k:]
        return at


def multiply(blocks: DataFrame, items: list[list[tuple[int, int]]], weights: np.ndarray, n: int, total: int, k: int) -> DataFrame:
    """(item, doc_id, score): candidates for the k best of every item, a list of (term, multiplicity), over all blocks.

    Gustavson's product: for each item the posting lists of its terms are added up in one dense row of the block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(items), k)
        for b in batches:
            for r in range(b.num_rows):
                ids, lengths, term, df = (b.column(c)[r].values for c in ("doc_ids", "lengths", "terms", "df"))
                lengths, term, df = (x.to_numpy(zero_copy_only=False) for x in (lengths, term, df))
                rows, tf = (np.frombuffer(b.column(c)[r].as_buffer(), kind).astype(np.int64) for c, kind in (("rows", "<u2"), ("tf", "<u4")))
                m = 75 + (25 * lengths * n) // max(1, total)
                impact = np.repeat(weights[term], df) * ((1_000_000_000 * tf) // (1000 * tf + 12 * m[rows]))
                begin, end = np.zeros(len(weights), np.int64), np.zeros(len(weights), np.int64)
                end[term] = np.cumsum(df)
                begin[term] = end[term] - df
                order = pc.sort_indices(ids, null_placement="at_end").to_numpy()
                place = np.empty(len(ids), np.int64)
                place[order] = np.arange(len(ids))
                out_item, out_at, out_score = [], [], []
                for item, terms_ in enumerate(items):
                    scores = np.zeros(len(ids), np.int64)
                    for t, times in terms_:
                        scores[rows[begin[t] : end[t]]] += times * impact[begin[t] : end[t]]
                    at = best.chosen(item, scores, place)
                    out_item.append(np.full(len(at), item, np.int32))
                    out_at.append(at)
                    out_score.append(scores[at])
                if items:
                    at = np.concatenate(out_at)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_item)), ids.take(pa.array(at)), pa.array(np.concatenate(out_score))], ["item", "doc_id", "score"])

    kind = blocks.schema["doc_ids"].dataType.elementType
    schema = StructType([StructField("item", IntegerType()), StructField("doc_id", kind), StructField("score", LongType())])
    return blocks.select("doc_ids", "lengths", "terms", "df", "rows", "tf").mapInArrow(run, schema)


def top(candidates: DataFrame, k: int) -> DataFrame:
    """candidates(item, doc_id, score) with rank up to k: by score, then by doc_id, null last.

    First within salted groups of an item, so that no task ranks all that the blocks gave for it.
    """
    best = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    salted = candidates.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)))
    first = salted.withColumn("rank", F.row_number().over(Window.partitionBy("item", "salt").orderBy(*best))).where(F.col("rank") <= k)
    return first.select("item", "doc_id", "score").withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*best))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k highest-scoring documents of each item, of those with a score over 0.

    All whole texts of docs are ranked; null ones have no term. Equal scores rank by ascending doc_id, null last; rows of
    docs that repeat a doc_id are documents of their own. Rows of items that repeat item_id and text count once; those that
    share an item_id only are ranked each by itself. Items without a term that a document has give no row, and
    so do empty tables. Other columns of either table are left out. The matrix holds the items' terms only; items of
    more than about ITEM_BYTES of text are taken in several passes over the documents, with the same result.
    """
    spark = docs.sparkSession
    asked = cut(items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct(), "items")
    size = asked.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    passes = -(-size // ITEM_BYTES)
    found, n, total = None, 0, 0
    for number in range(passes):
        some = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == number).collect() if passes > 1 else asked.collect()  # about ITEM_BYTES
        counted = [Counter(terms(r.text)) for r in some]
        vocabulary = sorted({t for c in counted for t in c})
        at = {t: i for i, t in enumerate(vocabulary)}
        blocks = cut(term_blocks(docs, vocabulary), "term-blocks", compression="zstd")
        if not found:
            n, total = blocks.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        df = blocks.select(F.explode(F.arrays_zip("terms", "df")).alias("t")).groupBy("t.terms").agg(F.sum("t.df").alias("df"))
        weight = F.floor(1000 * F.log(F.lit(2 * n + 2).cast("double") / (2 * F.col("df") + 1).cast("double")))
        weights = np.zeros(max(1, len(vocabulary)), dtype=np.int64)
        for r in df.select("terms", weight.alias("w")).toLocalIterator():  # a row for each term of the items at most
            weights[r.terms] = r.w
        lists = [sorted((at[t], times) for t, times in c.items()) for c in counted]
        names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(some)], StructType([StructField("item", IntegerType()), asked.schema["item_id"]]))
        ranked = top(multiply(blocks, lists, weights, n, total, k), k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found = found.union(ranked) if found else ranked
    if found is None:
        return spark.createDataFrame([], StructType([asked.schema["item_id"], StructField("rank", IntegerType()), docs.schema["doc_id"], StructField("score", LongType())]))
    return found
