"""Exact dedup by progressive refinement: length, then a prefix hash, then a hash of the whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.rows import digest, free_name, only, without
from tessera.storage import cut, scratch, small_side

#: Characters of a text that its prefix hash covers.
PREFIX = 256


def normal_text(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def _with_keys(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", normal_text(F.col("text")).alias("norm"))
    return rows.select("doc_id", "norm", F.length("norm").alias("len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("head"))


def _members(docs: DataFrame) -> DataFrame:
    """(len, head, sha, doc_id, digest, n): the rows of equal length and prefix hash as others, summed by doc_id and text.

    Each level groups only what the level before left with company: rows of equal length, then of equal
    prefix hash. Only these get the hash of their whole text. Whole texts are never shuffled: the
    surviving keys are broadcast to the scan while their counted size is below a limit; beyond it the scan
    hashes every text and the narrow rows are joined by shuffle. Counts are summed per doc_id and text
    before they meet in a group, so that a group with a third of all rows is spread over the tasks.
    """
    narrow = cut(_with_keys(docs).select("len", "head"), "lengths")
    lengths = cut(narrow.groupBy("len").count().where("count > 1").select("len"), "repeated")
    heads = narrow.join(small_side(lengths, 16), "len").groupBy("len", "head").count().where("count > 1").select("len", "head")
    heads = cut(heads, "heads")
    rows = docs.select("doc_id", digest("text").alias("digest"), normal_text(F.col("text")).alias("norm"))
    rows = rows.withColumns({"len": F.length("norm"), "head": F.xxhash64(F.substring("norm", 1, PREFIX))})
    # Beyond the broadcast limit the join shuffles: hash first then, so that it moves no texts.
    if heads.count() * 24 > 32 << 20:
        full = rows.withColumn("sha", F.sha2("norm", 256)).drop("norm").join(heads, ["len", "head"])
    else:
        full = rows.join(F.broadcast(heads), ["len", "head"]).withColumn("sha", F.sha2("norm", 256))
    return cut(full.groupBy("len", "head", "sha", "doc_id", "digest").agg(F.count("*").alias("n")), "members")


def duplicate_groups(docs: DataFrame) -> DataFrame:
    """Groups of two rows or more with equal text: (len, head, sha, keep_id, keep_rows, group_size).

    A null text counts as empty. keep_id is the smallest doc_id; null ids come last. keep_rows counts the
    rows that share keep_id and text (over one only if rows are repeated).
    """
    ids = _members(docs).groupBy("len", "head", "sha", "doc_id").agg(F.sum("n").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "n")).alias("first")
    groups = ids.groupBy("len", "head", "sha").agg(first, F.sum("n").alias("group_size")).where("group_size > 1")
    return cut(groups.select("len", "head", "sha", F.col("first.doc_id").alias("keep_id"), F.col("first.n").alias("keep_rows"), "group_size"), "groups")


def exact_report(docs: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of rows that repeat both the kept doc_id and its text, one is kept. Other columns of docs are left out.
    """
    groups = duplicate_groups(docs)
    rows = _with_keys(docs).select("doc_id", "len", "head", F.sha2("norm", 256).alias("sha"))
    joined = rows.join(groups, ["len", "head", "sha"], "left")
    lone = F.col("group_size").isNull()
    out = joined.select(
        "doc_id",
        F.when(lone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (lone | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
        (F.col("keep_rows") > 1).alias("again"),
    )
    if groups.where("keep_rows > 1").isEmpty():
        return out.drop("again")
    repeated = F.col("kept") & F.coalesce("again", F.lit(False))
    one = F.row_number().over(Window.partitionBy("doc_id", "text_sha256").orderBy(F.lit(0))) == 1
    return out.where(~repeated).drop("again").union(out.where(repeated).withColumn("kept", one).drop("again"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs with one row of those that have equal text: the one with the smallest doc_id. Every column stays as it is.

    A null text counts as empty. Of rows that share this doc_id too, one with the least digest stays; of rows that
    repeat doc_id and text, the first in the order of all columns. Null ids come last. An empty table gives none.
    """
    key = ["len", "head", "sha"]
    with scratch() as keep:
        members = _members(docs)
        first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest", "n")).alias("first")
        groups = cut(members.groupBy(key).agg(first, F.sum("n").alias("size")).where("size > 1").drop("size"), "groups")
        other = ~(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("digest") == F.col("first.digest")))
        copies = keep(cut(members.join(small_side(groups, 120), key).where(other).select("doc_id", "digest"), "copies"))
        again = keep(cut(groups.where("first.n > 1").select("first.doc_id", "first.digest"), "repeats"))
    kept = without(docs, copies)
    if again.isEmpty():
        return kept
    name = free_name(docs.columns, "nth")
    repeats = only(docs, again)
    pick = Window.partitionBy("doc_id", digest("text")).orderBy(*docs.columns)
    one = repeats.withColumn(name, F.row_number().over(pick)).where(F.col(name) == 1).drop(name)
    return without(kept, again).union(one)
