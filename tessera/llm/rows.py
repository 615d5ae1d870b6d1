"""Rows told apart by doc_id and text, so that a repeated doc_id never decides about another text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.storage import small_side


def digest(text: Column | str) -> Column:
    """64 bits of a text; null counts as empty. Only texts of one doc_id are told apart by it."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def free_name(taken: list[str], name: str) -> str:
    """name, with as many underscores as it takes not to be one of `taken` (in any case)."""
    held = {t.lower() for t in taken}
    while name in held:
        name += "_"
    return name


def _met(docs: DataFrame, rows: DataFrame, by_lang: bool, how: str) -> DataFrame:
    name = free_name(docs.columns, "row")
    side = rows.select(F.struct(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "digest").alias(name))
    told = digest(docs["text"])
    if by_lang:
        told = F.xxhash64(told, F.coalesce(docs["lang"], F.lit("")))
    own = F.struct(docs["doc_id"], told.alias("digest"))
    return docs.join(small_side(side, 32), own == F.col(name), how)


def without(docs: DataFrame, gone: DataFrame, by_lang: bool = False) -> DataFrame:
    """docs without the rows whose doc_id (null included) and digest are in gone(doc_id, digest).

    The digest is that of the text, or with by_lang a hash of it and the language (null counts as empty). Columns stay
    as they are, whatever their names. gone is broadcast if its counted rows are few; else rows meet by a shuffle.
    """
    return _met(docs, gone, by_lang, "left_anti")


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The other rows, as by without()."""
    return _met(docs, kept, False, "left_semi")
