"""Document fingerprints: one-permutation MinHash with optimal densification, kept as packed low-order bits. DataFrame operations only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.rows import digest
from tessera.storage import cut, small_side

#: Words of a shingle.
SHINGLE = 5
#: Bins of one permutation, a power of two, and low-order bits kept of each bin's least hash.
BINS, BITS = 512, 4
#: Bins that an empty one looks at, by hash, before all filled ones are ranked.
PROBES = 16
LANES = 64 // BITS
_LOW = 63 - (BINS.bit_length() - 1)
_EMPTY = (1 << _LOW) - 1


def _lane_mask() -> int:
    mask = sum(1 << (BITS * k) for k in range(LANES))
    return mask - (1 << 64) if mask >> 63 else mask


def with_fingerprint(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with name, array<long>, the packed fingerprint of a text column that isn't null; zeros for a text without words.

    Shingles are SHINGLE words in a row (maximal runs without white space), or all words where there are fewer. A shingle is
    hashed once: the high bits choose a bin, where the least of the rest stays. An empty bin takes the value of a filled
    one: the first of PROBES bins that its own sequence of hashes names, else the filled bin that ranks first by a hash of the
    two. So each empty bin goes through all bins in an order that is the same for all texts, which makes the densification
    optimal. No shuffle: a text's hashes are sorted in its row, with one mark for each bin as the last of that bin.
    """
    w, h, d, f = (f"{name}_{x}" for x in ("words", "hashes", "dense", "filled"))
    steps = rows.withColumn(w, F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), ""))
    shingle = F.transform(w, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, SHINGLE)]))
    whole = F.slice(shingle, 1, F.greatest(F.size(w) - (SHINGLE - 1), F.lit(1)))
    high = F.lit((1 << 63) - 1)
    # A hash equal to its bin's mark gives way by one.
    hashes = F.transform(whole, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) == _EMPTY, x.bitwiseAND(high) - 1).otherwise(x.bitwiseAND(high)))
    marks = F.transform(F.sequence(F.lit(0).cast("long"), F.lit(BINS - 1).cast("long")), lambda j: F.shiftleft(j, _LOW).bitwiseOR(F.lit(_EMPTY)))
    steps = steps.withColumn(h, F.sort_array(F.concat(hashes, marks))).drop(w)
    least = F.filter(h, lambda x, i: (i == 0) | (F.shiftright(x, _LOW) != F.shiftright(F.get(h, i - 1), _LOW)))
    steps = steps.withColumn(d, F.transform(least, lambda x: F.when(x.bitwiseAND(F.lit(_EMPTY)) != _EMPTY, x))).drop(h)
    steps = steps.withColumn(f, F.filter(F.sequence(F.lit(0), F.lit(BINS - 1)), lambda j: F.get(d, j).isNotNull()))

    def chosen(x: Column, j: Column) -> Column:
        probes = [F.get(d, F.hash(j, F.lit(k)).bitwiseAND(F.lit(BINS - 1))) for k in range(PROBES)]
        first = F.array_min(F.transform(f, lambda i: F.struct(F.xxhash64(j, i).alias("rank"), i.alias("bin"))))["bin"]
        # Two references keep the list of filled bins a column that is made once, not once a bin.
        return F.coalesce(x, *probes, F.when(F.size(f) > 0, F.get(d, first)), F.lit(0)).bitwiseAND(F.lit((1 << BITS) - 1))

    steps = steps.withColumn(d, F.transform(d, chosen)).drop(f)
    lanes = lambda k: reduce(lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.get(d, k * LANES + i), BITS * i) for i in range(LANES)])
    return steps.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(BINS // LANES - 1)), lanes)).drop(d)


def likeness(a: Column | str, b: Column | str) -> Column:
    """Estimated Jaccard similarity of two packed fingerprints, 0 to 1.

    Bins agree by chance with 2^-BITS, which is taken off. 1 for two texts without words, 0 if only one has none.
    """
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))

    def equal(x: Column, y: Column) -> Column:
        differ = reduce(lambda p, q: p.bitwiseOR(q), [F.shiftrightunsigned(x.bitwiseXOR(y), k) for k in range(BITS)])
        return F.lit(LANES).cast("long") - F.bit_count(differ.bitwiseAND(F.lit(_lane_mask())))

    same = F.aggregate(F.zip_with(a, b, equal), F.lit(0).cast("long"), lambda t, x: t + x) / BINS
    chance = 2.0**-BITS
    blank = lambda c: F.forall(c, lambda x: x == 0)
    return F.when(blank(a) != blank(b), 0.0).otherwise(F.greatest(F.lit(0.0), (same - chance) / (1 - chance)))


def as_text(fingerprint: Column | str) -> Column:
    """Lowercase hex digits of a packed fingerprint."""
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def _order() -> list[Column]:
    return [F.col("key.doc_id").desc_nulls_last(), F.col("key.digest")]


def successors(keys: DataFrame) -> DataFrame:
    """keys(key struct<doc_id, digest>, ...), distinct, with next_key: the following one by descending doc_id, null last; the first after the last.

    Rows are dealt by ranges of this order and numbered within them; what the parts hand to each other is one row each.
    """
    ranged = cut(keys.repartitionByRange(*_order()).withColumn("part", F.spark_partition_id()), "ordered")
    window = Window.partitionBy("part").orderBy(*_order())
    within = ranged.withColumns({"next_key": F.lead("key").over(window), "nth": F.row_number().over(window)})
    ordered = Window.orderBy("part")  # a row for each part
    heads = within.where("nth = 1").select("part", F.lead("key").over(ordered).alias("following"), F.first("key").over(ordered.rowsBetween(Window.unboundedPreceding, 0)).alias("start"))
    heads = F.broadcast(heads.select("part", F.coalesce("following", "start").alias("after")))
    return within.join(heads, "part").withColumn("next_key", F.coalesce("next_key", "after")).drop("part", "nth", "after")


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row of docs.

    A row's edited text has its last third of code points (rounded down) replaced by the first as many, or all, of the
    next document by descending doc_id; after the last comes the first, and a table of one row follows itself. Null texts
    are empty; null doc_ids come last. Rows that share a doc_id follow each other by their texts' 64-bit digests; rows that
    repeat doc_id and text count as one document and give equal rows. Other columns are left out; an empty table gives none.
    Whole texts are fingerprinted where they are read. Only what an edited text is made of is shuffled, about the
    text's own length.
    """
    key = F.struct("doc_id", digest("text").alias("digest")).alias("key")
    rows = docs.select(key, F.coalesce("text", F.lit("")).alias("text"))
    groups = rows.groupBy("key").agg(F.max(F.length("text")).cast("long").alias("n_chars"), F.count("*").alias("copies"))
    pairs = cut(successors(groups), "pairs")
    repeated = not pairs.where("copies > 1").isEmpty()
    if repeated:
        rows = rows.dropDuplicates(["key"])
    own = with_fingerprint(rows, "text", "fp")
    n = F.length("text")
    third = F.expr("cast(n_chars div 3 as int)")
    begin = own.select("key", "fp", F.substring("text", F.lit(1), n - F.expr("cast(length(text) div 3 as int)")).alias("begin"))
    asked = small_side(pairs.select(F.col("key").alias("asker"), F.col("next_key").alias("key"), third.alias("third")), 64)
    ends = rows.join(asked, "key").select(F.col("asker").alias("key"), F.substring("text", F.lit(1), F.col("third")).alias("end"))
    edited = begin.join(ends, "key").select("key", "fp", F.concat("begin", "end").alias("edited"))
    marked = edited.withColumn("edited_sha256", F.sha2("edited", 256))
    done = cut(with_fingerprint(marked, "edited", "edited_fp").drop("edited"), "fingerprints")
    done = done.join(pairs, "key").join(done.select(F.col("key").alias("next_key"), F.col("fp").alias("next_fp")), "next_key")
    if repeated:
        done = done.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return done.select(
        "key.doc_id",
        "n_chars",
        "edited_sha256",
        as_text("fp").alias("fingerprint"),
        as_text("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )
