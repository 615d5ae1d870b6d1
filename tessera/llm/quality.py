"""Quality classifier: an interpolated modified Kneser-Ney model of letters in running text, trained on trusted text.

N-grams run over the borders of words. Their counts are joined with each other and with the n-grams of the texts on
sharded keys; neither the model nor the counts pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from tessera.llm.rows import digest, without
from tessera.llm.tokens import release_memory
from tessera.storage import cut, scratch, small_side

#: Longest n-grams, in letters; MARK stands for the places before a text.
ORDER, MARK = 5, "\u0002"
#: Letters handled together, and distinct n-grams that a task holds before it hands their counts on.
CHUNK, HELD_GRAMS = 200_000, 700_000
#: The most n-grams whose scores are broadcast (12 bytes each, twice over in a table half full); rarer ones are joined by shuffle.
FREQUENT = 1_000_000
#: One of so many trusted documents is kept out of the counts; thresholds are quantiles of these.
HELD_OUT = 5
#: The quantile of trusted and of rejected text, by language, between which a threshold lies: of the perplexity, and of the
#: share of a text's word pairs that are new, which tells text that repeats itself.
PERPLEXITY_QUANTILES, VARIETY_QUANTILES = (0.995, 0.4), (0.002, 0.1)

_BASE = np.uint64(0x9E3779B97F4A7C15)
_COUNTED = np.uint64(0xD6E8FEB86659FD93)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _seed(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


def _pieces(texts: list[bytes], order: int) -> Iterator[tuple[list[int], list[str]]]:
    """Owners and pieces of all texts, about CHUNK letters at a time. A piece begins with order - 1 letters of context.

    Words are joined by one space, with one behind the last; U+0000 and MARK inside a text count as U+FFFD.
    """
    owners, pieces, size = [], [], 0
    for i, text in enumerate(texts):
        words = text.split()
        if not words:
            continue
        letters = b" ".join(words).decode().replace("\0", "�").replace(MARK, "�") + " "
        letters = MARK * (order - 1) + letters
        for at in range(order - 1, len(letters), CHUNK):
            owners.append(i)
            pieces.append(letters[at - order + 1 : at + CHUNK])
            size += len(pieces[-1])
            if size >= CHUNK:
                yield owners, pieces
                owners, pieces, size = [], [], 0
    if pieces:
        yield owners, pieces


def _windows(owners: list[int], pieces: list[str], order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all pieces, where each window of `order` letters starts, and its owner."""
    codes = np.frombuffer("".join(pieces).encode("utf-32-le"), dtype="<u4")
    sizes = np.array([len(p) for p in pieces])
    own = sizes - (order - 1)
    begin = np.cumsum(sizes) - sizes
    starts = np.repeat(begin - (np.cumsum(own) - own), own) + np.arange(int(own.sum()))
    return codes, starts, np.repeat(np.array(owners), own)


def _keys(codes: np.ndarray, starts: np.ndarray, seeds: np.ndarray, order: int) -> np.ndarray:
    """64-bit keys of the windows, with a seed for each window (its language's)."""
    h = np.zeros(len(codes) - order + 1, dtype=np.uint64)
    for j in range(order):
        h = h * _BASE + codes[j : len(h) + j]
    return _mix(_mix(h[starts] + seeds) * _BASE)


def count_grams(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """docs(lang, text, counted): (lang, gram, n, c), the n-grams of all texts, how often they occur, and how often in counted ones.

    Each task adds up its own before they are shuffled, and never holds more than about HELD_GRAMS of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        groups: dict[tuple[str, bool], int] = {}
        held: list[tuple[np.ndarray, ...]] = []

        def merged() -> tuple[np.ndarray, ...]:
            keys, n, grams, group = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            at = np.argsort(keys)
            keys = keys[at]
            first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
            n = np.add.reduceat(n[at], first)
            at = at[first]
            return keys[first], n, grams[at], group[at]

        def out() -> Iterator[pa.RecordBatch]:
            names = list(groups)
            for at in range(0, len(held[0][0]), 1 << 16):
                _, n, grams, group = (x[at : at + (1 << 16)] for x in held[0])
                text = pa.array(np.ascontiguousarray(grams).view(f"<U{order}").ravel().tolist(), pa.string())
                langs, counted = (pa.array([names[g][i] for g in group.tolist()]) for i in (0, 1))
                yield pa.RecordBatch.from_arrays([langs, text, pa.array(n), pa.array(np.where(np.array(counted), n, 0))], ["lang", "gram", "n", "c"])

        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                kinds = list(zip(part.column("lang").to_pylist(), part.column("counted").to_pylist(), strict=True))
                for kind in kinds:
                    groups.setdefault(kind, len(groups))
                own = np.array([groups[k] for k in kinds], dtype=np.int32)
                seeds = np.array([_seed(lang) for lang, _ in kinds], dtype=np.uint64) + np.array([c for _, c in kinds], dtype=np.uint64) * _COUNTED
                for owners, pieces in _pieces(part.column("text").cast(pa.large_binary()).to_pylist(), order):
                    codes, starts, owner = _windows(owners, pieces, order)
                    keys, first, n = np.unique(_keys(codes, starts, seeds[owner], order), return_index=True, return_counts=True)
                    held.append((keys, n, codes[starts[first][:, None] + np.arange(order)], own[owner[first]]))
                    if sum(len(x[0]) for x in held[1:]) > HELD_GRAMS // 2:
                        held = [merged()]
                        if len(held[0][0]) > HELD_GRAMS:
                            yield from out()
                            held = []
        if held:
            held = [merged()]
            yield from out()
            held = []
        release_memory()

    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"), "counted")
    counts = rows.mapInArrow(run, "lang string, gram string, n long, c long")
    return cut(counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("c").alias("c")), "grams")


def level_counts(grams: DataFrame, order: int) -> list[DataFrame]:
    """grams(lang, gram, c): a table (lang, k, gram, c) for each order from 1. The longest count occurrences, shorter ones distinct letters before them."""
    out = [grams.where("c > 0").select("lang", F.lit(order).alias("k"), "gram", "c")]
    for k in range(order - 1, 0, -1):
        inner = out[0].select("lang", F.substr("gram", F.lit(2)).alias("gram"))
        counts = inner.groupBy("lang", "gram").agg(F.count("*").alias("c"))
        out.insert(0, cut(counts.select("lang", F.lit(k).alias("k"), "gram", "c"), "counts"))
    return out


def _discounts(counts: DataFrame) -> DataFrame:
    """(lang, k, d1, d2, d3): modified Kneser-Ney discounts from the numbers of n-grams that occur 1 to 4 times."""
    n = [F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5)]
    at = counts.groupBy("lang", "k").agg(*n)
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def d(i: int) -> Column:
        plain = F.when((F.col("n1") > 0) & (F.col(f"n{i}") > 0), i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")).otherwise(F.lit(0.5 * i))
        return F.greatest(F.lit(0.01), F.least(plain, F.lit(i - 0.01)))

    return at.select("lang", "k", d(1).alias("d1"), d(2).alias("d2"), d(3).alias("d3"))


#: A model: for each order from 1 (lang, gram, logp) and (lang, head, backoff), and (lang, logp) of unseen letters.
Model = tuple[list[tuple[DataFrame, DataFrame]], DataFrame]


def train(grams: DataFrame, order: int = ORDER) -> Model:
    """The model of grams(lang, gram, c).

    logp is the interpolated probability of the gram's last letter after the others; backoff is the weight that the
    letters before the last leave to shorter grams. Counts of each order join those of the order below, sharded by
    their keys. Unseen letters share what one more letter than those seen would have.
    """
    counts = level_counts(grams, order)
    rates = cut(_discounts(reduce(DataFrame.unionByName, counts)), "rates")  # one row for a language and order
    letters = F.broadcast(cut(counts[0].groupBy("lang").agg((F.count("*") + 1).alias("letters")), "letters"))  # one row for a language
    levels: list[tuple[DataFrame, DataFrame]] = []
    for k, own in enumerate(counts, 1):
        rated = own.join(F.broadcast(rates.where(F.col("k") == k).drop("k")), "lang")
        less = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        rated = rated.select("lang", "gram", F.expr("substring(gram, 1, k - 1)").alias("head"), "c", less.alias("d"))
        heads = cut(rated.groupBy("lang", "head").agg(F.sum("c").alias("total"), F.sum("d").alias("left")), "heads")
        met = rated.join(heads, ["lang", "head"])
        if k == 1:
            met = met.join(letters, "lang").withColumn("below", -F.log("letters"))
        else:
            lower = levels[-1][0].select("lang", F.col("gram").alias("tail"), F.col("logp").alias("below"))
            met = met.withColumn("tail", F.substr("gram", F.lit(2))).join(lower, ["lang", "tail"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("left") / F.col("total") * F.exp("below")
        level = cut(met.select("lang", "gram", F.log(p).alias("logp")), "level")
        levels.append((level, heads.select("lang", "head", F.log(F.col("left") / F.col("total")).alias("backoff"))))
    return levels, letters.select("lang", (-F.log("letters")).alias("logp"))


def resolve(grams: DataFrame, model: Model, order: int = ORDER) -> DataFrame:
    """grams(lang, gram, n, c), those of the model among them: (lang, gram, n, logp, key); null logp without a model.

    Grams that the model has join it on their keys. Of the others, each distinct ending is resolved once, from the
    shortest up: what the model lacks has its context's backoff and the logp of its own ending.
    """
    levels, root = model
    asked = [grams.where("c = 0").select("lang", "gram")]
    for _ in range(order - 1):
        asked.insert(0, cut(asked[0].select("lang", F.substr("gram", F.lit(2)).alias("gram")).distinct(), "endings"))
    lower = F.broadcast(root.select("lang", F.lit("").alias("tail"), F.col("logp").alias("below")))  # one row for a language
    for own, (level, heads) in zip(asked, levels, strict=True):
        met = own.join(level, ["lang", "gram"], "left")
        met = met.withColumns({"head": F.expr("substring(gram, 1, length(gram) - 1)"), "tail": F.substr("gram", F.lit(2))})
        met = met.join(heads, ["lang", "head"], "left").join(lower, ["lang", "tail"], "left")
        logp = F.coalesce("logp", F.col("below") + F.coalesce("backoff", F.lit(0.0)))
        done = cut(met.select("lang", "gram", logp.alias("logp")), "resolved")
        lower = done.select("lang", F.col("gram").alias("tail"), F.col("logp").alias("below"))
    out = grams.select("lang", "gram", "n").join(levels[-1][0].unionByName(done), ["lang", "gram"])

    @F.pandas_udf("long")
    def key(lang: pd.Series, gram: pd.Series) -> pd.Series:
        codes = np.frombuffer("".join(gram).encode("utf-32-le"), dtype="<u4")
        seeds = np.array([_seed(x) for x in lang], dtype=np.uint64)
        return pd.Series(_keys(codes, np.arange(len(gram)) * order, seeds, order).view(np.int64) if len(gram) else np.empty(0, dtype=np.int64))

    return cut(out.select("lang", "gram", "n", "logp", key("lang", "gram").alias("key")), "resolved")


class Table:
    """Log probabilities by key, in an open table at most half full."""

    def __init__(self, keys: np.ndarray, values: np.ndarray) -> None:
        size = 1 << max(4, int(2 * len(keys)).bit_length())
        self.mask, self.keys, self.values, self.used = np.uint64(size - 1), np.zeros(size, dtype=np.uint64), np.zeros(size), np.zeros(size, dtype=bool)
        slot = keys & self.mask
        while len(keys):
            free = np.flatnonzero(~self.used[slot])
            place, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[place], self.values[place], self.used[place] = keys[won], values[won], True
            rest = np.ones(len(keys), dtype=bool)
            rest[won] = False
            keys, values, slot = keys[rest], values[rest], (slot[rest] + np.uint64(1)) & self.mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The value of each key and whether it is there."""
        slot = keys & self.mask
        out, there = self.values[slot], self.keys[slot] == keys
        there &= self.used[slot]
        left = np.flatnonzero(~there & self.used[slot])
        while len(left):
            at = slot[left] = (slot[left] + np.uint64(1)) & self.mask
            hit = self.used[at] & (self.keys[at] == keys[left])
            out[left[hit]], there[left[hit]] = self.values[at[hit]], True
            left = left[~hit & self.used[at]]
        return out, there


def frequent(resolved: DataFrame, most: int = FREQUENT) -> Table:
    """The grams that occur most often, `most` of them or fewer: those over a count that the histogram of counts gives."""
    step = F.floor(F.log2("n") * 16).cast("int")
    found = resolved.where("logp is not null")
    counts = found.groupBy(step.alias("step")).agg(F.count("*").alias("grams")).collect()  # one row for a sixteenth of a power of two
    total, least = 0, None
    for r in sorted(counts, key=lambda r: -r.step):
        total += r.grams
        if total > most:
            break
        least = r.step
    rows = found.where(step >= least if least is not None else F.lit(False)).select("key", "logp").toArrow()
    return Table(rows["key"].to_numpy().view(np.uint64), rows["logp"].to_numpy())


def score(docs: DataFrame, resolved: DataFrame, order: int = ORDER, most: int = FREQUENT) -> DataFrame:
    """(row, doc_id, digest, lang, logp, letters, variety) per row of docs, from resolve()'s table of all their n-grams.

    logp sums the log probabilities of the letters; null for languages without a model. Grams that occur often
    (bounded by `most`) are looked up in a broadcast table; a text's rarer ones join the resolved table by shuffle.
    variety is the share of distinct ones among a text's word pairs, null for less than two words.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(frequent(resolved, most))
    langs = {r.lang for r in resolved.where("logp is not null").select("lang").distinct().collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, row = held.value, TaskContext.get().partitionId() << 33
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                names, texts = part.column("lang").to_pylist(), part.column("text").cast(pa.large_binary()).to_pylist()
                seeds = np.array([_seed(x) for x in names], dtype=np.uint64)
                known = np.array([x in langs for x in names])
                logp, letters = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
                rare: list[tuple[np.ndarray, np.ndarray]] = []
                for owners, pieces in _pieces(texts, order):
                    codes, starts, owner = _windows(owners, pieces, order)
                    keys = _keys(codes, starts, seeds[owner], order)
                    value, there = table.find(keys)
                    logp += np.bincount(owner[there], weights=value[there], minlength=len(texts))
                    letters += np.bincount(owner, minlength=len(texts))
                    missing = np.flatnonzero(~there & known[owner])
                    rare.append((owner[missing], keys[missing]))
                owner, keys = (np.concatenate(x) for x in zip(*rare, strict=True)) if rare else (np.empty(0, dtype=np.int64),) * 2
                order_ = np.argsort(owner, kind="stable")
                borders = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=len(texts))))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(borders), pa.array(keys[order_].view(np.int64)))
                columns = [pa.array(np.arange(row, row + len(texts))), part.column("doc_id"), part.column("digest"), part.column("lang")]
                columns += [pa.array(logp, mask=~known), pa.array(letters), pa.array([_variety(t) for t in texts], pa.float64()), lists]
                row += len(texts)
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "digest", "lang", "logp", "letters", "variety", "rare"])
        release_memory()

    rows = docs.select("doc_id", digest("text").alias("digest"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    null = F.lit(None).cast("double")
    schema = rows.select(F.lit(0).cast("long").alias("row"), "doc_id", "digest", "lang", null.alias("logp"), F.lit(0).cast("long").alias("letters"), null.alias("variety"), F.expr("cast(array() as array<long>)").alias("rare")).schema
    scored = cut(rows.mapInArrow(run, schema), "scores")
    held.destroy()
    asked = scored.where(F.size("rare") > 0)
    if asked.isEmpty():
        return scored.drop("rare")
    each = asked.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n"))
    sums = each.join(resolved.select("key", F.col("logp").alias("one")), "key").groupBy("row").agg(F.sum(F.col("n") * F.col("one")).alias("more"))
    return cut(scored.drop("rare").join(sums, "row", "left").withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0))).drop("more"), "scores")


def _variety(text: bytes) -> float | None:
    words = text.split()
    if len(words) < 2:
        return None
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    pairs = _mix(h[:-1] * _BASE) + h[1:]
    return len(np.unique(pairs)) / len(pairs)


def judge(docs: DataFrame, labels: DataFrame, order: int = ORDER, most: int = FREQUENT) -> DataFrame:
    """(doc_id, digest, lang, perplexity, threshold, variety, variety_threshold, keep) per row of docs.

    Trusted text is every document that labels call quality 1 (and no label quality 0); one of HELD_OUT is kept out
    of the model. A language's threshold is the geometric mean of a high quantile of the perplexity of these and a
    middling one of documents labelled quality 0, if the latter is larger; else, or without such labels, the trusted
    quantile alone. Documents above it go, and so do those that repeat their own word pairs more than a low quantile
    of trusted text, found in the same way.

    Documents without words, and languages without trusted text, are kept. A null lang is a language of its own; a
    null text counts as empty. Equal texts of a language get equal values; a doc_id's labels hold for all its rows,
    and repeated labels count once. Columns beside doc_id, lang and text are left out, whatever their names. An empty
    table gives none. Memory is bounded by the longest text.
    """
    with scratch() as keep:
        rated, limits = (keep(x) for x in _rated(docs, labels, order, most))
    out = rated.join(F.broadcast(limits), "lang", "left")  # one row for a language
    good = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True)) & F.coalesce(F.col("variety") >= F.col("variety_threshold"), F.lit(True))
    return out.select("doc_id", "digest", "lang", "perplexity", "threshold", "variety", "variety_threshold", good.alias("keep"))


def _rated(docs: DataFrame, labels: DataFrame, order: int, most: int) -> tuple[DataFrame, DataFrame]:
    """Each row's perplexity and variety, and each language's thresholds."""
    marks = cut(labels.where("quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")), "marks")
    out_of = F.pmod(F.xxhash64("doc_id"), F.lit(HELD_OUT)) == 0
    trusted = marks.where((F.col("quality") == 1) & ~out_of).select("doc_id", F.lit(True).alias("counted"))
    marked = docs.select("doc_id", "lang", "text").join(small_side(trusted, 16), "doc_id", "left").select("lang", "text", F.coalesce("counted", F.lit(False)).alias("counted"))
    grams = count_grams(marked, order)
    resolved = resolve(grams, train(grams, order), order)
    scored = score(docs, resolved, order, most)
    perplexity = F.when(F.col("letters") > 0, F.round(F.exp(-F.col("logp") / F.col("letters")), 6)).alias("perplexity")
    rated = cut(scored.select("doc_id", "digest", "lang", "variety", perplexity), "rated")
    known = rated.join(small_side(marks, 16), "doc_id").where("perplexity is not null").withColumn("own", F.when(F.col("quality") == 0, "bad").when(out_of, "held").otherwise("seen"))

    def at(column: str, q: float, *kinds: str) -> Column:
        """The quantile over the first kind that a language has."""
        return F.coalesce(*[F.percentile_approx(F.when(F.col("own") == kind, F.col(column)), q, 100_000) for kind in kinds])

    (high, bad_low), (low, bad_high) = PERPLEXITY_QUANTILES, VARIETY_QUANTILES
    limits = known.groupBy("lang").agg(at("perplexity", high, "held", "seen").alias("p"), at("perplexity", bad_low, "bad").alias("bad_p"), at("variety", low, "held", "seen").alias("v"), at("variety", bad_high, "bad").alias("bad_v"))
    threshold = F.when(F.col("bad_p") > F.col("p"), F.sqrt(F.col("bad_p") * F.col("p"))).otherwise(F.col("p"))
    variety = F.when(F.col("bad_v") < F.col("v"), F.sqrt(F.col("bad_v") * F.col("v"))).otherwise(F.col("v"))
    return rated, cut(limits.select("lang", F.round(threshold, 6).alias("threshold"), F.round(variety, 6).alias("variety_threshold")), "limits")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows that judge() rejects, told by doc_id, text and language; every column stays as it is."""
    with scratch() as keep:
        bad = judge(docs, labels).where("not keep").select("doc_id", F.xxhash64("digest", "lang").alias("digest")).distinct()
        bad = keep(cut(bad, "rejected"))
    return without(docs, bad, by_lang=True)
