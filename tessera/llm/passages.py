"""Substring dedup by collinear chaining: shared seeds, chains with gap costs, aligned to fuzzy passages."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.llm.rows import digest, free_name
from tessera.llm.tokens import releasing
from tessera.storage import cut, scratch, small_side

#: Words of a seed, of which one in KEEP is kept, chosen by its hash alone, so that two texts keep the same ones whatever
#: stands around them. Where one word in eight differs, runs of seven words have three seeds each.
SEED, KEEP = 5, 4
#: Words between seeds of a run that count as covered, and between fragments that count as one passage.
HOLE, APART = 16, 8
#: Words of a passage, of a fragment of one, and the share of its words that must match.
MIN_WORDS, MIN_FRAGMENT, MIN_IDENTITY = 50, 20, 0.8
#: Words without a seed inside a run of one diagonal, and of the longest gap that is aligned word by word; cost of a gap's
#: word on either side; words around a chain to extend it. An alike run further out is found by a seed of its own, if one
#: of its seeds is kept.
MAX_GAP, GAP_COST, MARGIN = 48, 0.2, 48
#: The most seeds whose first occurrence is broadcast (32 bytes each); those that make up more than one in so many of all.
HOT_SEEDS = 20_000
#: Bytes hashed together.
CHUNK = 1_000_000

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASE = 0x100000001B3
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9FB21C651E98DF25)
    return h ^ (h >> np.uint64(28))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.cumprod(out)


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of all texts, A-Z lower-cased, and the number of words of each text."""
    joined = np.frombuffer(b"\n".join(t.lower() for t in texts) + b"\n", dtype=np.uint8)
    space = _SPACE[joined]
    before = np.concatenate(([True], space[:-1]))
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    sums = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(joined)))))
    back = _powers(pow(_BASE, -1, 1 << 64), len(joined))
    hashes = _mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    borders = np.cumsum([len(t) + 1 for t in texts])
    return hashes, np.diff(np.searchsorted(starts, np.concatenate(([0], borders))))


def pick_seeds(hashes: np.ndarray, counts: np.ndarray, size: int = SEED, keep: int = KEEP) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, word position and hash of the seeds kept: those whose hash is divisible by `keep`."""
    seeds = np.maximum(0, counts - size + 1)
    text = np.repeat(np.arange(len(counts)), seeds)
    place = np.arange(len(text)) - np.repeat(np.cumsum(seeds) - seeds, seeds)
    first = (np.cumsum(counts) - counts)[text] + place
    h = np.zeros(len(text), dtype=np.uint64)
    for j in range(size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + hashes[first + j])
    kept = h % np.uint64(keep) == 0
    return text[kept], place[kept], h[kept]


def keyed(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame | None, bool]:
    """docs with a key (long) for each document, the keys that aren't doc_ids, and whether rows repeat doc_id and text.

    The key is the doc_id. Where a doc_id has several texts, all but the one with the least digest get a hash of both
    instead: (key, doc_id). Rows without id or text have no key.
    """
    there = docs["doc_id"].isNotNull() & docs["text"].isNotNull()
    ids = docs.where(there).select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"))
    counts = ids.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("digest").alias("least"), F.max("digest").alias("most")).where("n > 1")
    counts = cut(counts, "repeats")
    plain = F.when(there, docs["doc_id"].cast("long"))
    if counts.isEmpty():
        return docs.withColumn(name, plain), None, False
    side = free_name(docs.columns, "least")
    least = counts.where("least != most").select(F.struct(F.col("doc_id").alias("id")).alias(f"{side}id"), F.col("least").alias(side))
    own = docs.join(small_side(least, 24), F.struct(plain.alias("id")) == F.col(f"{side}id"), "left")
    odd = F.col(side).isNotNull() & (digest(docs["text"]) != F.col(side))
    own = own.withColumn(name, F.when(odd & there, F.xxhash64(docs["doc_id"], digest(docs["text"]))).otherwise(plain))
    odd_keys = own.where(odd & there).select(F.col(name).alias("key"), docs["doc_id"].cast("long").alias("doc_id")).distinct()
    return own.drop(side, f"{side}id"), cut(odd_keys, "keys"), True


def seeds(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text): (doc_id, pos, seed), kept word k-mers of every row and their word positions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("doc_id"), b.column("text").cast(pa.large_binary()).to_pylist()
            at = 0
            while at < len(texts):
                stop, size = at, 0
                while stop < len(texts) and size < CHUNK:
                    size += len(texts[stop])
                    stop += 1
                text, place, h = pick_seeds(*word_hashes(texts[at:stop]))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(text + at)), pa.array(place.astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "pos", "seed"])
                at = stop

    return docs.select("doc_id", "text").mapInArrow(releasing(run), "doc_id long, pos int, seed long")


class MaxTree:
    """Fenwick tree of (value, owner) pairs: the largest value among the first n places."""

    def __init__(self, n: int) -> None:
        self.tree = [(0.0, -1)] * (n + 1)

    def put(self, i: int, item: tuple[float, int]) -> None:
        i += 1
        while i < len(self.tree):
            self.tree[i] = max(self.tree[i], item)
            i += i & -i

    def best(self, n: int) -> tuple[float, int]:
        out = (0.0, -1)
        while n:
            out = max(out, self.tree[n])
            n -= n & -n
        return out


def link_runs(runs: list[tuple[int, int, int, int]]) -> tuple[list[float], list[int]]:
    """The best score of a chain that ends with each run (x, x end, y, y end; sorted), and the run before it there, or -1.

    A run scores its words plus the best chain that ends before it in both documents, less GAP_COST for each word
    between them in either, if that is a gain. A Fenwick tree over the ends in y gives that chain.
    """
    stops = np.array(sorted({r[3] for r in runs}))
    place = {s: i for i, s in enumerate(stops.tolist())}
    tree, score, before = MaxTree(len(stops)), [0.0] * len(runs), [-1] * len(runs)
    by_end, done = sorted(range(len(runs)), key=lambda i: runs[i][1]), 0
    for i, (xs, xe, ys, _) in enumerate(runs):
        while done < len(by_end) and runs[by_end[done]][1] <= xs:
            j = by_end[done]
            tree.put(place[runs[j][3]], (score[j] + GAP_COST * (runs[j][1] + runs[j][3]), j))
            done += 1
        best, j = tree.best(int(np.searchsorted(stops, ys, side="right")))
        gain = best - GAP_COST * (xs + ys) if j >= 0 else 0.0
        score[i] = xe - xs + max(0.0, gain)
        before[i] = j if gain > 0 else -1
    return score, before


def chains(x: np.ndarray, y: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
    """Chains of the matches (x, y) of two documents, each a list of runs (x, x end, y, y end) in order.

    Matches on one diagonal join into runs, and runs into chains by link_runs(), over gaps of any length that their
    cost allows: alignment cuts them again. Chains are taken from the highest score down and share no runs. One that
    lies in words already covered, as repeated words give many, is left out; words of a gap between seeds of more
    than HOLE words aren't covered.
    """
    order = np.lexsort((x, y - x))
    x, y = x[order], y[order]
    base = int(x.min())
    new = np.concatenate(([True], (np.diff(y - x) != 0) | (np.diff(x) > MAX_GAP)))
    begin = np.flatnonzero(new)
    last = np.concatenate((begin[1:], [len(x)])) - 1
    rows = sorted(zip(x[begin].tolist(), (x[last] + SEED).tolist(), y[begin].tolist(), (y[last] + SEED).tolist(), begin.tolist(), last.tolist(), strict=True))
    runs, held = [r[:4] for r in rows], [r[4:] for r in rows]
    # Where each seed's words end, or those up to the next seed of its run if that is near.
    ends = x + SEED
    close = np.flatnonzero(~new[1:] & (np.diff(x) <= HOLE))
    ends[close] = np.maximum(ends[close], x[close + 1])
    score, before = link_runs(runs)
    out, used = [], [False] * len(runs)
    covered = np.zeros(max(r[1] for r in runs) - base, dtype=bool)
    for i in sorted(range(len(runs)), key=lambda i: -score[i]):
        chain, spans = [], []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            begun, ended = held[i]
            spans.extend(zip((x[begun : ended + 1] - base).tolist(), (ends[begun : ended + 1] - base).tolist(), strict=True))
            i = before[i]
        if not chain:
            continue
        own = covered[chain[-1][0] - base : chain[0][1] - base]
        if own.mean() < (0.5 if len(chain) == 1 else 0.9):
            for at, stop in spans:
                covered[at:stop] = True
            out.append(chain[::-1])
    return out


def _chained(pairs: DataFrame) -> DataFrame:
    """pairs(doc_id, rep_id, seeds): (doc_id, rep_id, xs, xe, ys, ye, runs) of each chain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(at, 256) for whole in batches for at in range(0, whole.num_rows, 256)):
            docs, reps, found = b.column("doc_id").to_pylist(), b.column("rep_id").to_pylist(), []
            for doc, rep, own in zip(docs, reps, b.column("seeds"), strict=True):
                flat = own.values
                x, y = flat.field("pos").to_numpy().astype(np.int64), flat.field("rep_pos").to_numpy().astype(np.int64)
                found += [(doc, rep, c[0][0], c[-1][1], c[0][2], c[-1][3], [v for r in c for v in r]) for c in chains(x, y)]
            columns = [*zip(*found, strict=True)] or [()] * 7
            kinds = [pa.int64()] * 2 + [pa.int32()] * 4 + [pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "rep_id", "xs", "xe", "ys", "ye", "runs"])

    return pairs.mapInArrow(releasing(run), "doc_id long, rep_id long, xs int, xe int, ys int, ye int, runs array<int>")


def _common(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of a longest common subsequence in both; the gaps of a chain are short."""
    rows = [[0] * (len(b) + 1)]
    for w in a:
        above, row = rows[-1], [0]
        for j, v in enumerate(b):
            row.append(above[j] + 1 if v == w else max(above[j + 1], row[j]))
        rows.append(row)
    out, i, j = [], len(a), len(b)
    while i and j and rows[i][j]:
        if a[i - 1] == b[j - 1]:
            i, j = i - 1, j - 1
            out.append((i, j))
        elif rows[i - 1][j] >= rows[i][j - 1]:
            i -= 1
        else:
            j -= 1
    return out[::-1]


#: Words left out of either text to go on behind a differing word, the likeliest first.
_STEPS = ((1, 1), (1, 0), (0, 1), (2, 2), (2, 1), (1, 2), (2, 0), (0, 2), (3, 3), (3, 2), (2, 3), (3, 0), (0, 3))


def _extend(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of matching words as far as a and b go on alike, with a few words replaced, inserted or left out in between.

    Behind a differing word the first step goes on after which two words match again.
    """
    pairs: list[tuple[int, int]] = []
    i = j = score = best = kept = 0
    n, m = len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            pairs.append((i, j))
            i, j, score = i + 1, j + 1, score + 1
            if score > best:
                best, kept = score, len(pairs)
            continue
        for p, q in _STEPS:
            if i + p + 1 < n and j + q + 1 < m and a[i + p] == b[j + q] and a[i + p + 1] == b[j + q + 1]:
                break
        else:
            p = q = 1
        i, j, score = i + p, j + q, score - 2 * max(p, q)
        if score < best - 8:
            break
    return pairs[:kept]


def _cut_stretches(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """First and last place in pairs (of matching words) of its best-scoring stretches.

    A match scores 1 and a word without one as much less as MIN_IDENTITY allows, so that each stretch is above
    it. Stretches are maximal: none gains by its neighbour (Ruzzo and Tompa). One that is too short to stand by
    itself joins its neighbour where both together keep MIN_IDENTITY.
    """
    loss = MIN_IDENTITY / (1 - MIN_IDENTITY)
    total, found = 0.0, []  # (first, last, score before, score after)
    n, at = len(pairs), 0
    while at < n:
        end = at + 1
        while end < n and pairs[end][0] == pairs[end - 1][0] + 1 and pairs[end][1] == pairs[end - 1][1] + 1:
            end += 1
        if at:
            total -= loss * (max(pairs[at][0] - pairs[at - 1][0], pairs[at][1] - pairs[at - 1][1]) - 1)
        first, low, high = at, total, total + end - at
        j = len(found) - 1
        while j >= 0:
            if found[j][2] >= low:
                j -= 1
            elif found[j][3] < high:
                first, low = found[j][0], found[j][2]
                del found[j:]
                j -= 1
            else:
                break
        found.append((first, end - 1, low, high))
        total, at = high, end
    size = lambda s: max(pairs[s[1]][0] - pairs[s[0]][0], pairs[s[1]][1] - pairs[s[0]][1]) + 1
    at = 0
    while at + 1 < len(found):
        one, two = found[at], found[at + 1]
        if min(size(one), size(two)) < MIN_WORDS and two[1] - one[0] + 1 >= MIN_IDENTITY * size((one[0], two[1])):
            found[at : at + 2] = [(one[0], two[1], one[2], two[3])]
            at = max(0, at - 1)
        else:
            at += 1
    return [(s[0], s[1]) for s in found]


def _bridge(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of matching words in the gap between two runs; in a long one only as far as its ends go on alike."""
    if len(a) == len(b):
        same = [(i, i) for i, same in enumerate(map(str.__eq__, a, b)) if same]
        if 2 * len(same) >= len(a) or len(a) > MAX_GAP:
            return same
    if max(len(a), len(b)) <= MAX_GAP:
        return _common(a, b)
    left = _extend(a, b)
    i, j = left[-1] if left else (-1, -1)
    right = [(len(a) - 1 - p, len(b) - 1 - q) for p, q in reversed(_extend(a[::-1], b[::-1]))]
    return left + [(p, q) for p, q in right if p > i and q > j]


def align(a: list[str], b: list[str], runs: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Passages around a chain's runs, its best-scoring stretches: their ends in word lists a and b, and the words that match."""
    parts = [runs[i : i + 4] for i in range(0, len(runs), 4)]
    x, y = parts[0][0], parts[0][2]
    pairs = [(x - 1 - i, y - 1 - j) for i, j in reversed(_extend(a[:x][::-1], b[:y][::-1]))]
    for xs, xe, ys, ye in parts:
        pairs += [(x + i, y + j) for i, j in _bridge(a[x:xs], b[y:ys])]
        pairs += [(xs + i, ys + i) for i, same in enumerate(map(str.__eq__, a[xs:xe], b[ys:ye])) if same]
        x, y = xe, ye
    pairs += [(x + i, y + j) for i, j in _extend(a[x:], b[y:])]
    ends = [(pairs[i], pairs[j], j - i + 1) for i, j in _cut_stretches(pairs)]
    return [(p[0], q[0] + 1, p[1], q[1] + 1, n) for p, q, n in ends]


def _words(text: Column) -> Column:
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.split(F.regexp_replace(lowered, r"^[\x20\x09-\x0D]+", ""), r"[\x20\x09-\x0D]+")


def _lists(column: pa.ListArray) -> Iterator[list]:
    """The rows of a column of lists without nulls, as to_pylist() has them but with all their values converted at once."""
    borders = (column.offsets.to_numpy() - column.offsets[0].as_py()).tolist()
    values = column.flatten().to_numpy(zero_copy_only=False).tolist()
    return (values[at:stop] for at, stop in zip(borders[:-1], borders[1:], strict=True))


def _aligned(found: DataFrame, docs: DataFrame, repeated: bool) -> DataFrame:
    """found as by _chained(): (doc_id, start, stop, rep_id, rep_start, rep_stop, matched); docs(doc_id, text) may repeat rows."""
    def words_of(column: str) -> DataFrame:
        """(column, words) of the texts named there."""
        ids = cut(found.select(F.col(column).alias("doc_id")).distinct(), "ids")
        texts = docs.select("doc_id", "text").join(small_side(ids, 16), "doc_id")
        texts = texts.dropDuplicates(["doc_id"]) if repeated else texts
        return texts.select(F.col("doc_id").alias(column), _words(F.col("text")).alias("words"))

    low = lambda c: F.greatest(F.lit(0), F.col(c) - MARGIN)
    spans = found.withColumns({"a0": low("xs"), "b0": low("ys")})
    mine = spans.join(words_of("doc_id"), "doc_id").withColumn("a", F.slice("words", F.col("a0") + 1, F.col("xe") + MARGIN - F.col("a0"))).drop("words")
    both = mine.join(words_of("rep_id"), "rep_id").withColumn("b", F.slice("words", F.col("b0") + 1, F.col("ye") + MARGIN - F.col("b0")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for part in (b.slice(at, 256) for at in range(0, b.num_rows, 256)):
                plain = [part.column(c).to_pylist() for c in ("doc_id", "rep_id", "a0", "b0")]
                for doc, rep, a0, b0, mine, other, runs in zip(*plain, *(_lists(part.column(c)) for c in ("a", "b", "runs")), strict=True):
                    shift = [a0, a0, b0, b0]
                    for xs, xe, ys, ye, matched in align(mine, other, [v - shift[i % 4] for i, v in enumerate(runs)]):
                        if xe - xs >= MIN_FRAGMENT:
                            out.append((doc, xs + a0, xe + a0, rep, ys + b0, ye + b0, matched))
            columns = [*zip(*out, strict=True)] or [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "start", "stop", "rep_id", "rep_start", "rep_stop", "matched"])

    rows = both.select("doc_id", "rep_id", "a0", "b0", "a", "b", "runs")
    return rows.mapInArrow(releasing(run), "doc_id long, start int, stop int, rep_id long, rep_start int, rep_stop int, matched int")


def frequent_seeds(kept: DataFrame) -> DataFrame:
    """Seeds, HOT_SEEDS at most, that make up more than one in HOT_SEEDS of kept; all with more than twice that share are there.

    Each task hands on those that are more than half as frequent as that among its own rows, with their counts. A
    seed's counts that are left out are then at most half of that share of all rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b.column("seed").to_numpy() for b in batches]
        if held:
            seed, n = np.unique(np.concatenate(held), return_counts=True)
            often = n > sum(map(len, held)) / (2 * HOT_SEEDS)
            yield pa.RecordBatch.from_arrays([pa.array(seed[often]), pa.array(n[often])], ["seed", "n"])

    own = kept.select("seed").mapInArrow(releasing(run), "seed long, n long").groupBy("seed").agg(F.sum("n").alias("n"))
    return cut(own.where(F.col("n") > kept.count() / HOT_SEEDS).select("seed"), "frequent")


def _matches(kept: DataFrame) -> DataFrame:
    """kept(doc_id, pos, seed): each seed with its first occurrence, where that is in another document.

    Frequent seeds and their first occurrences are broadcast, so that no task gathers their rows. The others' rows
    meet in one shuffle, sorted by document and place.
    """
    hot = frequent_seeds(kept)
    first = kept.join(F.broadcast(hot), "seed").groupBy("seed").agg(F.min(F.struct("doc_id", "pos")).alias("first"))
    met = kept.join(F.broadcast(cut(first, "first")), "seed")
    own = Window.partitionBy("seed").orderBy("doc_id", "pos")
    rest = kept.join(F.broadcast(hot), "seed", "left_anti").withColumn("first", F.first(F.struct("doc_id", "pos")).over(own))
    both = met.unionByName(rest).where("doc_id != first.doc_id")
    return both.select("doc_id", F.col("first.doc_id").alias("rep_id"), F.struct("pos", F.col("first.pos").alias("rep_pos")).alias("m"))


def _fragments(texts: DataFrame, repeated: bool) -> DataFrame:
    """texts(doc_id, text), doc_id a key of the text: what repeated_passages() returns."""
    with scratch() as keep:
        matches = _matches(cut(seeds(texts), "seeds"))
        pairs = matches.groupBy("doc_id", "rep_id").agg(F.collect_list("m").alias("seeds")).where(F.size("seeds") > 1)
        aligned = _aligned(cut(_chained(pairs), "chains"), texts, repeated)
        size = F.greatest(F.col("stop") - F.col("start"), F.col("rep_stop") - F.col("rep_start"))
        good = aligned.withColumn("identity", F.round(F.col("matched") / size, 4)).where((F.col("stop") - F.col("start") >= MIN_FRAGMENT) & (F.col("identity") >= MIN_IDENTITY))
        good = keep(cut(good.distinct(), "fragments"))
    own = Window.partitionBy("doc_id").orderBy("start", "stop", "rep_id", "rep_start")
    reach = F.max("stop").over(own.rowsBetween(Window.unboundedPreceding, -1))
    islands = good.withColumn("new", F.coalesce((F.col("start") > reach + APART).cast("int"), F.lit(1)))
    islands = islands.withColumn("island", F.sum("new").over(own))
    whole = Window.partitionBy("doc_id", "island")
    long = islands.withColumn("words", F.max("stop").over(whole) - F.min("start").over(whole)).where(F.col("words") >= MIN_WORDS)
    return long.select("doc_id", "start", "stop", "rep_id", "rep_start", "rep_stop", "matched", "identity")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages that an earlier document has, too: (doc_id, start, stop, rep_id, rep_start, rep_stop, matched, identity).

    Positions count words, stop exclusive. Each seed's class is represented by its first occurrence (smallest
    doc_id and position); every other occurrence is matched with that one only, so a passage in a third of all
    documents gives one match for each of its seeds and documents, and no pairs among them; a passage that only one
    document repeats isn't found. The matches of two documents are chained, aligned and cut into stretches; those of
    MIN_FRAGMENT words and MIN_IDENTITY count if they and their neighbours in the document, whichever document these
    come from, make up MIN_WORDS without a gap of more than APART words. Two documents are compared if they share two kept
    seeds or more; one seed in KEEP is kept.

    Documents with null id or text have no passages. Texts that share a doc_id are documents of their own, with
    positions in their own words; rows that repeat both count once. Columns beside doc_id and text are left out,
    whatever their names. An empty table gives none. A text's words are held together, so memory is bounded by the longest.
    """
    name = free_name(docs.columns, "key")
    own, odd, repeated = keyed(docs, name)
    found = _fragments(own.where(F.col(name).isNotNull()).select(F.col(name).alias("doc_id"), "text"), repeated)
    if odd is None:
        return found
    for c in ("doc_id", "rep_id"):
        names = odd.select(F.col("key").alias(c), F.col("doc_id").alias("known"))
        found = found.join(small_side(names, 16), c, "left").withColumn(c, F.coalesce("known", c)).drop("known")
    return found.select("doc_id", "start", "stop", "rep_id", "rep_start", "rep_stop", "matched", "identity")


def _without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without words of the given ranges, and without the white space behind them. Words are walked through, not listed."""
    out, kept_from = [], 0
    ranges = iter(sorted(s for s in spans if s[0] < s[1]))
    start, stop = next(ranges, (None, None))
    until = -1  # words before this one are cut
    for i, word in enumerate(_WORD.finditer(text)):
        while start == i:
            if until < i:
                out.append(text[kept_from : word.start()])
            until = max(until, stop)
            start, stop = next(ranges, (None, None))
        if i == until:
            kept_from, until = word.start(), -1
            if start is None:
                break
    return b"".join(out) + (b"" if until >= 0 else text[kept_from:])


def remove_passages(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, n_chars, ...) with repeated passages cut from all but the first document that has them.

    n_chars is set anew where a text changed. A document of which no word is left goes. Other columns stay, whatever
    their names. Only texts with such passages are handed to Python. Rows and texts count as in repeated_passages(): each text loses its own passages only.
    """
    key, spans_name = (free_name(docs.columns, name) for name in ("key", "spans"))
    own, _, repeated = keyed(docs, key)
    with scratch() as keep:
        found = _fragments(own.where(F.col(key).isNotNull()).select(F.col(key).alias("doc_id"), "text"), repeated)
        spans = keep(cut(found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set(F.struct("start", "stop")).alias(spans_name)), "spans"))
    side, at = small_side(spans, 64), docs.columns.index("text")
    whole = own.join(side.select(key), key, "left_anti").select(docs.columns)
    held = own.join(side, key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for all_rows in batches:
            for first in range(0, all_rows.num_rows, 256):
                b = all_rows.slice(first, 256)
                texts, left = [], []
                for text, cuts in zip(b.column(at).cast(pa.large_binary()), b.column(b.num_columns - 1).to_pylist(), strict=True):
                    text = _without(text.as_py(), [(s["start"], s["stop"]) for s in cuts])
                    left.append(_WORD.search(text) is not None)
                    texts.append(text)
                columns = [pa.array(texts, pa.binary()).cast(pa.string()) if i == at else b.column(i) for i in range(b.num_columns - 1)]
                yield pa.RecordBatch.from_arrays(columns, b.schema.names[:-1]).filter(pa.array(left))

    out = held.select(*docs.columns, spans_name).mapInArrow(releasing(run), docs.schema)
    if "n_chars" in out.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.unionByName(out.select(docs.columns))
