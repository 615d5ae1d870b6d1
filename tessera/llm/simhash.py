"""SimHash near-dedup: fingerprints, a binary trie self-join within a Hamming budget, and components."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from tessera.llm.rows import digest, without
from tessera.operators.components import connected_components, joined_components
from tessera.llm.tokens import releasing
from tessera.storage import cut, scratch, small_side

#: Fingerprints of one trie that a task joins by itself; larger ones are split into node pairs first.
TRIE_LIMIT = 1024
#: Fingerprints handed to the kernel at once.
CHUNK = 8192
#: Pairs of fingerprints below two nodes of a trie up to which they are compared one by one, and pairs compared at once.
LEAF_PAIRS, PAIRS = 64, 1 << 17
#: Bits by which a large trie is deepened in a round.
STEP = 4
#: Longs of a wide fingerprint, and the bits by which two may differ in all of it and in its first long to be compared
#: exactly: at a similarity of 0.8 about 155 do, with a standard deviation of 11.5, and 10 with one of 2.9.
WIDE, NEAR_BITS, FIRST_BITS = 16, 200, 22
#: The Jaccard similarity of near copies, of their distinct shingles.
SIMILAR = 0.8
#: Least hashes by which a level deals documents into tries, the levels, and members of a trie that one task joins.
KEYS, LEVELS, GROUP_LIMIT = 4, 2, 512
#: Shingles from which on texts count as long: their blocks have fewer members.
LONG_TEXT = 1000

_SALTS = np.arange(1, WIDE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def _shingle_hashes(text: bytes, words: int) -> Iterator[np.ndarray]:
    """XXH64 of a text's word shingles, repeats included, some at a time; nothing for a text without words."""
    tokens = text.lower().split()  # bytes: A-Z only, and exactly the six ASCII white spaces
    if not tokens:
        return
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(tokens) - words + 1)
    last = ends[words - 1 :] if len(tokens) >= words else ends[-1:]
    hashed = xxhash.xxh64_intdigest
    for at in range(0, n, 1 << 15):
        part = zip(starts[at : at + (1 << 15)].tolist(), last[at : at + (1 << 15)].tolist(), strict=False)
        yield np.array([hashed(joined[s:e], 42) for s, e in part], dtype=np.uint64)


def _fingerprint(text: bytes, words: int) -> int:
    votes, n = np.zeros(64, dtype=np.int64), 0
    for h in _shingle_hashes(text, words):
        votes += np.unpackbits(h.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
        n += len(h)
    return int.from_bytes(np.packbits(votes * 2 > n).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp) per row; fp is the 64-bit SimHash of the word shingles as a signed long.

    Words are runs without ASCII white space, A-Z lower-cased; shingles count as often as they occur.
    Fewer words than a shingle: the whole sequence is the shingle. None (or a null text): zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.large_binary())
            fps = [_fingerprint(t.as_py(), words) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(0).cast("long").alias("fp")).schema)


def key_masks(max_bits: int, spare: int = 2) -> list[int]:
    """Bit masks of which at least one leaves equal keys for any two fingerprints within max_bits.

    The 64 bits form max_bits + spare blocks; that many differing bits leave at least `spare` blocks equal.
    Each mask holds one choice of `spare` blocks: a trie that starts with these bits can spend no errors there.
    """
    blocks = np.array_split(np.arange(64), max_bits + spare)
    return [sum(1 << int(b) for block in chosen for b in block) for chosen in combinations(blocks, spare)]


def trie_links(fps: np.ndarray, group: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between fingerprints (unsigned) of the same group, as pairs of positions; equal ones link, too.

    All groups are tries over one sorted array, whose nodes are ranges. The frontier holds pairs of nodes with
    the bits in which they differ so far; each level replaces a pair by the pairs of its children and prunes
    those beyond the budget. Two nodes with LEAF_PAIRS or fewer pairs of fingerprints leave it: these are compared
    directly, as a wide budget prunes next to nothing before nodes are that small.
    """
    order = np.lexsort((fps, group))
    fps, group = fps[order], group[order]
    edges = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
    alo, ahi = edges[:-1], edges[1:]
    keep = ahi - alo > 1
    alo, ahi = alo[keep], ahi[keep]
    blo, bhi, diff = alo, ahi, np.zeros(len(alo), dtype=np.int8)
    leaves = []
    for bit in range(63, -1, -1):
        few = (ahi - alo) * (bhi - blo) <= LEAF_PAIRS
        leaves.append([x[few] for x in (alo, ahi, blo, bhi)])
        alo, ahi, blo, bhi, diff = (x[~few] for x in (alo, ahi, blo, bhi, diff))
        if not len(alo):
            break
        ones = np.concatenate(([0], np.cumsum((fps >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)))
        amid, bmid = ahi - (ones[ahi] - ones[alo]), bhi - (ones[bhi] - ones[blo])
        own = alo == blo
        other = ~own
        # Children of a pair: zero with zero, one with one, and the two that differ here (one of them for a node with itself).
        alo, ahi, blo, bhi, diff = (
            np.concatenate(x)
            for x in (
                (alo, amid, alo, amid[other]),
                (amid, ahi, amid, ahi[other]),
                (blo, bmid, bmid, blo[other]),
                (bmid, bhi, bhi, bmid[other]),
                (diff, diff, diff + 1, diff[other] + 1),
            )
        )
        keep = (diff <= max_bits) & (ahi > alo) & (bhi > blo) & ~((alo == blo) & (ahi - alo < 2))
        alo, ahi, blo, bhi, diff = alo[keep], ahi[keep], blo[keep], bhi[keep], diff[keep]
    # What went down to the last bit holds one fingerprint a node, perhaps many times.
    alo, ahi, blo, bhi = (np.concatenate(x) for x in zip(*leaves, (alo, ahi, blo, bhi), strict=True))
    wide = bhi - blo
    size = (ahi - alo) * wide
    ends = np.cumsum(size)
    found = [(order[:0], order[:0])]
    for at in range(0, int(size.sum()), PAIRS):
        nth = np.arange(at, min(at + PAIRS, int(ends[-1])))
        pair = np.searchsorted(ends, nth, side="right")
        nth -= (ends - size)[pair]
        a, b = alo[pair] + nth // wide[pair], blo[pair] + nth % wide[pair]
        keep = (np.bitwise_count(fps[a] ^ fps[b]) <= max_bits) & ((alo[pair] != blo[pair]) | (a < b))
        found.append((order[a[keep]], order[b[keep]]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _spanning(a: np.ndarray, b: np.ndarray, size: int) -> np.ndarray:
    """For each of `size` positions the smallest position that the links reach."""
    root = np.arange(size)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def _links_in_tries(tries: DataFrame, max_bits: int) -> DataFrame:
    """tries(fps array<long>): a spanning forest of each trie's links, as (src, dst)."""

    def solve(lists: list[np.ndarray]) -> pa.RecordBatch:
        fps = np.concatenate(lists)
        group = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
        a, b = trie_links(fps.view(np.uint64), group, max_bits)
        root = _spanning(a, b, len(fps))
        child = np.flatnonzero(root != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[root[child]]), pa.array(fps[child])], ["src", "dst"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting, rows = [], 0
            for one in b.column(0):
                waiting.append(one.values.to_numpy(zero_copy_only=False))
                rows += len(waiting[-1])
                if rows >= CHUNK:
                    yield solve(waiting)
                    waiting, rows = [], 0
            if waiting:
                yield solve(waiting)

    return tries.mapInArrow(run, "src long, dst long")


def _split(rows: DataFrame, max_bits: int, depth: int) -> DataFrame:
    """rows(item, a, b, fp): items too large for one task, replaced by the pairs of their nodes one step deeper.

    a and b tell whether fp belongs to the item's first and second node (both, for a node with itself);
    diff counts the differing bits of the two nodes. A pair of children survives within the budget.
    """
    nib = F.shiftrightunsigned("fp", 64 - depth - STEP).bitwiseAND((1 << STEP) - 1)
    rows = rows.withColumn("nib", nib)
    nodes = rows.groupBy("item", "diff", "nib").agg(F.max("a").alias("a"), F.max("b").alias("b"), F.max(F.col("a") & F.col("b")).alias("own"))
    left = nodes.where("a").select("item", "diff", "own", F.col("nib").alias("i"))
    right = nodes.where("b").select("item", F.col("nib").alias("j"))
    pairs = left.join(right, "item").withColumn("more", F.col("diff") + F.bit_count(F.col("i").bitwiseXOR(F.col("j"))))
    pairs = pairs.where(F.col("more") <= max_bits).where("not own or i <= j")
    pairs = pairs.select("item", "i", "j", F.col("more").alias("diff"), F.xxhash64("item", "i", "j").alias("next"))
    ends = pairs.select("item", F.explode(F.array_distinct(F.array("i", "j"))).alias("nib"), "next", "i", "j", F.col("diff").alias("d"))
    out = rows.join(ends, ["item", "nib"]).where("(a and nib = i) or (b and nib = j)")
    return out.select(F.col("next").alias("item"), (F.col("a") & (F.col("nib") == F.col("i"))).alias("a"), (F.col("b") & (F.col("nib") == F.col("j"))).alias("b"), "fp", F.col("d").alias("diff"))


def hamming_links(fps: DataFrame, max_bits: int = 3, trie_limit: int = TRIE_LIMIT) -> DataFrame:
    """fps(fp), distinct: links (src, dst) that connect all fingerprints within max_bits of each other.

    The links are spanning forests, so chains of near fingerprints stay connected though not every pair is
    listed. Each mask of key_masks() deals the fingerprints into tries that share the masked bits. Tries up to
    trie_limit are joined by one task each; larger ones are traversed as node pairs across the cluster, a few
    bits a round, until each pair is small.
    """
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(_signed(m)).alias("key")) for t, m in enumerate(key_masks(max_bits))])
    dealt = fps.select("fp", F.explode(keys).alias("k")).select("fp", F.xxhash64("k.t", "k.key").alias("item"))
    sizes = dealt.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(dealt.join(sizes, "item"), "tries")
    small = met.where(F.col("n") <= trie_limit).groupBy("item").agg(F.collect_list("fp").alias("fps")).select("fps")
    found = [_links_in_tries(small, max_bits)]
    big = met.where(F.col("n") > trie_limit).select("item", F.lit(True).alias("a"), F.lit(True).alias("b"), "fp", F.lit(0).alias("diff"))
    depth = 0
    while depth < 64 and not big.isEmpty():
        rows = _split(big, max_bits, depth)
        depth += STEP
        sizes = rows.groupBy("item").agg(F.count("*").alias("n")).where("n > 1")
        rows = cut(rows.join(sizes, "item"), "node-pairs")
        small = rows.where(F.col("n") <= trie_limit).groupBy("item").agg(F.collect_list("fp").alias("fps")).select("fps")
        found.append(_links_in_tries(small, max_bits))
        big = rows.where(F.col("n") > trie_limit).drop("n")
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def simhash_components(docs: DataFrame, words: int = 3, max_bits: int = 3, trie_limit: int = TRIE_LIMIT) -> DataFrame:
    """(doc_id, fp, component_id) per row of docs; component_id is the smallest doc_id that links reach.

    Rows of equal fingerprint meet in one partial aggregate, so copies cost one row each. Null ids are kept and
    never the smallest unless a component has no other.
    """
    marked = cut(fingerprints(docs, words), "fingerprints")
    distinct = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    links = hamming_links(distinct.select("fp"), max_bits, trie_limit)
    roots = connected_components(links)
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    named = cut(named, "roots")
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return marked.join(named.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _wide_fingerprint(h: np.ndarray) -> np.ndarray:
    """WIDE words of fingerprint bits: each bit is the majority of as many independent bits as there are hashes."""
    votes = np.zeros(64 * WIDE, dtype=np.int64)
    for at in range(0, len(h), 1 << 13):
        bits = np.unpackbits(_mixed(h[at : at + (1 << 13), None] + _SALTS).view(np.uint8), axis=1)
        for row in range(0, len(bits), 255):  # sums of 255 bits fit a byte
            votes += np.add.reduce(bits[row : row + 255], axis=0, dtype=np.uint8)
    return np.packbits(votes * 2 > len(h)).view(np.int64)


def wide_fingerprints(docs: DataFrame, words: int = 5) -> DataFrame:
    """(doc_id, digest, fp, sig, size, mins) of every row that has an id and words, over its distinct word shingles.

    digest tells texts of one doc_id apart. fp is a SimHash of WIDE longs, sig a hash of all shingles, size their number. mins are the least
    shingle hashes under KEYS x LEVELS hash functions; two documents agree in each with a probability of their Jaccard similarity.
    """
    seeds = _mixed(np.arange(1, KEYS * LEVELS + 1, dtype=np.uint64))

    def lists(rows: list[np.ndarray], width: int) -> pa.Array:
        flat = np.concatenate(rows) if rows else np.empty(0, dtype=np.int64)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.array(flat, pa.int64()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, fps, sigs, sizes, mins = [], [], [], [], []
            for row, text in enumerate(b.column("text").cast(pa.large_binary())):
                parts = [*_shingle_hashes(text.as_py(), words)]
                if parts:
                    h = np.unique(np.concatenate(parts))
                    at.append(row)
                    fps.append(_wide_fingerprint(h))
                    sigs.append(xxhash.xxh64_intdigest(h.tobytes()))
                    sizes.append(len(h))
                    mins.append(np.array([_mixed(h ^ s).min() for s in seeds], dtype=np.uint64).view(np.int64))
            own = [b.column(c).take(pa.array(at, pa.int32())) for c in ("doc_id", "digest")]
            told = [pa.array(np.array(sigs, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*own, lists(fps, WIDE), *told, lists(mins, KEYS * LEVELS)], ["doc_id", "digest", "fp", "sig", "size", "mins"])

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"), "text")
    return rows.mapInArrow(releasing(run), "doc_id long, digest long, fp array<long>, sig long, size long, mins array<long>")


def shingle_sets(ids: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """(id, shingles): the set of word shingles of each class of ids(id). A class has one text of docs, named by doc_id and digest."""
    asked = cut(classes.select("id", "doc_id", "digest").join(ids.distinct(), "id"), "ids")

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                sets = [np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *_shingle_hashes(t.as_py(), words)])).view(np.int64) for t in part.column("text").cast(pa.large_binary())]
                borders = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                flat = pa.array(np.concatenate(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.ListArray.from_arrays(pa.array(borders), flat)], ["id", "shingles"])

    texts = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), digest("text").alias("digest"), "text")
    met = texts.join(small_side(asked, 32), ["doc_id", "digest"]).select("id", "text")
    return cut(met.mapInArrow(releasing(shingle), "id long, shingles array<long>").where(F.size("shingles") > 0), "sets")


def similar_links(links: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """Those of links(src, dst) between classes(id, doc_id, digest) whose sets of word shingles have a Jaccard similarity of SIMILAR or more.

    A set is made once for all pairs that it is in.
    """
    pairs = cut(links.where("src != dst").select("src", "dst").distinct(), "pairs")
    sets = shingle_sets(pairs.select(F.col("src").alias("id")).union(pairs.select("dst")), classes, docs, words)
    both = pairs.join(sets.select(F.col("id").alias("src"), F.col("shingles").alias("a")), "src").join(sets.select(F.col("id").alias("dst"), F.col("shingles").alias("b")), "dst")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near = []
            for x, y in zip(b.column("a"), b.column("b"), strict=True):
                one, two = x.values.to_numpy(), y.values.to_numpy()
                if min(len(one), len(two)) / max(len(one), len(two)) < SIMILAR:
                    near.append(False)
                    continue
                common = len(one) + len(two) - len(np.union1d(one, two))
                near.append(common / (len(one) + len(two) - common) >= SIMILAR)
            yield b.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return cut(both.select("src", "dst", "a", "b").mapInArrow(releasing(run), "src long, dst long").distinct(), "similar")


def similar_in_blocks(packed: DataFrame, classes: DataFrame, docs: DataFrame, words: int) -> DataFrame:
    """packed(i, j, src array, dst array): links (src, dst) that connect the classes of those pairs that are similar, as by similar_links().

    A pair's members are of the blocks i and j. Sets meet by pair of blocks and are compared there, so that a large
    group of copies makes a row for each member and block, and none for each pair.
    """
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("src", "dst")]
    packed = cut(packed.groupBy("i", "j").agg(*lists), "proposals")
    ids = cut(packed.select("i", "j", F.explode(F.array_distinct(F.concat("src", "dst"))).alias("id")), "block-ids")
    sets = shingle_sets(ids.select("id"), classes, docs, words)
    members = ids.join(sets, "id").groupBy("i", "j").agg(F.collect_list(F.struct("id", "shingles")).alias("members"))

    def compare(ids: np.ndarray, sets: pa.ListArray, src: np.ndarray, dst: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        borders = sets.offsets.to_numpy()
        distinct, at = np.unique(sets.values.to_numpy()[borders[0] : borders[-1]], return_inverse=True)
        borders = (borders - borders[0]).astype(np.int64)
        size, order = np.diff(borders), np.argsort(ids)
        src, dst = (order[np.searchsorted(ids, x, sorter=order)] for x in np.unique(np.stack([src, dst]), axis=1))
        fit = np.minimum(size[src], size[dst]) >= SIMILAR * np.maximum(size[src], size[dst])  # no similar ones beyond
        if not fit.any():
            return ids[:0], ids[:0]
        src, dst = src[fit], dst[fit]
        turn = np.argsort(src, kind="stable")
        src, dst = src[turn], dst[turn]
        held, near = np.zeros(len(distinct), dtype=bool), np.zeros(len(src), dtype=bool)
        firsts = np.flatnonzero(np.concatenate(([True], src[1:] != src[:-1])))
        for first, last in zip(firsts.tolist(), [*firsts[1:].tolist(), len(src)], strict=True):
            own = at[borders[src[first]] : borders[src[first] + 1]]
            held[own] = True
            for k in range(first, last):
                other = at[borders[dst[k]] : borders[dst[k] + 1]]
                common = np.count_nonzero(held[other])
                near[k] = common / (len(own) + len(other) - common) >= SIMILAR
            held[own] = False
        root = _spanning(src[near], dst[near], len(ids))
        child = np.flatnonzero(root != np.arange(len(ids)))
        return ids[root[child]], ids[child]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                own = b.column("members")[row].values
                pair = [b.column(c)[row].values.to_numpy() for c in ("src", "dst")]
                found = compare(own.field("id").to_numpy(), own.field("shingles"), *pair)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["src", "dst"])

    met = members.join(packed, ["i", "j"]).select("members", "src", "dst")
    return cut(met.mapInArrow(releasing(run), "src long, dst long").distinct(), "similar")


def _near_in_groups(lists: list[pa.Array], max_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Positions a and b of open members of one group and different root within max_bits, the bits they differ in, and all members.

    The trie is made of the first 64 bits; pairs that stay within FIRST_BITS there go on to the other bits.
    """
    members = pa.concat_arrays(lists)
    roots, open_ = (members.field(c).to_numpy(zero_copy_only=False) for c in ("root", "open"))
    fps = members.field("fp").flatten().to_numpy().view(np.uint64).reshape(-1, WIDE)
    group = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    a, b = trie_links(fps[:, 0], group, FIRST_BITS)
    near = (open_[a] | open_[b]) & (roots[a] != roots[b])
    a, b = a[near], b[near]
    diff = np.zeros(len(a), dtype=np.int64)
    for w in range(WIDE):
        diff += np.bitwise_count(fps[a, w] ^ fps[b, w])
        near = diff <= max_bits
        a, b, diff = a[near], b[near], diff[near]
    return a, b, diff, members


def _by_chunks(solve: Callable[[list[pa.Array]], pa.RecordBatch]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """solve() of about CHUNK members at once, of whole groups; of fewer where groups are over GROUP_LIMIT, as pairs go with the square."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            waiting, rows = [], 0
            for one in b.column(0):
                waiting.append(one.values)
                rows += len(waiting[-1]) * max(len(waiting[-1]), GROUP_LIMIT) // GROUP_LIMIT
                if rows >= CHUNK:
                    yield solve(waiting)
                    waiting, rows = [], 0
            if waiting:
                yield solve(waiting)

    return releasing(run)


def _nearest_in_groups(groups: DataFrame, max_bits: int) -> DataFrame:
    """groups(members array<struct<id, open, root, fp>>): links (src, dst) of each member with its nearest of a smaller id."""

    def solve(lists: list[pa.Array]) -> pa.RecordBatch:
        a, b, diff, members = _near_in_groups(lists, max_bits)
        ids = members.field("id").to_numpy()
        src, dst = np.minimum(ids[a], ids[b]), np.maximum(ids[a], ids[b])
        at = np.lexsort((src, diff, dst))
        src, dst = src[at], dst[at]
        first = np.concatenate(([True], dst[1:] != dst[:-1]))[: len(dst)]
        return pa.RecordBatch.from_arrays([pa.array(src[first]), pa.array(dst[first])], ["src", "dst"])

    return groups.mapInArrow(_by_chunks(solve), "src long, dst long")


def _pairs_in_groups(groups: DataFrame, max_bits: int) -> DataFrame:
    """groups(members array<struct<id, open, root, fp, block>>): all their pairs, in one row (i, j, src array, dst array) for each pair of blocks."""

    def solve(lists: list[pa.Array]) -> pa.RecordBatch:
        a, b, _, members = _near_in_groups(lists, max_bits)
        ids, blocks = (members.field(c).to_numpy() for c in ("id", "block"))
        turn = (blocks[a] > blocks[b]) | ((blocks[a] == blocks[b]) & (ids[a] > ids[b]))
        a, b = np.where(turn, b, a), np.where(turn, a, b)
        at = np.lexsort((blocks[b], blocks[a]))
        i, j = blocks[a[at]], blocks[b[at]]
        first = np.flatnonzero(np.concatenate((i[:1] == i[:1], (i[1:] != i[:-1]) | (j[1:] != j[:-1]))))
        borders = pa.array(np.append(first, len(i)).astype(np.int32))
        pairs = [pa.ListArray.from_arrays(borders, pa.array(ids[x[at]])) for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(i[first]), pa.array(j[first]), *pairs], ["i", "j", "src", "dst"])

    return groups.mapInArrow(_by_chunks(solve), "i long, j long, src array<long>, dst array<long>")


def _live(rows: DataFrame) -> DataFrame:
    """rows with the number of members (n) and open members (opens) of their item, where these have pairs to compare."""
    sizes = rows.groupBy("item").agg(F.count("*").alias("n"), F.count_if("open").alias("opens")).where("n > 1 and opens > 0")
    return cut(rows.join(small_side(cut(sizes, "sizes"), 24), "item"), "groups")


def _members(rows: DataFrame, *more: str) -> DataFrame:
    return rows.groupBy("item").agg(F.collect_list(F.struct("id", "open", "root", "fp", *more)).alias("members")).select("members")


def _blocks(tries: DataFrame, classes: DataFrame, half: int) -> DataFrame:
    """(id, block) of all members of tries(trie, n, id): blocks of about `half` members, or the shingles of so many long texts, of an id's largest trie."""
    home = tries.groupBy("id").agg(F.max(F.struct("n", "trie"))["trie"].alias("home"))
    home = home.join(classes.select("id", "size"), "id")
    parts = home.groupBy("home").agg(F.ceil(F.greatest(F.count("*") / half, F.sum("size") / (half * LONG_TEXT))).alias("parts"))
    return home.join(parts, "home").select("id", F.xxhash64("home", F.pmod(F.xxhash64("id"), F.col("parts"))).alias("block"))


def near_components(classes: DataFrame, similar: Callable[[DataFrame], DataFrame], similar_packed: Callable[[DataFrame], DataFrame], max_bits: int, limit: int = GROUP_LIMIT) -> DataFrame:
    """classes(id, fp, size, mins), as by wide_fingerprints() without repeats: (node, component) of those connected by similar ones within max_bits.

    A trie holds the fingerprints that share one of the first KEYS least hashes, which two documents with a
    similarity of 0.8 do with a probability of 0.998. Tries up to `limit` are joined by one task each. In larger ones
    every member that is similar to a pivot is linked to it and closed: from then on it is compared with open
    members only. If open ones are left, the next KEYS least hashes deal the trie into smaller ones. What is still
    too large after LEVELS of them is compared whole: blocks of open members with every block.

    Tries only propose: similar() tells which links count. It is first asked about each member's nearest one. All pairs
    that these links leave in different components go to similar_packed(), many in a row.
    """
    keyed = lambda level: F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col("mins")[level * KEYS + k].alias("m")) for k in range(KEYS)])).alias("key")
    rows = classes.select("id", "fp", "mins", F.lit(True).alias("open"), keyed(0)).withColumn("item", F.xxhash64("key.k", "key.m")).drop("key")
    groups, found = [], []
    for level in range(1, LEVELS + 1):
        live = _live(rows)
        groups.append(live.where(F.col("n") <= limit).select("item", F.col("item").alias("trie"), "n", "id", "open", "fp"))
        big = live.where(F.col("n") > limit).drop("n", "opens")
        if big.isEmpty():
            break
        pivots = big.where("open").groupBy("item").agg(F.min_by(F.struct("id", "fp"), F.struct(F.xxhash64("id"), "id")).alias("pivot"))
        differ = F.aggregate(F.zip_with("fp", "pivot.fp", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
        told = cut(big.join(small_side(pivots, 300), "item").withColumn("src", F.when(differ <= max_bits, F.col("pivot.id"))).drop("pivot"), "pivots")
        found.append(similar(told.where("src != id").select("src", F.col("id").alias("dst"))))
        near = found[-1].select("src", F.col("dst").alias("id"), F.lit(True).alias("near"))
        told = told.join(small_side(near, 24), ["src", "id"], "left")
        rows = told.select("id", "fp", "mins", (F.col("open") & F.col("near").isNull() & ~F.col("src").eqNullSafe(F.col("id"))).alias("open"), "item")
        if level < LEVELS:
            rows = rows.select("id", "fp", "mins", "open", "item", keyed(level)).withColumn("item", F.xxhash64("item", "key.k", "key.m")).drop("key")
    else:
        live = _live(rows)
        few = F.ceil(F.col("opens") / limit)
        block = F.when(F.col("open"), F.pmod(F.xxhash64("id"), few)).otherwise(few + F.pmod(F.xxhash64("id"), F.ceil((F.col("n") - F.col("opens")) / limit)))
        live = live.withColumn("block", block)
        blocks = live.select("item", "block", "open").distinct()
        pairs = blocks.where("open").select("item", F.col("block").alias("i")).join(blocks.select("item", F.col("block").alias("j")), "item").where("i <= j")
        ends = pairs.select("item", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        dealt = live.join(ends, ["item", "block"])
        groups.append(cut(dealt.select(F.xxhash64("item", "i", "j").alias("item"), F.col("item").alias("trie"), "n", "id", "open", "fp"), "blocks"))
    alone = [_nearest_in_groups(_members(g.withColumn("root", F.monotonically_increasing_id())), max_bits) for g in groups]
    found.append(similar(_union(alone)))
    roots = connected_components(_union(found))
    blocks = _blocks(_union([g.select("trie", "n", "id") for g in groups]), classes, limit // 2)
    told = cut(blocks.join(roots.select(F.col("node").alias("id"), "component"), "id", "left").select("id", "block", F.coalesce("component", "id").alias("root")), "told")
    named = [g.join(told, "id") for g in groups]
    rest = similar_packed(_union([_pairs_in_groups(_members(g, "block"), max_bits) for g in named]))
    return joined_components(roots, rest)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.union(more)
    return out


def simhash_dedup(docs: DataFrame, words: int = 5, max_bits: int = NEAR_BITS, limit: int = GROUP_LIMIT) -> DataFrame:
    """docs with one document of each near-duplicate group: the one with the smallest doc_id. All columns stay, whatever their names.

    Near means a Jaccard similarity of SIMILAR or more of the distinct word shingles, compared exactly where the
    fingerprints of 1024 bits differ in max_bits or less (and in FIRST_BITS or less of their first 64). Documents are told
    apart by doc_id and text, so texts that share a doc_id are compared like any others (of equal ones the least
    digest stays), and rows that repeat both stay or go together. Rows without a doc_id or words stay.
    An empty table gives none. A text's shingle hashes are held together, so memory is bounded by the longest text.
    """
    with scratch() as keep:
        marked = cut(wide_fingerprints(docs, words), "fingerprints")
        rep = F.min(F.struct("doc_id", "digest")).alias("rep")
        classes = marked.groupBy("sig").agg(rep, *[F.first(c).alias(c) for c in ("fp", "size", "mins")], F.count("*").alias("rows"))
        classes = cut(classes.select(F.col("sig").alias("id"), "rep.doc_id", "rep.digest", "fp", "size", "mins", "rows"), "classes")
        asked = [lambda links, f=f: f(links, classes, docs, words) for f in (similar_links, similar_in_blocks)]
        roots = near_components(classes.select("id", "fp", "size", "mins"), *asked, max_bits, limit)
        named = classes.select("id", "doc_id", "digest", "rows").join(roots, F.col("id") == F.col("node"), "left").withColumn("root", F.coalesce("component", "id")).drop("node", "component")
        named = cut(named, "roots")
        kept = named.groupBy("root").agg(F.min(F.struct("doc_id", "digest")).alias("kept"), F.sum("rows").alias("rows")).where("rows > 1").drop("rows")
        company = cut(named.select("id", "root").join(small_side(cut(kept, "kept"), 40), "root").select("id", "kept"), "company")
        rows = marked.select("doc_id", "digest", F.col("sig").alias("id")).join(small_side(company, 40), "id")
        gone = rows.where("doc_id != kept.doc_id or digest != kept.digest").select("doc_id", "digest").distinct()
        gone = keep(cut(gone, "copies"))
    return without(docs, gone)
