import hashlib
import re
import tracemalloc
from contextlib import nullcontext

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tessera.llm import exact, passages, queries, simhash
from tessera.operators import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string"
SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x") for i, t in rows], SCHEMA)


def test_exact_groups_ties_nulls_and_clashing_columns(spark):
    rows = [(5, "a  b"), (3, "a\tb"), (9, "a c"), (7, None), (8, ""), (None, "a b"), (3, "a b"), (3, "zz"), (11, "q" * 5000), (10, "q" * 5000)]
    docs = table(spark, rows)
    got = exact.exact_report(docs).collect()
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    want = {}
    for i, t in rows:
        want.setdefault(norm(t), []).append(i)
    for r in got:
        group = next(v for k, v in want.items() if hashlib.sha256(k.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(group) and r.keep_id == min(i for i in group if i is not None)
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(want)
    left = exact.exact_dedup(docs)
    assert left.columns == docs.columns and sorted(norm(r.text) for r in left.collect()) == sorted(want)
    assert exact.exact_report(docs.limit(0)).count() == 0


def near(fps, bits):
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= bits:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


@pytest.mark.parametrize("limit", [1024, 4])
def test_hamming_components_by_brute_force(spark, limit):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 12).tolist()
    fps = {int(b) for b in base}
    for b in base[:4]:
        for _ in range(30):
            for k in rng.choice(64, rng.integers(1, 4), replace=False).tolist():
                b ^= 1 << k
            fps.add(int(b) & (1 << 64) - 1)
    fps = sorted(fps)
    frame = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    links = simhash.hamming_links(frame, 3, limit).collect()
    assert all(((r.src ^ r.dst) & (1 << 64) - 1).bit_count() <= 60 for r in links)
    at = {f: i for i, f in enumerate(fps)}
    root = list(range(len(fps)))
    find = lambda i: i if root[i] == i else find(root[i])
    for r in links:
        a, b = find(at[r.src % (1 << 64)]), find(at[r.dst % (1 << 64)])
        root[max(a, b)] = min(a, b)
    assert [find(i) for i in range(len(fps))] == near(fps, 3)


@pytest.mark.parametrize("bits", [3, simhash.FIRST_BITS, 64])
def test_trie_links_of_groups_with_copies_by_brute_force(bits):
    rng = np.random.default_rng(bits)
    fps = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    fps = np.concatenate((fps, fps[:40], fps[:40] ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)), np.repeat(fps[:1], 20)))
    group = rng.integers(0, 5, len(fps))
    got = [tuple(sorted(p)) for p in zip(*(x.tolist() for x in simhash.trie_links(fps, group, bits)), strict=True)]
    a, b = np.triu_indices(len(fps), 1)
    near = (group[a] == group[b]) & (np.bitwise_count(fps[a] ^ fps[b]) <= bits)
    assert sorted(got) == list(zip(a[near].tolist(), b[near].tolist(), strict=True))


def test_a_wide_budget_walks_no_pair_of_fingerprints_down_the_trie():
    fps = np.random.default_rng(5).integers(0, 1 << 64, 2 * simhash.GROUP_LIMIT, dtype=np.uint64)
    tracemalloc.start()
    try:
        simhash.trie_links(fps, np.zeros(len(fps), dtype=np.int64), simhash.FIRST_BITS)
        assert tracemalloc.get_traced_memory()[1] < 24 << 20  # node pairs of each level were held: half a million from the tenth on
    finally:
        tracemalloc.stop()


def test_simhash_query_by_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    fps = {}
    for i, t in texts.items():
        w = [x.encode().lower().decode() for x in WORD.findall(t)]
        h = [xxhash.xxh64_intdigest(" ".join(w[k : k + 3]).encode(), 42) for k in range(max(1, len(w) - 2))] if w else []
        fps[i] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fps)
    roots = near([fps[i] for i in ids], 3)
    want = {i: (f"{fps[i]:016x}", ids[r]) for i, r in zip(ids, roots, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op9_simhash(spark, SF).collect()} == want


def test_simhash_empty_and_null(spark):
    docs = table(spark, [(2, None), (1, " \t"), (3, "one two three"), (4, "ONE two\nthree"), (4, "ONE two\nthree")])
    got = sorted((r.doc_id, r.component_id) for r in simhash.simhash_components(docs).collect())
    assert got == [(1, 1), (2, 1), (3, 3), (4, 3), (4, 3)]
    assert simhash.simhash_components(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in simhash.simhash_dedup(docs).collect()) == [1, 2, 3]


def words(rng, n):
    return [f"w{i}" for i in rng.integers(0, 4000, n)]


@pytest.mark.parametrize("limit", [512, 8])
def test_near_copies_fall_with_their_text(spark, limit):
    rng = np.random.default_rng(9)
    texts = []
    for n in (60, 300, 300, 1000):
        base = words(rng, n)
        texts.append(base)
        for _ in range(20):
            w = list(base)
            for at in rng.choice(n, n // 60, replace=False).tolist():
                w[at] = "other"
            texts.append(w)
    shared = words(rng, 60)  # a passage of many documents that are no near copies
    texts += [shared + words(rng, 120) for _ in range(40)] + [words(rng, 200) for _ in range(20)]
    ids = rng.permutation(len(texts)).tolist()
    docs = table(spark, [(i, " ".join(w)) for i, w in zip(ids, texts, strict=True)] + [(900, None), (901, " "), (None, "a b"), (None, "a b")])
    # Copies have a similarity of 0.83 or more to their text and less to each other; the texts stand 21 apart.
    want = {min(ids[at : at + 21]) for at in range(0, 84, 21)} | set(ids[84:])
    left = {r.doc_id for r in simhash.simhash_dedup(docs, limit=limit).collect()}
    assert left == want | {900, 901, None}
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


@pytest.mark.parametrize("limit", [512, 64])
def test_many_copies_below_the_limit_make_no_row_for_each_pair(spark, monkeypatch, limit):
    rng = np.random.default_rng(17)
    base, texts = words(rng, 200), []
    for _ in range(240):
        w = list(base)
        for at in rng.choice(200, 3, replace=False).tolist():
            w[at] = f"own{rng.integers(1 << 40)}"
        texts.append(w)
    sets = [{tuple(w[k : k + 5]) for k in range(len(w) - 4)} for w in texts]
    likeness = {(i, j): len(sets[i] & sets[j]) / len(sets[i] | sets[j]) for i in range(240) for j in range(i + 1, 240)}
    assert sum(0.7 < x < 0.8 for x in likeness.values()) > 0.4 * len(likeness)
    near = [p for p, x in likeness.items() if x >= 0.8]
    root = list(range(240))
    for _ in range(240):
        for i, j in near:
            root[i] = root[j] = min(root[i], root[j])
    rows, cut = [], simhash.cut

    def counted(df, name):
        rows.append(cut(df, name))
        return rows[-1]

    monkeypatch.setattr(simhash, "cut", counted)
    monkeypatch.setattr(simhash, "scratch", lambda: nullcontext(lambda df: df))
    left = {r.doc_id for r in simhash.simhash_dedup(table(spark, [(i, " ".join(w)) for i, w in enumerate(texts)]), limit=limit).collect()}
    assert left == set(root)
    assert max(df.count() for df in rows) < len(likeness) // 2


def test_groups_of_near_copies_are_contracted_once(spark, monkeypatch):
    rng = np.random.default_rng(23)
    base = words(rng, 300)
    texts = [" ".join([*base[:k], "own", *base[k + 1 :]]) for k in range(0, 300, 10)]
    names, cut = [], components.cut
    monkeypatch.setattr(components, "cut", lambda df, name: names.append(name) or cut(df, name))
    left = simhash.simhash_dedup(table(spark, list(enumerate(texts)))).collect()
    # The links of nearest ones, a round or two, and what is left to connect: nothing.
    assert [r.doc_id for r in left] == [0] and len(names) <= 4


@pytest.mark.parametrize("limit", [512, 8])
def test_near_copies_around_the_limit_by_exact_similarity(spark, limit):
    rng = np.random.default_rng(13)
    texts = {}
    for n in range(200):
        base = words(rng, 400)
        copy = base[: 400 - n % 3] + words(rng, n % 5)
        for at in rng.choice(380, rng.integers(6, 13), replace=False).tolist():
            copy[at] = "other"
        texts[n], texts[n + 1000] = base, copy
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    likeness = {n: len(sets[n] & sets[n + 1000]) / len(sets[n] | sets[n + 1000]) for n in range(200)}
    assert sum(0.75 < x < 0.8 for x in likeness.values()) > 30 and sum(0.8 <= x < 0.85 for x in likeness.values()) > 30
    left = {r.doc_id for r in simhash.simhash_dedup(table(spark, [(i, " ".join(w)) for i, w in texts.items()]), limit=limit).collect()}
    wrong = [x for n, x in likeness.items() if (n + 1000 in left) == (x >= 0.8)]
    # Two with a similarity of 0.8 share one of four least hashes but for one pair in 600.
    assert set(range(200)) <= left and len(wrong) <= 1 and all(x >= 0.8 for x in wrong)


@pytest.mark.parametrize("limit", [512, 8])
def test_blocks_whose_pairs_all_differ_in_length_have_no_link(spark, limit):
    rng = np.random.default_rng(23)
    texts = {}
    for n in range(30):
        base = words(rng, 400)
        texts[n], texts[n + 100] = base, base + words(rng, 104)  # 396 of 500 shingles
        if n % 3 == 0:
            texts[n + 200] = [*base[:-1], "other"]
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in texts.items()}
    assert all(0.78 < len(sets[n] & sets[n + 100]) / len(sets[n] | sets[n + 100]) < 0.8 for n in range(30))
    left = {r.doc_id for r in simhash.simhash_dedup(table(spark, [(i, " ".join(w)) for i, w in texts.items()]), limit=limit).collect()}
    assert left == {i for i in texts if i < 200}


def test_wide_fingerprints_by_brute_force(spark):
    rng = np.random.default_rng(10)
    text = " ".join(words(rng, 700))
    h = np.unique(np.concatenate([*simhash._shingle_hashes(text.encode(), 5)]))
    mixed = [[int(simhash._mixed(np.array([x], dtype=np.uint64) + s)[0]) for s in simhash._SALTS] for x in h]
    bits = "".join(f"{int.from_bytes(int(v).to_bytes(8, 'little'), 'big'):064b}" for v in mixed[0])
    votes = np.zeros(len(bits))
    for row in mixed:
        votes += [int(x) for v in row for x in f"{int.from_bytes(int(v).to_bytes(8, 'little'), 'big'):064b}"]
    got = simhash.wide_fingerprints(table(spark, [(1, text), (2, text.upper()), (3, None)])).collect()
    want = np.packbits(votes * 2 > len(h)).view(np.int64).tolist()
    assert sorted(r.doc_id for r in got) == [1, 2] and all(r.fp == want for r in got)


def test_planted_passages_are_found_and_cut(spark):
    rng = np.random.default_rng(5)
    shared, fuzzy = words(rng, 60), words(rng, 120)
    other = list(fuzzy)
    other[30], other[61:61] = "changed", ["put", "in"]
    rows = [(1, words(rng, 80) + shared + words(rng, 50)), (2, words(rng, 300)), (3, shared + words(rng, 200)), (4, words(rng, 40) + fuzzy + words(rng, 10)), (5, words(rng, 15) + other + words(rng, 90)), (6, shared), (None, shared)]
    docs = table(spark, [(i, "  ".join(w)) for i, w in rows] + [(7, None), (8, "")])
    got = {(r.doc_id, r.rep_id): r for r in passages.repeated_passages(docs).collect()}
    # Seeds kept only at a text's border may have a later first occurrence, which is a true partner, too.
    assert {(3, 1), (5, 4), (6, 1)} <= set(got) <= {(3, 1), (5, 4), (6, 1), (6, 3)}
    assert (got[3, 1].start, got[3, 1].stop, got[3, 1].rep_start, got[3, 1].identity) == (0, 60, 80, 1)
    assert abs(got[5, 4].start - 15) <= 1 and abs(got[5, 4].stop - 137) <= 1 and got[5, 4].identity > 0.95
    left = {r.doc_id: r for r in passages.remove_passages(docs).collect()}
    assert set(left) == {1, 2, 3, 4, 5, None, 7, 8}
    assert left[3].text == "  ".join(rows[2][1][60:]) and left[3].n_chars == len(left[3].text)
    assert left[1].text == "  ".join(rows[0][1]) and len(left[5].text.split()) <= 107
    assert passages.repeated_passages(docs.limit(0)).count() == 0


def cover(spans, n):
    """Which of n words the (start, stop) spans hold."""
    held = np.zeros(n, dtype=bool)
    for start, stop in spans:
        held[start:stop] = True
    return held


def test_passages_with_own_words_between_are_found_each(spark):
    rng = np.random.default_rng(11)
    rows, own, gaps = [], {}, [15, 20, 25, 30, 35, 40, 44, 48] * 3
    for n, gap in enumerate(gaps):
        shared, one, two = [words(rng, 60) for _ in range(3)], [], []
        for k, w in enumerate(shared):
            one += (words(rng, gap) if k else words(rng, 40)) + w
            two += (words(rng, gap) if k else words(rng, 30)) + w
        rows += [(n, one + words(rng, 40)), (n + 100, two + words(rng, 40))]
        own[n + 100] = cover([(30 + k * (60 + gap), 90 + k * (60 + gap)) for k in range(3)], len(rows[-1][1]))
    got = {}
    for r in passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        assert r.rep_id == r.doc_id - 100 and r.stop - r.start >= 20 and r.identity >= 0.8
        got.setdefault(r.doc_id, []).append((r.start, r.stop))
    for i, want in own.items():
        have = cover(got.get(i, []), len(want))
        assert have[want].mean() > 0.98
        if gaps[i - 100] >= 25:
            assert have[~want].mean() < 0.05


@pytest.mark.parametrize("every", [8, 9, 10, 12])
def test_passages_with_every_few_words_changed_are_found(spark, every):
    rng = np.random.default_rng(14)
    rows = []
    for n in range(60):
        size = 55 if n % 2 else 100
        shared = words(rng, size)
        changed = [w if (k + 1) % every else f"x{n}_{k}" for k, w in enumerate(shared)]
        rows += [(n, words(rng, 40) + shared + words(rng, 40)), (n + 100, words(rng, 30) + changed + words(rng, 40))]
    held = {n + 100: [] for n in range(60)}
    for r in passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in rows])).collect():
        held[r.doc_id].append((r.start, r.stop))
    share = [cover(held[n + 100], 200)[30 : 30 + (55 if n % 2 else 100)].mean() for n in range(60)]
    # A passage of 55 words that loses a few at its ends is below the least length.
    assert np.mean([x > 0.8 for x in share[::2]]) >= 0.95 and np.mean([x > 0.8 for x in share[1::2]]) >= 0.8


def test_stretches_by_brute_force():
    rng = np.random.default_rng(12)
    for _ in range(200):
        same = rng.random(160) < rng.choice([0.2, 0.95], 8, p=[0.4, 0.6]).repeat(20)
        pairs = [(i, i) for i in np.flatnonzero(same).tolist()]
        found = passages._cut_stretches(pairs)
        sums = np.concatenate(([0], np.cumsum(np.where(same, 1, -4))))
        best = max(sums[j] - sums[i] for i in range(161) for j in range(i, 161))
        assert all(a[1] < b[0] for a, b in zip(found, found[1:], strict=False))
        spans = [(pairs[i][0], pairs[j][0] + 1) for i, j in found]
        assert all(same[a:b].mean() >= 0.8 for a, b in spans)
        # The best stretch of all lies in one of them.
        assert any(sums[b] - sums[a] == best or max(sums[j] - sums[i] for i in range(a, b) for j in range(i, b + 1)) == best for a, b in spans)


def test_lists_of_a_column_and_of_its_slices():
    rows = [["the", "é", ""], [], ["a"] * 300, ["x"]]
    column = pa.array(rows, pa.list_(pa.string()))
    assert [[*passages._lists(column.slice(at))] for at in range(5)] == [rows[at:] for at in range(5)]
    assert [*passages._lists(pa.array([[1, 2], [3]], pa.list_(pa.int32())).slice(1))] == [[3]]


def test_chains_by_brute_force():
    rng = np.random.default_rng(6)
    linked = 0
    for n in range(300):
        if n % 2:
            x, y = rng.integers(0, 300, 14), rng.integers(0, 300, 14)
        else:  # mostly in order, with gaps short and long
            x = np.cumsum(rng.integers(1, 90, 14))
            y = np.cumsum(rng.integers(1, 90, 14))
        sizes = rng.integers(5, 90, 14)
        runs = sorted(zip(x.tolist(), (x + sizes).tolist(), y.tolist(), (y + sizes).tolist(), strict=True))
        score, before = passages.link_runs(runs)
        best = []
        for xs, xe, ys, _ in runs:  # every earlier chain, asked one by one
            gains = [best[j] - passages.GAP_COST * (xs - r[1] + ys - r[3]) for j, r in enumerate(runs[: len(best)]) if r[1] <= xs and r[3] <= ys]
            best.append(xe - xs + max([0.0, *gains]))
        assert score == pytest.approx(best)
        for i, j in enumerate(before):
            if j >= 0:
                linked += 1
                gap = passages.GAP_COST * (runs[i][0] - runs[j][1] + runs[i][2] - runs[j][3])
                assert runs[j][1] <= runs[i][0] and runs[j][3] <= runs[i][2] and score[i] == pytest.approx(runs[i][1] - runs[i][0] + score[j] - gap)
    assert linked > 300


def test_a_near_run_is_chained_though_a_long_one_lies_further_back():
    x = np.concatenate((np.arange(0, 60), [100, 101], [110, 111]))
    y = np.concatenate((np.arange(0, 60), [102, 103], [113, 114]))
    assert [r[0] for r in passages.chains(x, y)[-1]][-2:] == [100, 110]


def shared_docs(rng):
    """Documents of a repeated doc_id with unrelated texts, among copies and shared passages."""
    base, passage, near = words(rng, 300), words(rng, 80), words(rng, 200)
    other = [*near[:150], "changed", *near[151:]]
    return {
        "a": (1, base), "a2": (2, base), "lone": (2, words(rng, 250)), "near": (3, near), "near2": (4, other),
        "lone4": (4, words(rng, 220)), "first": (5, words(rng, 40) + passage + words(rng, 40)), "second": (6, passage + words(rng, 90)),
        "lone6": (6, words(rng, 260)), "again": (7, words(rng, 30) + passage),
    }


def test_a_repeated_doc_id_never_decides_about_another_text(spark):
    rows = shared_docs(np.random.default_rng(21))
    names = ["_id", "_sha", "_n", "_spans", "fp", "item", "key", "least", "gone", "row", "digest", "sig", "id", "rep_id", "spans", "nth", "len", "head"]
    schema = "doc_id long, text string, n_chars int, tag string, " + ", ".join(f"{n} int" for n in names)
    docs = spark.createDataFrame([(i, " ".join(w), len(" ".join(w)), tag, *range(len(names))) for tag, (i, w) in rows.items()], schema)

    def left(frame):
        assert frame.columns == docs.columns
        return {r.tag: r.text.split() for r in frame.collect()}

    whole = {tag: w for tag, (_, w) in rows.items()}
    assert left(exact.exact_dedup(docs)) == {t: w for t, w in whole.items() if t != "a2"}
    assert left(simhash.simhash_dedup(docs)) == {t: w for t, w in whole.items() if t not in ("a2", "near2")}
    cut = left(passages.remove_passages(docs))
    assert {t: len(w) for t, w in cut.items()} == {t: len(w) for t, w in whole.items() if t not in ("a2", "near2")} | {"second": 90, "again": 30}
    assert all(cut[t] == whole[t] for t in ("a", "lone", "near", "lone4", "lone6", "first"))
    found = {(r.doc_id, r.rep_id) for r in passages.repeated_passages(docs).collect()}
    assert found == {(2, 1), (4, 3), (6, 5), (7, 5)}
    twice = docs.union(docs)
    assert sorted(r.tag for r in exact.exact_dedup(twice).collect()) == sorted(t for t in whole if t != "a2")
    assert {(r.doc_id, r.rep_id) for r in passages.repeated_passages(twice).collect()} == found


def test_picked_seeds_do_not_depend_on_neighbours():
    texts = [b"a b c d e f g h i j k l m n o p q r s t u v w x y z " * 2, b"", b"one two", b"k l m n o p q r s t u v w x y z a b c d e f g h i j"]
    whole = passages.pick_seeds(*passages.word_hashes(texts))
    for i, t in enumerate(texts):
        alone = passages.pick_seeds(*passages.word_hashes([t]))
        assert whole[2][whole[0] == i].tolist() == alone[2].tolist()


def test_pipeline_stages_keep_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs.count(), corpus_pipeline.cut(stage(spark, docs, SF), "t")
        assert docs.columns == names and 0.5 * before < docs.count() <= before, name


def edited(rng, words_, rate):
    """words_ with so many of them replaced, left out or followed by another one, a third each."""
    out = []
    for w in words_:
        if rng.random() >= rate:
            out.append(w)
            continue
        kind = rng.integers(3)
        out += [] if kind == 0 else ["other"] if kind == 1 else [w, "other"]
    return out


@pytest.mark.parametrize("n, rate, least", [(60, 0.05, 0.93), (60, 0.1, 0.82), (100, 0.125, 0.93)])
def test_passages_with_inserted_and_missing_words(spark, n, rate, least):
    rng = np.random.default_rng(21)
    rows = []
    for k in range(100):
        base = words(rng, n)
        rows.append((2 * k, words(rng, 90) + base + words(rng, 70)))
        rows.append((2 * k + 1, words(rng, 60) + edited(rng, base, rate) + words(rng, 90)))
    rows += [(1000 + k, words(rng, 300)) for k in range(100)]
    found = {r.doc_id for r in passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in rows])).collect()}
    assert len(found & set(range(1, 200, 2))) >= 100 * least
    assert not found - set(range(1, 200, 2))


def common(a, b):
    """Length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for w in a:
        last = 0
        for j, v in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if v == w else max(row[j + 1], row[j])
    return row[-1]


def test_whole_query_against_plain_rules(spark):
    """Every exact run of 50 words whose seeds first occur in one earlier document is covered, and every row found keeps the rules when worked out plainly."""
    rng = np.random.default_rng(33)
    rows, shared = [], [words(rng, int(n)) for n in rng.integers(20, 140, 12)]
    for i in range(90):
        w = words(rng, int(rng.integers(0, 120)))
        for _ in range(int(rng.integers(0, 3))):
            own = shared[int(rng.integers(len(shared)))]
            at = int(rng.integers(0, max(1, len(own) - 30)))
            own = own[at : at + int(rng.integers(20, 140))]
            w += edited(rng, own, 0.08) if rng.random() < 0.4 else own
            w += words(rng, int(rng.integers(0, 60)))
        rows.append((i, w))
    text = dict(rows)
    found = passages.repeated_passages(table(spark, [(i, " ".join(w)) for i, w in rows])).collect()
    covered = {}
    for r in found:
        a, b = text[r.doc_id][r.start : r.stop], text[r.rep_id][r.rep_start : r.rep_stop]
        size = max(len(a), len(b))
        assert r.rep_id < r.doc_id and len(a) >= 20 and common(a, b) >= r.matched >= 0.8 * size - 1e-9
        covered.setdefault(r.doc_id, set()).update(range(r.start, r.stop))
    for held in covered.values():
        places, islands = sorted(held), []
        for at in places:
            if islands and at - islands[-1][1] <= 9:
                islands[-1][1] = at
            else:
                islands.append([at, at])
        assert all(stop - start + 1 >= 50 for start, stop in islands)
    first, missed, long = {}, 0, 0
    for i, w in rows:
        own = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        for g in own:
            first.setdefault(g, i)
        for k in range(len(w) - 49):
            if len(of := {first[g] for g in own[k : k + 46]}) == 1 and of != {i}:  # all from one earlier document
                long += 50
                missed += len(set(range(k, k + 50)) - covered.get(i, set()))
    assert long > 2000 and missed == 0
