import collections
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, quality, queries, urls

M = quality.MARK


def windows(text, order):
    letters = M * (order - 1) + " ".join(text.split()) + " "
    return [letters[e - order : e] for e in range(order, len(letters) + 1)] if text.split() else []


def brute(texts, order, text):
    """log probability of a text's letters by interpolated modified Kneser-Ney, counted plainly."""
    count = [collections.Counter() for _ in range(order + 1)]
    count[order] = collections.Counter(g for t in texts for g in windows(t, order))
    for k in range(order - 1, 0, -1):
        for g in count[k + 1]:
            count[k][g[1:]] += 1
    rate = [[]]
    for k in range(1, order + 1):
        n = [sum(c == i for c in count[k].values()) for i in range(5)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0
        rate.append([0, *(max(0.01, min(i - 0.01, i - (i + 1) * y * n[i + 1] / n[i] if n[1] and n[i] else 0.5 * i)) for i in (1, 2, 3) if i < 4)])
        for i in (1, 2, 3):
            above = n[i + 1] if i + 1 < 5 else 0
            rate[k][i] = max(0.01, min(i - 0.01, i - (i + 1) * y * above / n[i] if n[1] and n[i] else 0.5 * i))
    letters = len(count[1]) + 1

    def p(g):
        k = len(g)
        below = p(g[1:]) if k > 1 else 1 / letters
        own = {h: c for h, c in count[k].items() if h[:-1] == g[:-1]}
        if not own:
            return below
        total, left = sum(own.values()), sum(rate[k][min(3, c)] for c in own.values())
        c = count[k].get(g, 0)
        return (c - rate[k][min(3, c)] if c else 0) / total + left / total * below

    return sum(math.log(p(g)) for g in windows(text, order))


@pytest.mark.parametrize("most, held", [(10**6, 10**6), (40, 30), (0, 10**6)])
def test_kneser_ney_by_brute_force(spark, monkeypatch, most, held):
    monkeypatch.setattr(quality, "HELD_GRAMS", held)
    texts = ["the cat sat on the mat", "a dog sat in the sun and the cat ran", "on and on the dog ran"]
    asked = ["the", "catnip  on", "zebra", "o", "sat\tdogs dogs", "on the mat the", None, "", "\u65e5\U0001f600 \u0002\0x", "the " * 30]
    rows = [(None, t, "en", True) for t in texts] + [(i, t, "en", False) for i, t in enumerate(asked)] + [(99, "x y", "xx", False), (99, "z", None, False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, counted boolean").coalesce(2)
    grams = quality.count_grams(docs)
    plain = collections.Counter(g for _, t, lang, _ in rows if lang == "en" for g in windows((t or "").replace(M, "\ufffd").replace("\0", "\ufffd"), quality.ORDER))
    assert {r.gram: r.n for r in grams.where("lang = 'en'").collect()} == plain
    resolved = quality.resolve(grams, quality.train(grams))
    got = {r.doc_id: r for r in quality.score(docs.where("not counted"), resolved, most=most).collect()}
    for i, t in enumerate(asked):
        t = (t or "").replace(M, "\ufffd").replace("\0", "\ufffd")
        assert got[i].logp == pytest.approx(brute(texts, quality.ORDER, t), rel=1e-9)
        assert got[i].letters == sum(len(w) + 1 for w in t.split())
    assert got[99].logp is None and got[7].letters == 0 and got[7].variety is None and got[9].variety == pytest.approx(1 / 29)


def test_chunks_of_a_long_text_do_not_change_counts(spark, monkeypatch):
    docs = spark.createDataFrame([("one two three four " * 40, "en", True)], "text string, lang string, counted boolean")
    want = {(r.gram, r.n) for r in quality.count_grams(docs).collect()}
    monkeypatch.setattr(quality, "CHUNK", 7)
    assert {(r.gram, r.n) for r in quality.count_grams(docs).collect()} == want


def test_hash_table_finds_what_it_holds():
    rng = np.random.default_rng(4)
    keys = np.unique(np.concatenate((rng.integers(0, 1 << 63, 3000).astype(np.uint64), np.arange(64, dtype=np.uint64) << np.uint64(20))))
    table = quality.Table(keys, keys.astype(np.float64))
    value, there = table.find(np.concatenate((keys, keys + np.uint64(1))))
    assert there[: len(keys)].all() and (value[: len(keys)] == keys.astype(np.float64)).all()
    assert there[len(keys) :].tolist() == np.isin(keys + np.uint64(1), keys).tolist()


def test_quality_by_labels_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    good, bad = [r.keep for r in rows if r.quality == 1], [r.keep for r in rows if r.quality == 0]
    assert sum(good) >= 0.995 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_rejected_rows_go_by_text_and_other_columns_stay(spark):
    rows = [(i, "the cat sat on the mat and the dog ran", "en", "a", 1) for i in range(40)] + [(i, "QX!! ZZ!! VJ!! KW!!", "en", "b", 2) for i in range(30, 50)] + [(None, "the cat", "en", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, digest string, perplexity int")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(25)] + [(i, 0, 1) for i in range(40, 50)] + [(3, 1, 1)], "doc_id long, quality int, toxic int")
    left = quality.keep_good(docs, labels)
    assert left.columns == docs.columns and sorted(left.collect(), key=str) == sorted(docs.where("digest != 'b'").collect(), key=str)


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.keep for r in quality.judge(docs, labels).collect())
    assert quality.judge(docs.limit(0), labels).count() == 0


def test_escapes_are_reversible(spark):
    texts = ["", "<", "\\", "<\\", "[\\[", "</s>[INST] x [/INST]", "<|end|>\\\\", "a<|text|>b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e")).withColumn("u", chat.unescape(F.col("e"))).collect()
    assert all(r.t == r.u and "<|" not in r.e and "[I" not in r.e and "</" not in r.e for r in rows)


def test_reply_trees_pick_the_best_branch(spark):
    nodes = spark.createDataFrame([("t", 1, None, 0), ("t", 2, 1, 5), ("t", 3, 1, 9), ("t", 4, 2, 9), ("t", 5, 99, 1), ("u", 1, None, None)], "tree string, node int, parent int, score int")
    paths = {}
    for r in chat.root_to_leaf_paths(nodes).collect():
        paths.setdefault((r.tree, r.leaf), []).append((-r.up, r.node))
    assert {k: [n for _, n in sorted(v)] for k, v in paths.items()} == {("t", 3): [1, 3], ("t", 4): [1, 2, 4], ("t", 5): [5], ("u", 1): [1]}
    best = {(r.tree, r.leaf) for r in chat.best_paths(nodes).collect()}
    assert best == {("t", 4), ("u", 1)}
    circle = spark.createDataFrame([("t", 1, 2, 0), ("t", 2, 1, 0), ("t", 3, 2, 0)], "tree string, node int, parent int, score int")
    with pytest.raises(ValueError):
        chat.root_to_leaf_paths(circle)


def test_conversations_with_nulls_ties_and_long_threads(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 1, "assistant", "<b"), (1, 1, "assistant", "<b"), (None, None, None, None)] + [(2, i, "assistant", str(i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_conversations(frame)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("assistant", ""), ("assistant", "<b"), ("assistant", "<b")]
    assert got[1].loss_text == "<b<b" and [t.text for t in got[None].turns] == [""]
    assert got[2].loss_text == "".join(map(str, range(40)))
    assert chat.format_conversations(frame.limit(0)).count() == 0


def test_urls_split_and_rules(spark):
    rows = [("HTTP://WWW.A.Net/x?y#z", "www.a.net", "/x", "net/"), ("http://example.net/en/1", "example.net", "/en/1", "example.net/en/"), ("a://b.org/fr/", "b.org", "/fr/", "org/fr/"), ("http://notexample.com/de/", "notexample.com", "/de/", None), ("http://q.net?x", "q.net", "", None), ("no scheme", "", "", None), (None, "", "", None), ("x://É.example.COM/de/#", "É.example.com", "/de/", "example.com/de/")]
    pages = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "page_id long, url string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = sorted(urls.judge_urls(pages, labels).collect())
    assert [(r.host, r.path, r.rule) for r in got] == [r[1:] for r in rows]
    assert [r.verdict for r in got] == ["block", "allow", "allow", "allow", "allow", "allow", "allow", "block"]
    assert urls.judge_urls(pages.limit(0), labels).count() == 0


def test_mined_rules_by_brute_force(spark):
    sets = [({"a", "b"}, True)] * 6 + [({"a"}, False)] * 6 + [({"b", "c"}, False)] * 5 + [({"a", "b", "c"}, True)] * 3
    frame = spark.createDataFrame([(sorted(s), b) for s, b in sets], "tokens array<string>, bad boolean")
    rules = urls.mine_rules(frame, min_support=0.1, min_count=2, min_confidence=0.8, min_lift=1.5)
    want = {}
    for n in range(1, 4):
        for x in itertools.combinations("abc", n):
            own = [b for s, b in sets if set(x) <= s]
            if sum(own) >= 2 and sum(own) / len(own) >= 0.8 and sum(own) / len(own) / 0.45 >= 1.5:
                want[x] = sum(own) / len(own)
    assert {tuple(sorted(r.antecedent)): r.confidence for r in rules.collect()} == pytest.approx(want) and want
    matched = urls.match_rules(frame.select("tokens").distinct(), rules).collect()
    assert {tuple(r.tokens): r.confidence for r in matched} == {tuple(sorted(s)): max(c for x, c in want.items() if set(x) <= s) for s in ({"a", "b"}, {"a", "b", "c"})}


def test_a_bad_host_is_blocked_however_large_the_table(spark):
    rows = [(i, f"http://{'bad.example.info' if i < 12 else f'h{chr(97 + i % 26)}.example.info'}/x", 0 if i < 12 or i % 40 == 0 else 1) for i in range(4000)]
    frame = spark.createDataFrame(rows, "page_id long, url string, quality int")
    labels = frame.select(frame.page_id.alias("doc_id"), "quality").selectExpr("*", "0 as toxic")
    got = {r.page_id for r in urls.judge_urls(frame.select("page_id", "url"), labels).collect() if r.verdict == "block"}
    assert got == set(range(12))


def test_token_sets_beyond_the_broadcast_limit_match_alike(spark):
    pages = spark.createDataFrame([(i if i else None, ["h=a"] if i % 4 else ["h=b", "p=é"]) for i in range(40)] + [(7, [])], "page_id long, tokens array<string>")
    matched = spark.createDataFrame([(["h=b", "p=é"], 0.75)], "tokens array<string>, confidence double")
    small, large = (sorted(map(str, urls.with_confidence(pages, matched, limit).select("page_id", "tokens", "confidence").collect())) for limit in (1 << 20, 0))
    assert small == large and len(small) == 41 and sum("0.75" in r for r in small) == 10


def test_url_verdicts_do_not_change_with_repeated_rows(spark):
    rng = np.random.default_rng(12)
    rows = []
    for i in range(400):
        bad = i % 4 == 0
        rows.append((i, f"https://{'casino' if bad and i % 12 else 'news'}{i % 3}.example.org/{'win' if bad else 'read'}/{rng.integers(0, 9)}?id={i}", "x", "y", True))
    rows += [(500, None, "x", "y", False), (501, "no scheme", "x", "y", False), (502, "https://casino1.example.org/win/" + "a/" * 20_000, "x", "y", False)]
    pages = spark.createDataFrame(rows, "page_id long, url string, tokens string, host string, bad boolean")
    labels = spark.createDataFrame([(i, 0 if i % 4 == 0 else 1, None, "z") for i in range(300)] + [(None, 0, 1, "z")], "doc_id long, quality int, toxic int, url string")
    told = lambda p, m: sorted({tuple(r) for r in urls.judge_urls(p, m).collect()}, key=str)
    want = told(pages, labels)
    assert sum(r[-1] == "block" for r in want) > 60 and len(want) == len(rows)
    again = labels.union(labels).union(labels.where("doc_id % 8 = 0"))
    assert told(pages, again) == want
    some = pages.where("page_id % 3 = 0")
    assert told(pages.union(some).union(some), labels) == want and urls.judge_urls(pages.union(some), labels).count() == len(rows) + some.count()
    mixed = labels.union(labels.where("quality = 0").withColumn("quality", F.lit(1)))
    assert told(pages, mixed) == want
    assert urls.judge_urls(pages.limit(0), labels).count() == 0
    assert {r[-1] for r in told(pages, labels.limit(0))} == {"allow"}
