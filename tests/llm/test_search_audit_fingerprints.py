import collections
import hashlib
import itertools
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import audit, fingerprints, queries, search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, rank string, part string, score long, key string, kept boolean"
ITEMS = "item_id long, text string, rank int, doc_id string"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", "y", 3, "z", True) for i, t, lang in rows], DOCS)


def ranked(docs, items, k=20):
    of = [(i, collections.Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in of), sum(sum(c.values()) for _, c in of)
    df = collections.Counter(t for _, c in of for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        asked = collections.Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in of:
            m = 75 + 25 * sum(c.values()) * n // max(1, total)
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t, q in asked.items() if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return out


@pytest.mark.parametrize("block, postings, item_bytes", [(4096, 1 << 21, 2 << 20), (3, 1 << 21, 40), (100, 5, 2 << 20)])
def test_search_by_brute_force(spark, monkeypatch, block, postings, item_bytes):
    monkeypatch.setattr(search, "BLOCK", block)
    monkeypatch.setattr(search, "BLOCK_POSTINGS", postings)
    monkeypatch.setattr(search, "ITEM_BYTES", item_bytes)
    rng = np.random.default_rng(5)
    said = lambda n: " ".join(f"W{i}" for i in rng.zipf(1.5, n) if i < 300)
    docs = [(int(i), said(int(rng.integers(1, 60)))) for i in rng.permutation(150)]
    docs += [(7, "w1 w2"), (7, "w1 w2"), (None, "w1 w2"), (900, None), (901, " .,\x00"), (902, "Café\x85É \U0001f600 w1"), (903, "w3 " * 40_000), (904, "w3 " * 40_000)]
    items = [(1, "w1 W2 w2"), (2, said(30)), (3, "É café\x85É"), (4, None), (5, "nowhere"), (6, "w3"), (6, "w3"), (6, "w5"), (None, "w2-w9")]
    got = search.search(table(spark, [(i, t, "en") for i, t in docs]), spark.createDataFrame([(i, t, 9, "c") for i, t in items], ITEMS))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    order = lambda rows: sorted(map(str, map(tuple, rows)))
    assert order(got.collect()) == order(ranked(docs, items))


def test_search_of_empty_tables(spark):
    docs, items = table(spark, [(1, "a b", "en")]), spark.createDataFrame([(1, "a", 9, "c")], ITEMS)
    assert search.search(docs.limit(0), items).count() == 0
    assert search.search(docs, items.limit(0)).columns == ["item_id", "rank", "doc_id", "score"]
    assert search.search(docs.withColumn("text", F.lit(None).cast("string")), items).count() == 0


def audited(docs, labels):
    first = {}
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    rows = collections.defaultdict(list)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    for i, t, lang in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": t in first and (i is None or i > first[t])}
        rows[lang or ""].append(({k for k, v in fails.items() if v}, i in good, i in toxic))
    out = {}
    for part, own in rows.items():
        total = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                before = set(order[: step - 1])
                removed = [r for r in own if f in r[0] and not r[0] & before]
                total[f] += len(removed)
                out[part, "".join(order), step] = [sum(not r[0] & (before | {f}) for r in own), len(removed), sum(f in r[0] and bool(r[0] & before) for r in own), sum(r[0] == {f} for r in own), sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(total[order[step - 1]])
    return out


@pytest.mark.parametrize("chunk, held", [(8192, 4096), (5, 1)])
def test_audit_by_brute_force(spark, monkeypatch, chunk, held):
    monkeypatch.setattr(audit, "CHUNK", chunk)
    monkeypatch.setattr(audit, "HELD_PARTS", held)
    rng = np.random.default_rng(8)
    docs = []
    for i in range(160):
        w = [f"w{k}" for k in rng.integers(0, int(rng.choice([40, 4000])), int(rng.choice([20, 199, 200, 260])))]
        docs.append((i, " ".join(w) + str(rng.choice(["", " # ", "A" * 60, "\n"])), str(rng.choice(["en", "de"]))))
    docs += [(500 + i, docs[3][1], "en") for i in range(40)] + [(600, None, "en"), (601, "", None), (601, "", None), (602, "\t ", "en"), (None, docs[3][1], "fr"), (None, "only", ""), (None, "only", ""), (700, "long " * 50_000, "xx"), (701, "\x00 É \U0001f600 " * 100, "xx")]
    labels = [(i, int(rng.integers(0, 2)), int(rng.integers(0, 2))) for i in range(0, 160, 2)] + [(4, 1, 0), (4, 0, None), (None, 1, 1), (601, None, 1), (999, 1, 1)]
    marks = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, lang string")
    got = audit.audit(table(spark, docs), marks)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert {tuple(r[:3]): list(r[3:]) for r in got.collect()} == audited(docs, labels)
    assert audit.audit(table(spark, docs).limit(0), marks).count() == 0
    assert audit.audit(table(spark, docs[:5]), marks.limit(0)).agg(F.sum("good_lost")).first()[0] == 0


def mur(j, k):
    """Spark's hash() of two ints."""
    rot = lambda x, r: (x << r | x >> 32 - r) & 0xFFFFFFFF
    h = 42
    for x in (j, k):
        x = x * 0xCC9E2D51 & 0xFFFFFFFF
        h = rot(h ^ rot(x, 15) * 0x1B873593 & 0xFFFFFFFF, 13) * 5 + 0xE6546B64 & 0xFFFFFFFF
        h ^= 4
        for shift, by in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            h = (h ^ h >> shift) * by & 0xFFFFFFFF
    return h


def int_pair(j, i):
    """Spark's xxhash64() of two ints, signed; an int is hashed as four bytes."""
    h = xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(j.to_bytes(4, "little"), 42))
    return h - (1 << 64) if h >> 63 else h


def plain_fingerprint(text):
    words, bins = WORD.findall(text), {}
    low = 63 - 9
    for at in range(max(1, len(words) - 4) if words else 0):
        h = 42
        for w in words[at : at + 5]:
            h = xxhash.xxh64_intdigest(w.encode(), h)
        h &= (1 << 63) - 1
        h -= h & (1 << low) - 1 == (1 << low) - 1
        bins[h >> low] = min(bins.get(h >> low, h), h)
    if not bins:
        return [0] * 512
    out = []
    for j in range(512):
        probes = [j] + [mur(j, k) & 511 for k in range(16)]
        out.append(bins[next((p for p in probes if p in bins), None) if any(p in bins for p in probes) else min(bins, key=lambda i: (int_pair(j, i), i))] & 15)
    return out


def lanes(text):
    return [int(text[16 * k + 15 - i], 16) for k in range(32) for i in range(16)]


def plain_report(docs):
    order = sorted({(i, t or "") for i, t in docs}, key=lambda r: (r[0] is None, -(r[0] or 0)))
    following = dict(zip(order, order[1:] + order[:1], strict=True))
    near = lambda a, b: 0.0 if any(a) != any(b) else max(0.0, (sum(x == y for x, y in zip(a, b, strict=True)) / 512 - 1 / 16) / (15 / 16))
    out = []
    for i, t in docs:
        t, nxt = t or "", following[i, t or ""][1]
        k = len(t) // 3
        edited = t[: len(t) - k] + nxt[:k]
        a, b, c = map(plain_fingerprint, (t, edited, nxt))
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), a, b, round(near(a, b), 9), round(near(a, c), 9)))
    return out


def test_fingerprints_by_brute_force(spark):
    rng = np.random.default_rng(2)
    said = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 2000, n))
    docs = [(int(i), said(int(n))) for i, n in zip(rng.permutation(40) * 3, [1, 2, 4, 5, 6, 7, 12, 30, 60, 120, 250, 500, 900, 3000] * 3)]
    docs += [(500, None), (501, ""), (502, " \t\n"), (503, "é\U0001f600 x " * 50), (504, docs[3][1]), (505, "ab"), (-9, said(40)), (506, docs[9][1]), (506, docs[9][1]), (506, docs[9][1]), (None, said(50)), (508, "same " * 30_000)]
    got = fingerprints.fingerprint_report(table(spark, [(i, t, "en") for i, t in docs]).repartition(5)).collect()
    rows = sorted(str((r.doc_id, r.n_chars, r.edited_sha256, lanes(r.fingerprint), lanes(r.edited_fingerprint), round(r.near_edited, 9), round(r.near_next, 9))) for r in got)
    assert rows == sorted(map(str, plain_report(docs)))


def test_fingerprints_of_few_rows(spark):
    docs = table(spark, [(1, "a b c d e f", "en")])
    assert fingerprints.fingerprint_report(docs.limit(0)).count() == 0
    (one,) = fingerprints.fingerprint_report(docs).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a b c d a b").hexdigest()
    same = fingerprints.fingerprint_report(table(spark, [(5, "q r", "en"), (5, "s t", "en"), (5, None, "en")])).collect()
    assert len(same) == 3 and {r.n_chars for r in same} == {3, 0}


def test_fingerprints_estimate_similarity(spark):
    rng = np.random.default_rng(4)
    rows, want = [], {}
    for n in range(60):
        w = [f"w{i}" for i in rng.integers(0, 10**6, int(rng.integers(60, 900)))]
        v = list(w)
        for at in rng.choice(len(v), int(rng.integers(0, len(v) // 8)), replace=False).tolist():
            v[at] = "other"
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w, v))
        rows.append((n, " ".join(w), " ".join(v)))
        want[n] = len(a & b) / len(a | b)
    both = spark.createDataFrame(rows, "doc_id int, one string, two string")
    both = fingerprints.with_fingerprint(fingerprints.with_fingerprint(both, "one", "a"), "two", "b")
    got = {r.doc_id: r.near for r in both.select("doc_id", fingerprints.likeness("a", "b").alias("near")).collect()}
    errors = np.array([got[n] - want[n] for n in want])
    assert abs(errors.mean()) < 0.015 and np.sqrt((errors**2).mean()) < 0.035 and abs(errors).max() < 0.11


def test_fingerprint_query_runs_without_python(spark):
    plan = fingerprints.fingerprint_report(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_queries_against_plain_versions(spark):
    read = lambda t: [tuple(r) for r in t.collect()]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = read(spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text"))
    assert sorted(read(queries.op11_search(spark, SF))) == sorted(ranked(read(docs.select("doc_id", "text")), items))
    labels = read(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic"))
    assert {r[:3]: list(r[3:]) for r in read(queries.op12_filter_audit(spark, SF))} == audited(read(docs.select("doc_id", "text", "lang")), labels)
