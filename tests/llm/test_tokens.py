import hashlib
import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, packing, queries, tokenfile, tokens

BYTE, WORD = queries.BYTE_BPE, queries.WORD_BPE
TEXTS = [
    "", None, "  a  b ", "x<|endoftext|> y <|endoftext|>", "a \n b\n\n  c\t d ", "\x1c x\x85y  z", "a" * 1300, "don't  WE'LL they've",
    "日本語 テキスト 😀😀 é é", "<|ENDOFTEXT|> <|startoftext|>abc İSTANBUL ΣΑΣ", "0123456789 12 3½", "    ", "\n", "   x",
    "a​b ﻿ c", "<|endoftext|", "x" * 3000 + " yy", "The and attion to thanedble the. " * 400, "same", "same",
]
DOCS = [(i if i % 7 else None, t, f"extra{i}") for i, t in enumerate(TEXTS)]
SCHEMA = "doc_id long, text string, ids string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, SCHEMA).repartition(3)


def ids_of(path, text):
    return Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids


def test_bpe_equals_library_and_decodes(docs):
    library = Tokenizer.from_file(BYTE)
    got = bpe.bpe_decode(bpe.bpe_encode(docs, BYTE), BYTE).collect()
    want = [(i, ids_of(BYTE, t)) for i, t, _ in DOCS]
    assert sorted((str(r.doc_id), np.frombuffer(r.ids, "<u4").tolist()) for r in got) == sorted((str(i), x) for i, x in want)
    assert sorted(r.text for r in got) == sorted(library.decode(x, skip_special_tokens=False) for _, x in want)


#: Quotes behind punctuation, white space of all kinds, added tokens and parts of them, letters of several scripts.
BITS = ["f('s')", "a]'s", "'s", "'re", "'", "!'ll", "x", "word", "The", " ", "  ", "   ", "\n", "\n\n", "\t", "\x1c", "\x85", "\xa0", "\u3000", "<", "<|", "|>", "<|endoftext|>", "<b>", "(", "]", ";", ".", "1", "23", "½", "é", "ß", "日本", "😀", "e\u0301", "İ", "\u200b", "\ufeff", "_", "==", '"', "don't", "'S", "\r\n", "²", "\x00"]


@pytest.mark.parametrize("encoder, path, kind", [(bpe._encoder, BYTE, "<u4"), (tokens.byte_texts, BYTE, "<u2"), (tokens.plain_texts, WORD, "<u2")])
def test_random_strings_equal_library(encoder, path, kind):
    rng, library = random.Random(7), Tokenizer.from_file(path)
    texts = ["".join(rng.choices(BITS, k=rng.randint(0, 14))) for _ in range(20_000)] + ["x ('re) <b>", "if (x < y) { t('save'); }", "a  <|endoftext|>  'll"]
    want = library.encode_batch_fast(texts, add_special_tokens=False)
    wrong = [t for t, got, w in zip(texts, encoder(path).texts(texts), want, strict=True) if np.frombuffer(got, kind).tolist() != w.ids]
    assert wrong == []


def test_one_very_long_text_and_one_very_long_word():
    for text in ("The and attion's to thanedble, (the) " * 20_000, "ab" * 50_000):
        want = np.array(ids_of(BYTE, text), "<u4").tobytes()
        assert bpe._encoder(BYTE).texts([text]) == [want]


def test_compatible_pairs_by_merging():
    vocabulary = bpe._vocabulary(BYTE)
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 50_000, 4000), rng.integers(0, 50_000, 4000)
    b[:1000] = a[:1000]
    same = rng.integers(0, 600, (2, 2000))
    a, b = np.concatenate((a, same[0])), np.concatenate((b, same[1]))
    want = [vocabulary.merge(vocabulary.bytes_of[x] + vocabulary.bytes_of[y]) == [x, y] for x, y in zip(a.tolist(), b.tolist(), strict=True)]
    assert vocabulary.compatible(a, b).tolist() == want
    assert 0 < sum(want) < len(want)


def test_long_pieces_merge_alike():
    vocabulary = bpe._vocabulary(BYTE)
    for piece in (b"thereforetheaaaaabababa" * 3, b"a" * 77, bytes(range(97, 123)) * 2):
        assert vocabulary.merge(piece) == ids_of(BYTE, piece.decode())


def test_cache_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 2)
    monkeypatch.setattr(tokens, "CACHE_PIECES", 2)
    cache = tokens.plain_texts.__wrapped__(WORD)
    for text in [t for t in TEXTS if t] * 2:
        assert np.frombuffer(cache.texts([text])[0], "<u2").tolist() == ids_of(WORD, text)


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))


def test_packing_covers_every_id_once(docs):
    pieces = packing.pack(docs, BYTE, length=64)
    rows = sorted(pieces.collect(), key=lambda r: (r.sequence_id, r.offset))
    stream = [i for _, t, _ in in_order(DOCS) for i in [*ids_of(BYTE, t), 0]]
    assert [i for r in rows for i in np.frombuffer(r.ids, "<u2").tolist()] == stream
    at = 0
    for r in rows:
        assert r.sequence_id * 64 + r.offset == at and r.length == len(r.ids) // 2
        at += r.length
    crcs = packing.with_crc(pieces).collect()
    assert sorted(r.ids_crc32 for r in crcs) == sorted(zlib.crc32(np.frombuffer(r.ids, "<u2").astype("<u4").tobytes()) for r in rows)
    at_once = packing.pack(docs, BYTE, length=64, crc=True)
    beside = packing.with_crc(pieces, keep_ids=True)
    assert at_once.columns == beside.columns and sorted(map(str, at_once.collect())) == sorted(map(str, beside.collect()))
    whole = {r.sequence_id: r.ids for r in packing.sequences(pieces, 64).collect()}
    assert [len(whole[k]) for k in sorted(whole)][:-1] == [64] * (len(whole) - 1)
    assert [i for k in sorted(whole) for i in whole[k]][: len(stream)] == stream


def test_token_files_read_back(docs, monkeypatch):
    segments = tokenfile.write_token_files(docs, WORD)
    got = sorted(tokenfile.read_documents(segments).collect(), key=lambda r: r.start)
    at = 0
    for (name, text, _), r in zip(in_order(DOCS), got, strict=True):
        ids = np.array([*ids_of(WORD, text), 1], dtype="<u4")
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (name, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_elias_fano_selects():
    rng = np.random.default_rng(2)
    for n, most in ((1, 1), (1, 10**6), (7, 3), (1000, 5), (3000, 10**7)):
        values = np.sort(rng.integers(0, most + 1, n))
        coded = tokenfile.EliasFano.from_bytes(memoryview(tokenfile.EliasFano.of(values, most + 1).to_bytes()))
        assert coded.values().tolist() == values.tolist()
        assert [coded.select(i) for i in range(n)] == values.tolist()
    bits = 8 * len(tokenfile.EliasFano.of(np.arange(0, 10**6, 1000), 10**6).to_bytes()) / 1000
    assert bits < 14


def test_segments_close_and_find_documents():
    parts = [np.array([5, 1], "<u2").tobytes(), np.array([1], "<u2").tobytes(), np.array([7, 8, 9, 1], "<u2").tobytes()]
    segment = tokenfile.Segment(memoryview(tokenfile.write_segment(parts, [None, -3, 2**61])))
    assert [segment.document(i).tolist() for i in range(3)] == [[5, 1], [1], [7, 8, 9, 1]]
    assert [segment.name(i) for i in range(3)] == [None, -3, 2**61]
    unnamed = tokenfile.Segment(memoryview(tokenfile.write_segment(parts, [None] * 3)))
    assert [unnamed.name(i) for i in range(3)] == [None] * 3 and unnamed.document(2).tolist() == [7, 8, 9, 1]


def test_ids_at_both_ends_of_64_bits(spark):
    docs = spark.createDataFrame([(-(2**63), "a b"), (2**63 - 1, "c"), (0, "d"), (None, "e")], "doc_id long, text string")
    got = sorted(tokenfile.read_documents(tokenfile.write_token_files(docs, WORD)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, -(2**63), 0, 2**63 - 1]


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert bpe.bpe_decode(bpe.bpe_encode(none, BYTE), BYTE).count() == 0
    assert packing.pack(none, BYTE).count() == 0
    assert tokenfile.read_documents(tokenfile.write_token_files(none, WORD)).count() == 0


def test_queries_over_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op4_bpe(spark, sf).collect():
        ids = np.array(ids_of(BYTE, texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()
    pieces = queries.op6_packing(spark, sf).collect()
    assert {r.doc_id for r in pieces} == set(texts)
    by_doc = {}
    for r in pieces:
        by_doc[r.doc_id] = by_doc.get(r.doc_id, 0) + r.length
        assert r.offset + r.length <= 1024
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in pieces)


def test_many_positions_are_selected_as_one_by_one():
    rng = np.random.default_rng(23)
    for n, most in ((1, 1), (1, 1 << 60), (63, 5), (1000, 40), (5000, 1 << 40)):
        values = np.sort(rng.integers(0, most, n))
        coded = tokenfile.EliasFano.from_bytes(memoryview(tokenfile.EliasFano.of(values, most).to_bytes()))
        i = rng.permutation(n)
        assert coded.selects(i).tolist() == [coded.select(int(k)) for k in i] == values[i].tolist()
