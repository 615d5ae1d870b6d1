"""Byte-level BPE by speculation: greedy longest matches, verified pair by pair, with exact merging where that fails."""

from __future__ import annotations

import heapq
import json
from array import array
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from tessera.llm.tokens import BYTE_PIECES, WordCache, byte_letters, byte_words, chunks

NEVER = np.int64(1) << 40


class Bpe:
    """Vocabulary, merges and added tokens of a tokenizers file of kind byte-level BPE."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items() if t not in self.added}
        size = max([*vocab.values(), *self.added.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        for t, i in [*vocab.items(), *((t.encode(), i) for t, i in self.added.items())]:
            self.bytes_of[i] = t
        self.vocab, self.longest = vocab, max(map(len, vocab))
        # Pairs that merge: pair_key is sorted; rank and result belong to it. left, right and made describe a token's last merge.
        self.size, self.made = size, np.full(size, -1, dtype=np.int64)
        self.left, self.right = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            whole = vocab[a + b]
            self.merges[vocab[a], vocab[b]] = (rank, whole)
            if self.made[whole] < 0:
                self.left[whole], self.right[whole], self.made[whole] = vocab[a], vocab[b], rank
        self.byte_id = [vocab[bytes([b])] for b in range(256)]
        keys = np.array([a * size + b for a, b in self.merges], dtype=np.int64)
        ranks = np.array([r for r, _ in self.merges.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.pair_key, self.pair_rank = keys[order], ranks[order]
        merged = np.flatnonzero(self.made >= 0)
        if (np.maximum(self.made[self.left[merged]], self.made[self.right[merged]]) >= self.made[merged]).any():
            raise ValueError("a token is merged before its parts")
        self.split_added = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(BYTE_PIECES)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.size + b
        at = np.minimum(np.searchsorted(self.pair_key, key), len(self.pair_key) - 1)
        return np.where(self.pair_key[at] == key, self.pair_rank[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens whether BPE leaves exactly these two tokens of their joined bytes.

        Undo the merges of both tokens from the last one back. The parts that touch the border at a time must
        not merge with each other before either is merged into its own token; of equal ranks the left merges first.
        """
        good = np.ones(len(a), dtype=bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int64), b.astype(np.int64)
        x_until, y_until = np.full(len(a), NEVER), np.full(len(a), NEVER)
        while len(at):
            rank = self.ranks(x, y)
            bad = (rank < x_until) & (rank <= y_until) & (rank < NEVER)
            good[at[bad]] = False
            go = ~bad & ((self.made[x] >= 0) | (self.made[y] >= 0))
            at, x, y, x_until, y_until = at[go], x[go], y[go], x_until[go], y_until[go]
            undo = self.made[x] > self.made[y]
            x_until, y_until = np.where(undo, self.made[x], x_until), np.where(undo, y_until, self.made[y])
            x, y = np.where(undo, self.right[x], x), np.where(undo, y, self.left[y])
        return good

    def propose(self, piece: bytes) -> list[int]:
        """Greedy longest matches."""
        out, at, end, vocab = [], 0, len(piece), self.vocab
        while at < end:
            for stop in range(min(end, at + self.longest), at, -1):
                if (i := vocab.get(piece[at:stop])) is not None:
                    out.append(i)
                    at = stop
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")
        return out

    def merge(self, piece: bytes) -> list[int]:
        """Exact BPE. Short pieces: merge the leftmost pair of least rank until none is left."""
        ids = [self.byte_id[b] for b in piece]
        if len(ids) > 24:
            return self._merge_long(ids)
        none = (1 << 40, -1)
        found = [self.merges.get(p, none) for p in zip(ids, ids[1:], strict=False)]
        while found:
            best = min(found)
            if best is none:
                break
            i = found.index(best)
            ids[i : i + 2] = [best[1]]
            del found[i]
            if i:
                found[i - 1] = self.merges.get((ids[i - 1], ids[i]), none)
            if i < len(found):
                found[i] = self.merges.get((ids[i], ids[i + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """A heap of the pairs that can merge, by rank and place, over a linked list of tokens."""
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.merges[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.merges]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else len(ids)
            if j >= len(ids) or ids[j] != b:
                continue
            ids[i], ids[j] = self.merges[a, b][1], -1
            after[i] = after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < len(ids) and (p := (ids[k], ids[after[k]])) in self.merges:
                    heapq.heappush(heap, (self.merges[p][0], k, *p))
        return [i for i in ids if i >= 0]

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        out = [[self.vocab[p]] if p in self.vocab and len(p) == 1 else self.propose(p) for p in pieces]
        sizes = np.array([len(x) for x in out], dtype=np.int64)
        flat = np.fromiter((i for x in out for i in x), dtype=np.int64, count=int(sizes.sum()))
        owner = np.repeat(np.arange(len(out)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1]) if len(flat) else np.empty(0, dtype=np.int64)
        keys, where = np.unique(flat[inside] * self.size + flat[inside + 1], return_inverse=True)
        good = self.compatible(keys // self.size, keys % self.size)
        for i in np.unique(owner[inside[~good[where]]]).tolist():
            out[i] = self.merge(pieces[i])
        return out

    def encode_words(self, pieces: list[str]) -> list[bytes]:
        """Ids of each piece of the pre-tokenizer as little-endian 32 bits."""
        return [array("I", x).tobytes() for x in self.encode_pieces([p.encode() for p in pieces])]

    def encode_strings(self, strings: list[str]) -> list[bytes]:
        """The same of strings that may hold added tokens, which are found first, and many pieces."""
        parts: list[list[int | bytes]] = []
        for w in strings:
            own: list[int | bytes] = []
            for s in self.split_added.split(w) if self.split_added else [w]:
                own += [self.added[s]] if s in self.added else [p.encode() for p in self.pieces.findall(s)]
            parts.append(own)
        pieces = list({p for own in parts for p in own if isinstance(p, bytes)})
        ids = {p: array("I", x).tobytes() for p, x in zip(pieces, self.encode_pieces(pieces), strict=True)}
        return [b"".join(p.to_bytes(4, "little") if isinstance(p, int) else ids[p] for p in own) for own in parts]


@lru_cache(maxsize=2)
def _encoder(path: str) -> WordCache:
    vocabulary = _vocabulary(path)
    return WordCache(partial(byte_words, added=tuple(vocabulary.added)), " ", BYTE_PIECES, vocabulary.encode_words, vocabulary.encode_strings)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> Bpe:
    return Bpe(path)


def bpe_encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of each whole text, as little-endian unsigned 32-bit integers.

    path names a tokenizers file of kind byte-level BPE, readable on every worker. A null text counts as empty
    and has no ids. Rows stay as they are, repeated ones included; other columns are left out, whatever their names;
    an empty table gives none. A text longer than CHUNK_CHARS is encoded by itself, so memory is bounded by the longest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for b in batches:
            for at, part in chunks(b.column("text")):
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(at, len(part)), pa.array(encoder.texts(part), pa.binary())], ["doc_id", "ids"])

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, rows.select("doc_id", F.lit(b"").alias("ids")).schema)


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """encoded(doc_id, ids): adds text, the decoded ids; bytes that aren't UTF-8 become U+FFFD."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _vocabulary(path).bytes_of
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                texts = [b"".join(map(table.__getitem__, np.frombuffer(x.as_buffer(), dtype="<u4").tolist())).decode("utf-8", "replace") for x in part.column("ids")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    rows = encoded.select("doc_id", "ids")
    return rows.mapInArrow(run, rows.select("*", F.lit("").alias("text")).schema)
