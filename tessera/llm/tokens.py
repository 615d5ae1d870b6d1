"""Token ids of whole texts with the tokenizers library, word by word, with a bounded cache per worker."""

from __future__ import annotations

import ctypes
import gc
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute
import regex
import tiktoken
from tokenizers import Tokenizer

#: Words and their pieces that a worker remembers; beyond that it starts anew. Longer ones are not remembered.
CACHE_WORDS, CACHE_PIECES, CACHE_CHARS = 400_000, 600_000, 40
#: Bytes of text that are encoded together; a longer text is encoded by itself.
CHUNK_CHARS = 1_000_000

#: How the two kinds of tokenizer split a text into pieces.
BYTE_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

_CUT = re.compile(r" (?=\S)")
_UNEVEN = re.compile(r" (?:\s|$)")
#: Texts of these letters only are in normal form C, and lower-case letter by letter.
_SIMPLE = re.compile("[\t\n\r -~\u00a1-\u012f\u0131-\u017f]*")


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in a vocabulary file: visible Latin-1 for itself, the rest from U+0100 on."""
    seen = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(seen)]
    return {chr(b): b for b in seen} | {chr(256 + i): b for i, b in enumerate(rest)}


def byte_words(text: str, added: tuple[str, ...] = ()) -> tuple[list[str], bool]:
    """Words of a byte-level BPE text, each but the first without its leading space, and whether they can be cut into pieces.

    The pre-tokenizer always starts a piece at a space before a character that isn't white space, so words can be
    encoded by themselves. An added token ends the text before it, white space included: such a text stays whole.
    """
    if any(a in text for a in added):
        return [text], False
    return _CUT.split(text) if _UNEVEN.search(text) else text.split(" "), True


def plain_words(text: str) -> tuple[list[str], bool]:
    """Words of a text for a tokenizer that drops white space (none of its pieces spans some); as byte_words()."""
    simple = "<" not in text and _SIMPLE.fullmatch(text) is not None
    if simple:
        text = text.lower()
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), simple


def _bounded(cache: dict[str, bytes], most: int) -> dict[str, bytes]:
    return cache if len(cache) <= most else {}


class WordCache:
    """Encodes texts as the joined ids of their words, and words as those of their pieces.

    split cuts a text into words; all but the first get `lead` before them. Pieces that weren't seen before go to
    `encode` in one list, and words of texts that can't be cut into pieces to `encode_whole`. A word alone encodes
    alike in either way, so one table holds both.
    """

    def __init__(self, split: Callable[[str], tuple[list[str], bool]], lead: str, pieces: str, encode: Callable[[list[str]], list[bytes]], encode_whole: Callable[[list[str]], list[bytes]] | None = None) -> None:
        self.split, self.lead, self.encode, self.encode_whole = split, lead, encode, encode_whole or encode
        self.find = regex.compile(pieces).findall
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _by_pieces(self, words: list[str]) -> list[bytes]:
        """Words with their lead, if any."""
        self.pieces = _bounded(self.pieces, CACHE_PIECES)
        find = self.find
        parts = [(w,) if w.isalpha() else find(w) for w in words]
        new = list(set().union(*parts).difference(self.pieces))
        self.pieces.update(zip(new, self.encode(new), strict=True))
        get = self.pieces.__getitem__
        out = [get(p[0]) if len(p) == 1 else b"".join(map(get, p)) for p in parts]
        for piece in new:
            if len(piece) > CACHE_CHARS:
                del self.pieces[piece]
        return out

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of a chunk's texts. Its many short lists hold no cycles, so the collector waits until they are gone."""
        collecting = gc.isenabled()
        gc.disable()
        try:
            return self._texts(texts)
        finally:
            if collecting:
                gc.enable()

    def _texts(self, texts: list[str]) -> list[bytes]:
        split = [self.split(t) for t in texts]
        first = [words.pop(0) for words, _ in split]
        heads = [list({f for f, (_, s) in zip(first, split, strict=True) if s == simple}) for simple in (False, True)]
        known = [dict(zip(h, f(h), strict=True)) for h, f in zip(heads, (self.encode_whole, self._by_pieces), strict=True)]
        self.words = _bounded(self.words, CACHE_WORDS)
        simple = set().union(*(w for w, s in split if s)).difference(self.words)
        whole = set().union(*(w for w, s in split if not s)).difference(self.words, simple)
        order = list(simple)
        self.words.update(zip(order, self._by_pieces([self.lead + w for w in order] if self.lead else order), strict=True))
        order = list(whole)
        self.words.update(zip(order, self.encode_whole([self.lead + w for w in order]), strict=True))
        get = self.words.__getitem__
        out = [known[s][f] + b"".join(map(get, words)) for f, (words, s) in zip(first, split, strict=True)]
        for word in simple | whole:
            if len(word) > CACHE_CHARS:
                del self.words[word]
        return out


def release_memory() -> None:
    """Give freed memory back to the system at the end of a task; workers are kept for later tasks, which may not need it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def releasing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, with release_memory() at its end."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    return whole


def chunks(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Slices of a string column with about CHUNK_CHARS bytes each, as lists, and where they start."""
    sizes = pa.compute.binary_length(column).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(column):
        stop, held = at + 1, int(sizes[at])
        while stop < len(column) and held + sizes[stop] <= CHUNK_CHARS:
            held += int(sizes[stop])
            stop += 1
        yield at, column.slice(at, stop - at).to_pylist()
        at = stop


class ByteTexts:
    """Whole texts by tiktoken, with vocabulary and merges of a tokenizers file of kind byte-level BPE.

    Both libraries give the same ids where ids follow the order of the merges; other files are refused.
    """

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        special = {a["content"]: a["id"] for a in spec["added_tokens"]}
        order = [vocab[p.replace(" ", "") if isinstance(p, str) else "".join(p)] for p in spec["model"]["merges"]]
        if order != sorted(order) or order[0] < 256 or max(*order, *special.values()) >= 1 << 16:
            raise ValueError("ids don't follow the merges, or don't fit 16 bits")
        ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
        self.own = tiktoken.Encoding("own", pat_str=BYTE_PIECES, mergeable_ranks=ranks, special_tokens=special)
        self.special = [*special]

    def texts(self, texts: list[str]) -> list[bytes]:
        plain, marked = self.own.encode_ordinary, self.own.encode
        return [array("H", marked(t, allowed_special="all") if any(x in t for x in self.special) else plain(t)).tobytes() for t in texts]


@lru_cache(maxsize=2)
def byte_texts(path: str) -> ByteTexts:
    return ByteTexts(path)


@lru_cache(maxsize=2)
def plain_texts(path: str) -> WordCache:
    """A worker's cache over the tokenizers library, for a file that drops white space; ids as little-endian 16 bits."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    if tokenizer.get_vocab_size() > 1 << 16:
        raise ValueError("ids don't fit 16 bits")

    def encode(pieces: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    return WordCache(plain_words, "", PLAIN_PIECES, encode)
