"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The words that a batch has not met yet are laid end to end in one flat array of symbols. In each round the
pairs of neighbours are looked up by binary search in the sorted keys of the merge table, every word takes
its pair of lowest rank and merges all of its occurrences from left to right, and finished words leave the
array. Words seen before come from a cache of bounded size. Decoding gathers each id's bytes.

Defined results: null text encodes as empty (no ids, empty decoded text); the strings of special tokens in a
text become their ids, as the tokenizers library does by default; an empty table gives an empty result;
repeated rows repeat; a single word of any length is merged with a heap instead, in O(n log n).
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, ragged

#: Words with more bytes than this are merged with a heap.
LONG_WORD = 256
#: Bytes of text that are encoded at a time.
STEP_BYTES = 1 << 20
#: Words that a worker keeps encoded.
CACHE_WORDS = 200_000
# Fixed value: the pattern of public byte-level BPE vocabularies that splits a text into words.
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
# Letters and numbers among the characters up to U+017F without U+0130, which lower-cases to two.
LATIN_LETTERS, LATIN_NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-\u012f\u0131-\u017f", "0-9²³¹¼½¾"
#: Texts of these characters only; for them the standard re module splits alike, and faster.
LATIN = re.compile("[\t-\r\x20-\x7e\x85\xa0-\u012f\u0131-\u017f]*")
LATIN_WORDS = re.compile(rf" ?[{LATIN_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_NUMBERS}]+| ?[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+|\s+(?!\S)|\s+")


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, extra = [], 256
    for b in range(256):
        out.append(chr(b) if b in plain else chr(extra))
        extra += b not in plain
    return out


class Encoder:
    """A byte-level BPE vocabulary read from a tokenizers JSON file."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        chars = byte_characters()
        self.first = np.array([vocab[c] for c in chars], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
        self.span = np.int64(max(vocab.values()) + 1)
        keys = np.array([vocab[a] * int(self.span) + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.by_pair = None
        back = {c: b for b, c in enumerate(chars)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        pieces_ = [b""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, i in vocab.items():
            pieces_[i] = bytes(back[c] for c in token)
        for token, i in self.special.items():
            pieces_[i] = token.encode()
        self.bytes = np.frombuffer(b"".join(pieces_), np.uint8)
        self.lengths = np.array([len(p) for p in pieces_], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.words = regex.compile(WORDS)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._forget()

    def _forget(self) -> None:
        self.seen = _Numbered()
        self.cached = np.zeros(1 << 16, np.int32)
        self.filled = 0
        self.where = np.zeros(1 << 14, np.int64)
        self.size = np.zeros(1 << 14, np.int64)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, and how many each has."""
        sizes = np.array([len(w) for w in words], np.int64)
        out_sizes = np.zeros(len(words), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []  # words' numbers, their ids in a row
        for i in np.flatnonzero(sizes > LONG_WORD):
            ids = self._heap(words[i])
            out_sizes[i] = len(ids)
            found.append((np.array([i]), ids))
        short = np.flatnonzero(sizes <= LONG_WORD)
        raw = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        symbol, word = self.first[raw], np.repeat(short, sizes[short])
        while len(symbol):
            same = word[1:] == word[:-1]
            key = symbol[:-1] * self.span + symbol[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.where(same & (self.keys[at] == key), self.ranks[at], _NONE)
            rank = np.append(rank, _NONE)
            heads = np.flatnonzero(np.append(True, ~same))
            least = np.minimum.reduceat(rank, heads)
            length = np.diff(np.append(heads, len(symbol)))
            done = least == _NONE
            if done.any():
                gone = np.repeat(done, length)
                out_sizes[word[heads[done]]] = length[done]
                found.append((word[heads[done]], symbol[gone]))
                symbol, word, rank = symbol[~gone], word[~gone], rank[~gone]
                least, length = least[~done], length[~done]
                if not len(symbol):
                    break
            hit = rank == np.repeat(least, length)
            # of neighbouring hits (a run of one symbol) every other one merges, from the left
            start = hit & ~np.append(False, hit[:-1])
            if (hit & ~start).any():
                place = np.arange(len(hit))
                run = np.maximum.accumulate(np.where(start, place, 0))
                hit &= (place - run) % 2 == 0
            symbol = np.where(hit, self.made[np.where(hit, rank, 0)], symbol)
            keep = ~np.append(False, hit[:-1])
            symbol, word = symbol[keep], word[keep]
        starts = np.cumsum(out_sizes) - out_sizes
        out = np.zeros(int(out_sizes.sum()), np.int32)
        for number, ids in found:
            out[ragged(starts[number], out_sizes[number])] = ids
        return out, out_sizes

    def _heap(self, word: bytes) -> np.ndarray:
        if self.by_pair is None:
            self.by_pair = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        span, get = int(self.span), self.by_pair.get
        symbol = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(symbol)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [(r, i, symbol[i], symbol[i + 1]) for i in range(n - 1) if (r := get(symbol[i] * span + symbol[i + 1])) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if symbol[i] != a or j < 0 or symbol[j] != b:
                continue
            symbol[i], symbol[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left in (before[i], i):
                if left >= 0 and (right := after[left]) >= 0 and (q := get(symbol[left] * span + symbol[right])) is not None:
                    heapq.heappush(queue, (q, left, symbol[left], symbol[right]))
        return np.array([s for s in symbol if s >= 0], np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and how many each has."""
        if len(self.seen) > CACHE_WORDS:
            self._forget()
        number = self.seen.__getitem__
        index, counts = [], np.zeros(len(texts), np.int64)
        for t, text in enumerate(texts):
            before = len(index)
            find = LATIN_WORDS.findall if LATIN.fullmatch(text) else self.words.findall
            if self.specials is not None and self.specials.search(text):
                for part in self.specials.split(text):
                    if part in self.special:
                        index.append(-1 - self.special[part])
                    else:
                        index += map(number, find(part))
            else:
                index += map(number, find(text))
            counts[t] = len(index) - before
        self._learn()
        index = np.array(index, np.int64)
        known = index >= 0
        sizes = np.where(known, self.size[np.where(known, index, 0)], 1) if len(index) else np.zeros(0, np.int64)
        starts = np.where(known, self.where[np.where(known, index, 0)], 0) if len(index) else sizes
        ids = self.cached[ragged(starts, sizes)]
        if not known.all():
            ids = ids.copy()
            ids[(np.cumsum(sizes) - sizes)[~known]] = -1 - index[~known]
        ends = np.append(0, np.cumsum(sizes))
        edges = ends[np.append(0, np.cumsum(counts))]
        return ids, np.diff(edges)

    def _learn(self) -> None:
        if not (new := self.seen.new):
            return
        ids, sizes = self.merge([w.encode("utf-8", "surrogatepass") for w in new])
        total, words = self.filled + len(ids), len(self.seen)
        if total > len(self.cached):
            self.cached = np.append(self.cached, np.zeros(total, np.int32))
        if words > len(self.where):
            self.where, self.size = (np.append(x, np.zeros(words, np.int64)) for x in (self.where, self.size))
        self.cached[self.filled : total] = ids
        self.size[words - len(new) : words] = sizes
        self.where[words - len(new) : words] = self.filled + np.cumsum(sizes) - sizes
        self.filled, self.seen.new = total, []

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """UTF-8 bytes of each text's ids; broken sequences become U+FFFD."""
        sizes = self.lengths[ids]
        data = self.bytes[ragged(self.starts[ids], sizes)].tobytes()
        ends = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))]
        out = []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            part = data[a:b]
            try:
                part.decode()
            except UnicodeDecodeError:
                part = part.decode(errors="replace").encode()
            out.append(part)
        return out


_NONE = np.int64(1 << 40)


class _Numbered(dict):
    """Numbers words as they come; ``new`` lists those not learned yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def encode(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, ids array<int>, decoded binary for each row."""
    return _run(df, vocabulary, text, key, full=True)


def digest(df: DataFrame, vocabulary: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, ids_sha256, decoded_sha256 for each row."""
    return _run(df, vocabulary, text, key, full=False)


def _run(df: DataFrame, vocabulary: str, text: str, key: str, full: bool) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        bpe = encoder(vocabulary)
        for batch in pieces(batches, "t", STEP_BYTES):
            ids, counts = bpe.encode(batch.column(1).to_pylist())
            decoded = bpe.decode(ids, counts)
            edges = np.append(0, np.cumsum(counts))
            if full:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids, pa.int32())), pa.array(decoded, pa.binary())], names=[key, "ids", "decoded"])
                continue
            raw = memoryview(ids.astype("<u4").tobytes())
            hashes = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts), pa.array(hashes, pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in decoded], pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    out = f"`{key}` {kind}, ids array<int>, decoded binary" if full else f"`{key}` {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return df.select(key, F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, out)
