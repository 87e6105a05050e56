"""Content-addressed store for token ids.

Each document's id stream is cut where a rolling hash of the last ids has low bits of zero, so equal
passages give equal chunks wherever they stand. A chunk is stored once, under the BLAKE2 hash of its
little-endian ids. A document is a recipe: its chunks in order, its place in the stream of all documents,
and the root of the Merkle tree over its chunk hashes. Reading back opens every chunk, checks it against its
name, joins recipes to chunk checks, checks Merkle roots, and composes each document's CRC-32 from those of
its chunks, so that no id moves again.

Files, Parquet below the store's folder: ``kind=chunk`` (key, n, data: zstd or raw ids, copies) and ``manifest``
(doc_id, start, n_tokens, root, recipe), whose files, read in the order of their names, hold the documents in
ascending doc_id order. Reading raises an error if a chunk, a recipe or a Merkle root does not fit.

Defined results: keys that are no integers are refused; null text counts as empty and is stored as the end id alone; repeated rows are stored as
copies and come back as often; an empty table gives empty files; null ids sort first; a text of any length
is cut, never truncated.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import chain
from operator import attrgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import LATIN, LATIN_LETTERS, LATIN_NUMBERS, _Numbered, byte_characters
from .common import exists, pieces, ragged, remove, shared_folder, uncollected, whole_number

#: Ids that the rolling hash sees; mean and most ids of a chunk.
WINDOW, MEAN, MOST = 16, 512, 4096
CACHE_WORDS = 600_000

# Fixed value: the pattern of the public lower-casing word vocabulary, for lower-case Latin texts; letters, the commonest, first.
LOWER_WORDS = re.compile(rf"[{LATIN_LETTERS}]+|'s|'t|'re|'ve|'m|'ll|'d|[{LATIN_NUMBERS}]|[^\s{LATIN_LETTERS}{LATIN_NUMBERS}]+")


class WordTokens:
    """Ids by the tokenizers library; in Latin texts it is asked once for each distinct word."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = self.library.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        chars = byte_characters()
        self.latin = {c: "".join(chars[b] for b in chr(c).encode()) for c in range(0x400)}
        self._forget()

    def _forget(self) -> None:
        self.seen = _Numbered()
        self.ids, self.filled = np.zeros(1 << 16, np.int64), 0
        self.where, self.size = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def _learn(self) -> None:
        if not (new := self.seen.new):
            return
        # each is one word of the library's pre-tokenizer, in byte-level characters
        merge, latin = self.library.model.tokenize, self.latin
        got = [merge(w if w.isascii() else w.translate(latin)) for w in new]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        flat = np.fromiter(map(attrgetter("id"), chain.from_iterable(got)), np.int64, int(sizes.sum()))
        total, words = self.filled + len(flat), len(self.seen)
        if total > len(self.ids):
            self.ids = np.append(self.ids, np.zeros(total, np.int64))
        if words > len(self.where):
            self.where, self.size = (np.append(x, np.zeros(words, np.int64)) for x in (self.where, self.size))
        self.ids[self.filled : total] = flat
        self.size[words - len(new) : words] = sizes
        self.where[words - len(new) : words] = self.filled + np.cumsum(sizes) - sizes
        self.filled, self.seen.new = total, []

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.seen) > CACHE_WORDS:
            self._forget()
        number, index, counts, whole = self.seen.__getitem__, [], [], {}
        for t, text in enumerate(texts):
            if LATIN.fullmatch(text) and not any(s in text for s in self.special):
                words = LOWER_WORDS.findall(text.lower())
                index.append(np.fromiter(map(number, words), np.int32, len(words)))
                counts.append(len(words))
            else:
                whole[t] = np.array(self.library.encode(text, add_special_tokens=False).ids, np.int64)
                counts.append(0)
        self._learn()
        index = np.concatenate(index) if index else np.zeros(0, np.int32)
        sizes = self.size[index]
        ids = self.ids[ragged(self.where[index], sizes)]
        edges = np.append(0, np.cumsum(sizes))[np.append(0, np.cumsum(counts))].tolist()
        return [whole[t] if t in whole else ids[edges[t] : edges[t + 1]] for t in range(len(texts))]


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    return WordTokens(path)


@lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    base = 0x9E3779B97F4A7C15
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        return (np.cumprod(np.append(np.uint64(1), np.full(n, base, np.uint64)), dtype=np.uint64), np.cumprod(np.append(np.uint64(1), np.full(n, inverse, np.uint64)), dtype=np.uint64))


def cuts(ids: np.ndarray, window: int = WINDOW, mean: int = MEAN, most: int = MOST) -> list[int]:
    """Ends of the chunks: where the hash of the last ``window`` ids says so, and after ``most`` ids."""
    n = len(ids)
    ends: list[int] = []
    if n > window:
        grown = 1 << max(10, (n + 1).bit_length())
        power, inverse = _powers(grown)
        with np.errstate(over="ignore"):
            total = np.cumsum((ids.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) * power[:n], dtype=np.uint64)
            h = total[window - 1 :].copy()
            h[1:] -= total[: n - window]
            h *= inverse[: len(h)]
            h ^= h >> np.uint64(31)
            h *= np.uint64(0xBF58476D1CE4E5B9)
        ends = (np.flatnonzero((h >> np.uint64(32)) % np.uint64(mean) == 0) + window).tolist()
    out, last = [], 0
    for end in [*ends, n]:
        while end - last > most:
            last += most
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def merkle(hashes: list[bytes]) -> bytes:
    """Root of the binary hash tree; an odd last node moves up alone."""
    level = [hashlib.blake2b(b"\0" + h, digest_size=16).digest() for h in hashes] or [b"\0" * 16]
    while len(level) > 1:
        pairs = [hashlib.blake2b(b"\1" + a + b, digest_size=16).digest() for a, b in zip(level[0::2], level[1::2], strict=False)]
        level = pairs + level[-1:] * (len(level) % 2)
    return level[0]


def _pack(ids: np.ndarray, wide: bool) -> bytes:
    return ids.astype("<u4" if wide else "<u2").tobytes()


def write(df: DataFrame, vocabulary: str, end_id: int, text: str = "text", key: str = "doc_id", folder: str | None = None) -> str:
    """Encode and store every row; returns the store's folder."""
    whole_number(df, key)
    folder = folder or f"{shared_folder(df.sparkSession)}/idstore-{uuid.uuid4().hex}"

    def encoded(batches):
        tokens = word_tokens(vocabulary)
        wide = max(tokens.library.get_vocab_size(), end_id + 1) > 1 << 16
        for batch in pieces(batches, "t"):
            names, data, sizes = [], [], []
            kinds, docs = [], []
            held: set[bytes] = set()
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.append(ids, end_id)
                recipe, last = [], 0
                for end in cuts(ids):
                    raw = _pack(ids[last:end], wide)
                    name = hashlib.blake2b(raw, digest_size=16).digest()
                    recipe.append(name + struct.pack("<I", end - last))
                    if name not in held:
                        held.add(name)
                        small = pa.compress(raw, codec="zstd", asbytes=True)
                        names.append(name), data.append(b"z" + small if len(small) < len(raw) else b"r" + raw)
                        kinds.append("chunk"), docs.append(None), sizes.append(end - last)
                    last = end
                root = merkle([r[:16] for r in recipe])
                names.append(struct.pack("<?q", doc is not None, doc or 0) + root), data.append(root + b"".join(recipe))
                kinds.append("doc"), docs.append(doc), sizes.append(len(ids))
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(names, pa.binary()), pa.array(docs, pa.int64()), pa.array(sizes, pa.int64()), pa.array(data, pa.binary())], names=["kind", "key", "doc", "n", "data"])

    def run(batches):
        with uncollected():
            yield from encoded(batches)

    rows = df.select(F.col(key).cast("bigint").alias(key), F.coalesce(F.col(text), F.lit("")).alias("t")).mapInArrow(run, "kind string, key binary, doc bigint, n bigint, data binary")
    once = rows.groupBy("kind", "key").agg(F.first("doc").alias("doc"), F.first("n").alias("n"), F.first("data").alias("data"), F.count("*").alias("copies"))
    once.write.partitionBy("kind").parquet(f"{folder}/once")
    there = f"{folder}/once/kind=doc"
    _manifest(df.sparkSession.read.parquet(there) if exists(df.sparkSession, there) else None, folder, df)
    return folder


def _manifest(docs: DataFrame | None, folder: str, df: DataFrame) -> None:
    """Recipes in ascending doc_id order over the files' names, with each document's start among all ids."""
    if docs is None:
        empty = df.sparkSession.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, root binary, recipe binary")
        empty.write.parquet(f"{folder}/manifest")
        return
    order = ["doc_id", "root", "copy"]  # equal ids can stand in several ranges
    recipe = [F.expr("substring(data, 1, 16)").alias("root"), F.expr("substring(data, 17)").alias("recipe")]
    each = docs.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_tokens"), *recipe, F.explode(F.expr("sequence(1, copies)")).alias("copy"))
    ranged = each.repartitionByRange(*order).withColumn("part", F.spark_partition_id())
    ranged.write.parquet(f"{folder}/ranges")
    ranged = df.sparkSession.read.schema(ranged.schema).parquet(f"{folder}/ranges")
    # a row for each range
    sums = ranged.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.join(F.broadcast(before), "part").withColumn("start", F.col("before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    placed = placed.select("doc_id", "start", "n_tokens", "root", "recipe")
    placed.repartitionByRange("start").sortWithinPartitions("start").write.parquet(f"{folder}/manifest")
    remove(df.sparkSession, f"{folder}/ranges")


@lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """Tables [k][byte place][byte]: what a CRC-32 becomes when 2**k zero bytes follow."""
    row = np.array([0xEDB88320 if i == 0 else 1 << (i - 1) for i in range(32)], np.uint32)  # one zero bit

    def apply(columns: np.ndarray, value: np.ndarray) -> np.ndarray:
        out = np.zeros_like(value)
        for i in range(32):
            out ^= np.where(value >> np.uint32(i) & np.uint32(1), columns[i], np.uint32(0))
        return out

    for _ in range(3):
        row = apply(row, row)
    tables = np.zeros((44, 4, 256), np.uint32)
    for k in range(44):
        for place in range(4):
            tables[k, place] = apply(row, (np.arange(256, dtype=np.uint32) << np.uint32(8 * place)))
        row = apply(row, row)
    return tables


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """The CRCs' share in that of a longer string, of which ``zeros`` bytes follow theirs."""
    out, tables = crc.astype(np.uint32), _shifts()
    for k in range(int(zeros.max()).bit_length() if len(zeros) else 0):
        t = tables[k]
        moved = t[0][out & 255] ^ t[1][out >> 8 & 255] ^ t[2][out >> 16 & 255] ^ t[3][out >> 24]
        out = np.where(zeros >> k & 1, moved, out)
    return out


def chunk_checks(df: DataFrame, wide: bool) -> DataFrame:
    """key, ok, crc of each stored chunk's ids as unsigned 32-bit numbers."""

    def run(batches):
        for batch in pieces(batches, "data"):
            ok, crcs = [], []
            for name, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = pa.decompress(data[1:], decompressed_size=n * (4 if wide else 2), codec="zstd", asbytes=True) if data[:1] == b"z" else data[1:]
                ok.append(hashlib.blake2b(raw, digest_size=16).digest() == name)
                crcs.append(zlib.crc32(raw if wide else np.frombuffer(raw, "<u2").astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ok, pa.bool_()), pa.array(crcs, pa.int64())], names=["key", "ok", "crc"])

    return df.select("key", "n", "data").mapInArrow(run, "key binary, ok boolean, crc bigint")


def read(spark, folder: str, wide: bool = False) -> DataFrame:
    """Read the files back: doc_id, start, n_tokens, ids_crc32, verified, n_chunks; an error where they do not fit."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    store = f"{folder}/once/kind=chunk"
    if not exists(spark, store):
        return manifest.select("doc_id", "start", "n_tokens", F.lit(0).cast("bigint").alias("ids_crc32"), F.lit(True).alias("verified"), F.lit(0).alias("n_chunks"))
    checks = chunk_checks(spark.read.parquet(store), wide)

    def parts(batches):
        for batch in batches:
            doc, start, n, root, recipes = (c.to_pylist() for c in batch.columns)
            out = [[] for _ in range(9)]
            for d, s, m, r, recipe in zip(doc, start, n, root, recipes, strict=True):
                names = [recipe[i : i + 16] for i in range(0, len(recipe), 20)]
                sizes = [struct.unpack_from("<I", recipe, i + 16)[0] for i in range(0, len(recipe), 20)]
                right = merkle(names) == r and sum(sizes) == m
                after = m
                for name, size in zip(names, sizes, strict=True):
                    after -= size
                    for column, value in zip(out, (d, s, m, right, name, 4 * after, len(names)), strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=False)], names=fields)

    types = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.int64(), pa.int32()]
    fields = ["doc_id", "start", "n_tokens", "root_ok", "key", "after", "n_chunks"]
    recipes = manifest.select("doc_id", "start", "n_tokens", "root", "recipe").mapInArrow(parts, "doc_id bigint, start bigint, n_tokens bigint, root_ok boolean, key binary, after bigint, n_chunks int")

    @F.pandas_udf("bigint")
    def shifted(crc, after):
        import pandas as pd

        return pd.Series(shift_crc(crc.to_numpy(np.int64), after.to_numpy(np.int64)).astype(np.int64))

    joined = recipes.join(checks, "key", "left").withColumn("part", shifted(F.coalesce("crc", F.lit(0)), "after"))
    fits = F.bool_and("root_ok") & F.bool_and(F.coalesce("ok", F.lit(False))) & (F.count("*") == F.first("n_chunks"))
    whole = joined.groupBy("doc_id", "start", "n_tokens", "n_chunks").agg(F.bit_xor("part").alias("crc"), fits.alias("fits"))
    broken = F.raise_error(F.concat(F.lit("the stored chunks do not make up the document at "), F.col("start").cast("string")))
    return whole.select("doc_id", "start", "n_tokens", F.when(F.col("fits"), F.col("crc")).otherwise(broken.cast("bigint")).alias("ids_crc32"), F.col("fits").alias("verified"), "n_chunks")
