"""Language identification with error-correcting output codes.

Each language has a codeword of +1/-1 bits. One binary n-gram classifier (logistic regression on
hashed byte 1- to 3-grams) predicts each bit; decoding adds every bit's logistic loss, weighted by
how reliable that bit was in training, and takes the codeword with the least loss. A small gap to
the second codeword is flagged as ambiguous.

Defined results: null text or text without a letter is ``und`` with score 0; without any labelled
row every document is ``und``; with one learned language every document with a letter gets it with
score 1. Null ids are not held out. Empty tables give empty results, repeated rows are predicted alike
and learned from once, ids can have any type, other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import flat, pieces

#: Hashed features of a document.
DIMS = 4096
#: Labelled documents of each language that training uses, about; a documented bound.
TRAIN_PER_LANGUAGE = 300
#: A gap between the two least losses under this is ambiguous.
AMBIGUOUS_GAP = 0.08
#: ``keep_identified`` lets an ambiguous document go if its score is under this.
LEAST_SCORE = 0.4
#: Documents whose features a worker holds at a time, DIMS numbers each, and bytes of their texts.
STEP_ROWS, STEP_BYTES = 512, 1 << 19

_BYTES = "__langid_bytes"
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _c in range(97, 123):
    _FOLD[_c] = _c
    _FOLD[_c - 32] = _c


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits, +1 or -1
    weights: np.ndarray  # DIMS x bits
    bias: np.ndarray
    trust: np.ndarray  # weight of each bit's loss


def features(data: np.ndarray, offsets: np.ndarray, dims: int = DIMS) -> np.ndarray:
    """Square roots of the relative frequencies of hashed byte 1- to 3-grams, a row for each document."""
    n = len(offsets) - 1
    out = np.zeros((n, dims), np.float32)
    if not len(data):
        return out
    b = _FOLD[data].astype(np.uint32)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    counts = np.zeros(n * dims, np.float64)
    for order, salt in ((1, 0x9E37), (2, 0x85EB), (3, 0xC2B2)):
        if len(b) < order:
            break
        gram = b[: len(b) - order + 1].copy()
        blank = b[: len(b) - order + 1] == 32
        for k in range(1, order):
            nxt = b[k : len(b) - order + 1 + k]
            gram = gram * np.uint32(257) + nxt
            blank = blank & (nxt == 32) if k == 1 else blank | ((nxt == 32) & (b[k - 1 : len(b) - order + k] == 32))
        keep = ~blank
        if order > 1:
            keep &= doc[: len(gram)] == doc[order - 1 :]
        slot = ((gram + np.uint32(salt)) * np.uint32(2654435761)) >> np.uint32(20)
        index = doc[: len(gram)][keep] * dims + slot[keep].astype(np.int64) % dims
        counts += np.bincount(index, minlength=n * dims)
    counts = counts.reshape(n, dims)
    total = counts.sum(axis=1, keepdims=True)
    np.divide(counts, total, out=counts, where=total > 0)
    return np.sqrt(counts).astype(np.float32)


def codewords(k: int, seed: int = 7) -> np.ndarray:
    """A code matrix: every dichotomy for up to 7 languages, else the best of random codes by least distance."""
    if k < 2:
        return np.ones((k, 0), np.float32)
    if k <= 7:
        bits = 2 ** (k - 1) - 1
        cols = [[1 if i == 0 or not (c >> (i - 1)) & 1 else -1 for i in range(k)] for c in range(1, bits + 1)]
        return np.array(cols, np.float32).T
    rng, bits, best, most = np.random.default_rng(seed), 4 * int(np.ceil(np.log2(k))) + 7, None, -1.0
    for _ in range(64):
        m = rng.choice(np.array([-1, 1], np.float32), size=(k, bits))
        m[0, np.abs(m.sum(axis=0)) == k] *= -1
        gram = m @ m.T
        np.fill_diagonal(gram, -bits)
        if (least := float((bits - gram.max()) / 2)) > most:
            best, most = m, least
    return best


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], steps: int = 150) -> Model:
    """Train one logistic regression for each bit, all at once, by full-batch Adam."""
    code = codewords(len(languages))
    bits = code.shape[1]
    w, b = np.zeros((x.shape[1], bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return Model(languages, code, w, b, np.zeros(0, np.float32))
    target = code[y]
    share = np.bincount(y, minlength=len(languages)).astype(np.float32)
    row = (1 / share[y] / len(languages))[:, None].astype(np.float32)
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(b), np.zeros_like(b)]
    for step in range(1, steps + 1):
        g = -target / (1 + np.exp(np.clip(target * (x @ w + b), -30, 30))) * row
        for p, grad, m, v in ((w, x.T @ g + 1e-5 * w, state[0], state[1]), (b, g.sum(axis=0), state[2], state[3])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad * grad - v)
            p -= 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    loss = (np.log1p(np.exp(-np.clip(target * (x @ w + b), -30, 30))) * row).sum(axis=0)
    trust = 1 / (0.05 + loss)
    return Model(languages, code, w, b, (trust / trust.sum()).astype(np.float32))


def decode(model: Model, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row: index of the language, score in 0..1, gap to the second codeword's loss, bits that differ."""
    n = len(x)
    if len(model.languages) == 1:
        return np.zeros(n, np.int64), np.ones(n), np.full(n, np.inf), np.zeros(n, np.int64)
    out = x @ model.weights + model.bias
    losses = np.stack([(np.log1p(np.exp(-np.clip(out * c, -30, 30))) * model.trust).sum(axis=1) for c in model.code], axis=1)
    order = np.argsort(losses, axis=1, kind="stable")
    best = order[:, 0]
    rows = np.arange(n)
    gap = losses[rows, order[:, 1]] - losses[rows, best]
    like = np.exp(-4 * (losses - losses[rows, best][:, None]))
    differ = ((out * model.code[best]) < 0).sum(axis=1)
    return best, 1 / like.sum(axis=1), gap, differ


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """Fit on about ``per_language`` documents of each language, chosen by the hash of key and text; features are made on the executors."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    counts = {r[lang]: r["count"] for r in rows.groupBy(lang).count().collect()}  # a row for each language
    if not counts:
        return None
    languages = sorted(counts)
    rate = F.create_map(*[F.lit(v) for x in languages for v in (x, min(1.0, per_language / counts[x]))])
    point = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(text)), F.lit(1 << 30)) / float(1 << 30)
    chosen = rows.where(point < F.element_at(rate, F.col(lang))).select(F.col(lang).alias("lang"), F.lower(F.col(text)).cast("binary").alias("bytes"))
    chosen = chosen.distinct()  # equal rows are chosen together

    def featurize(batches):
        for batch in pieces(batches, "bytes", STEP_BYTES, STEP_ROWS):
            x = features(*flat(batch.column(1))).astype(np.float16)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["lang", "x"])

    got = chosen.mapInArrow(featurize, "lang string, x binary").collect()
    got.sort(key=lambda r: (r["lang"], bytes(r["x"])))
    if not got:
        return None
    languages = sorted({r["lang"] for r in got})
    x = np.stack([np.frombuffer(bytes(r["x"]), np.float16) for r in got]).astype(np.float32)
    return fit(x, np.array([languages.index(r["lang"]) for r in got]), languages)


RESULTS = ("lang_pred", "score", "ambiguous", "bit_errors")


def predict(df: DataFrame, model: Model | None, text: str = "text", columns: list[str] | None = None, results: tuple[str, ...] = RESULTS) -> DataFrame:
    """``columns`` of ``df`` (default all) with language, score, ambiguity and bit errors, named by ``results``."""
    columns = df.columns if columns is None else columns
    kept = [F.col(c) for c in columns]
    if model is None:
        return df.select(*kept, *[F.lit(v).alias(n) for v, n in zip(("und", 0.0, True, 0), results, strict=True)])
    letters = F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))
    source = df.select(*kept, F.when(letters, F.lower(F.col(text)).cast("binary")).otherwise(F.lit(bytearray())).alias(_BYTES), letters.alias("_letters"))
    shared = df.sparkSession.sparkContext.broadcast(model)  # DIMS x bits floats: a fixed size

    def run(batches):
        m = shared.value
        names = np.array([*m.languages, "und"], dtype=object)
        for batch in pieces(batches, _BYTES, STEP_BYTES, STEP_ROWS):
            at = len(columns)
            best, score, gap, differ = decode(m, features(*flat(batch.column(at))))
            has = batch.column(at + 1).to_numpy(zero_copy_only=False).astype(bool)
            best = np.where(has, best, len(m.languages))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:at], pa.array(names[best], pa.string()), pa.array(np.where(has, score, 0.0).astype(np.float64)), pa.array(~has | (gap < AMBIGUOUS_GAP)), pa.array(np.where(has, differ, 0).astype(np.int32))],
                names=[*columns, *results],
            )

    fields = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)
    kinds = ", ".join(f"`{n}` {k}" for n, k in zip(results, ("string", "double", "boolean", "int"), strict=True))
    return source.mapInArrow(run, f"{fields}, {kinds}")


def held_out(key: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def identify(df: DataFrame) -> DataFrame:
    """Train on the rows that are not held out, predict every row: doc_id, held_out, lang_pred, score, ambiguous, bit_errors."""
    model = train(df.where(~held_out()))
    out = predict(df, model, columns=["doc_id", "text"]) if model is None else predict(df, model, columns=["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "ambiguous", "bit_errors")


def keep_identified(df: DataFrame, least: float = LEAST_SCORE) -> DataFrame:
    """Documents whose language is known: those without a letter, or that no codeword fits clearly, go."""
    model = train(df)
    lang, score, ambiguous, _ = own = tuple(f"__langid_{n}" for n in RESULTS)  # columns of these plain names may be there
    seen = predict(df, model, results=own)
    return seen.where((F.col(lang) != "und") & ~(F.col(ambiguous) & (F.col(score) < least))).select(*df.columns)
