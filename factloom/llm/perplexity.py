"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte n-grams.

Trusted text is counted once, at the highest order; lower orders get their continuation counts by grouping
the order above, three discounts for each order come from its counts of counts, and probabilities from joins
of the sharded count tables with their contexts' totals and with the order below. A document's perplexity is
the geometric mean of its bytes' inverse probabilities; it is kept if that is at most its language's quantile
among trusted documents that were not counted (one text in HELD, by its hash).

Documents are scored by joins alone, at every size: texts are packed into pieces of about PIECE_BYTES, a piece's
distinct grams are joined to the count tables, and what they get goes back to the piece, where each document's
bytes look theirs up. So a gram moves once a piece, not once a document, and the HOT most counted ones, which
nearly every piece holds, go to the workers beforehand instead. Rows keep their identity without a key: null
and repeated ids are scored by their own texts.

Defined results: null and empty texts have perplexity null and are not kept; a language without held-out
trusted documents uses the quantile of all of them, and without any the counted ones are used; without any
trusted text nothing has a perplexity and nothing is kept; an empty table gives an empty result; repeated rows
repeat; ids of any type are matched with the labels' as text; other columns are ignored.
"""

from __future__ import annotations

import io
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, is_small, pieces, saved, text_bytes, tidy

ORDER = 5
QUANTILE = 0.99
#: One trusted text in so many is not counted, but tells the threshold.
HELD = 5
PIECE_BYTES = 8 << 20
#: The most counted grams that every worker gets, about, and at most twice as many: four megabytes.
HOT = 1 << 18
#: Bytes of a text that are worked on at a time, and of a stored part of a piece.
STEP_BYTES, PART_BYTES = 1 << 18, 1 << 18
BROADCAST_BYTES = 8 << 20
#: Kinds of stored rows.
_TEXTS, _GRAMS, _COUNTS = 0, 1, 2

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48


def grams(data: np.ndarray, offsets: np.ndarray, order: int = ORDER) -> np.ndarray:
    """For each byte, it and the ``order`` - 1 before it in its text (zeros before the start), packed into a number."""
    b = _FOLD[data].astype(np.int64)
    place = np.arange(len(b)) - np.repeat(offsets[:-1], np.diff(offsets))
    out = b.copy()
    for k in range(1, order):
        out[k:] |= np.where(place[k:] >= k, b[:-k] << 8 * k, 0)
    return out


def _counted(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams of the last column of ``batch`` and their counts, summed over steps."""
    found = []
    for step in pieces([batch], batch.schema.names[-1], STEP_BYTES):
        found.append(np.unique(grams(*flat(step.column(step.num_columns - 1))), return_counts=True))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    g, inverse = np.unique(np.concatenate([x for x, _ in found]), return_inverse=True)
    return g, np.bincount(inverse, np.concatenate([c for _, c in found]), len(g)).astype(np.int64)


def _shrunk(x: np.ndarray) -> bytes:
    """Numbers, the last axis ascending, as compressed differences behind their count."""
    raw = np.diff(x, prepend=0).astype(np.int64).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _grown(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)
    return np.cumsum(np.frombuffer(raw, np.int64))


def _folded(batch: pa.RecordBatch) -> pa.RecordBatch:
    """The batch with its last column as the model sees it."""
    data, offsets = flat(batch.column(4))
    text = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(_FOLD[data])])
    return pa.RecordBatch.from_arrays([*batch.columns[:4], text], names=batch.schema.names)


def packed(df: DataFrame) -> DataFrame:
    """piece, kind, seq, data, more of (doc, lang, trusted, counted, bytes), saved: a piece's rows, its distinct grams,
    and grams with their counts in those rows that are counted."""

    def run(batches):
        zstd = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=12))
        for batch in pieces(batches, "bytes", PIECE_BYTES):
            batch = _folded(batch)
            piece = uuid.uuid4().int >> 65  # this attempt's own; only one attempt's rows are committed
            sink = io.BytesIO()
            with pa.ipc.new_stream(sink, batch.schema, options=zstd) as out:
                out.write_batch(batch)
            every, few = _counted(batch), batch.filter(batch.column(3))
            counted = _counted(few) if few.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            texts = sink.getvalue()
            rows = [(piece, _TEXTS, n, texts[at : at + PART_BYTES], None) for n, at in enumerate(range(0, len(texts), PART_BYTES))]
            rows += [(piece, _GRAMS, 0, _shrunk(every[0]), None), (piece, _COUNTS, 0, _shrunk(counted[0]), pa.compress(counted[1].tobytes(), codec="zstd", asbytes=True))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["piece", "kind", "seq", "data", "more"])

    types = [pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    rows = df.select("doc", "lang", "trusted", "counted", "bytes").mapInArrow(run, "piece bigint, kind int, seq int, data binary, more binary")
    return saved(rows, "kn-pieces")


def _train_counts(rows: DataFrame) -> DataFrame:
    """(g, c) of every piece."""

    def run(batches):
        for batch in batches:
            for data, more in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = _grown(data)
                c = np.frombuffer(pa.decompress(more, decompressed_size=8 * len(g), codec="zstd", asbytes=True), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(c)], names=["g", "c"])

    return rows.where(F.col("kind") == _COUNTS).select("data", "more").mapInArrow(run, "g bigint, c bigint")


def _wanted(rows: DataFrame, hot) -> DataFrame:
    """(piece, g) of every piece's distinct grams outside the broadcast ``hot`` ones."""

    def run(batches):
        known = hot.value[0]
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                g = _grown(data)
                if len(known):
                    g = g[known[np.minimum(np.searchsorted(known, g), len(known) - 1)] != g]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), piece)), pa.array(g)], names=["piece", "g"])

    return rows.where(F.col("kind") == _GRAMS).select("piece", "data").mapInArrow(run, "piece bigint, g bigint")


def train(counted: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """From (g, c) of the highest order, in any number of parts: probabilities (n, g, c, p) and back-off weights (n, h, w) of all orders."""
    counts = {order: saved(counted.groupBy("g").agg(F.sum("c").alias("c")), "kn-counts")}
    for n in range(order - 1, 0, -1):
        suffix = F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))
        counts[n] = saved(counts[n + 1].groupBy(suffix.alias("g")).agg(F.count("*").alias("c")), "kn-counts")
    weights, below, every = None, None, None
    for n in range(1, order + 1):
        t = counts[n].withColumn("h", F.shiftright("g", 8))
        n1, n2, n3, n4 = (float(x or 0) for x in t.agg(*[F.count_if(F.col("c") == k) for k in (1, 2, 3, 4)]).first())  # four numbers
        y = n1 / (n1 + 2 * n2) if n1 else 0.5
        d = [min(0.95 * k, max(0.05, k - (k + 1) * y * b / a if a else 0.5 * k)) for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = t.groupBy("h").agg(F.sum("c").alias("total"), F.sum(off).alias("taken")).select("h", "total", (F.col("taken") / F.col("total")).alias("w"))
        p = t.join(context, "h").withColumn("own", (F.col("c") - off) / F.col("total"))
        if below is None:
            p = p.select("g", "c", (F.col("own") + F.col("w") / 256.0).alias("p"))
        else:
            lower = below.select(F.col("g").alias("s"), F.col("p").alias("q"))
            p = p.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower, "s")
            p = p.select("g", "c", (F.col("own") + F.col("w") * F.col("q")).alias("p"))
        below = saved(p, "kn-probabilities")
        rows, w = below.select(F.lit(n).alias("n"), "g", "c", "p"), context.select(F.lit(n).alias("n"), "h", "w")
        every = rows if every is None else every.unionByName(rows)
        weights = w if weights is None else weights.unionByName(w)
    return every, saved(weights, "kn-weights")


def log_probabilities(wanted: DataFrame, every: DataFrame, weights: DataFrame, order: int = ORDER) -> DataFrame:
    """g, l for the distinct grams of ``wanted``: of the longest end that was counted, times the weights of the longer contexts.
    Tables of up to two bytes, 65,536 rows at most, are broadcast; an end of three bytes has as many grams at most."""
    few = lambda df, size: F.broadcast(df) if size < 3 else df
    todo = wanted.select("g").distinct().withColumn("l", F.lit(0.0)).withColumn("done", F.lit(False))
    for n in range(order, 0, -1):
        s = F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))
        p = every.where(F.col("n") == n).select(F.col("g").alias("s"), F.log("p").alias("lp"))
        w = weights.where(F.col("n") == n).select(F.col("h").alias("hh"), F.log("w").alias("lw"))
        both = todo.withColumn("s", s).join(few(p, n), "s", "left").withColumn("hh", F.shiftright("s", 8)).join(few(w, n - 1), "hh", "left")
        more = F.when(F.col("done"), 0.0).otherwise(F.coalesce("lp", "lw", F.lit(0.0)))
        todo = both.select("g", (F.col("l") + more).alias("l"), (F.col("done") | F.col("lp").isNotNull()).alias("done"))
    return todo.select("g", (F.col("l") + F.when(F.col("done"), 0.0).otherwise(float(np.log(1 / 256)))).alias("l"))


def most_counted(every: DataFrame, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Grams of the highest order with their log probabilities, by gram: about HOT of the most counted, never more than twice that."""
    top = every.where(F.col("n") == order)
    total = top.count()
    if total > HOT:
        top = top.join(F.broadcast(top.agg(F.percentile_approx("c", 1 - HOT / total, 100_000).alias("least"))), F.col("c") > F.col("least"))
    t = top.select("g", "p").limit(2 * HOT).toArrow()
    g, p = t.column("g").to_numpy(), t.column("p").to_numpy()
    rank = np.argsort(g)
    return g[rank], np.log(p[rank])


def _piece_scores(g: np.ndarray, l: np.ndarray, data: bytes) -> pa.RecordBatch:
    """The stored rows of a piece with their perplexities, from its grams."""
    rank = np.argsort(g, kind="stable")
    g, l = g[rank], l[rank]
    rows = pa.ipc.open_stream(data).read_next_batch()
    out = []
    for step in pieces([rows], "bytes", STEP_BYTES):
        text, offsets = flat(step.column(4))
        size = np.diff(offsets)
        here, inverse = np.unique(grams(text, offsets), return_inverse=True)
        total = np.append(0.0, np.cumsum(l[np.searchsorted(g, here)][inverse])) if len(text) else np.zeros(1)
        mean = -(total[offsets[1:]] - total[offsets[:-1]]) / np.maximum(1, size)
        out.append(pa.array(np.exp(mean), pa.float64(), mask=size == 0))
    perplexity = pa.chunked_array(out, pa.float64()).combine_chunks()
    return pa.RecordBatch.from_arrays([*rows.columns[:4], perplexity], names=["doc", "lang", "trusted", "counted", "perplexity"])


def score(rows: DataFrame, model: tuple[DataFrame, DataFrame], kind: str) -> DataFrame:
    """doc, lang, trusted, counted, perplexity of every packed row; doc has the type ``kind``."""
    hot = rows.sparkSession.sparkContext.broadcast(most_counted(model[0]))
    wanted = _wanted(rows, hot)
    known = wanted.join(log_probabilities(wanted, *model), "g")

    def packs(batches):
        for batch in batches:
            piece, g, l = (c.to_numpy() for c in batch.columns)
            rank = np.argsort(piece, kind="stable")
            first = np.flatnonzero(np.append(True, np.diff(piece[rank]) != 0)) if len(rank) else []
            runs = np.split(rank, first[1:]) if len(rank) else []
            columns = [pa.array(piece[rank[first]]) if len(rank) else pa.array([], pa.int64()), pa.array([0] * len(runs), pa.int32()), pa.array([g[x].tobytes() + l[x].tobytes() for x in runs], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["piece", "seq", "data"])

    sent = known.select("piece", "g", "l").mapInArrow(packs, "piece bigint, seq int, data binary")
    sent = sent.unionByName(rows.where(F.col("kind") == _TEXTS).select("piece", (F.col("seq") + 1).alias("seq"), "data"))

    def run(batches):
        at, g, l, parts = None, [], [], []

        def done():
            return _piece_scores(np.concatenate([hot.value[0], *g]), np.concatenate([hot.value[1], *l]), b"".join(parts))

        for batch in batches:
            if not batch.num_rows:
                continue
            piece = batch.column(0).to_numpy()
            first = np.flatnonzero(np.append(True, piece[1:] != piece[:-1])).tolist()
            for a, b in zip(first, [*first[1:], batch.num_rows], strict=True):
                if parts and piece[a] != at:
                    yield done()
                    g, l, parts = [], [], []
                at, run = piece[a], batch.slice(a, b - a)
                for seq, data in zip(run.column(1).to_pylist(), run.column(2).to_pylist(), strict=True):
                    if seq:
                        parts.append(data)
                    else:
                        g.append(np.frombuffer(data, np.int64, len(data) // 16))
                        l.append(np.frombuffer(data, np.float64, offset=len(data) // 2))
        if parts:
            yield done()

    dealt = sent.repartition("piece").sortWithinPartitions("piece", "seq")
    return dealt.select("piece", "seq", "data").mapInArrow(run, f"doc {kind}, lang string, trusted boolean, counted boolean, perplexity double")


@tidy
def classify(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """key, lang, perplexity, threshold, trusted, kept for every document; trusted are those labelled good and not toxic."""
    good = saved(labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("string").alias("good")).distinct(), "kn-trusted")
    good = good.withColumn("trusted", F.lit(True))
    source = docs.select(F.col(key).alias("doc"), F.coalesce(F.col(lang), F.lit("und")).alias("lang"), text_bytes(text).alias("bytes"))
    source = source.join(F.broadcast(good) if is_small(good, BROADCAST_BYTES) else good, F.col("doc").cast("string") == F.col("good"), "left")
    trusted = F.coalesce("trusted", F.lit(False))
    rows = packed(source.select("doc", "lang", trusted.alias("trusted"), (trusted & (F.crc32("bytes") % HELD != 0)).alias("counted"), "bytes"))
    model = train(_train_counts(rows))
    kind = docs.schema[key].dataType.simpleString()
    if model[0].limit(1).count():
        scored = saved(score(rows, model, kind), "kn-scores")
    else:
        scored = source.select("doc", "lang", trusted.alias("trusted"), F.lit(False).alias("counted"), F.lit(None).cast("double").alias("perplexity"))
    sure = scored.where("trusted and perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, 10000)
    limits = saved(sure.where("not counted").groupBy("lang").agg(limit.alias("threshold")), "kn-limits")
    held = F.percentile_approx(F.when(~F.col("counted"), F.col("perplexity")), quantile, 10000)
    overall = sure.agg(F.coalesce(held, limit).alias("overall"))  # one row
    out = scored.join(F.broadcast(limits) if is_small(limits, BROADCAST_BYTES) else limits, "lang", "left")
    out = out.join(F.broadcast(overall), F.lit(True), "left").withColumn("threshold", F.coalesce("threshold", "overall"))
    kept = F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(False))
    return out.select(F.col("doc").alias(key), "lang", "perplexity", "threshold", "trusted", kept.alias("kept"))
