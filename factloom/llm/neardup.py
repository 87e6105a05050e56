"""Near-duplicate groups by MinHash bands, odd sketches and an exact check.

Words are runs of bytes other than white space, A-Z lower-cased; a text's set holds its distinct w-word
shingles as 52-bit hashes. Texts with equal sets form a class, and classes go on alone. Each class has
MinHash samples in bands, and an odd sketch: the samples folded into a parity bitmap, whose XOR with another
one has a population count that tells a high similarity precisely.

Links are found in two steps, neither of which emits the pairs of a bucket:
1. every class and the head of the buckets that it shares most bands with, the head of a bucket being the
   member that has met most others: one pair a class;
2. buckets that still hold several components: members outside the largest one against all members, in cells
   of bounded bytes that carry the full sets. A cell compares the sketches of pairs of different components,
   confirms what they leave on the full sets at once, and emits a spanning forest of what it found.
Both pass the odd sketch (a bound far below the threshold) and confirm on full sets. Components are labelled
by their smallest id through iterated joins.

Defined results: null, empty and blank texts have no shingle and stay alone; fewer words than w make one
shingle; repeated rows are copies of one another; an id that stands on several texts links what they link
with; null ids are never linked; keys that are no integers are refused; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, is_small, pieces, ragged, release, saved, text_bytes, tidy, whole_number

BANDS, ROWS = 32, 5
#: MinHash samples of a sketch (those of the bands come first), and bits of its parity bitmap.
SAMPLES, BITS = 480, 2048
#: Tables up to so many bytes are broadcast; larger ones are joined by shuffle.
BROADCAST_BYTES = 8 << 20
#: Bytes of text that are hashed at a time.
STEP_BYTES = 1 << 19
#: Bytes of the members on either side of a cell in step 2; a longer member stands there alone.
CELL_BYTES = 6 << 20

_rng = np.random.default_rng(20240607)
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MULTIPLY = _rng.integers(0, 1 << 31, SAMPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_FLIP = _rng.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
_BASE, _M1, _M2 = 0x9E3779B97F4A7C15, np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        size = 1 << n.bit_length()
        with np.errstate(over="ignore"):
            for i, b in enumerate((_BASE, _INVERSE)):
                _powers[i] = np.cumprod(np.append(np.uint64(1), np.full(size, b, np.uint64)), dtype=np.uint64)
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct 52-bit shingle hashes of each text, and their offsets. At most 4095 texts at a time."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    word = (low != 32) & ((low < 9) | (low > 13))
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.append(False, word[:-1]) & ~first[:-1]
    starts = np.flatnonzero(word & ~before)
    after = np.append(word[1:], False) & ~first[1:]
    ends = np.flatnonzero(word & ~after) + 1
    power, inverse = _power(len(data) + 1)[:2]
    with np.errstate(over="ignore"):
        total = np.append(np.uint64(0), np.cumsum(_BYTE[low] * power[: len(low)], dtype=np.uint64))
        h = mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
        doc = (np.searchsorted(offsets, starts, side="right") - 1).astype(np.int64)
        words = np.bincount(doc, minlength=n)
        s = h.copy() if width == 1 else h[: max(0, len(h) - width + 1)].copy()
        for k in range(1, width):
            s = mix(s * np.uint64(_BASE) + h[k : len(h) - width + 1 + k])
        same = doc[: len(s)] == doc[width - 1 :] if len(s) else np.zeros(0, bool)
        s, owner = s[same], doc[: len(same)][same]
        few = np.flatnonzero((words > 0) & (words < width))
        if len(few):  # the whole sequence as one shingle
            head = np.cumsum(words) - words
            one = np.zeros(len(few), np.uint64)
            for k in range(width - 1):
                has = words[few] > k
                one = np.where(has, mix(one * np.uint64(_BASE) + h[np.where(has, head[few] + k, 0)] + np.uint64(k + 1)), one)
            s, owner = np.append(s, mix(one)), np.append(owner, few)
    key = np.sort((owner.astype(np.uint64) << np.uint64(52)) | (s >> np.uint64(12)))
    if len(key):
        key = key[np.append(True, key[1:] != key[:-1])]
    edges = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(52))
    return key & np.uint64((1 << 52) - 1), edges


def signatures(sets: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each non-empty set: MinHash samples, band keys, odd sketch (as 64-bit words)."""
    x = (sets >> np.uint64(20)).astype(np.uint32)
    heads = edges[:-1]
    samples = np.empty((len(heads), SAMPLES), np.uint32)
    for i in range(SAMPLES):
        samples[:, i] = np.minimum.reduceat((x ^ _FLIP[i]) * _MULTIPLY[i], heads)
    with np.errstate(over="ignore"):
        key = np.zeros((len(heads), BANDS), np.uint64)
        for r in range(ROWS):
            key = mix(key * np.uint64(_BASE) + samples[:, r : BANDS * ROWS : ROWS].astype(np.uint64) + np.uint64(1))
        key = mix(key + np.arange(1, BANDS + 1, dtype=np.uint64) * _M1)
        bit = mix(samples.astype(np.uint64) * _M2 + np.arange(1, SAMPLES + 1, dtype=np.uint64)) >> np.uint64(64 - (BITS - 1).bit_length())
    sketch, rows = np.zeros((len(heads), BITS // 64), np.uint64), np.arange(len(heads))
    for i in range(SAMPLES):
        sketch[rows, bit[:, i] >> np.uint64(6)] ^= np.uint64(1) << (bit[:, i] & np.uint64(63))
    return samples, key.view(np.int64), sketch


def most_odd(threshold: int) -> int:
    """The XOR's population count that pairs at the threshold stay under: five deviations above its mean, of sampling and of parity together."""
    differ, j = SAMPLES * (1 - threshold / 100), threshold / 100
    fade = (1 - 2 / BITS) ** (2 * differ)
    sampling, parity = 2 * fade * np.sqrt(SAMPLES * j * (1 - j)), 2 * differ * np.sqrt(2 / BITS)
    return int(BITS / 2 * (1 - fade) + 5 * np.hypot(sampling, parity))


def estimate(odd: np.ndarray) -> np.ndarray:
    """Similarity that a population count stands for."""
    return 1 + BITS / (4 * SAMPLES) * np.log(np.maximum(1e-9, 1 - 2 * odd / BITS))


def _keys(sets: np.ndarray, edges: np.ndarray) -> list[bytes | None]:
    """Sixteen bytes that stand for each set; None for an empty one."""
    size = np.diff(edges)
    some = np.flatnonzero(size)
    out: list[bytes | None] = [None] * len(size)
    if len(some):
        heads = edges[:-1][some]
        with np.errstate(over="ignore"):
            both = np.stack([np.bitwise_xor.reduceat(mix(sets + np.uint64(1)), heads), np.add.reduceat(mix(sets * _M2 + np.uint64(3)), heads)], axis=1)
        for i, row in zip(some.tolist(), both, strict=True):
            out[i] = row.tobytes()
    return out


def sketched(df: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """key, n (set size), k (the set's key), sketch, bands for each row; the last three are null for empty sets."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in pieces(batches, "bytes", STEP_BYTES):
            for at in range(0, batch.num_rows, 4000):
                part = batch.slice(at, 4000)
                sets, edges = shingle_sets(*flat(part.column(1)), width)
                size = np.diff(edges)
                some = np.flatnonzero(size)
                sketches, bands = [None] * len(size), np.zeros((0, BANDS), np.int64)
                if len(some):
                    _, bands, rows = signatures(sets, np.append(edges[:-1][some], len(sets)))
                    for i, row in zip(some.tolist(), rows, strict=True):
                        sketches[i] = row.tobytes()
                offsets = np.append(0, np.cumsum(np.where(size > 0, BANDS, 0)))
                bands = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(bands.reshape(-1)))
                columns = [part.column(0), pa.array(size, pa.int64()), pa.array(_keys(sets, edges), pa.binary()), pa.array(sketches, pa.binary()), bands]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "n", "k", "sketch", "bands"])

    return df.select(key, text_bytes(text).alias("bytes")).mapInArrow(run, f"`{key}` {kind}, n bigint, k binary, sketch binary, bands array<bigint>")


def full_sets(df: DataFrame, text: str, width: int) -> DataFrame:
    """k, s: key and sorted hashes of the set, eight bytes each, for each row of ``df`` that has any."""

    def run(batches):
        for batch in pieces(batches, "bytes", STEP_BYTES):
            for at in range(0, batch.num_rows, 4000):
                sets, edges = shingle_sets(*flat(batch.slice(at, 4000).column(0)), width)
                raw = memoryview(sets.tobytes())
                rows = [raw[8 * a : 8 * b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(_keys(sets, edges), pa.binary()), pa.array(rows, pa.binary())], names=["k", "s"])

    return df.select(text_bytes(text).alias("bytes")).mapInArrow(run, "k binary, s binary").where("k is not null")


def _sets_of(classes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """k, s of ``classes`` (k, id), made from the texts of (id, text), saved."""
    few = saved(classes.select("k", "id").distinct(), "near-needed")
    small = is_small(few, BROADCAST_BYTES)
    texts = docs.join(F.broadcast(few.select("id").distinct()) if small else few.select("id").distinct(), "id", "left_semi")
    sets = full_sets(texts, "text", width).join(F.broadcast(few.select("k")) if small else few.select("k"), "k", "left_semi")
    return saved(sets.dropDuplicates(["k"]), "near-sets")


def _reaches(one: np.ndarray, many: np.ndarray, sizes: np.ndarray, threshold: int) -> np.ndarray:
    """Whether each of the sorted sets that ``many`` holds one after the other is at the threshold with the set ``one``."""
    at = np.minimum(np.searchsorted(one, many), len(one) - 1)
    common = np.add.reduceat((one[at] == many).astype(np.int64), np.append(0, np.cumsum(sizes)[:-1]))
    return 100 * common >= threshold * (len(one) + sizes - common)


def _near(pairs: DataFrame, classes: DataFrame, limit: int) -> DataFrame:
    """The pairs (a, b) that odd sketches leave, saved."""
    side = lambda x: classes.select(F.col("k").alias(x), F.col("sketch").alias(f"s{x}"))

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = (flat(batch.column(i))[0].copy().view(np.uint64).reshape(batch.num_rows, -1) for i in (2, 3))
            keep = pa.array(np.bitwise_count(a ^ b).sum(axis=1) <= limit)
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb")
    return saved(both.mapInArrow(run, "a binary, b binary"), "near-first")


def _confirmed(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs whose full sets reach the threshold, saved."""
    side = lambda x, s: sets.select(F.col("k").alias(x), F.col("s").alias(s))

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                keep.append(bool(_reaches(x, y, np.array([len(y)]), threshold)[0]))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    both = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b").select("a", "b", "x", "y")
    return saved(both.mapInArrow(run, "a binary, b binary"), "near-links")


def components(classes: DataFrame, links: DataFrame) -> DataFrame:
    """k, label (the smallest id reachable) for the ends of the links (a, b); ``classes`` has k and the id to start from."""
    both = saved(links.select("a", "b").union(links.select("b", "a")).distinct(), "near-edges")
    ends = both.select(F.col("a").alias("k")).distinct()
    labels = saved(classes.join(ends, "k").select("k", F.col("id").alias("start"), F.col("id").alias("label")), "near-labels")
    while True:
        heard = both.join(labels, F.col("b") == F.col("k")).groupBy("a").agg(F.min("label").alias("heard"))
        new = labels.join(heard, F.col("k") == F.col("a")).select("k", "start", F.col("label").alias("old"), F.least("label", "heard").alias("mid"))
        jump = labels.groupBy(F.col("start").alias("at")).agg(F.min("label").alias("far"))
        new = new.join(jump, F.col("mid") == F.col("at"), "left")
        new = saved(new.select("k", "start", "old", F.least("mid", F.coalesce("far", "mid")).alias("label")), "near-labels")
        if not new.where("old <> label").limit(1).count():
            return new.select("k", "label")
        labels = new.select("k", "start", "label")


def _compare(side, label, sketches, bands, sets, edges, bucket: int, limit: int, threshold: int) -> list[tuple[int, int]]:
    """Links of a cell's rows, a spanning forest over their labels: side 0 against side 1, each pair in the first bucket
    that it shares."""
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    group = np.unique(label, return_inverse=True)[1]
    size = np.diff(edges)
    out = []
    for i in left.tolist():
        apart = right[group[right] != group[i]]
        near = apart[np.bitwise_count(sketches[apart] ^ sketches[i]).sum(axis=1) <= limit]
        if not len(near):
            continue
        near = near[bands[i][np.argmax(bands[near] == bands[i], axis=1)] == bucket]
        if not len(near):
            continue
        hit = near[_reaches(sets[edges[i] : edges[i + 1]], sets[ragged(edges[near], size[near])], size[near], threshold)]
        for j in hit.tolist():
            if group[i] != group[j]:
                out.append((i, j))
                group[group == group[j]] = group[i]
    return out


def _cells(members: DataFrame, payload: DataFrame, limit: int, threshold: int) -> DataFrame:
    """Links (a, b) between components in the buckets of ``members`` (bucket, k, label, w: bytes); ``payload`` has what
    stands behind k. Members outside a bucket's largest component meet all members, in cells of bounded bytes."""
    sizes = members.groupBy("bucket", "label").agg(F.sum("w").alias("w"))
    spread = sizes.groupBy("bucket").agg(F.sum("w").alias("w"), F.max(F.struct("w", "label")).alias("top"))
    cut = lambda w: F.ceil(w / CELL_BYTES).cast("int")
    spread = spread.select("bucket", F.col("top.label").alias("top"), cut(F.col("w")).alias("all"), cut(F.col("w") - F.col("top.w")).alias("out"))
    rows = members.join(spread, "bucket")
    place = lambda of: F.pmod(F.xxhash64("k"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    minor = rows.where("label <> top").select("bucket", place("out").alias("i"), every("all").alias("j"), F.lit(0).alias("side"), "k", "label")
    all_ = rows.select("bucket", every("out").alias("i"), place("all").alias("j"), F.lit(1).alias("side"), "k", "label")
    cells = minor.unionByName(all_).join(payload, "k").select("bucket", "i", "j", "side", "label", "k", "sketch", "bands", "s")
    cells = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")

    def links(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        side, label = (t.column(c).to_numpy() for c in (3, 4))
        sketches = flat(t.column(6))[0].copy().view(np.uint64).reshape(t.num_rows, -1)
        bands = t.column(7).flatten().to_numpy().reshape(t.num_rows, BANDS)
        sets, edges = flat(t.column(8))
        found = _compare(side, label, sketches, bands, sets.copy().view(np.uint64), edges // 8, t.column(0)[0].as_py(), limit, threshold)
        ends = [pa.array([x[e] for x in found], pa.int64()) for e in (0, 1)]
        return pa.RecordBatch.from_arrays([t.column(5).take(e) for e in ends], names=["a", "b"])

    def run(batches):
        held, at = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(3)], axis=1)
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(axis=1))).tolist()
            for a, b in zip(first, [*first[1:], batch.num_rows], strict=True):
                here = key[a].tolist()
                if held and here != at:
                    yield links(held)
                    held = []
                held.append(batch.slice(a, b - a))
                at = here
        if held:
            yield links(held)
        release()

    return cells.mapInArrow(run, "a binary, b binary")


@tidy
def groups(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: int = 80) -> DataFrame:
    """key, n_shingles, component_id, kept, class_id for every row."""
    whole_number(df, key)
    rows = saved(sketched(df, text, key, width).withColumnRenamed(key, "id").withColumn("id", F.col("id").cast("bigint")), "near-rows")
    some = rows.where("k is not null and id is not null")
    first = [F.first(c).alias(c) for c in ("n", "sketch", "bands")]
    classes = saved(some.groupBy("k").agg(F.min("id").alias("id"), *first), "near-classes")
    banded = classes.select("k", "id", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count("*").alias("m")).where("m > 1")
    joined = saved(banded.join(shared, "bucket"), "near-joined")
    # the original of a group meets most others: what has met most is its buckets' head
    met = joined.groupBy("k").agg(F.sum("m").alias("met"))
    heads = joined.join(met, "k").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("id")).alias("back"), "k")).alias("h")).select("bucket", F.col("h.k").alias("head"))
    limit = most_odd(threshold)
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text"))
    # 1. each class and the head that it shares most buckets with
    met_heads = joined.join(heads, "bucket").where("k <> head").groupBy("k", "head").agg(F.count("*").alias("m"))
    stars = met_heads.groupBy("k").agg(F.max_by("head", F.struct("m", "head")).alias("head"))
    stars = stars.select(F.greatest("k", "head").alias("a"), F.least("k", "head").alias("b")).distinct()
    stars = _near(stars, classes, limit)
    ends = stars.select(F.col("a").alias("k")).union(stars.select("b")).distinct()
    found = _confirmed(stars, _sets_of(classes.join(ends, "k"), docs, width), threshold)
    # texts under one id stand for one document
    under = some.groupBy("id").agg(F.min("k").alias("a"), F.max("k").alias("z")).where("a <> z").select("id", "a")
    alike = some.join(under, "id").where("k <> a").select("a", F.col("k").alias("b")).distinct()
    found = saved(found.unionByName(alike), "near-links")
    label = components(classes, found)
    # 2. buckets that still hold several components
    named = joined.join(label, "k", "left").select("bucket", "k", "id", F.coalesce("label", "id").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("bucket")
    open_ = saved(named.join(mixed, "bucket"), "near-open")
    payload = _sets_of(open_, docs, width).join(classes.select("k", "sketch", "bands"), "k")
    payload = saved(payload, "near-payload")
    weights = payload.select("k", (F.octet_length("s") + F.octet_length("sketch") + 8 * BANDS).cast("bigint").alias("w"))
    links = _cells(open_.select("bucket", "k", "label").join(weights, "k"), payload, limit, threshold)
    label = components(classes, saved(found.unionByName(links), "near-links"))
    named = classes.select("k", F.col("id").alias("class_id")).join(label, "k", "left").select("k", "class_id", F.coalesce("label", "class_id").alias("label"))
    out = rows.select("id", "n", "k").join(named, "k", "left")
    linked = F.col("k").isNotNull() & F.col("id").isNotNull()
    component = F.when(linked, F.col("label")).otherwise(F.col("id"))
    return out.select(
        F.col("id").alias(key), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
        F.when(linked, F.col("class_id")).otherwise(F.col("id")).alias("class_id"),
    )


def drop_near_copies(df: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, threshold: int = 80) -> DataFrame:
    """One document of each group stays: the one of the smallest id (one row, if that is repeated)."""
    found = groups(df, text, key, width, threshold)
    out = saved(found.where(~F.col("kept")).select(F.col(key).alias("_gone")).distinct(), "near-gone")
    gone = F.broadcast(out) if is_small(out, BROADCAST_BYTES) else out
    stay = df.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    twice = saved(found.where(F.col("kept") & F.col(key).isNotNull()).groupBy(F.col(key).alias("_twice")).count().where("count > 1").select("_twice"), "near-twice")
    if not twice.limit(1).count():
        return stay
    again = F.col(key) == F.col("_twice")
    return stay.join(twice, again, "left_anti").unionByName(stay.join(twice, again, "left_semi").dropDuplicates([key]))
