"""Exact repeats by enhanced suffix arrays over anchored strings.

Any string of LENGTH bytes holds, among its KGRAM-byte grams, one of least hash: its anchor. Equal strings
have equal anchors at equal places, so the windows of LENGTH bytes that an anchor owns (a run of starts, all
in the string U from the first start to the last window's end) need to be compared with those of equal
anchors only, and each window of the corpus lies in one U.

1. Anchors are counted by (hash of the gram, hash of U): a class. A class of two or more is repeated whole.
2. Where an anchor has several classes, one U of each goes to the anchor's group. There an enhanced suffix
   array is built over the group's strings (prefix doubling, LCP by the levels' ranks), a stack scan walks
   the tree of common-prefix intervals, and those of LENGTH bytes or more whose left extensions differ are
   the maximal repeat groups, each with all of its occurrences. A U's start counts as differing.
   Anchors with very many classes (a common line in many contexts) are not put into one task: the hashes of
   their classes' windows are counted instead, pre-aggregated. Both ways find the same windows, so the results
   do not depend on which is taken.
3. ``remove`` merges what repeats cover in each document and cuts it out; ``groups`` returns the repeat groups
   themselves, each with all of its occurrences in the corpus.

Defined results: null text counts as empty; texts under LENGTH bytes lose nothing; repeated rows repeat each
other, so both lose what they share; null and repeated ids are told apart by their texts' hashes; an empty
table gives an empty result; keys that are no integers are refused; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, is_small, pieces, ragged, saved, text_bytes, tidy, whole_number
from .neardup import _BYTE, _power, mix

LENGTH, KGRAM = 200, 32
#: Classes of an anchor that one task compares by suffix array.
GROUP_CLASSES = 2048
#: Bytes of strings that go into one suffix array, besides a single group.
BUFFER_BYTES = 1 << 20
BROADCAST_BYTES = 512 << 10
_NO_ID = -(1 << 63)


class Hashes:
    """Hashes of any substrings of a byte array, from running sums."""

    def __init__(self, data: np.ndarray):
        power, self.inverse = _power(len(data) + 1)[:2]
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(_BYTE[data] * power[: len(data)], out=self.total[1:])

    def of(self, starts, ends) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.total[ends] - self.total[starts]) * self.inverse[starts])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, kgram: int = KGRAM) -> tuple[np.ndarray, ...]:
    """Of each anchor: number of the text, U's start in the text, U's length, hash of the gram, hash of U."""
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return none, none, none, none, none
    n, width = len(data), length - kgram + 1
    hashes = Hashes(data)
    with np.errstate(over="ignore"):
        gram = mix((hashes.total[kgram:] - hashes.total[: n - kgram + 1]) * hashes.inverse[: n - kgram + 1])
    least = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        least = np.minimum(least[: len(least) - step], least[step:])
        step *= 2
    if width > step:
        least = np.minimum(least[: len(least) - (width - step)], least[width - step :])
    # least[s] is for the window that starts at s
    sizes = np.diff(offsets)
    starts = ragged(offsets[:-1], np.maximum(0, sizes - length + 1))
    if not len(starts):
        return none, none, none, none, none
    place = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    new = np.append(True, place[1:] != place[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    begin, end, at = starts[first], starts[last] + length, place[first]
    doc = np.searchsorted(offsets, begin, side="right") - 1
    u = hashes.of(begin, end) ^ mix((end - begin).astype(np.uint64) << np.uint64(20) | (at - begin).astype(np.uint64))
    return doc, begin - offsets[doc], end - begin, gram[at].view(np.int64), u.view(np.int64)


def suffix_array(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Enhanced suffix array over the strings' suffixes of ``length`` bytes or more: text, string number of each suffix,
    place in the string, length of the common prefix with the one before, left byte (differing negatives at a start)."""
    sizes = np.array([len(s) for s in strings], np.int64)
    text = np.frombuffer(b"".join(strings), np.uint8)
    n = len(text)
    edges = np.append(0, np.cumsum(sizes))
    owner = np.repeat(np.arange(len(strings)), sizes)
    room = edges[1:][owner] - np.arange(n)
    word = np.zeros(n + 8, np.uint64)
    padded = np.append(text, np.zeros(8, np.uint8)).astype(np.uint64)
    for k in range(8):
        word[:n] = word[:n] << np.uint64(8) | padded[k : n + k]
    rank = np.unique(word[:n], return_inverse=True)[1].astype(np.int64)
    levels, span = [(8, rank)], 8
    longest = int(sizes.max()) if len(sizes) else 0
    while span < longest and int(rank.max(initial=0)) < n - 1:
        ahead = np.full(n, -1, np.int64)
        ahead[: n - span] = rank[span:] if n > span else ahead[:0]
        rank = np.unique(rank * (n + 1) + ahead + 1, return_inverse=True)[1].astype(np.int64)
        span *= 2
        levels.append((span, rank))
    keep = np.flatnonzero(room >= length)
    sa = keep[np.argsort(rank[keep], kind="stable")]
    lcp = np.zeros(len(sa), np.int64)
    if len(sa) > 1:
        a, b, common = sa[:-1].copy(), sa[1:].copy(), np.zeros(len(sa) - 1, np.int64)
        most = np.minimum(room[sa[:-1]], room[sa[1:]])
        for span, rank in [levels[-1], *reversed(levels)]:
            inside = (a < n) & (b < n)
            same = inside & (rank[np.minimum(a, n - 1)] == rank[np.minimum(b, n - 1)])
            a, b, common = a + span * same, b + span * same, common + span * same
        for _ in range(7):
            same = (a < n) & (b < n)
            same &= text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)]
            going = same & (common < most)
            a, b, common = a + going, b + going, common + going
        lcp[1:] = np.minimum(common, most)
    left = np.where(sa == edges[owner[sa]], -1 - sa, text[np.maximum(sa - 1, 0)].astype(np.int64))
    return text, owner[sa], sa - edges[owner[sa]], lcp, left


def intervals(lcp: np.ndarray, left: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stack scan of the common-prefix interval tree: lengths and bounds of the intervals of ``length`` or more whose left extensions differ."""
    changes = np.cumsum(np.append(0, left[1:] != left[:-1])) if len(left) else np.zeros(0, np.int64)
    out: list[tuple[int, int, int]] = []
    long = np.flatnonzero(lcp >= length)
    if not len(long):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    breaks = np.flatnonzero(np.diff(long) > 1)
    for low, high in zip(long[np.append(0, breaks + 1)].tolist(), long[np.append(breaks, len(long) - 1)].tolist(), strict=True):
        part = lcp[low : high + 1]
        if (part == part[0]).all():
            out.append((int(part[0]), low - 1, high))
            continue
        stack: list[tuple[int, int]] = []
        for i, depth in enumerate(part.tolist(), low):
            start = i - 1
            while stack and stack[-1][0] > depth:
                deep, start = stack.pop()
                out.append((deep, start, i - 1))
            if not stack or stack[-1][0] < depth:
                stack.append((depth, start))
        out += [(deep, start, high) for deep, start in stack]
    found = np.array(out, np.int64)
    found = found[changes[found[:, 2]] > changes[found[:, 1]]]
    return found[:, 0], found[:, 1], found[:, 2]


def maximal_repeats(strings: list[bytes], length: int = LENGTH) -> list[tuple[int, list[tuple[int, int]]]]:
    """Every maximal repeat of ``length`` bytes or more: its length and all occurrences (string, place)."""
    _, owner, place, lcp, left = suffix_array(strings, length)
    return [(int(d), sorted(zip(owner[a : b + 1].tolist(), place[a : b + 1].tolist(), strict=True))) for d, a, b in zip(*intervals(lcp, left, length), strict=True)]


def spans_of(strings: list[bytes], length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(string, start, end) of what the occurrences of all maximal repeats cover, merged."""
    _, owner, place, lcp, left = suffix_array(strings, length)
    depth, low, high = intervals(lcp, left, length)
    at = ragged(low, high - low + 1)
    size = np.repeat(depth, high - low + 1)
    return merged(owner[at], place[at], place[at] + size)


def merged(owner: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, int]]:
    """Unions of touching spans of each owner."""
    if not len(owner):
        return []
    order = np.lexsort((start, owner))
    owner, start, end = owner[order], start[order], end[order]
    shift = owner * (int(end.max()) + 2)
    reach = np.maximum.accumulate(end + shift)
    head = np.append(True, start[1:] + shift[1:] > reach[:-1])
    first = np.flatnonzero(head)
    final = np.append(first[1:], len(head)) - 1
    return list(zip(owner[first].tolist(), start[first].tolist(), (reach[final] - shift[final]).tolist(), strict=True))


def _anchor_rows(source: DataFrame, length: int, once: bool) -> DataFrame:
    """a, u, doc, th, start, size for all anchors of (doc, th, bytes); ``once``: with n, one row for each class of a chunk."""

    def run(batches):
        for batch in pieces(batches, "bytes"):
            doc, start, size, a, u = anchors(*flat(batch.column(2)), length)
            n = np.ones(len(a), np.int64)
            if once and len(a):
                order = np.lexsort((u, a))
                head = np.append(True, (a[order][1:] != a[order][:-1]) | (u[order][1:] != u[order][:-1]))
                n = np.diff(np.append(np.flatnonzero(head), len(a)))
                first = order[head]
                doc, start, size, a, u = doc[first], start[first], size[first], a[first], u[first]
            at = pa.array(doc, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(u, pa.int64()), batch.column(0).take(at), batch.column(1).take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32()), pa.array(n, pa.int32())], names=["a", "u", "doc", "th", "start", "size", "n"])

    return source.select("doc", "th", "bytes").where(F.length("bytes") >= length).mapInArrow(run, "a bigint, u bigint, doc bigint, th bigint, start int, size int, n int")


def _strings(source: DataFrame, wanted: DataFrame) -> DataFrame:
    """a, u, s: the bytes of each wanted (a, u, doc, th, start, size)."""
    lists = saved(wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("a", "u", "start", "size")).alias("want")), "repeat-wanted")
    lists = F.broadcast(lists) if is_small(lists, BROADCAST_BYTES) else lists
    joined = source.join(lists, ["doc", "th"]).select("bytes", F.explode("want").alias("w"))
    return joined.select("w.a", "w.u", F.expr("substring(bytes, w.start + 1, w.size)").alias("s"))


def _by_suffix_array(strings: DataFrame, length: int) -> DataFrame:
    """a, u, spans of the classes whose group is compared in one task."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []
        size = 0

        def out():
            # one array for many groups: a window stands in one string only, so every match is a true one
            spans: dict[int, list] = {}
            for i, start, end in spans_of([s for _, _, s in held], length):
                spans.setdefault(i, []).append({"s": start, "e": end})
            rows = sorted(spans)
            return pa.RecordBatch.from_arrays([pa.array([held[i][0] for i in rows], pa.int64()), pa.array([held[i][1] for i in rows], pa.int64()), pa.array([spans[i] for i in rows], kind)], names=["a", "u", "spans"])

        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        for batch in batches:
            for a, u, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and size > BUFFER_BYTES and a != held[-1][0]:
                    yield out()
                    held, size = [], 0
                if not held or (a, u) != held[-1][:2]:
                    held.append((a, u, s))
                    size += len(s)
        if held:
            yield out()

    return strings.repartition("a").sortWithinPartitions("a", "u").mapInArrow(run, "a bigint, u bigint, spans array<struct<s:int,e:int>>")


def _window_rows(strings: DataFrame, length: int) -> DataFrame:
    """a, u, s, h: place and hash of every window of the strings, saved."""

    def run(batches):
        for batch in pieces(batches, "s"):
            data, offsets = flat(batch.column(2))
            counts = np.maximum(0, np.diff(offsets) - length + 1)
            starts = ragged(offsets[:-1], counts)
            owner = pa.array(np.repeat(np.arange(batch.num_rows), counts))
            h = Hashes(data).of(starts, starts + length).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), pa.array((starts - np.repeat(offsets[:-1], counts)).astype(np.int32)), pa.array(h)], names=["a", "u", "s", "h"])

    return saved(strings.dropDuplicates(["a", "u"]).mapInArrow(run, "a bigint, u bigint, s int, h bigint"), "repeat-windows")


def _by_windows(strings: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many classes: windows are counted by hash, wherever they stand."""
    windows = _window_rows(strings, length)
    twice = windows.groupBy("a", "h").count().where("count > 1").select("a", "h")
    hit = windows.join(twice, ["a", "h"])
    return hit.groupBy("a", "u").agg(F.sort_array(F.collect_list(F.struct("s", (F.col("s") + length).cast("int").alias("e")))).alias("spans"))


def _source(df: DataFrame, text: str, key: str) -> DataFrame:
    whole_number(df, key)
    return df.select(F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text_bytes(text)).alias("th"), text_bytes(text).alias("bytes"))


def _classes(source: DataFrame, length: int) -> DataFrame:
    """a, u, n (occurrences), one place, classes (of the anchor) for every class whose anchor stands twice or more, saved."""
    # by anchor, so that its classes meet; rows of a class were put together within each chunk
    rows = _anchor_rows(source, length, once=True).groupBy("a", "u").agg(F.sum("n").alias("n"), F.min(F.struct("doc", "th", "start", "size")).alias("at"))
    rows = saved(rows, "repeat-classes")
    of_anchor = rows.groupBy("a").agg(F.count("*").alias("classes"), F.sum("n").alias("total")).where("total > 1")
    return saved(rows.join(of_anchor, "a").select("a", "u", "n", "at.*", "classes"), "repeat-shared")


def _strings_of(source: DataFrame, classes: DataFrame) -> DataFrame:
    """a, u, s, n, classes of some classes, saved."""
    found = _strings(source, classes.select("a", "u", "doc", "th", "start", "size"))
    return saved(found.join(classes.select("a", "u", "n", "classes"), ["a", "u"]), "repeat-strings")


def _maximal(strings: DataFrame, length: int) -> DataFrame:
    """a, g (number of the group), length, u, at: the maximal repeat groups among an anchor's strings, one suffix array an anchor."""

    def run(batches):
        held: list[tuple[int, int, bytes]] = []

        def out():
            rows = [(held[0][0], g, n, held[i][1], at) for g, (n, where) in enumerate(maximal_repeats([s for _, _, s in held], length)) for i, at in where]
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(types)], names=["a", "g", "length", "u", "at"])

        for batch in batches:
            for a, u, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and a != held[0][0]:
                    yield out()
                    held = []
                if not held or u != held[-1][1]:
                    held.append((a, u, s))
        if held:
            yield out()

    types = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]
    return strings.select("a", "u", "s").repartition("a").sortWithinPartitions("a", "u").mapInArrow(run, "a bigint, g bigint, length int, u bigint, at int")


@tidy
def groups(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """anchor, g, length, key, start: the repeat groups with a row for every occurrence in the corpus, in bytes. A repeat that is longer
    than an anchor's string comes as the groups of its anchors; windows of anchors with very many classes are groups of ``length``."""
    source = _source(df, text, key)
    classes = _classes(source, length)
    strings = _strings_of(source, classes.where("classes > 1"))
    some = saved(_maximal(strings.where(F.col("classes") <= GROUP_CLASSES), length), "repeat-groups")
    windows = _window_rows(strings.where(F.col("classes") > GROUP_CLASSES).select("a", "u", "s"), length)
    many = windows.select("a", F.col("h").alias("g"), F.lit(length).alias("length"), "u", F.col("s").alias("at"))
    # copies of a whole string, unless a group of the same length has them already
    copies = classes.where("n > 1").where(F.col("classes") <= GROUP_CLASSES).select("a", F.col("u").alias("g"), F.col("size").alias("length"), "u", F.lit(0).alias("at"))
    copies = copies.join(some.select("a", "u", "length", "at"), ["a", "u", "length", "at"], "left_anti").select("a", "g", "length", "u", "at")
    alone = many.groupBy("a", "g").agg(F.count("*").alias("c")).join(many, ["a", "g"]).join(classes.select("a", "u", "n"), ["a", "u"]).where("c > 1 or n > 1").select("a", "g", "length", "u", "at")
    found = some.unionByName(copies).unionByName(alone)
    places = _anchor_rows(source, length, once=False).select("a", "u", "doc", "start")
    rows = places.join(found, ["a", "u"])
    return rows.select(F.col("a").alias("anchor"), "g", "length", F.nullif("doc", F.lit(_NO_ID)).alias(key), (F.col("start") + F.col("at")).alias("start"))


def spans(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH) -> DataFrame:
    """doc, th, spans: what each text repeats, as unmerged (start, end) in bytes."""
    source = _source(df, text, key)
    classes = _classes(source, length)
    whole = classes.where("n > 1").select("a", "u", F.array(F.struct(F.lit(0).alias("s"), F.col("size").alias("e"))).alias("spans"))
    # anchors in which a class of one may be part of another
    open_ = classes.where("n = 1 and classes > 1").select("a").distinct()
    strings = _strings_of(source, classes.where("classes > 1").join(open_, "a", "left_semi"))
    some = _by_suffix_array(strings.where(F.col("classes") <= GROUP_CLASSES).select("a", "u", "s"), length)
    many = _by_windows(strings.where(F.col("classes") > GROUP_CLASSES).select("a", "u", "s"), length)
    single = strings.where("n = 1").select("a", "u").distinct()
    found = whole.unionByName(some.unionByName(many).join(single, ["a", "u"], "left_semi"))
    found = saved(found, "repeat-found")
    every = _anchor_rows(source, length, once=False).select("a", "u", "doc", "th", "start")
    small = is_small(found, BROADCAST_BYTES)
    hits = every.join(F.broadcast(found) if small else found, ["a", "u"])
    hits = hits.select("doc", "th", F.expr("transform(spans, x -> struct(x.s + start as s, x.e + start as e))").alias("spans"))
    return hits.groupBy("doc", "th").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def remove(df: DataFrame, text: str = "text", key: str = "doc_id", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """key, n_bytes, n_removed, n_spans and kept (binary), or kept_sha256 with ``digest``, for every row."""
    found = saved(spans(df, text, key, length), "repeat-spans")
    found = F.broadcast(found) if is_small(found, BROADCAST_BYTES) else found
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(key).cast("bigint"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(text_bytes(text)).alias("th"), text_bytes(text).alias("bytes"))
    joined = rows.join(found, ["doc", "th"], "left").select("id", "bytes", "spans")

    def run(batches):
        for batch in pieces(batches, "bytes"):
            out = [[], [], [], []]
            for b, ranges in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                parts, last, gone, count = [], 0, 0, 0
                if ranges.is_valid and len(ranges.values):
                    s, e = (ranges.values.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (0, 1))
                    for _, start, end in merged(np.zeros(len(s), np.int64), s, e):
                        parts.append(b[last:start])
                        last, gone, count = end, gone + end - start, count + 1
                kept = b"".join([*parts, b[last:]])
                for column, value in zip(out, (len(b), gone, count, hashlib.sha256(kept).hexdigest() if digest else kept), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:3]), pa.array(out[3], pa.string() if digest else pa.binary())], names=names)

    names = [key, "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
    return joined.mapInArrow(run, f"`{key}` bigint, n_bytes bigint, n_removed bigint, n_spans bigint, " + ("kept_sha256 string" if digest else "kept binary"))
