"""Benchmark decontamination by template canonicalisation, in DataFrame functions only.

A text becomes words and numbers; numbers, with the unit that may follow, and names (capitalised words inside
a sentence) become typed placeholders. Windows of eight tokens are hashed in three doublings (pairs, fours,
eights) in two forms, with and without name placeholders, and hash-joined to the benchmark's windows. A pair
of document and item with enough of the item's windows is aligned at every shift that has any, and the slots in
the windows found there are compared: numbers, units and names of the item must map one to one to those of the
document, each kind by itself. Alignments where they do not are let go; the others must hold enough of the item's
windows, each counted once. Equal numbers, units and names are a copy, others a re-parameterised question.

Items of four to seven tokens are matched by windows of four. A window counts with at least four (of four:
three) tokens that are no placeholder. Items without any such window (short ones, arithmetic, lists of
quantities) are matched as they stand: literal words, numbers, units and operators, the whole item if it has
fewer than eight tokens, else windows of eight. So a very short item takes every document that holds its words.

A document is an id and its text, and an item likewise, so ids can be null, repeated, or stand on several texts:
each text is judged by itself, and a pair of ids is reported if any of their texts match.

Defined results: null and empty texts match nothing; an empty table on either side gives an empty result;
repeated rows of either table give one row for each distinct pair; ids can have any type; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, saved, tidy

# Units that count as one after a number.
UNITS = ("mm", "cm", "m", "km", "g", "kg", "mg", "t", "l", "ml", "s", "ms", "min", "h", "hours", "minutes", "seconds", "days", "years", "meters", "miles", "percent", "usd", "eur", "dollars", "euros", "c", "f", "k", "w", "kw", "v", "a", "hz", "gb", "mb")
AMOUNT = r"(\p{N}) ?(" + "|".join(sorted(UNITS, key=len, reverse=True)) + r")(?![\p{L}\p{N}])"
NAMES = r"(?<=[\p{L}\p{N},;:] )\p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)*"
NAME, NUMBER, UNIT, END = "\ue000", "\ue001", "\ue002", "\ue003"
_SLOTS = "array<struct<kind:string,a:string,b:string>>"
TOKENS = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+|" + NAME
#: Tokens of an item that is matched as it stands: numbers, words, operators.
LITERAL_TOKENS = r"\p{N}+(?:[.,]\p{N}+)*|\p{L}+|[+*/=<>^%×÷−-]"
LITERAL = 2  # beside the forms 0 and 1
#: The share of an item's windows that a document must hold.
COVERAGE = 0.5
#: Benchmark windows up to so many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 16 << 20


def tokens(text: Column, names: bool) -> Column:
    """Lower-case words and numbers, a unit being part of its number; with ``names``, a placeholder for each run of names."""
    if names:
        text = F.regexp_replace(text, NAMES, NAME)
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), AMOUNT, "$1 " + UNIT + " "), F.lit(TOKENS), F.lit(0))


def valued(text: Column, names: bool) -> Column:
    """The same tokens, with the unit behind its number and each run of names behind its placeholder."""
    text = F.translate(text, UNIT + END, "\ue004\ue004")
    if names:
        text = F.regexp_replace(F.replace(text, F.lit(NAME), F.lit(NAME + END)), NAMES, NAME + "$0" + END)
    text = F.regexp_replace(F.lower(text), AMOUNT, "$1 " + UNIT + "$2" + END + " ")
    number = rf"\p{{N}}+(?:[.,]\p{{N}}+)*(?: {UNIT}[^{END}]*{END})?"
    return F.regexp_extract_all(text, F.lit(rf"{number}|{NAME}[^{END}]*{END}|\p{{L}}+" if names else rf"{number}|\p{{L}}+|{NAME}"), F.lit(0))


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), then), 1)


def canonical(ts: Column) -> Column:
    """Tokens with a placeholder for each number."""
    return F.transform(ts, lambda t: F.when(t < F.lit(":"), F.lit(NUMBER)).otherwise(t))


def _doubled(step: int):
    # one parameter only: a second one of the lambda would be the place in the array
    return lambda x: F.zip_with(x, F.slice(x, F.lit(step + 1), F.size(x) + 1), lambda a, b: F.xxhash64(a, b))


def _marked(ws: Column, form: int, size: int) -> Column:
    """Window hashes as rows: form, wsize, at, w."""
    return F.transform(ws, lambda w, i: F.struct(F.lit(form).alias("form"), F.lit(size).alias("wsize"), i.alias("at"), w.alias("w")))


def windows(ts: Column, form: int, sizes: list[int]) -> Column:
    """Rows (form, wsize, at, w) of all windows of the ``sizes`` (powers of two) of canonical tokens, in order; the tokens are read once."""

    def grown(w: Column, size: int) -> Column:
        whole = lambda x: F.slice(x, F.lit(1), F.greatest(F.lit(0), F.size(x) - (size - 1)))
        here = _marked(whole(w), form, size) if size in sizes else None
        if size >= max(sizes):
            return here
        longer = _let(_doubled(size)(w), lambda x: grown(x, 2 * size))
        return longer if here is None else F.concat(here, longer)

    return _let(F.transform(ts, lambda t: F.xxhash64(F.when(t < F.lit(":"), F.lit(NUMBER)).otherwise(t))), lambda w: grown(w, 1))


def literal(text: Column) -> Column:
    """Lower-case words, numbers and operators, without placeholders."""
    return F.regexp_extract_all(F.lower(text), F.lit(LITERAL_TOKENS), F.lit(0))


def literal_windows(ts: Column, sizes: list[int]) -> Column:
    """The same of literal tokens, for sizes of any kind."""
    starts = lambda x, size: F.when(F.size(x) >= size, F.sequence(F.lit(1), F.size(x) - (size - 1)))
    hashes = lambda x, size: F.transform(F.coalesce(starts(x, size), F.array().cast("array<int>")), lambda i: F.xxhash64(F.slice(x, i, F.lit(size))))
    return _let(ts, lambda x: F.concat(*[_marked(hashes(x, size), LITERAL, size) for size in sizes]))


def every_window(text: Column, sizes: dict[int, list[int]]) -> Column:
    """Rows (form, wsize, at, w) of a text's windows, for the sizes of each form."""
    found = [literal_windows(literal(text), z) if form == LITERAL else windows(tokens(text, bool(form)), form, z) for form, z in sorted(sizes.items())]
    return F.concat(*found)


def _items(texts: DataFrame) -> DataFrame:
    """iid, ith, form, wsize, pos, w: the windows of every text of an item in both forms, literal ones of texts without any."""
    out = None
    for form in (0, 1):
        ts = canonical(tokens(F.col("text"), bool(form)))
        rows = saved(texts.select("iid", "ith", ts.alias("t"), every_window(F.col("text"), {form: [4, 8]}).alias("x")), "benchmark-items")
        if form:
            rows = rows.where(F.exists("t", lambda x: x == NAME))
        w = rows.select("iid", "ith", "t", F.explode("x").alias("x")).select("iid", "ith", "t", "x.form", "x.wsize", F.col("x.at").alias("pos"), "x.w")
        w = w.where("if(size(t) >= 8, 8, 4) = wsize")
        plain = f"size(filter(slice(t, pos + 1, wsize), x -> x not in ('{NAME}', '{NUMBER}', '{UNIT}'))) >= if(wsize = 8, 4, 3)"
        w = w.where(plain).drop("t")
        out = w if out is None else out.unionByName(w)
    out = saved(out, "benchmark-templates")
    rest = texts.join(out.select("ith").distinct(), "ith", "left_anti")
    rest = saved(rest.select("iid", "ith", literal(F.col("text")).alias("t"), "text").where(F.size("t") > 0), "benchmark-literal")
    sizes = [r["n"] for r in rest.select(F.least(F.size("t"), F.lit(8)).alias("n")).distinct().collect()]  # eight rows at most
    if sizes:
        w = rest.select("iid", "ith", "t", F.explode(every_window(F.col("text"), {LITERAL: sorted(sizes)})).alias("x"))
        w = w.where(F.col("x.wsize") == F.least(F.size("t"), F.lit(8)))
        out = out.unionByName(w.select("iid", "ith", "x.form", "x.wsize", F.col("x.at").alias("pos"), "x.w"))
    return out.distinct()


PAIR = ["_id", "th", "iid", "ith", "form", "wsize"]


def _documents(docs: DataFrame, text: str, key: str) -> DataFrame:
    return docs.where(F.col(text).isNotNull()).select(F.col(key).alias("_id"), F.xxhash64(text).alias("th"), F.col(text).alias("_dt"))


def candidates(docs: DataFrame, items: DataFrame) -> DataFrame:
    """PAIR, need, along (shift, places of the item's windows there) of the pairs with enough common windows."""
    need = items.groupBy("ith", "form", "wsize").agg(F.countDistinct("pos").alias("need"))
    sizes: dict[int, list[int]] = {}
    for r in items.select("form", "wsize").distinct().orderBy("form", "wsize").collect():  # twelve rows at most
        sizes.setdefault(r["form"], []).append(r["wsize"])
    if not sizes:
        sizes = {0: [8]}
    small = is_small(items, BROADCAST_BYTES)
    seen = docs.select("_id", "th", F.explode(every_window(F.col("_dt"), sizes)).alias("x")).select("_id", "th", "x.*")
    found = seen.join(F.broadcast(items) if small else items, ["form", "wsize", "w"])
    hits = saved(found.select(*PAIR, "pos", (F.col("at") - F.col("pos")).alias("shift")).distinct(), "benchmark-hits")
    # places of the item, however often the document repeats them
    covered = hits.select(*PAIR, "pos").distinct().groupBy(*PAIR).agg(F.count("*").alias("total"))
    enough = covered.join(F.broadcast(need) if small else need, ["ith", "form", "wsize"]).where(F.col("total") / F.col("need") >= COVERAGE)
    along = hits.groupBy(*PAIR, "shift").agg(F.collect_list("pos").alias("at")).groupBy(*PAIR).agg(F.collect_list(F.struct("shift", "at")).alias("along"))
    same = F.lit(True)
    for c in PAIR:
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}"))
    return along.alias("l").join(enough.alias("r"), same).select("l.*", "r.need")


def _slot(a: Column, b: Column) -> Column:
    """kind (number, unit, name), a, b of what fills a place in the item and in the document, if it is a slot in both."""
    number = lambda v: F.substring_index(v, " " + UNIT, 1)
    unit = lambda v: F.regexp_extract(v, f"{UNIT}([^{END}]*)", 1)
    row = lambda kind, x, y: F.struct(F.lit(kind).alias("kind"), x.alias("a"), y.alias("b"))
    amount = F.filter(F.array(row("number", number(a), number(b)), row("unit", unit(a), unit(b))), lambda z: (z["a"] != "") & (z["b"] != ""))
    return F.when((a < ":") & (b < ":"), amount).when(a.startswith(NAME) & b.startswith(NAME), F.array(row("name", a, b))).otherwise(F.expr(f"cast(array() as {_SLOTS})"))


def _matches(docs: DataFrame, benchmark: DataFrame, text: str, key: str, item: str, item_text: str) -> DataFrame:
    """_id, th, iid, hits, coverage, kind: a row for each pair of texts and form whose slots agree."""
    texts = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item).alias("iid"), F.xxhash64(item_text).alias("ith"), F.col(item_text).alias("text"))
    texts = saved(texts.distinct(), "benchmark-texts")
    rows = _documents(docs, text, key)
    pairs = saved(candidates(rows, saved(_items(texts), "benchmark-windows")), "benchmark-pairs")
    few = F.broadcast(pairs) if is_small(pairs, BROADCAST_BYTES) else pairs
    sides = texts.groupBy("ith").agg(F.first("text").alias("_it"))
    same = F.col("d._id").eqNullSafe(F.col("p._id")) & (F.col("d.th") == F.col("p.th"))
    aligned = rows.alias("d").join(few.alias("p"), same).select("p.*", "d._dt").join(F.broadcast(sides) if is_small(texts, BROADCAST_BYTES) else sides, "ith")
    both = lambda names: F.struct(valued(F.col("_dt"), names).alias("d"), valued(F.col("_it"), names).alias("i"))
    # what fills each slot of both in the windows that they share, for each alignment
    window = lambda s, shift, pos: F.flatten(F.transform(F.sequence(pos, pos + F.col("wsize") - 1), lambda k: _slot(F.get(s["i"], k), F.get(s["d"], k + shift))))
    filled = lambda s: lambda x: F.struct(x["at"].alias("at"), F.array_distinct(F.flatten(F.transform(x["at"], lambda pos: window(s, x["shift"], pos)))).alias("p"))
    slots = lambda names: _let(both(names), lambda s: F.transform("along", filled(s)))
    bare = F.transform("along", lambda x: F.struct(x["at"].alias("at"), F.expr(f"cast(array() as {_SLOTS})").alias("p")))
    along = F.when(F.col("form") == 0, slots(False)).when(F.col("form") == 1, slots(True)).otherwise(bare)
    rows = saved(aligned.select("_id", "th", "iid", "need", along.alias("along")).distinct(), "benchmark-slots")
    side = lambda c: f"size(y.p) = size(array_distinct(transform(y.p, x -> struct(x.kind, x.{c}))))"
    share = lambda along: f"size(array_distinct(flatten(transform({along}, y -> y.at)))) / need"
    one_to_one = F.expr(f"filter(along, y -> {side('a')} and {side('b')})")
    kept = rows.withColumn("along", one_to_one).withColumn("coverage", F.expr(share("along"))).where(F.col("coverage") >= COVERAGE)
    same = share("filter(along, y -> forall(y.p, x -> x.a = x.b))")
    kind = F.when(F.expr(same) >= COVERAGE, "copy").otherwise("reparameterised")
    return kept.select("_id", "th", "iid", F.expr("array_max(transform(along, y -> size(y.at)))").cast("bigint").alias("hits"), "coverage", kind.alias("kind"))


@tidy
def contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """key, item, hits, coverage, kind (copy or reparameterised): a row for each pair whose slots agree."""
    found = _matches(docs, benchmark, text, key, item, item_text)
    return found.groupBy(F.col("_id").alias(key), F.col("iid").alias(item)).agg(F.max("hits").alias("hits"), F.max("coverage").alias("coverage"), F.min("kind").alias("kind"))


@tidy
def _bad(docs: DataFrame, benchmark: DataFrame, text: str, key: str) -> DataFrame:
    return _matches(docs, benchmark, text, key, "item_id", "text").select(F.col("_id").alias("_bad"), F.col("th").alias("_bad_th")).distinct()


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The rows whose text holds no item; of a repeated id those texts stay that hold none."""
    bad = _bad(docs, benchmark, text, key)
    bad = F.broadcast(bad) if is_small(bad, BROADCAST_BYTES) else bad
    return docs.join(bad, F.col(key).eqNullSafe(F.col("_bad")) & (F.xxhash64(F.col(text)) == F.col("_bad_th")), "left_anti")
