"""Secret scan with corpus-wide ownership frequency, in DataFrame functions only.

Base spans come from three patterns. Positions come from the text between the matches: ``split`` gives it,
``regexp_extract_all`` the matches, and running lengths, in blocks of the root of their number, the offsets in
code points. The value of every candidate is hashed and counted over the corpus by distinct owner and
repository (a document is one, unless a column names it). A value that many owners hold, or several owners in
many repositories, is a copied example; all others are owner-specific and live-looking, whatever pattern found
them and however often their owner repeats them. A value is strong if it stands in a credential's place (an
assignment, an access key) somewhere. The method adds ``reuse`` spans: a run of token characters that stands
bare in one text, and whose value is strong. Values are equal if they differ by punctuation at their ends only.
Live spans of strong values are masked, hexadecimal ones too.

Defined results: null text counts as empty and has no span; an empty table gives an empty result; repeated
rows give repeated results and count once for ownership; a null owner counts as one owner, null ids as one
repository; ids can have any type; a text can hold any number of matches; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import is_small, saved, tidy

# The base patterns; lower-case letters of the key words stand for either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HINT = r"(?i:pass(?:word|wd)|secret|token|api_?key)"
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
#: A bare token: a whole run of token characters, not of punctuation alone.
BARE = r"(?<![A-Za-z0-9+/_.=-])(?=[+/_.=-]*+[A-Za-z0-9])[A-Za-z0-9+/_.=-]{12,}+"
#: What may stand at a value's ends without being part of it.
ENDS = "+/_.=-"
KINDS = ("assign", "access", "hex", "reuse")
#: Values of at least so many owners are examples; those of two, from so many repositories on.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 10
#: Spans up to so many bytes are broadcast; more are joined by shuffle.
BROADCAST_BYTES = 4 << 20

_SPAN = "array<struct<s:int,k:int,e:int,v:bigint>>"
_NONE = f"cast(array() as {_SPAN})"


def _spans(text: str, pattern: str, kind: int, value: int = 0, least: int = 0) -> str:
    """SQL for the spans of a pattern: start, kind, end, hash of the value group; values under ``least`` characters go."""
    p = "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"
    matches, values = f"regexp_extract_all({text}, {p}, 0)", f"regexp_extract_all({text}, {p}, {value})"
    rows = f"arrays_zip(split({text}, {p}, -1), {matches}{f', {values}' if value else ''})"
    between, match, v = "x.`0`", "x.`1`", "x.`2`" if value else "x.`1`"
    # the last row has the text after the last match, and no match
    block = f"""aggregate(slice(r, i * n + 1, n), struct(0 as at, {_NONE} as out),
        (a, x) -> struct(cast(a.at + char_length({between}) + coalesce(char_length({match}), 0) as int) as at,
            if({match} is null or char_length({v}) < {least}, a.out, concat(a.out, array(struct(cast(a.at + char_length({between}) as int) as s, {kind} as k,
                cast(a.at + char_length({between}) + char_length({match}) as int) as e, xxhash64(trim(BOTH '{ENDS}' FROM {v})) as v)))) as out))"""
    starts = "aggregate(bs, struct(0 as at, cast(array() as array<int>) as o), (a, y) -> struct(a.at + y.at as at, concat(a.o, array(a.at)) as o), a -> a.o)"
    moved = "transform(y.out, z -> struct(z.s + o as s, z.k as k, z.e + o as e, z.v as v))"
    joined = f"flatten(zip_with(bs, {starts}, (y, o) -> {moved}))"
    blocks = f"transform(sequence(0, cast(ceil(size(r) / n) as int) - 1), i -> {block})"
    return _let(rows, "r", _let("cast(ceil(sqrt(size(r))) as int)", "n", _let(blocks, "bs", joined)))


def _let(value: str, name: str, then: str) -> str:
    """SQL for ``then``, in which ``name`` stands for ``value``."""
    return f"element_at(transform(array({value}), {name} -> {then}), 1)"


def _guarded(hint: str, spans: str, text: str = "t") -> Column:
    p = "'" + hint.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return F.expr(f"if({text} rlike {p}, {spans}, {_NONE})")


def scan(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str | None = None) -> DataFrame:
    """key, th (hash of the text), owner, repository, base and bare spans; each pattern reads a text once if it has no match."""
    t = df.select(F.col(key).alias(key), F.col(owner).alias("owner"), F.col(repository or key).cast("string").alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    bare = _guarded("[A-Za-z0-9+/_.=-]{12}", _spans("t", BARE, 3))
    return t.select(
        key, "owner", "repository", F.xxhash64("t").alias("th"),
        F.concat(_guarded(ASSIGN_HINT, _spans("t", ASSIGN, 0, value=2, least=12)), _guarded("AKIA", _spans("t", ACCESS, 1)), _guarded(HEX, _spans("t", HEX, 2))).alias("base"),
        bare.alias("bare"),
    )


def _small(df: DataFrame, label: str) -> DataFrame:
    """A saved table, for a broadcast if it is small."""
    df = saved(df, label)
    return F.broadcast(df) if is_small(df, BROADCAST_BYTES) else df


def reuses(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, th, owner, repository, x: the bare spans of strong values, saved."""
    known = _small(scanned.select(F.explode("base").alias("x")).where("x.k < 2").select("x.v").distinct(), "secret-values")
    bare = scanned.select(key, "th", "owner", "repository", F.explode("bare").alias("x")).withColumn("v", F.col("x.v"))
    return saved(bare.join(known, "v", "left_semi").drop("v"), "secret-reuses")


def uncovered(scanned: DataFrame, bare: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, th, x: the distinct bare spans that no base span holds, nor one of the same value touches. Running ends tell, so
    that a text's spans are read in order, not against one another."""
    mine = bare.select(key, "th", "x").distinct()
    texts = _small(mine.select(F.col(key).alias("_k"), F.col("th").alias("_t")).distinct(), "secret-texts")
    base = scanned.where(F.size("base") > 0).join(texts, F.col(key).eqNullSafe(F.col("_k")) & (F.col("th") == F.col("_t")), "left_semi")
    both = mine.withColumn("b", F.lit(0)).unionByName(base.select(key, "th", F.explode("base").alias("x")).distinct().withColumn("b", F.lit(1)))
    start, end = F.when(F.col("b") == 1, F.col("x.s")), F.when(F.col("b") == 1, F.col("x.e"))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    text, value = Window.partitionBy(key, "th"), Window.partitionBy(key, "th", "x.v")
    onward, back = [F.col("x.s"), F.col("b").desc()], [F.col("x.s").desc(), F.col("b").desc()]
    held = F.max(end).over(so_far(text.orderBy(*onward))) >= F.col("x.e")
    before = F.max(end).over(so_far(value.orderBy(*onward))) > F.col("x.s")
    after = F.min(start).over(so_far(value.orderBy(*back))) < F.col("x.e")
    covered = F.coalesce(held, F.lit(False)) | F.coalesce(before, F.lit(False)) | F.coalesce(after, F.lit(False))
    return both.withColumn("covered", covered).where("b = 0 and not covered").select(key, "th", "x")


def ownership(scanned: DataFrame, bare: DataFrame) -> DataFrame:
    """v, owners, repositories, strong (seen in a credential's place), live for every value; distinct pairs are counted first."""
    base = scanned.select("owner", "repository", F.explode("base").alias("x"))
    every = base.unionByName(bare.select("owner", "repository", "x")).select("owner", "repository", "x.v", (F.col("x.k") < 2).alias("strong"))
    pairs = every.groupBy("v", "owner", "repository").agg(F.bool_or("strong").alias("strong"))
    count = lambda c: F.countDistinct(F.struct(F.col(c).isNull(), F.coalesce(c, F.lit("")))).alias("owners" if c == "owner" else "repositories")
    values = pairs.groupBy("v").agg(count("owner"), count("repository"), F.bool_or("strong").alias("strong"))
    example = (F.col("owners") >= EXAMPLE_OWNERS) | (F.col("owners") > 1) & (F.col("repositories") >= EXAMPLE_REPOSITORIES)
    return values.withColumn("live", ~example)


def find(df: DataFrame, text: str = "text", key: str = "doc_id", owner: str = "source", repository: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The scanned rows, and key, th, s, k, e, v, owners, repositories, live, strong of every distinct span."""
    scanned = saved(scan(df, text, key, owner, repository), "secret-scan")
    bare = reuses(scanned, key)
    values = _small(ownership(scanned, bare), "secret-owners")
    spans = scanned.select(key, "th", F.explode("base").alias("x")).unionByName(uncovered(scanned, bare, key))
    return scanned, spans.select(key, "th", "x.*").distinct().join(values, "v")


@tidy
def report(df: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_reuse, n_live, n_example, most_owners, most_repositories."""
    scanned, spans = find(df)
    row = F.struct("s", "k", "e", "live", "owners", "repositories")
    by_doc = spans.groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(row)).alias("spans"))
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.th") == F.col("r.th"))
    none = F.expr("cast(array() as array<struct<s:int,k:int,e:int,live:boolean,owners:bigint,repositories:bigint>>)")
    found = scanned.select("doc_id", "th").alias("l").join(by_doc.alias("r"), same, "left").select("l.doc_id", F.coalesce("r.spans", none).alias("spans"))
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    joined = lambda spans: F.expr(f"array_join(transform({spans}, x -> concat_ws(':', {names}[x.k], x.s, x.e)), ',')")
    count = lambda test: F.expr(f"cast(size(filter(spans, x -> {test})) as bigint)")
    most = lambda c: F.coalesce(F.expr(f"array_max(transform(spans, x -> x.{c}))"), F.lit(0)).alias(f"most_{c}")
    return found.select(
        "doc_id", count("x.k = 0").alias("n_assign"), count("x.k = 1").alias("n_access"), count("x.k = 2").alias("n_hex"),
        F.sha2(joined("filter(spans, y -> y.k < 3)").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans"),
        count("x.k = 3").alias("n_reuse"), count("x.live").alias("n_live"), count("not x.live").alias("n_example"), most("owners"), most("repositories"),
    )


@tidy
def _masks(df: DataFrame, text: str) -> DataFrame:
    """_id, _th, _m: the places to mask in a text, disjoint and in order."""
    _, spans = find(df, text)
    live = spans.where("live and strong").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "s", "e").distinct()
    order = Window.partitionBy("_id", "_th").orderBy("s", "e")
    fresh = F.coalesce(F.max("e").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("s"), F.lit(True))
    joined = live.withColumn("fresh", fresh.cast("int")).withColumn("at", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    whole = joined.groupBy("_id", "_th", "at").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return whole.groupBy("_id", "_th").agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("_m"))


def _masked(text: str, mark: str) -> Column:
    """``text`` with the places of ``_m`` replaced, in blocks of the root of their number: a place in a text is found by walking there."""
    piece = f"concat(substring(part, if(j = 0, 0, q[j - 1].e - at) + 1, x.s - if(j = 0, at, q[j - 1].e)), '{mark}')"
    inside = f"array_join(transform(q, (x, j) -> {piece}), '')"
    segment = _let(f"substring({text}, at + 1, q[size(q) - 1].e - at)", "part", inside)
    block = _let("slice(_m, i * n + 1, n)", "q", _let("if(i = 0, 0, _m[i * n - 1].e)", "at", segment))
    blocks = f"transform(sequence(0, cast(ceil(size(_m) / n) as int) - 1), i -> {block})"
    return F.expr(_let("cast(ceil(sqrt(size(_m))) as int)", "n", f"concat(array_join({blocks}, ''), substring({text}, _m[size(_m) - 1].e + 1))"))


def redact(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``df`` with live-looking values that stand in a credential's place somewhere replaced, wherever they stand, by ``mark``; n_chars follows if there."""
    # few documents hold any: their places go to the texts, not the texts to them
    places = _masks(df, text)
    places = F.broadcast(places) if is_small(places, BROADCAST_BYTES) else places
    rows = df.withColumn("_th", F.xxhash64(F.coalesce(F.col(text), F.lit("")))).alias("d")
    joined = rows.join(places.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f._id")) & (F.col("d._th") == F.col("f._th")), "left")
    joined = joined.select("d.*", "f._m").withColumn("_new", F.when(F.col("_m").isNotNull(), _masked(f"`{text}`", mark)).otherwise(F.col(text)))
    out = []
    for c in df.columns:
        if c == text:
            out.append(F.col("_new").alias(text))
        elif c == "n_chars":
            out.append(F.when(F.col("_m").isNotNull(), F.char_length("_new").cast(df.schema[c].dataType)).otherwise(F.col(c)).alias(c))
        else:
            out.append(F.col(f"`{c}`"))
    return joined.select(*out)
