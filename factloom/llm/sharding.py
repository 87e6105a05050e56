"""Balanced label propagation: documents move towards their neighbours' shards under capacity quotas.

Documents with equal texts are linked. Since copies are interchangeable, the graph is kept as pieces: the
copies of one text that stand in one shard, with their number. In each round every piece looks at its
group's pieces and prefers the shards that hold most of them (as many shards as the group needs under the
capacity); what wants to enter a shard beyond its room is turned away by a hash threshold and tries again.
Rounds go on while they bring more linked copies together, which is a whole number that cannot grow for ever.
A last pass numbers the rows of each shard, linked ones first, and hands what exceeds a shard's exact quota
to shards below theirs, so single documents give way before groups are cut. The law is ``rows``: counts of
any two shards differ by one at most.

Numbering needs no global sort: rows are dealt to hash buckets, buckets are counted, and a row's slot is its
bucket's offset plus its place inside. Only tables of one row for each shard reach the driver.

Defined results: null texts have size 16, CRC 0 and no link; empty texts are equal texts; repeated rows are
linked copies; null ids are spread by their texts; an empty table gives an empty result; ids can have any type;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved, text_bytes, tidy

OVERHEAD = 16


def _hash01(*columns) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 40)) / float(1 << 40)


def propagate(pieces: DataFrame, capacity: int, shards: int) -> DataFrame:
    """``pieces``: g (group), home, n; returns them with shard, the shard that their copies move to."""
    state, turn, together = saved(pieces.withColumn("shard", F.col("home")), "shard-pieces"), 0, -1
    while True:
        held = saved(state.groupBy("g", "shard").agg(F.sum("n").alias("m")), "shard-held")
        sums = held.groupBy("shard").agg(F.sum("m").alias("n"), F.sum(F.col("m").cast("decimal(38,0)") * F.col("m")).alias("pairs")).collect()  # a row for each shard
        full, now = {r["shard"]: r["n"] for r in sums}, sum(int(r["pairs"]) for r in sums)
        if now <= together:
            return best.select("g", "home", "shard")
        best, together = state, now
        room = F.array(*[F.lit(max(0, capacity - full.get(s, 0))) for s in range(shards)])
        # what a group has in a shard, most first; shards with room come before equal ones
        order = F.array_sort(F.collect_list(F.struct((-F.col("m")).alias("a"), (-F.element_at(room, F.col("shard") + 1)).alias("b"), F.xxhash64("g", "shard").alias("c"), F.col("shard").alias("s"))))
        liked = held.groupBy("g").agg(order.alias("o"), F.sum("m").alias("size")).select("g", F.expr(f"slice(transform(o, x -> x.s), 1, cast(ceil(size / {max(1, capacity)}D) as int))").alias("top"))
        next_ = F.element_at("top", (F.pmod(F.xxhash64("g", "home", F.lit(turn)), F.size("top")) + 1).cast("int"))
        wish = state.join(liked, "g").withColumn("to", F.when(F.array_contains("top", F.col("shard")), F.col("shard")).otherwise(next_))
        wish = saved(wish.select("g", "home", "n", "shard", "to"), "shard-wishes")
        moving = wish.where("to <> shard")
        inflow = {r["to"]: r["n"] for r in moving.groupBy("to").agg(F.sum("n").alias("n")).collect()}
        outflow = {r["shard"]: r["n"] for r in moving.groupBy("shard").agg(F.sum("n").alias("n")).collect()}
        if not inflow:
            return state.select("g", "home", "shard")
        rate = [min(1.0, max(0, capacity - full.get(s, 0) + outflow.get(s, 0)) / inflow[s]) if s in inflow else 0.0 for s in range(shards)]
        admitted = _hash01(F.col("g"), F.col("home"), F.lit(turn), F.lit("admit")) < F.element_at(F.array(*map(F.lit, rate)), F.col("to") + 1)
        moved = F.when(admitted | (F.col("to") == F.col("shard")), F.col("to")).otherwise(F.col("shard"))
        state = saved(wish.select("g", "home", "n", moved.alias("shard")), "shard-pieces")
        turn += 1


@tidy
def assign(df: DataFrame, shards: int = 40, text: str = "text", key: str = "doc_id", rows_per_bucket: int = 50_000) -> DataFrame:
    """key, size, text_crc32, law, shard, slot, grown_shard, linked (copies of the text, itself included), cut (edges of the row:
    copies in other shards)."""
    raw = text_bytes(text)
    base = df.select(
        F.col(key).alias(key), (F.coalesce(F.octet_length(text), F.lit(0)) + OVERHEAD).cast("bigint").alias("size"), F.crc32(raw).alias("text_crc32"),
        F.when(F.col(text).isNotNull(), F.struct(F.xxhash64(raw).alias("a"), F.crc32(raw).alias("b"), F.octet_length(text).alias("c"))).alias("g"),
        F.pmod(F.xxhash64(F.coalesce(F.col(key).cast("string"), F.col(text)), F.lit("home")), F.lit(shards)).cast("int").alias("home"),
    )
    base = saved(base, "shard-rows")
    total = base.count()
    capacity = total // shards + 1
    sizes = base.where("g is not null").groupBy("g", "home").agg(F.count("*").alias("n"))
    linked = sizes.groupBy("g").agg(F.sum("n").alias("linked")).where("linked > 1")
    moved = propagate(sizes.join(linked.select("g"), "g", "left_semi"), capacity, shards)
    placed = base.join(moved.join(linked, "g"), ["g", "home"], "left").select(key, "size", "text_crc32", F.coalesce("shard", "home").alias("want"), F.coalesce("linked", F.lit(1)).alias("linked"), F.when(F.col("linked").isNotNull(), F.xxhash64("g")).alias("gh"))
    # buckets: linked rows first, the rows of a group near each other
    fine = max(1, total // (shards * 8 * rows_per_bucket))
    bucket = F.struct(F.when(F.col("gh").isNotNull(), 0).otherwise(1).alias("x"), F.pmod(F.coalesce("gh", F.xxhash64(F.col(key), F.col("text_crc32"))), F.lit(8)).cast("int").alias("y"), F.pmod(F.xxhash64(F.col(key), F.col("text_crc32"), F.lit("fine")), F.lit(fine)).cast("int").alias("z"))
    placed = saved(placed.withColumn("bucket", bucket), "shard-placed")
    counts = placed.groupBy("want", "bucket").agg(F.count("*").alias("n"))
    before = counts.select("want", "bucket", (F.sum("n").over(Window.partitionBy("want").orderBy("bucket")) - F.col("n")).alias("before"))  # buckets, not rows
    inside = Window.partitionBy("want", "bucket").orderBy("gh", key, "text_crc32", "size")
    numbered = placed.withColumn("at", F.row_number().over(inside) - 1).join(before, ["want", "bucket"]).withColumn("slot", F.col("before") + F.col("at"))
    have = {r["want"]: r["n"] for r in counts.groupBy("want").agg(F.sum("n").alias("n")).collect()}  # a row for each shard
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    over, free = [], []  # rows beyond the quota in the shards before; places free in the shards before
    more = spare = 0
    for s in range(shards):
        over.append(more)
        free.append(spare)
        more += max(0, have.get(s, 0) - quota[s])
        spare += max(0, quota[s] - have.get(s, 0))
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("bigint") for x in xs])
    pick = lambda xs, s: F.element_at(longs(xs), s + F.lit(1))
    extra = F.col("slot") >= pick(quota, F.col("want"))
    number = pick(over, F.col("want")) + F.col("slot") - pick(quota, F.col("want"))
    numbered = numbered.withColumn("_extra", extra).withColumn("_number", F.when(F.col("_extra"), number))
    # the last shard whose free places begin at or before the number and that has any
    ends = [free[s] + max(0, quota[s] - have.get(s, 0)) for s in range(shards)]
    numbered = numbered.withColumn("_to", F.when(F.col("_extra"), F.size(F.filter(longs(ends), lambda e: e <= F.col("_number")))))
    shard = F.when(F.col("_extra"), F.col("_to")).otherwise(F.col("want"))
    slot = F.when(F.col("_extra"), pick([have.get(s, 0) for s in range(shards)], F.col("_to")) + F.col("_number") - pick(free, F.col("_to"))).otherwise(F.col("slot"))
    out = saved(numbered.select(key, "size", "text_crc32", shard.cast("int").alias("shard"), slot.cast("bigint").alias("slot"), "linked", "gh"), "shard-slots")
    here = out.where("gh is not null").groupBy("gh", "shard").agg(F.count("*").alias("here"))
    spread = F.coalesce("gh", F.xxhash64(F.col("shard"), F.col("slot")))  # rows without a link do not meet in one task
    out = out.withColumn("_g", spread).join(here.withColumnRenamed("gh", "_g"), ["_g", "shard"], "left")
    cut = F.when(F.col("gh").isNull(), 0).otherwise(F.col("linked") - F.col("here")).cast("bigint")
    return out.select(key, "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked", cut.alias("cut"))
