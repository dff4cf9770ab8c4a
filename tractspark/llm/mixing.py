"""Mixing sources to target weights, in DataFrame expressions only.

Targets: sources in code-point order (null last) weigh 1, 2, 3, repeating, and share all words; a target stops at CAP times its source's
size and the excess is shared again by weight until none is above (computed at once: sources sorted by capped size per unit of weight,
the first ones capped, the others at one level). Sizes are counted in words.

Method: Sainte-Lague apportionment. All words are cut into blocks of `block` words; the blocks go to the sources by the highest quotients
target / (2 k + 1), giving integer quotas; a source's quota is apportioned alike to its shards (documents with a common prefix of the MD5
of seed, doc_id and text, so shards stay small however large a source is and however often an id repeats). In a shard, documents lie in the order of that hash; as many whole
passes as the quota has go to every block, and the rest of the quota to the first blocks of the seeded order. A document takes the words
of its blocks, so never more than CAP times its size, and reruns agree.

Defined cases: a null text has size 0; a null source is a source of its own; repeated rows are documents of their own; a table without
words has targets and takings 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, materialise, own_columns

WEIGHTS = (1, 2, 3)
CAP = 3
BLOCK = 16
#: Documents a shard holds on average, at most.
SHARD = 4096
SEED = "mix-1"


def words(text: Column) -> Column:
    """Number of runs of characters other than x20 and x09-x0D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sources: source, source_size (one row each). Adds weight and target. Its windows run over one row for each source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1).cast("double")
    rows = sources.withColumn("weight", weight).withColumn("_ratio", cap * F.col("source_size") / F.col("weight"))
    upto = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    rest = Window.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(0, Window.unboundedFollowing)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumn("_level", (F.sum("source_size").over(every) - F.coalesce(F.sum(cap * F.col("source_size")).over(upto), F.lit(0))) / F.sum("weight").over(rest))
    rows = rows.withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_ratio"), F.col("_level"))).over(every))
    top = (cap * F.col("source_size")).cast("double")
    return rows.withColumn("target", F.least(top, F.coalesce(F.col("_level") * F.col("weight"), top))).drop("_level", "_ratio")


def apportion(parties: DataFrame, group: list[str], claim: str, seats: str, most: str, key: list[str], quota: str) -> DataFrame:
    """Sainte-Lague in each group: `seats` (equal within a group) go to parties by the highest quotients claim / (2 k + 1), no party beyond
    `most`; ties go to the smaller key, nulls last. Starts from claims rounded at the mean divisor, which is off by a few seats, and moves
    those by quotient."""
    w = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(1))
    rows = parties.withColumn("_sum", F.sum(claim).over(w)).withColumn("_place", F.row_number().over(w.orderBy(*(F.col(k).asc_nulls_last() for k in key))))
    rows = rows.withColumn("_start", F.least(F.col(most), F.when(F.col("_sum") > 0, F.floor(F.col(claim) * F.col(seats) / F.col("_sum") + F.lit(0.5))).otherwise(0)).cast("long"))
    rows = rows.withColumn("_short", (F.col(seats) - F.sum("_start").over(w)).cast("long"))
    steps = F.abs("_short")
    # A party's share of the move follows its claim; one more on either side covers the rounding.
    reach = F.when(F.col("_sum") > 0, F.least(steps, F.ceil(2 * steps * F.col(claim) / F.col("_sum")) + 2)).otherwise(0).cast("long")
    more = F.when(F.col("_short") > 0, F.least(reach, F.col(most) - F.col("_start"))).otherwise(F.least(reach, F.col("_start")))
    moves = rows.filter("_short <> 0").withColumn("_k", F.explode(F.when(more > 0, F.sequence(F.lit(1).cast("long"), more))))
    seat = F.when(F.col("_short") > 0, F.col("_start") + F.col("_k") - 1).otherwise(F.col("_start") - F.col("_k"))
    moves = moves.withColumn("_quotient", F.col(claim) / (2 * seat + 1))
    way = -F.signum("_short")  # the best quotients gain a seat, the worst lose one
    rank = F.row_number().over(w.orderBy(way * F.col("_quotient"), -way * F.col("_place"), "_k"))
    moved = moves.withColumn("_rank", rank).filter(F.col("_rank") <= F.abs("_short")).groupBy(*[F.col(k).alias(f"_key_{k}") for k in key]).agg(F.sum(F.signum("_short")).cast("long").alias("_moved"))
    rows = rows.join(moved, [F.col(k).eqNullSafe(F.col(f"_key_{k}")) for k in key], "left")
    return rows.withColumn(quota, F.col("_start") + F.coalesce("_moved", F.lit(0))).drop("_sum", "_place", "_start", "_short", "_moved", *(f"_key_{k}" for k in key))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, block: int = BLOCK, seed: str = SEED) -> DataFrame:
    """doc_id, text_key (a hash of the text), size, source_size, target, taken for every row of docs."""
    rank = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("text_key"), words(F.col("text")).alias("size"), rank.alias("rank"))
    rows = materialise(rows, "sizes")
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("documents")), weights, cap)
    sources = sources.withColumn("seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(1))) / block).cast("long")).withColumn("most", F.ceil(cap * F.col("source_size") / block).cast("long"))
    sources = apportion(sources, [], "target", "seats", "most", ["source"], "quota")
    sources = sources.withColumn("digits", F.greatest(F.lit(0), F.ceil(F.log(16.0, F.col("documents") / SHARD))).cast("int"))
    sources = materialise(sources.select(F.col("source").alias("_source"), "source_size", "target", "quota", "digits"), "targets")
    same = F.col("source").eqNullSafe(F.col("_source"))
    rows = rows.join(sources, same, "left").withColumn("shard", F.expr("substring(rank, 1, digits)"))
    shards = rows.groupBy("source", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = shards.withColumn("most", F.ceil(cap * F.col("shard_size") / block).cast("long"))
    shards = apportion(shards, ["source"], "shard_size", "quota", "most", ["source", "shard"], "shard_quota")
    shards = shards.select(F.col("source").alias("_of"), F.col("shard").alias("_shard"), "shard_size", F.least(F.col("shard_quota") * block, cap * F.col("shard_size")).alias("budget"))
    order = Window.partitionBy("source", "shard").orderBy("rank", "doc_id", "size", "text_key")
    rows = rows.withColumn("stop", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.join(shards, F.col("source").eqNullSafe(F.col("_of")) & (F.col("shard") == F.col("_shard")))
    passes = F.when(F.col("shard_size") > 0, F.floor(F.col("budget") / F.col("shard_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - passes * F.col("shard_size")
    first = F.least(F.col("size"), F.greatest(F.lit(0), rest - (F.col("stop") - F.col("size"))))
    return rows.select("doc_id", "source", "text_key", "size", "source_size", "target", (passes * F.col("size") + first).cast("long").alias("taken"))


def resample(docs: DataFrame, **how) -> DataFrame:
    """docs as the mix takes them: a document whose words are taken k times and in part once more stays k + 1 times, one of which nothing
    is taken goes (rows equal in doc_id, source and text stay as often as the one taken most). Only the last document of a shard's selection
    is taken in part, so sources stay near their targets. Null or empty texts have no words and go; null sources are one source; an empty
    table gives no rows; columns of any name are carried."""
    keys = {k: free_name(docs.columns, f"mix_{k}") for k in ("doc_id", "source", "text_key")}
    times = free_name(docs.columns, "mix_times")
    taken = mix(docs, **how).filter("taken > 0").groupBy("doc_id", "source", "text_key").agg(F.max(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times))
    taken = taken.select(*(F.col(k).alias(v) for k, v in keys.items()), times)
    rows = docs.join(taken, F.col("doc_id").eqNullSafe(F.col(keys["doc_id"])) & F.col("source").eqNullSafe(F.col(keys["source"])) & F.xxhash64("text").eqNullSafe(F.col(keys["text_key"])))
    return rows.select(*own_columns(docs), F.explode(F.array_repeat(F.lit(0), F.col(times))).alias(times)).select(*own_columns(docs))
