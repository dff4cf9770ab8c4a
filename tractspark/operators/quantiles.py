"""Exact quantiles by distributed selection, of all groups and ranks at once.

Values are counted by ranges, and only the ranges that hold a wanted rank are refined. A group's ranges are cut at values that a mergeable sketch
proposes; a value that is a cut has a range of its own, so ties never stand in the way. The counts are exact whatever the sketch says: it decides
how soon a range is small, not which value is found. Ranges of at most SMALL values are sorted as arrays; a group of any size is never in one task:
values of large groups stay where they are, and their groups' cuts come to them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .rounds import cut

#: Values that are sorted as one array, at most; ranges that a larger group is cut into (a power of two) and the accuracy of their cuts.
SMALL, RANGES, ACCURACY = 100_000, 128, 10_000

#: Large groups whose cuts are broadcast, at most (a kB each; there is at most one for SMALL values). Of more, Spark chooses the joins.
FEW = 10_000


def _interpolated(n: Column, p: float, at) -> Column:
    """The value at p of n sorted ones, as SQL's percentile has it; at(k): the k-th from 0."""
    place = (n - 1) * F.lit(float(p))
    low, high = F.floor(place), F.ceil(place)
    return F.when(at(low) == at(high), at(low)).otherwise((high - place) * at(low) + (place - low) * at(high))


def _range_of(v: Column, cuts: Column) -> Column:
    """Twice the number of cuts below v, and one more if v is the next cut; by bisection."""
    steps = F.array(*(F.lit(RANGES >> k) for k in range(1, RANGES.bit_length())))
    below = F.aggregate(steps, F.lit(0), lambda i, s: i + F.when(F.get(cuts, i + s - 1) < v, s).otherwise(0))
    return 2 * below + (F.coalesce(F.get(cuts, below) == v, F.lit(False))).cast("int")


def quantiles(df: DataFrame, col: str, probabilities: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """by and q, the array of col's quantiles (doubles, interpolated); nulls don't count, NaN is the largest value, and groups of nulls
    alone have no row. Runs jobs; the result is small: a row for each group."""
    keys = [f"_by{i}" for i in range(len(by))]
    rows = df.filter(F.col(col).isNotNull()).select(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col(col).cast("double").alias("v"))
    values = cut(rows.withColumn("path", F.lit("")))
    sizes = values.groupBy(*keys).agg(F.count("*").alias("n"))
    named = [F.col(k).alias(b) for b, k in zip(by, keys)]
    if (sizes.agg(F.max("n")).first()[0] or 0) <= SMALL:
        lists = values.groupBy(*keys).agg(F.sort_array(F.collect_list("v")).alias("a"))
        at = lambda k: F.get("a", k.cast("int"))
        return lists.select(*named, F.array(*(_interpolated(F.size("a"), p, at) for p in probabilities)).alias("q"))

    def met(a: DataFrame, b: DataFrame, names: Sequence[str], how: str = "inner", *also: Column) -> DataFrame:
        """a by the rows of b with the same names, nulls alike; b's are renamed first, as the tables descend from each other."""
        other = b.select(*(F.col(k).alias(f"_of_{k}") for k in names), *(c for c in b.columns if c not in names))
        on = [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in names] + list(also)
        return a.join(other, on, how).drop(*(f"_of_{k}" for k in names)) if on else a.crossJoin(other)

    group = [*keys, "path"]
    sizes = cut(sizes)
    places = F.array_distinct(F.flatten(F.array(*(F.array(F.floor((F.col("n") - 1) * F.lit(float(p))), F.ceil((F.col("n") - 1) * F.lit(float(p)))) for p in probabilities))))
    wanted = sizes.select(*keys, F.lit("").alias("path"), F.explode(places).alias("rank"), "n").withColumn("at", F.col("rank"))
    grid = [i / RANGES for i in range(1, RANGES)]
    found = None
    while True:
        large = wanted.filter(F.col("n") > SMALL)
        asked = cut(large.select(*group).distinct())
        sent = F.broadcast if asked.count() <= FEW else (lambda t: t)
        # Values are those of groups with wanted ranks: what isn't large is small.
        small = wanted.filter(F.col("n") <= SMALL).groupBy(*group).agg(F.collect_list(F.struct("rank", "at")).alias("asked"))
        lists = met(values, sent(asked), group, "left_anti").groupBy(*group).agg(F.sort_array(F.collect_list("v")).alias("a"))
        done = met(small, lists, group).select(*keys, F.explode("asked").alias("w"), "a").select(*keys, "w.rank", F.get("a", F.col("w.at").cast("int")).alias("value"))
        cuts = cut(met(values, sent(asked), group, "left_semi").groupBy(*group).agg(F.percentile_approx("v", grid, ACCURACY).alias("cuts")))
        placed = met(values, sent(cuts), group).select(*group, "v", _range_of(F.col("v"), F.col("cuts")).alias("range"))
        counts = placed.groupBy(*group, "range").agg(F.count("*").alias("c"), F.min("v").alias("least"), F.max("v").alias("most"))
        before = F.coalesce(F.sum("c").over(Window.partitionBy(*group).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        counts = counts.withColumn("before", before)
        held = met(large, counts, group, "inner", F.col("before") <= F.col("at"), F.col("at") < F.col("before") + F.col("c"))
        held = cut(held.select(*group, "range", "rank", (F.col("at") - F.col("before")).alias("at"), F.col("c").alias("n"), "least", "most"))
        done = cut(done.unionAll(held.filter("least = most").select(*keys, "rank", F.col("least").alias("value"))))
        found = done if found is None else found.unionAll(done)
        held = held.filter("least <> most")
        deeper = F.concat_ws("/", "path", F.col("range").cast("string"))
        wanted = held.select(*keys, deeper.alias("path"), "rank", "n", "at")
        if wanted.isEmpty():
            break
        kept = held.select(*group, "range").distinct()
        values = cut(met(placed, sent(kept), [*group, "range"], "left_semi").select(*keys, "v", deeper.alias("path")))
    answers = found.groupBy(*keys).agg(F.map_from_entries(F.collect_set(F.struct("rank", "value"))).alias("of"))
    out = met(sizes, answers, keys)
    at = lambda k: F.element_at("of", k.cast("long"))
    return out.select(*named, F.array(*(_interpolated(F.col("n"), p, at) for p in probabilities)).alias("q"))


def medians(df: DataFrame, col: str, by: Sequence[str] = (), name: str = "median") -> DataFrame:
    """by and the median of col as `name`."""
    return quantiles(df, col, [0.5], by).select(*by, F.col("q")[0].alias(name))


def with_groups(df: DataFrame, other: DataFrame, by: Sequence[str], how: str = "left") -> DataFrame:
    """df with the columns that other has for its groups, null groups included."""
    right = other.select(*(F.col(b).alias(f"_by_{b}") for b in by), *(c for c in other.columns if c not in by))
    if not by:
        return df.crossJoin(F.broadcast(right))
    met = df.join(right, [df[b].eqNullSafe(right[f"_by_{b}"]) for b in by], how)
    return met.drop(*(f"_by_{b}" for b in by))
