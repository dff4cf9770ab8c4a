"""Comparisons between conditions and graders (T items, A17 to A19). Values are counted first, so the work after that follows the distinct
values; p-values come from vectorised helpers over the few result rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions import special
from .quantiles import with_groups
from .rounds import cut


@pandas_udf(DoubleType())
def rank_sum_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, exact: pd.Series) -> pd.Series:
    return pd.Series([special.rank_sum_p(*row) if row[1] == row[1] and row[1] >= 2 and row[2] >= 2 else None for row in zip(u, n1.astype(int), n2.astype(int), ties, exact)], dtype=float)


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([2 * special.t_sf(abs(a), b) if a == a and b > 0 else None for a, b in zip(t, df)], dtype=float)


@pandas_udf(DoubleType())
def t_upper(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.t_sf(a, b) if a == a and b > 0 else None for a, b in zip(t, df)], dtype=float)


@pandas_udf(DoubleType())
def t_quantile(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([special.t_quantile(a, b) if b > 0 else None for a, b in zip(p, df)], dtype=float)


@pandas_udf(DoubleType())
def f_upper(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series([special.f_sf(*row) if row[0] == row[0] and row[2] > 0 else None for row in zip(f, d1, d2)], dtype=float)


def _histogram(df: DataFrame, col: str, *by: str) -> DataFrame:
    return df.filter(F.col(col).isNotNull()).groupBy(*by, F.col(col).alias("v")).agg(F.count("*").alias("c"))


def running_totals(rows: DataFrame, by: list[str], order: str, *cols: str) -> DataFrame:
    """rows with, for each of cols, `<col>_before`, the sum over the rows of the same `by` that come before in `order` (which tells them apart),
    and `next`, the order of the row that follows. Rows are dealt to ranges; each range adds up its own, and gets what the ranges before it
    hold, so a group of any size is spread over many tasks."""
    dealt = cut(rows.repartitionByRange(*by, order).withColumn("_part", F.spark_partition_id()))
    sums = dealt.groupBy(*by, "_part").agg(*(F.sum(c).alias(f"_{c}") for c in cols), F.min(order).alias("_first"))
    parts = Window.partitionBy(*by).orderBy("_part")
    behind = parts.rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("_part").alias("_at"), *(F.coalesce(F.sum(f"_{c}").over(behind), F.lit(0)).alias(f"_{c}") for c in cols), F.lead("_first").over(parts).alias("_next"))
    own = Window.partitionBy(*by, "_part").orderBy(order)
    local = own.rowsBetween(Window.unboundedPreceding, -1)
    out = dealt.select("*", *(F.coalesce(F.sum(c).over(local), F.lit(0)).alias(f"_own_{c}") for c in cols), F.lead(order).over(own).alias("_own_next"))
    same = F.col("_part") == F.col("_at")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_by_{b}"))
    out = out.join(offsets, same)
    return out.select(*rows.columns, *((F.col(f"_own_{c}") + F.col(f"_{c}")).alias(f"{c}_before") for c in cols), F.coalesce("_own_next", "_next").alias("next"))


def _against_reference(df: DataFrame, reference: str, col: str) -> DataFrame:
    """Per grader, type (other than the reference) and value: counts of the type (x) and of the reference (r)."""
    counts = _histogram(df, col, "grader", "type")
    types = counts.filter(F.col("type") != reference).select("grader", "type").distinct()
    own = counts.filter(F.col("type") != reference).select("grader", "type", "v", F.col("c").alias("x"), F.lit(0).cast("long").alias("r"))
    ref = counts.filter(F.col("type") == reference).drop("type").join(types, "grader").select("grader", "type", "v", F.lit(0).cast("long").alias("x"), F.col("c").alias("r"))
    return own.unionByName(ref).groupBy("grader", "type", "v").agg(F.sum("x").alias("x"), F.sum("r").alias("r"))


def rank_test(df: DataFrame, reference: str, col: str = "ratio") -> DataFrame:
    """U of the reference sample, effect size, Cliff's delta and the tie sum, for each grader and type."""
    # A row for each grader and value, with the counts of all types: running sums of the reference serve them all.
    counts = _histogram(df, col, "grader", "type")
    is_ref = F.col("type").eqNullSafe(F.lit(reference))
    values = counts.groupBy("grader", "v").agg(F.sum(F.when(is_ref, F.col("c")).otherwise(0)).alias("r"), F.collect_list(F.when(~is_ref, F.struct("type", F.col("c").alias("x")))).alias("others"))
    values = running_totals(values, ["grader"], "v", "r")
    ties = lambda t: (t * t * t - t).cast("double")
    whole = values.groupBy(F.col("grader").alias("_grader")).agg(F.sum("r").alias("n1"), F.sum(ties(F.col("r"))).alias("_ties"))
    rows = values.select("grader", "r", "r_before", F.explode("others").alias("o")).select("grader", "r", "r_before", "o.type", "o.x")
    sums = rows.groupBy("grader", "type").agg(
        F.sum("x").alias("n2"), F.sum(F.col("x") * (F.col("r_before") + F.col("r") / 2)).alias("_below"), F.sum(ties(F.col("x") + F.col("r")) - ties(F.col("r"))).alias("_more")
    )
    out = sums.join(whole, F.col("grader").eqNullSafe(F.col("_grader"))).select("grader", "type", "n1", "n2", (F.col("n1") * F.col("n2") - F.col("_below")).alias("u"), (F.col("_ties") + F.col("_more")).alias("ties"))
    enough = (F.col("n1") >= 2) & (F.col("n2") >= 2)
    out = out.withColumn("u", F.when(enough, F.col("u")))
    effect = 1 - 2 * F.col("u") / (F.col("n1") * F.col("n2"))
    return out.withColumns({"effect": effect, "delta": -effect})


def rank_test_p(df: DataFrame, reference: str, col: str = "ratio", exact: bool = False) -> DataFrame:
    """T1 with p. exact: the exact distribution wherever a test has at most special.EXACT_PAIRS pairs; `method` says which one was used."""
    tested = rank_test(df, reference, col)
    p = rank_sum_p(F.coalesce("u", F.lit(0.0)), "n1", "n2", "ties", F.lit(exact))
    small = F.col("n1") * F.col("n2") <= special.EXACT_PAIRS if exact else (F.least("n1", "n2") <= 8) & (F.col("ties") == 0)
    return tested.withColumns({"p": F.when(F.col("u").isNotNull(), p), "method": F.when(F.col("u").isNotNull(), F.when(small, "exact").otherwise("normal"))})


def disagreement(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """`<grader>_only` where exactly one of any number of graders is significant."""
    hits = tests.groupBy("type").agg(F.count_if(F.col("p") < alpha).alias("n"), F.max(F.when(F.col("p") < alpha, F.col("grader"))).alias("who"))
    return hits.select("type", F.when(F.col("n") == 1, F.concat("who", F.lit("_only"))).alias("disagreement"))


def interval_disagreement(intervals: DataFrame) -> DataFrame:
    """`<grader>_only` for types with intervals of exactly two graders, one of which excludes 0."""
    out = intervals.groupBy("type").agg(F.count("excludes_zero").alias("n"), F.count_if("excludes_zero").alias("hits"), F.max(F.when(F.col("excludes_zero"), F.col("grader"))).alias("who"))
    return out.select("type", F.when((F.col("n") == 2) & (F.col("hits") == 1), F.concat("who", F.lit("_only"))).alias("disagreement"))


def symbols(p: Column, levels: int = 4) -> Column:
    """T4."""
    base = F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*")
    return F.when(p < 0.0001, "****").otherwise(base.otherwise("ns")) if levels == 4 else base.otherwise("n.s.")


#: Distinct values that one task resamples together, at most.
CHUNK = 4096
#: Counts that are drawn at once, about, and chunks of an Arrow batch, at most.
CELLS, CHUNKS_PER_BATCH = 1 << 17, 16


def _chunks(rows: DataFrame, by: list[str], *sides: str) -> DataFrame:
    """rows (by, v and the counts in sides) by chunks of at most CHUNK values in order: by, chunk, h (v, next and the counts), and for each side
    its `path`, which leads from all values of the group down to the chunk: of each node the share of its left half and whether the chunk lies
    there. A chunk's path has a step for each doubling of the number of chunks."""
    whole = running_totals(rows.withColumn("_one", F.lit(1).cast("long")), by, "v", "_one")
    chunks = whole.withColumn("chunk", F.floor(F.col("_one_before") / CHUNK)).groupBy(*by, "chunk").agg(F.sort_array(F.collect_list(F.struct("v", "next", *sides))).alias("h"), *(F.sum(c).alias(f"_{c}") for c in sides))
    chunks = cut(chunks)
    sums = chunks.select(*by, "chunk", *(f"_{c}" for c in sides))
    depth = chunks.groupBy(*(F.col(b).alias(f"_by_{b}") for b in by)).agg(F.ceil(F.log2(F.max("chunk") + 1)).cast("int").alias("depth"))
    alike = lambda a, c, names: [a[n].eqNullSafe(c[m]) for n, m in names]
    own = [(b, f"_by_{b}") for b in by]
    # Nodes of level k hold 2^k chunks; level 0 are the chunks.
    deep = sums.join(depth, alike(sums, depth, own)).drop(*(m for _, m in own))
    nodes = deep.withColumn("level", F.explode(F.sequence(F.lit(0), "depth"))).withColumn("node", F.expr("shiftright(chunk, level)")).groupBy(*by, "level", "node").agg(*(F.sum(f"_{c}").alias(f"_{c}") for c in sides))
    nodes = cut(nodes)
    halves = nodes.withColumns({"up": F.col("level") + 1, "parent": F.expr("shiftright(node, 1)")}).groupBy(*by, "up", "parent").agg(*(F.sum(F.when(F.col("node") % 2 == 0, F.col(f"_{c}")).otherwise(0)).alias(f"left_{c}") for c in sides), *(F.sum(f"_{c}").alias(f"all_{c}") for c in sides))
    steps = deep.filter("depth > 0").withColumn("up", F.explode(F.sequence(F.lit(1), "depth"))).select(*(F.col(b).alias(f"_by_{b}") for b in by), F.col("chunk").alias("_chunk"), F.col("up").alias("_up"), F.expr("shiftright(chunk, up)").alias("_node"), (F.expr("shiftright(chunk, up - 1)") % 2 == 0).alias("goes_left"))
    met = halves.join(steps, [*alike(halves, steps, own), halves["up"] == steps["_up"], halves["parent"] == steps["_node"]])
    share = lambda c: F.coalesce(F.try_divide(F.col(f"left_{c}"), F.col(f"all_{c}")), F.lit(0.0)).alias(c)
    paths = met.groupBy(*(m for _, m in own), "_chunk").agg(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("level"), F.col("parent").alias("node"), "goes_left", *map(share, sides)))).alias("path"))
    totals = nodes.join(depth, [*alike(nodes, depth, own), nodes["level"] == depth["depth"]]).select(*(depth[m] for _, m in own), *(F.col(f"_{c}").alias(f"n_{c}") for c in sides))
    out = chunks.join(paths, [*alike(chunks, paths, own), chunks["chunk"] == paths["_chunk"]], "left").select(*(chunks[c] for c in (*by, "chunk", "h")), "path")
    return out.join(totals, alike(out, totals, own)).drop(*(m for _, m in own))


def _drawn(rng: np.random.Generator, totals: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Multinomial counts: a row for each of totals, a column for each of weights (whole numbers). Where values come few times each, the values
    themselves are drawn and counted, else a binomial draw for each weight takes less."""
    size = int(weights.sum())
    if size == 0:
        return np.zeros((len(totals), len(weights)), np.int64)
    if size > 16 * np.count_nonzero(weights):
        return rng.multinomial(totals, weights / size)
    owner = np.repeat(np.arange(len(weights)), weights)
    cells = owner[rng.integers(0, size, int(totals.sum()), dtype=np.uint16 if size < 1 << 16 else np.uint32)]
    cells += np.repeat(np.arange(len(totals)) * len(weights), totals)
    return np.bincount(cells, minlength=len(totals) * len(weights)).reshape(len(totals), len(weights))


def _resampled(rows: DataFrame, by: list[str], sides: tuple[str, str], replicates: int, block: int, seed: int, measure: Callable[..., dict], merge: dict[str, str], known: DataFrame | None = None) -> DataFrame:
    """by, replicate and the measures of each resample of rows (by, v and the counts in sides): both sides are drawn anew, as many values as
    they have. A chunk's share of a replicate is found by binomial draws down its path, seeded by replicates and node, so all chunks agree on them
    and each knows how much lies before it; its own counts are a multinomial draw. measure(row, v, next, counts, before, sizes) gives arrays by replicate, which
    `merge` (sum or max) joins over chunks; row also has what `known` (by and more columns, a row for each group) knows of the group. A chunk goes
    to several tasks, with some of the blocks each, only if there are few chunks. Runs jobs: the Arrow batches of a few chunks are set for them."""
    spark = rows.sparkSession
    chunks = _chunks(rows, by, *sides)
    chunks = chunks if known is None else with_groups(chunks, known, by)
    blocks, wide, pieces = -(-replicates // block), 4 * spark.sparkContext.defaultParallelism, max(1, chunks.count())
    spans = min(blocks, -(-wide // pieces))
    work = chunks.withColumn("span", F.explode(F.sequence(F.lit(0), F.lit(spans - 1)))).withColumn("key", F.pmod(F.xxhash64(*by), F.lit(2**31)))
    work = work.repartition(min(pieces * spans, max(wide, pieces // 64)), *by, "chunk", "span")
    names = list(merge)

    def draw_block(row: dict, at: int, paths: list[dict], numbers: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        n, own = min(block, replicates - at * block), (seed, row["key"], at)
        totals, before = [], []
        for k, side in enumerate(sides):
            total, behind = np.full(n, row[f"n_{side}"], np.int64), np.zeros(n, np.int64)
            for step in paths:
                left = np.random.default_rng((*own, k, -step["level"], step["node"])).binomial(total, min(1.0, step[side]))
                behind, total = (behind, left) if step["goes_left"] else (behind + left, total - left)
            totals.append(total)
            before.append(behind)
        rngs = [np.random.default_rng((*own, k, 0, row["chunk"])) for k in range(len(sides))]
        sizes, found = [row[f"n_{side}"] for side in sides], []
        step = max(1, CELLS // len(numbers["v"]))
        for some in (slice(i, i + step) for i in range(0, n, step)):
            counts = [_drawn(rng, total[some], numbers[side]) for rng, total, side in zip(rngs, totals, sides)]
            found.append(measure(row, numbers["v"], numbers["next"], counts, [x[some] for x in before], sizes))
        return {c: np.concatenate([x[c] for x in found]) for c in names}

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = batch.select([c for c in batch.schema.names if c not in ("h", "path")])
            for i, row in enumerate(rest.to_pylist()):
                h = batch.column("h")[i].values
                numbers = {c: h.field(c).cast(pa.float64() if c in ("v", "next") else pa.int64()).to_numpy(zero_copy_only=False) for c in ("v", "next", *sides)}
                row["h"] = np.rec.fromarrays(list(numbers.values()), names=list(numbers))
                paths = batch.column("path")[i].as_py() or []
                for at in range(row["span"] * blocks // spans, (row["span"] + 1) * blocks // spans):
                    out = draw_block(row, at, paths, numbers)
                    n = len(out[names[0]])
                    own = [pa.array([row[b]] * n, batch.schema.field(b).type) for b in by]
                    drawn = [pa.array((at * block + np.arange(n)).astype(np.int32)), *(pa.array(np.asarray(out[c], float)) for c in names)]
                    yield pa.RecordBatch.from_arrays(own + drawn, names=[*by, "replicate", *names])

    kinds = ", ".join(f"`{b}` {rows.schema[b].dataType.simpleString()}" for b in by)
    draws = work.mapInArrow(draw, f"{kinds}, replicate int, " + ", ".join(f"{c} double" for c in names))
    most = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(most)
    spark.conf.set(most, CHUNKS_PER_BATCH)
    try:
        return cut(draws.groupBy(*by, "replicate").agg(*((F.max if how == "max" else F.sum)(c).alias(c) for c, how in merge.items())))
    finally:
        spark.conf.set(most, old)


def bootstrap_delta(df: DataFrame, reference: str, col: str = "ratio", replicates: int = 5000, block: int = 250, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile interval of Cliff's delta from resampled counts of distinct values; chunks of values and blocks of replicates are spread
    over tasks. Types without values, or without a reference, have no interval."""
    rows = _against_reference(df, reference, col)
    both = rows.groupBy(F.col("grader").alias("_g"), F.col("type").alias("_t")).agg(F.sum("x").alias("_x"), F.sum("r").alias("_r")).filter("_x > 0 and _r > 0")
    rows = rows.join(both, rows["grader"].eqNullSafe(both["_g"]) & rows["type"].eqNullSafe(both["_t"]), "left_semi")

    def wins(row, v, following, counts, before, sizes):
        xs, rs = counts if sizes[0] * sizes[1] < 2**62 else (c.astype(float) for c in counts)
        # Of a reference value: values below it, and half of its ties, of all.
        inside = np.einsum("ij,ij->i", rs, np.cumsum(xs, axis=1)) - np.einsum("ij,ij->i", rs, xs) / 2
        return {"share": (before[0] * rs.sum(1, dtype=float) + inside) / (float(sizes[0]) * sizes[1])}

    draws = _resampled(rows, ["grader", "type"], ("x", "r"), replicates, block, seed, wins, {"share": "sum"}).withColumn("delta", 2 * F.col("share") - 1)
    out = draws.groupBy("grader", "type").agg(F.percentile("delta", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q")).select("grader", "type", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"))
    return out.withColumn("excludes_zero", (F.col("low") > 0) | (F.col("high") < 0))


#: Values of a side up to which a replicate resamples all of them; a larger side is resampled by bags of about n to the power BAG.
WHOLE, BAG = 20_000, 0.7
#: Values of a bag, about, at most.
BAG_MOST = 1_000_000


def bootstrap(
    df: DataFrame, by: str, statistic: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], float], replicates: int = 1000, alpha: float = 0.05, seed: int = 42, side: str = "side", value: str = "value", bags: int = 20
) -> DataFrame:
    """The interval of statistic(x, weights of x, y, weights of y), weights being how often a value is drawn. df has a row for each value, with
    `by` and the side (0: x, 1: y). Where both sides have at most WHOLE values it is the full bootstrap. Larger ones take a bag of little
    bootstraps: values fall into bags at random, `bags` of them are resampled to the size of the whole side by multinomial weights, and the
    ends of their intervals are averaged. An array holds a bag, not a group. Groups with fewer than two values on a side have no interval."""
    rows = cut(df.filter(F.col(value).isNotNull()).select(F.col(by).alias("_by"), F.col(side).cast("int").alias("side"), F.col(value).cast("double").alias("v"), F.monotonically_increasing_id().alias("_id")))
    sizes = rows.groupBy("_by").agg(F.count_if(F.col("side") == 0).alias("n0"), F.count_if(F.col("side") == 1).alias("n1")).filter("n0 > 1 and n1 > 1").withColumnRenamed("_by", "_of")
    bags_of = lambda n: F.when(n <= WHOLE, F.lit(1)).otherwise(F.ceil(n / F.least(F.pow(n.cast("double"), F.lit(BAG)), F.lit(float(BAG_MOST)))))
    n, most = F.when(F.col("side") == 0, F.col("n0")).otherwise(F.col("n1")), F.greatest("n0", "n1")
    # A side with fewer bags than the other gives each of its bags several times.
    dealt = rows.join(sizes, rows["_by"].eqNullSafe(sizes["_of"])).withColumn("bags", F.least(F.lit(bags), bags_of(most)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("_id", F.lit(seed)), bags_of(n)))
    dealt = dealt.withColumn("bag", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("bags").cast("long") - 1), lambda k: F.pmod(k, bags_of(n)) == F.col("own"))))
    arrays = dealt.groupBy("_by", "bag", "bags", "n0", "n1").agg(*(F.sort_array(F.collect_list(F.when(F.col("side") == k, F.col("v")))).alias(c) for k, c in ((0, "x"), (1, "y")))).filter("size(x) > 0 and size(y) > 0")
    block = 100
    work = arrays.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(-(-replicates // block) - 1)))).withColumn("key", F.pmod(F.xxhash64("_by"), F.lit(2**31))).repartition("_by", "bag", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.to_dict("records"):
                x, y = np.asarray(row["x"], float), np.asarray(row["y"], float)
                rng = np.random.default_rng((seed, row["key"], row["bag"], row["block"]))
                even = [np.full(len(a), 1 / len(a)) for a in (x, y)]
                values = [float(statistic(x, rng.multinomial(row["n0"], even[0]), y, rng.multinomial(row["n1"], even[1]))) for _ in range(min(block, replicates - block * row["block"]))]
                yield pd.DataFrame({"_by": [row["_by"]] * len(values), "bag": row["bag"], "value": values})

    draws = work.mapInPandas(run, f"_by {rows.schema['_by'].dataType.simpleString()}, bag long, value double")
    ends = draws.groupBy("_by", "bag").agg(F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2))).alias("q"))
    return ends.groupBy(F.col("_by").alias(by)).agg(F.avg(F.col("q")[0]).alias("low"), F.avg(F.col("q")[1]).alias("high"))


def weighted_median(values: np.ndarray, weights: np.ndarray) -> float:
    """The median of sorted values that come `weights` times each."""
    upto = np.cumsum(weights)
    n = int(upto[-1])
    return float((values[np.searchsorted(upto, (n - 1) // 2, side="right")] + values[np.searchsorted(upto, n // 2, side="right")]) / 2)


def _moments(df: DataFrame, a: str, b: str, col: Column, by: str = "type", *more: Column) -> DataFrame:
    own = lambda g: F.when(F.col("grader") == g, col)
    out = df.groupBy(by).agg(*(f(own(g)).alias(f"{n}{k}") for k, g in ((1, a), (2, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))), *more)
    return out.filter((F.col("n1") > 1) & (F.col("n2") > 1))


def welch_and_anova(df: DataFrame, a: str, b: str, col: str = "ratio") -> DataFrame:
    """T5: Welch's t and its degrees of freedom, and the one-way F, for two graders in each type."""
    m = _moments(df, a, b, F.col(col))
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    n = F.col("n1") + F.col("n2")
    grand = (F.col("n1") * F.col("m1") + F.col("n2") * F.col("m2")) / n
    between = F.col("n1") * F.pow(F.col("m1") - grand, 2) + F.col("n2") * F.pow(F.col("m2") - grand, 2)
    within = ((F.col("n1") - 1) * F.col("v1") + (F.col("n2") - 1) * F.col("v2")) / (n - 2)
    return m.select("type", "n1", "n2", ((F.col("m1") - F.col("m2")) / F.sqrt(s1 + s2)).alias("t"), (F.pow(s1 + s2, 2) / (F.pow(s1, 2) / (F.col("n1") - 1) + F.pow(s2, 2) / (F.col("n2") - 1))).alias("df"), (between / within).alias("f"))


def welch_and_anova_p(df: DataFrame, a: str, b: str, col: str = "ratio") -> DataFrame:
    """T5 with both p."""
    out = welch_and_anova(df, a, b, col)
    return out.withColumns({"p_welch": t_two_sided("t", "df"), "p_anova": f_upper("f", F.lit(1.0), (F.col("n1") + F.col("n2") - 2).cast("double"))})


def partially_overlapping_t(df: DataFrame, key: str, equal: bool = True, mu: float = 0.0, alternative: str = "two.sided", level: float = 0.95) -> DataFrame:
    """Df has `key`, x and y (null where only one was seen). Statistic, degrees of freedom, estimate, p for the alternative (1 without a
    standard error) and the interval (one end infinite for one-sided alternatives) in one row. It is an error if there are fewer than two pairs, or none alone."""
    if alternative not in ("two.sided", "less", "greater"):
        raise ValueError("alternative: two.sided, less or greater")
    x, y, pair = F.col("x"), F.col("y"), F.col("x").isNotNull() & F.col("y").isNotNull()
    s = df.agg(F.count(x).alias("n1"), F.count(y).alias("n2"), F.count_if(pair).alias("n12"), F.avg(x).alias("m1"), F.avg(y).alias("m2"), F.var_samp(x).alias("v1"), F.var_samp(y).alias("v2"), F.coalesce(F.corr(F.when(pair, x), F.when(pair, y)), F.lit(0.0)).alias("r"))
    n1, n2, n12, v1, v2 = (F.col(c) for c in ("n1", "n2", "n12", "v1", "v2"))
    alone = n1 + n2 - 2 * n12
    if equal:
        pooled = F.sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2))
        se = pooled * F.sqrt(1 / n1 + 1 / n2 - 2 * F.col("r") * n12 / (n1 * n2))
        df_ = (n12 - 1) + (alone + n12 - 1) / (alone + 2 * n12) * alone
    else:
        se = F.sqrt(v1 / n1 + v2 / n2 - 2 * F.col("r") * n12 * F.sqrt(v1) * F.sqrt(v2) / (n1 * n2))
        welch = F.pow(v1 / n1 + v2 / n2, 2) / (F.pow(v1 / n1, 2) / (n1 - 1) + F.pow(v2 / n2, 2) / (n2 - 1))
        df_ = (n12 - 1) + (welch - n12 + 1) / (alone + 2 * n12) * alone
    est = F.col("m1") - F.col("m2")
    checked = F.when(n12 < 2, F.raise_error(F.lit("partially overlapping samples need two pairs or more"))).when(alone <= 0, F.raise_error(F.lit("partially overlapping samples need values without a partner"))).otherwise(est)
    out = s.withColumn("_est", checked.cast("double")).select(F.try_divide(F.col("_est") - mu, se).alias("statistic"), df_.alias("df"), F.col("_est").alias("estimate"), se.alias("_se"))
    t, dof, tails = F.col("statistic"), F.col("df"), 2 if alternative == "two.sided" else 1
    p = t_two_sided(t, dof) if tails == 2 else t_upper(-t if alternative == "less" else t, dof)
    reach = t_quantile(F.lit(1 - (1 - level) / tails), dof) * F.col("_se")
    low = F.lit(float("-inf")) if alternative == "less" else F.col("estimate") - reach
    high = F.lit(float("inf")) if alternative == "greater" else F.col("estimate") + reach
    return out.select("statistic", "df", "estimate", F.coalesce(p, F.lit(1.0)).alias("p"), low.alias("low"), high.alias("high"))


def equivalence_parts(df: DataFrame, a: str, b: str, margin_percent: float = 10.0, col: str = "ratio", alpha: float = 0.05) -> DataFrame:
    """T7 and T8, point parts: both one-sided statistics of Welch's test on logs, the geometric mean ratio with its interval, and the ratio
    of the variances of the values themselves. Values must be positive; others are left out."""
    raw = [F.var_samp(F.when(F.col("grader") == g, F.col(col))) for g in (a, b)]
    m = _moments(df.filter(F.col(col) > 0), a, b, F.ln(col), "type", F.try_divide(*raw).alias("variance_ratio"))
    s1, s2 = F.col("v1") / F.col("n1"), F.col("v2") / F.col("n2")
    d, se, margin = F.col("m1") - F.col("m2"), F.sqrt(s1 + s2), float(np.log1p(margin_percent / 100))
    dof = F.pow(s1 + s2, 2) / (F.pow(s1, 2) / (F.col("n1") - 1) + F.pow(s2, 2) / (F.col("n2") - 1))
    reach = t_quantile(F.lit(1 - alpha / 2), dof) * se
    return m.select(
        "type", F.exp(d).alias("gmr"), F.exp(d - reach).alias("gmr_low"), F.exp(d + reach).alias("gmr_high"), ((d + margin) / se).alias("t_low"), ((d - margin) / se).alias("t_high"), dof.alias("df"), "variance_ratio",
    )


def bootstrap_equivalence(df: DataFrame, a: str, b: str, col: str = "ratio", replicates: int = 1000, block: int = 50, alpha: float = 0.05, seed: int = 42) -> DataFrame:
    """Percentile intervals of the variance ratio and of both distances of logs, from resampled counts of distinct values. The
    three share their resamples; chunks of values and blocks of replicates are spread over tasks."""
    counts = _histogram(df.filter((F.col(col) > 0) & F.col("grader").isin(a, b)), col, "type", "grader")
    own = lambda g: F.sum(F.when(F.col("grader") == g, F.col("c")).otherwise(0))
    rows = counts.groupBy("type", "v").agg(own(a).alias("x"), own(b).alias("y"))
    sizes = rows.groupBy(F.col("type").alias("_type")).agg(F.sum("x").alias("_x"), F.sum("y").alias("_y")).filter("_x > 1 and _y > 1")
    rows = rows.join(sizes, rows["type"].eqNullSafe(sizes["_type"]), "left_semi")

    def measure(row, v, following, drawn, before, sizes):
        out = {}
        with np.errstate(invalid="ignore"):
            gap = np.abs((before[0][:, None] + np.cumsum(drawn[0], axis=1)) / sizes[0] - (before[1][:, None] + np.cumsum(drawn[1], axis=1)) / sizes[1])
        width, off = np.log(following) - np.log(v), v - row["centre"]
        for c, d in zip("xy", drawn):
            out |= {f"{c}0": d.sum(1).astype(float), f"{c}1": d @ off, f"{c}2": d @ off**2}
        return out | {"ks": gap.max(1), "wasserstein": gap @ np.nan_to_num(width)}

    merge = {f"{c}{k}": "sum" for c in "xy" for k in range(3)} | {"ks": "max", "wasserstein": "sum"}
    draws = _resampled(rows, ["type"], ("x", "y"), replicates, block, seed, measure, merge, rows.groupBy("type").agg((F.sum(F.col("v") * (F.col("x") + F.col("y"))) / F.sum(F.col("x") + F.col("y"))).alias("centre")))
    variance = lambda c: (F.col(f"{c}2") - F.col(f"{c}1") * F.col(f"{c}1") / F.col(f"{c}0")) / (F.col(f"{c}0") - 1)
    draws = draws.withColumn("variance", F.try_divide(variance("x"), variance("y")))
    ends = (("low", alpha / 2), ("high", 1 - alpha / 2))
    return draws.groupBy("type").agg(*(F.percentile(c, q).alias(f"{c}_{end}") for c in ("variance", "ks", "wasserstein") for end, q in ends))


def equivalence(df: DataFrame, a: str, b: str, margin_percent: float = 10.0, alpha: float = 0.05, ks_limit: float = 0.08, distance_limit: float = 0.10, col: str = "ratio", variance_bounds: tuple[float, float] = (0.8, 1.25), replicates: int = 1000, seed: int = 42) -> DataFrame:
    """P of both one-sided tests, variance ratio, distances and their bootstrap intervals, and whether all hold: p below alpha, the
    interval of the variance ratio within its bounds, and the upper ends of both distances at most at their limits."""
    parts = equivalence_parts(df, a, b, margin_percent, col, alpha).withColumn("p", F.greatest(t_upper("t_low", "df"), t_upper(-F.col("t_high"), "df")))
    both = parts.join(distances(df, a, b, col), "type").join(bootstrap_equivalence(df, a, b, col, replicates, alpha=alpha, seed=seed), "type")
    checks = {
        "mean_equivalent": F.col("p") < alpha, "variance_equivalent": within(F.col("variance_low"), F.col("variance_high"), variance_bounds),
        "ks_equivalent": F.col("ks_high") <= ks_limit, "wasserstein_equivalent": F.col("wasserstein_high") <= distance_limit,
    }
    both = both.withColumns(checks)
    return both.withColumn("equivalent", F.expr(" and ".join(checks)))


def distances(df: DataFrame, a: str, b: str, col: str = "ratio") -> DataFrame:
    """Greatest gap of the two distribution functions of logs and the area between them."""
    counts = _histogram(df.filter(F.col(col) > 0).withColumn("_log", F.ln(col)), "_log", "type", "grader")
    own = lambda g: F.sum(F.when(F.col("grader") == g, F.col("c")).otherwise(0))
    rows = counts.groupBy("type", "v").agg(own(a).alias("x"), own(b).alias("y")).filter("x + y > 0")
    sizes = rows.groupBy(F.col("type").alias("_type")).agg(F.sum("x").alias("nx"), F.sum("y").alias("ny"))
    rows = running_totals(rows, ["type"], "v", "x", "y").join(sizes, F.col("type").eqNullSafe(F.col("_type")))
    share = lambda c: (F.col(f"{c}_before") + F.col(c)) / F.nullif(f"n{c}", F.lit(0))
    rows = rows.withColumns({"gap": F.abs(share("x") - share("y")), "step": F.col("next") - F.col("v")})
    return rows.groupBy("type").agg(F.max("gap").alias("ks"), F.coalesce(F.sum(F.col("gap") * F.col("step")), F.lit(0.0)).alias("wasserstein"))


def cluster_means(df: DataFrame, a: str, b: str, col: str = "ratio", log: bool = True) -> DataFrame:
    """T12, input: mean of each type for both graders as A and B."""
    v = F.ln(F.when(F.col(col) > 0, F.col(col))) if log else F.col(col)
    own = lambda g: F.avg(F.when(F.col("grader") == g, v))
    return df.groupBy("type").agg(own(a).alias("A"), own(b).alias("B")).dropna(subset=["A", "B"])


def average_rank(col: str) -> Column:
    """Rank with ties averaged, over a table of few rows."""
    return F.rank().over(Window.orderBy(col)) + (F.count("*").over(Window.partitionBy(col)) - 1) / 2


def agreement(means: DataFrame) -> DataFrame:
    """Pearson, Spearman, Kendall's tau-b and least squares of B on A, over one row for each type."""
    ranked = means.withColumns({"ra": average_rank("A"), "rb": average_rank("B")})
    line = ranked.agg(F.count("*").alias("n"), F.corr("A", "B").alias("pearson"), F.corr("ra", "rb").alias("spearman"), F.regr_slope("B", "A").alias("slope"), F.regr_intercept("B", "A").alias("intercept"))
    p, q = means.select("type", "A", "B"), means.select(F.col("type").alias("t2"), F.col("A").alias("a2"), F.col("B").alias("b2"))
    pairs = p.join(q, F.col("type") < F.col("t2")).select(F.signum(F.col("A") - F.col("a2")).alias("sa"), F.signum(F.col("B") - F.col("b2")).alias("sb"))
    tau = pairs.agg((F.sum(F.col("sa") * F.col("sb")) / F.sqrt(F.count_if(F.col("sa") != 0) * F.count_if(F.col("sb") != 0))).alias("kendall"))
    return line.crossJoin(F.broadcast(tau))


@pandas_udf(DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([special.correlation_p(a, int(b)) if a == a else None for a, b in zip(r, n)], dtype=float)


@pandas_udf(DoubleType())
def kendall_p(score: pd.Series, n: pd.Series, x: pd.Series, x0: pd.Series, x1: pd.Series, y: pd.Series, y0: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series([special.kendall_p(r[0], int(r[1]), (r[2:5], r[5:8])) for r in zip(score, n, x, x0, x1, y, y0, y1)], dtype=float)


def agreement_p(means: DataFrame) -> DataFrame:
    """T12 with p of all three coefficients, over one row for each type."""
    p, q = means.select("type", "A", "B"), means.select(F.col("type").alias("t2"), F.col("A").alias("a2"), F.col("B").alias("b2"))
    score = p.join(q, F.col("type") < F.col("t2")).agg(F.sum(F.signum(F.col("A") - F.col("a2")) * F.signum(F.col("B") - F.col("b2"))).alias("score"))

    def ties(c: str) -> DataFrame:
        t = F.col("t").cast("double")
        sums = means.groupBy(c).agg(F.count("*").alias("t"))
        return sums.agg(F.sum(t * (t - 1) / 2).alias(f"{c}_x"), F.sum(t * (t - 1) * (t - 2)).alias(f"{c}_x0"), F.sum(t * (t - 1) * (2 * t + 5)).alias(f"{c}_x1"))

    out = agreement(means).crossJoin(F.broadcast(score)).crossJoin(F.broadcast(ties("A"))).crossJoin(F.broadcast(ties("B")))
    return out.select("n", "pearson", correlation_p("pearson", "n").alias("pearson_p"), "spearman", correlation_p("spearman", "n").alias("spearman_p"), "kendall", kendall_p("score", "n", "A_x", "A_x0", "A_x1", "B_x", "B_x0", "B_x1").alias("kendall_p"))


def regression_intervals(means: DataFrame, level: float = 0.95) -> DataFrame:
    """Least squares of B on A with intervals; T16 asks whether they lie in given bounds."""
    s = means.agg(F.count("*").alias("n"), F.avg("A").alias("ma"), F.regr_slope("B", "A").alias("slope"), F.regr_intercept("B", "A").alias("intercept"), F.regr_sxx("B", "A").alias("sxx"), F.regr_syy("B", "A").alias("syy"), F.regr_sxy("B", "A").alias("sxy"))
    error = F.sqrt((F.col("syy") - F.col("slope") * F.col("sxy")) / (F.col("n") - 2))
    s = s.withColumn("t", t_quantile(F.lit(1 - (1 - level) / 2), (F.col("n") - 2).cast("double")))
    s = s.withColumns({"se_slope": error / F.sqrt("sxx"), "se_intercept": error * F.sqrt(1 / F.col("n") + F.col("ma") * F.col("ma") / F.col("sxx"))})
    return s.select("n", "slope", "intercept", *((F.col(c) + k * F.col("t") * F.col(f"se_{c}")).alias(f"{c}_{end}") for c in ("slope", "intercept") for k, end in ((-1, "low"), (1, "high"))))


def within(low: Column, high: Column, bounds: tuple[float, float]) -> Column:
    """T16."""
    return (low >= bounds[0]) & (high <= bounds[1])


def deming(means: DataFrame, ratio: DataFrame | float) -> DataFrame:
    """Ratio of error variances, B's over A's; a table with `lambda` or a number."""
    s = means.agg(F.avg("A").alias("ma"), F.avg("B").alias("mb"), F.var_samp("A").alias("vx"), F.var_samp("B").alias("vy"), F.covar_samp("A", "B").alias("c"))
    s = s.withColumn("lambda", F.lit(float(ratio))) if isinstance(ratio, (int, float)) else s.crossJoin(F.broadcast(ratio))
    d = F.col("vy") - F.col("lambda") * F.col("vx")
    slope = (d + F.sqrt(d * d + 4 * F.col("lambda") * F.col("c") * F.col("c"))) / (2 * F.col("c"))
    return s.select("lambda", slope.alias("slope"), (F.col("mb") - slope * F.col("ma")).alias("intercept"))


def error_ratio(df: DataFrame, a: str, b: str, col: str = "ratio", log: bool = True) -> DataFrame:
    """Mean variance within types, B's over A's, of logs only."""
    v = F.ln(F.when(F.col(col) > 0, F.col(col))) if log else F.col(col)
    cells = df.filter(F.col("grader").isin(a, b)).groupBy("type", "grader").agg(F.coalesce(F.var_samp(v), F.lit(0.0)).alias("s"))
    own = lambda g: F.avg(F.when(F.col("grader") == g, F.col("s")))
    return cells.agg((F.greatest(own(b), F.lit(1e-12)) / F.greatest(own(a), F.lit(1e-12))).alias("lambda"))


def interaction(df: DataFrame, col: str = "ratio") -> DataFrame:
    """F of type x grader with unbalanced cells: the additive model is fitted on the table of cells, a row for each."""
    return interaction_of_cells(df.filter(F.col(col).isNotNull()).groupBy("type", "grader").agg(F.count("*").alias("n"), F.avg(col).alias("m"), F.coalesce(F.var_samp(col), F.lit(0.0)).alias("v")))


def interaction_of_cells(cells: DataFrame) -> DataFrame:
    """T15 from the number, mean and variance of each cell."""

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), pd.get_dummies(pdf["type"], drop_first=True, dtype=float), pd.get_dummies(pdf["grader"], drop_first=True, dtype=float)])
        w = np.sqrt(pdf["n"].to_numpy(float))
        fitted = x @ np.linalg.lstsq(x * w[:, None], pdf["m"].to_numpy() * w, rcond=None)[0]
        extra, d1 = float((pdf["n"] * (pdf["m"] - fitted) ** 2).sum()), len(pdf) - np.linalg.matrix_rank(x)
        rest, d2 = float(((pdf["n"] - 1) * pdf["v"]).sum()), int(pdf["n"].sum()) - len(pdf)
        f = extra / d1 / (rest / d2) if d1 and d2 > 0 and rest > 0 else None
        return pd.DataFrame({"f": [f], "df1": [float(d1)], "df2": [float(d2)], "p": [special.f_sf(f, d1, d2) if f is not None else None]}, dtype=float)

    return cells.groupBy().applyInPandas(lambda pdf: fit(pdf), "f double, df1 double, df2 double, p double")


def binary_scores(df: DataFrame, truth: str = "y", score: str = "score", threshold: float = 0.5) -> DataFrame:
    """A17."""
    yes, hit = F.col(truth) == 1, F.col(score) >= threshold
    c = df.agg(F.count_if(yes & hit).alias("tp"), F.count_if(~yes & hit).alias("fp"), F.count_if(yes & ~hit).alias("fn"), F.count_if(~yes & ~hit).alias("tn"))
    tp, fp, fn, tn = (F.col(k) for k in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    over = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    chance = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)
    return c.select(over(tp + tn, n).alias("accuracy"), over(tp, tp + fp).alias("precision"), over(tp, tp + fn).alias("recall"), over(tn, tn + fp).alias("specificity"), over(2 * tp, 2 * tp + fp + fn).alias("f1"), over((tp + tn) / n - chance, 1 - chance).alias("kappa"))


def ranking_scores(df: DataFrame, truth: str = "y", score: str = "score") -> DataFrame:
    """AUROC and average precision, ties together. Scores are counted first; running sums go over distinct scores."""
    counts = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(truth) == 1).alias("p"), F.count_if(F.col(truth) != 1).alias("n"))
    r = running_totals(counts.withColumn("down", -F.col("s")), [], "down", "p", "n")
    r = r.withColumns({"tp": F.col("p_before") + F.col("p"), "fp": F.col("n_before") + F.col("n")})
    area = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2)) / (F.sum("p") * F.sum("n"))
    return r.agg(area.alias("auroc"), (F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.sum("p")).alias("average_precision"))
