"""Measurement tables: filters, conversions, unions, group statistics, rankings (F, P, U, A, W, X items)."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import HUMAN, KEY, ORIGIN, TERMINATION, TWO, VALID_TYPES
from .quantiles import medians, quantiles, with_groups


def nan_to_null(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols})


def drop_invalid_boxes(df: DataFrame, box: str = "bbox", pixels: str | None = None) -> DataFrame:
    """F1; pixels: the column of the fiber's pixels, which must not be empty."""
    b = F.col(box)
    rows = df.filter((b["width"] > 0) & (b["height"] > 0) & (b["x"] >= 0) & (b["y"] >= 0))
    return rows.filter(F.size(pixels) > 0) if pixels else rows


def valid_only(df: DataFrame) -> DataFrame:
    """F2."""
    return df.filter(F.col("fiber_type").isin(*VALID_TYPES))


def only_double(df: DataFrame) -> DataFrame:
    return df.filter(F.col("fiber_type") == TWO)


def only_triple(df: DataFrame) -> DataFrame:
    return df.filter(F.col("fiber_type").isin(TERMINATION, ORIGIN))


def exclude_types(df: DataFrame, types: Sequence[str], col: str = "fiber_type") -> DataFrame:
    """F4; with the column of conditions F10. Rows without a type stay."""
    return df.filter(~F.coalesce(F.col(col).isin(*types), F.lit(False)))


def complete(df: DataFrame, cols: Sequence[str] = ("ratio", "length_um")) -> DataFrame:
    """F11."""
    return df.dropna(subset=list(cols))


def lookup(df: DataFrame, fiber_id: int) -> DataFrame:
    """F12."""
    return df.filter(F.col("fiber_id") == fiber_id)


def renamed(df: DataFrame, by_grader: Mapping[str, Callable[[Column], Column]], then: Callable[[Column], Column] | None = None, col: str = "type") -> DataFrame:
    """Each grader's own renaming of its conditions, then one for all. A renaming maps a Column to a Column."""
    out = F.col(col)
    for grader, rename in by_grader.items():
        out = F.when(F.col("grader") == grader, rename(F.col(col))).otherwise(out)
    rows = df.withColumn(col, out)
    return rows.withColumn(col, then(F.col(col))) if then else rows


def below_error(df: DataFrame, threshold: float = 0.5, inclusive: bool = False) -> DataFrame:
    """F5."""
    p = F.col("error_probability")
    return df.filter(p <= threshold if inclusive else p < threshold)


def inside_border(df: DataFrame, border: int, width: int, height: int, box: str = "bbox") -> DataFrame:
    """F6."""
    b = F.col(box)
    return df.filter(~((b["x"] < border) | (b["y"] < border) | (b["x"] + b["width"] > width - border) | (b["y"] + b["height"] > height - border)))


def longer_than(df: DataFrame, length: float) -> DataFrame:
    """F7."""
    return df.filter(F.col("first_um") + F.col("second_um") > length)


def in_range(df: DataFrame, low: float, high: float, col: str = "ratio", inclusive: bool = True) -> DataFrame:
    """F8."""
    c = F.col(col)
    return df.filter(c.between(low, high) if inclusive else (c > low) & (c < high))


def present_in(df: DataFrame, other: DataFrame, col: str = "type") -> DataFrame:
    """conditions that the other table has."""
    return df.join(other.select(col).distinct(), col, "left_semi")


def measure(fibers: DataFrame, um_per_px: float) -> DataFrame:
    """Red and green (pixels) to first, second, ratio and length."""
    first, second = F.col("red") * um_per_px, F.col("green") * um_per_px
    return fibers.withColumns({"first_um": first, "second_um": second, "length_um": first + second, "ratio": F.try_divide("green", F.nullif("red", F.lit(0.0)))})


def display(df: DataFrame) -> DataFrame:
    """Three decimals, ratio 0 where the first tract is 0."""
    return df.withColumns({c: F.format_string("%.3f", F.col(c)) for c in ("first_um", "second_um")}).withColumn("ratio", F.format_string("%.3f", F.coalesce("ratio", F.lit(0.0))))


def swap(df: DataFrame) -> DataFrame:
    """P3."""
    return df.withColumns({"first_um": F.col("second_um"), "second_um": F.col("first_um"), "ratio": F.try_divide("first_um", F.nullif("second_um", F.lit(0.0)))})


def offset_transition(df: DataFrame, grader: str, offset_um: float, symmetric: bool = False) -> DataFrame:
    """P4."""
    own = F.col("grader") == grader
    second = F.when(own, F.col("second_um") - offset_um).otherwise(F.col("second_um"))
    first = F.when(own, F.col("first_um") + offset_um).otherwise(F.col("first_um")) if symmetric else F.col("first_um")
    return df.withColumns({"first_um": first, "second_um": second}).withColumn("ratio", F.try_divide("second_um", F.nullif("first_um", F.lit(0.0))))


def union_graded(*tables: tuple[DataFrame, str]) -> DataFrame:
    """By name, missing columns null, with each table's grader."""
    out = None
    for df, grader in tables:
        one = df.withColumn("grader", F.lit(grader))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def append(df: DataFrame, other: DataFrame) -> DataFrame:
    """All rows of both, by name; their files are not kept."""
    return df.drop("path").unionByName(other.drop("path"), allowMissingColumns=True)


def distinct_names(df: DataFrame, *cols: str) -> DataFrame:
    """The names that each column has, as rows of column and name."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("name")) for c in cols])).alias("n")).select("n.*").filter("name is not null").distinct()


def added_and_skipped(df: DataFrame, key: str) -> DataFrame:
    """How many rows `dedupe` keeps, and how many it passes over."""
    return df.groupBy(key).agg(F.count("*").alias("n")).agg(F.count("*").alias("added"), F.sum(F.col("n") - 1).alias("skipped"))


def dedupe(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """The first row of each key."""
    first = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", first).filter("_n = 1").drop("_n")


def summary(df: DataFrame, col: str = "ratio", by: Sequence[str] = ("type", "grader"), log: bool = False) -> DataFrame:
    """A1."""
    rows = df.select(*by, (F.ln(col) if log else F.col(col)).alias("_v"))
    out = rows.groupBy(*by).agg(F.count("_v").alias("n"), F.avg("_v").alias("mean"), F.stddev_samp("_v").alias("sd"))
    return with_groups(out, medians(rows, "_v", by), by).select(*by, "n", "mean", "median", "sd")


def box_statistics(df: DataFrame, col: str = "ratio", by: Sequence[str] = ("type", "grader"), approximate: int | None = None) -> DataFrame:
    """A2: quartiles and whiskers within 1.5 interquartile ranges. approximate: the accuracy of percentile_approx."""
    every = df.groupBy(*by).agg(F.percentile_approx(col, [0.25, 0.5, 0.75], approximate).alias("q")) if approximate else quantiles(df, col, [0.25, 0.5, 0.75], by)
    quartiles = every.select(*by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("q2"), F.col("q")[2].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    inside = with_groups(df, quartiles, by, "inner").filter(F.col(col).between(F.col("q1") - reach, F.col("q3") + reach))
    return inside.groupBy(*by, "q1", "q2", "q3").agg(F.min(col).alias("low"), F.max(col).alias("high"))


def by_grader(df: DataFrame, graders: Sequence[str], col: str = "ratio") -> DataFrame:
    """One median column per grader."""
    every = medians(df.filter(F.col("grader").isin(*graders)), col, ["type", "grader"])
    return every.groupBy("type").agg(*(F.max(F.when(F.col("grader") == g, F.col("median"))).alias(g) for g in graders)).dropna(subset=list(graders))


def median_difference(df: DataFrame, first: str, second: str, col: str = "ratio") -> DataFrame:
    """A3."""
    return by_grader(df, [first, second], col).select("type", (F.col(second) - F.col(first)).alias("difference"))


def normalise(df: DataFrame, baseline: str, col: str = "ratio", per_grader: bool = True) -> DataFrame:
    """A4: divides by the baseline's median (null without one)."""
    base = df.filter(F.col("type") == baseline)
    if per_grader:
        return df.join(medians(base, col, ["grader"], "_base"), "grader", "left").withColumn(col, F.try_divide(F.col(col), F.col("_base"))).drop("_base")
    whole = base.agg(F.count(col).alias("_n")).join(medians(base, col, (), "_base"), F.lit(True), "left").drop("_n")
    return df.crossJoin(F.broadcast(whole)).withColumn(col, F.try_divide(F.col(col), F.col("_base"))).drop("_base")


def count_change(old: DataFrame, new: DataFrame, col: str = "fiber_type") -> DataFrame:
    """A5."""
    counts = lambda df, name: df.groupBy(F.coalesce(col, F.lit("(no type)")).alias(col)).agg(F.count("*").alias(name))
    both = counts(old, "n_old").join(counts(new, "n_new"), col, "full").fillna(0, ["n_old", "n_new"])
    return both.withColumn("percent", F.try_divide((F.col("n_new") - F.col("n_old")) * 100.0, F.col("n_old")))


def robustness(df: DataFrame, col: str = "ratio") -> DataFrame:
    """Medians and counts at the lowest and highest sigma of each model."""
    per = with_groups(df.groupBy("model", "sigma").agg(F.count("*").alias("n")), medians(df, col, ["model", "sigma"]), ["model", "sigma"])
    ends = per.groupBy("model").agg(*(f(F.col(c), F.col("sigma")).alias(f"{c}_{name}") for c in ("median", "n") for f, name in ((F.min_by, "low"), (F.max_by, "high"))))
    return ends.withColumns({"median_change": F.abs(F.col("median_high") - F.col("median_low")) / F.col("median_low") * 100, "count_drop": (F.col("n_low") - F.col("n_high")) / F.col("n_low") * 100})


def describe(df: DataFrame, col: str, by: str) -> DataFrame:
    """With the geometric mean."""
    out = df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.exp(F.avg(F.ln(col))).alias("geometric_mean"))
    return with_groups(out, medians(df, col, [by]), [by]).select(by, "n", "mean", "median", "sd", "geometric_mean")


def longest(df: DataFrame, n: int) -> DataFrame:
    """W1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(F.desc("length_um"), *KEY))).filter(F.col("rank") <= n)


def closest(df: DataFrame, n: int | None, col: str = "ratio", centre: Callable[[str], Column] | None = None, untouched: str = HUMAN) -> DataFrame:
    """Rows nearest to each (type, grader)'s centre (the median, or an aggregate of col); rows of `untouched` stay. n None: that grader's count of the type."""
    rest, fixed = df.filter(F.col("grader") != untouched), df.filter(F.col("grader") == untouched)
    centres = rest.groupBy("type", "grader").agg(centre(col).alias("_centre")) if centre else medians(rest, col, ["type", "grader"], "_centre")
    sizes = fixed.groupBy("type").agg(F.count("*").alias("_n"))
    rows = rest.join(centres, ["type", "grader"])
    rows = rows.withColumn("_n", F.lit(n)) if n is not None else rows.join(sizes, "type")
    order = Window.partitionBy("type", "grader").orderBy(F.abs(F.col(col) - F.col("_centre")), *KEY)
    return rows.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= F.col("_n")).drop("_rank", "_centre", "_n").unionByName(fixed)


def cap_groups(df: DataFrame, n: int, col: str = "length_um") -> DataFrame:
    """Groups of at most n stay, of others the n nearest to the median."""
    centres = medians(df, col, ["type", "grader"], "_centre")
    order = Window.partitionBy("type", "grader").orderBy(F.abs(F.col(col) - F.col("_centre")), *KEY)
    return df.join(centres, ["type", "grader"]).withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank", "_centre")


def nearest_to_median(df: DataFrame, n: int, col: str = "length_um") -> DataFrame:
    """Over the whole table."""
    return df.crossJoin(F.broadcast(medians(df, col, (), "_centre"))).orderBy(F.abs(F.col(col) - F.col("_centre")), *KEY).limit(n).drop("_centre")


def first_k(df: DataFrame, k: int) -> DataFrame:
    """W5."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("type").orderBy(*KEY))).filter(F.col("rank") <= k)


def order_types(df: DataFrame, col: str = "length_um", descending: bool = False, grader: str | None = None) -> DataFrame:
    """Type, its median and type_order."""
    rows = df.filter(F.col("grader") == grader) if grader else df
    every = with_groups(rows.select("type").distinct(), medians(rows, col, ["type"]), ["type"])
    return every.withColumn("type_order", F.row_number().over(Window.orderBy(F.desc("median") if descending else F.asc("median"), "type")))


def with_order(df: DataFrame, order: DataFrame) -> DataFrame:
    return df.join(order.select("type", "type_order"), "type", "left")


def fixed_order(df: DataFrame, types: Sequence[str]) -> DataFrame:
    """W7."""
    return df.withColumn("type_order", F.array_position(F.array(*map(F.lit, types)), F.col("type")).cast("int"))


def order_concordance(medians: DataFrame, human: str, ai: str, tolerance: float = 0.01) -> DataFrame:
    """In the human order the first is near the AI's least, the last near its greatest, and none falls below an earlier one."""
    order, every = Window.orderBy(human, "type"), Window.orderBy(human, "type").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.max(ai).over(order.rowsBetween(Window.unboundedPreceding, -1))
    n, rank = F.count("*").over(every), F.row_number().over(order)
    ok = F.when(rank == 1, F.abs(F.col(ai) - F.min(ai).over(every)) <= tolerance).when(rank == n, F.abs(F.col(ai) - F.max(ai).over(every)) <= tolerance).otherwise(F.col(ai) >= earlier)
    return medians.select("type", rank.alias("type_order"), ok.alias("concordant"))


def trend(order: DataFrame) -> DataFrame:
    """Least squares of the median on the order."""
    x, y = F.col("type_order").cast("double"), F.col("median")
    return order.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.corr(y, x).alias("r"))


def resolve_duplicates(df: DataFrame, name: str = "filename", label: str = "quality", order: str = "row") -> DataFrame:
    """One row per normalised name: the first one, with the first label of the group; Bad is 1, Good and none 0."""
    key = F.regexp_replace(F.when(F.col(name).contains("("), F.concat(F.rtrim(F.substring_index(name, "(", 1)), F.lit(".png"))).otherwise(F.col(name)), r"(\.png)+$", ".png")
    w = Window.partitionBy("key").orderBy(order)
    filled = F.first(label, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    rows = df.withColumn("key", key).withColumns({"_label": filled, "_n": F.row_number().over(w)})
    return rows.filter("_n = 1").select("key", order, (F.coalesce(F.col("_label"), F.lit("Good")) == "Bad").cast("int").alias("is_error"))


def collapse_gaps(df: DataFrame, coord: str, by: str, tile: float, factor: float = 1.5) -> DataFrame:
    """A gap beyond tile * factor loses its excess."""
    w = Window.partitionBy(by).orderBy(coord)
    gap = F.col(coord) - F.lag(coord).over(w)
    excess = F.when(gap > tile * factor, gap - tile).otherwise(0.0)
    return df.withColumn("_excess", excess).withColumn("shifted", F.col(coord) - F.sum("_excess").over(w.rangeBetween(Window.unboundedPreceding, 0))).drop("_excess")


def compact_grid(df: DataFrame, by: str, order: Sequence[str]) -> DataFrame:
    """W12."""
    cols = F.ceil(F.sqrt(F.count("*").over(Window.partitionBy(by)))).cast("int")
    index = F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1
    return df.withColumns({"_cols": cols, "_index": index}).withColumns({"row": F.floor(F.col("_index") / F.col("_cols")).cast("int"), "col": F.col("_index") % F.col("_cols")}).drop("_cols", "_index")


def adjust_p(df: DataFrame, p: str = "p", key: str = "type") -> DataFrame:
    """Benjamini-Hochberg and Holm over all rows (one per test)."""
    up = Window.orderBy(p, key)
    rows = df.withColumns({"_k": F.row_number().over(up), "_m": F.count("*").over(Window.partitionBy(F.lit(1)))})
    bh = F.min(F.least(F.lit(1.0), F.col(p) * F.col("_m") / F.col("_k"))).over(Window.orderBy("_k").rowsBetween(0, Window.unboundedFollowing))
    holm = F.max(F.least(F.lit(1.0), F.col(p) * (F.col("_m") - F.col("_k") + 1))).over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumns({"p_bh": bh, "p_holm": holm}).drop("_k", "_m")


def test_pairs(order: DataFrame, mode: str = "all") -> DataFrame:
    """Pairs of types by order: all, against the first (`reference`), or neighbours and the next but one (`near`)."""
    a, b = order.select(F.col("type").alias("a"), F.col("type_order").alias("i")), order.select(F.col("type").alias("b"), F.col("type_order").alias("j"))
    wanted = {"all": F.col("i") < F.col("j"), "reference": (F.col("i") == 1) & (F.col("j") > 1), "near": (F.col("j") - F.col("i")).isin(1, 2)}[mode]
    return a.join(b, wanted)


def split(df: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """A stable part for each key, `train` in about percent of all."""
    return df.withColumn("part", F.when(F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(100)) < percent, "train").otherwise("test"))


def split_by_rule(df: DataFrame, name: str, pattern: str = "04|05|06") -> DataFrame:
    """X2."""
    return df.withColumn("part", F.when(F.col(name).rlike(pattern), "test").otherwise("train"))


def pair_by_position(a: DataFrame, b: DataFrame, name: str = "path", strict: bool = True) -> DataFrame:
    """The i-th of a with the i-th of b, by name, within each entry. Their numbers must agree: an error if strict, else the other side
    of a left-over file is null."""
    rank = F.row_number().over(Window.partitionBy("entry").orderBy(name))
    left, right = a.select("entry", rank.alias("position"), F.col(name).alias("first")), b.select("entry", rank.alias("position"), F.col(name).alias("second"))
    both = left.join(right, ["entry", "position"], "full")
    if not strict:
        return both
    alone = F.raise_error(F.concat(F.lit("files without a partner: entry "), F.col("entry").cast("string"))).cast("string")
    return both.withColumns({c: F.coalesce(c, alone) for c in ("first", "second")})


def role_check(df: DataFrame, required: Sequence[str], optional: Sequence[str] = ()) -> DataFrame:
    """The issues of each entry's role assignment."""
    counts = df.groupBy("entry").agg(*(F.count_if(F.col("role") == r).alias(r) for r in (*required, *optional)))
    issues = [F.when(F.col(r) != 1, F.concat(F.lit(f"{r}: "), F.col(r).cast("string"))) for r in required] + [F.when(F.col(r) > 1, F.concat(F.lit(f"{r}: "), F.col(r).cast("string"))) for r in optional]
    return counts.select("entry", F.concat_ws("; ", *issues).alias("issues"))


def not_done(inputs: DataFrame, outputs: DataFrame, key: str = "stem") -> DataFrame:
    """J17."""
    return inputs.join(outputs.select(key), key, "left_anti")


def missing_annotators(df: DataFrame) -> DataFrame:
    """(image, annotator) pairs of the grid that have no mask."""
    annotators = df.select("annotator").distinct().agg(F.collect_set("annotator").alias("a"))
    grid = df.select("image").distinct().crossJoin(F.broadcast(annotators)).select("image", F.explode("a").alias("annotator"))
    return grid.join(df.select("image", "annotator").distinct(), ["image", "annotator"], "left_anti")


def annotator_stacks(df: DataFrame) -> DataFrame:
    """Each image's masks by annotator, in order, as one array."""
    return df.groupBy("image").agg(F.array_sort(F.collect_set("annotator")).alias("present"))
