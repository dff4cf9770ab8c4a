"""Registered queries over the given tables and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import names as N
from ..operators import cohort as C
from ..operators import matching as J
from ..operators import pixels as P
from ..operators import statistics as S
from ..operators.quantiles import medians
from ..operators.rounds import cut
from ..schemas import AI, HUMAN
from ..sources import files
from . import fixtures as X
from .fixtures import BASELINE, BOXES_SQL, MEASUREMENTS_SQL, PIXELS_SQL, POINTS_SQL

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def _r(c: str | Column, name: str | None = None, digits: int = 6) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return (F.round(col, digits) + 0.0).alias(name or c)


def query(sql: str | None = None, base: str = "") -> Callable[[Query], Query]:
    """Registers a query; base: the common table expressions that its SQL builds on."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {base} {sql}" if base else sql
        return f

    return add


M, B, T, PX = MEASUREMENTS_SQL, BOXES_SQL, POINTS_SQL, f"{BOXES_SQL}, {PIXELS_SQL}"


def _clean(spark: SparkSession, sf: str) -> DataFrame:
    """F3, F5 and F8 with the usual parameters."""
    return C.in_range(C.below_error(C.only_double(X.measurements(spark, sf))), 0.125, 8)


@query(f", n AS (SELECT d.* REPLACE (d.ratio / q.b AS ratio) FROM d JOIN (SELECT grader, median(ratio) AS b FROM d WHERE type = '{BASELINE}' GROUP BY 1) q USING (grader)), o AS (SELECT type, row_number() OVER (ORDER BY median(length_um), type) AS type_order FROM d GROUP BY type) SELECT n.type, grader, type_order::INT AS type_order, count(*) AS n, round(avg(ratio), 6) AS mean, round(median(ratio), 6) AS median, round(stddev_samp(ratio), 6) AS sd FROM n JOIN o USING (type) GROUP BY ALL", M)
def flagship_conditions(spark, sf):
    """Clean, normalise to the baseline, order the conditions, summarise."""
    rows = _clean(spark, sf)
    out = C.summary(C.normalise(rows, BASELINE))
    return C.with_order(out, C.order_types(rows)).select("type", "grader", "type_order", "n", *map(_r, ("mean", "median", "sd")))


@query("SELECT type, grader, count(*) AS n, round(sum(length_um), 4) AS total FROM m WHERE fiber_type IN ('two segments', 'termination', 'origin', 'other') AND error_probability <= 0.5 AND length_um > 20 AND ratio > 0.25 AND ratio < 6 GROUP BY ALL", M)
def filters(spark, sf):
    """F2, F5 inclusive, F7, F8 strict."""
    rows = C.in_range(C.longer_than(C.below_error(C.valid_only(X.measurements(spark, sf)), 0.5, inclusive=True), 20), 0.25, 6, inclusive=False)
    return rows.groupBy("type", "grader").agg(F.count("*").alias("n"), F.round(F.sum("length_um"), 4).alias("total"))


@query("SELECT fiber_type, count(*) AS n FROM m WHERE fiber_type NOT IN ('other', 'one segment') AND type IN (SELECT type FROM m WHERE second_um > 49.99) GROUP BY 1", M)
def exclude_and_present(spark, sf):
    """F4, F9."""
    rows = X.measurements(spark, sf)
    return C.present_in(C.exclude_types(rows, ["other", "one segment"]), rows.filter("second_um > 49.99")).groupBy("fiber_type").agg(F.count("*").alias("n"))


@query("SELECT grader, count(*) AS n FROM b WHERE NOT (x < 50 OR y < 50 OR x + width > 950 OR y + height > 950) AND width > 0 AND height > 0 GROUP BY 1", B)
def border_filter(spark, sf):
    """F1, F6."""
    return C.inside_border(C.drop_invalid_boxes(X.boxes(spark, sf)), 50, 1000, 1000).groupBy("grader").agg(F.count("*").alias("n"))


@query("SELECT image, fiber_id, round(red * 0.26 + green * 0.26, 6) AS length_um, green / nullif(red, 0) AS ratio, printf('%.3f', red * 0.26) AS shown, TRUE AS ratio_as_shown, round(red / nullif(green, 0), 6) AS swapped, (x * 1.5)::INT - CASE WHEN (x * 1.5)::INT > x * 1.5 THEN 1 ELSE 0 END AS x15 FROM b", B)
def conversions(spark, sf):
    """P1, P2, P3, P5."""
    rows = C.measure(X.boxes(spark, sf), 0.26).withColumns({"x15": G.scale(F.col("bbox"), 1.5)["x"], "own": F.col("ratio")})
    swapped = C.swap(rows).withColumn("swapped", F.col("ratio"))
    shown = C.display(C.swap(swapped))  # swapped back before it is shown
    return shown.select("image", "fiber_id", _r("length_um"), F.col("own").alias("ratio"), F.col("first_um").alias("shown"), (F.abs(F.col("ratio").cast("double") - F.coalesce("own", F.lit(0.0))) <= 0.00051).alias("ratio_as_shown"), _r("swapped"), "x15")


@query(f"SELECT type, round(median((second_um - CASE WHEN grader = '{AI}' THEN 0.5 ELSE 0 END) / (first_um + CASE WHEN grader = '{AI}' THEN 0.5 ELSE 0 END)), 6) AS median FROM d GROUP BY 1", M)
def offset(spark, sf):
    """P4."""
    return medians(C.offset_transition(_clean(spark, sf), AI, 0.5, symmetric=True), "ratio", ["type"]).select("type", _r("median"))


@query(", w AS (SELECT image, fiber_id, width * height AS area, x + width // 2 AS cx, y + height // 2 AS cy, trunc(greatest(width, height) * 1.5)::BIGINT AS side FROM b), o AS (SELECT *, cx - side // 2 AS l, cy - side // 2 AS t FROM w) SELECT image, fiber_id, cx, cy, area, greatest(0, l) AS x0, greatest(0, t) AS y0, least(1000, l + side) AS x1, least(1000, t + side) AS y1, greatest(0, -l) AS \"left\", greatest(0, -t) AS top, greatest(0, l + side - 1000) AS \"right\", greatest(0, t + side - 1000) AS bottom FROM o", B)
def box_geometry(spark, sf):
    """Crops of half as much again, clipped to images of 1000 x 1000."""
    b = F.col("bbox")
    w = G.crop_window(b, F.lit(1000), F.lit(1000), 1.5)
    values = {"cx": G.centre(b)["x"], "cy": G.centre(b)["y"], "area": G.area(b)} | {k: w[k] for k in ("x0", "y0", "x1", "y1", "left", "top", "right", "bottom")}
    return X.boxes(spark, sf).select("image", "fiber_id", *(v.cast("long").alias(k) for k, v in values.items()))


@query("SELECT image, fiber_id, trunc(width * 1.25)::BIGINT AS width, trunc(height * 1.25)::BIGINT AS height, trunc(x - (trunc(width * 1.25) - width) / 2)::BIGINT AS x, trunc(y - (trunc(height * 1.25) - height) / 2)::BIGINT AS y, round((width - 45.5) / 14.5, 6) AS wide FROM b", B)
def box_expansion(spark, sf):
    """P6, P9."""
    e = G.expand(F.col("bbox"), 0.25)
    return X.boxes(spark, sf).select("image", "fiber_id", *(e[k].cast("long").alias(k) for k in ("width", "height", "x", "y")), _r(G.standardise(F.col("bbox.width"), 45.5, 14.5), "wide"))


@query("SELECT label, count(*) AS n FROM (SELECT CASE WHEN (y * 5 + x * 11) % 256 > 150 THEN 2 WHEN (y * 7 + x * 3) % 256 > 150 THEN 1 ELSE 0 END AS label FROM px) GROUP BY 1", PX)
def rgb_labels(spark, sf):
    """P8."""
    px = X.mask_pixels(spark, sf).select(G.label_from_rgb((F.col("y") * 7 + F.col("x") * 3) % 256, (F.col("y") * 5 + F.col("x") * 11) % 256).alias("label"))
    return px.groupBy("label").agg(F.count("*").alias("n"))


@query("SELECT image_name, array_to_string(list_slice(string_split(image_name, '-'), 1, -2), '-') AS condition, replace(replace(image_name, '_', ' '), '-', ' ') AS shown, split_part(image_name, '-0', 1) AS marked, CASE type WHEN 'SMALL' THEN 'little' ELSE type END AS renamed, upper(replace(type, 'A', '4')) AS replaced FROM (SELECT DISTINCT image_name, type FROM m)", M)
def condition_names(spark, sf):
    """S1, S2, S4, S5, S7."""
    n = F.col("image_name")
    rows = X.measurements(spark, sf).select("image_name", "type").distinct()
    return rows.select("image_name", N.condition_from_name(n).alias("condition"), N.default_rename(n).alias("shown"), N.condition_by_marker(n).alias("marked"), N.map_rename(F.col("type"), {"SMALL": "little"}).alias("renamed"), N.substring_rename(F.col("type"), [("A", "4")]).alias("replaced"))


@query("SELECT p_name, CASE WHEN p_name LIKE 'small %' THEN CASE WHEN substr(p_name, 7) LIKE 'ring%' THEN 'S_Ring' || substr(p_name, 11) WHEN substr(p_name, 7) LIKE 'b%' THEN 'S_B' || substr(p_name, 8) END END AS renamed FROM (SELECT DISTINCT p_name FROM part)")
def rule_names(spark, sf):
    """S6."""
    return X.table(spark, sf, "part").select("p_name").distinct().select("p_name", N.rule_rename(F.col("p_name"), {"small ": "S_"}, [("ring", "Ring"), ("b", "B")]).alias("renamed"))


@query("SELECT type, CASE WHEN type = 'STANDARD' THEN type ELSE chr(64 + k::INT) END AS label, count(*) AS n FROM m JOIN (SELECT type AS t, row_number() OVER (ORDER BY type) AS k FROM (SELECT DISTINCT type FROM m WHERE type <> 'STANDARD') UNION ALL SELECT 'STANDARD', 0) ON t = type GROUP BY ALL", M)
def anonymised(spark, sf):
    """S8."""
    return C.summary(N.anonymise(X.measurements(spark, sf), ["STANDARD"]), "length_um", ("type", "label")).select("type", "label", "n")


@query("SELECT user_id, round(CASE WHEN count(*) < 2 THEN count(*) FILTER (label = 1) ELSE 0.125 + coalesce(sum(CASE WHEN label = 1 THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END), 0) END, 6) AS red, round(CASE WHEN count(*) < 2 THEN count(*) FILTER (label = 2) ELSE 0.25 + coalesce(sum(CASE WHEN label = 2 THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END), 0) END, 6) AS green, 1 + sum((pl IS NOT NULL AND pl <> label)::INT)::BIGINT AS n_runs FROM s GROUP BY 1", T)
def colour_lengths(spark, sf):
    """R1 with an endpoint correction, R5."""
    p = F.col("points")
    return X.traces(spark, sf).select("user_id", _r(G.colour_length(p, 1, F.lit(0.125)), "red"), _r(G.colour_length(p, 2, F.lit(0.25)), "green"), F.size(G.runs(p)).cast("long").alias("n_runs"))


@query("SELECT user_id, (run - 1)::INT AS pos, any_value(label)::INT AS label, count(*)::INT AS n_points, round(sum(CASE WHEN pl = label THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END), 6) AS length_px FROM (SELECT *, sum((pl IS DISTINCT FROM label)::INT) OVER (PARTITION BY user_id ORDER BY x) AS run FROM s) GROUP BY user_id, run", T)
def trace_segments(spark, sf):
    """Every other trace runs backwards, which the orientation undoes."""
    rows = X.traces(spark, sf).select("user_id", F.when(F.col("user_id") % 2 == 1, F.reverse("points")).otherwise(F.col("points")).alias("points"))
    rows = rows.select("user_id", F.posexplode(G.oriented_segments(F.col("points"))).alias("pos", "s"))
    return rows.select("user_id", "pos", F.col("s.label").cast("int").alias("label"), F.size("s.points").alias("n_points"), _r("s.length_px", "length_px"))


@query("SELECT user_id, CASE WHEN r = 0 OR g = 0 THEN 'one segment' WHEN outside THEN 'error' WHEN n = 2 THEN 'two segments' WHEN n = 3 AND f = 1 THEN 'termination' WHEN n = 3 THEN 'origin' ELSE 'other' END AS fiber_type FROM (SELECT user_id, CASE WHEN count(*) < 2 THEN count(*) FILTER (label = 1) ELSE sum(CASE WHEN label = 1 THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END) END AS r, CASE WHEN count(*) < 2 THEN count(*) FILTER (label = 2) ELSE sum(CASE WHEN label = 2 THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END) END AS g, bool_or(y >= 49) AS outside, 1 + sum((pl IS NOT NULL AND pl <> label)::INT) AS n, min_by(label, x) AS f FROM s GROUP BY 1)", T)
def fiber_types(spark, sf):
    """R2, in rasters of 49 rows."""
    p = F.col("points")
    return X.traces(spark, sf).select("user_id", G.fiber_type(G.colour_length(p, 1), G.colour_length(p, 2), G.runs(p), F.exists(p, lambda q: q["y"] >= 49)).alias("fiber_type"))


@query("SELECT user_id, round(CASE WHEN c = 0 OR n < 2 THEN 0 ELSE n / c - 1 END, 6) AS tortuosity FROM (SELECT user_id, count(*) AS n, sqrt((max_by(x, x) - min_by(x, x)) ** 2 + (max_by(y, x) - min_by(y, x)) ** 2) AS c FROM t GROUP BY 1)", T)
def tortuosity(spark, sf):
    """R3."""
    return X.traces(spark, sf).select("user_id", _r(G.tortuosity(F.col("points")), "tortuosity"))


@query(", w AS (SELECT *, x - lag(x, 15) OVER w AS ux, y - lag(y, 15) OVER w AS uy, lead(x, 15) OVER w - x AS vx, lead(y, 15) OVER w - y AS vy FROM s WINDOW w AS (PARTITION BY user_id ORDER BY x)) SELECT user_id, round(CASE WHEN count(*) < 31 THEN 0 ELSE coalesce(sum(acos(greatest(-1, least(1, (ux * vx + uy * vy) / (sqrt(ux ** 2 + uy ** 2) * sqrt(vx ** 2 + vy ** 2)))))), 0) / sum(sqrt((x - px) ** 2 + (y - py) ** 2)) END, 5) AS curvature FROM w GROUP BY 1", T)
def curvature(spark, sf):
    """R4."""
    return X.traces(spark, sf).select("user_id", _r(G.curvature(F.col("points")), "curvature", 5))


def _pairs(spark, sf, threshold: float = 0.25, inclusive: bool = False) -> DataFrame:
    b = X.boxes(spark, sf)
    return J.box_pairs(b.filter("grader = 'F'"), b.filter("grader = 'O'"), threshold, inclusive)


def _sides(spark, sf) -> DataFrame:
    """Fibers of F (0) and O (1)."""
    return X.mask_fibers(spark, sf).filter("grader in ('F', 'O')").withColumn("of", (F.col("grader") == "O").cast("int"))


def _similar(spark, sf, everyone: bool = False) -> DataFrame:
    """Skeleton similarity of all pairs above 0: of F with O, or of any two fibers of an image."""
    px = X.mask_fibers(spark, sf)
    return J.near_skeletons(px) if everyone else J.near_skeletons(px.filter("grader in ('F', 'O')"), apart="grader")


@query("SELECT image, a, b, round(i / (s - i), 6) AS iou FROM pr", B)
def box_overlap_join(spark, sf):
    """J1, R8."""
    return _pairs(spark, sf).select("image", "a", "b", _r("iou"))


@query("SELECT 'missed' AS part, count(*) AS n FROM b WHERE grader = 'F' AND (image, fiber_id) NOT IN (SELECT (image, a) FROM pr) UNION ALL SELECT 'met', count(*) FROM b WHERE grader = 'F' AND (image, fiber_id) IN (SELECT (image, a) FROM pr)", B)
def difference_and_intersection(spark, sf):
    """J3, J4."""
    own, pairs = X.boxes(spark, sf).filter("grader = 'F'"), _pairs(spark, sf)
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return count(J.difference(own, pairs), "missed").unionByName(count(J.intersection(own, pairs), "met"))


@query("SELECT DISTINCT image, a AS fiber_id FROM pr WHERE i / (s - i) > 0.5", B)
def found_by_all(spark, sf):
    """J8."""
    return J.found_by_all(X.boxes(spark, sf), "F", ["O"], 0.5).select("image", "fiber_id")


@query("SELECT image, a, b, red_1, round(green_1, 6) AS green_1, round(green_1 / red_1, 6) AS ratio_1, red_2, round(green_2, 6) AS green_2, round(green_2 / red_2, 6) AS ratio_2 FROM pr WHERE i / (s - i) > 0.5", B)
def paired_lengths(spark, sf):
    """J13."""
    b = X.boxes(spark, sf)
    return J.paired_lengths(_pairs(spark, sf, 0.5), b.filter("grader = 'F'"), b.filter("grader = 'O'")).select("image", "a", "b", "red_1", _r("green_1"), _r("ratio_1"), "red_2", _r("green_2"), _r("ratio_2"))


#: All pairs of F and O with an intersection, and what a matching takes that goes through ordered pairs (k) one after the other.
_EVERY = ", e AS (SELECT image, a, b, i / (s - i) AS iou FROM (SELECT p.image, p.fiber_id AS a, q.fiber_id AS b, greatest(0, least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y)) AS i, p.width * p.height + q.width * q.height AS s FROM b p JOIN b q ON p.image = q.image AND p.grader = 'F' AND q.grader = 'O'))"
_TAKEN = ", w AS (SELECT image, 0::BIGINT AS k, []::BIGINT[] AS ua, []::BIGINT[] AS ub, NULL::BIGINT AS a, NULL::BIGINT AS b, NULL::DOUBLE AS iou FROM (SELECT DISTINCT image FROM od) UNION ALL SELECT w.image, od.k, CASE WHEN t THEN list_append(ua, od.a) ELSE ua END, CASE WHEN t THEN list_append(ub, od.b) ELSE ub END, CASE WHEN t THEN od.a END, od.b, od.iou FROM w JOIN od ON od.image = w.image AND od.k = w.k + 1 CROSS JOIN LATERAL (SELECT NOT list_contains(ua, od.a) AND NOT list_contains(ub, od.b) AS t)), g AS (SELECT image, a, b, iou FROM w WHERE a IS NOT NULL)"
_GREEDY = _EVERY + ", od AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY iou DESC, a, b) AS k FROM e WHERE iou >= 0.1)" + _TAKEN
_FIRST = _EVERY + ", od AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY a, b) AS k FROM e WHERE iou > 0.25)" + _TAKEN
_DETECTED = " SELECT n.image, coalesce(tp, 0) AS tp, n_pred - coalesce(tp, 0) AS fp, n, coalesce(tp / nullif(n_pred, 0), 0)::DOUBLE AS precision, coalesce(tp / nullif(n, 0), 0)::DOUBLE AS recall, coalesce(2 * tp / nullif(n_pred + n, 0), 0)::DOUBLE AS f1, round(coalesce(s / tp, 0), 9)::DOUBLE AS mean_iou FROM (SELECT image, count(*) FILTER (grader = 'F') AS n_pred, count(*) FILTER (grader = 'O') AS n FROM b GROUP BY 1) n LEFT JOIN (SELECT image, count(*) AS tp, sum(iou) AS s FROM g GROUP BY 1) USING (image)"


@query(_GREEDY + " SELECT * FROM g", f"RECURSIVE {B}")
def greedy_match(spark, sf):
    """J11."""
    return J.greedy_match(_pairs(spark, sf, 0.1, inclusive=True))


@query(_FIRST + " SELECT * FROM g", f"RECURSIVE {B}")
def first_come_match(spark, sf):
    """J12."""
    return J.first_come_match(_pairs(spark, sf))


@query()
def optimal_match(spark, sf):
    """By skeleton similarity."""
    return J.optimal_match(_similar(spark, sf).withColumnRenamed("similarity", "iou"), 0.5).withColumnRenamed("iou", "similarity")


@query(_GREEDY + _DETECTED, f"RECURSIVE {B}")
def detection(spark, sf):
    """A10: pairs matched greedily."""
    b = X.boxes(spark, sf)
    return J.detection_scores(b.filter("grader = 'F'"), b.filter("grader = 'O'"), J.greedy_match(_pairs(spark, sf, 0.1, inclusive=True)), per_image=True).withColumn("mean_iou", _r("mean_iou", digits=9))


@query(_FIRST + _DETECTED, f"RECURSIVE {B}")
def image_detection(spark, sf):
    """Pairs matched first come."""
    b = X.boxes(spark, sf)
    return J.detection_scores(b.filter("grader = 'F'"), b.filter("grader = 'O'"), J.first_come_match(_pairs(spark, sf)), per_image=True).withColumn("mean_iou", _r("mean_iou", digits=9))


def _own_pairs(spark, sf, threshold: float) -> DataFrame:
    """All pairs of an image's boxes, those of one grader included."""
    b = X.boxes(spark, sf)
    return J.box_pairs(b, b, threshold).filter("a < b")


#: Fibers of an image in the order of their graders and ids (k), each with those before it that it matches; it stays if none of these stays.
_UNION = ", f AS (SELECT *, row_number() OVER (PARTITION BY image ORDER BY grader, fiber_id) AS k FROM b), c AS (SELECT q.image, q.k, list(p.k) AS near FROM f p JOIN f q ON p.image = q.image AND p.k < q.k WHERE greatest(0, least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y)) / (p.width * p.height + q.width * q.height - greatest(0, least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y))) > 0.75 GROUP BY ALL), h AS (SELECT image, k, near, row_number() OVER (PARTITION BY image ORDER BY k) AS i FROM c), z AS (SELECT image, 0::BIGINT AS i, []::BIGINT[] AS gone, NULL::BIGINT AS k FROM (SELECT DISTINCT image FROM h) UNION ALL SELECT z.image, h.i, CASE WHEN t THEN list_append(gone, h.k) ELSE gone END, CASE WHEN t THEN h.k END FROM z JOIN h ON h.image = z.image AND h.i = z.i + 1 CROSS JOIN LATERAL (SELECT len(list_filter(near, lambda x: NOT list_contains(gone, x))) > 0 AS t)), u AS (SELECT f.* FROM f ANTI JOIN z USING (image, k))"


@query(_UNION + " SELECT image, grader, fiber_id FROM u", f"RECURSIVE {B}")
def ordered_union(spark, sf):
    """Over the fibers of all graders."""
    return J.ordered_union(X.boxes(spark, sf), _own_pairs(spark, sf, 0.75))


_FLAG = "EXISTS (FROM b q WHERE q.image = p.image AND q.grader = '{0}' AND greatest(0, least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y)) / (p.width * p.height + q.width * q.height - greatest(0, least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y))) > 0.75) AS found_{0}"


@query(f"SELECT image, grader, fiber_id, {_FLAG.format('F')}, {_FLAG.format('O')} FROM b p", B)
def found_by_grader(spark, sf):
    """J9 over all fibers, before any union."""
    b = X.boxes(spark, sf)
    return J.found_flags(b, b, ["F", "O"])


@query(_UNION + f" SELECT image, grader, fiber_id, {_FLAG.format('F')}, {_FLAG.format('O')} FROM u p", f"RECURSIVE {B}")
def union_found_flags(spark, sf):
    """J9."""
    b = X.boxes(spark, sf)
    kept = b.join(J.ordered_union(b, _own_pairs(spark, sf, 0.75)), ["image", "grader", "fiber_id"], "left_semi")
    return J.found_flags(kept, b, ["F", "O"])


_NEAR = "SELECT nr.image, a, b, count(DISTINCT ({0}.y, {0}.x)) AS h FROM nr JOIN px p ON p.image = nr.image AND p.fiber_id = a JOIN px q ON q.image = nr.image AND q.fiber_id = b AND (p.y - q.y) ** 2 + (p.x - q.x) ** 2 <= 25 GROUP BY ALL"
#: Any two fibers of an image whose pixels come near, their similarity, and clusters by all that a fiber reaches over links ({0}: which).
_CLUSTERS = f", nr AS (SELECT p.image, p.fiber_id AS a, q.fiber_id AS b FROM b p JOIN b q ON p.image = q.image AND p.fiber_id < q.fiber_id AND p.x - 5 < q.x + q.width AND q.x < p.x + p.width + 5 AND p.y - 5 < q.y + q.height AND q.y < p.y + p.height + 5), n AS (SELECT image, fiber_id, count(*) AS n FROM px GROUP BY ALL), sm AS (SELECT l.image, a, b, least(l.h / n1.n, r.h / n2.n) AS s FROM ({_NEAR.format('p')}) l JOIN ({_NEAR.format('q')}) r USING (image, a, b) JOIN n n1 ON n1.image = l.image AND n1.fiber_id = a JOIN n n2 ON n2.image = l.image AND n2.fiber_id = b), ln AS (SELECT sm.image, a, b FROM sm JOIN b p ON p.image = sm.image AND p.fiber_id = a JOIN b q ON q.image = sm.image AND q.fiber_id = b WHERE s > 0.5 AND (WHICH)), bo AS (FROM ln UNION ALL SELECT image, b, a FROM ln), re AS (SELECT image, fiber_id AS x, fiber_id AS y FROM b UNION SELECT re.image, x, bo.b FROM re JOIN bo ON bo.image = re.image AND bo.a = re.y), cl AS (SELECT image, x AS fiber_id, min(y) AS cluster FROM re GROUP BY ALL), mb AS (SELECT image, cluster, bool_or(grader = 'F') AS f, bool_or(grader = 'O') AS o FROM cl JOIN b USING (image, fiber_id) GROUP BY ALL)"


@query(_CLUSTERS.replace("WHICH", "TRUE") + ", t AS (SELECT count(*) AS total, count(*) FILTER (f AND o) AS found_by_all, count(*) FILTER (f) AS F_total, count(*) FILTER (f AND NOT o) AS F_unique, count(*) FILTER (o) AS O_total, count(*) FILTER (o AND NOT f) AS O_unique FROM mb) SELECT *, found_by_all / total AS found_by_all_share, F_total / total AS F_recall, O_total / total AS O_recall, (F_unique / F_total + O_unique / O_total) / 2 AS average_unique, (F_total / total + O_total / total) / 2 AS average_recall FROM t", f"RECURSIVE {PX}")
def annotator_agreement(spark, sf):
    """J6 (fibers of one grader link as well), J7, A8."""
    b = X.boxes(spark, sf)
    return J.agreement(J.membership(b, J.clusters(b, _similar(spark, sf, everyone=True).filter("similarity > 0.5")), ["F", "O"]), ["F", "O"])


@query(_CLUSTERS.replace("WHICH", "p.grader <> q.grader") + " SELECT f AS F, o AS O, count(*) AS n FROM mb GROUP BY ALL", f"RECURSIVE {PX}")
def cross_grader_clusters(spark, sf):
    """Links between graders only."""
    b = X.boxes(spark, sf)
    found = J.clusters(b, J.near_skeletons(X.mask_fibers(spark, sf).filter("grader is not null"), apart="grader").filter("similarity > 0.5"))
    return J.membership(b, found, ["F", "O"]).groupBy("F", "O").agg(F.count("*").alias("n"))


@query(f", nr AS (SELECT p.image, p.fiber_id AS a, q.fiber_id AS b FROM b p JOIN b q ON p.image = q.image AND p.grader = 'F' AND q.grader = 'O' AND p.x - 5 < q.x + q.width AND q.x < p.x + p.width + 5 AND p.y - 5 < q.y + q.height AND q.y < p.y + p.height + 5), n AS (SELECT image, fiber_id, count(*) AS n FROM px GROUP BY ALL), s AS (SELECT l.image, a, b, least(l.h / n1.n, r.h / n2.n) AS s FROM ({_NEAR.format('p')}) l JOIN ({_NEAR.format('q')}) r USING (image, a, b) JOIN n n1 ON n1.image = l.image AND n1.fiber_id = a JOIN n n2 ON n2.image = l.image AND n2.fiber_id = b) SELECT image, a, b, round(s, 6) AS similarity FROM s WHERE s > 0.5", PX)
def skeleton_match(spark, sf):
    """J2, R10."""
    return _similar(spark, sf).filter("similarity > 0.5").select("image", "a", "b", _r("similarity"))


@query(", q AS (SELECT type, grader, quantile_cont(ratio, 0.25) AS q1, quantile_cont(ratio, 0.5) AS q2, quantile_cont(ratio, 0.75) AS q3 FROM d GROUP BY ALL) SELECT type, grader, round(q1, 6) AS q1, round(q2, 6) AS q2, round(q3, 6) AS q3, round(min(ratio), 6) AS low, round(max(ratio), 6) AS high FROM d JOIN q USING (type, grader) WHERE ratio BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) GROUP BY type, grader, q1, q2, q3", M)
def box_quartiles(spark, sf):
    """A2."""
    return C.box_statistics(_clean(spark, sf)).select("type", "grader", *map(_r, ("q1", "q2", "q3", "low", "high")))


@query(f"SELECT type, round(median(ratio) FILTER (grader = '{HUMAN}') - median(ratio) FILTER (grader = '{AI}'), 6) AS difference FROM d GROUP BY 1", M)
def median_difference(spark, sf):
    """A3, J16."""
    return C.median_difference(_clean(spark, sf), AI, HUMAN).select("type", _r("difference"))


@query("SELECT fiber_type, n_old, n_new, round((n_new - n_old) * 100.0 / n_old, 6) AS percent FROM (SELECT fiber_type, count(*) AS n_old, count(*) FILTER (error_probability < 0.5) AS n_new FROM m GROUP BY 1)", M)
def count_change(spark, sf):
    """A5."""
    rows = X.measurements(spark, sf)
    return C.count_change(rows, C.below_error(rows)).select("fiber_type", "n_old", "n_new", _r("percent"))


@query("SELECT model, round(median_low, 6) AS median_low, n_low, n_high, round(abs(median_high - median_low) / median_low * 100, 6) AS median_change, round((n_low - n_high) * 100.0 / n_low, 6) AS count_drop FROM (SELECT grader AS model, min_by(md, sigma) AS median_low, max_by(md, sigma) AS median_high, min_by(n, sigma) AS n_low, max_by(n, sigma) AS n_high FROM (SELECT grader, round(error_probability) AS sigma, median(ratio) AS md, count(*) AS n FROM m WHERE ratio IS NOT NULL GROUP BY ALL) GROUP BY 1)", M)
def robustness(spark, sf):
    """A6."""
    rows = X.measurements(spark, sf).filter("ratio is not null").select(F.col("grader").alias("model"), F.round("error_probability").alias("sigma"), "ratio")
    return C.robustness(rows).select("model", _r("median_low"), "n_low", "n_high", _r("median_change"), _r("count_drop"))


@query("SELECT grader, count(*) AS n, round(avg(ratio), 6) AS mean, round(median(ratio), 6) AS median, round(stddev_samp(ratio), 6) AS sd, round(exp(avg(ln(ratio))), 6) AS geometric_mean FROM d GROUP BY 1", M)
def describe(spark, sf):
    """A7."""
    return C.describe(_clean(spark, sf), "ratio", "grader").select("grader", "n", *map(_r, ("mean", "median", "sd", "geometric_mean")))


@query("SELECT type, image_name, fiber_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY length_um DESC, image_name, fiber_id) AS rank FROM m) WHERE rank <= 50", M)
def longest(spark, sf):
    """W1."""
    return C.longest(X.measurements(spark, sf), 50).select("type", "image_name", "fiber_id", "rank")


@query(f"SELECT type, grader, image_name, fiber_id FROM (SELECT d.*, row_number() OVER (PARTITION BY type, grader ORDER BY abs(ratio - md), image_name, fiber_id) AS k FROM d JOIN (SELECT type, grader, median(ratio) AS md FROM d GROUP BY ALL) USING (type, grader)) WHERE k <= 30 OR grader = '{HUMAN}'", M)
def closest_to_median(spark, sf):
    """W2."""
    return C.closest(_clean(spark, sf), 30).select("type", "grader", "image_name", "fiber_id")


@query("SELECT type, grader, count(*) AS n, round(max(abs(length_um - md)), 6) AS far FROM (SELECT d.*, md, row_number() OVER (PARTITION BY type, grader ORDER BY abs(length_um - md), image_name, fiber_id) AS k FROM d JOIN (SELECT type, grader, median(length_um) AS md FROM d GROUP BY ALL) USING (type, grader)) WHERE k <= 100 GROUP BY ALL", M)
def capped_groups(spark, sf):
    """W3."""
    rows = _clean(spark, sf)
    centres = medians(rows, "length_um", ["type", "grader"], "md")
    return C.cap_groups(rows, 100).join(centres, ["type", "grader"]).groupBy("type", "grader").agg(F.count("*").alias("n"), _r(F.max(F.abs(F.col("length_um") - F.col("md"))), "far"))


@query("SELECT image_name, fiber_id FROM d, (SELECT median(length_um) AS md FROM d) ORDER BY abs(length_um - md), image_name, fiber_id LIMIT 100", M)
def nearest_to_median(spark, sf):
    """W4."""
    return C.nearest_to_median(_clean(spark, sf), 100).select("image_name", "fiber_id")


@query("SELECT type, image_name, fiber_id, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY image_name, fiber_id) AS rank FROM m) WHERE rank <= 50", M)
def first_fifty(spark, sf):
    """W5."""
    return C.first_k(X.measurements(spark, sf), 50).select("type", "image_name", "fiber_id", "rank")


@query(f", h AS (SELECT type, median(ratio) FILTER (grader = '{HUMAN}') AS h, median(ratio) FILTER (grader = '{AI}') AS a FROM d GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY h, type) AS k, count(*) OVER () AS n, max(a) OVER (ORDER BY h, type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e, min(a) OVER () AS lo, max(a) OVER () AS hi FROM h) SELECT type, k::INT AS type_order, CASE WHEN k = 1 THEN abs(a - lo) <= 0.01 WHEN k = n THEN abs(a - hi) <= 0.01 ELSE a >= e END AS concordant FROM k", M)
def order_concordance(spark, sf):
    """W8."""
    return C.order_concordance(C.by_grader(_clean(spark, sf), [HUMAN, AI]), HUMAN, AI)


@query(", o AS (SELECT median(length_um) AS md, row_number() OVER (ORDER BY median(length_um), type) AS k FROM d GROUP BY type) SELECT round(regr_slope(md, k), 6) AS slope, round(regr_intercept(md, k), 6) AS intercept, round(corr(md, k), 6) AS r FROM o", M)
def trend_of_medians(spark, sf):
    """W6, W9."""
    return C.trend(C.order_types(_clean(spark, sf))).select(*map(_r, ("slope", "intercept", "r")))


@query("SELECT image, x_um, round(x_um - coalesce(sum(e) OVER (PARTITION BY image ORDER BY x_um RANGE UNBOUNDED PRECEDING), 0), 6) AS shifted FROM (SELECT image, x_um, CASE WHEN x_um - lag(x_um) OVER (PARTITION BY image ORDER BY x_um, c_custkey) > 60 THEN x_um - lag(x_um) OVER (PARTITION BY image ORDER BY x_um, c_custkey) - 40 ELSE 0 END AS e FROM (SELECT c_nationkey AS image, (c_custkey * 13 % 5000)::DOUBLE AS x_um, c_custkey FROM customer))")
def collapsed_gaps(spark, sf):
    """W11."""
    tiles = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("image"), (F.col("c_custkey") * 13 % 5000).cast("double").alias("x_um"))
    return C.collapse_gaps(tiles, "x_um", "image", 40, 1.5).select("image", "x_um", _r("shifted"))


@query("SELECT image, c_custkey, (i // c)::INT AS row, (i % c)::INT AS col FROM (SELECT c_nationkey AS image, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i, ceil(sqrt(count(*) OVER (PARTITION BY c_nationkey)))::INT AS c FROM customer)")
def compact_grid(spark, sf):
    """W12."""
    tiles = X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("image"), "c_custkey")
    return C.compact_grid(tiles, "image", ["c_custkey"]).select("image", "c_custkey", "row", "col")


@query("SELECT a.type AS a, b.type AS b FROM (SELECT DISTINCT type FROM m) a JOIN (SELECT DISTINCT type FROM m) b ON a.type <> b.type JOIN (SELECT type, row_number() OVER (ORDER BY median(length_um), type) AS k FROM m GROUP BY 1) i ON i.type = a.type JOIN (SELECT type, row_number() OVER (ORDER BY median(length_um), type) AS k FROM m GROUP BY 1) j ON j.type = b.type WHERE j.k - i.k IN (1, 2)", M)
def comparison_pairs(spark, sf):
    """W14."""
    return C.test_pairs(C.order_types(X.measurements(spark, sf)), "near").select("a", "b")


@query("SELECT DISTINCT ON (key) key, doc_id, coalesce(q, 1)::INT AS is_error FROM (SELECT (doc_id // 3)::VARCHAR || '.png' AS key, doc_id, first_value(CASE WHEN l.quality = 0 THEN 1 WHEN l.quality = 1 THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id // 3 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS q0, coalesce(first_value(CASE WHEN l.quality = 0 THEN 1 WHEN l.quality = 1 THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id // 3 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS q FROM documents d LEFT JOIN labels l USING (doc_id)) ORDER BY key, doc_id")
def duplicate_labels(spark, sf):
    """W10, J15."""
    docs, labels = X.table(spark, sf, "documents").select("doc_id"), X.table(spark, sf, "labels").select("doc_id", "quality")
    rows = docs.join(labels, "doc_id", "left").select("doc_id", F.concat(F.floor(F.col("doc_id") / 3).cast("string"), F.lit(" ("), (F.col("doc_id") % 3).cast("string"), F.lit(").png.png")).alias("filename"), F.when(F.col("quality") == 0, "Bad").when(F.col("quality") == 1, "Good").alias("label"))
    return C.resolve_duplicates(rows, "filename", "label", "doc_id")


@query(", ref AS (SELECT grader, ratio AS v FROM d WHERE type = 'STANDARD'), k AS (SELECT grader, type, ratio AS v FROM d WHERE type <> 'STANDARD'), c AS (SELECT k.grader, k.type, count(*) AS n2, sum(CASE WHEN TRUE THEN (SELECT count(*) FROM ref r WHERE r.grader = k.grader AND r.v > k.v) + 0.5 * (SELECT count(*) FROM ref r WHERE r.grader = k.grader AND r.v = k.v) END) AS u FROM k GROUP BY ALL) SELECT c.grader, type, n1, n2, round(u, 4)::DOUBLE AS u, round(1 - 2 * u / (n1 * n2), 6)::DOUBLE AS effect, round(2 * u / (n1 * n2) - 1, 6)::DOUBLE AS delta FROM c JOIN (SELECT grader, count(*) AS n1 FROM ref GROUP BY 1) r USING (grader)", M)
def rank_tests(spark, sf):
    """T1, T2."""
    return S.rank_test(_clean(spark, sf), BASELINE).select("grader", "type", "n1", "n2", _r("u", digits=4), _r("effect"), _r("delta"))


@query()
def rank_test_p(spark, sf):
    """T1 with p, W13, T4."""
    rows = S.rank_test_p(_clean(spark, sf), BASELINE).withColumn("key", F.concat_ws("/", "grader", "type"))
    return C.adjust_p(rows, "p", "key").withColumn("symbol", S.symbols(F.col("p_holm"))).select("grader", "type", "u", "p", "p_bh", "p_holm", "symbol")


@query()
def bootstrap_intervals(spark, sf):
    """T3."""
    return S.bootstrap_delta(_clean(spark, sf), BASELINE)


_MOMENTS = f", g AS (SELECT type, count(*) FILTER (grader = '{AI}') AS n1, count(*) FILTER (grader = '{HUMAN}') AS n2, avg(VAL) FILTER (grader = '{AI}') AS m1, avg(VAL) FILTER (grader = '{HUMAN}') AS m2, var_samp(VAL) FILTER (grader = '{AI}') AS v1, var_samp(VAL) FILTER (grader = '{HUMAN}') AS v2 FROM d GROUP BY 1)"


@query(_MOMENTS.replace("VAL", "ratio") + " SELECT type, n1, n2, round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 5) AS t, round((v1 / n1 + v2 / n2) ** 2 / ((v1 / n1) ** 2 / (n1 - 1) + (v2 / n2) ** 2 / (n2 - 1)), 4) AS df, round((n1 * (m1 - (n1 * m1 + n2 * m2) / (n1 + n2)) ** 2 + n2 * (m2 - (n1 * m1 + n2 * m2) / (n1 + n2)) ** 2) / (((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 5) AS f FROM g", M)
def welch_and_anova(spark, sf):
    """T5."""
    return S.welch_and_anova(_clean(spark, sf), AI, HUMAN).select("type", "n1", "n2", _r("t", digits=5), _r("df", digits=4), _r("f", digits=5))


@query(_MOMENTS.replace("VAL", "ln(ratio)") + " SELECT type, round(exp(m1 - m2), 6) AS gmr, round((m1 - m2 + ln(1.1)) / sqrt(v1 / n1 + v2 / n2), 5) AS t_low, round((m1 - m2 - ln(1.1)) / sqrt(v1 / n1 + v2 / n2), 5) AS t_high, round((SELECT var_samp(ratio) FILTER (grader = '" + AI + "') / var_samp(ratio) FILTER (grader = '" + HUMAN + "') FROM d WHERE d.type = g.type), 6) AS variance_ratio FROM g", M)
def equivalence_parts(spark, sf):
    """T7, T8."""
    return S.equivalence_parts(_clean(spark, sf), AI, HUMAN).select("type", _r("gmr"), _r("t_low", digits=5), _r("t_high", digits=5), _r("variance_ratio"))


@query(f", e AS (SELECT type, l, sum(x) AS x, sum(y) AS y FROM (SELECT type, ln(ratio) AS l, (grader = '{AI}')::INT AS x, (grader = '{HUMAN}')::INT AS y FROM d) GROUP BY ALL), c AS (SELECT type, abs(sum(x) OVER w / sum(x) OVER (PARTITION BY type) - sum(y) OVER w / sum(y) OVER (PARTITION BY type)) AS gap, lead(l) OVER w - l AS step FROM e WINDOW w AS (PARTITION BY type ORDER BY l)) SELECT type, round(max(gap), 6) AS ks, round(sum(gap * step), 6) AS wasserstein FROM c GROUP BY 1", M)
def distances(spark, sf):
    """T9, T10."""
    return S.distances(_clean(spark, sf), AI, HUMAN).select("type", _r("ks"), _r("wasserstein"))


@query()
def equivalence_report(spark, sf):
    """T11."""
    return S.equivalence(_clean(spark, sf), AI, HUMAN)


_MEANS = f", g AS (SELECT type, avg(ln(ratio)) FILTER (grader = '{AI}') AS a, avg(ln(ratio)) FILTER (grader = '{HUMAN}') AS b FROM d GROUP BY 1), rk AS (SELECT *, rank() OVER (ORDER BY a) AS ra, rank() OVER (ORDER BY b) AS rb FROM g)"


@query(_MEANS + " SELECT count(*) AS n, round(corr(a, b), 5) AS pearson, round(corr(ra, rb), 5) AS spearman, round(regr_slope(b, a), 5) AS slope, round(regr_intercept(b, a), 5) AS intercept, (SELECT round(avg(sign(p.a - q.a) * sign(p.b - q.b)), 5) FROM g p JOIN g q ON p.type < q.type) AS kendall FROM rk", M)
def trend_agreement(spark, sf):
    """T12, T13, A19."""
    return S.agreement(S.cluster_means(_clean(spark, sf), AI, HUMAN)).select("n", *(_r(c, digits=5) for c in ("pearson", "spearman", "slope", "intercept", "kendall")))


@query(_MEANS + f", lam AS (SELECT avg(v) FILTER (grader = '{HUMAN}') / avg(v) FILTER (grader = '{AI}') AS l FROM (SELECT type, grader, var_samp(ln(ratio)) AS v FROM d GROUP BY ALL)), s AS (SELECT avg(a) AS ma, avg(b) AS mb, var_samp(a) AS vx, var_samp(b) AS vy, covar_samp(a, b) AS c, any_value(l) AS l FROM g, lam) SELECT round(l, 5) AS lambda, round((vy - l * vx + sqrt((vy - l * vx) ** 2 + 4 * l * c * c)) / (2 * c), 4) AS slope, round(mb - (vy - l * vx + sqrt((vy - l * vx) ** 2 + 4 * l * c * c)) / (2 * c) * ma, 4) AS intercept FROM s", M)
def deming(spark, sf):
    """T14."""
    rows = _clean(spark, sf)
    return S.deming(S.cluster_means(rows, AI, HUMAN), S.error_ratio(rows, AI, HUMAN)).select(_r("lambda", digits=5), _r("slope", digits=4), _r("intercept", digits=4))


@query()
def regression_intervals(spark, sf):
    """T13, T16."""
    out = S.regression_intervals(S.cluster_means(_clean(spark, sf), AI, HUMAN))
    return out.withColumn("equivalent", S.within(F.col("slope_low"), F.col("slope_high"), (0.9, 1.1)))


@query()
def interaction(spark, sf):
    """T15."""
    return S.interaction(_clean(spark, sf).withColumn("log_ratio", F.ln("ratio")), "log_ratio")


def _overlapping(spark, sf) -> DataFrame:
    key = F.col("o_orderkey") % 3
    rows = X.table(spark, sf, "orders").select("o_orderkey", F.when(key < 2, F.col("o_totalprice")).alias("x"), F.when(key > 0, F.col("o_totalprice") * 0.9 + F.col("o_custkey")).alias("y"))
    return S.partially_overlapping_t(rows, "o_orderkey")


@query()
def partially_overlapping(spark, sf):
    """T6."""
    return _overlapping(spark, sf)


@query("""WITH t AS (SELECT CASE WHEN o_orderkey % 3 < 2 THEN o_totalprice END AS x, CASE WHEN o_orderkey % 3 > 0 THEN o_totalprice * 0.9 + o_custkey END AS y FROM orders),
s AS (SELECT count(x) AS n1, count(y) AS n2, count(*) FILTER (x IS NOT NULL AND y IS NOT NULL) AS n12, avg(x) AS m1, avg(y) AS m2, var_samp(x) AS v1, var_samp(y) AS v2, corr(x, y) AS r FROM t)
SELECT round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)) / sqrt(1 / n1 + 1 / n2 - 2 * r * n12 / (n1 * n2)), 5) AS statistic,
  round(n12 - 1 + (n1 + n2 - n12 - 1) / (n1 + n2) * (n1 + n2 - 2 * n12), 4) AS df, round(m1 - m2, 4) AS estimate FROM s""")
def partially_overlapping_parts(spark, sf):
    """T6 without p and interval."""
    return _overlapping(spark, sf).select(_r("statistic", digits=5), _r("df", digits=4), _r("estimate", digits=4))


_SCORED = "z AS (SELECT toxic AS y, (n_chars % 101) / 100 AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, sf):
    return X.table(spark, sf, "labels").join(X.table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id").select(F.col("toxic").alias("y"), (F.col("n_chars") % 101 / 100).alias("score"))


@query(", c AS (SELECT count(*) FILTER (y = 1 AND score >= 0.5) AS tp, count(*) FILTER (y <> 1 AND score >= 0.5) AS fp, count(*) FILTER (y = 1 AND score < 0.5) AS fn, count(*) FILTER (y <> 1 AND score < 0.5) AS tn, count(*) AS n FROM z) SELECT round((tp + tn) / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(((tp + tn) / n - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / (n * n)), 6) AS kappa FROM c", _SCORED)
def binary_scores(spark, sf):
    """A17."""
    return S.binary_scores(_scored(spark, sf)).select(*map(_r, ("accuracy", "precision", "recall", "specificity", "f1", "kappa")))


@query(", q AS (SELECT score, sum((y = 1)::INT) AS p, sum((y <> 1)::INT) AS n FROM z GROUP BY 1), r AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp FROM q) SELECT round(sum(n * (tp - p / 2)) / (sum(p) * sum(n)), 6)::DOUBLE AS auroc, round(sum(p * tp / (tp + fp)) / sum(p), 6)::DOUBLE AS average_precision FROM r", _SCORED)
def ranking_scores(spark, sf):
    """A18."""
    return S.ranking_scores(_scored(spark, sf)).select(_r("auroc"), _r("average_precision"))


@query("SELECT image, grader, fiber_id, min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1, count(*) AS area FROM px GROUP BY ALL", PX)
def component_boxes(spark, sf):
    """R11."""
    px = X.mask_pixels(spark, sf)
    return P.component_boxes(px.select(F.struct("image", "grader").alias("image"), F.col("fiber_id").alias("label"), "y", "x")).select("image.image", "image.grader", F.col("label").alias("fiber_id"), *(F.col(c).cast("long").alias(c) for c in ("x0", "y0", "x1", "y1")), "area")


@query(", f AS (SELECT image, y, x, fiber_id FROM px WHERE grader = 'F'), o AS (SELECT image, y, x, fiber_id FROM px WHERE grader = 'O'), h AS (SELECT f.image, f.fiber_id AS a, o.fiber_id AS b, count(*) AS shared FROM f JOIN o USING (image, y, x) GROUP BY ALL), na AS (SELECT image, fiber_id, count(*) AS n FROM px GROUP BY ALL) SELECT h.image, a, b, shared, round(shared / (p.n + q.n - shared), 6) AS iou FROM h JOIN na p ON p.image = h.image AND p.fiber_id = a JOIN na q ON q.image = h.image AND q.fiber_id = b", PX)
def overlap_matrix(spark, sf):
    """A9."""
    return P.overlap_matrix(_sides(spark, sf).withColumnRenamed("label", "colour").withColumnRenamed("fiber_id", "label")).select("image", "a", "b", "shared", _r("iou"))


_SHOWN = ", k AS (SELECT image, a, b FROM pr WHERE i / (s - i) > 0.5), f AS (SELECT image, y, x, max_by(label, fiber_id) AS p FROM px WHERE grader = 'F' GROUP BY ALL), o AS (SELECT image, y, x, max_by(label, fiber_id) AS t FROM px WHERE grader = 'O' GROUP BY ALL), u AS (SELECT k.*, y, x FROM k JOIN px ON px.image = k.image AND fiber_id IN (a, b) GROUP BY ALL), j AS (SELECT u.image, a, b, p, t FROM u JOIN o USING (image, y, x) LEFT JOIN f USING (image, y, x)), c AS (SELECT image, a, b, " + ", ".join(f"count(*) FILTER (p = {k} AND t = {k}) AS h{k}, count(*) FILTER (p = {k}) AS p{k}, count(*) FILTER (t = {k}) AS t{k}" for k in (1, 2)) + " FROM j GROUP BY ALL)"


@query(_SHOWN + " SELECT image, a, b, " + ", ".join(f"round(coalesce(2 * (h{k} / nullif(p{k} + t{k} - h{k}, 0)) / (1 + h{k} / nullif(p{k} + t{k} - h{k}, 0)), 0), 6) AS {n}_dice, round(coalesce(h{k} / nullif(t{k}, 0), 0), 6) AS {n}_recall, round(coalesce(h{k} / nullif(p{k}, 0), 0), 6) AS {n}_precision" for k, n in ((1, "red"), (2, "green"))) + " FROM c", PX)
def colour_scores(spark, sf):
    """A11, for pairs of boxes of an IoU above 0.5."""
    out = P.colour_scores(_sides(spark, sf), None, _pairs(spark, sf, 0.5))
    return out.select("image", "a", "b", *(_r(c) for c in out.columns[3:]))


_MEANS_OF = ", ".join(f"round(coalesce(sum(coalesce({v}, 0)) / (SELECT count(*) FROM g), 0), 9)::DOUBLE AS {n}_{c}" for k, n in ((1, "red"), (2, "green")) for c, v in (("dice", f"2 * (h{k} / nullif(p{k} + t{k} - h{k}, 0)) / (1 + h{k} / nullif(p{k} + t{k} - h{k}, 0))"), ("recall", f"h{k} / nullif(t{k}, 0)"), ("precision", f"h{k} / nullif(p{k}, 0)")))


@query(_GREEDY + _SHOWN.replace("SELECT image, a, b FROM pr WHERE i / (s - i) > 0.5", "SELECT image, a, b FROM g") + f" SELECT (SELECT count(*) FROM g) AS tp, {_MEANS_OF} FROM c", f"RECURSIVE {PX}")
def mean_colour_scores(spark, sf):
    """The means over greedily matched pairs."""
    pairs = cut(J.greedy_match(_pairs(spark, sf, 0.1, inclusive=True)))
    out = P.mean_colour_scores(P.colour_scores(_sides(spark, sf), None, pairs), pairs)
    return out.select("tp", *(_r(c, digits=9) for c in out.columns[1:]))


@query("SELECT *, n > 0.5 * 64 * 64 AS keep, n > 0.5 * 64 * 64 AND (ty + 1) * 64 <= 1000 AND (tx + 1) * 64 <= 1000 AS keep_whole FROM (SELECT image, y // 64 AS ty, x // 64 AS tx, count(DISTINCT (y, x)) AS n FROM px GROUP BY ALL)", PX)
def tile_share(spark, sf):
    """A13, in images of 1000 x 1000."""
    return P.tile_share(X.mask_pixels(spark, sf), 64, 1000, 1000)


_RING = ", u AS (SELECT DISTINCT image, y, x FROM px), k AS (SELECT u.image, u.y, u.x, count(v.y) AS n FROM u LEFT JOIN u v ON v.image = u.image AND v.y BETWEEN u.y - 1 AND u.y + 1 AND v.x BETWEEN u.x - 1 AND u.x + 1 AND (v.y <> u.y OR v.x <> u.x) GROUP BY ALL)"


@query(_RING.replace("LEFT JOIN u v ON v.image = u.image AND v.y BETWEEN u.y - 1 AND u.y + 1 AND v.x BETWEEN u.x - 1 AND u.x + 1 AND (v.y <> u.y OR v.x <> u.x)", "CROSS JOIN (SELECT unnest([-1, -1, -1, 0, 0, 1, 1, 1]) AS dy, unnest([-1, 0, 1, -1, 1, -1, 0, 1]) AS dx) LEFT JOIN u v ON v.image = u.image AND v.y = u.y + dy AND v.x = u.x + dx") + " SELECT image, count(*) FILTER (n <= 1) AS n_ends FROM k GROUP BY 1 HAVING count(*) FILTER (n <= 1) > 0", PX)
def skeleton_ends(spark, sf):
    """R12."""
    return P.endpoints(P.neighbour_ring(X.mask_fibers(spark, sf).select("image", "y", "x"))).groupBy("image").agg(F.count("*").alias("n_ends"))


@query(", u AS (SELECT DISTINCT image, y, x FROM px), r AS (SELECT u.image, u.y, u.x, k FROM (SELECT image, y - dy AS y, x - dx AS x, k FROM u CROSS JOIN (SELECT unnest([0, 1, 2, 3, 4, 5, 6, 7]) AS k, unnest([-1, -1, -1, 0, 1, 1, 1, 0]) AS dy, unnest([-1, 0, 1, 1, 1, 0, -1, -1]) AS dx)) u), l AS (SELECT image, y, x, bit_or(1 << k) AS ring FROM r GROUP BY ALL HAVING count(*) > 2), t AS (SELECT DISTINCT (1 << a) | (1 << b) | (1 << c) AS three FROM range(8) a(a), range(8) b(b), range(8) c(c) WHERE b - a > 1 AND c - b > 1 AND c - a < 7) SELECT image, y, x FROM l SEMI JOIN u USING (image, y, x) WHERE EXISTS (FROM t WHERE ring & three = three)", PX)
def skeleton_junctions(spark, sf):
    """R13."""
    return P.junctions(P.neighbour_ring(X.mask_fibers(spark, sf).select("image", "y", "x"))).select("image", "y", "x")


@query()
def mask_components(spark, sf):
    """R14, R11."""
    return P.boxes_of_components(X.mask_fibers(spark, sf))


@query()
def ordered_traces(spark, sf):
    """R15."""
    return P.trace(X.mask_fibers(spark, sf))


@query("SELECT image, y, x, max_by(label, fiber_id) AS label FROM px WHERE y BETWEEN 0 AND 999 AND x BETWEEN 0 AND 999 GROUP BY ALL", PX)
def painted_mask(spark, sf):
    """R16."""
    return P.paint(X.mask_pixels(spark, sf), 1000, 1000).withColumns({c: F.col(c).cast("long") for c in ("y", "x")})


@query("SELECT image, round(avg(red_mean), 4) AS red_mean, round(avg(green_mean), 4) AS green_mean FROM (SELECT image, fiber_id, avg(CASE WHEN label = 1 THEN (y * 7 + x * 3) % 256 END) AS red_mean, avg(CASE WHEN label = 2 THEN (y * 5 + x * 11) % 256 END) AS green_mean FROM px GROUP BY ALL) GROUP BY 1", PX)
def mean_intensity(spark, sf):
    """R7."""
    px = X.mask_pixels(spark, sf)
    values = px.select("image", "y", "x").distinct().withColumns({"red": (F.col("y") * 7 + F.col("x") * 3) % 256, "green": (F.col("y") * 5 + F.col("x") * 11) % 256})
    return P.mean_intensity(px, values).groupBy("image").agg(_r(F.avg("red_mean"), "red_mean", 4), _r(F.avg("green_mean"), "green_mean", 4))


_PROBS = ", u AS (SELECT DISTINCT image, y, x FROM px), pb AS (SELECT image, y, x, ((y * 31 + x * 17 + k * 7) % 101) / 101 AS p0, ((y * 13 + x * 29 + k * 11) % 101) / 101 AS p1, ((y * 7 + x * 3 + k * 5) % 101) / 101 AS p2 FROM u, range(3) r(k))"


@query(_PROBS + ", a AS (SELECT image, y, x, sum((p0 * 101)::BIGINT) AS p0, sum((p1 * 101)::BIGINT) AS p1, sum((p2 * 101)::BIGINT) AS p2 FROM pb GROUP BY ALL) SELECT image, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS label, count(*) AS n FROM a GROUP BY ALL", PX)
def ensemble_vote(spark, sf):
    """A15."""
    px = X.mask_pixels(spark, sf).select("image", "y", "x").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = lambda a, b, c: ((F.col("y") * a + F.col("x") * b + F.col("k") * c) % 101).cast("double")
    return P.vote(px.select("image", "y", "x", p(31, 17, 7).alias("p0"), p(13, 29, 11).alias("p1"), p(7, 3, 5).alias("p2"))).groupBy("image", "label").agg(F.count("*").alias("n"))


@query(", o AS (SELECT DISTINCT image, y, x, ty, tx FROM (SELECT image, y, x, unnest([y // 48, y // 48 - 1]) AS ky, kx FROM (SELECT image, y, x, unnest([x // 48, x // 48 - 1]) AS kx FROM px)) CROSS JOIN LATERAL (SELECT ky * 48 AS ty, kx * 48 AS tx) WHERE ky >= 0 AND kx >= 0 AND y - ty < 64 AND x - tx < 64), w AS (SELECT image, y, x, (ty + 2 * tx) % 97 AS v, 1 - least(1, sqrt((2 * (y - ty) / 63 - 1) ** 2 + (2 * (x - tx) / 63 - 1) ** 2)) + 0.001 AS w FROM o) SELECT image, y AS gy, x AS gx, round(sum(v * w) / sum(w), 5) AS value FROM w GROUP BY ALL", PX)
def blended_tiles(spark, sf):
    """Tiles of 64 pixels every 48, each with values of its own."""
    px = X.mask_pixels(spark, sf).select("image", "y", "x").distinct()
    near = lambda c: F.explode(F.array(F.floor(F.col(c) / 48), F.floor(F.col(c) / 48) - 1))
    px = px.withColumn("ty", near("y")).withColumn("tx", near("x")).withColumns({c: F.col(c) * 48 for c in ("ty", "tx")}).filter("ty >= 0 and tx >= 0 and y - ty < 64 and x - tx < 64")
    tiles = px.select("image", "ty", "tx", (F.col("y") - F.col("ty")).alias("y"), (F.col("x") - F.col("tx")).alias("x"), ((F.col("ty") + 2 * F.col("tx")) % 97).alias("value"))
    return P.blend(tiles, 64).select("image", "gy", "gx", _r("value", digits=5))


@query("SELECT image, channel, fiber_id, CASE WHEN hi = lo OR p = lo THEN 0 ELSE trunc(greatest(0, least(255, 255 * ((v - lo) / (hi - lo)) / ((p - lo) / (hi - lo)))))::INT END AS scaled FROM (SELECT l_suppkey AS image, l_linestatus AS channel, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS fiber_id, l_quantity AS v, min(l_quantity) OVER w AS lo, max(l_quantity) OVER w AS hi, quantile_cont(l_quantity, 0.99) OVER w AS p FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_linestatus))")
def normalised_channels(spark, sf):
    """A14."""
    li = X.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image"), F.col("l_linestatus").alias("channel"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("fiber_id"), F.col("l_quantity").alias("value"))
    return P.normalise_channels(li).select("image", "channel", "fiber_id", "scaled")


@query("SELECT o_orderpriority AS type, count(*) AS n, round(sum(s / f), 4) AS total FROM (SELECT o_orderpriority, k // 2 AS pair, max(v) FILTER (k % 2 = 1) AS f, max(v) FILTER (k % 2 = 0) AS s FROM (SELECT o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) - 1 AS k, o_totalprice / 10000 AS v FROM orders) GROUP BY ALL) WHERE f IS NOT NULL AND s IS NOT NULL GROUP BY 1")
def human_sheets(spark, sf):
    """IO2."""
    from pyspark.sql import Window

    rows = X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sheet"), (F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey")) - 1).alias("row_idx"), (F.col("o_totalprice") / 10000).alias("value"))
    return files.pair_sheet_rows(rows).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 4).alias("total"))


@query("SELECT o_orderstatus AS type, count(*) AS n, round(sum(1 / o_totalprice), 9) AS total FROM orders WHERE o_orderstatus IN ('F', 'O', 'P') AND o_totalprice <> 0 GROUP BY 1")
def wide_sheets(spark, sf):
    """IO4."""
    wide = X.table(spark, sf, "orders").select(*(F.when(F.col("o_orderstatus") == s, F.col("o_totalprice")).alias(s) for s in "FOP"))
    return files.melt_ratios(wide, list("FOP"), invert=True).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("ratio"), 9).alias("total"))


@query("SELECT image_name, fiber_id, '{\"type\":\"' || fiber_type || '\",\"ratio\":' || coalesce(ratio, -1)::DOUBLE || ',\"proba\":' || coalesce(error_probability, -1)::DOUBLE || '}' AS json FROM m", M)
def fiber_json(spark, sf):
    """IO7."""
    return files.fiber_json(X.measurements(spark, sf))


_STEPS = "list_reduce(list(CASE WHEN px IS NOT NULL AND label = {0} THEN sqrt((x - px) ** 2 + (y - py) ** 2) ELSE 0 END ORDER BY x), lambda a, b: a + b)"
_LINES = ", r AS (SELECT user_id, run, any_value(label) AS label, count(*) AS n, string_agg(x || ',' || y, ' ' ORDER BY x) AS line FROM (SELECT *, sum((pl IS DISTINCT FROM label)::INT) OVER (PARTITION BY user_id ORDER BY x) AS run FROM s) GROUP BY user_id, run), sg AS (SELECT user_id, count(*) AS runs, min_by(label, run) AS head, string_agg('\"' || line || '\"', ',' ORDER BY run) AS lines, string_agg(CASE label WHEN 1 THEN '\"red\"' ELSE '\"green\"' END, ',' ORDER BY run) AS colors, string_agg(n::VARCHAR, ',' ORDER BY run) AS lens FROM r GROUP BY 1)"
_LINES += f", ln AS (SELECT user_id, count(*) AS n, CASE WHEN count(*) < 2 THEN count(*) FILTER (label = 1) ELSE {_STEPS.format(1)} END::DOUBLE AS red, CASE WHEN count(*) < 2 THEN count(*) FILTER (label = 2) ELSE {_STEPS.format(2)} END::DOUBLE AS green FROM s GROUP BY 1), ty AS (SELECT *, CASE WHEN red = 0 OR green = 0 THEN 'one segment' WHEN runs = 2 THEN 'two segments' WHEN runs = 3 AND head = 1 THEN 'termination' WHEN runs = 3 THEN 'origin' ELSE 'other' END AS kind FROM ln JOIN sg USING (user_id))"


@query(_LINES + " SELECT 'events' AS image, user_id AS fiber_id, '{\"x\":0,\"y\":0,\"width\":' || n || ',\"height\":50,\"points\":[' || lines || '],\"colors\":[' || colors || '],\"fiber_id\":' || user_id || ',\"type\":\"' || kind || '\",\"ratio\":' || coalesce(green / nullif(red, 0), -1)::DOUBLE || ',\"proba_error\":-1.0,\"segmentLengthsPx\":[' || lens || '],\"firstAnalogPx\":' || red || ',\"secondAnalogPx\":' || green || '}' AS json FROM ty", T)
def trace_json(spark, sf):
    """IO7 with polylines."""
    p = F.col("points")
    red, green = G.colour_length(p, 1), G.colour_length(p, 2)
    box = F.struct(F.lit(0).alias("x"), F.lit(0).alias("y"), F.size(p).alias("width"), F.lit(50).alias("height"))
    rows = X.traces(spark, sf).select(F.lit("events").alias("image"), F.col("user_id").alias("fiber_id"), box.alias("bbox"), "points", red.alias("red"), green.alias("green"))
    rows = rows.select("*", G.fiber_type(F.col("red"), F.col("green"), G.runs(p)).alias("fiber_type"), F.try_divide("green", F.nullif("red", F.lit(0.0))).alias("ratio"), F.lit(None).cast("double").alias("error_probability"))
    return files.trace_json(rows)


@query("SELECT host, url FROM (SELECT split_part(split_part(url, '//', 2), '/', 1) AS host, url, row_number() OVER (PARTITION BY split_part(split_part(url, '//', 2), '/', 1) ORDER BY page_id) AS k FROM pages) WHERE k = 1")
def queue_dedupe(spark, sf):
    """U3."""
    rows = X.table(spark, sf, "pages").withColumn("host", F.split(F.split("url", "//")[1], "/")[0])
    return C.dedupe(rows, "host", ["page_id"]).select("host", "url")


@query("SELECT entry, position, a.name AS first, b.name AS second FROM (SELECT c_nationkey AS entry, c_name AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS position FROM customer) a JOIN (SELECT c_nationkey AS entry, 'x' || lpad(((c_custkey * 7919) % 1000003)::VARCHAR, 7, '0') AS name, row_number() OVER (PARTITION BY c_nationkey ORDER BY 'x' || lpad(((c_custkey * 7919) % 1000003)::VARCHAR, 7, '0')) AS position FROM customer) b USING (entry, position)")
def paired_files(spark, sf):
    """Two roles with as many files each."""
    rows = X.table(spark, sf, "customer")
    other = F.concat(F.lit("x"), F.lpad((F.col("c_custkey") * 7919 % 1000003).cast("string"), 7, "0"))
    return C.pair_by_position(rows.select(F.col("c_nationkey").alias("entry"), F.col("c_name").alias("name")), rows.select(F.col("c_nationkey").alias("entry"), other.alias("name")), "name").withColumn("position", F.col("position").cast("long"))


@query("SELECT c_nationkey AS entry, concat_ws('; ', CASE WHEN a <> 1 THEN 'AUTOMOBILE: ' || a END, CASE WHEN h > 1 THEN 'HOUSEHOLD: ' || h END) AS issues FROM (SELECT c_nationkey, count(*) FILTER (c_mktsegment = 'AUTOMOBILE') AS a, count(*) FILTER (c_mktsegment = 'HOUSEHOLD') AS h FROM customer GROUP BY 1)")
def role_check(spark, sf):
    """A21."""
    return C.role_check(X.table(spark, sf, "customer").select(F.col("c_nationkey").alias("entry"), F.col("c_mktsegment").alias("role")), ["AUTOMOBILE"], ["HOUSEHOLD"])


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def not_processed(spark, sf):
    """J17."""
    return C.not_done(X.table(spark, sf, "customer").select("c_custkey"), X.table(spark, sf, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


def _masks(spark, sf):
    return X.table(spark, sf, "orders").select(F.col("o_custkey").alias("image"), F.col("o_orderpriority").alias("annotator"))


@query("SELECT o_custkey AS image, s AS annotator FROM (SELECT DISTINCT o_custkey FROM orders) n, (SELECT DISTINCT o_orderpriority AS s FROM orders) WHERE (o_custkey, s) NOT IN (SELECT (o_custkey, o_orderpriority) FROM orders)")
def missing_annotators(spark, sf):
    """J18."""
    return C.missing_annotators(_masks(spark, sf))


@query("SELECT o_custkey AS image, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS present FROM orders GROUP BY 1")
def annotator_stacks(spark, sf):
    """J18."""
    return C.annotator_stacks(_masks(spark, sf)).select("image", F.array_join("present", "|").alias("present"))


@query("SELECT CASE WHEN regexp_matches(image_name, '04|05|06') THEN 'test' ELSE 'train' END AS part, count(*) AS n FROM m GROUP BY 1", M)
def split_by_rule(spark, sf):
    """X2."""
    return C.split_by_rule(X.measurements(spark, sf), "image_name").groupBy("part").agg(F.count("*").alias("n"))


@query()
def stable_split(spark, sf):
    """X1."""
    return C.split(X.measurements(spark, sf), "fiber_id", 90).groupBy("part").agg(F.count("*").alias("n"))


@query(f"SELECT grader, count(*) AS n, count(ratio) AS n_ratio FROM (SELECT ratio, 'sheet' AS grader FROM m WHERE grader = '{HUMAN}' UNION ALL SELECT NULL, 'tool' FROM m WHERE grader = '{AI}') GROUP BY 1", M)
def union_graded(spark, sf):
    """U1."""
    rows = X.measurements(spark, sf)
    both = C.union_graded((rows.filter(F.col("grader") == HUMAN), "sheet"), (rows.filter(F.col("grader") == AI).drop("ratio"), "tool"))
    return both.groupBy("grader").agg(F.count("*").alias("n"), F.count("ratio").alias("n_ratio"))


@query("SELECT name, \"column\", count(*) AS n FROM (SELECT DISTINCT 'type' AS \"column\", type AS name FROM m UNION ALL SELECT DISTINCT 'grader', grader FROM m) GROUP BY ALL", M)
def distinct_names(spark, sf):
    """A20."""
    return C.distinct_names(X.measurements(spark, sf), "type", "grader").groupBy("column", "name").agg(F.count("*").alias("n"))


@query("SELECT type, count(*) AS n FROM m WHERE ratio IS NOT NULL AND length_um IS NOT NULL AND type NOT IN ('STANDARD', 'SMALL') GROUP BY 1", M)
def dropped_categories(spark, sf):
    """F10, F11."""
    return C.complete(C.exclude_types(X.measurements(spark, sf), ["STANDARD", "SMALL"], "type")).groupBy("type").agg(F.count("*").alias("n"))


@query("SELECT grader, count(*) AS n FROM (FROM m UNION ALL SELECT * FROM m WHERE second_um > 40) GROUP BY 1", M)
def appended(spark, sf):
    """U2."""
    rows = X.measurements(spark, sf)
    return C.append(rows, rows.filter("second_um > 40")).groupBy("grader").agg(F.count("*").alias("n"))


@query("SELECT count(DISTINCT split_part(split_part(url, '//', 2), '/', 1)) AS added, count(*) - count(DISTINCT split_part(split_part(url, '//', 2), '/', 1)) AS skipped FROM pages")
def added_and_skipped(spark, sf):
    """U3."""
    return C.added_and_skipped(X.table(spark, sf, "pages").withColumn("host", F.split(F.split("url", "//")[1], "/")[0]), "host")


@query(f"SELECT type, grader, count(*) AS n FROM (SELECT grader, lower(CASE grader WHEN '{AI}' THEN replace(type, 'A', '4') ELSE CASE type WHEN 'SMALL' THEN 'little' ELSE type END END) AS type FROM m) GROUP BY ALL", M)
def renamed_by_grader(spark, sf):
    """X3."""
    rows = C.renamed(X.measurements(spark, sf), {AI: lambda c: N.substring_rename(c, [("A", "4")], upper=False), HUMAN: lambda c: N.map_rename(c, {"SMALL": "little"})}, F.lower)
    return rows.groupBy("type", "grader").agg(F.count("*").alias("n"))


@query("SELECT type, type_order, count(*) AS n FROM (SELECT type, list_position(['STANDARD', 'SMALL', 'ECONOMY'], type)::INT AS type_order FROM m) GROUP BY ALL", M)
def fixed_order(spark, sf):
    """W7; types that the list lacks have no order."""
    return C.fixed_order(X.measurements(spark, sf), ["STANDARD", "SMALL", "ECONOMY"]).groupBy("type", F.nullif("type_order", F.lit(0)).alias("type_order")).agg(F.count("*").alias("n"))


@query(", p AS (SELECT image_name, avg(error_probability) / 10 AS p FROM m GROUP BY 1), k AS (SELECT *, row_number() OVER (ORDER BY p, image_name) AS k, count(*) OVER () AS m FROM p) SELECT image_name, round(min(least(1, p * m / k)) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) AS p_bh, round(max(least(1, p * (m - k + 1))) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 6) AS p_holm, CASE WHEN p < 0.0001 THEN '****' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' WHEN p < 0.05 THEN '*' ELSE 'ns' END AS symbol FROM k", M)
def adjusted_p(spark, sf):
    """Of numbers that stand for p values, one for each image."""
    rows = X.measurements(spark, sf).groupBy("image_name").agg((F.avg("error_probability") / 10).alias("p"))
    return C.adjust_p(rows, "p", "image_name").select("image_name", _r("p_bh"), _r("p_holm"), S.symbols(F.col("p")).alias("symbol"))


@query("SELECT name, right(split_part(name, 'min', 1), 2) || ' min' AS shown FROM (SELECT DISTINCT image_name || ' ' || (first_um::INT + 10) || 'min x' AS name FROM m WHERE first_um IS NOT NULL)", M)
def durations(spark, sf):
    """S3."""
    rows = X.measurements(spark, sf).filter("first_um is not null").select(F.concat(F.col("image_name"), F.lit(" "), (F.col("first_um").cast("int") + 10).cast("string"), F.lit("min x")).alias("name")).distinct()
    return rows.select("name", N.duration(F.col("name")).alias("shown"))


@query("SELECT c_custkey, left(sha1('green=' || c_name || '#2|red=' || c_mktsegment || '#1|' || c_nationkey), 16) AS id FROM customer")
def entry_ids(spark, sf):
    """S9."""
    part = lambda c, k: F.struct(F.col(c).alias("path"), F.lit(k).alias("channel"))
    return X.table(spark, sf, "customer").select("c_custkey", N.entry_id(F.create_map(F.lit("red"), part("c_mktsegment", 1), F.lit("green"), part("c_name", 2)), F.col("c_nationkey").cast("string")).alias("id"))


@query("SELECT user_id, count(*) AS n, sum(x)::DOUBLE AS sx, sum(y)::DOUBLE AS sy FROM t GROUP BY 1", T)
def polylines(spark, sf):
    """Traces written as text and read again."""
    text = F.array_join(F.transform("points", lambda p: F.concat_ws(",", p["x"].cast("string"), p["y"].cast("string"))), " ")
    rows = X.traces(spark, sf).select("user_id", F.explode(N.parse_polyline(text)).alias("p"))
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("p.x").alias("sx"), F.sum("p.y").alias("sy"))


@query("SELECT o_orderpriority AS type, count(*) AS n, round(sum(o_totalprice / 10000), 4) AS total FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def second_only_sheets(spark, sf):
    """IO3: sheets with a ratio column that is empty."""
    rows = X.table(spark, sf, "orders").select(F.col("o_orderpriority").alias("sheet"), (F.col("o_totalprice") / 10000).alias("value"), F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), F.lit(1.0)).alias("ratio"))
    return files.second_only_sheet(rows).groupBy("type").agg(F.count("*").alias("n"), F.round(F.sum("second_um"), 4).alias("total"))


@query()
def bootstrap_disagreement(spark, sf):
    """T3."""
    return S.interval_disagreement(S.bootstrap_delta(_clean(spark, sf), BASELINE))


@query()
def graders_test(spark, sf):
    """T5 with p."""
    return S.welch_and_anova_p(_clean(spark, sf), AI, HUMAN)


@query()
def correlations_p(spark, sf):
    """T12 with p."""
    return S.agreement_p(S.cluster_means(_clean(spark, sf), AI, HUMAN))


@query()
def bootstrap_medians(spark, sf):
    """Interval of the difference of medians."""
    rows = _clean(spark, sf).select("type", (F.col("grader") == HUMAN).cast("int").alias("side"), F.col("ratio").alias("value"))
    return S.bootstrap(rows, "type", lambda x, wx, y, wy: S.weighted_median(x, wx) - S.weighted_median(y, wy))


_NAMED = f"lower(CASE grader WHEN '{AI}' THEN replace(type, 'A', '4') ELSE CASE type WHEN 'SMALL' THEN 'little' ELSE type END END)"


@query(f", c AS (SELECT grader, {_NAMED} AS type, length_um FROM m WHERE fiber_type = 'two segments' AND error_probability < 0.5), o AS (SELECT type, row_number() OVER (ORDER BY median(length_um), type) AS k FROM c GROUP BY 1) SELECT type, grader, k::INT AS type_order, count(*) AS n, round(median(length_um), 6) AS median FROM c JOIN o USING (type) GROUP BY ALL", M)
def loaded_conditions(spark, sf):
    """F3, F5, X3, W6 one after the other: what a loader does before anything is compared."""
    rows = C.renamed(C.below_error(C.only_double(X.measurements(spark, sf))), {AI: lambda c: N.substring_rename(c, [("A", "4")], upper=False), HUMAN: lambda c: N.map_rename(c, {"SMALL": "little"})}, F.lower)
    out = C.summary(rows, "length_um")
    return C.with_order(out, C.order_types(rows)).select("type", "grader", "type_order", "n", _r("median"))


@query("SELECT fiber_type, grader, count(*) AS n FROM m WHERE fiber_type IN ('termination', 'origin') GROUP BY ALL", M)
def triple_fibers(spark, sf):
    """F3 for fibers of three segments."""
    return C.only_triple(X.measurements(spark, sf)).groupBy("fiber_type", "grader").agg(F.count("*").alias("n"))


@query("SELECT image_name, type, first_um FROM m WHERE fiber_id = (SELECT min(fiber_id) FROM m)", M)
def looked_up(spark, sf):
    """F12."""
    rows = X.measurements(spark, sf)
    return C.lookup(rows, rows.agg(F.min("fiber_id")).first()[0] or 0).select("image_name", "type", "first_um")


@query(", v AS (SELECT *, CASE WHEN fiber_id % 11 = 0 THEN 0 ELSE width END AS w, CASE WHEN fiber_id % 13 = 0 THEN -x - 1 ELSE x END AS l, CASE WHEN fiber_id % 17 = 0 THEN 0 ELSE height END AS p FROM b) SELECT grader, count(*) AS n, count(*) FILTER (x >= 900) AS far FROM v WHERE w > 0 AND height > 0 AND l >= 0 AND y >= 0 AND p > 0 GROUP BY 1", B)
def valid_boxes(spark, sf):
    """boxes without width, boxes that begin outside the image, and fibers without pixels go."""
    b, own = F.col("bbox"), F.col("fiber_id")
    bad = F.struct(F.when(own % 13 == 0, -b["x"] - 1).otherwise(b["x"]).alias("x"), b["y"].alias("y"), F.when(own % 11 == 0, 0).otherwise(b["width"]).alias("width"), b["height"].alias("height"))
    rows = X.boxes(spark, sf).select("grader", F.abs(b["x"]).alias("at"), bad.alias("bbox"), F.when(own % 17 == 0, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(1), b["height"].cast("int"))).alias("pixels"))
    return C.drop_invalid_boxes(rows, pixels="pixels").groupBy("grader").agg(F.count("*").alias("n"), F.count_if(F.col("at") >= 900).alias("far"))


@query(_PROBS + " SELECT image, " + ", ".join(f"round(avg(p{k}), 6) AS p{k}" for k in range(3)) + " FROM (SELECT image, y, x, " + ", ".join(f"avg(p{k} * p{k}) AS p{k}" for k in range(3)) + " FROM pb GROUP BY ALL) GROUP BY 1", PX)
def merged_scales(spark, sf):
    """A15 over scales: means of squares."""
    px = X.mask_pixels(spark, sf).select("image", "y", "x").distinct().withColumn("k", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    p = lambda a, b, c: ((F.col("y") * a + F.col("x") * b + F.col("k") * c) % 101) / 101
    return P.merge_scales(px.select("image", "y", "x", p(31, 17, 7).alias("p0"), p(13, 29, 11).alias("p1"), p(7, 3, 5).alias("p2"))).groupBy("image").agg(*(_r(F.avg(f"p{k}"), f"p{k}") for k in range(3)))


@query(", t AS (SELECT type, row_number() OVER (ORDER BY median(length_um), type) AS k FROM m GROUP BY 1) SELECT 'all' AS mode, a.type AS a, b.type AS b FROM t a JOIN t b ON a.k < b.k UNION ALL SELECT 'reference', a.type, b.type FROM t a JOIN t b ON a.k = 1 AND b.k > 1", M)
def comparison_modes(spark, sf):
    """All pairs, and all against the first."""
    order = C.order_types(X.measurements(spark, sf))
    mode = lambda m: C.test_pairs(order, m).select(F.lit(m).alias("mode"), "a", "b")
    return mode("all").unionByName(mode("reference"))
