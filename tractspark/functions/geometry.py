"""Row-local geometry: boxes and traces (P5 to P9, R1 to R6, R8, R9), as Column functions over arrays and structs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def area(b: Column) -> Column:
    return b["width"].cast("long") * b["height"]


def centre(b: Column) -> Column:
    half = lambda x: F.floor(x / 2).cast("int")
    return F.struct((b["x"] + half(b["width"])).alias("x"), (b["y"] + half(b["height"])).alias("y"))


def iou(a: Column, b: Column) -> Column:
    """0 if the union is empty."""
    side = lambda p, s: F.greatest(F.lit(0), F.least(a[p].cast("long") + a[s], b[p].cast("long") + b[s]) - F.greatest(a[p], b[p]))
    both = side("x", "width").cast("long") * side("y", "height")
    union = area(a) + area(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def scale(b: Column, s: float) -> Column:
    """P5: products are truncated."""
    return F.struct(*((b[k] * s).cast("int").alias(k) for k in ("x", "y", "width", "height")))


def expand(b: Column, f: float) -> Column:
    """P6."""
    w, h = (b["width"] * (1 + f)).cast("int"), (b["height"] * (1 + f)).cast("int")
    return F.struct((b["x"] - (w - b["width"]) / 2).cast("int").alias("x"), (b["y"] - (h - b["height"]) / 2).cast("int").alias("y"), w.alias("width"), h.alias("height"))


def crop_window(b: Column, width: Column, height: Column, inflate: float = 1.0) -> Column:
    """A square around the centre, clipped to the image, and what was clipped on each side."""
    side = (F.greatest(b["width"], b["height"]) * inflate).cast("int")
    c = centre(b)
    x0, y0 = c["x"] - F.floor(side / 2).cast("int"), c["y"] - F.floor(side / 2).cast("int")
    out = lambda v: F.greatest(F.lit(0), v)
    return F.struct(
        out(x0).alias("x0"), out(y0).alias("y0"), F.least(width, x0 + side).alias("x1"), F.least(height, y0 + side).alias("y1"),
        out(-x0).alias("left"), out(-y0).alias("top"), out(x0 + side - width).alias("right"), out(y0 + side - height).alias("bottom"),
    )


def label_from_rgb(red: Column, green: Column, threshold: float = 150) -> Column:
    """Green wins."""
    return F.when(green > threshold, 2).when(red > threshold, 1).otherwise(0)


def standardise(value: Column, mean: float, std: float) -> Column:
    """P9."""
    return (value - mean) / std


def colour_length(points: Column, label: int, correction: Column | None = None) -> Column:
    """Steps that end in a point of the label, and the endpoint correction; fewer than two points: the points of that label, without
    correction. points: structs y, x, label."""
    steps = F.zip_with(F.slice(points, 2, F.greatest(F.size(points) - 1, F.lit(0))), F.slice(points, 1, F.greatest(F.size(points) - 1, F.lit(0))), lambda p, q: F.when(p["label"] == label, F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"]))).otherwise(F.lit(0.0)))
    total = F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)
    total = total if correction is None else total + F.coalesce(correction, F.lit(0.0))
    return F.when(F.size(points) < 2, F.size(F.filter(points, lambda p: p["label"] == label)).cast("double")).otherwise(total)


def runs(points: Column) -> Column:
    """The labels of the runs along a trace, in order."""
    return F.transform(segments(points), lambda s: s["label"].cast("int"))


def segments(points: Column) -> Column:
    """The runs along a trace in order, structs of label and points; runs share no point."""
    n, none = F.size(points), F.array().cast("array<int>")
    turn = lambda i: (i == 0) | (F.get(points, i)["label"] != F.get(points, i - 1)["label"])
    starts = F.when(n > 0, F.filter(F.sequence(F.lit(0), n - 1), turn)).otherwise(none)
    ends = F.when(n > 0, F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(n))).otherwise(none)
    return F.zip_with(starts, ends, lambda a, b: F.struct(F.get(points, a)["label"].alias("label"), F.slice(points, a + 1, b - a).alias("points")))


def polyline_length(points: Column) -> Column:
    """Sum of the steps; 0 for fewer than two points."""
    rest = F.greatest(F.size(points) - 1, F.lit(0))
    steps = F.zip_with(F.slice(points, 2, rest), F.slice(points, 1, rest), lambda p, q: F.sqrt((p["x"] - q["x"]) * (p["x"] - q["x"]) + (p["y"] - q["y"]) * (p["y"] - q["y"])))
    return F.aggregate(steps, F.lit(0.0), lambda s, v: s + v)


def oriented_segments(points: Column) -> Column:
    """Label, points and length_px of each run; the last run first if the trace ends left of its start."""
    own = F.transform(segments(points), lambda s: F.struct(s["label"].alias("label"), s["points"].alias("points"), polyline_length(s["points"]).alias("length_px")))
    return F.when(F.try_element_at(points, F.lit(1))["x"] > F.try_element_at(points, F.lit(-1))["x"], F.reverse(own)).otherwise(own)


def fiber_type(red: Column, green: Column, run_labels: Column, outside: Column | None = None) -> Column:
    """R2. outside: whether the trace leaves its raster, which is an error."""
    n = F.size(run_labels)
    return (
        F.when((red == 0) | (green == 0), "one segment").when(F.lit(False) if outside is None else outside, "error").when(n == 2, "two segments")
        .when((n == 3) & (F.try_element_at(run_labels, F.lit(1)) == 1), "termination").when(n == 3, "origin").otherwise("other")
    )


def tortuosity(points: Column) -> Column:
    """The number of points over the chord, less 1."""
    a, b = F.try_element_at(points, F.lit(1)), F.try_element_at(points, F.lit(-1))
    chord = F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))
    return F.when((F.size(points) < 2) | (chord == 0), F.lit(0.0)).otherwise(F.size(points) / chord - 1)


def curvature(points: Column, window: int = 15) -> Column:
    """Turning angles between the points `window` before and after, summed over the arc length."""
    n = F.size(points)
    at = lambda i: F.element_at(points, i.cast("int"))

    def angle(i):
        a, b, c = at(i - window + 1), at(i + 1), at(i + window + 1)
        ux, uy, vx, vy = b["x"] - a["x"], b["y"] - a["y"], c["x"] - b["x"], c["y"] - b["y"]
        norm = F.sqrt((ux * ux + uy * uy).cast("double")) * F.sqrt((vx * vx + vy * vy).cast("double"))
        return F.when(norm > 0, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (ux * vx + uy * vy) / norm)))).otherwise(F.lit(0.0))

    arc = colour_length(F.transform(points, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"), F.lit(1).alias("label"))), 1)
    total = F.aggregate(F.transform(F.sequence(F.lit(window), n - window - 1), angle), F.lit(0.0), lambda s, v: s + v)
    return F.when((n < 2 * window + 1) | (arc < 1e-6), F.lit(0.0)).otherwise(total / arc)
