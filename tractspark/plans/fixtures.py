"""The library's tables as views of the given ones, in Spark and (for the oracles) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import AI, HUMAN

BASELINE = "STANDARD"

#: Boxes of a partition, about; some 35 pixels follow from each.
BOXES = 25_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").select("p_partkey", "p_type")
    line = F.col("l_linenumber")
    kind = F.when(line <= 3, "two segments").when(line == 4, "origin").when(line == 5, "termination").when(line == 6, "other").otherwise("one segment")
    first, second = F.when(F.col("l_tax") == 0, 0.0).otherwise(F.col("l_quantity")), F.col("l_extendedprice") / 2100
    return li.join(part, li["l_partkey"] == part["p_partkey"]).select(
        F.concat_ws("-", "p_type", F.col("l_suppkey").cast("string")).alias("image_name"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + line).alias("fiber_id"), first.alias("first_um"), second.alias("second_um"),
        F.try_divide(second, F.nullif(first, F.lit(0.0))).alias("ratio"), (first + second).alias("length_um"), kind.alias("fiber_type"), (F.col("l_discount") * 10).alias("error_probability"),
        F.col("p_type").alias("type"), F.when(F.col("l_linestatus") == "O", AI).otherwise(HUMAN).alias("grader"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dealt by image once, while they are small: what is grouped or joined by image and more needs no further shuffle of boxes or their pixels
    (joins by a setting that stays, as plans run later)."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    li = table(spark, sf_dir, "lineitem")
    parts = max(spark.sparkContext.defaultParallelism, -(-li.count() // BOXES))
    box = F.struct(((F.col("l_partkey") * 37) % 1000).cast("int").alias("x"), ((F.col("l_orderkey") * 17) % 1000).cast("int").alias("y"), (F.col("l_quantity").cast("int") + 20).alias("width"), (F.lit(20) + 5 * F.col("l_linenumber")).alias("height"))
    return li.select(F.col("l_suppkey").alias("image"), F.col("l_linestatus").alias("grader"), (F.col("l_orderkey") * 1000000 + F.col("l_partkey") * 10 + F.col("l_linenumber")).alias("fiber_id"), box.alias("bbox"), F.col("l_quantity").alias("red"), (F.col("l_extendedprice") / 2100).alias("green")).repartition(parts, "image").dropDuplicates(["image", "fiber_id"])


def trace_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One trace for each user, in the order of events."""
    ev = table(spark, sf_dir, "events")
    x = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    label = F.when(F.col("event_type").isin("click", "view", "signup"), 1).otherwise(2)
    return ev.select("user_id", x.alias("x"), (F.col("value").cast("int") % 50).alias("y"), label.alias("label"))


def traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "label"))), lambda p: p)
    return trace_points(spark, sf_dir).groupBy("user_id").agg(points.alias("points"))


def mask_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagonals through the boxes, by grader; the smallest label wins where they cross."""
    b = boxes(spark, sf_dir)
    rows = b.select("image", "grader", "fiber_id", "bbox", F.explode(F.sequence(F.lit(0), F.col("bbox.height") - 1)).alias("i"))
    return rows.select("image", "grader", "fiber_id", (F.col("bbox.y") + F.col("i")).alias("y"), (F.col("bbox.x") + F.col("i") % F.col("bbox.width")).alias("x"), (F.lit(1) + (F.col("i") >= F.col("bbox.height") / 2).cast("int")).alias("label"))


def mask_fibers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pixels, a row for each fiber: y, x and label are arrays."""
    b = boxes(spark, sf_dir).filter("bbox.x is not null and bbox.y is not null and bbox.width > 0 and bbox.height > 0")
    x, y, w, h = (F.col("bbox")[c] for c in ("x", "y", "width", "height"))
    half = F.ceil(h / 2).cast("int")
    across = F.slice(F.flatten(F.array_repeat(F.sequence(x, x + w - 1), F.ceil(h / w).cast("int"))), F.lit(1), h)
    return b.select("image", "grader", "fiber_id", F.sequence(y, y + h - 1).alias("y"), across.alias("x"), F.concat(F.array_repeat(F.lit(1), half), F.array_repeat(F.lit(2), h - half)).alias("label"))


MEASUREMENTS_SQL = f"""m AS (SELECT concat(p_type, '-', l_suppkey) AS image_name, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS fiber_id,
  CASE WHEN l_tax = 0 THEN 0.0 ELSE l_quantity END AS first_um, l_extendedprice / 2100 AS second_um,
  l_extendedprice / 2100 / nullif(CASE WHEN l_tax = 0 THEN 0.0::DOUBLE ELSE l_quantity END, 0) AS ratio, CASE WHEN l_tax = 0 THEN 0.0 ELSE l_quantity END + l_extendedprice / 2100 AS length_um,
  CASE WHEN l_linenumber <= 3 THEN 'two segments' WHEN l_linenumber = 4 THEN 'origin' WHEN l_linenumber = 5 THEN 'termination' WHEN l_linenumber = 6 THEN 'other' ELSE 'one segment' END AS fiber_type,
  l_discount * 10 AS error_probability, p_type AS type, CASE WHEN l_linestatus = 'O' THEN '{AI}' ELSE '{HUMAN}' END AS grader
  FROM lineitem JOIN part ON l_partkey = p_partkey),
d AS (SELECT * FROM m WHERE fiber_type = 'two segments' AND error_probability < 0.5 AND ratio BETWEEN 0.125 AND 8)"""
BOXES_SQL = """b AS (SELECT DISTINCT ON (image, fiber_id) * FROM (SELECT l_suppkey AS image, l_linestatus AS grader, l_orderkey * 1000000 + l_partkey * 10 + l_linenumber AS fiber_id, (l_partkey * 37) % 1000 AS x, (l_orderkey * 17) % 1000 AS y,
  trunc(l_quantity)::BIGINT + 20 AS width, 20 + 5 * l_linenumber AS height, l_quantity AS red, l_extendedprice / 2100 AS green FROM lineitem)),
pr AS (SELECT * FROM (SELECT p.image, p.fiber_id AS a, q.fiber_id AS b, p.red AS red_1, p.green AS green_1, q.red AS red_2, q.green AS green_2,
  greatest(0, least(p.x + p.width, q.x + q.width) - greatest(p.x, q.x)) * greatest(0, least(p.y + p.height, q.y + q.height) - greatest(p.y, q.y)) AS i, p.width * p.height + q.width * q.height AS s
  FROM b p JOIN b q ON p.image = q.image AND p.grader = 'F' AND q.grader = 'O' AND p.x < q.x + q.width AND q.x < p.x + p.width AND p.y < q.y + q.height AND q.y < p.y + p.height) WHERE i / (s - i) > 0.25)"""
POINTS_SQL = """t AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS x, trunc(value)::BIGINT % 50 AS y,
  CASE WHEN event_type IN ('click', 'view', 'signup') THEN 1 ELSE 2 END AS label FROM events),
s AS (SELECT *, lag(x) OVER w AS px, lag(y) OVER w AS py, lag(label) OVER w AS pl FROM t WINDOW w AS (PARTITION BY user_id ORDER BY x))"""
PIXELS_SQL = """px AS (SELECT image, grader, fiber_id, y + i AS y, x + i % width AS x, 1 + (i >= height / 2)::INT AS label FROM (SELECT *, unnest(range(0, height)) AS i FROM b))"""
