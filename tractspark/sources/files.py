"""Files in and out (IO items)."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.geometry import colour_length, fiber_type, runs, segments
from ..operators.cohort import drop_invalid_boxes
from ..schemas import AI, FIBERS, IMAGE_COLUMNS, TYPE_ALIASES


#: Columns of a prediction file that are read, and where their values go.
_CELLS = ("image_name", "Fiber ID", "First analog (µm)", "Second analog (µm)", "Ratio", "Fiber type", "Valid", "Error probability")


def read_predictions(spark: SparkSession, root: str, grader: str = AI) -> DataFrame:
    """IO1: all CSV files below root, read whole and each parsed with its own header (the record that names the first tract; what stands before it
    is skipped): any number of columns in any order, quoted cells with commas and line ends, the image column spelt either way. Columns that a
    file lacks, and cells that a short record lacks, are null, as are numbers that can't be read; a file without a header has no rows."""
    names = [f"c{k}" for k in range(len(_CELLS))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                at, out = None, [[] for _ in names]
                for record in csv.reader(io.StringIO(content.as_py().decode("utf-8-sig", "replace"), newline="")):
                    cells = [c.strip() for c in record]
                    if _CELLS[2] in cells:
                        spelt = [next((c for c in IMAGE_COLUMNS if c in cells), None), *_CELLS[1:]]
                        at = [cells.index(c) if c in cells else None for c in spelt]
                    elif at is not None and any(cells):
                        for column, k in zip(out, at):
                            column.append(cells[k] or None if k is not None and k < len(cells) else None)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root).select("content")
    cells = files.mapInArrow(parse, ", ".join(f"{c} string" for c in names))
    image, fiber, first, second, ratio, kind, valid, error = (F.col(c) for c in names)
    aliases = F.create_map(*[F.lit(x) for p in TYPE_ALIASES.items() for x in p])
    number = lambda c: F.when(~F.isnan(c.try_cast("double")), c.try_cast("double"))
    return cells.select(
        image.alias("image_name"), fiber.try_cast("long").alias("fiber_id"), number(first).alias("first_um"), number(second).alias("second_um"), number(ratio).alias("ratio"), (number(first) + number(second)).alias("length_um"),
        F.coalesce(aliases[kind], kind).alias("fiber_type"), valid.try_cast("boolean").alias("valid"), number(error).alias("error_probability"), F.lit(grader).alias("grader"),
    )


def pair_sheet_rows(rows: DataFrame) -> DataFrame:
    """IO2: sheet, row_idx, value; an even row is the second tract and the odd one after it the first."""
    pairs = rows.groupBy("sheet", F.floor(F.col("row_idx") / 2).alias("pair")).agg(F.max(F.when(F.col("row_idx") % 2 == 1, F.col("value"))).alias("first_um"), F.max(F.when(F.col("row_idx") % 2 == 0, F.col("value"))).alias("second_um"))
    return pairs.dropna(subset=["first_um", "second_um"]).withColumn("ratio", F.try_divide("second_um", F.nullif("first_um", F.lit(0.0)))).withColumnRenamed("sheet", "type")


def second_only_sheet(rows: DataFrame) -> DataFrame:
    """IO3: sheets whose ratio column is empty: the value is the second tract, the first is 0 and the ratio null."""
    empty = rows.groupBy("sheet").agg(F.count("ratio").alias("n")).filter("n = 0").select("sheet")
    own = rows.join(empty, "sheet", "left_semi").filter(F.col("value").isNotNull())
    return own.select(F.col("sheet").alias("type"), F.lit(0.0).alias("first_um"), F.col("value").alias("second_um"), F.col("value").alias("length_um"), F.lit(None).cast("double").alias("ratio"))


def melt_ratios(wide: DataFrame, conditions: Sequence[str], invert: bool = False) -> DataFrame:
    """IO4: a column per condition to rows."""
    long = wide.unpivot([], list(conditions), "type", "ratio").filter(F.col("ratio").isNotNull())
    return long.withColumn("ratio", F.try_divide(F.lit(1.0), "ratio")) if invert else long


def write_measurements(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """IO5."""
    (df.write.partitionBy("type").parquet if kind == "parquet" else df.write.option("header", True).csv)(path)


def read_measurements(spark: SparkSession, path: str, schema: str | StructType, kind: str = "parquet") -> DataFrame:
    """IO5: what write_measurements wrote, with the columns of the schema."""
    return spark.read.schema(schema).parquet(path) if kind == "parquet" else spark.read.schema(schema).option("header", True).csv(path)


def write_fibers(df: DataFrame, path: str) -> None:
    """IO6: keeps what a fiber is (FIBERS); derived columns go."""
    df.select(*(f.name for f in FIBERS)).write.parquet(path)


def read_fibers(spark: SparkSession, path: str) -> DataFrame:
    """IO6: fibers with their lengths, type, ratio and boxes computed anew; rows with an invalid box go."""
    rows = drop_invalid_boxes(spark.read.schema(FIBERS).parquet(path), pixels="pixels")
    p = F.col("trace")
    lengths = {"red": colour_length(p, 1, F.col("correction.red")), "green": colour_length(p, 2, F.col("correction.green"))}
    outside = F.exists(p, lambda q: (q["x"] < 0) | (q["y"] < 0) | (q["x"] >= F.col("bbox.width")) | (q["y"] >= F.col("bbox.height")))
    return rows.withColumns(lengths).withColumns({"fiber_type": fiber_type(F.col("red"), F.col("green"), runs(p), outside), "ratio": F.try_divide("green", F.nullif("red", F.lit(0.0)))})


def fiber_json(df: DataFrame) -> DataFrame:
    """IO7: one JSON text per fiber; a null ratio is -1."""
    return df.select("image_name", "fiber_id", F.to_json(F.struct(F.col("fiber_type").alias("type"), F.coalesce("ratio", F.lit(-1.0)).alias("ratio"), F.coalesce("error_probability", F.lit(-1.0)).alias("proba"))).alias("json"))


def trace_json(df: DataFrame, scale: float = 1.0, colours: Sequence[str] = ("red", "green")) -> DataFrame:
    """IO7 with traces: image, fiber_id and json, null for an empty trace. df: image, fiber_id, bbox, points (from the box's corner), red,
    green, fiber_type, ratio and error_probability. Scaled coordinates are truncated; a null ratio or probability is -1."""
    b, cut = F.col("bbox"), lambda c: (c * scale).cast("int")
    found = segments(F.col("points"))
    line = lambda s: F.array_join(F.transform(s["points"], lambda p: F.concat_ws(",", cut(p["x"] + b["x"]).cast("string"), cut(p["y"] + b["y"]).cast("string"))), " ")
    whole = F.struct(
        *(cut(b[k]).alias(k) for k in ("x", "y", "width", "height")), F.transform(found, line).alias("points"), F.transform(found, lambda s: F.when(s["label"] == 1, colours[0]).otherwise(colours[1])).alias("colors"),
        "fiber_id", F.col("fiber_type").alias("type"), F.coalesce("ratio", F.lit(-1.0)).alias("ratio"), F.coalesce("error_probability", F.lit(-1.0)).alias("proba_error"),
        F.transform(found, lambda s: F.size(s["points"])).alias("segmentLengthsPx"), F.col("red").cast("double").alias("firstAnalogPx"), F.col("green").cast("double").alias("secondAnalogPx"),
    )
    return df.select("image", "fiber_id", F.when(F.size("points") > 0, F.to_json(whole)).alias("json"))


def list_files(spark: SparkSession, root: str, extensions: Sequence[str]) -> DataFrame:
    """IO8: paths below root whose extension is listed, whatever its case, by name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    return files.filter(F.lower(F.element_at(F.split("path", r"\."), -1)).isin(*(e.lower().lstrip(".") for e in extensions))).orderBy("path")


def read_labels(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """IO9."""
    return spark.read.schema(ddl).option("header", True).csv(path)
