"""Canonical columns, literals and parameters."""

from __future__ import annotations

from pyspark.sql import types as T

# Fiber types, and older spellings that loaders still meet.
ONE, TWO, TERMINATION, ORIGIN, OTHER, ERROR = "one segment", "two segments", "termination", "origin", "other", "error"
VALID_TYPES = (TWO, TERMINATION, ORIGIN, OTHER)
TYPE_ALIASES = {"double": TWO, "single": ONE}
#: Names of the graders; every function takes them as parameters.
AI, HUMAN = "AI", "Human"

MEASUREMENTS = "image_name string, fiber_id bigint, first_um double, second_um double, ratio double, length_um double, fiber_type string, valid boolean, error_probability double, type string, grader string"
# Spellings of the image column in prediction files.
IMAGE_COLUMNS = ("Image Name", "image_name")
_point = [T.StructField("y", T.IntegerType()), T.StructField("x", T.IntegerType()), T.StructField("label", T.IntegerType())]
#: A fiber as it is stored: pixels and trace from the corner of the box.
FIBERS = T.StructType(
    [
        T.StructField("image", T.StringType()), T.StructField("grader", T.StringType()), T.StructField("fiber_id", T.LongType()), T.StructField("bbox", T.StructType([T.StructField(k, T.IntegerType()) for k in ("x", "y", "width", "height")])),
        T.StructField("pixels", T.ArrayType(T.StructType(_point))), T.StructField("trace", T.ArrayType(T.StructType(_point))), T.StructField("error_probability", T.DoubleType()),
        T.StructField("correction", T.StructType([T.StructField(k, T.DoubleType()) for k in ("red", "green")])),
    ]
)
KEY = ("image_name", "fiber_id")
