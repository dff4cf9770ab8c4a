"""Shared helpers: where intermediate tables go, cutting lineage by writing them, Arrow batches of a bounded size, running sums."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and bytes per Arrow batch handed to a Python worker, at most; texts may be long, so batches are short.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Elements that one step of running_sums adds up.
STEP = 256


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. Where it is unset: a folder in the warehouse, or on a local
    master, whose executors are the driver, a new temporary one."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = sc.master.startswith("local") and not sc.master.startswith("local-cluster")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-") if local else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared"
        spark.conf.set("spark.checkpoint.dir", base)
    path = sc._jvm.org.apache.hadoop.fs.Path(base)  # a path without a scheme is one of the default file system
    return str(path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()).replace("file:/", "file:///", 1) if "://" not in base else base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: the lineage ends there and lost executors cost nothing upstream."""
    return _written(df, new_path(df.sparkSession, tag))


def _written(df: DataFrame, path: str) -> DataFrame:
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Intermediate tables of one run in the shared folder, deleted when the block ends; what leaves the block is written elsewhere."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.path, self.n = spark, new_path(spark, f"{tag}-scratch"), 0

    def __enter__(self) -> Scratch:
        return self

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        return _written(df, f"{self.path}/{self.n}")

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that `write` gave, once nothing reads them any more."""
        for table in tables:
            for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
                self._delete(name)

    def _delete(self, name: str) -> None:
        sc = self.spark.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_) -> None:
        self._delete(self.path)


def bound_arrow(spark: SparkSession, n: int = ARROW_ROWS) -> None:
    """From now on the session's Arrow batches hold at most n rows and ARROW_BYTES; a setting that is smaller already stays. It isn't set
    back, as plans run after their operator has returned."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", n), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = int(str(spark.conf.get(key)).rstrip("bB"))
        if now <= 0 or now > most:
            spark.conf.set(key, most)


@contextlib.contextmanager
def arrow_rows(spark: SparkSession, n: int = ARROW_ROWS):
    """Arrow batches of at most n rows for the jobs that end inside the block."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.set(key, old)


def running(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """Array (int) of what merge makes of 0 and all elements before each one, by steps of STEP elements, so that no array grows by one
    element at a time."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    starts = lambda a: F.aggregate(a, empty, lambda s, x: F.struct(merge(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])
    last = F.greatest(F.lit(0), F.floor((F.size(values) - 1) / STEP)).cast("int")
    steps = F.transform(F.sequence(F.lit(0), last), lambda k: F.slice(values, k * STEP + 1, F.lit(STEP)))
    before = starts(F.transform(steps, lambda a: F.aggregate(a, F.lit(0), merge)))
    return F.flatten(F.zip_with(F.transform(steps, starts), before, lambda own, first: F.transform(own, lambda x: merge(first, x))))


def running_sums(values: Column) -> Column:
    return running(values, lambda s, x: s + x)


def running_most(values: Column) -> Column:
    return running(values, lambda s, x: F.greatest(s, x))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def free_name(columns: list[str], name: str) -> str:
    """name, with as many underscores before it as it takes to clash with none of the columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def own_columns(df: DataFrame) -> list[Column]:
    """The columns of df, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in df.columns]
