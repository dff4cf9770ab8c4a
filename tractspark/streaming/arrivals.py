"""Incremental work on arriving files (ST items)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def append_new(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, transform=lambda df: df, files_per_trigger: int = 1000) -> None:
    """ST1: each input file once; a rerun adds only what is missing."""
    rows = transform(spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).parquet(source))
    rows.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink, format="parquet", outputMode="append").awaitTermination()


def running_summary(rows: DataFrame, by: list[str], col: str, probabilities: Sequence[float] = (0.25, 0.5, 0.75), accuracy: int = 10_000) -> DataFrame:
    """ST2: count, sum, mean and quantiles of col for each group, for complete or update mode. A group's state is a count, a sum and a sketch that
    merges with others, of bounded size; the ranks of its quantiles are off by count / accuracy at most. A query that is stopped goes on from its
    checkpoint, so a restart gives what one run would have given."""
    sketch = F.percentile_approx(col, [float(p) for p in probabilities], accuracy)
    return rows.groupBy(*by).agg(F.count(col).alias("n"), F.sum(col).alias("sum"), F.avg(col).alias("mean"), sketch.alias("quantiles"))


def keep_summary(rows: DataFrame, by: list[str], col: str, sink: str, checkpoint: str, **options) -> None:
    """Brings a table of running summaries up to date with what has arrived: each batch's changed groups are written as one version, and the
    latest one of each group counts (read_summary). A batch that is written twice has the same number, so it counts once."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{sink}/batch={number}_")

    running_summary(rows, by, col, **options).writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start().awaitTermination()


def read_summary(spark: SparkSession, by: list[str], sink: str) -> DataFrame:
    """What keep_summary holds now: the latest row of each group."""
    rows = spark.read.option("recursiveFileLookup", True).parquet(sink)
    others = [c for c in rows.columns if c not in (*by, "batch")]
    return rows.groupBy(*by).agg(F.max_by(F.struct(*others), "batch").alias("s")).select(*by, "s.*")
