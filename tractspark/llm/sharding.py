"""Sharding by bytes: global prefix sums from per-partition totals, cut at equal targets into contiguous shards.

Rows are range-partitioned by their order and sorted; a task gives its rows the sums of what stands before them in its partition. The totals of the
partitions (one row each) give every partition its offset, and a row goes to the shard that its middle byte falls into, so a shard's
size differs from total / shards by a row at each end at most. Rows of one group stand together, at the place of the group's first row, and stay in
one shard as long as the group holds at most WHOLE of a shard; larger groups are cut like single rows. Nothing but the totals of partitions and
shards reaches the driver or is broadcast.

Defined cases: sizes that are null or negative count as 0, and if all are 0 every row goes to shard 0. Null ids come last. Rows equal in order,
group and id are interchangeable: each gets a slot. A group may hold any share of the rows. Shards may stay empty if rows are fewer or larger
than a shard. An empty table gives no rows; further columns are carried, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import Scratch, bound_arrow, materialise, own_columns

#: The share of a shard up to which a group is kept whole.
WHOLE = 0.01
#: Names of the columns that the method adds before it is done; the input's own get their place after them.
ADDED = ("first", "digest", "bytes", "order", "salt", "kept")


def text_bytes(text: Column) -> Column:
    """UTF-8 bytes of a text (null: none) plus 1."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def assign(rows: DataFrame, size: Column, order: Column, group: Column | None = None, shards: int = 8) -> DataFrame:
    """The columns of rows, then shard (int) and slot (long, gapless from 0 in each shard); a column of those names is replaced."""
    if shards < 1:
        raise ValueError("there must be a shard")
    spark = rows.sparkSession
    bound_arrow(spark)
    names = rows.columns
    # The salt, given where the table is read, tells rows apart that are equal otherwise.
    keyed = rows.select(
        F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).alias("bytes"), order.alias("order"), (F.lit(None).cast("binary") if group is None else group.cast("binary")).alias("digest"),
        F.monotonically_increasing_id().alias("salt"), F.struct(*[c.alias(f"c{i}") for i, c in enumerate(own_columns(rows))]).alias("own"),
    )
    with Scratch(spark, "sharding") as scratch:
        if group is None:
            keyed = keyed.select("bytes", F.col("order").alias("first"), "digest", "order", "salt", "own", F.lit(None).cast("long").alias("kept"))
        else:
            groups = scratch.write(keyed.groupBy("digest").agg(F.sum("bytes").alias("group_bytes"), F.min("order").alias("first"), F.count("*").alias("n")))
            most = int((groups.agg(F.sum("group_bytes")).first()[0] or 0) / shards * WHOLE)
            # Only groups of several rows are met: a row without one is a group of its own.
            several = groups.filter((F.col("n") > 1) & F.col("digest").isNotNull()).select("digest", "first", F.when(F.col("group_bytes") <= most, F.col("group_bytes")).alias("kept"), F.lit(True).alias("several"))
            keyed = keyed.join(several, "digest", "left").select("bytes", F.when(F.col("several"), F.col("first")).otherwise(F.col("order")).alias("first"), "digest", "order", "salt", "own", "kept")
        # Rows of a kept group have one range key, so no range parts them.
        apart = lambda c: F.when(F.col("kept").isNull(), F.col(c))
        ranged = keyed.repartitionByRange(F.asc_nulls_last("first"), "digest", apart("order").asc_nulls_last(), apart("salt")).sortWithinPartitions(F.asc_nulls_last("first"), "digest", F.asc_nulls_last("order"), "salt")
        local = ranged.select("bytes", "digest", "kept", "own")
        schema = StructType([StructField("part", IntegerType()), StructField("at", LongType()), StructField("middle", LongType()), *(f for f in local.schema if f.name in ("bytes", "own"))])

        def sums(batches):
            """Rows with their number in the partition and twice their middle byte (of a kept group: the group's)."""
            part, count, total, last, start = TaskContext.get().partitionId(), 0, 0, None, 0
            for batch in batches:
                table = pa.Table.from_batches([batch])
                n, own, kept = len(table), table["bytes"].to_numpy(), table["kept"]
                before = total + np.concatenate(([0], np.cumsum(own)[:-1]))
                inside = pc.is_valid(kept).to_numpy(zero_copy_only=False)
                digest = table["digest"].to_pylist()
                begins = np.array([not i or d != p for i, d, p in zip(inside, digest, [last, *digest[:-1]])])
                place = np.maximum.accumulate(np.where(begins, np.arange(n), -1))
                starts = np.where(place < 0, start, before[np.maximum(place, 0)])
                middle = np.where(inside, 2 * starts + pc.fill_null(kept, 0).to_numpy(), 2 * before + own)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int32)), pa.array(count + np.arange(n)), pa.array(middle), batch.column(0), batch.column(3)], names=schema.names)
                count, total, last, start = count + n, total + int(own.sum()), digest[-1] if inside[-1] else None, int(starts[-1])

        placed = scratch.write(local.mapInArrow(sums, schema))
        totals = placed.groupBy("part").agg(F.sum("bytes").alias("bytes"), F.count("*").alias("rows")).orderBy("part").collect()
        offsets, bytes_, count = [], 0, 0
        for r in totals:
            offsets.append((r.part, bytes_, count))
            bytes_, count = bytes_ + r.bytes, count + r.rows
        offsets = spark.createDataFrame(offsets, "part int, bytes_before long, rows_before long")
        cut = F.expr(f"int(least({shards - 1}, cast(middle + 2 * bytes_before as decimal(38,0)) * {shards} div {max(1, 2 * bytes_)}L))")
        placed = placed.join(F.broadcast(offsets), "part").select("own", cut.alias("shard"), (F.col("at") + F.col("rows_before")).alias("row"))
        firsts = spark.createDataFrame(placed.groupBy("shard").agg(F.min("row").alias("first_row")).collect(), "shard int, first_row long")
        out = placed.join(F.broadcast(firsts), "shard")
        kept_names = [(i, c) for i, c in enumerate(names) if c.lower() not in ("shard", "slot")]
        return materialise(out.select(*[F.col(f"own.c{i}").alias(c) for i, c in kept_names], "shard", (F.col("row") - F.col("first_row")).alias("slot")), "sharded")


def shard_documents(docs: DataFrame, shards: int = 8, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """All columns of docs, with shard and slot: shards of near-equal bytes, contiguous by id; equal texts stay together."""
    return assign(docs, text_bytes(F.col(text_col)), F.col(id_col), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256), shards)


def digests(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: where each document goes; texts aren't moved."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select("doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(text).alias("text_crc32"), F.sha2(text, 256).alias("digest"))
    placed = assign(rows, F.col("size"), F.col("doc_id"), F.unhex("digest"), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = 8, text_col: str = "text", id_col: str = "doc_id") -> None:
    """Parquet in a folder for each shard, its rows by slot; files of a shard are ranges of slots."""
    placed = shard_documents(docs, shards, text_col, id_col)
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
