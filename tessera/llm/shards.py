"""Contiguous shards of nearly equal bytes from global prefix sums.

Rows, reduced to key, size and checksum, are range-partitioned by key once and kept by a checkpoint, so that
partitions stay the same in both passes. Pass one takes each partition's totals (one row each); their prefix
sums give the byte and the row at which every partition begins. Pass two adds running sums within the
partition and cuts at equal byte targets. Nothing but a row for each partition meets in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.plans.session import cut, ship, width


def _place(shards: int, total: int, starts):
    """Running sums from where the partition begins; a row belongs to the shard in which its middle byte lies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, byte, row = False, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if not begun:
                byte, row = starts.value[batch.column(batch.schema.get_field_index("_part"))[0].as_py()]
                begun = True
            size = batch.column(batch.schema.get_field_index("size")).to_numpy()
            ends = byte + np.cumsum(size)
            middle = ends - size + size // 2
            if total < (1 << 58) // shards:
                shard = np.minimum(middle * shards // total, shards - 1)
            else:
                shard = np.array([min(int(m) * shards // total, shards - 1) for m in middle])
            at = row + np.arange(len(size))
            byte, row = int(ends[-1]), row + len(size)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard.astype(np.int32)), pa.array(at.astype(np.int64))], names=[*batch.schema.names, "shard", "_row"])

    return run


def assign(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot (gapless from 0), grown_shard (null).

    Size is the text's UTF-8 bytes plus 1 (null: 1). Rows are in the order of id (nulls first), size and
    checksum; repeated rows are alike, so their order among themselves shows nowhere. Shards are contiguous in
    that order, and each is within the largest row of an equal part. An empty table gives none; with fewer rows
    than shards some shards are empty.
    """
    spark = docs.sparkSession
    ship(spark)
    n = width(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    light = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    # the last key deals rows that are alike to several partitions
    ordered = light.withColumn("_salt", F.monotonically_increasing_id()).repartitionByRange(n, "doc_id", "size", "text_crc32", "_salt").sortWithinPartitions("doc_id", "size", "text_crc32")
    kept = cut(ordered.drop("_salt").withColumn("_part", F.spark_partition_id()))
    totals = kept.groupBy("_part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts, byte, row = {}, 0, 0
    for r in sorted(totals.collect()):  # one row a partition
        starts[r["_part"]] = (byte, row)
        byte, row = byte + r["bytes"], row + r["rows"]
    shared = spark.sparkContext.broadcast(starts)
    placed = kept.mapInArrow(_place(shards, max(byte, 1), shared), "doc_id long, size long, text_crc32 long, _part int, shard int, _row long")
    firsts = {r["shard"]: r["f"] for r in placed.groupBy("shard").agg(F.min("_row").alias("f")).collect()}
    first = F.create_map(*(F.lit(x) for k in sorted(firsts) for x in (k, firsts[k]))) if firsts else F.create_map(F.lit(0), F.lit(0).cast("long"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("_row") - F.try_element_at(first, F.col("shard"))).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
