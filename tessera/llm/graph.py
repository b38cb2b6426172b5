"""Connected components of an edge table: in one task while it is small, else distributed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.plans.session import cut, ship

#: Edges (16 bytes each) that one task may hold; more are worked off by joins.
ONE_TASK = 500_000


def lowest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices and the smallest vertex of each one's component."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    u, v = place[: len(a)], place[len(a) :]
    top = np.arange(len(ids))
    while True:
        x, y = top[u], top[v]
        if (x == y).all():
            return ids, ids[top]
        np.minimum.at(top, np.maximum(x, y), np.minimum(x, y))
        while (top[top] != top).any():
            top = top[top]


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    got = [(x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches if x.num_rows]
    if got:
        ids, least = lowest(*(np.concatenate(x) for x in zip(*got, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(least)], names=["id", "comp"])


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(id, comp) of every vertex that has an edge to another; comp is the smallest id of its component. Ids are longs.

    Up to one_task distinct edges go to one task. Of more, each turn hooks every label to the smallest label among its vertices'
    neighbours, then doubles the jumps until every label is at the end of its hooks. Labels only fall, and turns go on until none can be
    hooked, so the result is exact for any order of ids. Aggregates combine before the shuffle, so a vertex of very many edges is no hot spot.
    """
    spark = edges.sparkSession
    once = cut(edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v").distinct())
    if once.count() <= one_task:
        ship(spark)
        return once.coalesce(1).mapInArrow(_whole, "id long, comp long")
    both = cut(once.unionByName(once.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    label = cut(both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("least")).select("id", F.least("id", "least").alias("comp")))
    while True:
        # of a label's neighbours by edges, the smallest label: hooks whole trees, not single vertices
        seen = both.join(label.select(F.col("id").alias("v"), F.col("comp").alias("other")), "v").groupBy(F.col("u").alias("id")).agg(F.min("other").alias("other"))
        hook = label.join(seen, "id").groupBy("comp").agg(F.min("other").alias("to")).filter("to < comp")
        if hook.isEmpty():
            break
        jump = cut(hook.select(F.col("comp").alias("c"), "to"))
        while not jump.join(jump.select(F.col("c").alias("to")), "to", "left_semi").isEmpty():
            for _ in range(2):
                far = jump.select(F.col("c").alias("to"), F.col("to").alias("next"))
                jump = jump.join(far, "to", "left").select("c", F.coalesce("next", "to").alias("to"))
            jump = cut(jump)
        label = cut(label.join(jump, F.col("comp") == F.col("c"), "left").select("id", F.coalesce("to", "comp").alias("comp")))
    return label
