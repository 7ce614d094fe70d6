"""Connected components of a link table: few links by union-find in one task, any number by alternating large and small stars.

A round of stars is seven shuffles for the driver to plan, compile and keep account of, however few the links are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquery.llm.common import materialize
from leafquery.ship import ship

#: Distinct links that one task takes (16 bytes each, below 100 MB with all that union-find holds); more go in rounds.
TASK_LINKS = 250_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of one task: each linked id u with the least one v that it reaches, but for that one itself."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
    if not held:
        return
    u, v = (np.concatenate(x) for x in zip(*held, strict=True))
    ids, places = np.unique(np.concatenate([u, v]), return_inverse=True)  # ascending: the least place is the least id
    at = list(range(len(ids)))

    def root(x: int) -> int:
        while at[x] != x:
            at[x] = at[at[x]]
            x = at[x]
        return x

    for x, y in zip(places[: len(u)].tolist(), places[len(u) :].tolist(), strict=True):
        x, y = root(x), root(y)
        at[max(x, y)] = min(x, y)
    least = ids[[root(x) for x in range(len(ids))]]
    yield pa.RecordBatch.from_arrays([pa.array(x[ids != least], pa.int64()) for x in (ids, least)], names=["u", "v"])


def _star(links: DataFrame, large: bool) -> DataFrame:
    """large: every greater neighbour of u is linked to u's least neighbour; small: every lesser one, and u itself."""
    if large:
        both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        out = links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """links: two columns of ids, in any direction, repeated or not; null ids and loops are left out.

    Returns (node, component): the least id that each linked id reaches, itself included. Ids without links are not
    listed. Up to TASK_LINKS links go through one task; above, the number of rounds grows with the logarithm of the
    longest path.
    """
    ship(links.sparkSession)
    a, b = links.columns[:2]
    now = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u > v").distinct()
    now = materialize(now, label)
    few = now.count() <= TASK_LINKS
    now = materialize(now.coalesce(1).mapInArrow(_forest, "u long, v long"), label, done=(now,)) if few else _rounds(now, label)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _rounds(now: DataFrame, label: str) -> DataFrame:
    """Large and small stars until nothing changes: u, v of each id and the least one that it reaches."""
    sign = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
    before = sign(now)
    while before[0]:
        now = materialize(_star(_star(now, True), False), label, done=(now,))
        after = sign(now)
        if after == before:
            break
        before = after
    return now
