"""Exact splitters of a long key by iterated histograms, with DataFrame functions only.

Each round counts the weight of the rows in equal ranges of the key across all partitions (partial sums on the map
side, at most `bins` rows to the driver) and narrows the ranges that still hold an unmet splitter, until every
splitter meets the tolerance or is exact to one key.
"""

from __future__ import annotations

from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class Splitters:
    """bounds[k]: the first key of part k + 1. low, high: the least and greatest key. total: the summed weight."""

    bounds: list[int]
    low: int
    high: int
    total: int
    rows: int
    rounds: int


def exact_splitters(df: DataFrame, key: Column, weight: Column, shares: list[float], tolerances: list[float], bins: int = 4096) -> Splitters:
    """The keys below which the given shares (ascending, between 0 and 1) of the summed weight lie.

    tolerances: for each splitter, the accepted distance from its target, as weight. A coarser boundary that meets
    the tolerance is preferred to an exact one. Rows with equal keys are never parted. An empty df gives no bounds.
    """
    keyed = df.select(key.cast("long").alias("k"), weight.cast("long").alias("w"))
    low, high, total, rows = keyed.agg(F.min("k"), F.max("k"), F.sum("w"), F.count("*")).first()
    if low is None:
        return Splitters([], 0, 0, 0, rows or 0, 0)
    total = total or 0
    off = (F.col("k").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")).cast("decimal(20,0)") if high - low >= 2**63 else F.col("k") - F.lit(low)
    pre = 0
    if high - low >= 2**63:  # keys so far apart are told apart by all but their last bit
        off, pre = F.floor(off / 2).cast("long"), 1
    keyed = keyed.select(off.alias("k"), "w")
    shift = max(0, ((high - low) >> pre).bit_length() - (bins.bit_length() - 1))
    edges: dict[int, int] = {}
    #: target -> (bin id at the last shift, weight below that bin)
    todo = {i: (0, 0) for i in range(len(shares))}
    targets = [s * total for s in shares]
    last, rounds = None, 0
    while todo:
        rounds += 1
        part = keyed
        if last is not None:
            part = part.where(F.shiftright("k", last).isin(sorted({b for b, _ in todo.values()})))
        counted = {r.b: r.w for r in part.groupBy(F.shiftright("k", shift).alias("b")).agg(F.sum("w").alias("w")).collect()}
        inside: dict[int, list[int]] = {}
        for b in sorted(counted):
            inside.setdefault(b >> (last - shift) if last is not None else 0, []).append(b)
        after = {}
        for i, (parent, below) in todo.items():
            best, run, into = None, below, None
            for b in inside.get(parent, []):
                if best is None or abs(run - targets[i]) < best[0]:
                    best = (abs(run - targets[i]), b)
                if run <= targets[i] < run + counted[b]:
                    into = (b, run)
                run += counted[b]
                if best is None or abs(run - targets[i]) < best[0]:
                    best = (abs(run - targets[i]), b + 1)
                if run > targets[i] and into:
                    break
            if best is None:
                best = (0, parent << (last - shift) if last is not None else 0)
            if shift == 0 or best[0] <= tolerances[i] or into is None:
                edges[i] = low + ((best[1] << shift) << pre)
            else:
                after[i] = into
        todo, last = after, shift
        if todo:
            shift = max(0, shift - max(1, (max(2, bins // len({b for b, _ in todo.values()}))).bit_length() - 1))
    bounds = [edges[i] for i in range(len(shares))]
    for i in range(1, len(bounds)):
        bounds[i] = max(bounds[i], bounds[i - 1])
    return Splitters(bounds, low, high, total, rows, rounds)


def with_part(df: DataFrame, key: Column, found: Splitters, name: str, few: int = 48, bins: int = 65536) -> DataFrame:
    """df with the number of the part that each row's key falls into.

    Few bounds become comparisons; many are looked up by a broadcast table of at most `bins` ranges of the key.
    """
    bounds = found.bounds
    key = key.cast("long")
    if len(bounds) <= few:
        return df.withColumn(name, sum(((key >= F.lit(b)).cast("int") for b in bounds), F.lit(0)))
    shift = max(0, (found.high - found.low).bit_length() - (bins.bit_length() - 1))
    cells: dict[int, list[int]] = {}
    for b in bounds:
        cells.setdefault((b - found.low) >> shift, []).append(b)
    top = ((found.high - found.low) >> shift) + 1
    rows = [(c, bisect_left(bounds, found.low + (c << shift)), cells.get(c, [])) for c in range(top + 1)]
    look = df.sparkSession.createDataFrame(rows, f"{name}_cell long, {name}_base int, {name}_cuts array<long>")
    return (
        df.withColumn(f"{name}_cell", F.shiftright(key - F.lit(found.low), shift))
        .join(F.broadcast(look), f"{name}_cell", "left")
        .withColumn(name, F.col(f"{name}_base") + F.size(F.filter(f"{name}_cuts", lambda c: c <= key)))
        .drop(f"{name}_cell", f"{name}_base", f"{name}_cuts")
    )
