"""Near-duplicate vectors by an exact metric range join on the unit sphere.

Cosine c between unit vectors is Euclidean distance sqrt(2 - 2c), so linking from a cosine on is a range join. Pivots
partition each label's vectors: a vector's home is the cell of its nearest pivot. It is copied into every cell whose
border it may reach over: if y lies within r of x and y's home is j, then x is within r of the half space nearer to
j, and by the triangle inequality (d(x,pj)^2 - d(x,pi)^2) / (2 d(pi,pj)) <= r holds for x's home i. A pair is counted
in the home of its lesser id, where both must be present. Cells join independently; a cell of many rows is cut into
blocks, each pair of blocks being one small task. Exact copies are one class with a weight.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquery.llm.common import materialize
from leafquery.llm.components import components
from leafquery.ship import ship

#: Vectors meant for one cell, rows of a block, pivots of all labels together (a bounded sample; results never depend
#: on it), and candidates looked at for each pivot.
CELL, BLOCK, MOST_PIVOTS, TRIES = 4096, 1024, 1024, 4
SLACK = 1e-9


def _rows(col: pa.Array) -> list[np.ndarray | None]:
    """Each vector as doubles; None if it is null, empty, zero, or holds a null or a non-finite component."""
    out: list[np.ndarray | None] = []
    for v in col:
        x = np.array(v.values.to_pylist(), dtype=object) if v.is_valid else None
        if x is None or not len(x) or any(e is None for e in x):
            out.append(None)
            continue
        x = x.astype(np.float64) + 0.0
        out.append(x if np.isfinite(x).all() and x.any() else None)
    return out


def _prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, units = [], []
        for label, x in zip(batch.column(1).to_pylist(), _rows(batch.column(2)), strict=True):
            if x is None or label is None:
                digests.append(None)
                units.append(None)
                continue
            digests.append(xxhash.xxh3_128_digest(str(label).encode() + b"|" + x.tobytes()))
            x = x / np.abs(x).max()
            units.append(x / np.sqrt(x @ x))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "label", "h", "u"])


def _pivots(nodes: DataFrame) -> dict[str, np.ndarray]:
    """Some far-apart vectors of every group that is too large for one cell."""
    sizes = nodes.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > CELL).withColumn("m", F.ceil(F.col("n") / CELL))
    sizes = materialize(sizes, "vector-groups-sizes")
    total = sizes.agg(F.sum("m")).first()[0]
    if not total:
        return {}
    # groups whose share of the pivots is one or none stay one cell, cut into blocks; so at most MOST_PIVOTS / 2 are listed
    share = min(1.0, MOST_PIVOTS / total)
    large = sizes.withColumn("m", F.floor(F.col("m") * share).cast("int")).where("m >= 2")
    wanted = {r.g: r.m for r in large.collect()}
    chance = large.select("g", F.least(F.lit(1.0), TRIES * (F.col("m") + 4) / F.col("n")).alias("chance"))
    picked = nodes.join(F.broadcast(chance), "g").where(F.pmod(F.xxhash64("a"), F.lit(1 << 30)) < F.col("chance") * (1 << 30)).select("g", "a", "u").limit(2 * TRIES * (MOST_PIVOTS + 4 * len(wanted))).toPandas()
    out = {}
    for g, part in picked.sort_values("a").groupby("g"):
        x = np.stack(part["u"].to_numpy())
        chosen, far = [0], ((x - x[0]) ** 2).sum(1)
        while len(chosen) < min(wanted[g], len(x)) and far.max() > 0:
            chosen.append(int(far.argmax()))
            far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
        out[g] = x[chosen]
    return out


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id, kept.

    Rows of one label and dimension are linked if their cosine in double precision is at least `cosine`. A vector that
    is null, empty, zero, or has null or non-finite components, and a row without a label, is linked with nothing.
    component_id is the least vec_id reachable; a row without an id has none, is kept, and is left out of the links.
    Repeated rows each count as a vector. Further columns are ignored. An empty table gives an empty result.
    """
    ship(vectors.sparkSession)
    radius = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + SLACK
    given = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vec_col).alias("v"))
    ready = materialize(given.mapInArrow(_prepare, "vec_id long, label long, h binary, u array<double>"), "vectors")
    usable = ready.where("h is not null and vec_id is not null")
    classes = usable.groupBy("h").agg(F.min("vec_id").alias("a"), F.count("*").alias("w"))
    nodes = usable.join(classes, "h").where("vec_id = a").dropDuplicates(["h"]).select("h", "a", "w", F.concat_ws(":", "label", F.size("u")).alias("g"), "u")
    nodes = materialize(nodes, "vector-classes")
    pivots = nodes.sparkSession.sparkContext.broadcast(_pivots(nodes))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pdf = batch.to_pandas()
            parts = []
            for g, part in pdf.groupby("g"):
                p = pivots.value.get(g)
                if p is None or len(p) == 1:
                    parts.append(part.assign(cell=0, home=True))
                    continue
                near = 2 - 2 * np.stack(part["u"].to_numpy()) @ p.T
                home = near.argmin(1)
                apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[home]
                reach = near - near[np.arange(len(part)), home][:, None] <= 2 * apart * (radius + SLACK)
                reach[np.arange(len(part)), home] = True
                row, cell = np.nonzero(reach)
                parts.append(part.iloc[row].assign(cell=cell, home=cell == home[row]))
            out = pd.concat(parts) if parts else pdf.assign(cell=0, home=True)
            yield pa.RecordBatch.from_pandas(out[["a", "w", "g", "cell", "home", "u"]], schema=pa.schema([("a", pa.int64()), ("w", pa.int64()), ("g", pa.string()), ("cell", pa.int32()), ("home", pa.bool_()), ("u", pa.list_(pa.float64()))]), preserve_index=False)

    dealt = materialize(nodes.select("a", "w", "g", "u").mapInArrow(deal, "a long, w long, g string, cell int, home boolean, u array<double>"), "vector-cells")
    blocks = dealt.groupBy("g", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("nb"))
    cut = dealt.join(blocks, ["g", "cell"]).withColumn("b", F.pmod(F.xxhash64("a"), F.col("nb")).cast("int"))
    cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1))).select(
        "g", "cell", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), (F.col("b") > F.col("other")).alias("second"), "a", "w", "home", "u"
    )

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        one = pdf["i"].iloc[0] == pdf["j"].iloc[0]
        x, y = (pdf, pdf) if one else (pdf[~pdf["second"]], pdf[pdf["second"]])
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "links": [], "b": []}).astype("int64")
        hit = np.stack(x["u"].to_numpy()) @ np.stack(y["u"].to_numpy()).T >= cosine
        ax, ay = x["a"].to_numpy(), y["a"].to_numpy()
        lesser = ax[:, None] < ay[None, :]
        hit &= np.where(lesser, x["home"].to_numpy()[:, None], y["home"].to_numpy()[None, :])
        hit &= lesser if one else ax[:, None] != ay[None, :]
        ids = np.concatenate([ax, ay])
        links = np.concatenate([hit @ y["w"].to_numpy(), hit.T @ x["w"].to_numpy()])
        at, where = np.unique(ids, return_inverse=True)
        total = np.bincount(where, links, len(at)).astype(np.int64)
        r, c = np.nonzero(hit)
        r, c = where[: len(ax)][r], where[len(ax) :][c]
        root = np.arange(len(at))
        while len(r):  # least label through all links, with pointer jumping
            new = root.copy()
            np.minimum.at(new, r, root[c])
            np.minimum.at(new, c, root[r])
            new = new[new]
            if (new == root).all():
                break
            root = new
        some = total > 0
        return pd.DataFrame({"a": at[some], "links": total[some], "b": at[root][some]})

    found = materialize(cut.groupBy("g", "cell", "i", "j").applyInPandas(join, "a long, links long, b long"), "vector-links")
    counts = found.groupBy("a").agg(F.sum("links").alias("links"))
    groups = components(found.select("a", "b"), "vector-groups").withColumnRenamed("node", "a")
    known = classes.join(counts, "a", "left").join(groups, "a", "left").select("h", F.col("a").alias("own"), (F.col("w") - 1 + F.coalesce("links", F.lit(0))).alias("links"), "component")
    return (
        ready.select("vec_id", F.when(F.col("vec_id").isNotNull(), F.col("h")).alias("h"))
        .join(known, "h", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "own", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
