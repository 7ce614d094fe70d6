"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

The statistics depend on the text alone. Random Fourier features approximate a Gaussian kernel over them; each
partition of the labelled rows sums its part of the normal equations, and the driver adds a fixed number of such sums.
A third of the training rows is kept from the fit to calibrate its scores by isotonic regression.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquery.llm.common import materialize, short_batches, texts_of

#: Cosine features, ridge penalty per row, partitions that sum equations, bins of raw scores for the calibration.
FEATURES, RIDGE, SUMS, BINS = 256, 1e-4, 16, 1024
#: At most about so many labelled rows are used to fit, chosen by a hash of the id.
MOST_LABELLED = 400_000
SEED = 11

_CLASS = np.zeros(256, np.int64)  # upper, lower, digit, space, line end, sentence mark, other mark, beyond ASCII
for _i in range(256):
    _c = chr(_i)
    _CLASS[_i] = 7 if _i > 127 else 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 4 if _c == "\n" else 3 if _c.isspace() else 5 if _c in ".,;:'\"-?()" else 6
N_STATS = 21


def statistics(text: str) -> np.ndarray:
    """N_STATS numbers of the whole text; all zero for the empty text."""
    out = np.zeros(N_STATS)
    data = text.encode("utf-8", "surrogatepass")
    if not data:
        return out
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    share = np.bincount(_CLASS, bytes_, 8) / len(data)
    words = data.lower().split()
    n = max(1, len(words))
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = bytes_[bytes_ > 0] / len(data)
    out[:8] = np.sqrt(share)
    out[8] = np.log1p(len(data))
    out[9] = np.log1p(len(words))
    out[10] = np.log1p(len(lines))
    out[11] = min(30.0, (len(data) - n) / n) / 10
    distinct = len(set(words))
    out[12] = distinct / n
    out[13] = np.log1p(distinct) / (1 + np.log1p(n))
    out[14] = np.sqrt(sum(map(eq, words, words[1:])) / n)
    out[15] = np.sqrt(1 - len(set(lines)) / max(1, len(lines)))
    out[16] = -(p * np.log2(p)).sum() / 4
    out[17] = np.sqrt(bytes_[ord("!")] / n)
    out[18] = np.sqrt(bytes_[ord("|")] / n)
    out[19] = np.sqrt(bytes_[[ord(c) for c in "#$%&*@<>{}[]\\^~=+_"]].sum() / n)
    out[20] = np.sqrt(bytes_[[ord("."), ord("?")]].sum() / n)
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    gamma: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return _fourier(self.standard(x), self.gamma) @ self.weights

    def standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -5, 5)

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def _fourier(z: np.ndarray, gamma: float) -> np.ndarray:
    """cos(wx + b) for Gaussian w: inner products approximate exp(-gamma |x - y|^2); and a constant."""
    rnd = np.random.default_rng(SEED)
    w = rnd.normal(size=(N_STATS, FEATURES)) * np.sqrt(2 * gamma)
    b = rnd.uniform(0, 2 * np.pi, FEATURES)
    return np.hstack([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(z), 1))])


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots of the non-decreasing fit of y on ascending x with weights w, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for xi, yi, wi in zip(x.tolist(), y.tolist(), w.tolist(), strict=True):
        pools.append([yi, wi, xi, xi])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            b, a = pools.pop(), pools.pop()
            total = a[1] + b[1]
            pools.append([(a[0] * a[1] + b[0] * b[1]) / total, total, a[2], b[3]])
    knots, values = [], []
    for value, _, low, high in pools:
        for at in (low, high) if high > low else (low,):
            knots.append(at)
            values.append(value)
    return np.array(knots), np.array(values)


def document_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, part (crc32 of the id as text, modulo 4; null without an id), stats."""
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [statistics(t) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "part", "stats"])

    part = F.pmod(F.crc32(F.col(id_col).cast("long").cast("string").cast("binary")), F.lit(4)).cast("int")
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), part.alias("part"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, part int, stats array<double>")


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).flatten().to_numpy(zero_copy_only=False).reshape(-1, N_STATS)


def fit(stats: DataFrame, labels: DataFrame, label_col: str = "quality", gamma: float = 0.05) -> Model | None:
    """stats as from document_statistics, labels with doc_id and a label of 0 or 1. Rows of part 2 are never used.

    Null and other labels are left out; of an id's several labels all count. None if no labelled row is left.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where("doc_id is not null and y in (0, 1)")
    rows = stats.where("part != 2").join(y, "doc_id").select("doc_id", "part", "stats", "y")
    n = rows.count()
    if not n:
        return None
    if n > MOST_LABELLED:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 30)) < int(MOST_LABELLED / n * (1 << 30)))
    rows = materialize(rows.repartition(SUMS), "quality-labelled")
    got = rows.agg(*[f(F.col("stats")[k]).alias(f"{n}{k}") for k in range(N_STATS) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    model = Model(np.array([got[f"m{k}"] for k in range(N_STATS)]), np.array([max(got[f"s{k}"], 1e-3) for k in range(N_STATS)]), np.zeros(FEATURES + 1), np.array([0.0]), np.array([1.0]), gamma)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b, m = np.zeros((FEATURES + 1, FEATURES + 1)), np.zeros(FEATURES + 1), 0
        for batch in batches:
            phi = _fourier(model.standard(_matrix(batch, "stats")), gamma)
            a += phi.T @ phi
            b += phi.T @ batch.column(1).to_numpy()
            m += len(phi)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary()), pa.array([m], pa.int64())], names=["a", "b", "m"])

    # the fit takes parts 0 and 1; part 3 calibrates, unless there are too few rows to spare some
    spare = rows.where("part = 3").agg(F.count("*"), F.countDistinct("y")).first()
    apart = spare[0] >= 20 and spare[1] == 2
    parts = (rows.where("part != 3") if apart else rows).select("stats", "y").coalesce(SUMS).mapInArrow(sums, "a binary, b binary, m long").collect()  # SUMS rows
    a = sum(np.frombuffer(r.a).reshape(FEATURES + 1, -1) for r in parts)
    b = sum(np.frombuffer(r.b) for r in parts)
    model.weights = np.linalg.solve(a + max(1, sum(r.m for r in parts)) * RIDGE * np.eye(FEATURES + 1), b)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.clip((model.raw(_matrix(batch, "stats")) + 0.5) / 2, 0, 1) * BINS).cast(pa.int32(), safe=False), batch.column(1)], names=["bin", "y"])

    held = (rows.where("part = 3") if apart else rows).select("stats", "y")
    counted = sorted(held.mapInArrow(score, "bin int, y int").groupBy("bin").agg(F.count("*").alias("n"), F.sum("y").alias("s")).collect())  # BINS rows
    x, n_, s = (np.array(c, float) for c in zip(*counted, strict=True))
    model.knots, model.values = isotonic((x + 0.5) / BINS * 2 - 0.5, (s + 0.5) / (n_ + 1) if len(x) < 3 else s / n_, n_)
    return model


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, held_out, score (0 to 1, higher: label 1 likelier), predicted (score >= threshold).

    Null texts count as empty, and empty texts are scored by their statistics like any other. Rows without an id are
    scored and never held out. Repeated rows are all returned. Further columns are ignored. Without any usable label
    every score is 1, so that nothing is rejected for want of a model. An empty table gives an empty result.
    """
    stats = materialize(document_statistics(docs, id_col, text_col), "quality-statistics")
    model = fit(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(_matrix(batch, "stats")) if model else np.ones(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p == 2 for p in batch.column(1).to_pylist()]), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return stats.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, with their columns, whose text is not rejected. The fit and the decision are those of classify."""
    stats = materialize(document_statistics(docs), "quality-statistics")
    model = fit(stats, labels)
    if model is None:
        return docs
    short_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([statistics(t) for t in texts_of(batch)]) if batch.num_rows else np.zeros((0, N_STATS))
            yield batch.filter(pa.array(model.score(x) >= threshold))

    return docs.mapInArrow(run, docs.schema)
