import duckdb
import numpy as np
import pytest

from leafquery.llm import embedding
from leafquery.llm.embedding import near_vectors
from leafquery.llm.q_embedding import ORACLES, op3_embedding_near_dedup
from tests.llm.test_minhash import least_reachable


def brute(rows, cosine):
    ok = {}
    for i, e, label in rows:
        x = np.array([np.nan if v is None else v for v in e], np.float64) if e is not None else np.zeros(0)
        if label is not None and len(x) and np.isfinite(x).all() and x.any():
            ok[i] = (label, x / np.linalg.norm(x))
    links = [(a, b) for a in ok for b in ok if a < b and ok[a][0] == ok[b][0] and len(ok[a][1]) == len(ok[b][1]) and ok[a][1] @ ok[b][1] >= cosine]
    n = {i: 0 for i, _, _ in rows}
    for a, b in links:
        n[a] += 1
        n[b] += 1
    c = least_reachable(n, links)
    return {i: (n[i], c[i]) for i in n}


@pytest.mark.parametrize("cell, block", [(4096, 1024), (40, 16)])
def test_against_brute_force(spark, monkeypatch, cell, block):
    monkeypatch.setattr(embedding, "CELL", cell)
    monkeypatch.setattr(embedding, "BLOCK", block)
    rnd = np.random.default_rng(5)
    centres = rnd.normal(size=(12, 8))
    rows = []
    for i in range(500):
        x = centres[rnd.integers(12)] + rnd.normal(size=8) * rnd.choice([0, 0.05, 0.15, 2])
        rows.append((i * 7 % 3001, [float(v) for v in x], int(rnd.integers(2)) if i % 3 else 0))
    rows += [(5000 + k, [2.0 * v for v in rows[0][1]], rows[0][2]) for k in range(3)]
    rows += [(6000, None, 0), (6001, [0.0] * 8, 0), (6002, [float("nan")] * 8, 0), (6003, [None] * 8, 0), (6004, rows[0][1], None), (6005, [], 0), (6006, [1.0, 2.0], 0), (6007, [1.0, 2.0], 0), (6008, [-0.0, 1.0], 0), (6009, [0.0, 3.0], 0)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), 0.98).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == brute([(i, np.float32(e).tolist() if e and None not in e else e, y) for i, e, y in rows], 0.98)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_odd_rows(spark):
    rows = [(None, [1.0, 0.0], 1, "a"), (1, [1.0, 0.0], 1, "b"), (2, [1.0, 0.0], 1, None), (2, [1.0, 0.0], 1, None)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, h string"), 0.98).collect()
    assert sorted((r.vec_id or 0, r.n_links, r.component_id or 0, r.kept) for r in got) == [(0, 0, 0, True), (1, 2, 1, True), (2, 2, 1, False), (2, 2, 1, False)]
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<double>, label int")).count() == 0


def test_query_equals_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in op3_embedding_near_dedup(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf_dir}/embeddings.parquet'")
    assert got == sorted(con.execute(ORACLES["op3_embedding_near_dedup"]).fetchall())
