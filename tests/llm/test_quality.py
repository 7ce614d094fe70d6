import zlib

import numpy as np

from leafquery.llm import quality
from leafquery.llm.common import table
from leafquery.llm.quality import FEATURES, N_STATS, _fourier, classify, isotonic, keep_good, statistics


def test_fourier_features_approximate_the_kernel():
    z = np.random.default_rng(0).normal(size=(40, N_STATS)) * 0.7
    phi = _fourier(z, 0.05)[:, :FEATURES]
    true = np.exp(-0.05 * ((z[:, None] - z[None]) ** 2).sum(-1))
    assert np.abs(phi @ phi.T - true).mean() < 0.07


def test_isotonic_equals_brute_force():
    rnd = np.random.default_rng(1)
    for _ in range(50):
        n = rnd.integers(1, 8)
        y, w = rnd.integers(0, 5, n).astype(float), rnd.integers(1, 4, n).astype(float)
        x, v = isotonic(np.arange(n, dtype=float), y, w)
        # max-min formula for isotonic regression
        want = [max(min(np.average(y[a : b + 1], weights=w[a : b + 1]) for b in range(i, n)) for a in range(i + 1)) for i in range(n)]
        assert np.allclose(np.interp(np.arange(n), x, v), want)


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    got = {r.doc_id: r for r in classify(docs, labels).collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    y = [(r.quality, got[r.doc_id]) for r in labels.collect()]
    test = [(q, r) for q, r in y if r.held_out]
    assert np.mean([q == r.predicted for q, r in test]) > 0.95
    pos, neg = [r.score for q, r in test if q], [r.score for q, r in test if not q]
    assert np.mean([(a > b) + (a == b) / 2 for a in pos for b in neg]) > 0.97


def test_fit_and_scores_equal_a_direct_computation(spark, monkeypatch):
    """The ridge fit from summed normal equations, the calibration and every score, anew in numpy from the raw texts."""
    monkeypatch.setattr(quality, "BINS", 64)
    rnd = np.random.default_rng(4)
    vocabulary = [f"{a}{b}" for a in ("the", "run", "Zq", "99", "!!") for b in ("", "s", "ing", "#")]
    rows = [(int(i), " ".join(rnd.choice(vocabulary, rnd.integers(0, 60)))) for i in range(260)]
    marks = [(i, int(rnd.random() < (0.8 if "the" in t else 0.3))) for i, t in rows if i % 5]
    got = {r.doc_id: r for r in classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int")).collect()}

    part = {i: zlib.crc32(str(i).encode()) % 4 for i, _ in rows}
    x = {i: statistics(t) for i, t in rows}
    seen = [(i, y) for i, y in marks if part[i] != 2]
    every = np.stack([x[i] for i, _ in seen])
    mean, scale = every.mean(0), np.maximum(every.std(0), 1e-3)
    phi = lambda ids: _fourier(np.clip((np.stack([x[i] for i in ids]) - mean) / scale, -5, 5), 0.05)
    fitted = [(i, y) for i, y in seen if part[i] != 3]
    f, y = phi([i for i, _ in fitted]), np.array([y for _, y in fitted], float)
    w = np.linalg.solve(f.T @ f + len(f) * quality.RIDGE * np.eye(f.shape[1]), f.T @ y)
    held = [(i, y) for i, y in seen if part[i] == 3]
    assert len(held) >= 20
    bins = (np.clip((phi([i for i, _ in held]) @ w + 0.5) / 2, 0, 1) * 64).astype(int)
    by_bin = {b: [y for (_, y), c in zip(held, bins, strict=True) if c == b] for b in sorted(set(bins))}
    mid, ys, ns = [(b + 0.5) / 64 * 2 - 0.5 for b in by_bin], [np.mean(v) for v in by_bin.values()], [len(v) for v in by_bin.values()]
    level = [max(min(np.average(ys[a : b + 1], weights=ns[a : b + 1]) for b in range(i, len(ys))) for a in range(i + 1)) for i in range(len(ys))]
    want = np.clip(np.interp(phi([i for i, _ in rows]) @ w, mid, level), 0, 1)
    assert np.allclose([got[i].score for i, _ in rows], want, atol=1e-6)
    assert all(got[i].held_out == (part[i] == 2) and got[i].predicted == (got[i].score >= 0.7) for i, _ in rows)


def test_odd_rows(spark):
    good, bad = "The cat sat on the mat. It was glad of it.\n" * 3, "BUY!! NOW!! ###$$$ "
    rows = [(i, (good if i % 3 else bad) * (1 + i % 4), "en") for i in range(400)] + [(None, good, None), (None, None, None), (5, "", "x"), (7, bad * 5000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part string")
    labels = spark.createDataFrame([(i, 1 if i % 3 else 0, "z") for i in range(400)] + [(None, 1, "z"), (9, None, "z"), (9, 4, None)], "doc_id long, quality int, text string")
    got = classify(docs, labels).collect()
    assert len(got) == len(rows) and not any(r.held_out for r in got if r.doc_id is None)
    kept = keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect() if r.text and r.text.startswith("BUY")} == set()
    assert {r.doc_id for r in kept.collect() if r.text and r.text.startswith("The")} >= {i for i in range(400) if i % 3}
    none = spark.createDataFrame([], labels.schema)
    assert all(r.score == 1 for r in classify(docs, none).collect())
    assert classify(docs.limit(0), labels).count() == 0 and keep_good(docs, none).count() == len(rows)
    assert statistics("").shape == (N_STATS,) and np.isfinite(statistics("\n \t")).all()
