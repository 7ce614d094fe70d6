import hashlib
import re

import pytest
from pyspark.sql import functions as F

from leafquery.llm import fingerprint
from leafquery.llm.common import table
from leafquery.llm.fingerprint import differences, fingerprints, peel, sketch, subtract

PIECE = re.compile(fingerprint._PIECE)


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: -r[0])
    out = {}
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        a, e, n = (set(PIECE.findall(t)) for t in (text, edited, after))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        out[i] = (len(text), hashlib.sha256(edited.encode()).hexdigest(), near(a, e), near(a, n), text)
    return out


def check(got, want):
    assert len(got) == len(want)
    by_text = {}
    for r in got:
        w = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == w[:2]
        assert r.near_edited == pytest.approx(w[2]) and r.near_next == pytest.approx(w[3])
        assert by_text.setdefault(w[4], r.fingerprint) == r.fingerprint
    assert len(set(by_text.values())) == len(by_text)


@pytest.mark.parametrize("part_bytes", [6 << 20, 5000])
def test_documents(spark, sf_dir, monkeypatch, part_bytes):
    monkeypatch.setattr(fingerprint, "PART_BYTES", part_bytes)
    docs = table(spark, sf_dir, "documents")
    got = fingerprints(docs).collect()
    check(got, brute([(r.doc_id, r.text) for r in docs.collect()]))
    assert sum(r.near_edited > r.near_next for r in got) > 0.9 * len(got)


def recovered(spark, rows, tries):
    table = spark.createDataFrame([(i, list(a), list(b)) for i, (a, b) in enumerate(rows)], "i int, a array<long>, b array<long>")
    found = differences(F.col("a"), F.col("b"), sketch(F.col("a"), F.lit(0)), sketch(F.col("b"), F.lit(0)), tries)
    got = {r.i: (r.x.in_a, r.x.in_b) for r in table.select("i", found.alias("x")).collect()}
    assert got == {i: (sorted(set(a) - set(b)), sorted(set(b) - set(a))) for i, (a, b) in enumerate(rows)}


@pytest.mark.parametrize("tries", [8, 2])
def test_peeling_returns_the_differing_digests(spark, tries):
    recovered(spark, [([], []), ([5], []), ([], [-7]), ([1, 2, 3], [3, 2, 1]), (range(-40, 60), range(30, 95)), ([0], [1])], tries)


def test_retries_give_the_same_differences(spark):
    recovered(spark, [(range(i), range(i // 2, i + 40 * (i % 3))) for i in range(0, 90, 7)] + [(range(3000), range(2990, 5000)), (range(4000), range(1, 4001))], 8)


def test_small_differences_are_peeled_from_the_fingerprints_alone(spark):
    """Without a retry: a few differences among many paragraphs leave nothing in the subtracted cells."""
    rows = spark.range(200).select(F.sequence(F.lit(0).cast("long"), F.col("id") + 50).alias("a"), F.sequence(F.lit(2).cast("long"), F.col("id") + 52).alias("b"))
    cells = subtract(sketch(F.col("a"), F.lit(0)), sketch(F.col("b"), F.lit(0)))
    got = rows.select("a", "b", peel(cells, F.lit(0)).alias("x")).collect()
    done = [r for r in got if not r.x.rest]
    assert len(done) > 180
    assert all(sorted(r.x.in_a) == [0, 1] and sorted(r.x.in_b) == [r.a[-1] + 1, r.a[-1] + 2] for r in done)


def test_odd_rows(spark):
    rows = [(5, None), (4, ""), (9, "One. Two.\nThree"), (7, "é😀 " * 20000), (-3, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("part", F.lit("p"))
    check(fingerprints(docs).collect(), brute(rows))
    again = spark.createDataFrame([(1, "a"), (1, "a"), (None, "b"), (None, None)], "doc_id long, text string")
    assert fingerprints(again).count() == 4
    assert fingerprints(docs.limit(0)).count() == 0
    check(fingerprints(spark.createDataFrame([(1, "only one")], docs.columns[:2])).collect(), brute([(1, "only one")]))


def test_no_python_in_the_plan(spark, sf_dir):
    plan = fingerprints(table(spark, sf_dir, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval"))
