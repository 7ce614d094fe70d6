import random
from itertools import combinations

import duckdb
import numpy as np
import pytest

from leafquery.llm import components as components_module
from leafquery.llm import minhash
from leafquery.llm.common import materialize
from leafquery.llm.components import components
from leafquery.llm.minhash import needed_agreements, near_duplicates, shingle_set, signature
from leafquery.llm.q_minhash import ORACLES, op2_minhash_near_dedup


def least_reachable(nodes, links):
    at = {x: x for x in nodes}

    def root(x):
        while at[x] != x:
            x = at[x]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        at[y] = x
    return {x: root(x) for x in nodes}


def brute(rows, n, percent):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    return {i: (len(sets[i]), c) for i, c in least_reachable(sets, links).items()}


def check(spark, rows, n, percent):
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()
    want = brute(rows, n, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(rows)


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_edited_copies_against_brute_force(spark, n, percent):
    rnd = random.Random(n)
    vocabulary = [f"w{k}" for k in range(3000)]
    line = " ".join(rnd.choice(vocabulary) for _ in range(12))
    rows, base = [], [rnd.choice(vocabulary) for _ in range(120)]
    for i in range(220):  # one large group of near copies with edits around the limit
        words = list(base)
        for _ in range(rnd.randint(0, 9)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        rows.append((i * 3 % 997, " ".join(words)))
    for i in range(150):  # documents that share a line
        rows.append((2000 + i, line + "\n" + " ".join(rnd.choice(vocabulary) for _ in range(rnd.randint(1, 60)))))
    rows += [(3000 + i, f"A b {i % 2}") for i in range(6)] + [(3100, "a"), (3101, "A"), (3102, "a b"), (3103, ""), (3104, None), (3105, " \t")]
    check(spark, rows, n, percent)


def test_odd_rows(spark):
    rows = [(1, "a b c d", 7), (1, "a b c d", 7), (1, "x y z q", 8), (0, "A  B\tC d", 9), (None, "a b c d", 1), (None, None, 1), (5, "x y z q", None), (6, "k " * 30000, 1), (7, "k " * 29999, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id long"), 3, 85).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got if r.doc_id is not None) == [(0, 0, True), (1, 0, False), (1, 0, False), (1, 1, True), (5, 1, False), (6, 6, True), (7, 6, False)]
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


@pytest.mark.parametrize("ids", [1_000_000, 1])
def test_blank_rows_of_an_id_do_not_hide_its_text(spark, monkeypatch, ids):
    monkeypatch.setattr(minhash, "BROADCAST_IDS", ids)
    rows = []
    for i in range(0, 60, 2):
        text = " ".join(f"w{i}x{k}" for k in range(60))
        own = [(i, text), (i, (None, "", " \t")[i % 3])]
        rows += (own if i % 4 else own[::-1]) + [(i + 1, text + " more")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 5, 80).collect()
    want = [(i, 0, i) for i in range(0, 60, 2)] + [(i, 56, i) for i in range(0, 60, 2)] + [(i + 1, 57, i) for i in range(0, 60, 2)]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(want)


def test_query_equals_sql(spark, sf_dir):
    got = sorted(tuple(r) for r in op2_minhash_near_dedup(spark, sf_dir).collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    assert got == sorted(con.execute(ORACLES["op2_minhash_near_dedup"]).fetchall())


def test_signatures_agree_as_often_as_sets_are_alike():
    a, b = shingle_set(" ".join(map(str, range(5000))), 3), shingle_set(" ".join(map(str, range(500, 5500))), 3)
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((signature(a) == signature(b)).mean() - true) < 0.3
    assert needed_agreements(0.85) > needed_agreements(0.5) >= 1 and minhash.K == 32


def test_components_of_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, 400 + i) for i in range(50)] + [(7, 7), (9, None), (3, 2), (2, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 400 for i in (*range(400, 450), 500)}, 2: 2, 3: 2}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize("n, percent", [(3, 85), (5, 80)])
def test_excerpts_and_variants_of_one_text(spark, n, percent):
    """Classes that their pivot does not unite: excerpts of one text, copies with another passage, and edits of both."""
    rnd = random.Random(7 * n)
    base = [f"b{k}" for k in range(130)]
    others = [[f"o{v}x{k}" for k in range(rnd.randint(8, 30))] for v in range(4)]
    rows = []
    for i in range(420):
        words = list(base)
        if i % 3 == 0:
            low = rnd.randint(0, 45)
            words = words[low : low + rnd.randint(75, 110)]
        elif i % 3 == 1:
            words = words[: rnd.randint(95, 130)] + rnd.choice(others)
        for _ in range(rnd.randint(0, 6)):
            at = rnd.randrange(len(words))
            if rnd.random() < 0.4:
                del words[at]
            else:
                words[at] = f"e{rnd.randrange(400)}"
        rows.append((i * 7 % 2003, " ".join(words)))
    rows += [(5000 + i, " ".join(base)) for i in range(1500)]
    want = brute(rows[:430], n, percent)
    same = min([i for i, t in rows[:430] if t == " ".join(base)])
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), n, percent).collect()}
    assert {i: got[i] for i in want} == {i: c for i, (_, c) in want.items()}
    assert {got[5000 + i] for i in range(1500)} == {got[same]}


@pytest.mark.parametrize("links_of_a_task", [components_module.TASK_LINKS, 10])
def test_components_by_one_task_and_by_rounds(spark, monkeypatch, links_of_a_task):
    monkeypatch.setattr(components_module, "TASK_LINKS", links_of_a_task)
    rnd = random.Random(3)
    links = [tuple(rnd.randint(-(10**12), 10**12) if rnd.random() < 0.05 else rnd.randint(-80, 80) for _ in range(2)) for _ in range(120)]
    links += [(i, i + 1) for i in range(1000, 1040)] + [(None, 5), (7, 7), (2**62, -(2**62)), (2**62, 2000)]
    used = [x for x in links if None not in x and x[0] != x[1]]
    want = least_reachable({x for link in used for x in link}, used)
    got = components(spark.createDataFrame(links, "x long, y long")).collect()
    assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_the_driver_plans_few_shuffles_at_once(spark, monkeypatch):
    """Its memory goes with the shuffles of a plan and with the jobs of a run, not with the rows."""
    seen = {}

    def counted(df, label, *args, **kwargs):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[label] = max(seen.get(label, 0), sum(" Exchange " in line or "BroadcastExchange" in line for line in plan.splitlines()))
        return materialize(df, label, *args, **kwargs)

    monkeypatch.setattr(minhash, "materialize", counted)
    monkeypatch.setattr(components_module, "materialize", counted)
    spark.sparkContext.setJobGroup("near duplicates", "")
    try:
        components(spark.createDataFrame([(i, i + 1) for i in range(100)], "x long, y long")).collect()
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("near duplicates"))
        near_duplicates(spark.createDataFrame([(i, f"a b {i % 3} c d e f") for i in range(60)], "doc_id long, text string")).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs <= 12 and max(seen.values()) <= 24, (jobs, seen)
