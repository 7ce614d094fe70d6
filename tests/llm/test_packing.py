import random
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from leafquery.llm import packing
from leafquery.llm.common import table
from leafquery.llm.packing import best_fit, cost, pack, pack_group


def check(rows, sizes, lengths):
    bins, docs = defaultdict(list), defaultdict(list)
    for r in rows:
        bins[r.bin_id].append(r)
        docs[r.doc_id].append(r)
    for part in bins.values():
        part.sort(key=lambda r: r["at"])
        assert [r["at"] for r in part] == [sum(x.n_tokens for x in part[:k]) for k in range(len(part))]
        held = sum(r.n_tokens for r in part)
        assert {r.capacity for r in part} == {min(c for c in lengths if c >= held)}
    for i, n in sizes.items():
        part = sorted(docs[i], key=lambda r: r.piece)
        assert [r.piece for r in part] == list(range(len(part))) and sum(r.n_tokens for r in part) == n
        assert [r["first"] for r in part] == [sum(x.n_tokens for x in part[:k]) for k in range(len(part))]
        assert all(r.n_tokens == max(lengths) for r in part[:-1])
    return sum(len(p) and p[0].capacity for p in bins.values())


def test_documents(spark, sf_dir, monkeypatch):
    lengths = (1024, 2048, 4096, 8192, 16384)
    docs = table(spark, sf_dir, "documents")
    sizes = {r.doc_id: len((r.text or "").encode()) + 1 for r in docs.collect()}
    total = sum(sizes.values())
    for tokens in (16 << 20, 50_000):
        monkeypatch.setattr(packing, "GROUP_TOKENS", tokens)
        assert check(pack(docs).collect(), sizes, lengths) < 1.12 * total


def test_small_cases_are_near_the_optimum():
    rnd, lengths = random.Random(2), [4, 7, 12]
    for _ in range(60):
        sizes = sorted((rnd.randint(1, 12) for _ in range(rnd.randint(1, 6))), reverse=True)
        best = min(
            sum(cost(min(c for c in lengths if c >= x)) for x in held if x)
            for put in product(range(len(sizes)), repeat=len(sizes))
            if max(held := [sum(s for s, b in zip(sizes, put) if b == k) for k in range(len(sizes))]) <= 12
        )
        bins, _, final = pack_group(sizes, lengths)
        got = sum(map(cost, final))
        assert got == best <= min(best_fit(sizes, lengths, c)[3] for c in (None, *lengths))


@pytest.mark.parametrize("fixed, least", [(32, 0), (300, 1), (900, 1)])
def test_large_groups_are_cheaper_than_with_one_length(monkeypatch, fixed, least):
    monkeypatch.setattr(packing, "cost", lambda length: fixed + length + length * length / 65536)
    cost = packing.cost
    rnd, lengths = random.Random(5), [1024, 2048, 4096, 8192, 16384]
    gain = 0
    for _ in range(6):
        sizes = sorted((min(16384, int(rnd.lognormvariate(7, 1.2)) + 1) for _ in range(400)), reverse=True)
        bins, offsets, final = pack_group(sizes, lengths)
        held = defaultdict(list)
        for size, b, at in zip(sizes, bins, offsets, strict=True):
            held[b].append((at, size))
        for b, part in held.items():
            part.sort()
            assert [at for at, _ in part] == [sum(s for _, s in part[:k]) for k in range(len(part))]
            assert final[b] == min(c for c in lengths if c >= sum(s for _, s in part))
        one = min(best_fit(sizes, lengths, c)[3] for c in lengths)
        got = sum(map(cost, final))
        assert got <= one
        gain += got < one
    assert gain >= least


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "x" * 100_000), (None, "abc"), (4, "y"), (5, "é" * 600)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit("n")).withColumn("g", F.lit(1))).collect()
    check(got, {1: 1, 2: 1, 3: 100_001, None: 4, 4: 2, 5: 1201}, (1024, 2048, 4096, 8192, 16384))
    many = pack(spark.createDataFrame([(9, "a")] * 3000, "doc_id long, text string"), lengths=(16, 64)).collect()
    assert len(many) == 3000 and sum({r.bin_id: r.capacity for r in many}.values()) < 6200
    assert len(pack(spark.createDataFrame([(9, "a")] * 5, "doc_id long, text string")).collect()) == 5
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
