import corpus_pipeline
from leafquery.llm.common import table
from leafquery.llm.quality import classify
from tests.llm.test_minhash import brute
from tests.llm.test_packing import check
from tests.llm.test_secrets import planted


def test_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in classify(docs, table(spark, sf_dir, "labels")).collect() if r.predicted}
    groups = brute([(i, texts[i]) for i in good], 5, 80)
    kept = {i for i in good if groups[i][1] == i}
    assert 0 < len(kept) < len(good) < len(texts)
    sizes = {}
    for i in kept:
        text = texts[i]
        for at, v in reversed(planted(text)):
            text = text[:at] + "[SECRET]" + text[at + len(v) :]
        sizes[i] = len(text.encode()) + 1
    check(corpus_pipeline.run(spark, sf_dir).collect(), sizes, (1024, 2048, 4096, 8192, 16384))


def test_columns_and_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "same words in here again and again", "en", "a", 3), (2, "", "en", "a", 0), (2, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    for _, stage in corpus_pipeline.STAGES[1:3]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 4
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_first_and_last_stage_on_odd_rows(spark, sf_dir):
    rows = [(1, None, None, None, None), (None, "same words in here again and again", "en", "a", 3), (2, "", "en", "a", 0), (2, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, table(spark, sf_dir, "documents").schema)
    kept = corpus_pipeline.quality(spark, docs, sf_dir)
    assert kept.columns == docs.columns and kept.count() <= 4
    assert corpus_pipeline.quality(spark, docs.limit(0), sf_dir).count() == 0
    pieces = corpus_pipeline.packing(spark, docs, sf_dir).collect()
    assert sorted(r.n_tokens for r in pieces) == [1, 1, 1, len(rows[1][1]) + 1]
    assert corpus_pipeline.packing(spark, docs.limit(0), sf_dir).count() == 0


def test_one_row_of_each_group_stays_whatever_its_id(spark, sf_dir):
    text = " ".join(f"w{k}" for k in range(60))
    other = "quite another text " + " ".join(f"v{k}" for k in range(40))
    rows = [(7, text), (3, text + " more"), (3, text + " more"), (None, text), (None, other), (None, other + " end"), (5, ""), (5, "")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], table(spark, sf_dir, "documents").schema)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()]
    assert sorted(got, key=str)[:2] == [(3, text + " more"), (5, "")] and len(got) == 4
    assert got.count((5, "")) == 2 and sum(i is None and t.startswith(other) for i, t in got) == 1
