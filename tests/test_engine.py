import json

import pytest
from pyspark.sql import functions as F

from leafquery.api import Engine
from leafquery.functions import text as fn
from leafquery.functions.names import normalize
from leafquery.lang.lexer import QueryError
from leafquery.streaming.pages import query_stream, read_pages, start

CARDS = """<main id=content><section class="result card" data-kind=flight><h3>Tokyo</h3><span class=stop>1 stop</span></section>
<section class="result card" data-kind=hotel><h3>Kyoto</h3><p class=summary>Near station</p></section></main>"""


@pytest.fixture(scope="module")
def cards(spark):
    return Engine.of_html(spark, CARDS)


def rows(engine, text):
    df = engine.execute(text)
    return [tuple(r) for r in df.drop("doc_id").collect()]


def test_missing_values_differ_only_on_the_value_path(cards):
    assert rows(cards, "SELECT section.data-kind FROM doc WHERE attributes.none <> 'x'") == []
    assert len(rows(cards, "SELECT section.data-kind FROM doc WHERE LOWER(none) <> 'x'")) == 2
    assert rows(cards, "SELECT s.data-kind FROM doc AS s JOIN doc AS h ON h.parent_id = s.node_id WHERE s.none <> 'x'") == []


def test_class_equality_differs_between_runtimes(cards):
    assert len(rows(cards, "SELECT section.data-kind FROM doc WHERE class = 'card'")) == 2
    assert rows(cards, "SELECT s.data-kind FROM doc AS s JOIN doc AS h ON h.parent_id = s.node_id AND h.tag = 'h3' WHERE s.class = 'card'") == []
    assert len(rows(cards, "SELECT s.data-kind FROM doc AS s JOIN doc AS h ON h.parent_id = s.node_id AND h.tag = 'h3' WHERE s.class = 'result card'")) == 2


def test_project_keeps_rows_without_suppliers(cards):
    assert rows(cards, "SELECT PROJECT(section) AS (a: TEXT(h3), b: TEXT(span), c: COALESCE(b, TEXT(p), 'none')) FROM doc WHERE class = 'result'") == [("Tokyo", "1 stop", "1 stop"), ("Kyoto", None, "Near station")]


def test_bytes_and_ascii(spark):
    e = Engine.of_html(spark, "<div class=a>é ÀB</div>")
    assert rows(e, "SELECT LENGTH(TEXT(self)) AS n, LOWER(TEXT(self)) AS l, POSITION('B' IN TEXT(self)) AS p, SUBSTRING(TEXT(self), 1, 2) AS s FROM doc WHERE class = 'a'") == [(6, "é Àb", 6, "é")]
    v = spark.range(1).select(fn.compare("<", F.lit("9"), F.lit("10")), fn.compare("<", F.lit("9"), F.lit("1a")), fn.compare("=", F.lit(" 7"), F.lit("07")), fn.like(F.lit("a\\b"), "A\\_"), fn.regex_replace(F.lit("ab"), "(", "x"), fn.regex_replace(F.lit("ab"), "a", "<$&>")).first()
    assert tuple(v) == (True, False, True, True, None, "<a>b")


@pytest.mark.parametrize(
    "text, code",
    [
        ("SELECT * EXCLUDE colour FROM doc", "SEM-0205"),
        ("SELECT COUNT(*), a.href FROM doc", "SEM-0301"),
        ("SELECT TEXT(div) FROM doc WHERE tag = 'div'", "SEM-0304"),
        ("SELECT a.href, b.id FROM doc WHERE tag = 'a'", "SEM-0302"),
        ("SELECT a FROM doc LIMIT 100001", "SEM-0501"),
        ("SELECT a, b.href FROM doc", "SEM-0303"),
        ("SELECT a FROM doc TO LIST()", "SEM-0401"),
        ("SELECT a FROM doc AS x JOIN doc AS X ON x.a = x.a", "SEM-0201"),
    ],
)
def test_checks(cards, text, code):
    with pytest.raises(QueryError) as e:
        cards.execute(text)
    assert e.value.code == code
    assert [f.code for f in cards.lint(text)] == [code]


def test_lint_warns_of_misspelt_functions(cards):
    assert [f.code for f in cards.lint("SELECT section.data-kind FROM doc WHERE LENGHT(data-kind) > 3")] == ["LINT-0002"]
    assert cards.lint("SELECT section.data-kind FROM doc WHERE LENGTH(data-kind) > 3") == []


def test_outputs(spark, cards, tmp_path):
    for kind in ("CSV", "PARQUET", "JSON", "NDJSON"):
        cards.execute(f"SELECT section.data-kind, self.attributes FROM doc WHERE class = 'card' TO {kind}('{tmp_path}/{kind}')", single=True)
    lines = [r.value for r in spark.read.text(f"{tmp_path}/CSV").collect()]
    assert lines == ["data-kind,attributes", 'flight,"{class=result card,data-kind=flight}"', 'hotel,"{class=result card,data-kind=hotel}"']
    assert {json.loads(r.value)["data-kind"] for r in spark.read.text(f"{tmp_path}/NDJSON").collect()} == {"flight", "hotel"}
    (whole,) = [r.value for r in spark.read.text(f"{tmp_path}/JSON", wholetext=True).collect()]
    assert [x["data-kind"] for x in json.loads(whole)] == ["flight", "hotel"]
    cards.execute(f"SELECT section.data-kind FROM doc WHERE class = 'none' TO JSON('{tmp_path}/none')")
    assert json.loads("".join(r.value for r in spark.read.text(f"{tmp_path}/none").collect())) == []
    assert spark.read.parquet(f"{tmp_path}/PARQUET").count() == 2


def test_pages_without_rows_and_nulls(spark):
    pages = spark.createDataFrame([(1, "a", None), (2, None, ""), (3, "c", "<p>x</p>")], "page_id long, url string, html string")
    e = Engine.of_table(spark, pages)
    assert sorted(tuple(r) for r in e.execute("SELECT COUNT(p) FROM doc").collect()) == [(1, 0), (2, 0), (3, 1)]
    assert Engine.of_table(spark, pages.limit(0)).execute("SELECT p.text FROM doc").count() == 0


def test_tfidf_over_a_corpus_keeps_documents_apart(spark):
    pages = spark.createDataFrame([(k, None, f"<html><body><p>{w}</p></body></html>") for k, w in ((1, "apple pear"), (2, "apple plum"))], "page_id long, url string, html string")
    got = {r.doc_id: r.terms_score for r in Engine.of_table(spark, pages, scope="corpus").execute("SELECT TFIDF(p) FROM doc").collect()}
    assert {k: set(m) for k, m in got.items()} == {1: {"apple", "pear"}, 2: {"apple", "plum"}}
    assert got[1]["apple"] == got[2]["apple"] < got[1]["pear"] == got[2]["plum"]


def test_stream(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/pages.parquet").write.parquet(f"{tmp_path}/in")
    text = "SELECT h1.node_id FROM doc WHERE parent.tag = 'article'"
    start(query_stream(spark, read_pages(spark, f"{tmp_path}/in"), text), f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    want = Engine.of_table(spark, spark.read.parquet(f"{sf_dir}/pages.parquet")).execute(text)
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, want.collect()))


def test_axes_need_no_shuffle(spark, sf_dir):
    e = Engine.of_table(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    df = e.execute("SELECT a.href FROM doc WHERE ancestor.tag = 'nav' AND EXISTS(parent WHERE tag = 'li') ORDER BY node_id LIMIT 3")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_table_export(spark, tmp_path):
    e = Engine.of_html(spark, "<table id=a><tr><th>k</th><th>a \"q\", b</th></tr><tr><td>1</td></tr></table><table id=b><tr><td>x</td></tr></table>")
    with pytest.raises(QueryError):
        e.execute(f"SELECT table FROM doc TO CSV('{tmp_path}/two')")
    read = lambda name: [r.value for r in spark.read.text(f"{tmp_path}/{name}").collect()]
    e.execute(f"SELECT table FROM doc WHERE id = 'a' TO CSV('{tmp_path}/head')")
    assert read("head") == ['k,"a ""q"", b"', "1,"]
    e.execute(f"SELECT table FROM doc WHERE id = 'a' TO TABLE(HEADER=OFF, EXPORT='{tmp_path}/plain')")
    assert read("plain") == ["col1,col2", 'k,"a ""q"", b"', "1,"]
    e.execute(f"SELECT table FROM doc WHERE id = 'b' TO PARQUET('{tmp_path}/parquet')")
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/parquet").collect()] == [("x",)]
    with pytest.raises(QueryError):
        e.execute(f"SELECT table FROM doc WHERE id = 'a' TO TABLE(FORMAT=SPARSE, SPARSE_SHAPE=WIDE, EXPORT='{tmp_path}/wide')")


def test_patterns_and_replacements(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    for pattern, new, x, want in [
        ("[0-9]+", "US$5", "a12b", "aUSb"), ("([a-z])([0-9])", "$2$1$$", "a1", "1a$"), ("b", "$", "abc", "a$c"), ("b", "\\", "abc", "a\\c"), ("x", "<$&>", "x", "<x>"),
        ("(?P<n>x)", "y", "x", None), ("(?<n>x)", "y", "x", None), ("x++", "y", "x", None), ("[[]", "y", "a[b", "ayb"), ("[a&&b]", "-", "a&b", "---"), ("a[^]c", "y", "abc", "y"),
    ]:
        assert one(fn.regex_replace(F.lit(x), pattern, new)) == want, pattern
    e = Engine.of_html(spark, "<p id=x>ax</p>")
    assert rows(e, "SELECT REGEX_REPLACE(TEXT(p), CONCAT('[', id, ']'), '$&$&') AS r, REGEX_REPLACE(TEXT(p), CONCAT('[', 'a]'), '') AS s FROM doc WHERE id = 'x'") == [("axx", "x")]


def test_cuts_through_characters(spark):
    row = spark.range(1).select(fn.substring(F.lit("aé…"), F.lit(1), F.lit(2)), fn.locate(F.lit("p"), F.lit("aé price"), F.lit(3)), fn.locate(F.lit(""), F.lit("abc"), F.lit(4)), fn.locate(F.lit(""), F.lit("abc"), F.lit(5)), fn.substring(F.lit("abc"), F.lit(2), F.lit(None).cast("int"))).first()
    assert tuple(row) == ("a\ufffd", 5, 4, 0, "bc")


def test_minify_keeps_what_is_preformatted(spark):
    got = lambda h: spark.range(1).select(fn.minify(F.lit(h))).first()[0]
    assert got("<pre>x\n  y</pre>  <b>a  b</b>\n<i>c</i> d  ") == "<pre>x\n  y</pre><b>a b</b><i>c</i> d "
    assert got("<p a='x > y'> <code> 1\n 2</code>\n</p> <!-- a  b --> <br/> t") == "<p a='x > y'><code> 1\n 2</code></p><!-- a  b --><br/> t"
    assert got("<textarea>  q </textarea") == "<textarea>  q </textarea"


def test_relations_of_a_document(spark):
    e = Engine.of_html(spark, "<ul><li class=a>x1<b>q</b></li><li class=b>y</li></ul><p title=it's>Hello</p>")
    assert rows(e, "SELECT p.title, p.text FROM doc") == [("it's", "Hello")]
    assert rows(e, "SELECT a.tag, b.class FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id AND b.tag = 'li' WHERE a.child.class = 'a' AND EXISTS(child WHERE tag = 'li') AND b.descendant.tag = 'b'") == [("ul", "a")]
    assert rows(e, "SELECT COUNT(*) FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id WHERE a.tag = 'zz'") == [(0,)]
    assert sorted(rows(e, "SELECT u.tag, c.n FROM doc AS u CROSS JOIN LATERAL (SELECT COUNT(*) AS n FROM doc AS x WHERE x.parent_id = u.node_id) AS c WHERE u.tag IN ('ul', 'p', 'li')")) == [("li", 0), ("li", 1), ("p", 0), ("ul", 2)]


def test_joins_parse_pages_once(spark, sf_dir):
    e = Engine.of_table(spark, spark.read.parquet(f"{sf_dir}/pages.parquet"))
    df = e.execute("SELECT a.tag, b.text AS t FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id WHERE a.tag = 'article' AND b.tag = 'h1'")
    assert df.count() > 0
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("MapInArrow") == 1 and "ReusedExchange" in plan


def test_column_names():
    assert normalize(["left", "Select", "a__b", " 1 x", "é", "x", "x"]) == ["left", "select_", "a_b", "c_1_x", "col", "x", "x__2"]


def test_summarize_counts_in_the_row(spark):
    """no exchange, whatever the tags."""
    pages = spark.createDataFrame([(1, "a", "<p>x<p>y<b>z</b>"), (2, "b", None), (3, "c", "")], "page_id long, url string, html string")
    df = Engine.of_table(spark, pages).execute("SELECT SUMMARIZE(*) FROM doc")
    assert sorted(tuple(r) for r in df.collect()) == [(1, "b", 1), (1, "body", 1), (1, "html", 1), (1, "p", 2)]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


JOINS = [
    "SELECT u.node_id, c.no FROM doc AS u CROSS JOIN LATERAL (SELECT x.data-no AS no FROM doc AS x WHERE x.parent_id = u.node_id ORDER BY x.data-no DESC, x.node_id LIMIT 2) AS c WHERE u.tag = 'ul'",
    "SELECT u.tag, c.n FROM doc AS u CROSS JOIN LATERAL (SELECT COUNT(*) AS n FROM doc AS x WHERE x.parent_id = u.node_id AND x.text > 40) AS c WHERE u.tag <> 'b'",
    "SELECT u.node_id, c.node_id AS k FROM doc AS u CROSS JOIN LATERAL (SELECT self FROM doc AS x WHERE x.class = u.class AND EXISTS(child WHERE tag = 'b') ORDER BY class LIMIT 3) AS c WHERE u.parent.tag = 'ul'",
    "SELECT u.tag, c.t, d.n FROM doc AS u CROSS JOIN LATERAL (SELECT x.text AS t FROM doc AS x WHERE x.parent_id = u.node_id) AS c CROSS JOIN LATERAL (SELECT COUNT(*) AS n FROM doc AS y WHERE y.text = c.t) AS d WHERE u.tag = 'ul' ORDER BY u.node_id DESC",
    "WITH l AS (SELECT li.node_id AS id, li.data-no AS no FROM doc WHERE class = 'a'), c AS (SELECT s.parent_id AS id, s.class AS cls, s.text AS v FROM doc AS s WHERE s.tag = 'b') SELECT l.no, q.v AS x, p.v AS y FROM l LEFT JOIN c AS q ON q.id = l.id AND q.cls = 'k' LEFT JOIN c AS p ON p.id = l.id AND p.v <> 'z' ORDER BY l.no DESC",
    "WITH l AS (SELECT li.node_id AS id, li.data-no AS no FROM doc WHERE tag = 'li' ORDER BY node_id DESC LIMIT 3) SELECT l.no, d.tag FROM l JOIN doc AS d ON l.id = d.parent_id WHERE d.class = 'k' ORDER BY d.node_id LIMIT 2",
    "WITH l AS (SELECT li.node_id AS id FROM doc WHERE tag = 'li') SELECT COUNT(*) AS n FROM l JOIN doc AS d ON l.id = d.parent_id AND d.parent.class = 'a'",
    "SELECT d.no, e.parent_id FROM (SELECT li.node_id AS id, li.data-no AS no FROM doc WHERE class = 'a') AS d LEFT JOIN (SELECT b.class AS k FROM doc WHERE tag = 'b') AS e ON e.parent_id = d.node_id AND d.no = e.k",
    "SELECT d.no, e.text FROM (SELECT li.data-no AS no FROM doc WHERE tag = 'li') AS d JOIN doc AS e ON e.parent_id = d.node_id AND e.class = d.no",
]


@pytest.mark.parametrize("text", JOINS)
@pytest.mark.parametrize("scope", ["document", "corpus"])
def test_joins_in_the_row_give_what_relations_give(spark, monkeypatch, text, scope):
    """LATERAL and joins of CTEs and derived tables shuffled every page; they stay in its row."""
    import random

    from leafquery.plans import inrow

    rnd = random.Random(3)
    lis = lambda n: "".join(f"<li class={rnd.choice('abc')} data-no={rnd.choice(['1', '2', 'x', '10'])}>{rnd.choice(['50', '7', 'w'])}" + "".join(f"<b class={rnd.choice(['k', '2', 'x'])}>{rnd.choice(['41', 'z', ''])}</b>" for _ in range(rnd.randint(0, 3))) + "</li>" for _ in range(n))
    pages = [(k, "u", f"<ul>{lis(k % 5)}</ul><div><ul>{lis(k)}</ul></div>") for k in range(12)] + [(90, "u", None), (91, "u", f"<ul>{lis(70)}</ul>")]
    e = Engine(spark, spark.createDataFrame(pages, "doc_id long, source_uri string, html string"), scope)
    monkeypatch.setattr(inrow, "CHUNK", 8)
    got = e.execute(text)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "LIMIT 2" in text[-8:] or "COUNT" in text[:120] or "Exchange" not in plan
    got = [tuple(r) for r in got.collect()]
    monkeypatch.setattr(inrow.InRow, "fits", lambda self: False)
    want = [tuple(r) for r in e.execute(text).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and (got or scope == "corpus")
    if "ORDER BY" in text[-30:] and scope == "document":
        assert sorted(got, key=lambda r: r[0]) == want


def test_one_array_comes_from_many_tasks(spark, tmp_path):
    """the array is one file, in the order of the rows, and no task makes or reads all of it."""
    pages = spark.createDataFrame([(k, "u", None if k == 7 else f"<p id=k{k}>\u00e9 \"q\"</p>") for k in range(40)], "doc_id long, source_uri string, html string").repartitionByRange(5, "doc_id")
    seen = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("array", "array")
    Engine(spark, pages).execute(f"SELECT p.id, p.text FROM doc TO JSON('{tmp_path}/a')")
    stages = [seen.getStageInfo(s) for j in seen.getJobIdsForGroup("array") for s in seen.getJobInfo(j).stageIds]
    spark.sparkContext.setJobGroup("", "")
    assert max(s.numTasks for s in stages) >= 5 and sum(s.numTasks == 1 for s in stages) == 0
    files = [f.name for f in (tmp_path / "a").iterdir() if f.name.startswith("part-")]
    assert len(files) == 1 and sorted(f.name for f in tmp_path.iterdir()) == ["a"]
    text = (tmp_path / "a" / files[0]).read_text()
    assert [x["id"] for x in json.loads(text)] == [f"k{k}" for k in range(40) if k != 7] and json.loads(text)[0]["text"] == '\u00e9 "q"'
    assert text.splitlines()[0] == "[" and text.splitlines()[-1] == "]" and len(text.splitlines()) == 41
    Engine(spark, pages).execute(f"SELECT p.id FROM doc TO JSON('{tmp_path}/a')")  # again, over what is there
    Engine(spark, pages).execute(f"SELECT em.id FROM doc TO CSV('{tmp_path}/none')")
    assert [r.value for r in spark.read.text(f"{tmp_path}/none").collect()] == ["id"]
