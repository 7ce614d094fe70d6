"""Loading with guards, diagnostics, templates, limits of results, scripts, tokenizers."""

import json

import pytest

from leafquery.api import Engine, bare_path
from leafquery.lang import templates
from leafquery.lang.lexer import QueryError
from leafquery.operators import terms
from leafquery.sources import loader
from leafquery.sources.loader import Policy, check_host, load


@pytest.fixture(scope="module")
def page(spark):
    return Engine.of_html(spark, "<ul><li id=a>one</li><li id=b>two</li></ul>")


def code(call) -> str:
    with pytest.raises(QueryError) as e:
        call()
    return e.value.code


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/p.html").write_bytes(b"<p>\xff caf\xc3\xa9</p>")
    (tmp_path / "out.html").write_text("<p>x</p>")
    assert load(tmp_path / "in/p.html")[0] == "<p>\ufffd caf\u00e9</p>"
    assert load(b"<b>x</b>") == ("<b>x</b>", "document") and load("<b>x</b>")[0] == "<b>x</b>"
    assert code(lambda: load(str(tmp_path / "in/../out.html"), Policy(base_dir=str(tmp_path / "in")))) == "RUN-0002"
    assert code(lambda: load("neither")) == "RUN-0002"
    assert code(lambda: load(b"<p>" * 100_001)) == "RUN-0001" and code(lambda: load(b"x" * 5_000_001)) == "RUN-0001"
    assert load(b"</p>" * 100_001)
    assert [r.text for r in Engine.of_source(spark, tmp_path / "out.html").execute("SELECT p.text FROM doc").collect()] == ["x"]


def test_addresses(spark, page):
    assert code(lambda: load("http://example.org/")) == "RUN-0002"  # the network is not allowed
    for host, found in [("a", "10.1.2.3"), ("b", "127.0.0.1"), ("c", "169.254.169.254"), ("d", "::1"), ("e", "fd00::1"), ("f", "::ffff:192.168.0.1"), ("g", "0.0.0.0")]:
        assert code(lambda: check_host(f"http://{host}/", Policy(network=True), lambda h: [found])) == "RUN-0002"  # noqa: B023
    check_host("https://a/", Policy(network=True), lambda h: ["93.184.216.34"])
    check_host("https://a/", Policy(network=True, private=True))
    assert code(lambda: check_host("ftp://a/", Policy(network=True))) == "RUN-0002"
    assert code(lambda: page.execute("SELECT p FROM 'http://127.0.0.1/x'")) == "RUN-0002"


def test_fetch_follows_checked_redirects():
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from threading import Thread

    class Answers(BaseHTTPRequestHandler):
        def do_GET(self):
            to = {"/one": "/two", "/loop": "/loop", "/away": "ftp://x/"}.get(self.path)
            self.send_response(302 if to else 200 if self.path == "/two" else 404)
            if to:
                self.send_header("Location", to)
            self.end_headers()
            if self.path == "/two":
                self.wfile.write(b"<p>two</p>")

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answers)
    Thread(target=server.serve_forever, daemon=True).start()
    at, policy = f"http://127.0.0.1:{server.server_port}", Policy(network=True, private=True)
    assert loader.fetch(f"{at}/one", policy) == ("<p>two</p>", f"{at}/two")
    for path in ("/loop", "/away", "/none"):
        assert code(lambda: loader.fetch(at + path, policy)) == "RUN-0002"  # noqa: B023
    assert code(lambda: loader.fetch(f"{at}/one", Policy(network=True))) == "RUN-0002"
    assert code(lambda: loader.fetch(f"{at}/two", Policy(network=True, private=True, most_bytes=3))) == "RUN-0001"
    server.shutdown()


def test_named_inputs(spark, page):
    page.load("other", "<p>p1</p>")
    assert [r.text for r in page.execute("SELECT p.text FROM other").collect()] == ["p1"]
    assert page.execute("SELECT li.text FROM doc").count() == 2


def test_limits_of_results(page):
    assert page.execute("SELECT li.id FROM doc", most=2).count() == 2
    assert code(lambda: page.execute("SELECT li.id FROM doc", most=1)) == "RUN-0002"
    rows, more = page.first_rows("SELECT li.id FROM doc ORDER BY node_id", 1)
    assert [r["id"] for r in rows] == ["a"] and more and not page.first_rows("SELECT li.id FROM doc", 2)[1]


def test_last_columns_and_scripts(page):
    said = []
    got = page.script("SELECT li.id FROM doc; SELECT FROM doc; SELECT li.text FROM doc", go_on=True, say=said.append)
    assert [isinstance(x, QueryError) for x in got] == [False, True, False]
    assert said == ["== stmt 1/3 ==", "== stmt 2/3 ==", "== stmt 3/3 =="]
    assert [tuple(r) for r in page.describe_last().collect()] == [("text", "text")]


def test_bare_paths():
    assert bare_path("SELECT p FROM ./a/b.html WHERE id = 3") == "SELECT p FROM './a/b.html' WHERE id = 3"
    assert bare_path("SELECT p FROM doc WHERE text = 'FROM x.html'") == "SELECT p FROM doc WHERE text = 'FROM x.html'"


def test_warnings_and_coverage(page):
    codes = lambda t: [f.code for f in page.lint(t)]
    assert codes("SELECT n FROM doc AS n WHERE n.tag = 'li'") == ["LINT-0001"]
    assert codes("SELECT n.tag AS t FROM doc AS n WHERE n.parnt_id = 3") == ["LINT-0002"]
    assert codes("SELECT a.tag AS t FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id WHERE c.tag = 'x'") == ["LINT-0003"]
    assert codes("SELECT a.tag AS t FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id WHERE a.data-x = 'x'") == []
    assert [page.check(t).coverage for t in ("SELECT li FROM doc", "SELECT a.tag AS t FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id", "SELECT FROM doc", "SHOW AXES")] == ["full", "reduced", "parse_only", "parse_only"]
    assert page.check("SELECT li FROM doc; WITH x AS (SELECT li.id FROM doc) SELECT x.id FROM x").coverage == "mixed"


def test_rendered_diagnostics(page):
    text = "SELECT li.id\nFROM doc WHERE LENGHT(id) > 1"
    got = json.loads(page.lint_json(text))
    assert got["summary"]["status"] == "warnings" and got["summary"]["coverage"] == "full" and got["summary"]["warning_count"] == 1
    (one,) = got["diagnostics"]
    assert (one["severity"], one["code"]) == ("WARNING", "LINT-0002")
    assert one["span"] == {"start_line": 2, "start_col": 16, "end_line": 2, "end_col": 22, "byte_start": 28, "byte_end": 34}
    lines = page.lint_text(text).split("\n")
    assert lines[0].startswith("warning[LINT-0002]") and lines[3] == "2 | FROM doc WHERE LENGHT(id) > 1" and lines[4].index("^") == lines[3].index("LENGHT")
    bad = json.loads(page.lint_json("SELECT FROM doc"))
    assert bad["summary"]["status"] == "parse_failed" and bad["diagnostics"][0]["code"].startswith("SYN") and set(bad["diagnostics"][0]) == set(one)
    assert page.lint_text("SELECT li FROM doc") == ""


def test_templates(page, tmp_path):
    (tmp_path / "v.toml").write_text("tag = 'li'\nmost = 1\nfields = [['i', 'id'], ['t', 'text']]\n")
    made = page.render("SELECT {% for a, f in fields %}{{ tag }}.{{ f }} AS {{ a }}{% if not loop.last %}, {% endif %}{% endfor %} FROM doc{# note #} LIMIT {{ most }}", str(tmp_path / "v.toml"), str(tmp_path / "out.sql"))
    assert made == "SELECT li.id AS i, li.text AS t FROM doc LIMIT 1" == (tmp_path / "out.sql").read_text()
    assert [tuple(r)[1:] for r in page.execute(made).collect()] == [("a", "one")]
    assert templates.render("{% if a %}x{% else %}y{% endif %}{{ b.c[1] }}", {"a": False, "b": {"c": [1, 2]}}) == "y2"
    for bad in ("{{ none }}", "{{ a.b }}", "{% for x in a %}", "{% endif %}", "{% what %}"):
        assert code(lambda: templates.render(bad, {"a": 1, "l": [1]})) == "RUN-0001"  # noqa: B023


def test_parse_guards(spark, monkeypatch):
    from leafquery.plans import planner

    e = Engine.of_html(spark, "<ul><li id=a><b>x</b></li><li>plain</li></ul>")
    count = lambda t: [r["count"] for r in e.execute(t).collect()]
    assert count("SELECT COUNT(b) FROM PARSE(SELECT RAW_INNER_HTML(li, MAX_DEPTH) FROM doc WHERE id = 'a') AS f") == [1]
    for bad in ("SELECT COUNT(b) FROM PARSE(SELECT li.id FROM doc) AS f", "SELECT COUNT(b) FROM PARSE(SELECT li.text FROM doc WHERE sibling_pos = 2) AS f"):
        with pytest.raises(Exception, match="RUN-0002"):
            count(bad)
    monkeypatch.setattr(planner, "MOST_FRAGMENT", 3)
    with pytest.raises(Exception, match="at most 3 bytes"):
        count("SELECT COUNT(b) FROM PARSE(SELECT RAW_INNER_HTML(li, MAX_DEPTH) FROM doc WHERE id = 'a') AS f")


def test_registered_tokenizers(spark):
    docs = spark.createDataFrame([("a-b a",), ("b-b",), (None,)], "text string")
    terms.register_tokenizer("dash", lambda t: t.replace(" ", "-").split("-"))
    got = [(r.token, r["count"]) for r in terms.summarize_content(docs, "text", 5, lang="DASH").collect()]
    assert got == [("b", 3)]  # `a` is a stop word
    assert code(lambda: terms.summarize_content(docs, "text", 5, lang="none")) == "RUN-0002"
