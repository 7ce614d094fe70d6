import pytest

from leafquery.api import statements
from leafquery.functions.names import normalize
from leafquery.lang.ast import And, Case, Compare, Exists, Operand, Or, Selector
from leafquery.lang.lexer import QueryError, tokens
from leafquery.lang.parser import parse


def test_tokens():
    assert [t.text for t in tokens("a-b 'it' /* x */ >= <> != 12 -- end\n.")][:-1] == ["a-b", "it", ">=", "<>", "<>", "12", "."]


@pytest.mark.parametrize(
    "text, code",
    [
        ("SELECT 'a FROM doc", "SYN-0004"),
        ("SELECT a /* FROM doc", "SYN-0003"),
        ("SELECT a ? FROM doc", "SYN-0002"),
        ("SELECT a doc", "SYN-0001"),
        ("SELECT a FROM doc WHERE", "SYN-0001"),
        ("SELECT a FROM doc WHERE x", "SYN-0001"),
        ("SELECT a FROM doc AS a CROSS JOIN doc AS b ON a.x = b.x", "SEM-0203"),
        ("SELECT a FROM (SELECT b FROM doc)", "SEM-0204"),
        ("SELECT a FROM doc CROSS JOIN LATERAL doc AS b", "SEM-0202"),
        ("SELECT table FROM doc TO TABLE(HEADER=ON, HEADER=OFF)", "SEM-0402"),
        ("SELECT table FROM doc TO TABLE(COLOUR=ON)", "SEM-0401"),
        ("WITH a AS (SELECT b FROM doc), A AS (SELECT c FROM doc) SELECT x FROM a", "SEM-0201"),
        ("SELECT a FROM doc WHERE EXISTS(uncle)", "SEM-0101"),
        ("SELECT TFIDF(a, SIZE=3) FROM doc", "SEM-0301"),
        ("SHOW TABLES", "SYN-0001"),
    ],
)
def test_errors(text, code):
    with pytest.raises(QueryError) as e:
        parse(text)
    assert e.value.code == code


def test_precedence_and_operands():
    q = parse("select x from doc as d where a = 1 or b = 2 and exists(child where tag = 'p') limit 3")
    assert isinstance(q.where, Or) and isinstance(q.where.right, And) and isinstance(q.where.right.right, Exists) and q.limit == 3
    assert parse("SELECT a FROM doc WHERE d.parent.attributes.class = 'x'").where == Compare("=", Operand("d", "parent", "attribute", "class"), parse("SELECT a FROM doc WHERE b = 'x'").where.right)
    assert parse("SELECT a FROM doc WHERE data-id IS NOT NULL").where.left == Operand(None, "self", "attribute", "data-id", True)


def test_project_selectors():
    (item,) = parse("SELECT PROJECT(tr) AS (a: LAST_TEXT(td WHERE x = 1), b: ATTR(a, HREF, 2), c: CASE WHEN d = 1 THEN a ELSE b END,) FROM doc").items
    a, b, c = (e for _, e in item.expr)
    assert (a.kind, a.tag, a.at) == ("TEXT", "td", -1) and b == Selector("ATTR", "a", "href", None, 2) and isinstance(c, Case)


def test_names_and_scripts():
    assert normalize([" A b ", "a_b", "", "1x", "select", "é"]) == ["a_b", "a_b__2", "col", "c_1x", "select_", "col__2"]
    assert statements("SELECT a FROM doc; -- x;\nSELECT ';' FROM doc;") == ["SELECT a FROM doc", "-- x;\nSELECT ';' FROM doc"]
