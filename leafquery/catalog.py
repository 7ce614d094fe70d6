"""Registered queries of the engine over the test tables, and the SQL that states their results.

Orders with their lines are rendered as one page each, read by the engine, and compared with SQL over the tables.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafquery.api import Engine
from leafquery.operators import terms
from leafquery.sources import sinks


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each order that has lines: doc_id, source_uri, html. An order has a few lines only."""
    line = lambda x: F.concat(
        F.lit('<li class="line '), x["l_returnflag"], F.lit('" data-no="'), x["l_linenumber"].cast("string"), F.lit('"><span class="qty">'), x["l_quantity"].cast("int").cast("string"),
        F.lit('</span><span class="part">'), x["l_partkey"].cast("string"), F.lit("</span> note "), x["l_linestatus"], F.lit("</li>"),
    )
    key = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    # lines are shuffled as they are and rendered once they are together
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(key)).alias("lines")).select("l_orderkey", F.array_join(F.transform("lines", line), "").alias("lis"))
    o = table(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    html = F.concat(
        F.lit('<html><body><article class="order '), "o_orderstatus", F.lit('" data-id="'), F.col("o_orderkey").cast("string"), F.lit('"><h3> '), "o_orderpriority",
        F.lit(" </h3><ul>"), "lis", F.lit("</ul><p>Customer <b>"), F.col("o_custkey").cast("string"), F.lit("</b> &amp; co</p></article></body></html>"),
    )
    return o.select(F.col("o_orderkey").alias("doc_id"), F.concat(F.lit("order/"), F.col("o_orderkey").cast("string")).alias("source_uri"), html.alias("html"))


def nation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page for each region with a table of its nations; columns 3 and the last row are empty."""
    row = F.concat(F.lit("<tr><td>"), F.col("n_nationkey").cast("string"), F.lit("<td>"), "n_name", F.lit("<td> </td><td>"), F.when(F.col("n_nationkey") % 2 == 0, "even").otherwise(""), F.lit("</tr>"))
    rows = table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.array_join(F.sort_array(F.collect_list(F.struct("n_nationkey", row.alias("h"))))["h"], "").alias("trs"))
    html = F.concat(F.lit("<table id=nations><tr><th>key</th><th>Nation\n Nation</th><th></th><th>key</th></tr>"), "trs", F.lit("<tr><td></td><td>&nbsp;</td></tr></table>"))
    return rows.select(F.col("n_regionkey").cast("long").alias("doc_id"), F.lit("nations").alias("source_uri"), html.alias("html"))


def over(pages: Callable, text: str, keep: str | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = Engine(spark, pages(spark, sf_dir), **options).execute(text)
        return df.selectExpr(*keep.split("; ")) if keep else df

    return run


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Orders with their lines, in the order in which they are rendered; r: the line's number on the page.
L = """WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS r,
  count(*) OVER (PARTITION BY l_orderkey) AS n, o_orderkey AS doc_id, CAST(CAST(l_quantity AS INT) AS VARCHAR) AS qty, CAST(l_partkey AS VARCHAR) AS part, CAST(l_linenumber AS VARCHAR) AS no
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
o AS (SELECT o_orderkey AS doc_id, orders.*, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS n FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)) """


def add(name: str, text: str, oracle: str | None = None, pages: Callable = order_pages, keep: str | None = None, **options) -> None:
    QUERIES[name] = over(pages, text, keep, **options)
    if oracle:
        ORACLES[name] = oracle


add("scan_star_exclude", "SELECT * EXCLUDE attributes FROM doc WHERE tag = 'LI'", L + "SELECT doc_id, 5 + 3 * (r - 1) AS node_id, 'li' AS tag, CAST(4 AS BIGINT) AS parent_id, CAST(1 AS BIGINT) AS max_depth, 5 + 3 * (r - 1) AS doc_order FROM l")
add("tag_fields", "SELECT li.data-no AS no, li.class, li.sibling_pos FROM doc WHERE attributes.data-no >= 3", L + "SELECT doc_id, no, 'line ' || l_returnflag AS class, r AS sibling_pos FROM l WHERE l_linenumber >= 3")
add("field_list", "SELECT article(data-id, class) FROM doc WHERE class <> 'O'", L + """SELECT doc_id, CAST(doc_id AS VARCHAR) AS "data-id", 'order ' || o_orderstatus AS class FROM o WHERE o_orderstatus <> 'O'""")
add("filter_and_or", "SELECT span.node_id, span.text FROM doc WHERE (class = 'qty' AND text > 40) OR (class = 'part' AND (text = '7' OR text < 3))", L + "SELECT doc_id, 6 + 3 * (r - 1) AS node_id, qty AS text FROM l WHERE CAST(l_quantity AS INT) > 40 UNION ALL SELECT doc_id, 7 + 3 * (r - 1), part FROM l WHERE l_partkey = 7 OR l_partkey < 3")
add("class_tokens", "SELECT COUNT(li) FROM doc WHERE class = 'R'", L + "SELECT doc_id, count(*) FILTER (l_returnflag = 'R') AS count FROM l GROUP BY 1")
add("in_list", "SELECT COUNT(li) AS n FROM doc WHERE class IN ('R', 'N')", L + "SELECT doc_id, count(*) FILTER (l_returnflag IN ('R', 'N')) AS n FROM l GROUP BY 1")
add("like_any_case", "SELECT TEXT(self) AS t FROM doc WHERE tag = 'h3' AND text LIKE '%-uRg_nt%'", L + "SELECT doc_id, ' ' || o_orderpriority || ' ' AS t FROM o WHERE lower(o_orderpriority) LIKE '%-urg_nt%'")
add("regex", "SELECT h3.node_id FROM doc WHERE text ~ '^ [12]-[A-Z]+ $'", L + "SELECT doc_id, CAST(3 AS BIGINT) AS node_id FROM o WHERE regexp_matches(o_orderpriority, '^[12]-[A-Z]+$')")
add("contains_all_any", "SELECT li.data-no FROM doc WHERE attributes.class CONTAINS ALL ('LINE', 'a') OR attributes.class CONTAINS ANY ('zz', ' r')", L + """SELECT doc_id, no AS "data-no" FROM l WHERE l_returnflag IN ('A', 'R')""")
add("null_tests", "SELECT COUNT(*) FROM doc WHERE attributes IS NULL AND parent_id IS NOT NULL AND attributes.class IS NULL", L + "SELECT doc_id, CAST(5 AS BIGINT) AS count FROM o")
add("direct_text", "SELECT DIRECT_TEXT(li) AS t FROM doc WHERE li HAS_DIRECT_TEXT 'NOTE o'", L + "SELECT doc_id, ' note ' || l_linestatus AS t FROM l WHERE l_linestatus = 'O'")
add("parent_axis", "SELECT span.node_id FROM doc WHERE parent.data-no = 1 AND class = 'part'", L + "SELECT doc_id, 7 + 3 * (r - 1) AS node_id FROM l WHERE l_linenumber = 1")
add("child_axis", "SELECT li.node_id FROM doc WHERE child.text = 50", L + "SELECT doc_id, 5 + 3 * (r - 1) AS node_id FROM l WHERE CAST(l_quantity AS INT) = 50 OR l_partkey = 50")
add("ancestor_axis", "SELECT b.text AS cust FROM doc WHERE ancestor.class = 'F' AND ancestor.tag <> 'ul'", L + "SELECT doc_id, CAST(o_custkey AS VARCHAR) AS cust FROM o WHERE o_orderstatus = 'F'")
add("descendant_axis", "SELECT article.data-id AS id, article.descendant.data-no AS last_no FROM doc WHERE descendant.class = 'A'", L + "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id, arg_max(no, r) AS last_no FROM l GROUP BY 1, 2 HAVING bool_or(l_returnflag = 'A')")
add("exists_nested", "SELECT article.node_id FROM doc WHERE EXISTS(descendant WHERE tag = 'li' AND class = 'R' AND EXISTS(child WHERE class = 'qty' AND text > 45)) OR EXISTS(child WHERE tag = 'h3' AND text LIKE '%LOW%')", L + "SELECT doc_id, CAST(2 AS BIGINT) AS node_id FROM l GROUP BY doc_id HAVING bool_or(l_returnflag = 'R' AND CAST(l_quantity AS INT) > 45) OR any_value(o_orderpriority) LIKE '%LOW%'")
add("order_limit", "SELECT li.data-no AS no, li.node_id FROM doc ORDER BY node_id DESC LIMIT 2", L + "SELECT doc_id, no, 5 + 3 * (r - 1) AS node_id FROM l WHERE n - r < 2")
add("count_all", "SELECT COUNT(*) FROM doc", L + "SELECT doc_id, 7 + 3 * n AS count FROM o")
add("count_corpus", "SELECT COUNT(li) FROM doc", L + "SELECT CAST(0 AS BIGINT) AS doc_id, count(*) AS count FROM l", scope="corpus")
add("summarize", "SELECT SUMMARIZE(*) FROM doc", L + "SELECT doc_id, t.tag, CASE t.tag WHEN 'li' THEN n WHEN 'span' THEN 2 * n ELSE 1 END AS count FROM o, (SELECT unnest(['html', 'body', 'article', 'h3', 'ul', 'li', 'span', 'p', 'b']) AS tag) t")
add("summarize_corpus", "SELECT SUMMARIZE(*) FROM doc ORDER BY count DESC LIMIT 2", L + "SELECT * FROM (SELECT 'span' AS tag, CAST(2 * count(*) AS BIGINT) AS count FROM l UNION ALL SELECT 'li', count(*) FROM l)", scope="corpus")
add("flatten", "SELECT FLATTEN(li) AS (qty, part, more) FROM doc WHERE data-no = 2", L + "SELECT doc_id, qty, part, CAST(NULL AS VARCHAR) AS more FROM l WHERE l_linenumber = 2")
add("flatten_where", "SELECT FLATTEN(ul) AS (a, b) FROM doc WHERE descendant.class = 'qty'", L + "SELECT doc_id, max(qty) FILTER (r = 1) AS a, max(qty) FILTER (r = 2) AS b FROM l GROUP BY 1")
add(
    "project",
    "SELECT PROJECT(article) AS (prio: TEXT(h3), first_qty: TEXT(span WHERE class = 'qty'), second_part: TEXT(span WHERE class = 'part', 2), last_no: LAST_ATTR(li, data-no), returned: ATTR(li, data-no WHERE class = 'R'), "
    "none: TEXT(em), label: COALESCE(none, CONCAT(LOWER(prio), ':', first_qty), 'x'), big: CASE WHEN EXISTS(descendant WHERE class = 'qty' AND text >= 48) THEN 'big' ELSE 'small' END, same: first_qty = second_part,) FROM doc",
    L
    + """SELECT doc_id, any_value(o_orderpriority) AS prio, max(qty) FILTER (r = 1) AS first_qty, max(part) FILTER (r = 2) AS second_part, max(no) FILTER (r = n) AS last_no, arg_min(no, r) FILTER (l_returnflag = 'R') AS returned,
  CAST(NULL AS VARCHAR) AS none, lower(any_value(o_orderpriority)) || ':' || max(qty) FILTER (r = 1) AS label, CASE WHEN max(CAST(l_quantity AS INT)) >= 48 THEN 'big' ELSE 'small' END AS big,
  CASE WHEN max(part) FILTER (r = 2) IS NULL THEN NULL WHEN max(qty) FILTER (r = 1) = max(part) FILTER (r = 2) THEN 'true' ELSE 'false' END AS same FROM l GROUP BY doc_id""",
)
add(
    "scalar_functions",
    "SELECT TRIM(TEXT(h3)) AS t, UPPER(SUBSTRING(TEXT(h3), 2, 3)) AS s, LENGTH(TEXT(h3)) AS n, POSITION('-' IN TEXT(h3)) AS p, LOCATE('U', TEXT(h3), 5) AS q, REPLACE(TEXT(h3), '-', '+') AS r, REGEX_REPLACE(TEXT(h3), '[0-9]', '#') AS x, LTRIM(TEXT(h3)) AS lt, RTRIM(TEXT(h3)) AS rt FROM doc WHERE tag = 'h3' AND parent.tag = 'article'",
    L
    + """SELECT doc_id, o_orderpriority AS t, upper(o_orderpriority[1:3]) AS s, CAST(strlen(o_orderpriority) + 2 AS BIGINT) AS n, CAST(3 AS BIGINT) AS p,
  CAST(CASE WHEN instr((o_orderpriority || ' ')[4:], 'U') = 0 THEN 0 ELSE instr((o_orderpriority || ' ')[4:], 'U') + 4 END AS BIGINT) AS q, ' ' || replace(o_orderpriority, '-', '+') || ' ' AS r, ' ' || regexp_replace(o_orderpriority, '[0-9]', '#', 'g') || ' ' AS x,
  o_orderpriority || ' ' AS lt, ' ' || o_orderpriority AS rt FROM o""",
)
add("text_forms", "SELECT TEXT(p), INNER_HTML(p) AS html FROM doc WHERE attributes.class IS NULL", L + "SELECT doc_id, 'Customer ' || CAST(o_custkey AS VARCHAR) || ' & co' AS text, 'Customer <b>' || CAST(o_custkey AS VARCHAR) || '</b> &amp; co' AS html FROM o")
add("inner_join", "SELECT a.data-no AS no, b.text AS qty FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id AND b.class = 'qty' WHERE a.tag = 'li'", L + "SELECT doc_id, no, qty FROM l")
add("left_join", "SELECT a.data-no AS no, b.text AS qty FROM doc AS a LEFT JOIN doc AS b ON b.parent_id = a.node_id AND b.tag = 'span' AND b.text = 50 WHERE a.tag = 'li'", L + "SELECT doc_id, no, '50' AS qty FROM l WHERE CAST(l_quantity AS INT) = 50 UNION ALL SELECT doc_id, no, '50' FROM l WHERE l_partkey = 50 UNION ALL SELECT doc_id, no, NULL FROM l WHERE CAST(l_quantity AS INT) <> 50 AND l_partkey <> 50")
add("cross_join", "SELECT a.tag AS x, b.tag AS y FROM doc AS a CROSS JOIN doc AS b WHERE a.tag = 'h3' AND b.tag IN ('b', 'p')", L + "SELECT doc_id, 'h3' AS x, unnest(['b', 'p']) AS y FROM o")
add("lateral", "SELECT u.node_id, c.no FROM doc AS u CROSS JOIN LATERAL (SELECT x.data-no AS no FROM doc AS x WHERE x.parent_id = u.node_id ORDER BY x.node_id DESC LIMIT 2) AS c WHERE u.tag = 'ul'", L + "SELECT doc_id, CAST(4 AS BIGINT) AS node_id, no FROM l WHERE n - r < 2")
add(
    "cte_left_joins",
    "WITH lines AS (SELECT li.node_id AS id, li.data-no AS no FROM doc WHERE tag = 'li'), cells AS (SELECT c.parent_id AS id, c.class AS cls, TEXT(c) AS v FROM doc AS c WHERE c.tag = 'span') SELECT l.no, q.v AS qty, p.v AS part, CASE WHEN q.v > p.v THEN 'q' ELSE 'p' END AS more FROM lines AS l LEFT JOIN cells AS q ON q.id = l.id AND q.cls = 'qty' LEFT JOIN cells AS p ON p.id = l.id AND p.cls = 'part' ORDER BY l.id",
    L + "SELECT doc_id, no, qty, part, CASE WHEN CAST(l_quantity AS INT) > l_partkey THEN 'q' ELSE 'p' END AS more FROM l",
)
add("derived_table", "SELECT d.no, d.parent_id FROM (SELECT li.data-no AS no FROM doc WHERE class = 'N') AS d WHERE d.no <> 1", L + "SELECT doc_id, no, CAST(4 AS BIGINT) AS parent_id FROM l WHERE l_returnflag = 'N' AND l_linenumber <> 1")
add("parse_fragments", "SELECT COUNT(span) FROM PARSE(SELECT RAW_INNER_HTML(li, MAX_DEPTH) FROM doc WHERE data-no <= 4) AS f", L + "SELECT doc_id, 2 * count(*) AS count FROM l WHERE l_linenumber <= 4 GROUP BY 1")
add("raw_source", "SELECT li.text AS t, li.sibling_pos FROM RAW('<ul><li>a<li>b &lt; c</ul>')", "SELECT CAST(0 AS BIGINT) AS doc_id, t, p AS sibling_pos FROM (VALUES ('a', CAST(1 AS BIGINT)), ('b < c', CAST(2 AS BIGINT))) v(t, p)")
add("join_axes", "SELECT a.data-no AS no, b.text AS qty FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id AND b.class = 'qty' WHERE a.tag = 'li' AND a.child.text = 50 AND a.ancestor.class = 'F'", L + "SELECT doc_id, no, qty FROM l WHERE (CAST(l_quantity AS INT) = 50 OR l_partkey = 50) AND o_orderstatus = 'F'")
add("join_exists", "SELECT a.data-no AS no, b.tag FROM doc AS a JOIN doc AS b ON a.parent_id = b.node_id WHERE a.tag = 'li' AND EXISTS(child WHERE class = 'qty' AND text > 45)", L + "SELECT doc_id, no, 'ul' AS tag FROM l WHERE CAST(l_quantity AS INT) > 45")
add("join_count_zero", "SELECT COUNT(*) AS n FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id AND b.text = 50 WHERE a.tag = 'li'", L + "SELECT doc_id, CAST(coalesce(sum(CASE WHEN CAST(l_quantity AS INT) = 50 THEN 1 ELSE 0 END + CASE WHEN l_partkey = 50 THEN 1 ELSE 0 END), 0) AS BIGINT) AS n FROM l GROUP BY 1")
add("join_count_corpus", "SELECT COUNT(*) AS n FROM doc AS a JOIN doc AS b ON b.parent_id = a.node_id WHERE a.tag = 'li'", L + "SELECT CAST(0 AS BIGINT) AS doc_id, 2 * count(*) AS n FROM l", scope="corpus")
add("lateral_count", "SELECT u.data-no AS no, c.n FROM doc AS u CROSS JOIN LATERAL (SELECT COUNT(*) AS n FROM doc AS x WHERE x.parent_id = u.node_id AND x.text > 40) AS c WHERE u.tag = 'li'", L + "SELECT doc_id, no, CAST(CASE WHEN CAST(l_quantity AS INT) > 40 THEN 1 ELSE 0 END + CASE WHEN l_partkey > 40 THEN 1 ELSE 0 END AS BIGINT) AS n FROM l")
add("order_limit_corpus", "SELECT article.data-id AS id FROM doc WHERE tag = 'article' ORDER BY max_depth DESC, text LIMIT 5", L + "SELECT doc_id, CAST(doc_id AS VARCHAR) AS id FROM (SELECT doc_id, ' ' || any_value(o_orderpriority) || ' ' || string_agg(qty || part || ' note ' || l_linestatus, '' ORDER BY r) || 'Customer ' || any_value(o_custkey) || ' & co' AS t FROM l GROUP BY 1) ORDER BY t, doc_id LIMIT 5", scope="corpus")
add("regex_dollar", "SELECT REGEX_REPLACE(TEXT(h3), '([0-9])-', 'US$$$1$5$') AS t, REGEX_REPLACE(TEXT(h3), '[[-]', '\\$&') AS u FROM doc WHERE text LIKE '%-%' AND tag = 'h3'", L + "SELECT doc_id, ' ' || replace(regexp_replace(o_orderpriority, '([0-9])-', 'US#\\1#'), '#', chr(36)) || ' ' AS t, ' ' || replace(o_orderpriority, '-', chr(92) || '-') || ' ' AS u FROM o")
N = "WITH n AS (SELECT CAST(n_regionkey AS BIGINT) AS doc_id, CAST(n_nationkey AS VARCHAR) AS k, n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS r, n_nationkey % 2 = 0 AS even FROM nation) "
add("table_rect", "SELECT table FROM doc TO TABLE(TRIM_EMPTY_ROWS=ON, TRIM_EMPTY_COLS=ALL)", N + "SELECT doc_id, CAST(2 AS BIGINT) AS node_id, r + 1 AS row_index, k || '|' || n_name || '|' || CASE WHEN even THEN 'even' ELSE '' END AS row FROM n UNION ALL SELECT DISTINCT doc_id, 2, 1, 'key|Nation\n Nation|key' FROM n", pages=nation_pages, keep="doc_id; node_id; row_index; array_join(cells, '|', '') as row")
add("table_long", "SELECT table FROM doc TO TABLE(FORMAT=SPARSE, SPARSE_SHAPE=LONG, HEADER_NORMALIZE=ON)", N + "SELECT doc_id, CAST(2 AS BIGINT) AS node_id, r AS row_index, c.i AS col_index, c.h AS header, CASE c.i WHEN 1 THEN k WHEN 2 THEN n_name ELSE 'even' END AS value FROM n, (VALUES (CAST(1 AS BIGINT), 'key'), (CAST(2 AS BIGINT), 'Nation'), (CAST(4 AS BIGINT), 'key_2')) c(i, h) WHERE c.i < 4 OR even", pages=nation_pages)
add("table_wide", "SELECT table FROM doc TO TABLE(FORMAT=SPARSE, SPARSE_SHAPE=WIDE, STOP_AFTER_EMPTY_ROWS=1)", N + "SELECT doc_id, r AS row_index, k AS key, n_name AS name, CASE WHEN even THEN 'even' END AS other FROM n UNION ALL SELECT doc_id, max(r) + 1, NULL, NULL, NULL FROM n GROUP BY 1", pages=nation_pages, keep="doc_id; row_index; cells['key'] as key; cells['Nation\\n Nation'] as name; cells['key_2'] as other")
QUERIES["show_operators"] = lambda spark, sf_dir: Engine(spark).execute("SHOW OPERATORS").select("operator")
ORACLES["show_operators"] = "SELECT unnest(['=', '<>', '<, <=, >, >=', 'IN (...)', 'LIKE', 'CONTAINS', 'CONTAINS ALL', 'CONTAINS ANY', 'IS NULL', 'IS NOT NULL', 'HAS_DIRECT_TEXT', '~', 'AND', 'OR']) AS operator"
QUERIES["describe_doc"] = lambda spark, sf_dir: Engine(spark).execute("DESCRIBE doc").select("column_name", "type", "nullable")
ORACLES["describe_doc"] = "SELECT * FROM (VALUES ('node_id', 'int64', 'false'), ('tag', 'string', 'false'), ('attributes', 'map<string,string>', 'false'), ('parent_id', 'int64', 'true'), ('max_depth', 'int64', 'false'), ('doc_order', 'int64', 'false'), ('sibling_pos', 'int64', 'false'), ('source_uri', 'string', 'true')) v(column_name, type, nullable)"


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of every page of the `pages` table."""
    return Engine.of_table(spark, table(spark, sf_dir, "pages")).execute("SELECT a.href, TEXT(a) AS t FROM doc WHERE attributes.href IS NOT NULL AND ancestor.tag = 'nav'")


def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine.of_table(spark, table(spark, sf_dir, "pages")).execute("SELECT PROJECT(body) AS (title: TEXT(h1), ad: TEXT(div WHERE class = 'ad'), links: TEXT(nav)) FROM doc").select("doc_id", "title", "ad")


def tfidf_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF of the documents table through the engine's operator, over the corpus."""
    docs = table(spark, sf_dir, "documents").select(F.lit("p").alias("tag"), F.col("doc_id").alias("node_id"), F.lit(None).cast("long").alias("parent_id"), terms.tokens(F.col("text")).alias("terms"))
    out = terms.tfidf(docs, [], top=3, min_df=2)
    return out.select("node_id", F.explode("terms_score").alias("term", "score")).select("node_id", "term", F.round("score", 6).alias("score"))


def content_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return terms.summarize_content(table(spark, sf_dir, "documents"), "text", 20).select("token", "count")


def csv_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What TO CSV writes, line by line: a header in each part, quotes around values that need them."""
    at = f"{fresh()}/csv"
    Engine(spark, order_pages(spark, sf_dir)).execute(f"SELECT article.data-id AS id, CONCAT('a,\"', data-id, '\"') AS t FROM doc WHERE class IS NOT NULL AND tag = 'article' TO CSV('{at}')")
    return spark.read.text(at).where("value != 'id,t'").select(F.col("value").alias("line"))


def csv_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{fresh()}/csv"
    Engine(spark, order_pages(spark, sf_dir)).execute(f"SELECT li.data-no AS no, li.class FROM doc WHERE sibling_pos = 1 AND tag = 'li' TO CSV('{at}')")
    return spark.read.csv(at, header=True)


def json_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TO JSON is one array, an object a line: its lines are read apart from each other."""
    at = f"{fresh()}/json"
    Engine(spark, order_pages(spark, sf_dir)).execute(f"SELECT article.data-id AS id, article.none FROM doc WHERE tag = 'article' TO JSON('{at}')")
    one = spark.read.text(at).where("value NOT IN ('[', ']')").select(F.from_json(F.regexp_replace("value", "^,", ""), "map<string,string>").alias("m"))
    return one.select(F.col("m.id").alias("id"), F.col("m.none").alias("none"), F.size("m").alias("n"))


def table_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the one table of a page as CSV."""
    at = f"{fresh()}/table"
    pages = nation_pages(spark, sf_dir).where("doc_id = 2")
    Engine(spark, pages).execute(f"SELECT table FROM doc TO TABLE(TRIM_EMPTY_ROWS=ON, TRIM_EMPTY_COLS=ALL, HEADER=OFF, EXPORT='{at}')")
    return spark.read.csv(at, header=True, multiLine=True, escape='"').where("col1 != 'key'").select("col1", "col2")


def table_long_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = f"{fresh()}/long"
    pages = nation_pages(spark, sf_dir).where("doc_id = 3")
    Engine(spark, pages).execute(f"SELECT table FROM doc TO TABLE(FORMAT=SPARSE, SPARSE_SHAPE=LONG, EXPORT='{at}')")
    return spark.read.csv(at, header=True, multiLine=True, escape='"').where("col_index = '2'").select("row_index", "header", "value")


def fresh() -> str:
    """A folder for what a query writes and reads back; below the shared one where there is one."""
    spark = SparkSession.active()
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or f"file://{tempfile.mkdtemp(prefix='leafquery-')}"
    return f"{base.rstrip('/')}/leafquery-out-{uuid.uuid4().hex}"


QUERIES |= {"page_links": page_links, "page_ads": page_articles, "tfidf": tfidf_documents, "summarize_content": content_tokens, "csv_lines": csv_lines, "csv_read_back": csv_read_back, "json_read_back": json_read_back, "table_csv": table_csv, "table_long_csv": table_long_csv}
# The words that TFIDF and content summaries leave out by default, as SQL.
_STOP = "'a','an','and','are','as','at','be','but','by','for','from','has','have','he','her','his','i','in','is','it','its','of','on','or','she','that','the','their','they','to','was','were','with','you'"
_TOKENS = "string_split_regex(translate(regexp_replace(text, '<[^>]*(>|$)', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9_]+')"
ORACLES |= {
    "page_links": """WITH p AS (SELECT page_id AS doc_id, unnest(regexp_extract_all(regexp_extract(html, '<nav>.*?</nav>'), '<a href="[^"]*">[^<]*</a>')) AS a FROM pages)
SELECT doc_id, regexp_extract(a, 'href="([^"]*)"', 1) AS href, replace(regexp_extract(a, '>([^<]*)<', 1), '&amp;', '&') AS t FROM p""",
    "page_ads": """SELECT page_id AS doc_id, replace(replace(replace(replace(replace(trim(regexp_extract(html, '<h1>([^<]*)</h1>', 1)), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS title, trim(regexp_replace(regexp_extract(html, '<div class="ad">([^<]*)</div>', 1), '\\s+', ' ', 'g')) AS ad FROM pages""",
    "tfidf": f"""WITH t AS (SELECT doc_id AS node_id, unnest(list_filter({_TOKENS}, lambda x: x NOT IN ('', {_STOP}))) AS term FROM documents),
c AS (SELECT node_id, term, count(*) AS c FROM t GROUP BY 1, 2), n AS (SELECT node_id, count(*) AS total FROM t GROUP BY 1), d AS (SELECT term, count(*) AS df FROM c GROUP BY 1),
s AS (SELECT c.node_id, c.term, c.c / n.total * (ln(((SELECT count(*) FROM documents) + 1) / (d.df + 1)) + 1) AS score FROM c JOIN n USING (node_id) JOIN d USING (term) WHERE d.df >= 2)
SELECT node_id, term, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY score DESC, term) AS r FROM s) WHERE r <= 3""",
    "summarize_content": f"""SELECT term AS token, count(*) AS count FROM (SELECT unnest(list_filter({_TOKENS}, lambda x: x <> '')) AS term FROM documents)
WHERE term NOT IN ({_STOP}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20""",
    "csv_lines": L + "SELECT CAST(doc_id AS VARCHAR) || ',' || chr(34) || 'a,' || repeat(chr(34), 2) || CAST(doc_id AS VARCHAR) || repeat(chr(34), 3) AS line FROM o",
    "csv_read_back": L + "SELECT no, 'line ' || l_returnflag AS class FROM l WHERE r = 1",
    "json_read_back": L + "SELECT CAST(doc_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS none, 2 AS n FROM o",
    "table_csv": "SELECT CAST(n_nationkey AS VARCHAR) AS col1, n_name AS col2 FROM nation WHERE n_regionkey = 2",
    "table_long_csv": "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS VARCHAR) AS row_index, 'Nation\n Nation' AS header, n_name AS value FROM nation WHERE n_regionkey = 3",
}
