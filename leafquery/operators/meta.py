"""What SHOW and DESCRIBE list."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = [
    ("text(tag|self)", "string", "all text below the row's node"),
    ("direct_text(tag|self)", "string", "the node's own text"),
    ("first_text(tag WHERE ...)", "string", "text of the first node in scope that fits"),
    ("last_text(tag WHERE ...)", "string", "text of the last node in scope that fits"),
    ("first_attr(tag, attr WHERE ...)", "string", "attribute of the first node in scope that fits"),
    ("last_attr(tag, attr WHERE ...)", "string", "attribute of the last node in scope that fits"),
    ("concat(a, b, ...)", "string", "joined; NULL if any is NULL"),
    ("substring(str, start, len)", "string", "bytes from a 1-based start"),
    ("substr(str, start, len)", "string", "as substring"),
    ("length(str)", "int64", "bytes in UTF-8"),
    ("char_length(str)", "int64", "as length"),
    ("position(substr IN str)", "int64", "1-based place, 0 if absent"),
    ("locate(substr, str[, start])", "int64", "1-based place, 0 if absent"),
    ("replace(str, from, to)", "string", "all occurrences replaced"),
    ("regex_replace(str, pattern, repl)", "string", "all matches replaced"),
    ("lower(str)", "string", "ASCII letters in lower case"),
    ("upper(str)", "string", "ASCII letters in upper case"),
    ("ltrim(str)", "string", "without leading white space"),
    ("rtrim(str)", "string", "without trailing white space"),
    ("coalesce(a, b, ...)", "scalar", "the first that is not NULL"),
    ("case when ... then ... else ... end", "scalar", "the value of the first condition that holds"),
    ("inner_html(tag|self[, depth|MAX_DEPTH])", "string", "markup inside the node, minified"),
    ("raw_inner_html(tag|self[, depth|MAX_DEPTH])", "string", "markup inside the node as it is"),
    ("flatten_text(tag[, depth])", "string[]", "texts of the nodes below as columns"),
    ("flatten(tag[, depth])", "string[]", "as flatten_text"),
    ("project(tag)", "mixed[]", "named expressions for each row"),
    ("flatten_extract(tag)", "mixed[]", "as project"),
    ("trim(inner_html(...))", "string", "without white space at the ends"),
    ("count(tag|*)", "int64", "number of nodes"),
    ("summarize(*)", "table<tag,count>", "number of nodes of each tag"),
    ("tfidf(tag|*)", "map<string,double>", "scores of each row's best terms"),
]
AXES = [("parent", "the node above"), ("child", "the nodes right below"), ("ancestor", "all nodes above"), ("descendant", "all nodes below")]
OPERATORS = [
    ("=", "equal"),
    ("<>", "not equal"),
    ("<, <=, >, >=", "ordered"),
    ("IN (...)", "one of"),
    ("LIKE", "with % and _, without regard to ASCII case"),
    ("CONTAINS", "holds a string"),
    ("CONTAINS ALL", "holds all strings"),
    ("CONTAINS ANY", "holds any string"),
    ("IS NULL", "is missing"),
    ("IS NOT NULL", "is there"),
    ("HAS_DIRECT_TEXT", "own text holds a string"),
    ("~", "matches a regular expression"),
    ("AND", "both"),
    ("OR", "either"),
]
COLUMNS = [
    ("node_id", "int64", "false", "place in the document"),
    ("tag", "string", "false", "name in lower case"),
    ("attributes", "map<string,string>", "false", "names in lower case"),
    ("parent_id", "int64", "true", "NULL at a root"),
    ("max_depth", "int64", "false", "height of the subtree"),
    ("doc_order", "int64", "false", "place in pre-order"),
    ("sibling_pos", "int64", "false", "1-based among siblings"),
    ("source_uri", "string", "true", "where the document came from"),
]
LANGUAGE = (
    [("clause", n, s, t) for n, s, t in [
        ("WITH", "WITH name AS (query)[, ...]", "named results"), ("SELECT", "SELECT *|self|tag|item[, ...]", "tags also filter"), ("EXCLUDE", "EXCLUDE column[, ...]", "only after *"),
        ("FROM", "FROM source [AS alias]", ""), ("JOIN", "[INNER|LEFT] JOIN source ON expr | CROSS JOIN source | CROSS JOIN LATERAL (query) AS alias", ""),
        ("WHERE", "WHERE expr", ""), ("ORDER BY", "ORDER BY field [ASC|DESC][, ...]", ""), ("LIMIT", "LIMIT n", "at most 100000"),
    ]]
    + [("output", n, s, "") for n, s in [("TO LIST", "TO LIST()"), ("TO TABLE", "TO TABLE(options)"), ("TO CSV", "TO CSV('file')"), ("TO PARQUET", "TO PARQUET('file')"), ("TO JSON", "TO JSON(['file'])"), ("TO NDJSON", "TO NDJSON(['file'])")]]
    + [("source", n, s, "") for n, s in [("document", "FROM doc"), ("path", "FROM 'file.html'"), ("raw", "FROM RAW('<html>')"), ("parse", "FROM PARSE(html or query)"), ("derived", "FROM (query) AS alias")]]
    + [("field", n, n, t) for n, t, _, _ in COLUMNS]
    + [("function", n.split("(")[0], n, t) for n, _, t in FUNCTIONS]
    + [("axis", n, f"{n}.field", t) for n, t in AXES]
    + [("predicate", "exists", "EXISTS(axis [WHERE expr])", "one node meets all of it")]
    + [("operator", n, f"a {n} b", t) for n, t in OPERATORS]
    + [("meta", n, n, "") for n in ("SHOW INPUT", "SHOW INPUTS", "SHOW FUNCTIONS", "SHOW AXES", "SHOW OPERATORS", "DESCRIBE doc", "DESCRIBE language")]
)


def table_of(spark: SparkSession, kind: str, inputs: list[str] | None = None) -> DataFrame:
    if kind == "show input":
        return spark.createDataFrame([("source_uri", (inputs or ["document"])[0])], "key string, value string")
    if kind == "show inputs":
        return spark.createDataFrame([(u,) for u in inputs or ["document"]], "source_uri string")
    if kind == "show functions":
        return spark.createDataFrame(FUNCTIONS, "`function` string, returns string, description string")
    if kind == "show axes":
        return spark.createDataFrame(AXES, "axis string, description string")
    if kind == "show operators":
        return spark.createDataFrame(OPERATORS, "operator string, description string")
    if kind == "describe doc":
        return spark.createDataFrame(COLUMNS, "column_name string, type string, nullable string, notes string")
    return spark.createDataFrame(LANGUAGE, "category string, name string, syntax string, notes string")
