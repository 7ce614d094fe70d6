"""load pages, execute statements, run scripts, check statements."""

from __future__ import annotations

import re
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquery.functions.names import normalize
from leafquery.lang import diagnostics, templates
from leafquery.lang.ast import Meta
from leafquery.lang.diagnostics import Finding, Report
from leafquery.lang.lexer import QueryError, tokens
from leafquery.lang.parser import parse
from leafquery.operators import meta
from leafquery.plans.planner import Planner, Result
from leafquery.sources import sinks
from leafquery.sources.html import nodes_of
from leafquery.sources.loader import MOST_BYTES, Policy, checked, load


class Engine:
    """Statements over a table of pages, or over one document."""

    def __init__(self, spark: SparkSession, pages: DataFrame | None = None, scope: str = "document", policy: Policy = Policy()):  # noqa: B008
        self.spark, self.pages, self.scope, self.policy = spark, pages, scope, policy
        self.named: dict[str, DataFrame] = {}
        self.last: list[str] = []

    @classmethod
    def of_table(cls, spark: SparkSession, pages: DataFrame, id_col: str = "page_id", uri_col: str = "url", html_col: str = "html", scope: str = "document") -> Engine:
        return cls(spark, pages.select(F.col(id_col).cast("long").alias("doc_id"), F.col(uri_col).alias("source_uri"), F.col(html_col).alias("html")), scope)

    @classmethod
    def of_html(cls, spark: SparkSession, html: str, uri: str = "document") -> Engine:
        html = checked(html)
        return cls(spark, spark.createDataFrame([(0, uri, html)], "doc_id long, source_uri string, html string"))

    @classmethod
    def of_source(cls, spark: SparkSession, source: str | bytes | Path, policy: Policy = Policy()) -> Engine:  # noqa: B008
        """A document given as bytes, a path, an address (if the policy allows the network) or markup."""
        html, uri = load(source, policy)
        out = cls.of_html(spark, html, uri)
        out.policy = policy
        return out

    @classmethod
    def of_stdin(cls, spark: SparkSession) -> Engine:
        return cls.of_source(spark, sys.stdin.buffer.read(MOST_BYTES + 1))

    def load(self, alias: str, source: str | bytes | Path) -> None:
        """A further document, which statements read by FROM alias."""
        html, uri = load(source, self.policy)
        self.named[alias.lower()] = self.spark.createDataFrame([(0, uri, html)], "doc_id long, source_uri string, html string")

    @classmethod
    def of_files(cls, spark: SparkSession, path: str) -> Engine:
        """Each file below a path is a document."""
        files = spark.read.format("binaryFile").load(path)
        return cls(spark, files.select(F.xxhash64("path").alias("doc_id"), F.col("path").alias("source_uri"), F.decode("content", "UTF-8").alias("html")))

    def plan(self, text: str) -> Result:
        q = parse(text)
        if isinstance(q, Meta) and q.kind in ("show input", "show inputs"):
            uris = [r.source_uri for r in self.pages.select("source_uri").distinct().limit(1000).collect()] if self.pages is not None else []  # a listing for people
            df = meta.table_of(self.spark, q.kind, uris)
            return Result(df, df.columns)
        return Planner(self.spark, self.pages, self.scope, self.policy, self.named).run(text)

    def execute(self, text: str, columns: str = "raw", single: bool = False, most: int | None = None) -> DataFrame:
        """The result; written too if the statement has TO with a path. most: more rows than this are an error."""
        got = self.plan(bare_path(text))
        df = got.df
        self.last = list(got.columns)
        if most is not None and df.limit(most + 1).count() > most:
            raise QueryError("RUN-0002", f"the result has more than {most} rows")
        if columns == "normalize":
            names = dict(zip(got.columns, normalize(got.columns), strict=True))
            df, got.columns = df.toDF(*[names.get(c, c) for c in df.columns]), list(names.values())
        if got.to:
            kind, options = got.to
            path = options.get("path") or options.get("EXPORT")
            if path and got.table:
                sinks.write_table(df, ("PARQUET" if path.lower().endswith(".parquet") else "CSV") if kind == "TABLE" else kind, path, kind != "TABLE" or not ("NOHEADER" in options or options.get("HEADER", "ON") == "OFF"))
            elif path:
                sinks.write(df, got.columns, kind, path, single)
        return df

    def script(self, text: str, go_on: bool = False, say: Callable[[str], None] | None = None) -> list[DataFrame | QueryError]:
        """Statements between semicolons; stops at the first error unless go_on. say: gets a line before each."""
        out: list[DataFrame | QueryError] = []
        each = statements(text)
        for k, one in enumerate(each, 1):
            if say:
                say(f"== stmt {k}/{len(each)} ==")
            try:
                out.append(self.execute(one))
            except QueryError as e:
                out.append(e)
                if not go_on:
                    break
        return out

    def check(self, text: str) -> Report:
        """Reads and checks a statement, or a script, without running it."""
        names = [n.split("(")[0].upper() for n, _, _ in meta.FUNCTIONS] + "ATTR TRIM PROJECT EXISTS RAW PARSE IN AS JSON CSV LIST TABLE PARQUET NDJSON ALL ANY CONTAINS LATERAL FROM VALUES ON AND OR NOT WHERE BY LIKE JOIN THEN ELSE WHEN".split()
        validate = Planner(self.spark, self.pages, self.scope).check
        try:
            each = statements(text)
        except QueryError:
            each = [text]
        if len(each) < 2:
            return diagnostics.check(text, validate, names)
        reports = [(text.index(one), diagnostics.check(one, validate, names)) for one in each]
        for start, r in reports:
            for f in r.findings:
                f.at, f.end = f.at + start, f.end + start if f.end >= 0 else -1
        kinds = {r.coverage for _, r in reports}
        return Report([f for _, r in reports for f in r.findings], kinds.pop() if len(kinds) == 1 else "mixed", all(r.parsed for _, r in reports), any(r.relational for _, r in reports))

    def lint(self, text: str) -> list[Finding]:
        """The errors and warnings of a statement."""
        return self.check(text).findings

    def lint_text(self, text: str, colour: bool = False) -> str:
        return diagnostics.as_text(text, self.lint(text), colour)

    def lint_json(self, text: str) -> str:
        return diagnostics.as_json(text, self.check(text))

    def render(self, template: str, variables: dict | str, out: str | None = None) -> str:
        """The statement that a template gives with its variables, or those of a TOML file; also written to `out`."""
        text = templates.render(template, templates.variables_of(variables) if isinstance(variables, str) else variables)
        if out:
            with open(out, "w", encoding="utf-8") as f:
                f.write(text)
        return text

    def describe_last(self) -> DataFrame:
        """The columns of the last result, as they were named and as identifiers."""
        return self.spark.createDataFrame(list(zip(self.last, normalize(self.last), strict=True)), "raw_name string, output_name string")

    def first_rows(self, text: str, most: int = 2000) -> tuple[list[dict], bool]:
        """At most `most` rows, and whether there are more."""
        got = self.execute(text).limit(most + 1).collect()
        return [r.asDict(True) for r in got[:most]], len(got) > most

    def summarize(self, top: int = 20) -> dict[str, DataFrame]:
        """Node count, and the `top` most frequent tags and attribute names of each document (by name on ties)."""
        from leafquery.sources.html import parse_pages

        n = parse_pages(self.pages, frozenset(["attributes"])).select("doc_id", F.explode("nodes").alias("n"))
        by = lambda df, c: df.groupBy("doc_id", c).agg(F.count("*").alias("count"))
        best = lambda df, c: df.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), c))).where(F.col("n") <= top).drop("n")
        tags = best(by(n.select("doc_id", "n.tag"), "tag"), "tag")
        keys = best(by(n.select("doc_id", F.explode(F.map_keys("n.attributes")).alias("attribute")), "attribute"), "attribute")
        return {"nodes": n.groupBy("doc_id").agg(F.count("*").alias("total_nodes")), "tags": tags, "attributes": keys}


def bare_path(text: str) -> str:
    """FROM page.html, without quotes, as FROM 'page.html'."""
    return re.sub(r"(?i)(\bFROM\s+)(?!RAW\b|PARSE\b|LATERAL\b)((?:\.{0,2}/)?[\w./-]+\.(?:html?|xhtml))(?=\s|;|$)", r"\1'\2'", text) if "'" not in text and '"' not in text else text


def statements(text: str) -> list[str]:
    """The statements of a script, split at semicolons outside strings, comments and parentheses."""
    cuts, depth = [0], 0
    toks = tokens(text)
    for t in toks:
        depth += (t.word == "(") - (t.word == ")")
        if t.word == ";" and depth == 0:
            cuts.append(t.at + 1)
    return [s.strip().rstrip(";") for s in (text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)], strict=True)) if s.strip().rstrip(";").strip()]


def parse_nodes(html: str) -> list[dict]:
    """The node rows of one document, without Spark."""
    return nodes_of([html])
