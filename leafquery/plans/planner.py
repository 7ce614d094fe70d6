"""From a statement to a DataFrame.

Statements over one document source plan inside the document's row (higher-order functions over its nodes). WITH, JOIN
and derived tables plan as relations: DataFrames with a struct for each alias, joined on the document and the ON terms.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafquery.functions import text as fn
from leafquery.lang.ast import FIELDS, And, Call, Case, Compare, Contains, Exists, HasDirectText, In, IsNull, Item, Lit, Meta, Operand, Or, Select, Selector, Source
from leafquery.lang.lexer import QueryError
from leafquery.lang.parser import parse
from leafquery.operators import meta, tables, terms
from leafquery.plans.inrow import InRow
from leafquery.plans.scope import Project, Scope, _all, _any, apply, depth_limited, let
from leafquery.sources.html import EVERY, parse_pages
from leafquery.sources.loader import Policy, fetch

CORE = ["node_id", "tag", "attributes", "parent_id", "max_depth", "doc_order"]
HIDDEN = ["node_id", "tag", "attributes", "parent_id", "max_depth", "doc_order", "sibling_pos", "text", "direct_text", "inner_html"]
MOST_LIMIT, MOST_RAW, MOST_PATTERN, MOST_FRAGMENTS, MOST_FRAGMENT = 100_000, 5 << 20, 1024, 1000, 1 << 20


@dataclass
class Result:
    """The rows (doc_id first if the input has several documents), in `order` within a document, and where they go."""

    df: DataFrame
    columns: list[str]
    to: tuple[str, dict] | None = None
    warnings: list[str] = field(default_factory=list)
    table: bool = False
    ordered: bool = False


def walk(e):
    """An expression and all in it."""
    yield e
    if isinstance(e, (And, Or, Compare)):
        yield from walk(e.left)
        yield from walk(e.right)
    elif isinstance(e, (In, Contains)):
        yield from walk(e.left)
        for x in e.options:
            yield from walk(x)
    elif isinstance(e, (IsNull, HasDirectText)):
        yield from walk(e.left)
    elif isinstance(e, (Exists, Selector)) and e.where is not None:
        yield from walk(e.where)
    elif isinstance(e, Call):
        for x in e.args:
            yield from walk(x)
    elif isinstance(e, Case):
        for a, b in e.whens:
            yield from walk(a)
            yield from walk(b)
        yield from walk(e.other)


#: Node columns that are read by the names of fields, by axes, and by anything that is not one of these.
_BY_FIELD = {"max_depth": "max_depth", "sibling_pos": "sibling_pos"}
_BY_AXIS = {"child": "children", "ancestor": "ancestors", "descendant": "lifo"}
_NO_ATTRIBUTE = frozenset(FIELDS) | {"node"}


def needed(q) -> frozenset:
    """The columns of nodes, of those that are made on demand, that a statement may read."""
    text = set()

    def named(c: str):
        text.add(_BY_FIELD.get(c.lower(), "text" if c.lower() == "text" else "attributes" if c.lower() not in FIELDS else "tag"))

    def of(s: Select):
        for i in s.items:
            if i.kind == "flatten":
                text.update(("direct_text", "inline_text", "ancestors"))
            if i.kind in ("star", "self", "tag"):
                text.update(("attributes", "max_depth"))
            for c in i.expr if i.kind == "fields" else ():
                named(c)
            if i.kind == "tfidf":
                text.add("inner_html")
            if i.kind == "tag" and i.tag == "table":
                text.update(("text", "near_tr", "near_cell"))
            for e in [p[1] for p in i.expr] if i.kind == "project" else [i.expr] if i.kind in ("expr", "field", "tag") else []:
                look(e)
        if s.where is not None:
            look(s.where)
        for j in s.joins:
            if j.on is not None:
                look(j.on)
            source(j.source)
        for _, c, _ in s.order:
            named(c)
        source(s.source)
        for _, c in s.ctes:
            of(c)

    def source(s: Source):
        if s.kind in ("query", "parse") and isinstance(s.value, Select):
            of(s.value)

    def look(e):
        for x in walk(e):
            if isinstance(x, (Operand, Exists)) and x.axis in _BY_AXIS:
                text.add(_BY_AXIS[x.axis])
            if isinstance(x, Operand) and x.field not in _NO_ATTRIBUTE or isinstance(x, Call) and x.name == "ATTR" or isinstance(x, Selector) and x.kind == "ATTR":
                text.add("attributes")
            if isinstance(x, Operand):
                text.add(_BY_FIELD.get(x.field, "tag"))
            if isinstance(x, Selector):
                text.update(("direct_text", "inline_text", "text"))
            elif isinstance(x, HasDirectText):
                text.add("direct_text")
            elif isinstance(x, Call) and "TEXT" in x.name:
                text.update(("text", "direct_text", "inline_text"))
            elif isinstance(x, Call) and "HTML" in x.name:
                text.add("inner_html")
            elif isinstance(x, Operand) and x.field in ("text", "node"):
                text.add("text")

    of(q)
    return frozenset(text & EVERY)


def looks_up(q: Select) -> bool:
    """Whether a statement reads anything of a node's parent."""
    terms = [q.where, *[j.on for j in q.joins], *[i.expr for i in q.items if i.kind in ("expr", "field", "tag")]]
    inner = [c for _, c in q.ctes] + [s.value for s in [q.source, *[j.source for j in q.joins]] if isinstance(s.value, Select)]
    return any(isinstance(x, Operand) and x.axis == "parent" for e in terms if e is not None for x in walk(e)) or any(looks_up(c) for c in inner)


def readers(q: Select) -> int:
    """How many sources of a statement read the loaded pages, or may."""
    out = sum(readers(c) for _, c in q.ctes)
    for s in [q.source, *[j.source for j in q.joins]]:
        out += readers(s.value) if isinstance(s.value, Select) else s.kind == "doc" or s.kind == "name" and s.value.lower() not in {n.lower() for n, _ in q.ctes}
    return out


class Planner:
    """pages: doc_id, source_uri, html. scope: `document` (counts and limits hold in each document) or `corpus`."""

    def __init__(self, spark: SparkSession, pages: DataFrame | None = None, scope: str = "document", policy: Policy = Policy(), named: dict | None = None):  # noqa: B008
        self.spark, self.pages, self.scope, self.policy, self.named = spark, pages, scope, policy, named or {}
        self.parsed: dict[frozenset, DataFrame] = {}
        self.readers, self.upward, self.behind = 1, True, HIDDEN

    def run(self, text: str) -> Result:
        q = parse(text)
        if isinstance(q, Meta):
            df = meta.table_of(self.spark, q.kind)
            return Result(df, df.columns)
        self.check(q)
        self.need, self.readers, self.upward = needed(q), readers(q), looks_up(q)
        self.behind = [h for h in HIDDEN if h not in EVERY or h in self.need]
        return self.select(q, {}, top=True)

    # checks
    def check(self, q: Select) -> None:
        if q.limit is not None and q.limit > MOST_LIMIT:
            raise QueryError("SEM-0501", f"LIMIT is at most {MOST_LIMIT}")
        kinds = [i.kind for i in q.items]
        if q.exclude and kinds != ["star"]:
            raise QueryError("SEM-0205", "EXCLUDE goes only with SELECT *")
        if q.exclude and (set(q.exclude) - set(CORE) or set(q.exclude) >= set(CORE)):
            raise QueryError("SEM-0205", "EXCLUDE names an unknown column or all of them")
        for one in ("count", "summarize", "tfidf", "project", "flatten"):
            if one in kinds and len(kinds) > 1 and one != "flatten":
                raise QueryError("SEM-0301", f"{one.upper()} stands alone in SELECT")
        if "count" in kinds and q.order:
            raise QueryError("SEM-0301", "COUNT takes no ORDER BY")
        aliases = [s.alias.lower() for s in [q.source, *[j.source for j in q.joins]] if s.alias]
        if len(set(aliases)) < len(aliases):
            raise QueryError("SEM-0201", "an alias is used twice")
        if q.to and q.to[0] == "LIST" and (len(q.items) != 1 or kinds[0] in ("star", "self", "tag")):
            raise QueryError("SEM-0401", "TO LIST takes exactly one column")
        if q.to and q.to[0] == "TABLE" and not (len(q.items) == 1 and q.items[0].tag == "table"):
            raise QueryError("SEM-0401", "TO TABLE takes SELECT table")
        tags = {i.tag for i in q.items if i.kind in ("field", "fields") and not q.ctes and not q.joins and i.tag not in ("self", (q.source.alias or q.source.value or "").lower() if q.source.kind in ("doc", "name") else None)}
        if len(tags) > 1 and not q.joins and not q.ctes and q.source.kind != "query":
            raise QueryError("SEM-0302", "projected fields must share one tag")
        if "tag" in kinds and ({"field", "fields"} & set(kinds)) and not q.joins and not q.ctes:
            raise QueryError("SEM-0303", "tags and fields cannot be mixed")
        guarded = [i for i in q.items if i.kind == "expr" and isinstance(i.expr, Call) and i.expr.name in ("TEXT", "INNER_HTML", "RAW_INNER_HTML")]
        if guarded and not q.joins and not q.ctes and q.source.kind in ("doc", "raw", "path", "parse"):
            own = lambda e: isinstance(e, Operand) and e.field == "tag" and e.axis == "self"
            if q.where is None or all(isinstance(x, (And, Or, Lit, Operand)) or isinstance(x, (Compare, In)) and own(x.left) for x in walk(q.where)):
                raise QueryError("SEM-0304", "TEXT() and INNER_HTML() need a WHERE beyond the row's own tag")
        for e in walk(q.where) if q.where is not None else ():
            if isinstance(e, Compare) and e.op == "~" and isinstance(e.right, Lit) and len(str(e.right.value)) > MOST_PATTERN:
                raise QueryError("SEM-0501", "the pattern is too long")

    # sources
    def documents(self, s: Source, ctes: dict) -> DataFrame:
        """doc_id, source_uri, nodes."""
        if s.kind == "name" and s.value.lower() in self.named:
            return parse_pages(self.named[s.value.lower()], self.need)
        if s.kind in ("doc", "name"):
            if self.pages is None:
                raise QueryError("RUN-0001", "no document is loaded")
            if self.need not in self.parsed:
                parsed = parse_pages(self.pages, self.need)
                # several aliases read the parsed pages from one exchange, which also deals the joins by document
                self.parsed[self.need] = parsed.repartition("doc_id") if self.readers > 1 else parsed
            return self.parsed[self.need]
        if s.kind == "parse" and isinstance(s.value, Select):
            return self.fragments(s.value, ctes)
        if s.kind == "path":
            if "://" in s.value and s.value.split("://")[0] in ("http", "https"):
                html, uri = fetch(s.value, self.policy)
                return parse_pages(self.spark.createDataFrame([(0, uri, html)], "doc_id long, source_uri string, html string"), self.need)
            files = self.spark.read.text(s.value, wholetext=True)
            several = len(files.inputFiles()) > 1  # each file is a document of its own
            file = F.col("_metadata.file_path")
            one = files.select((F.xxhash64(file) if several else F.lit(0).cast("long")).alias("doc_id"), (file if several else F.lit(s.value)).alias("source_uri"), F.col("value").alias("html"))
        else:
            html = s.value if s.kind == "raw" else constant(s.value)
            if len(html.encode()) > MOST_RAW:
                raise QueryError("SEM-0501", "the literal is too long")
            if s.kind == "parse" and not ("<" in html and ">" in html):
                raise QueryError("RUN-0002", "PARSE takes HTML")
            one = self.spark.createDataFrame([(0, s.kind, html)], "doc_id long, source_uri string, html string")
        return parse_pages(one, self.need)

    def fragments(self, q: Select, ctes: dict) -> DataFrame:
        got = self.select(q, ctes)
        if len(got.columns) != 1:
            raise QueryError("SEM-0401", "PARSE takes one column")
        if got.table:
            raise QueryError("SEM-0401", "PARSE takes no tables")
        h = fn.trim(F.col(f"`{got.columns[0]}`").cast("string"))
        bytes_ = F.octet_length("h")
        stop = lambda what: F.raise_error(F.lit(f"RUN-0002: PARSE {what}"))
        html = F.when(F.col("h").isNull() | (F.col("h") != "") & ~(F.contains("h", F.lit("<")) & F.contains("h", F.lit(">"))), stop("takes strings of HTML")).when(bytes_ > MOST_FRAGMENT, stop(f"takes fragments of at most {MOST_FRAGMENT} bytes")).otherwise(F.col("h"))
        one = got.df.select("doc_id", "__ord", h.alias("h")).select("doc_id", "__ord", html.alias("h")).where("h != ''")
        total = one.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("__ord", "h"))).alias("f"), F.count("*").alias("n"), F.sum(bytes_).alias("size"))  # one document's fragments
        kept = F.when(F.col("n") > MOST_FRAGMENTS, stop(f"takes at most {MOST_FRAGMENTS} fragments")).when(F.col("size") > MOST_RAW, stop(f"takes at most {MOST_RAW} bytes")).otherwise(F.col("f"))
        per = total.select("doc_id", kept.alias("f"))
        pages = per.select("doc_id", F.lit("parse").alias("source_uri"), F.col("f.h").alias("html"))
        return parse_pages(pages, self.need)

    # statements
    def select(self, q: Select, ctes: dict, top: bool = False) -> Result:
        ctes = dict(ctes)
        names = {*ctes, *[name.lower() for name, _ in q.ctes]}
        named = q.source.kind == "name" and q.source.value.lower() in names
        dotted = any(a for a, _, _ in q.order)
        if q.joins or names or named or q.source.kind == "query" or dotted:
            out = self.relation_select(q, ctes, top)
        else:
            out = self.node_select(q, ctes, [c.lower() for _, c, _ in q.order] if top else self.behind)
        out.to = q.to
        if top:
            if q.order and "__ord" in out.df.columns and not out.ordered and (q.joins or names or dotted or q.source.kind == "query"):
                out.df = out.df.orderBy("doc_id", "__ord")
            out.df = out.df.drop("__ord", "__hidden")
        return out

    # -- node runtime
    def node_select(self, q: Select, ctes: dict, behind: list[str], array: bool = False) -> Result | tuple[Column, list[str]]:
        """behind: the columns of the node behind each row that are still read after this. array: only the rows as an array
        in the page's row, and their columns."""
        docs = self.documents(q.source, ctes) if not array else None
        alias = (q.source.alias or (q.source.value if q.source.kind == "name" else None) or "doc").lower()
        nodes, uri = F.col("nodes"), F.col("source_uri")
        scope_of = lambda n, kind=Scope, env=None: kind(n, nodes, uri, alias, env)
        first = q.items[0]
        tags = self.tag_filter(q, alias)
        flat_where, where = (None, q.where) if first.kind != "flatten" else split_descendant(q.where)

        def keep(n: Column) -> Column:
            out = n["tag"].isin(*tags) if tags else F.lit(True)
            return out & scope_of(n).test(where) if where is not None else out

        rows = F.filter(nodes, keep) if tags or where is not None else nodes
        if q.order and first.kind not in ("count", "summarize"):
            rows = F.array_sort(rows, order_of(q.order))
        limit = q.limit if self.scope == "document" or first.kind not in ("count", "summarize", "tfidf") else None
        if limit is not None:
            rows = F.slice(rows, 1, limit)
        if first.kind == "count":
            df = docs.select("doc_id", F.size(rows).cast("long").alias(first.alias or "count"))
            if self.scope == "corpus":
                df = df.agg(F.sum(first.alias or "count").alias(first.alias or "count")).select(F.lit(0).cast("long").alias("doc_id"), first.alias or "count")
            return Result(df, [first.alias or "count"])
        by = ["doc_id"] if self.scope == "document" else []
        picked = None if array else docs.select("doc_id", "source_uri", "nodes", rows.alias("rows"))
        if first.kind == "summarize":
            if by and q.limit is None and not q.order:
                df = picked.select("doc_id", F.explode(terms.counted(F.col("rows.tag"))).alias("c")).select("doc_id", "c.tag", "c.count")
                return Result(df, ["tag", "count"])
            df = terms.summarize(picked.select("doc_id", F.explode("rows.tag").alias("tag")), by)
            order = [F.desc("count"), F.asc("tag")]
            if q.order:
                order = [(F.desc if d else F.asc)(c.lower()) for _, c, d in q.order] + [F.asc("tag")]
            return Result(limited(df, by, order, q.limit), ["tag", "count"])
        if first.kind == "tfidf":
            o = first.options
            each = picked.select("doc_id", F.explode("rows").alias("n")).select("doc_id", "n.node_id", "n.parent_id", "n.tag", terms.tokens(F.col("n.inner_html")).alias("terms"))
            # nodes of several documents share ids: the document stays a key, only the statistics widen with the scope
            df = terms.tfidf(each, by, o["TOP_TERMS"], o["MIN_DF"], o["MAX_DF"], o["STOPWORDS"] not in ("NONE", "OFF"))
            return Result(df, ["node_id", "parent_id", "tag", "terms_score"])
        if first.kind == "tag" and first.tag == "table" and len(q.items) == 1 and q.to and q.to[0] in ("TABLE", "CSV", "PARQUET"):
            cells = picked.select("doc_id", "nodes", F.explode("rows").alias("t")).select("doc_id", F.col("t.node_id").alias("node_id"), tables.cells_of(F.col("t"), nodes).alias("cells"))
            df = tables.to_table(cells, q.to[1] if q.to[0] == "TABLE" else {})
            return Result(df, [c for c in df.columns if c not in ("doc_id",)], table=True)
        columns: list[str] = []
        hidden = lambda n: [F.struct(*[n[h].alias(h) for h in HIDDEN if h in behind]).alias("__hidden")] if behind else []

        def row(n: Column) -> Column:
            out = []

            def add(name: str, value: Column):
                out.append((name, value))

            for item in q.items:
                if item.kind == "project":
                    made = projected(item.expr, lambda env, shared: shared_scope(scope_of(n, Project, env), shared))
                    columns[:] = unique([name for name, _ in item.expr])
                    return let(made, lambda m: F.struct(*[m[f"p{at}"].alias(c) for at, c in enumerate(columns)], *hidden(n)))
                elif item.kind == "flatten":
                    for name, value in zip(item.options["names"], flatten(scope_of(n), item, flat_where), strict=True):
                        add(name, value)
                elif item.kind in ("star", "self", "tag"):
                    for c in CORE:
                        if c not in q.exclude and c not in [x for x, _ in out]:
                            add(c, n[c])
                elif item.kind == "fields":
                    for c in item.expr:
                        add(c, n[c.lower()] if c.lower() in CORE + ["sibling_pos", "text"] else F.element_at(n["attributes"], c.lower()))
                elif item.kind == "field":
                    o = item.expr
                    own = Operand(None, o.axis, o.field, o.attr) if (o.alias or "").lower() in (item.tag, alias) else o
                    add(item.name, scope_of(n).value(own))
                else:
                    value = scope_of(n).value(item.expr)
                    call = item.expr
                    if isinstance(call, Call) and call.name == "TEXT" and item.alias is None:
                        _, fits = scope_of(n).named(call.args[0])
                        value = F.when(fits, n["inline_text"])
                    add(item.name, value)
            names = unique([c for c, _ in out])
            columns[:] = names
            return F.struct(*[v.alias(c) for c, (_, v) in zip(names, out, strict=True)], *hidden(n))

        if array:
            made = F.transform(rows, row)  # names the columns
            return made, columns
        df = picked.select("doc_id", F.posexplode(F.transform("rows", row)).alias("__ord", "r")).select("doc_id", F.col("__ord").cast("long").alias("__ord"), "r.*")
        if q.limit is not None and self.scope == "corpus":
            by = [F.col("__hidden")[c.lower()] for _, c, _ in q.order]
            keys = [k.desc_nulls_first() if d else k.asc_nulls_last() for k, (_, _, d) in zip(by, q.order, strict=True)]
            df = df.orderBy(*keys, "doc_id", "__ord").limit(q.limit)
        return Result(df, columns)

    def tag_filter(self, q: Select, alias: str) -> list[str]:
        """Tags in SELECT also filter, unless they name the source's alias or cannot be tags."""
        out = []
        for i in q.items:
            if i.kind in ("tag", "fields", "field", "count", "project", "flatten") and i.tag and i.tag not in ("self", "document", "doc", "attributes", "attr", "parent", "child", "ancestor", "descendant", *FIELDS):
                if i.kind == "tag" or i.tag != alias:
                    out.append(i.tag.lower())
            if i.kind == "tfidf":
                out += [t for t in i.expr if t != "*"]
            call = i.expr if i.kind == "expr" and i.alias is None else None
            while isinstance(call, Call) and call.name == "TRIM" and call.args:
                call = call.args[0]
            if isinstance(call, Call) and call.name in ("TEXT", "INNER_HTML", "RAW_INNER_HTML") and isinstance(call.args[0], Operand) and call.args[0].bare:
                tag = (call.args[0].attr or call.args[0].field).lower()
                out += [tag] if tag != alias else []
        if any(i.kind in ("star", "self") for i in q.items):
            return []
        return sorted(set(out))

    # -- relation runtime
    def relation_of(self, q: Select, ctes: dict) -> DataFrame:
        """A subquery's rows as doc_id, __ord, r (its columns, and the hidden ones of the node behind each row)."""
        got = self.select(q, ctes)
        df = got.df
        inside = [F.col(f"`{c}`") for c in got.columns]
        if "__hidden" in df.columns:
            low = {c.lower() for c in got.columns}
            inside += [F.col("__hidden")[h].alias(h) for h in self.behind if h not in low]
        ord_ = F.col("__ord") if "__ord" in df.columns else F.monotonically_increasing_id()
        doc = F.col("doc_id") if "doc_id" in df.columns else F.lit(0).cast("long")
        return df.select(doc.alias("doc_id"), F.array(ord_).alias("__key") if "array" not in dict(df.dtypes).get("__ord", "") else ord_.alias("__key"), F.struct(*inside).alias("r"))

    def source_rows(self, s: Source, ctes: dict, deep: list | None = None) -> tuple[str, DataFrame]:
        """alias and rows (doc_id, __key, r). deep: conditions on children, ancestors and descendants; those of this alias
        become columns of r, as long as the document's other nodes are at hand."""
        if s.kind == "query":
            return s.alias, self.relation_of(s.value, ctes)
        if s.kind == "name" and s.value.lower() in ctes:
            return s.alias or s.value, ctes[s.value.lower()]
        docs = self.documents(s, ctes)
        alias = s.alias or (s.value if s.kind in ("name", "doc") else s.kind)
        rows = docs.select("doc_id", "source_uri", "nodes", F.explode("nodes").alias("n"))
        return alias, rows.select("doc_id", F.array(F.col("n")["doc_order"]).alias("__key"), self.node_row(F.col("n"), alias, deep or []).alias("r"))

    def node_row(self, n: Column, alias: str, deep: list) -> Column:
        """A node as a row of a relation: its columns that are read, its parent's, and the tests that need its document."""
        up = F.get(F.col("nodes"), n["parent_id"].cast("int"))
        read = lambda names: [c for c in names if c in self.behind]
        parent = [F.struct(*[up[c].alias(c) for c in read(("node_id", "tag", "attributes", "parent_id", "max_depth", "doc_order", "sibling_pos", "text"))]).alias("__parent")]
        scope = Scope(n, F.col("nodes"), F.col("source_uri"), alias.lower())
        tests = [F.coalesce(scope.test(t.expr), F.lit(False)).alias(t.name) for t in deep if t.alias in (None, alias.lower())]
        return F.struct(*[n[h].alias(h) for h in read(HIDDEN)], F.col("source_uri"), *(parent if self.upward else []), *tests)

    def node_array(self, alias: str, deep: list) -> Column:
        return F.transform("nodes", lambda n: F.struct(F.array(n["doc_order"]).alias("__key"), self.node_row(n, alias, deep).alias("r")))

    def select_array(self, q: Select, behind: list[str]) -> Column:
        """The rows of a statement over the pages, as an array in the page's row."""
        rows, columns = self.node_select(q, {}, behind, array=True)
        low = {c.lower() for c in columns}
        of = lambda x: F.struct(*[x.getField(c).alias(c) for c in columns], *[x["__hidden"][h].alias(h) for h in behind if h not in low])
        return F.transform(rows, lambda x, k: F.struct(F.array(k.cast("long")).alias("__key"), of(x).alias("r")))

    def relation_select(self, q: Select, ctes: dict, top: bool = False) -> Result:
        if any(i.kind in ("project", "flatten", "tfidf", "summarize") for i in q.items):
            raise QueryError("SEM-0305", "PROJECT, FLATTEN, TFIDF and SUMMARIZE do not go with joins; put them into a CTE")
        deep, ordered = deep_tests(q), False
        inside = InRow(self, q, {name.lower(): c for name, c in q.ctes})
        if top and inside.fits():
            rel, ordered = inside.relation()
        else:
            for name, c in q.ctes:
                ctes[name.lower()] = self.relation_of(c, ctes)
            alias, rows = self.source_rows(q.source, ctes, deep)
            rel = Relation(rows.select("doc_id", "__key", F.col("r").alias(alias)), [alias], deep)
            for j in q.joins:
                rel = self.join(rel, j, ctes)
        if q.where is not None:
            rel.df = rel.df.where(rel.join_test(q.where))
        first = q.items[0]
        if first.kind == "count":
            df = rel.df
            if q.limit is not None:
                df = limited(df, ["doc_id"], [F.asc("__key")], q.limit)
            name = first.alias or "count"
            if self.scope == "corpus":
                return Result(df.agg(F.count("*").alias(name)).select(F.lit(0).cast("long").alias("doc_id"), name), [name])
            counts = df.groupBy("doc_id").agg(F.count("*").alias(name))
            every = self.pages.select("doc_id").distinct() if self.pages is not None and self.readers or inside.bound else rows.select("doc_id").union(self.spark.range(1).select("id")).distinct()
            return Result(every.join(counts, "doc_id", "left").select("doc_id", F.coalesce(name, F.lit(0).cast("long")).alias(name)), [name])
        order = [] if ordered else [rel.sort_key(rel.order_operand(a, c), d) for a, c, d in q.order]
        keys = [k for ks in order for k in ks] + [F.asc("__key")]
        df = rel.df
        if q.limit is not None and self.scope == "corpus":  # at most MOST_LIMIT rows are numbered
            df = df.orderBy(*keys, "doc_id").limit(q.limit).withColumn("__n", F.row_number().over(Window.orderBy(*keys, "doc_id")))
        elif q.order and not ordered or q.limit is not None:
            df = df.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy(*keys)))
            if q.limit is not None:
                df = df.where(F.col("__n") <= q.limit)
        names, values, hidden = self.columns_of(rel, q)
        ord_ = F.array(F.col("__n").cast("long")) if "__n" in df.columns else F.col("__key")
        df = df.select("doc_id", ord_.alias("__ord"), *values, *([F.struct(*hidden).alias("__hidden")] if len(hidden) == len(self.behind) else []))
        return Result(df, names, ordered=ordered)

    def columns_of(self, rel: Relation, q: Select) -> tuple[list[str], list[Column], list[Column]]:
        """Names and values of the columns over joined rows, and those of the node behind the first alias."""
        at = rel.at
        out = []
        for i in q.items:
            if i.kind == "star":
                src = next((a for a in rel.aliases if rel.has(a, "node_id")), rel.aliases[0])
                out += [(c, at(src)[c]) for c in (CORE if rel.has(src, "tag") else rel.fields(src)) if c not in q.exclude]
            elif i.kind == "self" or i.kind == "tag" and any(a.lower() == i.tag for a in rel.aliases):
                src = next((a for a in rel.aliases if a.lower() == i.tag), rel.aliases[0])
                out += [(c, at(src)[c]) for c in CORE if rel.has(src, c)]
            elif i.kind in ("tag", "field"):
                out.append((i.alias or i.name, rel.value(i.expr)))
            elif i.kind == "expr":
                out.append((i.name, rel.value(i.expr)))
            else:
                raise QueryError("SEM-0305", f"{i.kind} does not go with joins")
        names = unique([c for c, _ in out])
        head = rel.aliases[0]
        hidden = [at(head)[h].alias(h) for h in HIDDEN if rel.has(head, h)]
        return names, [v.alias(c) for c, (_, v) in zip(names, out, strict=True)], hidden

    def join(self, left: Relation, j, ctes: dict) -> Relation:
        if j.kind == "lateral":
            return self.lateral(left, j.source, ctes)
        alias, rows = self.source_rows(j.source, ctes, left.deep)
        if alias.lower() in [a.lower() for a in left.aliases]:
            raise QueryError("SEM-0201", f"the alias {alias} is used twice")
        right = rows.select(F.col("doc_id").alias("__doc"), F.col("__key").alias("__right"), F.col("r").alias(alias))
        both = Relation(left.df.crossJoin(right), [*left.aliases, alias], left.deep)
        cond = left.df["doc_id"] == right["__doc"]
        if j.on is not None:
            on = both.join_test(j.on)
            cond = cond & on
        df = left.df.join(right, cond, "left" if j.kind == "left" else "inner")
        df = df.withColumn("__key", F.concat("__key", F.coalesce("__right", F.array(F.lit(-1).cast("long"))))).drop("__doc", "__right")
        return Relation(df, [*left.aliases, alias], left.deep)

    def lateral(self, left: Relation, s: Source, ctes: dict) -> Relation:
        """The subquery for each row on the left: a join on its WHERE, then its ORDER BY and LIMIT by row number."""
        q: Select = s.value
        deep = [*left.deep, *deep_tests(q, len(left.deep))]
        alias, rows = self.source_rows(q.source, ctes, deep)
        right = rows.select(F.col("doc_id").alias("__doc"), F.col("__key").alias("__right"), F.col("r").alias(alias))
        rel = Relation(left.df.join(right, left.df["doc_id"] == right["__doc"]).drop("__doc"), [*left.aliases, alias], deep)
        rel.inner = alias
        for j in q.joins:
            rel = self.join(rel, j, ctes)
            rel.inner = alias
        if q.where is not None:
            rel.df = rel.df.where(rel.join_test(q.where))
        if q.items[0].kind == "count":
            name = q.items[0].alias or "count"
            counts = rel.df.groupBy("doc_id", "__key").agg(F.count("*").alias("__count"))
            df = left.df.join(counts, ["doc_id", "__key"], "left").withColumn(s.alias, F.struct(F.coalesce("__count", F.lit(0).cast("long")).alias(name)))
            return Relation(df.select("doc_id", "__key", *left.aliases, s.alias), [*left.aliases, s.alias], left.deep)
        keys = [k for a, c, d in q.order for k in rel.sort_key(Operand(a or alias, "self", c.lower()) if c.lower() in FIELDS else Operand(a, "self", "attribute", c, a is None), d)]
        n = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy(*keys, F.asc("__right")))
        df = rel.df.withColumn("__n", n) if q.order or q.limit is not None else rel.df.withColumn("__n", F.element_at("__right", 1))
        if q.limit is not None:
            df = df.where(F.col("__n") <= q.limit)
        out = []
        for i in q.items:
            if i.kind in ("star", "self") or i.kind == "tag" and i.tag == alias.lower():
                out += [F.col(f"`{alias}`")[h].alias(h) for h in HIDDEN if rel.has(alias, h)]
            else:
                out.append(rel.value(i.expr).alias(i.name))
        df = df.withColumn(s.alias, F.struct(*out)).withColumn("__key", F.concat("__key", F.array(F.col("__n").cast("long"))))
        return Relation(df.select("doc_id", "__key", *left.aliases, s.alias), [*left.aliases, s.alias], left.deep)


@dataclass
class DeepTest:
    """A condition on other nodes of the document, for the rows of an alias (None: of the first one)."""

    expr: object
    alias: str | None
    name: str


def deep_tests(q: Select, first: int = 0) -> list[DeepTest]:
    """The conditions of a statement's WHERE and ON that look along child, ancestor or descendant, and EXISTS."""
    out: list[DeepTest] = []

    def of(e) -> None:
        if isinstance(e, (And, Or)):
            of(e.left)
            of(e.right)
        elif isinstance(e, Exists) or isinstance(getattr(e, "left", None), Operand) and e.left.axis in ("child", "ancestor", "descendant"):
            alias = None if isinstance(e, Exists) or e.left.alias is None else e.left.alias.lower()
            out.append(DeepTest(e, alias, f"__test{first + len(out)}"))

    for e in [q.where, *[j.on for j in q.joins]]:
        if e is not None:
            of(e)
    return out


class Relation:
    """A DataFrame with a struct for each alias."""

    def __init__(self, df: DataFrame, aliases: list[str], deep: list[DeepTest] | None = None):
        self.df, self.aliases, self.inner, self.deep = df, aliases, None, deep or []
        self.places: dict[str, Column] = {}

    def at(self, alias: str) -> Column:
        return self.places.get(alias, F.col(f"`{alias}`"))

    def within(self, places: dict[str, Column], make: Callable):
        """What make() gives while aliases stand for these structs and not for columns."""
        before, self.places = self.places, places
        try:
            return make()
        finally:
            self.places = before

    def fields(self, alias: str) -> list[str]:
        return [f.name for f in self.df.schema[alias].dataType.fields]

    def has(self, alias: str, name: str) -> bool:
        return name.lower() in [f.lower() for f in self.fields(alias)]

    def col(self, alias: str, name: str) -> Column:
        return self.at(alias)[next(f for f in self.fields(alias) if f.lower() == name.lower())]

    def find(self, alias: str | None) -> list[str]:
        if alias is None:
            return [self.inner, *[a for a in self.aliases if a != self.inner]] if self.inner else self.aliases
        got = [a for a in self.aliases if a.lower() == alias.lower()]
        if not got:
            raise QueryError("SEM-0102", f"unknown name {alias}")
        return got

    def value(self, e) -> Column:
        if isinstance(e, Lit):
            return F.lit(None).cast("string") if e.value is None else F.lit(e.value)
        if isinstance(e, Operand):
            return self.operand(e)
        if isinstance(e, Case):
            out = None
            for cond, v in e.whens:
                out = (F if out is None else out).when(self.test(cond), self.value(v).cast("string"))
            return out.otherwise(self.value(e.other).cast("string"))
        if isinstance(e, Call):
            if e.name in ("TEXT", "DIRECT_TEXT", "INNER_HTML", "RAW_INNER_HTML", "ATTR") and e.args and isinstance(e.args[0], Operand):
                o = e.args[0]
                name = o.alias or (o.attr or o.field if o.field != "node" else None)
                own = [a for a in self.aliases if name and a.lower() == name.lower()] or [self.find(None)[0]]
                if "HTML" in e.name:
                    depth = e.args[1].value if len(e.args) > 1 else 1
                    got = depth_limited(self.col(own[0], "inner_html"), depth) if depth < 1 << 30 else self.col(own[0], "inner_html")
                what = "text" if e.name == "TEXT" else "direct_text"
                fits = F.lit(True) if name is None or own[0].lower() == name.lower() else self.col(own[0], "tag") == name.lower()
                if e.name == "ATTR":
                    return F.when(fits, F.element_at(self.col(own[0], "attributes"), e.args[1].value))
                if "HTML" in e.name:
                    return F.when(fits, got if e.name == "RAW_INNER_HTML" else fn.minify(got))
                return F.when(fits, self.col(own[0], what))
            return apply(e.name, [self.value(a) for a in e.args], e.args, blank=True)
        raise QueryError("SEM-0105", "this is not a value here")

    def operand(self, o: Operand) -> Column:
        name = o.attr if o.field == "attribute" else o.field
        if o.field == "node":
            return self.col(self.find(o.alias)[0], "node_id")
        if o.bare and o.field == "attribute":  # a lone name may be an alias' column before it is an attribute
            for a in self.find(None):
                if self.has(a, name):
                    return self.col(a, name)
        for a in self.find(o.alias):
            if o.axis == "parent" and self.has(a, "__parent"):
                up = self.at(a)["__parent"]
                return F.element_at(up["attributes"], o.attr.lower()) if o.field == "attribute" else up[o.field]
            if o.axis not in ("self", "parent"):
                raise QueryError("SEM-0306", f"the {o.axis} axis needs rows of a document")
            if self.has(a, name):
                return self.col(a, name)
            if o.field == "attribute" and self.has(a, "attributes"):
                return F.element_at(self.col(a, "attributes"), o.attr.lower())
        if o.alias is None and o.field not in FIELDS:
            raise QueryError("SEM-0102", f"unknown name {name}")
        return F.lit(None).cast("string")

    def join_test(self, e) -> Column:
        """ON or WHERE, with plain equalities between aliases on typed keys so that they stay equi-joins."""
        if isinstance(e, And):
            return self.join_test(e.left) & self.join_test(e.right)
        if isinstance(e, Compare) and e.op == "=" and all(isinstance(x, Operand) for x in (e.left, e.right)):
            a, b = self.value(e.left), self.value(e.right)
            return a == b if self.numbers(e.left, e.right) else join_key(a) == join_key(b)
        return self.test(e)

    def numbers(self, *values) -> bool:
        """Whether all values are integers by their types, so that nothing has to be read from texts."""
        columns = self.within({}, lambda: [self.value(e).alias(f"v{k}") for k, e in enumerate(values)])
        return all(f.dataType.typeName() in ("long", "integer") for f in self.df.select(*columns).schema)

    def join_key(self, v: Column) -> Column:
        return join_key(v)

    def test(self, e) -> Column:
        return F.coalesce(self._test(e), F.lit(False))

    def _test(self, e) -> Column:
        if isinstance(e, And):
            return self.test(e.left) & self.test(e.right)
        if isinstance(e, Or):
            return self.test(e.left) | self.test(e.right)
        for t in self.deep:
            if t.expr is e:
                for a in self.find(t.alias):
                    if self.has(a, t.name):
                        return self.col(a, t.name)
        if isinstance(e, Compare):
            a = self.value(e.left).cast("string")
            if e.op == "LIKE":
                return fn.like(a, e.right.value if isinstance(e.right, Lit) else self.value(e.right))
            if e.op == "~":
                ok = fn.java_pattern(str(e.right.value)) if isinstance(e.right, Lit) else None
                return F.lit(False) if ok is None else a.rlike(ok)
            x, y = self.value(e.left), self.value(e.right)
            if e.op in fn.FIT and self.numbers(e.left, e.right):
                return fn.FIT[e.op](x, y)
            b = y.cast("string")
            if isinstance(e.left, Operand) and e.left.field == "tag":
                b = fn.lower(b)
                if isinstance(e.right, Lit) and e.op in ("=", "<>"):
                    return fn.FIT[e.op](a, b)
            return fn.compare(e.op, a, b)
        if isinstance(e, In):
            a = self.value(e.left).cast("string")
            return _any(fn.compare("=", a, self.value(x).cast("string")) for x in e.options)
        if isinstance(e, Contains):
            a = fn.lower(self.value(e.left).cast("string"))
            return (_all if e.mode == "all" else _any)(F.contains(a, F.lit(x.lower())) for x in e.options)
        if isinstance(e, IsNull):
            v = self.value(e.left)
            return v.isNotNull() if e.negated else v.isNull()
        if isinstance(e, HasDirectText):
            return F.contains(fn.lower(self.col(self.find(None)[0], "direct_text")), F.lit(e.text.lower()))
        raise QueryError("SEM-0306", "EXISTS needs rows of a document")

    def sort_key(self, o: Operand, down: bool) -> list[Column]:
        """Numbers by value before strings, NULL first when ascending."""
        return [k.desc_nulls_last() if down else k.asc_nulls_first() for k in self.sort_values(o)]

    def sort_values(self, o: Operand) -> list[Column]:
        if self.numbers(o):
            return [self.value(o)]
        v = self.value(o).cast("string")
        return [v.isNotNull(), v.isNotNull() & ~fn.is_int(v), fn.as_int(v), v]

    known = FIELDS

    def order_operand(self, a: str | None, c: str) -> Operand:
        return Operand(a, "self", c.lower()) if c.lower() in FIELDS else Operand(a, "self", "attribute", c, a is None)


def join_key(v: Column) -> Column:
    return F.when(fn.is_int(v), F.concat(F.lit("N:"), fn.as_int(v).cast("string"))).otherwise(F.concat(F.lit("S:"), v.cast("string")))


def constant(e) -> str:
    if isinstance(e, Lit):
        return str(e.value)
    if isinstance(e, Call) and e.name == "CONCAT":
        return "".join(constant(a) for a in e.args)
    raise QueryError("RUN-0002", "PARSE takes a constant or a subquery")


def unique(names: list[str]) -> list[str]:
    seen: dict[str, int] = {}
    out = []
    for n in names:
        k = seen[n.lower()] = seen.get(n.lower(), 0) + 1
        out.append(n if k == 1 else f"{n}__{k}")
    return out


def limited(df: DataFrame, by: list[str], order: list[Column], limit: int | None) -> DataFrame:
    if limit is None:
        return df
    if not by:
        return df.orderBy(*order).limit(limit)
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= limit).drop("__n")


def order_of(order):
    """A comparator of nodes; ties keep the document's order. A missing parent sorts last, first when descending."""

    def compare(a: Column, b: Column) -> Column:
        out = None
        for _, c, down in [*order, (None, "doc_order", False)]:
            c = c.lower()
            if c not in FIELDS or c == "source_uri":
                raise QueryError("SEM-0301", f"cannot order by {c}")
            x, y = a[c], b[c]
            less, more = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
            steps = [(x.isNull() & y.isNotNull(), more), (x.isNotNull() & y.isNull(), less), (x < y, less), (x > y, more)]
            for cond, v in steps:
                out = F.when(cond, v) if out is None else out.when(cond, v)
        return out.otherwise(F.lit(0))

    return compare


def split_descendant(where):
    """The conjuncts on descendants, which pick FLATTEN's nodes, and the rest, which picks its rows."""
    if where is None:
        return None, None
    if isinstance(where, And):
        (a, b), (c, d) = split_descendant(where.left), split_descendant(where.right)
        both = lambda x, y: y if x is None else x if y is None else And(x, y)
        return both(a, c), both(b, d)
    deep = any(isinstance(x, Operand) and x.axis == "descendant" for x in walk(where) if not isinstance(where, Exists))
    if deep and isinstance(where, Or):
        raise QueryError("SEM-0301", "descendant conditions cannot stand under OR with FLATTEN")
    return (where, None) if deep else (None, where)


def shared_scope(s: Project, shared: dict) -> Project:
    s.shared = shared
    return s


def projected(pairs: tuple, scope: Callable[[dict, dict], Project]) -> Column:
    """The columns of a PROJECT as one struct of strings. Values that later expressions name, and the nodes of a tag that
    several selectors read, are bound once."""
    uses = [{o.attr or o.field for o in walk(e) if isinstance(o, Operand) and o.bare} for _, e in pairs]
    tags = [x.tag for _, e in pairs for x in walk(e) if isinstance(x, Selector)]
    often = [t for t in dict.fromkeys(tags) if tags.count(t) > 1]

    def tagged(left: list, shared: dict) -> Column:
        if not left:
            return valued(0, {}, shared, [])
        own = F.filter(scope({}, {}).subtree(), lambda c: c["tag"] == left[0])
        return let(own, lambda nodes: tagged(left[1:], {**shared, left[0]: nodes}))

    def valued(k: int, env: dict, shared: dict, done: list) -> Column:
        if k == len(pairs):
            return F.struct(*[v.cast("string").alias(f"p{at}") for at, v in enumerate(done)])
        name, e = pairs[k]
        value = scope(env, shared).value(e)
        if any(name in u for u in uses[k + 1 :]):
            return let(value, lambda v: valued(k + 1, {**env, name: v}, shared, [*done, v]))
        return valued(k + 1, {**env, name: value}, shared, [*done, value])

    return tagged(often, {})


def flatten(s: Scope, item: Item, where) -> list[Column]:
    depth = item.options["depth"]
    cands = s.candidates("descendant") if depth is None else s.subtree()
    if depth is not None:
        cands = F.filter(cands, lambda c: F.size(c["ancestors"]) == F.size(s.node["ancestors"]) + depth)
    if where is not None:
        conds = lambda e: [*conds(e.left), *conds(e.right)] if isinstance(e, And) else [e]
        near = [on_self(c) for c in conds(where)]
        cands = F.filter(cands, lambda c: reduce(lambda x, y: x & y, [s.inner(c).test(t) for t in near]))
    strict = lambda c: fn.spaces(c["direct_text"])
    texts = F.transform(cands, lambda c: F.when(strict(c) != "", strict(c)).otherwise(fn.spaces(c["inline_text"])))
    if depth is None:
        texts = F.filter(texts, lambda t: t != "")
    return [F.get(texts, k) for k in range(len(item.options["names"]))]


def on_self(e):
    """A condition on descendants as one on the node itself."""
    swap = lambda o: Operand(None, "self", o.field, o.attr) if isinstance(o, Operand) and o.axis == "descendant" else o
    if isinstance(e, Compare):
        return Compare(e.op, swap(e.left), swap(e.right))
    if isinstance(e, In):
        return In(swap(e.left), e.options)
    if isinstance(e, Contains):
        return Contains(e.mode, swap(e.left), e.options)
    if isinstance(e, IsNull):
        return IsNull(swap(e.left), e.negated)
    raise QueryError("SEM-0301", "this condition on descendants does not go with FLATTEN")
