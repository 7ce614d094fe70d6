"""Expressions over one row node of a document, as columns.

A document is an array of nodes in which a node's place is its id. parent is a place, child and ancestor are lists of
places, and descendants are a stretch of the array; conditions on them are higher-order functions inside the row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafquery.functions import text as fn
from leafquery.lang.ast import And, Call, Case, Compare, Contains, Exists, HasDirectText, In, IsNull, Lit, Operand, Or, Selector
from leafquery.lang.lexer import QueryError

NUMBERS = frozenset(["node_id", "parent_id", "max_depth", "doc_order", "sibling_pos"])
NULL = F.lit


def _null() -> Column:
    return F.lit(None).cast("string")


def depth_limited(inner: Column, depth: Column | int) -> Column:
    """Markup whose tags below a depth are left out, their text kept. Depth 1 keeps the children's tags."""
    # tags are walked with the level as the state: an opening tag raises it, a closing one lowers it
    parts = F.regexp_extract_all(inner, F.lit(r"<!\[CDATA\[[\s\S]*?\]\]>|<[^>]*>|[^<]+"), F.lit(0))
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("d"))

    def step(a: Column, p: Column) -> Column:
        tag = p.startswith("<") & ~p.startswith("<![CDATA[")
        closing, single = p.startswith("</"), p.endswith("/>") | p.startswith("<!")
        level = F.when(closing, a["d"]).otherwise(a["d"] + 1)
        show = ~tag | (level <= depth)
        after = F.when(~tag | single, a["d"]).when(closing, a["d"] - 1).otherwise(a["d"] + 1)
        return F.struct(F.when(show, F.concat(a["s"], p)).otherwise(a["s"]).alias("s"), after.cast("int").alias("d"))

    return F.aggregate(parts, start, step, lambda a: a["s"])


class Scope:
    """node: the row node; nodes: the document; alias: the source's name; env: columns that earlier PROJECT names gave."""

    def __init__(self, node: Column, nodes: Column, uri: Column, alias: str | None = None, env: dict[str, Column] | None = None, outer: Scope | None = None):
        self.node, self.nodes, self.uri, self.alias, self.env, self.outer = node, nodes, uri, alias, env or {}, outer
        self.shared: dict[str | None, Column] = {}

    def inner(self, node: Column) -> Scope:
        return Scope(node, self.nodes, self.uri, None, {}, self)

    # axes
    def candidates(self, axis: str) -> Column:
        n, of = self.node, lambda places: F.transform(places, lambda k: F.get(self.nodes, k))
        if axis == "self":
            return F.array(n)
        if axis == "parent":
            return F.when(n["parent_id"].isNull(), F.slice(self.nodes, 1, 0)).otherwise(F.slice(self.nodes, n["parent_id"].cast("int") + 1, 1))
        if axis == "child":
            return of(n["children"])
        if axis == "ancestor":
            return of(n["ancestors"])
        return F.slice(self.nodes, n["doc_order"].cast("int") + 2, (n["subtree_end"] - n["doc_order"]).cast("int"))

    def subtree(self) -> Column:
        """The node and its descendants in document order."""
        n = self.node
        return F.slice(self.nodes, n["doc_order"].cast("int") + 1, (n["subtree_end"] - n["doc_order"] + 1).cast("int"))

    def field_of(self, node: Column, o: Operand) -> Column:
        if o.field == "attribute":
            return F.element_at(node["attributes"], o.attr.lower())
        if o.field == "source_uri":
            return self.uri
        if o.field == "node":
            return node["node_id"]
        return node[o.field]

    def owner(self, o: Operand) -> Scope:
        """Where an operand belongs: the innermost scope, unless its alias is that of an outer one."""
        s = self
        while o.alias and s.outer is not None and (s.alias or "").lower() != o.alias.lower():
            s = s.outer
        return s

    def value_of(self, o: Operand) -> Column:
        """An operand's value: on an axis that of the first node that has one (descendants: the last child first)."""
        s = self.owner(o)
        if s is not self:
            return s.value_of(o)
        if o.bare and o.attr in self.env:
            return self.env[o.attr]
        if o.bare and o.field in self.env:
            return self.env[o.field]
        if o.axis == "self":
            return self.field_of(self.node, o)
        if o.axis == "descendant":
            found = F.transform(self.candidates(o.axis), lambda c: F.struct(c["lifo"].alias("k"), self.field_of(c, o).alias("v")))
            return F.get(F.array_sort(F.filter(found, lambda x: x["v"].isNotNull())), 0)["v"]
        return F.get(F.filter(F.transform(self.candidates(o.axis), lambda c: self.field_of(c, o)), lambda v: v.isNotNull()), 0)

    # conditions
    def test(self, e) -> Column:
        return F.coalesce(self._test(e), F.lit(False))

    def _test(self, e) -> Column:
        if isinstance(e, And):
            first, then = (e.right, e.left) if own_tag(e.right) else (e.left, e.right)  # a tag costs less to compare than a text
            return self.test(first) & self.test(then)
        if isinstance(e, Or):
            return self.test(e.left) | self.test(e.right)
        if isinstance(e, Exists):
            found = self.candidates(e.axis)
            return F.size(found) > 0 if e.where is None else F.exists(found, lambda c: self.inner(c).test(e.where))
        if isinstance(e, HasDirectText):
            tag = e.left.attr or e.left.field if isinstance(e.left, Operand) else str(e.left)
            same = F.lit(True) if tag in ("tag", "self") else self.node["tag"] == tag.lower()
            return same & F.contains(fn.lower(self.node["direct_text"]), F.lit(e.text.lower()))
        if isinstance(e, Compare) and e.op == "~":
            if not isinstance(e.right, Lit):
                raise QueryError("SEM-0103", "~ takes a literal pattern")
            ok = fn.java_pattern(str(e.right.value))
            return F.lit(False) if ok is None else self.along(e.left, lambda v: v.cast("string").rlike(ok))
        if isinstance(e, Compare) and isinstance(e.left, Operand) and self._placed(e.left) and isinstance(e.right, Lit):
            return self.along(e.left, lambda v: compare_literal(e.op, self.owner(e.left), e.left, v, e.right.value))
        if isinstance(e, Compare):
            right = self.value(e.right)
            if e.op == "LIKE":
                return self.along(e.left, lambda v: fn.like(v.cast("string"), e.right.value if isinstance(e.right, Lit) else right))
            if e.op == "<>":  # on this path a missing left side differs from any value
                return self.along(e.left, lambda v: F.coalesce(fn.compare("<>", v, right), v.isNull() & right.isNotNull()), missing=True)
            return self.along(e.left, lambda v: fn.compare(e.op, v, right))
        if isinstance(e, In):
            literal = isinstance(e.left, Operand) and self._placed(e.left) and all(isinstance(x, Lit) for x in e.options)
            if literal:
                return self.along(e.left, lambda v: _any(compare_literal("=", self, e.left, v, x.value) for x in e.options))
            options = [self.value(x) for x in e.options]
            return self.along(e.left, lambda v: _any(fn.compare("=", v, x) for x in options))
        if isinstance(e, Contains):
            if isinstance(e.left, Operand) and e.left.field == "attributes":
                values = lambda v: F.map_values(v)
                has = lambda v, x: F.exists(values(v), lambda y: F.contains(fn.lower(y), F.lit(x.lower())))
            else:
                has = lambda v, x: F.contains(fn.lower(v.cast("string")), F.lit(x.lower()))
            join = _all if e.mode == "all" else _any
            return self.along(e.left, lambda v: join(F.coalesce(has(v, x), F.lit(False)) for x in e.options))
        if isinstance(e, IsNull):
            got = self._present(e.left)
            return got if e.negated else ~got
        raise QueryError("SEM-0104", "this is not a condition")

    def _placed(self, o: Operand) -> bool:
        return not (o.bare and (o.attr in self.env or o.field in self.env))

    def _present(self, e) -> Column:
        if not isinstance(e, Operand) or not self._placed(e):
            return self.value(e).isNotNull()
        there = lambda c: F.size(c["attributes"]) > 0 if e.field == "attributes" else self.field_of(c, e).isNotNull()
        s = self.owner(e)
        return there(s.node) if e.axis == "self" else F.exists(s.candidates(e.axis), lambda c: F.coalesce(there(c), F.lit(False)))

    def along(self, e, test: Callable[[Column], Column], missing: bool = False) -> Column:
        """Whether any node of the operand's axis meets the test."""
        if isinstance(e, Operand) and self._placed(e) and e.axis != "self":
            s = self.owner(e)
            return F.exists(s.candidates(e.axis), lambda c: F.coalesce(test(s.field_of(c, e)), F.lit(False)))
        return test(self.value(e))

    # values
    def value(self, e) -> Column:
        if isinstance(e, Lit):
            return _null() if e.value is None else F.lit(e.value)
        if isinstance(e, Operand):
            if e.field == "node" and e.axis == "self":
                return self.node["text"]
            return self.value_of(e)
        if isinstance(e, Case):
            out = None
            for cond, value in e.whens:
                out = (F if out is None else out).when(self.test(cond), self.value(value).cast("string"))
            return out.otherwise(self.value(e.other).cast("string"))
        if isinstance(e, Selector):
            return self.selected(e)
        if isinstance(e, Compare):
            a, b = self.value(e.left), self.value(e.right)
            got = fn.like(a.cast("string"), e.right.value if isinstance(e.right, Lit) else b) if e.op == "LIKE" else fn.compare(e.op, a, b)
            return F.when(got, "true").when(~got, "false")
        if isinstance(e, Call):
            return self.call(e)
        raise QueryError("SEM-0105", "this is not a value")

    def named(self, e) -> tuple[str | None, Column]:
        """The tag that a node argument names (None: any) and whether the row fits it."""
        if isinstance(e, Operand) and e.field == "node":
            return None, F.lit(True)
        tag = (e.attr or e.field).lower() if isinstance(e, Operand) else None
        if tag is None:
            raise QueryError("SEM-0105", "expected a tag or self")
        return tag, self.node["tag"] == tag

    def call(self, e: Call) -> Column:
        name, args = e.name, e.args
        n = self.node
        if name in ("TEXT", "DIRECT_TEXT") and len(args) == 1:
            _, fits = self.named(args[0])
            return F.when(fits, n["text" if name == "TEXT" else "direct_text"])
        if name == "ATTR":
            _, fits = self.named(args[0])
            return F.when(fits, F.element_at(n["attributes"], args[1].value))
        if name in ("INNER_HTML", "RAW_INNER_HTML"):
            _, fits = self.named(args[0])
            depth = args[1].value if len(args) > 1 else 1
            got = n["inner_html"] if depth >= 1 << 30 else depth_limited(n["inner_html"], depth)
            return F.when(fits, got if name == "RAW_INNER_HTML" else fn.minify(got))
        return apply(name, [self.value(a) for a in args], args, blank=bool(self.env) or isinstance(self, Project))

    def selected(self, e: Selector) -> Column:
        # nodes of one tag that several selectors read are taken from the subtree once
        own = self.shared.get(e.tag)
        fits = lambda c: self.inner(c).test(e.where)
        if own is None:
            own = F.filter(self.subtree(), lambda c: c["tag"] == e.tag)
        want = own if e.where is None else F.filter(own, fits)

        def of(c: Column) -> Column:
            if e.kind == "ATTR":
                return F.element_at(c["attributes"], e.attr)
            if e.kind == "DIRECT_TEXT":
                return fn.trim(c["direct_text"])
            tries = [fn.spaces(c[k]) for k in ("direct_text", "inline_text", "text")]
            return F.when(tries[0] != "", tries[0]).when(tries[1] != "", tries[1]).otherwise(tries[2])

        found = F.filter(F.transform(want, of), lambda v: v.isNotNull() & (v != ""))
        return F.get(found, F.size(found) - 1) if e.at < 0 else F.get(found, e.at - 1)


class Project(Scope):
    """The scope of PROJECT: COALESCE also skips blank strings."""


def own_tag(e) -> bool:
    return isinstance(e, Compare) and isinstance(e.left, Operand) and e.left.axis == "self" and e.left.field == "tag" and isinstance(e.right, Lit)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once, however often `then` reads it."""
    return F.transform(F.array(value), then)[0]


def _any(conds) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _all(conds) -> Column:
    out = F.lit(True)
    for c in conds:
        out = out & c
    return out


def compare_literal(op: str, scope: Scope, o: Operand, v: Column, literal) -> Column:
    """An operand against a literal: class by its words, tag without case, numbers as numbers, all else as bytes."""
    if literal is None:
        return F.lit(False)
    if op == "LIKE":
        return fn.like(v.cast("string"), str(literal))
    if o.field == "attribute" and (o.attr or "").lower() == "class" and op in ("=", "<>"):
        same = fn.has_token(v, str(literal))
        return same if op == "=" else v.isNotNull() & ~same
    if o.field in NUMBERS:
        text = str(literal).strip()
        return fn.FIT[op](v, F.lit(int(text)).cast("long")) if text.lstrip("+-").isdigit() and abs(int(text)) < 2**63 else F.lit(False)
    text = F.lit(str(literal).lower() if o.field == "tag" else str(literal))
    if op in ("=", "<>"):
        return v == text if op == "=" else v != text
    return fn.compare(op, v, text)


def constant(e) -> str | None:
    """The value of a literal or of a CONCAT of literals; None for anything else."""
    if isinstance(e, Lit) and e.value is not None:
        return str(e.value)
    parts = [constant(a) for a in e.args] if isinstance(e, Call) and e.name == "CONCAT" and e.args else [None]
    return None if None in parts else "".join(parts)


def apply(name: str, v: list[Column], args: tuple, blank: bool) -> Column:
    """A scalar function of values. Unknown names and wrong numbers of arguments give NULL."""
    s = [x.cast("string") for x in v]
    n = len(v)
    if name == "COALESCE" and n:
        return F.coalesce(*[F.when(fn.trim(x) != "", x) for x in s[:-1]], s[-1]) if blank else F.coalesce(*s)
    if name == "CONCAT" and n:
        return F.concat(*s)
    if name in ("LOWER", "UPPER", "TRIM", "LTRIM", "RTRIM") and n == 1:
        return getattr(fn, name.lower())(s[0])
    if name in ("LENGTH", "CHAR_LENGTH") and n == 1:
        return fn.length(s[0])
    if name in ("SUBSTRING", "SUBSTR") and n in (2, 3):
        return fn.substring(s[0], v[1], v[2] if n == 3 else None)
    if name == "POSITION" and n == 2:
        return fn.locate(s[0], s[1])
    if name == "LOCATE" and n in (2, 3):
        return fn.locate(s[0], s[1], v[2] if n == 3 else None)
    if name == "REPLACE" and n == 3:
        return fn.replace(*s)
    if name == "REGEX_REPLACE" and n == 3:
        fixed = [constant(a) for a in args[1:]]
        if None not in fixed:
            return fn.regex_replace(s[0], *fixed)
        return fn.regex_replace_each(*s)
    return _null()
