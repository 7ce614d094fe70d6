"""Joins of a document's relations inside its row.

A CTE, a derived table or the nodes themselves are an array of (key, r) in the row of their document. A join looks its
matches up in the right array, sorted by the joined value once for each document; LATERAL does so and then sorts and cuts
what it found. Nothing is shuffled. Rows on the left go in chunks, so that memory is bounded by a chunk and its matches.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafquery.lang.ast import And, Compare, Operand, Select, Source
from leafquery.plans.scope import let
from leafquery.sources.html import EVERY, parse_pages

CHUNK = 1024  # rows on the left that are joined at once
FEW = 16  # up to here a list is read through
PLAIN = frozenset(["star", "self", "tag", "fields", "field", "expr", "project", "flatten"])


def conjuncts(e) -> list:
    return [] if e is None else [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, And) else [e]


class InRow:
    """The FROM and the joins of a statement, row by row. `walk` and the relations' names come from the planner."""

    def __init__(self, planner, q: Select, ctes: dict[str, Select]):
        self.p, self.q, self.ctes = planner, q, ctes
        self.bound: dict[object, str] = {}

    def read_outside(self) -> list[str]:
        """Of the columns of the node behind a row, those that may be read by the statement around a CTE or derived table."""
        from leafquery.plans.planner import needed

        doc = Source("doc", "doc")
        read = needed(replace(self.q, ctes=[], source=doc, joins=[j if j.kind == "lateral" else replace(j, source=doc) for j in self.q.joins]))
        return [h for h in self.p.behind if h not in EVERY or h in read]

    # which statements
    def pages(self, s: Source) -> bool:
        return s.kind == "doc" or s.kind == "name" and s.value.lower() not in self.p.named and s.value.lower() not in self.ctes

    def joined_like(self, q: Select) -> bool:
        """Whether a statement is read as over relations: where CTEs are known before it, it is, even over the pages."""
        return any(q is not c for c in list(self.ctes.values())[:1]) if self.ctes else False

    def made(self, s: Source) -> Select | None:
        """The statement behind a CTE's name or a derived table."""
        return s.value if s.kind == "query" else self.ctes.get(s.value.lower()) if s.kind == "name" else None

    def simple(self, s: Source) -> bool:
        """The pages, or a statement over them that is one array in the row."""
        q = self.made(s)
        if q is None:
            return self.pages(s)
        if self.joined_like(q) and (q.order or q.limit is not None or any(i.kind not in ("star", "self", "tag", "field", "expr") for i in q.items)):
            return False
        one = all(i.kind in PLAIN for i in q.items) and not q.joins and not q.ctes and self.pages(q.source) and not any(a for a, _, _ in q.order)
        return one and (q.limit is None or self.p.scope == "document")

    def fits(self) -> bool:
        q, joins = self.q, self.q.joins
        if not joins or self.p.pages is None or not self.simple(q.source):
            return False
        if all(self.pages(s) for s in [q.source, *[j.source for j in joins]]):  # these read one exchange of the pages
            return False
        for j in joins:
            if j.kind == "lateral":
                inner = j.source.value
                if not isinstance(inner, Select) or inner.joins or inner.ctes or not self.simple(inner.source):
                    return False
            elif not self.simple(j.source) or not any(self.own_id(e.left) or self.own_id(e.right) for e in self.equal(conjuncts(j.on), self.name(j.source))):
                return False
        return True

    def name(self, s: Source) -> str:
        return s.alias or (s.value if s.kind in ("name", "doc") else s.kind)

    def equal(self, terms: list, right: str) -> list[Compare]:
        """The equalities between a value on the right and one on the left, as Compare(left, right)."""
        out = []
        for e in terms:
            if isinstance(e, Compare) and e.op == "=" and all(isinstance(x, Operand) and x.alias and x.axis == "self" for x in (e.left, e.right)):
                own = [x.alias.lower() == right.lower() for x in (e.left, e.right)]
                if own == [False, True]:
                    out.append(e)
                elif own == [True, False]:
                    out.append(Compare("=", e.right, e.left))
        return out

    def own_id(self, o: Operand) -> bool:
        """Whether a value is the id of its relation's nodes, which is there once in a document."""
        for s in [self.q.source, *[j.source for j in self.q.joins if j.kind != "lateral"]]:
            if self.name(s).lower() == o.alias.lower():
                q, field = self.made(s), (o.attr if o.field == "attribute" else o.field).lower()
                if q is not None and any(i.kind in ("project", "flatten") for i in q.items):
                    return False
                if q is None or not any((i.alias or i.name or "").lower() == field for i in q.items):
                    return field in ("node_id", "node")
                named = [i for i in q.items if (i.alias or i.name or "").lower() == field]
                return len(named) == 1 and isinstance(named[0].expr, Operand) and named[0].expr.axis == "self" and named[0].expr.field == "node_id"
        return False

    # arrays
    def bind(self, value: Column, name: str | None = None) -> str:
        """A value as a column of the document's row. A generator keeps it from being put into the lambdas that read it."""
        name = name or f"__bound{len(self.df.columns)}"
        self.df = self.df.select(*[c for c in self.df.columns if c != name], F.explode(F.array(value)).alias(name))
        return name

    def rows(self, s: Source, deep: list) -> tuple[str, str]:
        """alias and the name of an array of (__key, r)."""
        q, alias = self.made(s), self.name(s)
        tests = tuple(t.name for t in deep if q is None and t.alias in (None, alias.lower()))
        key = (id(q), tests) if q is not None else (None, alias.lower() if tests else "", tests)
        if key not in self.bound:
            value = self.p.node_array(alias, deep) if q is None else self.selected(q) if self.joined_like(q) else self.p.select_array(q, self.read_outside())
            self.bound[key] = self.bind(value)
        return alias, self.bound[key]

    def selected(self, q: Select) -> Column:
        """The rows of a statement over one source, read as over relations."""
        from leafquery.plans.planner import deep_tests

        deep = deep_tests(q)
        alias, name = self.rows(q.source, deep)
        rel = self.template([alias], name, deep)
        kept = F.filter(name, lambda x: rel.within({alias: x["r"]}, lambda: rel.join_test(q.where))) if q.where is not None else F.col(name)

        def row(x: Column) -> Column:
            names, values, hidden = rel.within({alias: x["r"]}, lambda: self.p.columns_of(rel, q))
            low, there, read = {c.lower() for c in names}, [h for h in self.p.behind if rel.has(alias, h)], self.read_outside()
            return F.struct(*values, *[h for h, n in zip(hidden, there, strict=True) if n not in low and n in read])

        return F.transform(kept, lambda x: F.struct(x["__key"].alias("__key"), row(x).alias("r")))

    def flat(self, name: str = "__left") -> DataFrame:
        return self.df.select("doc_id", F.explode(name).alias("x")).select("doc_id", "x.*")

    def relation(self) -> tuple[object, bool]:
        """The joined rows (doc_id, __key, a struct for each alias), and whether they come in the statement's order."""
        from leafquery.plans.planner import Relation, deep_tests

        q, p = self.q, self.p
        self.df = parse_pages(p.pages, p.need)
        deep = deep_tests(q)
        alias, name = self.rows(q.source, deep)
        rel = self.template([alias], name, deep)
        mine = [e for e in conjuncts(q.where) if self.only(e, alias)]
        left = F.filter(name, lambda x: self.test(rel, mine, {alias: x["r"]})) if mine else F.col(name)
        ordered = bool(q.order) and q.limit is None and q.items[0].kind != "count" and all((a or "").lower() == alias.lower() for a, _, _ in q.order)
        if ordered:
            left = self.sorted_by(left, rel, q.order, lambda x: {alias: x["r"]})
        self.bind(F.transform(left, lambda x: F.struct(x["__key"].alias("__key"), x["r"].alias(alias))), "__left")
        rel = Relation(self.flat(), [alias], deep)
        for j in q.joins:
            rel = self.lateral(rel, j.source) if j.kind == "lateral" else self.join(rel, j)
        return Relation(self.flat(), rel.aliases, deep), ordered

    def template(self, aliases: list[str], name: str, deep: list, left: object = None):
        """A relation of which only the types are read."""
        from leafquery.plans.planner import Relation

        right = self.flat(name).select(F.col("r").alias(aliases[-1]))
        return Relation(right if left is None else left.df.crossJoin(right), aliases, deep)

    def only(self, e, alias: str) -> bool:
        from leafquery.plans.planner import walk

        found = [x for x in walk(e) if isinstance(x, Operand)]
        return bool(found) and all(x.alias and x.alias.lower() == alias.lower() and x.axis == "self" for x in found) and not self.deep(e)

    def deep(self, e) -> bool:
        from leafquery.lang.ast import Exists
        from leafquery.plans.planner import walk

        return any(isinstance(x, Exists) for x in walk(e))

    def test(self, rel, terms: list, at: dict[str, Column]) -> Column:
        return rel.within(at, lambda: reduce(lambda a, b: a & b, [F.coalesce(rel.join_test(e), F.lit(False)) for e in terms]))

    def sorted_by(self, rows: Column, rel, order: list, at: Callable[[Column], dict]) -> Column:
        """rows in an order; ties stay as they are. Each term sorts all, the last one first."""
        for a, c, down in reversed(order):
            rows = let(rows, self.sorter(rel, rel.order_operand(a, c), down, at))
        return rows

    def sorter(self, rel, o: Operand, down: bool, at: Callable[[Column], dict]) -> Callable[[Column], Column]:
        def keys(x: Column, k: Column) -> Column:
            values = rel.within(at(x), lambda: rel.sort_values(o))
            return F.struct(*[v.alias(f"k{n}") for n, v in enumerate(values)], (-k if down else k).alias("at"))

        return lambda rows: F.transform(F.sort_array(F.transform(rows, keys), not down), lambda s: F.get(rows, F.abs(s["at"])))

    def lookup(self, both, aliases: list[str], alias: str, name: str, terms: list) -> Callable[[Column], Column]:
        """For a row on the left: the rows of the right array that meet the terms, in their order."""
        mine = [e for e in terms if self.only(e, alias)]
        pairs = self.equal([e for e in terms if e not in mine], alias)
        rest = [e for e in terms if e not in mine]
        if pairs:
            pair = pairs[0]
            rest = [e for e in rest if e is not pair and e != pair and e != Compare("=", pair.right, pair.left)]
            numbers = both.numbers(pair.left, pair.right)
            typed = lambda v: v.cast("long") if numbers else both.join_key(v)
            own = lambda r: both.within({alias: r["r"]}, lambda: typed(both.value(pair.right)))
            keyed = F.transform(name, lambda r, k: F.struct((F.when(self.test(both, mine, {alias: r["r"]}), own(r)) if mine else own(r)).alias("v"), k.alias("k")))
            index = self.bind(F.sort_array(F.filter(keyed, lambda s: s["v"].isNotNull())))
            steps = F.filter(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), lambda s: s <= F.size(index))

            def bound(v: Column, past: bool) -> Column:
                fits = (lambda x: x <= v) if past else (lambda x: x < v)
                return F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= F.size(index)) & fits(F.get(index, at + s - 1)["v"]), at + s).otherwise(at))

            def found(x: Column) -> Column:
                value = both.within({a: x[a] for a in aliases}, lambda: typed(both.value(pair.left)))
                some = lambda v: F.when(F.size(index) <= FEW, F.filter(index, lambda s: s["v"] == v)).when(v.isNotNull(), let(bound(v, False), lambda lo: F.slice(index, lo + 1, bound(v, True) - lo)))
                return F.transform(F.coalesce(let(value, some), F.slice(index, 1, 0)), lambda s: F.get(name, s["k"]))
        else:
            small = self.bind(F.filter(name, lambda r: self.test(both, mine, {alias: r["r"]}))) if mine else name

            def found(x: Column) -> Column:
                return F.col(small)

        if not rest:
            return found
        return lambda x: F.filter(found(x), lambda r: self.test(both, rest, {**{a: x[a] for a in aliases}, alias: r["r"]}))

    def chunked(self) -> None:
        n = F.size("__left")
        chunks = F.transform(F.sequence(F.lit(0), (F.greatest(n - 1, F.lit(0)) / CHUNK).cast("int")), lambda c: F.slice("__left", c * CHUNK + 1, CHUNK))
        self.df = self.df.select(*[c for c in self.df.columns if c != "__left"], F.explode(F.when(n > CHUNK, chunks).otherwise(F.array("__left"))).alias("__left"))

    def join(self, left, j):
        from leafquery.plans.planner import Relation

        alias, name = self.rows(j.source, left.deep)
        both = self.template([*left.aliases, alias], name, left.deep, left)
        found = self.lookup(both, left.aliases, alias, name, conjuncts(j.on))
        self.chunked()
        kept = lambda x: [x[a].alias(a) for a in left.aliases]

        def joined(x: Column) -> Column:
            rows = lambda m: F.transform(m, lambda r: F.struct(F.concat(x["__key"], r["__key"]).alias("__key"), *kept(x), r["r"].alias(alias)))
            if j.kind != "left":
                return rows(found(x))
            none = F.transform(F.array(F.lit(0)), lambda _: F.struct(F.concat(x["__key"], F.array(F.lit(-1).cast("long"))).alias("__key"), *kept(x), F.lit(None).cast(both.df.schema[alias].dataType).alias(alias)))
            return let(found(x), lambda m: F.when(F.size(m) > 0, rows(m)).otherwise(none))

        self.bind(F.flatten(F.transform("__left", joined)), "__left")
        return Relation(self.flat(), [*left.aliases, alias], left.deep)

    def lateral(self, left, s: Source):
        from leafquery.plans.planner import HIDDEN, Relation, deep_tests

        q: Select = s.value
        deep = [*left.deep, *deep_tests(q, len(left.deep))]
        alias, name = self.rows(q.source, deep)
        both = self.template([*left.aliases, alias], name, deep, left)
        both.inner = alias
        found = self.lookup(both, left.aliases, alias, name, conjuncts(q.where))
        self.chunked()
        kept = lambda x: [x[a].alias(a) for a in left.aliases]
        places = lambda x, r: {**{a: x[a] for a in left.aliases}, alias: r["r"]}
        if q.items[0].kind == "count":
            count = lambda x: F.struct(F.size(found(x)).cast("long").alias(q.items[0].alias or "count")).alias(s.alias)
            self.bind(F.transform("__left", lambda x: F.struct(x["__key"].alias("__key"), *kept(x), count(x))), "__left")
            return Relation(self.flat(), [*left.aliases, s.alias], left.deep)

        def made(x: Column, r: Column) -> Column:
            def columns() -> list[Column]:
                out = []
                for i in q.items:
                    if i.kind in ("star", "self") or i.kind == "tag" and i.tag == alias.lower():
                        out += [both.col(alias, h).alias(h) for h in HIDDEN if both.has(alias, h)]
                    else:
                        out.append(both.value(i.expr).alias(i.name))
                return out

            return F.struct(*both.within(places(x, r), columns))

        def rows(x: Column) -> Column:
            m = found(x)
            order = [(a or (alias if c.lower() in both.known else None), c, d) for a, c, d in q.order]
            if order:
                m = self.sorted_by(m, both, order, lambda r: places(x, r))
            if q.limit is not None:
                m = F.slice(m, 1, q.limit)
            n = lambda r, k: (k + 1).cast("long") if q.order or q.limit is not None else r["__key"][0]
            return F.transform(m, lambda r, k: F.struct(F.concat(x["__key"], F.array(n(r, k))).alias("__key"), *kept(x), made(x, r).alias(s.alias)))

        self.bind(F.flatten(F.transform("__left", rows)), "__left")
        return Relation(self.flat(), [*left.aliases, s.alias], left.deep)
