"""Recursive descent from tokens to the statement; the first error wins."""

from __future__ import annotations

from leafquery.lang.ast import AXES, FIELDS, And, Call, Case, Compare, Contains, Exists, HasDirectText, In, IsNull, Item, Join, Lit, Meta, Operand, Or, Select, Selector, Source
from leafquery.lang.lexer import QueryError, tokens

SCALARS = frozenset("CONCAT SUBSTRING SUBSTR LENGTH CHAR_LENGTH LOCATE REPLACE REGEX_REPLACE LOWER UPPER LTRIM RTRIM TRIM COALESCE TEXT DIRECT_TEXT ATTR INNER_HTML RAW_INNER_HTML POSITION".split())
SELECTORS = frozenset("TEXT DIRECT_TEXT FIRST_TEXT LAST_TEXT ATTR FIRST_ATTR LAST_ATTR".split())
_STOP = frozenset("WHERE JOIN INNER LEFT CROSS ON ORDER LIMIT TO AS LATERAL".split())


def parse(text: str):
    p = Parser(text)
    out = p.statement()
    p.take(";")
    if p.now.kind != "end":
        p.fail(f"unexpected {p.now.text!r}")
    return out


class Parser:
    def __init__(self, text: str):
        self.all, self.k, self.in_project = tokens(text), 0, False

    @property
    def now(self):
        return self.all[self.k]

    def peek(self, n: int = 1):
        return self.all[min(self.k + n, len(self.all) - 1)]

    def fail(self, message: str, code: str = "SYN-0001"):
        raise QueryError(code, message, self.now.at)

    def take(self, *words: str) -> bool:
        """Takes the words if all of them come next."""
        if all(self.peek(i).word == w for i, w in enumerate(words)):
            self.k += len(words)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            self.fail(f"expected {word}, found {self.now.text or 'the end'!r}")

    def name(self) -> str:
        if self.now.kind != "name":
            self.fail(f"expected a name, found {self.now.text or 'the end'!r}")
        self.k += 1
        return self.all[self.k - 1].text

    def string(self) -> str:
        if self.now.kind != "str":
            self.fail("expected a string")
        self.k += 1
        return self.all[self.k - 1].text

    def number(self) -> int:
        if self.now.kind != "int":
            self.fail("expected a number")
        self.k += 1
        return int(self.all[self.k - 1].text)

    def listed(self, one) -> list:
        out = [one()]
        while self.take(","):
            out.append(one())
        return out

    # statements
    def statement(self):
        if self.take("SHOW"):
            what = self.name().lower()
            if what not in ("input", "inputs", "functions", "axes", "operators"):
                self.fail("SHOW takes INPUT, INPUTS, FUNCTIONS, AXES or OPERATORS")
            return Meta(f"show {what}")
        if self.take("DESCRIBE"):
            what = self.name().lower()
            if what not in ("doc", "document", "language"):
                self.fail("DESCRIBE takes doc or language")
            return Meta("describe language" if what == "language" else "describe doc")
        return self.select()

    def select(self) -> Select:
        ctes = []
        if self.take("WITH"):
            ctes = self.listed(self.cte)
            if len({n.lower() for n, _ in ctes}) < len(ctes):
                self.fail("a CTE name is used twice", "SEM-0201")
        self.need("SELECT")
        items = self.listed(self.item)
        exclude = []
        if self.take("EXCLUDE"):
            if self.take("("):
                exclude = self.listed(self.name)
                self.need(")")
            else:
                exclude = [self.name()]
        self.need("FROM")
        q = Select(items, self.source(), [x.lower() for x in exclude], ctes)
        while (join := self.join()) is not None:
            q.joins.append(join)
        if self.take("WHERE"):
            q.where = self.expr()
        if self.take("ORDER", "BY"):
            q.order = self.listed(self.order)
        if self.take("LIMIT"):
            q.limit = self.number()
        if self.take("TO"):
            q.to = self.target()
        return q

    def cte(self):
        name = self.name()
        self.need("AS")
        self.need("(")
        q = self.select()
        self.take(";")
        self.need(")")
        return name, q

    def order(self):
        first, second = self.name(), None
        if self.take("."):
            second = self.name()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return (first, second, down) if second else (None, first, down)

    def join(self) -> Join | None:
        kind = "left" if self.take("LEFT", "JOIN") else "inner" if self.take("INNER", "JOIN") or self.take("JOIN") else "cross" if self.take("CROSS", "JOIN") else None
        if kind is None:
            return None
        if kind == "cross" and self.take("LATERAL"):
            s = self.source()
            if s.kind != "query" or not s.alias:
                self.fail("LATERAL takes a subquery with an alias", "SEM-0202")
            return Join("lateral", s)
        s = self.source()
        if kind == "cross":
            if self.now.word == "ON":
                self.fail("CROSS JOIN takes no ON", "SEM-0203")
            return Join(kind, s)
        self.need("ON")
        return Join(kind, s, self.expr())

    def source(self) -> Source:
        if self.take("("):
            q = self.select()
            self.take(";")
            self.need(")")
            s = Source("query", q)
        elif self.take("RAW", "("):
            s = Source("raw", self.string())
            self.need(")")
        elif self.take("PARSE", "("):
            s = Source("parse", self.select() if self.now.word in ("SELECT", "WITH") else self.value())
            self.need(")")
        elif self.now.kind == "str":
            s = Source("path", self.string())
        elif self.now.word in ("DOC", "DOCUMENT"):
            s = Source("doc", self.name().lower())
        else:
            s = Source("name", self.name())
        if self.take("AS"):
            s.alias = self.name()
        elif self.now.kind == "name" and self.now.word not in _STOP:
            s.alias = self.name()
        if s.kind == "query" and not s.alias:
            self.fail("a derived table needs an alias", "SEM-0204")
        return s

    def target(self):
        kind = self.name().upper()
        if kind not in ("LIST", "TABLE", "CSV", "PARQUET", "JSON", "NDJSON"):
            self.fail("TO takes LIST, TABLE, CSV, PARQUET, JSON or NDJSON")
        self.need("(")
        options = {}
        if kind == "TABLE":
            while self.now.word != ")":
                key = self.name().upper().replace("NO_HEADER", "NOHEADER")
                if key in options:
                    self.fail(f"{key} is given twice", "SEM-0402")
                known = {"HEADER", "NOHEADER", "EXPORT", "TRIM_EMPTY_ROWS", "TRIM_EMPTY_COLS", "EMPTY_IS", "STOP_AFTER_EMPTY_ROWS", "FORMAT", "SPARSE_SHAPE", "HEADER_NORMALIZE"}
                if key not in known:
                    self.fail(f"unknown table option {key}", "SEM-0401")
                self.take("=")
                options[key] = self.string() if self.now.kind == "str" else self.number() if self.now.kind == "int" else self.name().upper() if self.now.kind == "name" else "ON"
                if not self.take(","):
                    break
        elif kind in ("CSV", "PARQUET"):
            options["path"] = self.string()
        elif kind != "LIST" and self.now.kind == "str":
            options["path"] = self.string()
        self.need(")")
        return kind, options

    # select items
    def item(self) -> Item:
        w = self.now.word
        if self.take("*"):
            return Item("star")
        if self.peek().word == "(":
            if w in ("PROJECT", "FLATTEN_EXTRACT"):
                self.k += 2
                tag = self.name().lower()
                for x in (")", "AS", "("):
                    self.need(x)
                held, self.in_project, pairs = self.in_project, True, []
                while self.now.word != ")":
                    name = self.name()
                    self.need(":")
                    pairs.append((name, self.comparison()))
                    if not self.take(","):
                        break
                self.need(")")
                self.in_project = held
                return Item("project", tag, expr=tuple(pairs))
            if w in ("FLATTEN", "FLATTEN_TEXT"):
                self.k += 2
                tag, depth, names = self.name().lower(), None, ["flatten_text"]
                if self.take(","):
                    depth = self.number()
                self.need(")")
                if self.take("AS", "("):
                    names = self.listed(self.name)
                    self.need(")")
                return Item("flatten", tag, options={"depth": depth, "names": names})
            if w == "COUNT":
                self.k += 2
                tag = None if self.take("*") else self.name()
                self.need(")")
                return Item("count", tag, "count", alias=self.alias())
            if w == "SUMMARIZE":
                self.k += 2
                self.need("*")
                self.need(")")
                return Item("summarize")
            if w == "TFIDF":
                self.k += 2
                return self.tfidf()
            if w in SCALARS or w in SELECTORS:
                held, self.in_project = self.in_project, w.startswith(("FIRST", "LAST"))
                e = self.value()
                self.in_project = held
                alias = self.alias()
                return Item("expr", name=alias or w.lower(), expr=e, alias=alias)
            tag = self.name().lower()
            self.k += 1
            fields = self.listed(self.name)
            self.need(")")
            return Item("fields", tag, expr=tuple(fields))
        if w == "CASE":
            held, self.in_project = self.in_project, True
            e = self.value()
            self.in_project = held
            alias = self.alias()
            return Item("expr", name=alias or "case", expr=e, alias=alias)
        first = self.name()
        if self.now.word == ".":
            path = [first]
            while self.take("."):
                path.append(self.name())
            alias = self.alias()
            name = alias or path[-1]
            return Item("field", first.lower(), name, self.operand(path), alias=alias)
        if first.lower() == "self":
            return Item("self")
        return Item("tag", first.lower(), first, self.operand([first]), alias=self.alias())

    def alias(self) -> str | None:
        return self.name() if self.take("AS") else None

    def tfidf(self) -> Item:
        tags, options = [], {"TOP_TERMS": 30, "MIN_DF": 1, "MAX_DF": 0, "STOPWORDS": "ENGLISH"}
        while True:
            if self.take("*"):
                tags.append("*")
            else:
                name = self.name()
                if self.take("="):
                    if name.upper() not in options:
                        self.fail(f"unknown TFIDF option {name}", "SEM-0301")
                    options[name.upper()] = self.number() if self.now.kind == "int" else self.string().upper() if self.now.kind == "str" else self.name().upper()
                else:
                    tags.append(name.lower())
            if not self.take(","):
                break
        self.need(")")
        return Item("tfidf", expr=tuple(tags), options=options)

    # conditions
    def expr(self):
        left = self.conjunction()
        while self.take("OR"):
            left = Or(left, self.conjunction())
        return left

    def conjunction(self):
        left = self.condition()
        while self.take("AND"):
            left = And(left, self.condition())
        return left

    def condition(self):
        if self.take("("):
            e = self.expr()
            self.need(")")
            return e
        if self.take("EXISTS", "("):
            axis = self.name().lower()
            if axis not in AXES:
                self.fail(f"unknown axis {axis}", "SEM-0101")
            where = self.expr() if self.take("WHERE") else None
            self.need(")")
            return Exists(axis, where)
        left = self.value()
        if self.take("CONTAINS"):
            mode = "all" if self.take("ALL") else "any" if self.take("ANY") else "one"
            if self.take("("):
                options = self.listed(self.string)
                self.need(")")
            else:
                options = [self.string()]
            return Contains(mode, left, tuple(options))
        if self.take("HAS_DIRECT_TEXT"):
            return HasDirectText(left, self.string())
        if self.take("IN"):
            if self.take("("):
                options = self.listed(self.value)
                self.need(")")
            else:
                options = [self.value()]
            return In(left, tuple(options))
        if self.take("IS"):
            negated = self.take("NOT")
            self.need("NULL")
            return IsNull(left, negated)
        op = self.now.word
        if op not in ("=", "<>", "<", "<=", ">", ">=", "~", "LIKE"):
            self.fail(f"expected a comparison, found {self.now.text or 'the end'!r}")
        self.k += 1
        return Compare(op, left, self.value())

    def comparison(self):
        left = self.value()
        while self.now.word in ("=", "<>", "<", "<=", ">", ">=", "LIKE"):
            op = self.now.word
            self.k += 1
            left = Compare(op, left, self.value())
        return left

    # values
    def value(self):
        t = self.now
        if t.kind == "str":
            return Lit(self.string())
        if t.kind == "int":
            return Lit(self.number())
        if self.take("NULL"):
            return Lit(None)
        if self.take("CASE"):
            whens = []
            while self.take("WHEN"):
                cond = self.expr()
                self.need("THEN")
                whens.append((cond, self.value()))
            other = self.value() if self.take("ELSE") else Lit(None)
            self.need("END")
            if not whens:
                self.fail("CASE needs WHEN")
            return Case(tuple(whens), other)
        if t.kind == "name" and self.peek().word == "(":
            return self.call()
        path = [self.name()]
        while self.take("."):
            path.append(self.name())
        return self.operand(path)

    def call(self):
        name = self.name().upper()
        self.need("(")
        if name == "POSITION":
            a = self.value()
            self.need("IN")
            b = self.value()
            self.need(")")
            return Call(name, (a, b))
        if self.in_project and name in SELECTORS:
            return self.selector(name)
        args = []
        if name == "ATTR":
            node = self.name()
            self.need(",")
            args = [Operand(None, "self", "attribute", node, True), Lit(self.name().lower())]
        elif self.now.word != ")":
            args = self.listed(lambda: Lit(1 << 30) if self.take("MAX_DEPTH") else self.value())
        self.need(")")
        return Call(name, tuple(args))

    def selector(self, name: str) -> Selector:
        tag, attr = self.name().lower(), None
        if name.endswith("ATTR"):
            self.need(",")
            attr = self.name().lower()
        held, self.in_project = self.in_project, False
        where = self.expr() if self.take("WHERE") else None
        self.in_project = held
        at = -1 if name.startswith("LAST") else 1
        if self.take(","):
            at = 1 if self.take("FIRST") else -1 if self.take("LAST") else self.number()
        self.need(")")
        return Selector(name.removeprefix("FIRST_").removeprefix("LAST_"), tag, attr, where, at)

    def operand(self, path: list[str]) -> Operand:
        def rest(p: list[str], alias, axis="self") -> Operand:
            low = [x.lower() for x in p]
            if not p:
                return Operand(alias, axis, "node")
            if low[0] in ("attributes", "attr") and len(p) <= 2:
                return Operand(alias, axis, "attribute", low[1]) if len(p) == 2 else Operand(alias, axis, "attributes")
            if len(p) == 1:
                return Operand(alias, axis, low[0]) if low[0] in FIELDS else Operand(alias, axis, "attribute", low[0])
            if low[0] in AXES and axis == "self":
                return rest(p[1:], alias, low[0])
            self.fail(f"cannot read {'.'.join(path)}", "SEM-0102")

        low = path[0].lower()
        if low in AXES:
            return rest(path[1:], None, low)
        if len(path) == 1:
            if low in FIELDS or low == "attributes":
                return Operand(None, "self", low, None, True)
            return Operand(None, "self", "attribute", path[0], True)
        if low in ("attributes", "attr"):
            return rest(path, None)
        return rest(path[1:], path[0])
