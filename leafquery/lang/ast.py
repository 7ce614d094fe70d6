"""What a statement is made of."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

FIELDS = ("node_id", "tag", "parent_id", "max_depth", "doc_order", "sibling_pos", "text", "source_uri")
AXES = ("self", "parent", "child", "ancestor", "descendant")


@dataclass(frozen=True)
class Lit:
    value: str | int | None


@dataclass(frozen=True)
class Operand:
    """alias.axis.field; field may be `attribute` (with attr), `attributes`, `node` (no field at all) or one of FIELDS.
    bare: a lone name, which may also stand for an alias or a column."""

    alias: str | None
    axis: str
    field: str
    attr: str | None = None
    bare: bool = False


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple = ()


@dataclass(frozen=True)
class Selector:
    """TEXT, DIRECT_TEXT or ATTR of the at-th tag in a row's scope that meets where (-1: the last)."""

    kind: str
    tag: str
    attr: str | None
    where: Any
    at: int


@dataclass(frozen=True)
class Case:
    whens: tuple
    other: Any


@dataclass(frozen=True)
class And:
    left: Any
    right: Any


@dataclass(frozen=True)
class Or:
    left: Any
    right: Any


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class In:
    left: Any
    options: tuple


@dataclass(frozen=True)
class Contains:
    mode: str  # one, all, any
    left: Any
    options: tuple


@dataclass(frozen=True)
class IsNull:
    left: Any
    negated: bool


@dataclass(frozen=True)
class HasDirectText:
    left: Any
    text: str


@dataclass(frozen=True)
class Exists:
    axis: str
    where: Any


@dataclass(frozen=True)
class Item:
    """A select item. kind: star, tag, self, field, expr, text, inner_html, count, summarize, tfidf, flatten, project."""

    kind: str
    tag: str | None = None
    name: str | None = None
    expr: Any = None
    options: dict = field(default_factory=dict)
    alias: str | None = None


@dataclass
class Source:
    """kind: doc, name (CTE or alias of the document), path, raw, parse, query."""

    kind: str
    value: Any = None
    alias: str | None = None


@dataclass
class Join:
    kind: str  # inner, left, cross, lateral
    source: Source
    on: Any = None


@dataclass
class Select:
    items: list[Item]
    source: Source
    exclude: list[str] = field(default_factory=list)
    ctes: list[tuple[str, Any]] = field(default_factory=list)
    joins: list[Join] = field(default_factory=list)
    where: Any = None
    order: list[tuple[str | None, str, bool]] = field(default_factory=list)
    limit: int | None = None
    to: tuple[str, dict] | None = None


@dataclass
class Meta:
    kind: str
