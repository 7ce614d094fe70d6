"""What is wrong or doubtful in a statement, with places, as text or JSON."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

from leafquery.lang.ast import Meta, Select
from leafquery.lang.lexer import QueryError, Token, tokens
from leafquery.lang.parser import parse

# Fields that a misspelt member may mean.
BUILT_IN = "tag text node_id parent_id sibling_pos max_depth doc_order attributes attr".split()
WHY = {
    "LINT-0001": "The alias names the rows of the source; as a value it is easily taken for a column.",
    "LINT-0002": "Any name is an attribute, so this is no error, but it is close to a built-in name.",
    "LINT-0003": "No source in FROM or JOIN has this name.",
}


@dataclass
class Finding:
    code: str
    message: str
    at: int
    severity: str = "error"
    end: int = -1
    help: str = ""


@dataclass
class Report:
    """findings, and how far the check went: parse_only (the statement cannot be read, or is no SELECT), full, reduced
    (joins and WITH are checked less), mixed (a script with several of these)."""

    findings: list[Finding] = field(default_factory=list)
    coverage: str = "parse_only"
    parsed: bool = False
    relational: bool = False

    def count(self, severity: str) -> int:
        return sum(f.severity == severity for f in self.findings)


def is_relational(q: Select) -> bool:
    return bool(q.ctes or q.joins or q.source.kind == "query" or any(a for a, _, _ in q.order))


def place(text: str, at: int) -> tuple[int, int]:
    """Line and column, from 1."""
    before = text[: max(0, at)]
    return before.count("\n") + 1, len(before) - (before.rfind("\n") + 1) + 1


def span_of(text: str, f: Finding) -> dict[str, int]:
    start = min(max(0, f.at), len(text))
    word = re.compile(r"[\w-]+").match(text, start)
    end = min(len(text), f.end if f.end > start else word.end() if word else start + 1)
    (line, col), (line2, col2) = place(text, start), place(text, max(end, start))
    at_byte = lambda k: len(text[:k].encode())
    return {"start_line": line, "start_col": col, "end_line": line2, "end_col": col2, "byte_start": at_byte(start), "byte_end": at_byte(end)}


def snippet(text: str, f: Finding) -> str:
    """The line with a caret under the place."""
    s = span_of(text, f)
    line = (text.split("\n") or [""])[s["start_line"] - 1]
    margin = " " * len(str(s["start_line"]))
    width = max(1, s["end_col"] - s["start_col"]) if s["end_line"] == s["start_line"] else 1
    return f"{margin}--> line {s['start_line']}, col {s['start_col']}\n{margin} |\n{s['start_line']} | {line}\n{margin} | {' ' * (s['start_col'] - 1)}{'^' * width}"


def as_text(text: str, findings: list[Finding], colour: bool = False) -> str:
    out = []
    for f in findings:
        head = f"{f.severity}[{f.code}]"
        if colour:
            head = f"\x1b[{31 if f.severity == 'error' else 33}m{head}\x1b[0m"
        out.append(f"{head}: {f.message}\n{snippet(text, f)}" + "".join(f"\n  {k}: {v}" for k, v in (("why", WHY.get(f.code)), ("help", f.help)) if v))
    return "\n\n".join(out)


def as_json(text: str, report: Report) -> str:
    """One object: a summary and the findings, with the same keys whatever was found."""
    status = "parse_failed" if not report.parsed else "failed" if report.count("error") else "warnings" if report.findings else "ok"
    summary = {
        "parse_succeeded": report.parsed,
        "coverage": report.coverage,
        "relation_style_query": report.relational,
        "used_reduced_validation": report.coverage in ("reduced", "mixed"),
        "status": status,
        "error_count": report.count("error"),
        "warning_count": report.count("warning"),
        "note_count": report.count("note"),
    }
    kind = lambda c: "parse" if c.startswith("SYN") else "semantic" if c.startswith("SEM") else "runtime" if c.startswith("RUN") else "suspicion"
    each = [
        {"severity": f.severity.upper(), "code": f.code, "message": f.message, "help": f.help, "span": span_of(text, f), "snippet": snippet(text, f), "related": [], "category": kind(f.code), "why": WHY.get(f.code, "")}
        for f in report.findings
    ]
    return json.dumps({"summary": summary, "diagnostics": each}, ensure_ascii=False)


def distance(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def near(word: str, known: list[str]) -> str | None:
    """The closest of the known words that differs from the word by two letters at most; None if it is one of them."""
    best = min(known, key=lambda k: (distance(word, k), k))
    return best if 0 < distance(word, best) <= 2 and word not in known else None


def warnings_of(text: str, q: Select, functions: list[str]) -> list[Finding]:
    """LINT-0001: SELECT of the source's own alias. LINT-0002: misspelt functions and members. LINT-0003: unknown
    qualifiers in joins."""
    out: list[Finding] = []
    toks = tokens(text)
    add = lambda code, message, t, help="": out.append(Finding(code, message, t.at, "warning", t.at + len(t.text), help))
    if len(q.items) == 1 and q.source.alias and q.items[0].kind in ("tag", "self") and (q.items[0].tag or "").lower() == q.source.alias.lower() and q.source.kind in ("doc", "raw", "path", "parse", "name"):
        t = next(t for t in toks[1:] if t.text.lower() == q.source.alias.lower())
        add("LINT-0001", "the alias of FROM is selected as a value", t, "SELECT self returns the current node")
    bound = {"self", "doc", "document", *(n.lower() for n, _ in q.ctes)}
    bound |= {x.lower() for s in [q.source, *[j.source for j in q.joins]] for x in (s.alias, s.value if isinstance(s.value, str) else None) if x}
    axes = {"parent", "child", "ancestor", "descendant", "attributes", "attr"}
    inner = {t.text.lower() for a, t in zip(toks, toks[1:], strict=False) if a.word in ("AS", "DOC", ")") and t.kind == "name"}
    tags = {i.tag.lower() for i in q.items if i.tag}
    for k, t in enumerate(toks):
        after = toks[k + 1] if k + 1 < len(toks) else Token("end", "", t.at)
        before = toks[k - 1] if k else Token("end", "", 0)
        if t.kind != "name":
            continue
        if after.word == "(" and (best := near(t.word, functions)):
            add("LINT-0002", f"{t.text} is not known; did you mean {best}?", t, f"write {best}")
        if after.word == "." and k + 2 < len(toks) and before.word != ".":
            member, low = toks[k + 2], t.text.lower()
            if member.kind == "name" and low not in axes and (k + 3 >= len(toks) or toks[k + 3].word not in (".", "(")) and (best := near(member.text.lower(), BUILT_IN)):
                add("LINT-0002", f"{t.text}.{member.text} looks like the field {best}", member, f"write {t.text}.{best} for the field")
            if is_relational(q) and low not in bound | axes | inner | tags:
                add("LINT-0003", f"{t.text} may not be bound here", t, "names in scope: " + ", ".join(sorted(bound - {"document"})[:4]))
    return out


def check(text: str, validate, functions: list[str]) -> Report:
    """Reads and validates one statement without running it. validate raises QueryError."""
    report = Report()
    try:
        q = parse(text)
    except QueryError as e:
        report.findings.append(Finding(e.code, e.message, e.at))
        return report
    report.parsed = True
    if isinstance(q, Meta):
        return report
    report.relational = is_relational(q)
    report.coverage = "reduced" if report.relational else "full"
    try:
        validate(q)
    except QueryError as e:
        report.findings.append(Finding(e.code, e.message, e.at))
        return report
    report.findings += warnings_of(text, q, functions)
    return report
