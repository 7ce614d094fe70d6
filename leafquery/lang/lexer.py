"""Tokens of the query language: keywords without regard to case, -- and /* */ comments, no escapes in strings."""

from __future__ import annotations

import re
from dataclasses import dataclass


class QueryError(ValueError):
    """A statement that cannot be read (code SYN-…), checked (SEM-…) or run (RUN-…)."""

    def __init__(self, code: str, message: str, at: int = -1):
        super().__init__(f"{code}: {message}")
        self.code, self.message, self.at = code, message, at


@dataclass(frozen=True)
class Token:
    kind: str  # name, str, int, sym, end
    text: str
    at: int

    @property
    def word(self) -> str:
        return self.text.upper() if self.kind == "name" else self.text if self.kind == "sym" else ""


_SCAN = re.compile(
    r"(?P<skip>\s+|--[^\n]*|/\*.*?\*/)|(?P<open>/\*)|(?P<name>[A-Za-z_][A-Za-z0-9_-]*)|(?P<int>[0-9]+)"
    r"|(?P<str>'[^']*'|\"[^\"]*\")|(?P<bad>['\"])|(?P<sym><=|>=|<>|!=|[=<>~(),.;:*])",
    re.S,
)


def tokens(text: str) -> list[Token]:
    out, at = [], 0
    while at < len(text):
        m = _SCAN.match(text, at)
        if not m:
            raise QueryError("SYN-0002", f"unexpected character {text[at]!r}", at)
        if m["open"]:
            raise QueryError("SYN-0003", "a block comment is not closed", at)
        if m["bad"]:
            raise QueryError("SYN-0004", "a string is not closed", at)
        if not m["skip"]:
            kind = m.lastgroup
            out.append(Token(kind, m[0][1:-1] if kind == "str" else "<>" if m[0] == "!=" else m[0], at))
        at = m.end()
    return [*out, Token("end", "", len(text))]
