"""Statements from templates: {{ name }}, {{ a.b[0] }}, {% for x in list %}, {% if x %}, {# notes #}.

Strict: a name without a value is an error, never an empty text. Values are put in as they are, without escaping. A subset of the usual template syntax, read here as no library may be present.
"""

from __future__ import annotations

import re
import tomllib
from collections.abc import Mapping
from pathlib import Path
from typing import Any

from leafquery.lang.lexer import QueryError

_PART = re.compile(r"\{\{-?\s*(?P<value>.+?)\s*-?\}\}|\{%-?\s*(?P<tag>.+?)\s*-?%\}|\{#.*?#\}", re.S)
_STEP = re.compile(r"\.([A-Za-z_]\w*)|\[(\d+)\]|\[(?:'([^']*)'|\"([^\"]*)\")\]")
_NAME = re.compile(r"[A-Za-z_]\w*")
_FOR = re.compile(r"for\s+(\w+(?:\s*,\s*\w+)*)\s+in\s+(\S+)")


def fail(message: str) -> QueryError:
    return QueryError("RUN-0001", message)


def variables_of(path: str | Path) -> dict[str, Any]:
    """The variables in a TOML file."""
    try:
        return tomllib.loads(Path(path).read_bytes().decode())
    except OSError as e:
        raise fail(f"the variables in {path} cannot be read") from e
    except (UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise fail(f"{path} is not valid TOML: {e}") from e


def value_of(expression: str, names: Mapping[str, Any]) -> Any:
    first = _NAME.match(expression)
    if not first or first[0] not in names:
        raise fail(f"the template's variable {expression!r} has no value")
    value, at = names[first[0]], first.end()
    while at < len(expression):
        step = _STEP.match(expression, at)
        if not step:
            raise fail(f"the template's expression {expression!r} cannot be read")
        key = next(int(x) if k == 2 else x for k, x in enumerate(step.groups(), 1) if x is not None)
        try:
            value = value[key]
        except (KeyError, IndexError, TypeError) as e:
            raise fail(f"the template's variable {expression!r} has no value") from e
        at = step.end()
    return value


def render(template: str, variables: Mapping[str, Any]) -> str:
    """The template with its variables put in."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(template):
        parts.append(("text", template[at : m.start()]))
        at = m.end()
        if m["value"] or m["tag"]:
            parts.append(("value", m["value"]) if m["value"] else ("tag", m["tag"]))
    parts.append(("text", template[at:]))
    out, stop = _run(parts, 0, dict(variables), True)
    if stop < len(parts):
        raise fail(f"{parts[stop][1]!r} ends nothing")
    return out


def _run(parts: list[tuple[str, str]], k: int, names: dict[str, Any], live: bool) -> tuple[str, int]:
    """Renders up to a tag that ends or divides a block; live: whether it is shown."""
    out = []
    while k < len(parts):
        kind, text = parts[k]
        if kind == "text":
            out.append(text if live else "")
        elif kind == "value" and live:
            out.append(str(value_of(text, names)))
        elif kind == "tag":
            words = text.split()
            if words[0] in ("endfor", "endif", "else"):
                return "".join(out), k
            if each := _FOR.fullmatch(text):
                start, stop = k + 1, k + 1
                names_of = [w.strip() for w in each[1].split(",")]
                items = value_of(each[2], names) if live else []
                if not isinstance(items, (list, dict)):
                    raise fail(f"the template's variable {each[2]!r} is no list")
                for n, item in enumerate(items):
                    own = dict(zip(names_of, item, strict=True)) if len(names_of) > 1 else {names_of[0]: item}
                    loop = {"index": n + 1, "index0": n, "first": n == 0, "last": n + 1 == len(items)}
                    done, stop = _run(parts, start, {**names, **own, "loop": loop}, True)
                    out.append(done)
                if not items:
                    _, stop = _run(parts, start, names, False)
                k = _ended(parts, stop, "endfor")
            elif words[0] == "if" and len(words) >= 2:
                no = words[1] == "not"
                holds = live and bool(value_of(" ".join(words[1 + no :]), names)) != no
                done, stop = _run(parts, k + 1, names, holds)
                out.append(done)
                if stop < len(parts) and parts[stop][1].split()[0] == "else":
                    done, stop = _run(parts, stop + 1, names, live and not holds)
                    out.append(done)
                k = _ended(parts, stop, "endif")
            else:
                raise fail(f"the template's tag {text!r} is not known")
        k += 1
    return "".join(out), k


def _ended(parts: list[tuple[str, str]], k: int, word: str) -> int:
    if k >= len(parts) or parts[k] != ("tag", word):
        raise fail(f"a block of the template lacks its {word}")
    return k
