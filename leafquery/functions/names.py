"""Column names as identifiers."""

from __future__ import annotations

import re

# Words that need a suffix when they name a column.
RESERVED = frozenset("select from where group order join limit".split())


def normalize(names: list[str]) -> list[str]:
    out, seen = [], {}
    for n in names:
        n = re.sub(r"[^a-z0-9]+", "_", n.strip().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))).strip("_") or "col"
        n = f"c_{n}" if n[0].isdigit() else f"{n}_" if n in RESERVED else n
        seen[n] = seen.get(n, 0) + 1
        out.append(n if seen[n] == 1 else f"{n}__{seen[n]}")
    return out
