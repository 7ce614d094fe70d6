"""Column builders with the language's semantics: bytes for lengths and positions, ASCII for letter case."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from leafquery.lang.lexer import QueryError

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: Column) -> Column:
    return F.translate(x, _UP, _LOW)


def upper(x: Column) -> Column:
    return F.translate(x, _LOW, _UP)


def trim(x: Column) -> Column:
    """White space and no-break space at both ends."""
    return F.regexp_replace(x, r"^[\s ]+|[\s ]+$", "")


def ltrim(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+", "")


def rtrim(x: Column) -> Column:
    return F.regexp_replace(x, r"\s+$", "")


def spaces(x: Column) -> Column:
    """Trimmed, with white space as one blank."""
    return F.regexp_replace(F.regexp_replace(x, r"^\s+|\s+$", ""), r"\s+", " ")


def length(x: Column) -> Column:
    return F.octet_length(x).cast("long")


def replace(x: Column, old: Column, new: Column) -> Column:
    return F.when(old == "", x).otherwise(F.replace(x, old, new))


#: Not part of ECMAScript patterns: groups other than (?: (?= (?!, possessive repeats, and Java's own escapes.
_FOREIGN = re.compile(r"\(\?(?![:=!])|(?<=[*+?}])\+|\\[AzZGQEhHVRXpPkaeN]")


def java_pattern(pattern: str) -> str | None:
    """The ECMAScript pattern as Java reads it; None if it is not valid."""
    out, at, inside = [], 0, False
    while at < len(pattern):
        c = pattern[at]
        if c == "\\":
            if at + 1 == len(pattern) or (not inside and _FOREIGN.match(pattern, at)):
                return None
            out.append(pattern[at : at + 2])
            at += 2
            continue
        if inside:
            inside = c != "]"
            out.append("\\" + c if c in "[&" else c)  # Java would nest and intersect classes
        elif c == "[":
            inside = True
            out.append(c)
            if pattern.startswith("[^]", at) or pattern.startswith("[]", at):
                return None if pattern.startswith("[]", at) else _valid("".join(out[:-1]) + r"[\s\S]" + (java_pattern(pattern[at + 3 :]) or ""))
        elif _FOREIGN.match(pattern, at) if c in "(+" else False:
            return None
        else:
            out.append(c)
        at += 1
    return _valid("".join(out))


def _valid(pattern: str) -> str | None:
    return None if _groups(pattern) is None else pattern


def _groups(pattern: str) -> int | None:
    """How many groups a Java pattern has; None if it does not compile."""
    jvm = SparkSession.active()._jvm
    try:
        return jvm.java.util.regex.Pattern.compile(pattern).matcher("").groupCount()
    except (Py4JJavaError, PySparkException):
        return None


def java_replacement(new: str, groups: int) -> str:
    """$& and $n in a replacement as Java writes them; a group that the pattern lacks is empty, any other $ is itself."""

    def one(m: re.Match) -> str:
        what = m.group(1)
        if what == "$":
            return r"\$"
        if what == "&":
            return "$0"
        if what and what in "`'":
            raise QueryError("SEM-0501", "the parts before and after a match are not available in a replacement")
        if what and what.isdigit():
            for digits in (what, what[:1]):
                if 1 <= int(digits) <= groups:
                    return f"${int(digits)}" + ("\\" + what[len(digits) :] if len(digits) < len(what) else "")
            return ""
        return r"\$" if m.group(0) == "$" else "\\\\"

    return re.sub(r"\$([$&`']|\d{1,2})?|\\", one, new)


def regex_replace(x: Column, pattern: str, new: str) -> Column:
    """All matches; NULL for a pattern that is not valid. $& is the whole match."""
    ok = java_pattern(pattern)
    return F.lit(None).cast("string") if ok is None else F.regexp_replace(x, F.lit(ok), F.lit(java_replacement(new, _groups(ok))))


def regex_replace_each(x: Column, pattern: Column, new: Column) -> Column:
    """Like regex_replace, with a pattern or a replacement that differs by row. Such patterns are taken as they are, so
    one that is not valid ends the statement."""
    new = F.replace(new, F.lit("\\"), F.lit("\\\\"))
    new = F.regexp_replace(F.regexp_replace(new, r"\$(?![0-9&$])|\$\$", r"\\\$"), r"\$&", r"\$0")
    return F.regexp_replace(x, pattern, new)


def _cut(x: Column, start: Column, n: Column) -> Column:
    """Bytes from start on, as they are: the ends may hold parts of characters."""
    return F.call_function("substring", x.cast("binary"), start, n).cast("string")


def substring(x: Column, start: Column, size: Column | None = None) -> Column:
    """1-based, in bytes; the parts of a character that a cut leaves become replacement characters. Without a size, or
    with NULL, to the end."""
    start = F.greatest(start.cast("int"), F.lit(1))
    n = F.lit(1 << 30) if size is None else F.coalesce(size.cast("int"), F.when(size.isNull(), F.lit(1 << 30)).otherwise(F.lit(0)))
    plain = F.octet_length(x) == F.length(x)
    cut = F.when(plain, F.substring(x, start, n)).otherwise(F.call_function("make_valid_utf8", _cut(x, start, n)))
    return F.when(x.isNotNull() & start.isNotNull(), F.when(n <= 0, F.lit("")).otherwise(cut))


def position(what: Column, x: Column) -> Column:
    """1-based byte position of the first occurrence, 0 if there is none."""
    return F.when(F.contains(x, what), F.octet_length(F.call_function("substring_index", x, what, F.lit(1))) + 1).otherwise(F.when(x.isNotNull() & what.isNotNull(), F.lit(0))).cast("long")


def locate(what: Column, x: Column, start: Column | None = None) -> Column:
    if start is None:
        return F.when(what == "", F.when(x.isNotNull(), F.lit(1))).otherwise(position(what, x)).cast("long")
    begin = F.greatest(F.when(start.isNull(), F.lit(1)).otherwise(start.cast("int")), F.lit(1))
    found = position(what, _cut(x, begin, F.lit(1 << 30)))
    none = F.when(begin - 1 <= F.octet_length(x), begin).otherwise(F.lit(0))
    return F.when(what == "", F.when(x.isNotNull(), none)).when(found == 0, F.lit(0)).otherwise(found + begin - 1).cast("long")


def like(x: Column, pattern: Column | str) -> Column:
    """% and _ without regard to ASCII case; no escape character."""
    if isinstance(pattern, str):
        return lower(x).like(pattern.translate(str.maketrans(_UP, _LOW)).replace("\\", "\\\\"))
    return F.like(lower(x), F.replace(lower(pattern), F.lit("\\"), F.lit("\\\\")))


def is_int(x: Column) -> Column:
    return x.cast("string").rlike(r"^\s*[+-]?[0-9]+$")


def as_int(x: Column) -> Column:
    return F.when(is_int(x), F.trim(x.cast("string")).try_cast("bigint"))


FIT = {"=": lambda x, y: x == y, "<>": lambda x, y: x != y, "<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}


def compare(op: str, a: Column, b: Column) -> Column:
    """As integers if both are written so, else as strings. NULL if either is."""
    fit = FIT[op]
    return F.when(is_int(a) & is_int(b), fit(as_int(a), as_int(b))).otherwise(fit(a.cast("string"), b.cast("string")))


def has_token(x: Column, token: str) -> Column:
    return F.array_contains(F.split(F.trim(x), r"\s+"), token)


#: A comment, an element whose white space counts, with its contents, or a tag (quotes may hold its end).
_TAG_END = r"""[^>"']*+(?:"[^"]*+"[^>"']*+|'[^']*+'[^>"']*+)*+>"""
_KEPT = rf"(?is)<!--.*?(?:-->|\z)|<(pre|code|textarea|script|style)(?=[\s>])(?:{_TAG_END[:-1]})(?<!/)>.*?(?:</\1\s*>|\z)|<{_TAG_END}|<.*"


def minify(x: Column) -> Column:
    """Markup with runs of white space as one blank, and none between tags; comments, tags and the contents of pre,
    code, textarea, script and style stay."""
    joined = F.regexp_replace(x, rf"(?is)({_KEPT[5:]})(?:[ \t\n\x0B\f\r]+(?=<))?".replace(r"\1\s", r"\2\s"), "$1")
    parts = F.regexp_extract_all(joined, F.lit(_KEPT + "|[^<]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda t: F.when(F.startswith(t, F.lit("<")), t).otherwise(F.regexp_replace(t, r"[ \t\n\x0B\f\r]+", " "))), "")
