"""The nodes of many well-formed pages at once, column by column.

A page is plain if the tree builder of `html` would imply, move and drop nothing in it: its tags nest, html comes first
(or is implied before everything), and no element stands where another one would have to end. Then a node's depth is the
number of open tags before it, and all places follow from the depths. Pages that are not plain are left to the tree builder.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa

SKIP, START, SINGLE, END, ODD = range(5)
DEEPEST = 256
_CACHE = 20_000

#: A tag whose quotes close before its end, so that it reads the same alone and on its page.
_WHOLE = re.compile(r"<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|(?![\"'])))*+)>", re.S)
#: The most common form of it, which needs no decoding of its parts.
_EASY = re.compile(r"<([a-z][a-z0-9-]*+)((?: [a-z][a-z0-9-]*+=\"[^\"&]++\")*+)>")
_PAIR = re.compile(r" ([^=]+)=\"([^\"]+)\"")
_seen: dict[bytes, tuple] = {}


def _read(token: bytes) -> tuple:
    """kind, name, attributes."""
    from leafquery.sources import html as h

    try:
        text = token.decode()
    except UnicodeDecodeError:
        return ODD, "", []
    m = _EASY.fullmatch(text)
    if m:
        pairs = _PAIR.findall(m[2])
        if len(pairs) < 2 or len(dict(pairs)) == len(pairs):
            return (SINGLE if m[1] in h.VOID else START), m[1], pairs
    if text[1:2] in ("!", "?"):
        return (ODD if text.startswith("<!--") else SKIP), "", []
    m = _WHOLE.fullmatch(text)
    if not m:
        return ODD, "", []
    name = m["tag"].lower()
    if m["end"]:
        return (SKIP if name in ("html", "body") else END), name, []
    attrs = h._attributes(m["attrs"])
    return (SINGLE if name in h.VOID or m["attrs"].strip() == "/" else START), name, list(attrs.items())


def fits(tag: str, parent: str) -> bool:
    """Whether a tag inside a parent ('': none) leaves all that is open as it is."""
    from leafquery.sources import html as h

    if tag == "html" or not parent:
        return tag == "html" and not parent
    if tag in ("frameset", "frame", "noframes") or parent in h.RAW or parent == "option":
        return False
    if tag in ("head", "body"):
        return parent == "html"
    if parent in ("html", "head"):
        return parent == "head" and tag in h.HEAD
    if tag in h.BLOCK and (parent == "p" or parent in h.STYLE or parent in ("span", "a")):
        return False
    if tag == "tr":
        return parent in ("table", "thead", "tbody", "tfoot")
    places = {"li": h.FENCE["li"], "dt": ("dl",), "dd": ("dl",), "td": ("tr",), "th": ("tr",), "thead": ("table",), "tbody": ("table",), "tfoot": ("table",), "option": ("select", "optgroup")}
    return tag not in places or parent in places[tag]


def _strings(parts: list[bytes], sizes: np.ndarray | None = None) -> pa.Array:
    """Texts in one Arrow array. sizes: their lengths, if parts are not the texts themselves."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) if sizes is None else sizes
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 1 << 31:
        raise OverflowError("the texts of one part are too large")
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(b"".join(parts)))


def _spans(data: bytes, a: np.ndarray, b: np.ndarray) -> pa.Array:
    return _strings([data[x:y] for x, y in zip(a.tolist(), b.tolist(), strict=True)])


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def nodes_of_plain(pages: list[bytes], group: np.ndarray, need: frozenset, schema: pa.StructType) -> tuple[np.ndarray, Callable[[], tuple[np.ndarray, pa.Array]] | None]:
    """Which pages are not plain; if all are, a function of no arguments for the number of nodes in each page and all
    nodes. group: the row that a page belongs to, as rising numbers; ids count on within a row."""
    from leafquery.sources import html as h

    n = len(pages)
    pages = [b"<html><body>" + p if p[:1] == b"<" and not _OWN.match(p) else p for p in pages]
    data = b"".join(pages)
    offs = np.concatenate([[0], np.cumsum(np.fromiter(map(len, pages), np.int64, n))])
    raw = np.frombuffer(data, np.uint8)
    ang = np.flatnonzero((raw == 60) | (raw == 62))
    first = np.searchsorted(ang, offs)
    count = np.diff(first)
    of = np.repeat(np.arange(n), count)
    wrong = (raw[ang] == 60) != ((np.arange(len(ang)) - first[of]) % 2 == 0)
    bad = (np.bincount(of[wrong], minlength=n) > 0) | (count % 2 == 1) | (count == 0)
    if bad.any():
        return bad, None
    lt, gt, of = ang[0::2], ang[1::2], of[0::2]
    tokens = [data[x:y] for x, y in zip(lt.tolist(), (gt + 1).tolist(), strict=True)]
    if len(_seen) > _CACHE:
        _seen.clear()
    ids: dict[bytes, int] = {}
    kinds: list[tuple] = []
    for t in set(tokens):
        ids[t] = len(kinds)
        got = _seen.get(t)
        if got is None:
            got = _seen[t] = _read(t)
        kinds.append(got)
    tok = np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens))
    names = ["", *sorted({k[1] for k in kinds} - {""})]
    number = {x: k for k, x in enumerate(names)}
    kind = np.array([k[0] for k in kinds])[tok]
    name = np.array([number[k[1]] for k in kinds])[tok]
    one = lambda x: number.get(x, -1)

    def note(at: np.ndarray) -> None:
        """The pages of these tags are not plain."""
        bad[of[at]] = True

    note(kind == ODD)
    # depths: html and body never end before the page does
    delta = (kind == START).astype(np.int64) - (kind == END)
    after = np.cumsum(delta)
    begins = first[:-1] // 2
    after -= (after - delta)[begins][of]
    note((after < 0) | (after > DEEPEST))
    if bad.any():
        return bad, None
    is_node = (kind == START) | (kind == SINGLE)
    at = np.flatnonzero(is_node)
    doc, depth = of[at], (after - delta)[at]
    m = len(tokens) + 1
    opened = np.flatnonzero(kind == START)
    if not len(opened):
        return np.ones(n, bool), None
    keys = np.sort((after - delta)[opened] * m + opened)
    find = lambda level, place: keys[np.searchsorted(keys, level * m + place, "right") - 1] % m
    before = np.cumsum(is_node)  # nodes up to a tag, itself too
    inner = depth > 0
    parent = np.full(len(at), -1)
    parent[inner] = before[find(depth[inner] - 1, at[inner])] - 1
    # each page is one tree, of html, with at most one head, then at most one body
    mine, above = name[at], np.where(inner, name[at][parent], 0)
    pairs, back = np.unique(mine * len(names) + above, return_inverse=True)
    ok = np.array([fits(names[p // len(names)], names[p % len(names)]) for p in pairs.tolist()], bool)
    note(at[~ok[back]])
    for x in ("html", "head", "body"):
        bad |= np.bincount(doc[mine == one(x)], minlength=n) > 1
    bad |= np.bincount(doc[~inner], minlength=n) != 1
    heads = np.flatnonzero(mine == one("head"))
    note(at[heads[np.bincount(doc[mine == one("body")], minlength=n)[doc[heads]] > 0]][_after_body(heads, doc, mine, one("body"))])
    # an end tag ends the innermost open element
    ends = np.flatnonzero(kind == END)
    ended = find(after[ends], ends)
    note(ends[name[ended] != name[ends]])
    raws = np.flatnonzero((kind == START) & np.isin(name, [one(x) for x in h.RAW if x in number]))
    last = np.zeros(len(tokens), bool)
    last[first[1:] // 2 - 1] = True
    note(raws[last[raws] | (kind[np.minimum(raws + 1, len(tokens) - 1)] != END)])
    # texts: what follows a tag, up to the next one
    stop = np.where(last, offs[1:][of], np.concatenate([lt[1:], [len(data)]]))
    lead = lt[begins] > offs[:-1]
    for k in np.flatnonzero(lead).tolist():
        bad[k] |= not data[offs[k] : lt[begins[k]]].isspace()
    tx = np.flatnonzero(stop > gt + 1)
    texts = [data[x:y] for x, y in zip((gt[tx] + 1).tolist(), stop[tx].tolist(), strict=True)]
    level = after[tx]
    holder = np.where(level > 0, before[find(level - 1, tx)] - 1, -1)
    held = np.where(level > 0, mine[holder], 0)
    loose = (level == 0) | (held == one("html")) | (held == one("head"))
    for k in np.flatnonzero(loose).tolist():
        if not texts[k].isspace():
            bad[of[tx[k]]] = True
    if bad.any():
        return bad, None

    def made() -> tuple[np.ndarray, pa.Array]:
        nonlocal texts, tx, holder, held
        total = len(at)
        g = np.arange(total)
        starts = np.searchsorted(doc, np.arange(n + 1))
        sizes = np.diff(starts)
        row_first = starts[np.searchsorted(group, group)]  # of the first page of the same row
        shift = row_first[doc]
        end_tag = at.copy()  # the tag before which a node's texts and nodes end
        end_tag[kind[at] == START] = (first[1:] // 2)[doc][kind[at] == START]
        end_tag[before[ended] - 1] = ends
        sub = np.where(kind[at] == START, before[np.maximum(end_tag - 1, 0)] - 1, g)
        keep = np.flatnonzero(~loose)
        if len(keep) < len(tx):
            texts, tx, holder, held = [texts[k] for k in keep.tolist()], tx[keep], holder[keep], held[keep]
        is_raw = np.isin(held, [one(x) for x in h.RAW if x in number])
        plain = [t if b"&" not in t or r else h._unescape(t.decode()).encode() for t, r in zip(texts, is_raw.tolist(), strict=True)]
        out: dict[str, pa.Array] = {}
        ids_ = pa.array(g - shift)
        out["node_id"] = out["doc_order"] = ids_
        out["tag"] = pa.array(names).take(pa.array(mine))
        out["parent_id"] = pa.array(parent - shift, mask=~inner)
        out["subtree_end"] = pa.array(sub - shift)
        if "attributes" in need:
            used, place = np.unique(tok[at], return_inverse=True)
            attrs = [kinds[k][2] for k in used.tolist()]
            offsets = np.concatenate([[0], np.cumsum([len(a) for a in attrs])]).astype(np.int32)
            flat = [p for a in attrs for p in a]
            out["attributes"] = pa.MapArray.from_arrays(pa.array(offsets), pa.array([k for k, _ in flat], pa.string()), pa.array([v for _, v in flat], pa.string())).take(pa.array(place))
        kids = np.bincount(parent[inner], minlength=total)
        by_parent = g[inner][np.argsort(parent[inner], kind="stable")]
        if "sibling_pos" in need:
            pos = np.ones(total, np.int64)
            rank = np.arange(len(by_parent))
            head = np.concatenate([[0], np.cumsum(kids)])
            pos[by_parent] = rank - head[parent[by_parent]] + 1
            out["sibling_pos"] = pa.array(pos)
        if "max_depth" in need:
            both = np.empty(2 * total, np.int64)
            both[0::2], both[1::2] = g, sub + 1
            out["max_depth"] = pa.array(np.maximum.reduceat(np.concatenate([depth, [0]]), both)[0::2] - depth)
        if "children" in need:
            out["children"] = _lists((g - shift)[by_parent], kids)
        deepest = int(depth.max(initial=0))
        if "ancestors" in need:
            off = np.cumsum(depth) - depth
            values, up = np.empty(int(depth.sum()), np.int64), parent.copy()
            for k in range(deepest):
                has = depth > k
                values[off[has] + k] = (up - shift)[has]
                up[has] = parent[up[has]]
            out["ancestors"] = _lists(values, depth)
        if "lifo" in need:
            out["lifo"] = pa.array((depth + starts[:-1][doc] - shift + starts[1:][doc] - 1 - sub).astype(np.int32))
        for field, tags in (("near_tr", ["tr"]), ("near_cell", ["td", "th"])):
            if field in need:
                is_one, near, up = np.isin(mine, [one(x) for x in tags if x in number]), np.full(total, -1), parent.copy()
                for _ in range(deepest if is_one.any() else 0):
                    hit = (near < 0) & (up >= 0) & is_one[up]
                    near[hit] = up[hit]
                    up = np.where(up >= 0, parent[up], -1)
                out[field] = pa.array((near - shift).astype(np.int32), mask=near < 0)
        if {"text", "inline_text"} & need:
            every = b"".join(plain)
            cum = np.concatenate([[0], np.cumsum(np.fromiter(map(len, plain), np.int64, len(plain)))])
            lo, hi = cum[np.searchsorted(tx, at)], cum[np.searchsorted(tx, end_tag)]
        if "text" in need:
            out["text"] = _spans(every, lo, hi)
        if {"direct_text", "inline_text"} & need:
            order = np.argsort(holder, kind="stable").tolist()
            size = np.bincount(holder, np.fromiter(map(len, plain), np.int64, len(plain)), minlength=total).astype(np.int64)
            direct = _strings([plain[k] for k in order], size)
            if "direct_text" in need:
                out["direct_text"] = direct
        if "inline_text" in need:
            inline = np.isin(mine, [one(x) for x in h.INLINE if x in number])
            away = np.cumsum(~inline)
            whole = away[sub] == away
            some = np.bincount(parent[inner & inline], minlength=total) > 0
            joined = direct.to_pylist()
            for k in np.flatnonzero(some).tolist():
                joined[k] = every[lo[k] : hi[k]].decode() if whole[k] else _inline(k, tx, holder, at, end_tag, parent, inline, plain)
            out["inline_text"] = pa.array(joined, pa.string())
        if "inner_html" in need:
            filled = (kids > 0) | (np.bincount(holder, minlength=total) > 0)
            out["inner_html"] = _markup(kinds, tok, names, mine, kind, of, at, ends, before[ended] - 1, end_tag, depth, doc, filled, tx, [f"<![CDATA[{t.decode()}]]>".encode() if r else h._escaped(t.decode()).encode() for t, r in zip(plain, is_raw.tolist(), strict=True)], n)
        columns = [out[f.name].cast(f.type) for f in schema]
        return sizes, pa.StructArray.from_arrays(columns, fields=list(schema))

    return bad, made


#: Pages that begin with one of these imply no html and body before everything.
_OWN = re.compile(rb"(?i)<(?:[^a-z]|(?:html|head|body|frameset|noframes|frame|script|style|meta|link|title|base)(?=[\s/>]))")


def _after_body(heads: np.ndarray, doc: np.ndarray, mine: np.ndarray, body: int) -> np.ndarray:
    """Of the heads on pages with a body: which come after it."""
    bodies = np.flatnonzero(mine == body)
    heads = heads[np.isin(doc[heads], doc[bodies])]
    return heads > bodies[np.minimum(np.searchsorted(doc[bodies], doc[heads]), max(len(bodies) - 1, 0))] if len(bodies) else np.zeros(0, bool)


def _inline(k: int, tx: np.ndarray, holder: np.ndarray, at: np.ndarray, end_tag: np.ndarray, parent: np.ndarray, inline: np.ndarray, plain: list[bytes]) -> str:
    """The texts below a node that only inline elements part from it."""
    out = []
    near = {k: True}

    def reaches(x: int) -> bool:
        chain = []
        while x not in near:
            chain.append(x)
            if not inline[x]:
                near[x] = False
                break
            x = int(parent[x])
        for y in chain:
            near[y] = near[x]
        return near[x]

    for t in range(*np.searchsorted(tx, [at[k], end_tag[k]]).tolist()):
        if reaches(int(holder[t])):
            out.append(plain[t])
    return b"".join(out).decode()


def _markup(kinds, tok, names, mine, kind, of, at, ends, ended, end_tag, depth, doc, filled, tx, texts, n) -> pa.Array:
    """What stands inside each node, as stretches of the pages' markup: a tag and the text after it, page by page, then the
    ends that a page leaves out."""
    from leafquery.sources.html import _QUOTE

    tags = [b""] * len(tok)
    for k, t in enumerate(at.tolist()):
        _, name, attrs = kinds[tok[t]]
        tags[t] = (f"<{name}" + "".join(f' {a}="{v.translate(_QUOTE)}"' for a, v in attrs) + (">" if filled[k] else "/>")).encode()
    for e, k in zip(ends.tolist(), ended.tolist(), strict=True):
        tags[e] = f"</{names[mine[k]]}>".encode() if filled[k] else b""
    after = [b""] * len(tok)
    for t, x in zip(tx.tolist(), texts, strict=True):
        after[t] = x
    unclosed = np.ones(len(at), bool)
    unclosed[ended] = False
    unclosed &= kind[at] == START
    left: list[list[int]] = [[] for _ in range(n)]
    for k in np.flatnonzero(unclosed).tolist():
        left[doc[k]].append(k)
    pieces, at_tag, past_tag, finish, size, page = [], [0] * len(tok), [0] * len(tok), {}, 0, -1
    bounds = np.searchsorted(of, np.arange(n + 1)).tolist()
    for page in range(n):
        for t in range(bounds[page], bounds[page + 1]):
            at_tag[t] = size
            size += len(tags[t])
            past_tag[t] = size
            size += len(after[t])
            pieces += (tags[t], after[t])
        for k in reversed(left[page]):  # the innermost first
            finish[k] = size
            end = f"</{names[mine[k]]}>".encode() if filled[k] else b""
            size += len(end)
            pieces.append(end)
    a = [past_tag[t] for t in at.tolist()]
    b = [finish[k] if k in finish else at_tag[e] if e != t else past_tag[t] for k, (t, e) in enumerate(zip(at.tolist(), end_tag.tolist(), strict=True))]
    return _spans(b"".join(pieces), np.array(a, np.int64), np.array(b, np.int64))
