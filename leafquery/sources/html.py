"""HTML to node rows: a forgiving tree builder and the scan that runs it over a table of pages.

Each document becomes one row with an array of its nodes in document order, so a node's position in the array is its
id. Axes are then positions or stretches of that array, and no query over one document needs a shuffle.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator
from html.entities import html5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquery.ship import ship
from leafquery.sources.plain import nodes_of_plain

# HTML's element classes and implied ends.
VOID = frozenset("area base basefont br col embed frame hr img input isindex link meta param source track wbr".split())
RAW = frozenset("script style".split())
HEAD = frozenset("script style meta link title base".split())
INLINE = frozenset("a abbr b bdi bdo br cite code data dfn em i kbd mark q rp rt ruby s samp small span strong sub sup time u var wbr".split())
BLOCK = frozenset("address article aside blockquote center dir div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul noframes figure".split())
STYLE = frozenset("b i u em strong font small big s strike tt".split())
ENDS = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "thead": frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]),
    "tbody": frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]),
    "tfoot": frozenset(["tr", "td", "th", "thead", "tbody", "tfoot"]),
    "option": frozenset(["option"]),
    "body": frozenset(["head", "title"]),
}
#: Implied ends are not looked for above these.
FENCE = {"li": frozenset(["ul", "ol", "menu", "dir"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"])}
FENCE |= dict.fromkeys(("tr", "td", "th", "thead", "tbody", "tfoot"), frozenset(["table"]))

_TAG = re.compile(r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*>?|<(?P<end>/?)(?P<tag>[A-Za-z][^\s/>]*+)(?P<attrs>(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>?", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
BOOLEAN = frozenset("checked compact declare defer disabled ismap multiple nohref noresize noshade nowrap readonly selected".split())
_ENTITY = re.compile(r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|([A-Za-z][A-Za-z0-9]*);)")
_ESCAPE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;"})
_QUOTE = str.maketrans({"&": "&amp;", "<": "&lt;", ">": "&gt;", '"': "&quot;"})


def _unescape(text: str) -> str:
    """Character references as characters. A name counts only up to its semicolon; one without stays as it is."""
    return _ENTITY.sub(lambda m: html5.get(m[1] + ";", m[0]) if m[1] else _html.unescape(m[0]), text) if "&" in text else text


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, value in _ATTR.findall(text):
        name = name.lower()
        if name not in out:
            value = value[1:-1] if value[:1] in ("'", '"') and value[-1:] == value[:1] and len(value) > 1 else value
            out[name] = _unescape(value)
            if not value and name in BOOLEAN and not re.search(rf"(?i){re.escape(name)}\s*=", text):
                out[name] = name
    return out


class Node:
    __slots__ = ("attrs", "id", "inline", "inner", "kids", "parent", "parts", "size", "tag", "text")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.kids: list[Node] = []
        self.parts: list[str | Node | tuple[str]] = []  # text, child, or (comment,)
        self.id = self.size = 0
        self.text = self.inline = self.inner = ""


def tree(page: str) -> list[Node]:
    """The document's roots; none for empty input. Any input is accepted: strays are dropped, what is missing implied."""
    roots: list[Node] = []
    stack: list[Node] = []
    seen = set()

    def open_(tag: str, attrs: dict[str, str]) -> Node:
        parent = stack[-1] if stack else None
        node = Node(tag, attrs, parent)
        if parent:
            parent.kids.append(node)
            parent.parts.append(node)
        else:
            roots.append(node)
        stack.append(node)
        seen.add(tag)
        return node

    def close(upto: int) -> None:
        del stack[upto:]

    def imply(tag: str | None) -> None:
        """html, head and body around what stands bare; tag None: text."""
        if tag == "html":
            return
        if not stack:
            if roots:  # after the end everything goes on in the body, or in html
                stack.append(roots[0])
                if roots[0].kids and roots[0].kids[-1].tag == "body":
                    stack.append(roots[0].kids[-1])
            else:
                open_("html", {})
        if tag in ("head", "body", "frameset"):
            return
        names = [n.tag for n in stack]
        if tag in HEAD and "body" not in seen and "frameset" not in seen:
            if len(stack) == 1:
                open_("head", {}) if "head" not in seen else None
            return
        if "noframes" in names and "body" not in names and tag is not None:
            open_("body", {})
        elif names[-1] == "head" or len(stack) == 1:
            if names[-1] == "head":
                close(len(stack) - 1)
            if "body" not in seen and "frameset" not in seen:
                open_("body", {})

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        stop = m.start() if m else n
        if stop > at:
            text = _unescape(page[at:stop])
            if text.strip() or stack and stack[-1].tag not in ("html", "head", "table", "tr", "ul", "ol"):
                if text.strip():
                    bare = not stack and not roots
                    imply(None)
                    if bare:
                        open_("p", {})
                if stack:
                    stack[-1].parts.append(text)
            elif stack and stack[-1].tag not in ("html", "head"):
                stack[-1].parts.append(text)
        if not m:
            break
        at = m.end()
        if m["comment"] is not None:
            if stack:
                stack[-1].parts.append((m["comment"],))
            continue
        if m["tag"] is None:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            if tag == "p" and not any(x.tag == "p" for x in stack):
                imply("p")
                open_("p", {})
                close(len(stack) - 1)
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == tag:
                    if tag not in ("html", "body"):  # these end with the input
                        close(k)
                    break
                if tag in INLINE and stack[k].tag in BLOCK | {"td", "th", "table", "body"}:
                    break
            continue
        attrs = _attributes(m["attrs"])
        if tag in ("html", "body", "head") and tag in seen:
            if tag != "head":
                for node in (x for x in (*stack, *roots) if x.tag == tag):
                    node.attrs = {**attrs, **node.attrs}
            continue
        if tag in BLOCK:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag == "p":
                    close(k)
                    break
                if stack[k].tag not in STYLE | {"span", "a"}:
                    break
            while tag == "p" and stack and stack[-1].tag in STYLE and not stack[-1].parts:  # <b><p> leaves <b/> behind
                close(len(stack) - 1)
        if tag in ENDS:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k].tag in ENDS[tag]:
                    last = k
                    while last and stack[last - 1].tag in ENDS[tag]:
                        last -= 1
                    close(last)
                    break
                if stack[k].tag in FENCE.get(tag, ()):
                    break
        imply(tag)
        node = open_(tag, attrs)
        if tag in VOID or m["attrs"].endswith("/") and tag in VOID:
            close(len(stack) - 1)
        elif m["attrs"].endswith("/") and m["attrs"].strip() == "/":
            close(len(stack) - 1)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = end.start() if end else n
            if stop > at:
                node.parts.append(page[at:stop])
            at = stop
    return roots


def _escaped(text: str) -> str:
    return text.translate(_ESCAPE) if "&" in text or "<" in text or ">" in text else text


def markup_of(node: Node) -> str:
    """What stands inside a node, as markup. Its children's must be known."""
    out = []
    for part in node.parts:
        if isinstance(part, str):
            out.append(f"<![CDATA[{part}]]>" if node.tag in RAW else _escaped(part))
        elif isinstance(part, tuple):
            out.append(f"<!--{part[0]}-->")
        else:
            attrs = "".join(f' {k}="{v.translate(_QUOTE)}"' for k, v in part.attrs.items()) if part.attrs else ""
            out.append(f"<{part.tag}{attrs}>{part.inner}</{part.tag}>" if part.parts else f"<{part.tag}{attrs}/>")
    return "".join(out)


NODE = pa.struct(
    [
        ("node_id", pa.int64()), ("tag", pa.string()), ("attributes", pa.map_(pa.string(), pa.string())), ("parent_id", pa.int64()), ("max_depth", pa.int64()),
        ("doc_order", pa.int64()), ("sibling_pos", pa.int64()), ("subtree_end", pa.int64()), ("children", pa.list_(pa.int32())), ("ancestors", pa.list_(pa.int32())),
        ("lifo", pa.int32()), ("near_tr", pa.int32()), ("near_cell", pa.int32()),
        ("text", pa.string()), ("direct_text", pa.string()), ("inline_text", pa.string()), ("inner_html", pa.string()),
    ]
)
_DDL = dict(
    f.split(":", 1) for f in "node_id:bigint;tag:string;attributes:map<string,string>;parent_id:bigint;max_depth:bigint;doc_order:bigint;sibling_pos:bigint;subtree_end:bigint;children:array<int>;ancestors:array<int>;"
    "lifo:int;near_tr:int;near_cell:int;text:string;direct_text:string;inline_text:string;inner_html:string".split(";")
)
#: What only some queries need; each costs time and space that grows with the depth of a page.
TEXTS = ("text", "direct_text", "inline_text", "inner_html")
LINKS = ("attributes", "max_depth", "sibling_pos", "children", "ancestors", "lifo", "near_tr", "near_cell")
EVERY = frozenset(TEXTS + LINKS)
#: Pages that are parsed together.
PART_ROWS, PART_BYTES = 512, 1 << 20


def nodes_of(pages: list[str], need: frozenset = frozenset(TEXTS)) -> list[dict]:
    """The nodes of one page, or of several as one forest."""
    out: list[dict] = []
    for page in pages:
        roots = tree(page or "")
        order: list[tuple[Node, int, list[int], int | None, int | None]] = []
        todo = [(r, 1, [], None, None) for r in reversed(roots)]
        while todo:
            node, pos, above, tr, cell = todo.pop()
            node.id = len(out) + len(order)
            order.append((node, pos, above, tr, cell))
            inside = [node.id, *above]
            tr2, cell2 = (node.id if node.tag == "tr" else tr), (node.id if node.tag in ("td", "th") else cell)
            todo += [(k, len(node.kids) - i, inside, tr2, cell2) for i, k in enumerate(reversed(node.kids))]
        height: dict[int, int] = {}
        for node, *_ in reversed(order):
            node.size = 1 + sum(k.size for k in node.kids)
            height[node.id] = 1 + max((height[k.id] for k in node.kids), default=-1)
            if "text" in need:
                node.text = "".join([p if isinstance(p, str) else p.text for p in node.parts if not isinstance(p, tuple)])
            if "inline_text" in need:
                node.inline = "".join([p if isinstance(p, str) else p.inline for p in node.parts if isinstance(p, str) or isinstance(p, Node) and p.tag in INLINE])
            if "inner_html" in need:
                node.inner = markup_of(node)
        lifo, todo2 = {}, list(roots)
        while todo2:
            node = todo2.pop()
            lifo[node.id] = len(out) + len(lifo)
            todo2 += node.kids
        rows = []
        for node, pos, above, tr, cell in order:
            row = {
                "node_id": node.id, "tag": node.tag, "attributes": list(node.attrs.items()), "parent_id": above[0] if above else None, "max_depth": height[node.id],
                "doc_order": node.id, "sibling_pos": pos, "subtree_end": node.id + node.size - 1, "children": [k.id for k in node.kids], "ancestors": above,
                "lifo": lifo[node.id], "near_tr": tr, "near_cell": cell,
            }
            if "text" in need:
                row["text"] = node.text
            if "direct_text" in need:
                row["direct_text"] = "".join(p for p in node.parts if isinstance(p, str))
            if "inline_text" in need:
                row["inline_text"] = node.inline
            if "inner_html" in need:
                row["inner_html"] = node.inner
            rows.append(row)
        out += rows
    return out


def node_of(need: frozenset) -> pa.StructType:
    """A node with those columns that are always there or needed."""
    return pa.struct([f for f in NODE if f.name not in EVERY or f.name in need])


def nodes_array(docs: list[list[dict]], need: frozenset = EVERY) -> pa.Array:
    """Documents' nodes as one Arrow array, column by column."""
    rows = [n for d in docs for n in d]
    offsets = [0]
    for d in docs:
        offsets.append(offsets[-1] + len(d))
    columns = [pa.array([n.get(f.name) for n in rows], f.type) for f in node_of(need)]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(node_of(need))))


def parsed(docs: list, need: frozenset = EVERY) -> pa.Array:
    """The nodes of documents (a page, or a list of fragments that form one forest): plain ones together, the others one
    by one."""
    forests = [[y for y in x or [] if y] if isinstance(x, list) else [x] if x else [] for x in docs]
    plain = [k for k, f in enumerate(forests) if f]
    got = None
    while plain:
        group = np.repeat(np.arange(len(plain)), [len(forests[k]) for k in plain])
        odd, made = nodes_of_plain([p.encode() for k in plain for p in forests[k]], group, need, node_of(need))
        if made:
            sizes, nodes = made()
            offsets = np.concatenate([[0], np.cumsum(np.bincount(group, sizes, minlength=len(plain)))]).astype(np.int32)
            got = pa.ListArray.from_arrays(pa.array(offsets), nodes)
            break
        out = set(group[odd].tolist())
        plain = [k for at, k in enumerate(plain) if at not in out]
    if len(plain) == len(docs) and got is not None:
        return got
    known = set(plain)
    others = [k for k in range(len(docs)) if k not in known]
    slow = nodes_array([nodes_of(forests[k], need) for k in others], need)
    if got is None:
        return slow
    place = np.empty(len(docs), np.int64)
    place[plain], place[others] = np.arange(len(plain)), len(plain) + np.arange(len(others))
    return pa.concat_arrays([got, slow]).take(pa.array(place))


def parse_pages(pages: DataFrame, need: frozenset = EVERY, html: str = "html") -> DataFrame:
    """pages (doc_id, source_uri, html: a string, or an array of fragments that form one forest): doc_id, source_uri, nodes.

    A null page has no nodes. need: the columns of EVERY that the query reads; a node
    has no others.
    """
    ship(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = 0
            while k < batch.num_rows:
                part = batch.slice(k, PART_ROWS)
                if part.column(2).nbytes > PART_BYTES:
                    part = part.slice(0, max(1, part.num_rows * PART_BYTES // part.column(2).nbytes))
                k += part.num_rows
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), parsed(part.column(2).to_pylist(), need)], names=["doc_id", "source_uri", "nodes"])

    return pages.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source_uri").cast("string").alias("source_uri"), html).mapInArrow(run, f"doc_id long, source_uri string, nodes array<struct<{','.join(f'{f.name}:{_DDL[f.name]}' for f in node_of(need))}>>")
