"""Main text of web pages by a linear-chain conditional random field over the leaf blocks of the DOM.

A block is a run of text between block-level tags. Its features are the tags and the class, id and role words of its
ancestors, and its own length, links, punctuation, wording and place. The field is trained on labelled pages that are
made here from templates (never from the pages to be read), by gradient ascent on the likelihood with exact
forward-backward sums, and decoded by Viterbi.
"""

from __future__ import annotations

import html as _html
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafquery.llm.common import short_batches, texts_of

# HTML's inline elements, those without content, those whose text is never shown, and implied ends.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr nobr picture source".split())
VOID = frozenset("area base br col embed frame hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style noscript template svg iframe object canvas audio video head title select datalist textarea".split())
RAW = frozenset("script style textarea title iframe noframes xmp".split())
CLOSES = {
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "td", "th"]),
    "td": frozenset(["td", "th"]),
    "th": frozenset(["td", "th"]),
    "option": frozenset(["option"]),
    "body": frozenset(["head", "title"]),
}
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
IN_HEAD = frozenset("title meta link script style base noscript template head html".split())
BARRIER = frozenset("table ul ol dl div section article body td th".split())

#: A quote counts only right after `=`, so one in an unquoted value or in prose opens nothing; a tag that is not closed
#: goes to the end of the page. No part can be matched in two ways, so time grows with the page's length.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
_NAMES = re.compile(r"""(?:^|\s)(class|id|role|itemprop|aria-label|data-component|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    path: tuple[str, ...]
    linked: int


def _names(attrs: str) -> str:
    """The words of the attributes that name an element's purpose."""
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return ""
    out = []
    for key, value in _NAMES.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value):
            out.append("hiddenelement")
        elif key != "style":
            out += [w for w in _WORD.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", value)) if len(w) > 1]
    return " ".join(dict.fromkeys(out))


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order. Works on any input: stray ends are ignored, missing ones implied."""
    out: list[Block] = []
    stack: list[str] = []
    keys: list[str] = []
    parts: list[str] = []
    linked = [0]
    hidden = links = 0
    at = 0

    def flush():
        if parts:
            text = "".join(parts)
            text = " ".join((_html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Block(text, tuple(keys), linked[0]))
            parts.clear()
        linked[0] = 0

    def pop(upto: int):
        nonlocal hidden, links
        while len(stack) > upto:
            tag = stack.pop()
            keys.pop()
            hidden -= tag in HIDDEN
            links -= tag == "a"

    n = len(page)
    while at < n:
        found = _TOKEN.search(page, at)
        stop = found.start() if found else n
        if stop > at and not hidden:
            text = page[at:stop]
            parts.append(text)
            if links:
                linked[0] += len(text)
        if not found:
            break
        at = found.end()
        if found[2] is None:
            continue
        tag = found[2].lower()
        if found[1]:
            if tag in stack:
                if tag not in INLINE:
                    flush()
                k = len(stack) - 1 - stack[::-1].index(tag)
                if tag in INLINE and any(t not in INLINE for t in stack[k + 1 :]):
                    continue
                pop(k)
            elif tag in ("p", "br"):
                flush() if tag == "p" else parts.append(" ")
            continue
        if tag not in IN_HEAD and "head" in stack:  # its end may be left out
            pop(stack.index("head"))
        if tag == "br":
            parts.append(" ")
            continue
        if tag not in INLINE:
            flush()
            if tag in ENDS_P and "p" in stack:
                k = len(stack) - 1 - stack[::-1].index("p")
                if not any(t in BARRIER for t in stack[k + 1 :]):
                    pop(k)
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in CLOSES[tag]:
                        pop(k)
                        break
                    if stack[k] in ("ul", "ol", "table", "dl") or tag in ("td", "th") and stack[k] == "tr":
                        break
        if tag in VOID or found[3].endswith("/") and tag not in RAW:
            continue
        stack.append(tag)
        keys.append(tag + "|" + _names(found[3]) if tag not in INLINE else tag + "|")
        hidden += tag in HIDDEN
        links += tag == "a"
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            at = end.start() if end else n
    flush()
    return out


# Words that tell what a block of text is for.
SAYS = {
    "notice": r"cookie|consent|gdpr|accept all|your browser|javascript",
    "rights": r"©|\(c\)|copyright|all rights reserved|privacy|terms",
    "sign": r"subscribe|newsletter|sign up|sign in|log ?in|register|e-?mail address|password|your name|submit|search",
    "share": r"share|tweet|facebook|follow us|print this",
    "reply": r"reply|replies|comments?\b|posted by|said:|ago\b|upvote|report abuse",
    "advert": r"advert|sponsor|promot|buy now|% off|special offer|shop now|deal",
    "more": r"read more|related|you may|recommended|next post|previous|most popular|trending|tags?:|categor|skip to|back to top|home",
}
_SAYS = [(k, re.compile(v, re.I)) for k, v in SAYS.items()]


def path_features(path: tuple[str, ...]) -> list[str]:
    out = set()
    tags = [k.partition("|")[0] for k in path]
    shown = [t for t in tags if t not in INLINE and t not in ("html", "body")]
    out.add("own=" + (shown[-1] if shown else "body"))
    if len(shown) > 1:
        out.add("up=" + shown[-2])
    for t in shown:
        out.add("in=" + t)
    for k in path:
        for w in k.partition("|")[2].split():
            out.add("name=" + w)
            if len(w) > 4:
                out.add("stem=" + w[:5])
    if path:
        near = next((k.partition("|")[2] for k in reversed(path) if k.partition("|")[2]), "")
        out.update("near=" + w for w in near.split())
    return sorted(out)


def text_features(text: str, linked: int, place: float) -> list[str]:
    n = len(text)
    words = text.count(" ") + 1
    out = [f"words={min(7, words.bit_length())}", f"link={min(3, int(4 * linked / n))}", f"place={min(3, int(4 * place))}"]
    if text[-1] in ".!?…\"”»":
        out.append("ends")
    commas = text.count(",") + text.count(". ")
    out.append(f"marks={min(3, commas)}")
    if words > 12:
        out.append("long")
    if n < 400:
        out += ["says=" + k for k, p in _SAYS if p.search(text)]
    return out


@dataclass
class Field:
    """Weights of the features of label 1, and of the four steps from label to label, the first and the last label."""

    weights: dict[str, float]
    step: np.ndarray
    first: np.ndarray
    last: np.ndarray
    known: dict = field(default_factory=dict)

    def emissions(self, blocks: list[Block]) -> np.ndarray:
        w, out = self.weights, np.empty(len(blocks))
        for i, b in enumerate(blocks):
            if (score := self.known.get(b.path)) is None:
                if len(self.known) > 50_000:
                    self.known.clear()
                score = self.known[b.path] = w.get("bias", 0.0) + sum(w.get(f, 0.0) for f in path_features(b.path))
            out[i] = score + sum(w.get(f, 0.0) for f in text_features(b.text, b.linked, i / len(blocks)))
        return out

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels."""
        if not blocks:
            return []
        (a, b), (c, d) = self.step.tolist()
        zero, one = self.first.tolist()
        backs = []
        for i, e in enumerate(self.emissions(blocks).tolist()):
            if i:
                backs.append((b_ := zero + a < one + c, zero + b < one + d))
                zero, one = max(zero + a, one + c), max(zero + b, one + d)
            one += e
        now = int(one + self.last[1] > zero + self.last[0])
        labels = [now]
        for back in reversed(backs):
            now = int(back[now])
            labels.append(now)
        return labels[::-1]

    def extract(self, page: str) -> str:
        blocks = blocks_of(page)
        return " ".join(b.text for b, y in zip(blocks, self.decode(blocks), strict=True) if y)


# --- labelled pages -------------------------------------------------------------------------------------------------
_SYLLABLES = "ka lo mi ren tu sa vel no dar pi che us ton ba li er an da go mar est ine oth ald ven ir ox que lan der sei té ñor ü".split()


class _Maker:
    """Makes pages of which every piece of text is known to be content (1) or not (0)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def sentence(self, low: int = 4, high: int = 18) -> str:
        words = [self.word() for _ in range(self.r.randint(low, high))]
        if len(words) > 6 and self.r.random() < 0.5:
            words[3] += ","
        return " ".join(words).capitalize() + "."

    def text(self, low: int, high: int) -> str:
        return " ".join(self.sentence(2) for _ in range(self.r.randint(low, high)))

    def mark(self, label: int, text: str) -> str:
        return f"\x01{label}{text}\x02"

    def one(self, *options: str) -> str:
        return self.r.choice(options)

    def links(self, n: int, tag: str = "li") -> str:
        return "".join(f"<{tag}><a href='/{self.word()}'>{self.mark(0, self.word().title() if self.r.random() < 0.6 else self.sentence(2, 6))}</a></{tag}>" for _ in range(n))

    def article(self) -> str:
        r = self.r
        out = [f"<h1>{self.mark(1, self.sentence(1, 9).rstrip('.'))}</h1>"] if r.random() < 0.85 else [f"<p>{self.mark(1, self.text(1, 3))}</p>"]
        if r.random() < 0.3:
            out.append(self.one("<p class='byline'>{}</p>", "<div class='meta'>{}</div>").format(self.mark(0, "Posted by " + self.word().title() + ", 3 days ago")) if r.random() < 0.4 else "")
        for _ in range(r.choice([0, 1, 2, 4, 6, 9])):
            kind = r.random()
            if kind < 0.7:
                text = self.text(1, 5)
                if r.random() < 0.2:
                    text = text.replace(" ", f" <a href='#'>{self.word()}</a> ", 1)
                if r.random() < 0.15:
                    text = f"<b>{text}<br>" + self.text(1, 2)
                close = "</p>" if r.random() < 0.85 else ""
                out.append("<p>" + self.mark(1, text) + close)
            elif kind < 0.78:
                out.append(f"<h2>{self.mark(1, self.sentence(1, 6).rstrip('.'))}</h2>")
            elif kind < 0.86:
                out.append("<ul>" + "".join(f"<li>{self.mark(1, self.sentence(2, 9))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                out.append(f"<blockquote><p>{self.mark(1, self.text(1, 2))}</p></blockquote>")
            elif kind < 0.94:
                out.append("<table>" + "".join(f"<tr><td>{self.mark(1, self.word())}<td>{self.mark(1, self.sentence(1, 4))}</tr>" for _ in range(3)) + "</table>")
            elif kind < 0.97:
                out.append(f"<figure><img src=x><figcaption>{self.mark(1, self.sentence(3, 9))}</figcaption></figure>")
            else:
                out.append(f"<div class='{self.one('ad', 'advert', 'ad-slot', 'sponsored', 'promo')}'>{self.mark(0, self.text(1, 3))}</div>")
        if r.random() < 0.15:
            out.append(f"<div class='{self.one('share', 'social', 'share-buttons')}'>{self.links(3, 'span')}</div>")
        return "".join(out)

    def comments(self) -> str:
        a, b = self.one(("section", "comments"), ("div", "comments"), ("div", "comment-list"), ("ol", "commentlist"), ("div", "reader-comments"), ("section", "discussion"), ("div", "responses"))
        item = "li" if a == "ol" else self.one("div", "article", "li", "p")
        each = "".join(f"<{item} class='{self.one('comment', 'comment-body', 'reply')}'>{'<b>' + self.mark(0, self.word().title()) + '</b> ' if item != 'p' else ''}{'<p>' if item != 'p' else ''}{self.mark(0, self.text(1, 4))}</{item}>" for _ in range(self.r.randint(1, 5)))
        return f"<{a} {self.one('id', 'class')}='{b}'><h3>{self.mark(0, self.one('Comments', 'Reader comments', '3 comments', 'Discussion', 'Leave a reply'))}</h3>{each}</{a}>"

    def page(self) -> str:
        r = self.r
        some = lambda p: r.random() < p
        nav = lambda: self.one("<nav>{}</nav>", "<nav><ul>{}</ul></nav>", "<div class='menu'><ul>{}</ul></div>", "<div id='navigation'>{}</div>", "<ul class='nav main-menu'>{}</ul>", "<div role='navigation'>{}</div>", "<div class='breadcrumbs'>{}</div>").format(self.links(r.randint(2, 8)))
        ad = lambda: self.one("<div class='ad'>{}</div>", "<div class='advert'><p>{}</p></div>", "<aside class='ad-banner'>{}</aside>", "<div id='ads'>{}</div>", "<div class='sponsored'>{}</div>", "<section class='promo'><p>{}</p></section>", "<ins class='adsbygoogle'>{}</ins>").format(self.mark(0, self.text(1, 3)))
        notice = lambda: self.one("<div class='cookie-notice'>{}</div>", "<div id='consent' role='dialog'><p>{}</p></div>", "<div class='notice'>{}</div>", "<div role='alert' class='alert'>{}</div>", "<div class='cookie-banner'><p>{}</p></div>", "<div class='popup modal'>{}</div>").format(self.mark(0, self.one("We use cookies. " + self.sentence(), self.text(1, 2), "Please accept cookies to go on.")))
        side = lambda: self.one("<aside>{}</aside>", "<div class='sidebar'>{}</div>", "<div id='sidebar'>{}</div>", "<aside class='related'>{}</aside>", "<div class='widget'>{}</div>", "<section class='related-posts'>{}</section>").format(f"<h3>{self.mark(0, self.one('Related', 'Most popular', 'About us', self.word().title()))}</h3>" + self.one("<ul>" + self.links(4) + "</ul>", "<p>" + self.mark(0, self.text(1, 3)) + "</p>"))
        form = lambda: self.one("<form action=/s>{}</form>", "<div class='newsletter'><form>{}</form></div>", "<form class='signup'><p>{}</p></form>", "<div class='search-form'><form>{}</form></div>").format("<label>" + self.mark(0, self.one("Your name", "E-mail address", "Search", self.sentence(2, 6))) + "</label><input name=q><button>" + self.mark(0, self.one("Send", "Subscribe", "Go")) + "</button>")
        head = lambda: self.one("<header>{}</header>", "<div class='header'>{}</div>", "<div id='masthead'>{}</div>", "<header class='site-header'>{}</header>").format(self.one("<a href=/>", "<p>", "<div class='logo'>") + self.mark(0, self.sentence(1, 5)) + (nav() if some(0.4) else ""))
        foot = lambda: self.one("<footer>{}</footer>", "<div class='footer'>{}</div>", "<div id='footer'><p>{}</p></div>", "<footer class='site-footer'>{}").format(self.mark(0, self.one("&copy; " + self.word() + ".example &middot; " + self.text(1, 3), "Copyright 2020 " + self.word(), self.text(1, 2))))
        wrap = self.one("<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", "<div class='content'>{}</div>", "<div id='main'>{}</div>", "<div class='post'>{}</div>", "<section class='entry-content'>{}</section>", "<div class='article-body'>{}</div>", "<div class='wrapper'><div class='story'>{}</div></div>", "<article class='post' itemprop='articleBody'>{}</article>")
        before = [x() for x, p in ((notice, 0.25), (head, 0.45), (nav, 0.7), (ad, 0.45), (form, 0.15), (side, 0.15)) if some(p)]
        after = [x() for x, p in ((side, 0.3), (self.comments, 0.35), (form, 0.2), (ad, 0.25), (nav, 0.1), (notice, 0.1)) if some(p)]
        before, after = [] if some(0.15) else before, [] if some(0.15) else after
        body = "".join(before) + wrap.format(self.article() + (self.comments() if some(0.08) else "") + (side() if some(0.08) else "")) + "".join(after) + (foot() if some(0.8) else "")
        return f"<!DOCTYPE html><html><head><title>{self.word()}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{body}</body></html>"


def labelled_pages(n: int, seed: int = 1) -> list[tuple[list[Block], list[int]]]:
    """n pages as blocks with labels, the same ones every time."""
    maker, out = _Maker(seed), []
    for _ in range(n):
        blocks, labels = [], []
        for b in blocks_of(maker.page()):
            labels.append(int("\x011" in b.text))
            text = " ".join(re.sub("\x01[01]|\x02", "", b.text).split())
            if text:
                blocks.append(Block(text, b.path, b.linked))
            else:
                labels.pop()
        if blocks:
            out.append((blocks, labels))
    return out


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 120, rate: float = 0.15, ridge: float = 2e-3) -> Field:
    """Ascent on the log-likelihood (Adam), with a ridge penalty; expectations by forward-backward over all pages at once."""
    feats = [[["bias", *path_features(b.path), *text_features(b.text, b.linked, i / len(bs))] for i, b in enumerate(bs)] for bs, _ in pages]
    count: dict[str, int] = {}
    for page in feats:
        for names in page:
            for f in names:
                count[f] = count.get(f, 0) + 1
    index = {f: k for k, f in enumerate(sorted(f for f, c in count.items() if c >= 4))}
    most, n = max(map(len, feats)), len(pages)
    x = np.zeros((n, most, len(index)), np.float32)
    y, on = np.zeros((n, most), np.int64), np.zeros((n, most), bool)
    for p, (page, (_, labels)) in enumerate(zip(feats, pages, strict=True)):
        for t, names in enumerate(page):
            x[p, t, [index[f] for f in names if f in index]] = 1
        y[p, : len(labels)], on[p, : len(labels)] = labels, True
    size = on.sum(1)
    flat = x.reshape(-1, len(index))
    params = np.zeros(len(index) + 8)
    mean, square = np.zeros_like(params), np.zeros_like(params)
    rows = np.arange(n)
    true = np.zeros_like(params)
    true[: len(index)] = flat[(y == 1).ravel() & on.ravel()].sum(0)
    for a in (0, 1):
        true[-4 + a] = (y[:, 0] == a).sum()
        true[-2 + a] = (y[rows, size - 1] == a).sum()
        for b in (0, 1):
            true[-8 + 2 * a + b] = ((y[:, :-1] == a) & (y[:, 1:] == b) & on[:, 1:]).sum()
    for k in range(rounds):
        w, step, first, last = params[:-8], params[-8:-4].reshape(2, 2), params[-4:-2], params[-2:]
        e = (flat @ w.astype(np.float32)).reshape(n, most).astype(float)
        fwd, bwd = np.zeros((most, n, 2)), np.zeros((most, n, 2))
        fwd[0] = first
        fwd[0, :, 1] += e[:, 0]
        for t in range(1, most):
            nxt = np.logaddexp(fwd[t - 1, :, :1] + step[0], fwd[t - 1, :, 1:] + step[1])
            nxt[:, 1] += e[:, t]
            fwd[t] = np.where(on[:, t, None], nxt, fwd[t - 1])
        total = np.logaddexp(fwd[-1, :, 0] + last[0], fwd[-1, :, 1] + last[1])
        bwd[-1] = last
        for t in range(most - 2, -1, -1):
            go = bwd[t + 1].copy()
            go[:, 1] += e[:, t + 1]
            nxt = np.logaddexp(step[:, 0] + go[:, :1], step[:, 1] + go[:, 1:])
            bwd[t] = np.where(on[:, t + 1, None], nxt, bwd[t + 1])
        chance = np.exp(fwd + bwd - total[:, None]) * on.T[:, :, None]
        got = np.zeros_like(params)
        got[: len(index)] = flat.T @ chance[:, :, 1].T.ravel().astype(np.float32)
        got[-4:-2] = chance[0].sum(0)
        got[-2:] = chance[size - 1, rows].sum(0)
        for a in (0, 1):
            for b in (0, 1):
                s = fwd[:-1, :, a] + step[a, b] + bwd[1:, :, b] + (e.T[1:] if b else 0) - total
                got[-8 + 2 * a + b] = (np.exp(s) * on.T[1:]).sum()
        slope = (true - got) / n - ridge * params
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        params += rate * (1 - k / rounds / 1.2) * (mean / (1 - 0.9 ** (k + 1))) / (np.sqrt(square / (1 - 0.999 ** (k + 1))) + 1e-8)
    return Field({f: float(params[k]) for f, k in index.items() if abs(params[k]) > 1e-4}, params[-8:-4].reshape(2, 2), params[-4:-2], params[-2:])


_trained: dict[int, Field] = {}


def default_field(n_pages: int = 500) -> Field:
    if n_pages not in _trained:
        _trained[n_pages] = train(labelled_pages(n_pages))
    return _trained[n_pages]


def extract_pages(pages: DataFrame, model: Field | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: page_id, url, text (the blocks labelled as content, joined by one space), n_chars (code points).

    The whole html is read; null, empty or tag-free input is allowed (null and empty give the empty text). Null ids and
    urls, repeated rows and further columns are allowed; each row gives one row. An empty table gives an empty result.
    """
    short_batches(pages.sparkSession)
    model = model or default_field()
    sent = pages.sparkSession.sparkContext.broadcast((model.weights, model.step, model.first, model.last))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Field(*sent.value)
        for batch in batches:
            texts = [use.extract(h) for h in texts_of(batch, "html")]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")
