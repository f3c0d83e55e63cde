"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the page.

A tolerant tag scanner cuts the page into leaf blocks (runs of text without a block-level tag between them) with the tags, classes and
ids above them. Features of a block come from its ancestors and its text; the field has two labels (main text or not), is
trained by gradient ascent on the likelihood of labelled pages, and each page is decoded by Viterbi. Labelled pages are made here from layouts with
known main blocks unless others are given; see ``made_pages``.

Defined cases. A null or empty page has the empty text. Unclosed and stray tags, cut-off pages and cut-off character references are
read as they stand; script and style without an end go on to the end of the page. All kinds of white space, ``<br>`` included, become one space inside a block; blocks without other text are left out.
Pages are scanned whole. Ids and addresses, null or repeated, are carried as they come; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements of other vocabularies, which ``/>`` closes.
FOREIGN = frozenset("svg g path rect circle ellipse line polyline polygon text tspan textpath use symbol defs math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle mspace msub msup msubsup munder mover munderover mtable mtr mtd mpadded mphantom mfenced menclose semantics annotation".split())
#: Elements that stand inside a line of text.
INLINE = FOREIGN | frozenset("a abbr acronym audio b bdi bdo big canvas cite code data del dfn em font i ins kbd label mark noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var video wbr".split())
#: Elements without content.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
_SKIPPED = RAW - {"textarea", "title", "xmp"}
#: Controls, and elements that stand in none, so that a control still open was left so.
CONTROLS = ("button", "select", "option", "optgroup", "datalist")
NO_CONTROL = frozenset("article aside blockquote body dl footer form h1 h2 h3 h4 h5 h6 header main nav ol p pre section table ul".split())
#: Which open elements a start tag closes.
CLOSES = {"p": ("p",), "li": ("li", "p"), "dt": ("dt", "dd", "p"), "dd": ("dt", "dd", "p"), "tr": ("tr", "td", "th", "p"), "td": ("td", "th", "p"), "th": ("td", "th", "p"), "option": ("option",)}
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTR = re.compile(r"\b(class|id|role|itemprop|aria-hidden|hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+")


@dataclass
class Block:
    text: str
    tag: str  # the nearest element that isn't inline
    above: frozenset[str]  # names of the elements around it
    marks: frozenset[str]  # words of their classes, ids and roles
    linked: float  # share of the text inside links


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks with text, in page order."""
    page = page or ""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    open_, marked = Counter(), Counter()  # how many of each element and mark are open
    text: list[str] = []
    linked, size, links = 0, 0, 0

    def close():
        nonlocal text, linked, size
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                tag = next((n for n, _ in reversed(stack) if n not in INLINE), "")
                out.append(Block(whole, tag, frozenset(open_.keys() - INLINE), frozenset(marked), linked / max(size, 1)))
        text, linked, size = [], 0, 0

    def say(raw: str):
        nonlocal linked, size
        if raw:
            t = unescape(raw) if "&" in raw else raw
            text.append(t)
            size += len(t)
            linked += len(t) * (links > 0)

    def push(name: str, marks: tuple[str, ...]):
        stack.append((name, marks))
        open_[name] += 1
        marked.update(marks)

    def drop(i: int):
        """Takes an element off the stack."""
        nonlocal links
        name, marks = stack.pop(i)
        links -= name == "a"
        for held, keys in ((open_, (name,)), (marked, marks)):
            for k in keys:
                held[k] -= 1
                if not held[k]:
                    del held[k]

    def pop(names, limit=None):
        """Closes open elements down to the last of ``names``, if one is open above ``limit``."""
        if not any(n in open_ for n in names):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                close()
                while len(stack) > i:
                    drop(-1)
                return
            if limit and stack[i][0] in limit:
                return

    at = 0
    unclosed: set[str] = set()  # raw elements of which no end follows
    while (m := _TAG.search(page, at)) is not None:
        say(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in INLINE:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == name:
                        drop(i)
                        break
                    if stack[i][0] not in INLINE:
                        break
            elif name == "p" and "p" not in open_:
                close()
            else:
                pop((name,))
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                close()
            continue
        marks = ()
        if m[3]:
            found = []
            for key, value in _ATTR.findall(m[3]):
                key, value = key.lower(), value.strip("\"'").lower()
                if key in ("hidden", "aria-hidden"):
                    found += ["hidden"] if value != "false" else []
                elif key == "style":
                    found += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value) else []
                else:
                    found += _WORD.findall(value)
            marks = tuple(found)
        if name in FOREIGN and m[3].rstrip().endswith("/"):
            continue
        if name in RAW:
            end = None if name in unclosed else re.compile(rf"</{name}\s*>", re.I).search(page, at)
            if end is None:
                # Code goes on to the end; any other start tag alone is a stray one.
                unclosed.add(name)
                at = len(page) if name in ("script", "style") else at
                continue
            if name not in _SKIPPED:
                close()
                push(name, marks)
                if name == "xmp":
                    say(page[at : end.start()].replace("&", "&amp;"))
                else:
                    say(re.sub(r"<[^>]*>", " ", page[at : end.start()]))
                close()
                drop(-1)
            at = end.end()
            continue
        if name not in INLINE:
            close()
            # Inline elements left open don't reach into the next block.
            while stack and stack[-1][0] in INLINE:
                drop(-1)
            if name in NO_CONTROL:
                while any(n in open_ for n in CONTROLS):
                    pop(CONTROLS)
            if name in CLOSES:
                pop(CLOSES[name], ("ul", "ol", "dl", "table", "article", "section", "div", "body", "td", "th") if name != "tr" else ("table",))
        push(name, marks)
        links += name == "a"
    say(page[at:])
    close()
    return out


def features(found: list[Block]) -> list[list[str]]:
    out = []
    n = len(found)
    for i, b in enumerate(found):
        words = b.text.count(" ") + 1
        x = ["bias", f"words{min(6, words.bit_length())}", f"linked{int(b.linked * 3.99)}", f"tag={b.tag}"]
        x += [f"in={t}" for t in b.above] + [f"mark={w}" for w in b.marks]
        if b.text[-1] in ".!?…":
            x.append("sentence")
        if "©" in b.text or "(c)" in b.text.lower():
            x.append("copyright")
        if i == 0:
            x.append("first")
        if i == n - 1:
            x.append("last")
        out.append(x)
    return out


@dataclass
class Field:
    weights: dict[str, tuple[float, float]]
    step: np.ndarray  # (2, 2)

    def decode(self, xs: list[list[str]]) -> list[int]:
        """The likeliest labels, by Viterbi."""
        if not xs:
            return []
        none = (0.0, 0.0)
        get = self.weights.get
        (s00, s01), (s10, s11) = self.step.tolist()
        back = []
        v0 = v1 = 0.0
        for i, x in enumerate(xs):
            e0 = e1 = 0.0
            for f in x:
                w = get(f, none)
                e0 += w[0]
                e1 += w[1]
            if i:
                a, b = v0 + s00, v1 + s10
                c, d = v0 + s01, v1 + s11
                back.append((b > a, d > c))
                v0, v1 = max(a, b), max(c, d)
            v0 += e0
            v1 += e1
        y = int(v1 > v0)
        out = [y]
        for b in reversed(back):
            y = int(b[y])
            out.append(y)
        return out[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page)
        return "\n".join(b.text for b, y in zip(found, self.decode(features(found))) if y)


def train(pages: list[tuple[list[list[str]], list[int]]], rounds: int = 150, rate: float = 0.25, ridge: float = 2e-3) -> Field:
    """Gradient ascent (Adam) on the conditional likelihood of labelled feature sequences, all pages at once."""
    pages = [p for p in pages if p[1]]
    names = {f: i for i, f in enumerate(sorted({f for xs, _ in pages for x in xs for f in x}))}
    p, longest = len(pages), max(len(y) for _, y in pages)
    size = np.array([len(y) for _, y in pages])
    gold = np.zeros((p, longest), np.int64)
    rows, cols = [], []
    for i, (xs, y) in enumerate(pages):
        gold[i, : len(y)] = y
        for t, x in enumerate(xs):
            rows += [i * longest + t] * len(x)
            cols += [names[f] for f in x]
    rows, cols = np.array(rows), np.array(cols)
    live = np.arange(longest)[None, :] < size[:, None]
    w, step = np.zeros((len(names), 2)), np.zeros((2, 2))
    m, v = [np.zeros_like(w), np.zeros_like(step)], [np.zeros_like(w), np.zeros_like(step)]
    one_hot = np.eye(2)[gold] * live[:, :, None]
    pair = live[:, 1:]
    seen = np.einsum("pta,ptb->ab", one_hot[:, :-1] * pair[:, :, None], one_hot[:, 1:])
    for r in range(1, rounds + 1):
        e = np.stack([np.bincount(rows, w[cols, c], p * longest) for c in (0, 1)], 1).reshape(p, longest, 2)
        a, b = np.zeros_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        for t in range(1, longest):
            now = np.logaddexp(a[:, t - 1, :1] + step[0], a[:, t - 1, 1:] + step[1]) + e[:, t]
            a[:, t] = np.where(live[:, t : t + 1], now, a[:, t - 1])
        for t in range(longest - 2, -1, -1):
            nxt = e[:, t + 1] + b[:, t + 1]
            now = np.logaddexp(step[:, 0] + nxt[:, :1], step[:, 1] + nxt[:, 1:])
            b[:, t] = np.where(live[:, t + 1 : t + 2], now, 0)
        z = np.logaddexp(a[:, -1, 0], a[:, -1, 1])
        q = np.exp(a + b - z[:, None, None]) * live[:, :, None]
        joint = np.exp(a[:, :-1, :, None] + step + (e + b)[:, 1:, None, :] - z[:, None, None, None]) * pair[:, :, None, None]
        miss = (one_hot - q).reshape(-1, 2)
        grads = [np.stack([np.bincount(cols, miss[rows, c], len(names)) for c in (0, 1)], 1) / p - ridge * w, (seen - joint.sum((0, 1))) / p - ridge * step]
        for x, g, k in ((w, grads[0], 0), (step, grads[1], 1)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            x += rate * (m[k] / (1 - 0.9**r)) / (np.sqrt(v[k] / (1 - 0.99**r)) + 1e-8) * (0.5 if r > rounds // 2 else 1)
    return Field({f: (float(w[i, 0]), float(w[i, 1])) for f, i in names.items()}, step)


def made_pages(count: int = 400, seed: int = 3) -> list[tuple[str, str]]:
    """Labelled pages: (html, main text) over random layouts. Texts say nothing of the label: any part may be long, short or junk."""
    rng = np.random.default_rng(seed)
    syllables = "la re mi don ta shi ver en qu ou pel gra ni st ō é ü".split()
    pick = lambda *x: x[int(rng.integers(len(x)))]
    word = lambda: "".join(pick(*syllables) for _ in range(int(rng.integers(1, 4))))

    def prose(least=1, most=40):
        ws = [word() for _ in range(int(rng.integers(least, most)))]
        if rng.random() < 0.15:
            ws = [w + pick("***", "###", "$$$", "!!", " |") for w in ws]
        return " ".join(ws).capitalize() + pick(".", ".", ".", "", "!", "?")

    def links(tag="ul"):
        return f"<{tag}>" + "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(int(rng.integers(2, 8)))) + f"</{tag}>"

    def clutter(kind=None):
        kind = kind or pick("nav", "menu", "header", "footer", "aside", "sidebar", "ad", "notice", "form", "comments", "share", "related", "promo")
        p = lambda: f"<p>{prose(1, 30)}</p>"
        parts = {
            "nav": lambda: f"<nav>{links(pick('ul', 'ol'))}</nav>",
            "menu": lambda: f'<div {pick("class", "id")}="{pick("menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "topbar", "toolbar", "pagination", "skip")}">{links()}</div>',
            "header": lambda: f"<header{pick('', ' class=\"site-header\"', ' id=\"header\"')}><a href='/'>{word()}</a>{pick('', p(), '<h1>' + prose(1, 5) + '</h1>')}{pick('', links())}</header>",
            "footer": lambda: f"<{(t := pick('footer', 'footer', 'div class=\"footer\"', 'div id=\"footer\"', 'div class=\"site-footer copyright\"'))}>{pick('&copy; ', '')}{word()} &middot; {prose()}{pick('', links())}</{t.split()[0]}>",
            "aside": lambda: f"<aside>{pick('', '<h3>' + prose(1, 4) + '</h3>')}{p()}{pick('', links())}</aside>",
            "sidebar": lambda: f'<div {pick("class", "id")}="{pick("sidebar", "side", "widget", "rail", "widget-area", "sidebar-right", "column-side")}"><h3>{prose(1, 4)}</h3>{p()}{links()}</div>',
            "ad": lambda: f'<{(t := pick("div", "section", "p", "ins"))} {pick("class", "id")}="{pick("ad", "ads", "advert", "advertisement", "banner", "sponsor", "sponsored", "ad-slot", "ad-banner", "adbox")}">{prose()}</{t}>',
            "notice": lambda: f'<div {pick("class", "id", "role")}="{pick("notice", "cookie", "cookie-banner", "cookies", "consent", "alert", "gdpr", "popup", "modal", "overlay", "message", "disclaimer")}">{p()}<button>{word()}</button></div>',
            "form": lambda: f"<form{pick('', ' class=\"search\"', ' class=\"newsletter subscribe\"', ' id=\"login\"')}><label>{prose(1, 4)}</label><input name=q>{pick('', p())}<button>{word()}</button></form>",
            "comments": lambda: f'<{(t := pick("section", "div", "ol"))} {pick("class", "id")}="{pick("comments", "comment-list", "discussion", "replies", "responses", "comment", "disqus", "reader-comments", "user-comments")}">{pick("", "<h2>" + prose(1, 4) + "</h2>")}' + "".join(pick(f'<div class="comment">{p()}</div>', f"<li>{p()}</li>", f'<article class="comment">{p()}</article>', p()) for _ in range(int(rng.integers(1, 4)))) + f"</{t}>",
            "share": lambda: f'<div class="{pick("share", "social", "tags", "sharing", "author-bio", "byline-links", "follow")}">{links()}{pick("", p())}</div>',
            "related": lambda: f'<{(t := pick("div", "section"))} {pick("class", "id")}="{pick("related", "recommended", "more", "trending", "popular", "read-next")}"><h3>{prose(1, 4)}</h3>{links()}{pick("", p())}</{t}>',
            "promo": lambda: f'<div class="{pick("promo", "newsletter", "subscribe", "subscription", "paywall", "signup")}">{p()}</div>',
        }
        return parts[kind]()

    out = []
    for _ in range(count):
        body, want = [], []

        def say(tag, text):
            want.append(" ".join(text.split()))
            inner = text.replace("&", "&amp;")
            if rng.random() < 0.2:
                inner = f"<{(t := pick('b', 'em', 'span', 'strong'))}>{inner}</{t}>"
            elif rng.random() < 0.1:
                inner = f'<a href="/x">{inner}</a>'
            body.append(f"<{tag}>{inner}" + ("" if tag == "p" and rng.random() < 0.1 else f"</{tag.split()[0]}>"))

        top = [clutter(k) for k in ("nav", "menu", "header", "notice", "ad", "form") if rng.random() < 0.4]
        low = [clutter(k) for k in ("comments", "related", "share", "sidebar", "aside", "footer", "notice", "ad", "form", "promo") if rng.random() < 0.35]
        rng.shuffle(top)
        say(pick("h1", "h1", "h2"), prose(1, 9))
        for _ in range(int(rng.integers(1, 14))):
            kind = rng.random()
            if kind < 0.72:
                say(pick("p", "p", "p", "div"), prose(1, 60))
            elif kind < 0.8:
                say(pick("h2", "h3"), prose(1, 7))
            elif kind < 0.86:
                body.append("<ul>")
                for _ in range(int(rng.integers(1, 4))):
                    say("li", prose(1, 15))
                body.append("</ul>")
            elif kind < 0.9:
                say(pick("blockquote", "pre", "figcaption"), prose(1, 20))
            else:
                body.append(clutter(pick("ad", "aside", "form", "share", "related", "promo", "notice")))
        if rng.random() < 0.2:
            body.append(clutter("comments"))
        box = pick("article", "article", "article", "main", 'div class="content"', 'div id="content"', 'div class="post-body"', 'div class="entry-content"', 'div class="article-text"', 'section class="story"', 'div role="main"', 'div itemprop="articlebody"')
        main = f"<{box}>{''.join(body)}</{box.split()[0]}>"
        if rng.random() < 0.3:
            main = f"<{(t := pick('main', 'div', 'div class=\"container\"', 'div id=\"wrapper\"', 'section'))}>{main}</{t.split()[0]}>"
        title = prose(1, 8)
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var a='</p>';</script></head><body>{''.join(top)}<!-- x -->{main}{''.join(low)}</body></html>", "\n".join(want)))
    return out


def labelled(page: str, want: str) -> tuple[list[list[str]], list[int]]:
    """Features and labels of a page: blocks that are lines of the main text, in order, are main."""
    found, lines, y, i = blocks(page), want.split("\n") if want else [], [], 0
    for b in found:
        hit = i < len(lines) and b.text == lines[i]
        y.append(int(hit))
        i += hit
    return features(found), y


@lru_cache(maxsize=2)
def default_field(seed: int = 3) -> Field:
    return train([labelled(h, w) for h, w in made_pages(seed=seed)])


def extract_text(pages: DataFrame, field: Field | None = None, html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every row."""
    field = field or default_field()

    def run(batches):
        for b in batches:
            text = [field.extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col(html_col).alias("html")).mapInArrow(run, "page_id long, url string, text string, n_chars long")
