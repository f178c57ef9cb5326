"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of a page."""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm import common

#: Rows whose words fill the labelled pages that the field is trained on (those with the smallest hashed ids), and how many pages are laid out.
TRAINING_ROWS = 200
TRAINING_PAGES = 900

_PIECE = re.compile(
    r"""<!--(?:>|->|.*?--!?>|.*\Z)|<(script|style|template|noscript|svg|iframe|textarea|title|select|object)\b(?:"[^"]*"|'[^']*'|[^"'>])*(?:/>|>.*?(?:</\1\s*>|\Z))"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:\s+|/|"[^"]*"|'[^']*'|[^"'>])*)>|<[!?/][^>]*(?:>|\Z)|([^<]+|<)""", re.S | re.I,
)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_NAME = re.compile(r"[a-z]+")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements inside which text runs on; any other tag ends a block.
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
#: A start tag closes an open element of the kinds named with it.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
_HINTS = frozenset("copyright cookie cookies privacy terms subscribe newsletter share login comment comments reply menu advertisement sponsored rights reserved".split())


class _Node:
    __slots__ = ("tag", "own", "features", "score", "link")

    def __init__(self, tag: str, attributes: str, above: _Node | None):
        own = ["t:" + tag]
        for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id", "role", "itemprop"):
                own += ["c:" + w for w in _NAME.findall(value)]
            elif name != "style" or "display:none" in value.replace(" ", ""):
                own.append("hidden")
        self.tag = tag
        self.own = ["p:" + tag, *("i:" + f for f in own[1:])]
        self.features = frozenset(own) | (above.features if above else frozenset())
        self.link = tag == "a" or bool(above and above.link)
        self.score: float | None = None


class Block:
    """Text between two block tags, the innermost block element around it, and how much of it is links."""

    __slots__ = ("node", "parts", "linked")

    def __init__(self, node: _Node):
        self.node, self.parts, self.linked = node, [], 0

    def text(self) -> str:
        return " ".join("".join(self.parts).split())


def blocks(page: str) -> list[tuple[_Node, str, float]]:
    """Leaf blocks of a page in order: (element, text, share of it in links). Tags may be unclosed or misnested."""
    root = _Node("html", "", None)
    stack, made = [root], []
    now: Block | None = None
    for m in _PIECE.finditer(page):
        text = m[5]
        if text is not None:
            if now is None:
                if text.isspace():
                    continue
                node = next(n for n in reversed(stack) if n.tag not in _INLINE)
                now = Block(node)
                made.append(now)
            plain = html.unescape(text) if "&" in text else text
            now.parts.append(plain)
            if stack[-1].link:
                now.linked += len(plain)
            continue
        if m[3] is None:  # comments, declarations and elements whose content is no text of the page
            continue
        tag = m[3].lower()
        if tag == "br":
            if now is not None:
                now.parts.append(" ")
            continue
        if tag not in _INLINE:
            now = None
        if m[2]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag not in _INLINE:
            shut = _CLOSES.get(tag, ())
            for i in range(len(stack) - 1, 0, -1):
                open_ = stack[i].tag
                if open_ == "p" or open_ in shut:
                    del stack[i:]
                    break
                if open_ not in _INLINE and open_ not in ("tbody", "thead"):
                    break
        if tag not in _VOID and not m[4].endswith("/"):
            if tag == "body":
                root.features |= _Node("body", m[4], None).features
            elif tag not in ("html", "head"):
                stack.append(_Node(tag, m[4], stack[-1]))
    out = []
    for b in made:
        text = b.text()
        if text:
            out.append((b.node, text, min(1.0, b.linked / max(1, sum(map(len, b.parts))))))
    return out


def text_features(text: str, linked: float, place: int, total: int) -> list[str]:
    n = len(text)
    found = [f"n:{min(n, 4000).bit_length()}", f"l:{int(linked * 4)}", "end:" + ("." if text[-1] in ".!?:;\"'”»" else "_"), f"at:{place * 5 // total}"]
    if text[0] in "©®™" or "©" in text:
        found.append("copy")
    if n < 400:
        found += ["w:" + w for w in set(_NAME.findall(text.lower())) & _HINTS]
    return found


class Field:
    """Weights of a two-label chain: a score for 'main' per feature, transitions, and the start."""

    def __init__(self, weights: dict[str, float], transitions: Sequence[Sequence[float]], start: Sequence[float]):
        self.weights, self.transitions, self.start = weights, transitions, start

    def scores(self, page: list[tuple[_Node, str, float]]) -> list[float]:
        get = self.weights.get
        out = []
        for i, (node, text, linked) in enumerate(page):
            if node.score is None:
                node.score = get("bias", 0.0) + sum(get(f, 0.0) for f in node.own) + sum(get(f, 0.0) for f in node.features)
            out.append(node.score + sum(get(f, 0.0) for f in text_features(text, linked, i, len(page))))
        return out

    def decode(self, page: list[tuple[_Node, str, float]]) -> list[bool]:
        """Viterbi: the likeliest labels of the whole page."""
        (t00, t01), (t10, t11) = self.transitions
        a, b, back = self.start[0], self.start[1], []
        for i, s in enumerate(self.scores(page)):
            if i:
                from_a, from_b = (a + t00 >= b + t10), (a + t01 > b + t11)
                back.append((not from_a, not from_b))
                a, b = (a + t00 if from_a else b + t10), (a + t01 if from_b else b + t11)
            b += s
        now, labels = b > a, []
        for i in range(len(page) - 1, -1, -1):
            labels.append(now)
            if i:
                now = back[i - 1][now]
        return labels[::-1]

    def extract(self, page: str | None) -> str:
        found = blocks(page or "")
        return "\n\n".join(t for (_, t, _), main in zip(found, self.decode(found)) if main)


def train(pages: Sequence[tuple[str, Sequence[bool]]], steps: int = 250, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Maximum likelihood of labelled pages (html, label per leaf block): forward-backward over all pages at once, adaptive steps."""
    parsed = [(blocks(p), y) for p, y in pages]
    for got, y in parsed:
        if len(got) != len(y):
            raise ValueError("a label for each leaf block")
    number: dict[str, int] = {}
    feature, row = [], []
    longest, count = max(len(b) for b, _ in parsed), len(parsed)
    label = np.zeros((count, longest))
    used = np.zeros((count, longest), bool)
    for i, (page, y) in enumerate(parsed):
        for j, (node, text, linked) in enumerate(page):
            for f in {"bias", *node.own, *node.features, *text_features(text, linked, j, len(page))}:
                feature.append(number.setdefault(f, len(number)))
                row.append(i * longest + j)
            label[i, j], used[i, j] = y[j], True
    feature, row = np.array(feature), np.array(row)
    w, t, s = np.zeros(len(number)), np.zeros((2, 2)), np.zeros(2)
    seen = [np.full(x.shape, 1e-6) for x in (w, t, s)]
    y = label.astype(int)
    pairs = used[:, 1:] & used[:, :-1]
    true_t = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)], float)
    true_s = np.array([(y[:, 0] == a).sum() for a in (0, 1)], float)
    for _ in range(steps):
        emit = np.zeros((count, longest, 2))
        emit[:, :, 1] = np.bincount(row, w[feature], count * longest).reshape(count, longest)
        alpha, beta = np.zeros_like(emit), np.zeros_like(emit)
        alpha[:, 0] = s + emit[:, 0]
        for j in range(1, longest):
            alpha[:, j] = np.where(used[:, j, None], np.logaddexp(alpha[:, j - 1, :1] + t[0], alpha[:, j - 1, 1:] + t[1]) + emit[:, j], alpha[:, j - 1])
        for j in range(longest - 2, -1, -1):
            ahead = beta[:, j + 1] + emit[:, j + 1]
            beta[:, j] = np.where(used[:, j + 1, None], np.logaddexp(ahead[:, :1] + t[:, 0], ahead[:, 1:] + t[:, 1]), beta[:, j + 1])
        total = np.logaddexp(alpha[:, -1, 0], alpha[:, -1, 1])[:, None, None]
        chance = np.exp(alpha + beta - total)
        both = alpha[:, :-1, :, None] + t + (emit + beta)[:, 1:, None, :] - total[..., None]
        expected_t = (np.exp(np.minimum(both, 0)) * pairs[..., None, None]).sum((0, 1))
        gap = ((label - chance[:, :, 1]) * used).ravel()
        for x, grad, acc in ((w, np.bincount(feature, gap[row], len(w)) - decay * count * w, seen[0]), (t, true_t - expected_t - decay * count * t, seen[1]), (s, true_s - chance[:, 0].sum(0) - decay * count * s, seen[2])):
            acc += grad**2
            x += rate * grad / np.sqrt(acc)
    return Field({f: float(w[i]) for f, i in number.items()}, t.tolist(), s.tolist())


def labelled_pages(words: Sequence[str], count: int = TRAINING_PAGES, seed: int = 11) -> list[tuple[str, list[bool]]]:
    """Pages laid out in many usual ways from given words, with the label of every leaf block."""
    rng = random.Random(seed)
    words = [w for w in words if w] or ["text"]
    pick = rng.choice

    def said(low: int, high: int) -> str:
        n = rng.randint(low, high)
        at = rng.randrange(len(words))
        return html.escape(" ".join(words[(at + i) % len(words)] for i in range(n)), quote=False) or "text"

    def page() -> tuple[str, list[bool]]:
        labels: list[bool] = []

        def leaf(tag: str, text: str, main: bool, attributes: str = "") -> str:
            labels.append(main)
            return f"<{tag}{attributes}>{text}" + ("" if tag in ("p", "li") and rng.random() < 0.3 else f"</{tag}>")

        def menu() -> str:
            items = "".join(leaf("li", f'<a href="/{i}">{said(1, 2)}</a>', False) for i in range(rng.randint(2, 8)))
            return pick(["<nav><ul>{}</ul></nav>", '<ul class="menu">{}</ul>', '<div id="navigation" class="navbar"><ul>{}</ul></div>', '<div role="navigation"><ul class="nav">{}</ul></div>', '<div class="breadcrumbs"><ul>{}</ul></div>']).format(items)

        def header() -> str:
            inner = leaf(pick(["div", "h1", "p", "h2"]), said(1, 6), False) + (leaf("p", said(2, 12), False) if rng.random() < 0.5 else "")
            return pick(["<header>{}</header>", '<div class="header">{}</div>', '<div id="masthead">{}</div>', '<div class="site-header top">{}</div>', '<div role="banner">{}</div>']).format(inner)

        def footer() -> str:
            inner = leaf("p" if rng.random() < 0.5 else "div", pick(["&copy; ", "© ", "Copyright ", ""]) + said(2, 25), False)
            inner += "".join(leaf("p", f'<a href="#">{said(1, 3)}</a>', False) for _ in range(rng.randint(0, 3)))
            return pick(["<footer>{}</footer>", '<div class="footer">{}</div>', '<div id="page-footer">{}</div>', '<div role="contentinfo">{}</div>', '<div class="copyright legal">{}</div>']).format(inner)

        def plain_footer() -> str:
            labels.append(False)
            return f"<footer>&copy; {said(2, 25)}</footer>"

        def advert() -> str:
            kind = pick(['div class="ad"', 'div class="ads banner"', 'div id="advert"', 'aside class="sponsored"', 'div class="promo"', 'section class="advertisement"', 'ins class="adsbygoogle"'])
            tag = kind.split()[0]
            if rng.random() < 0.6 and tag != "ins":
                labels.append(False)
                return f"<{kind}>{said(3, 40)}</{tag}>"
            return f"<div class='ad'>{leaf('p', said(3, 60), False)}</div>"

        def notice() -> str:
            if rng.random() < 0.4:
                return leaf(pick(["div", "p"]), said(3, 40), False, pick([' class="notice"', ' class="alert"', ' class="cookie-notice"', ' class="warning"', ' id="notice"', ' class="banner"']))
            inner = leaf("p", said(4, 40) + pick([" cookies", " privacy", ""]), False)
            return pick(['<div class="cookie-notice">{}</div>', '<div class="alert notice">{}</div>', '<div class="notice">{}</div>', '<div class="notification">{}</div>', '<div class="alert">{}</div>', '<div id="consent-banner">{}</div>', '<div class="warning message">{}</div>', '<div role="alert">{}</div>', '<section class="popup modal">{}</section>']).format(inner)

        def form() -> str:
            inner = leaf("p", said(2, 20), False) + "<input type='text' name='q'>" + leaf("button", said(1, 2), False)
            return pick(["<form action='/s'>{}</form>", '<div class="search"><form>{}</form></div>', '<form class="newsletter subscribe">{}</form>', '<form id="login">{}</form>']).format(inner)

        def sidebar() -> str:
            inner = leaf("h3", said(1, 4), False) + "".join(leaf(pick(["p", "li"]), pick(["{}", '<a href="/x">{}</a>']).format(said(1, 30)), False) for _ in range(rng.randint(1, 4)))
            return pick(["<aside>{}</aside>", '<div class="sidebar">{}</div>', '<div id="sidebar" class="widget">{}</div>', '<div class="related posts">{}</div>', '<div role="complementary">{}</div>', '<section class="widget-area">{}</section>']).format(inner)

        def comments() -> str:
            inner = leaf("h3", said(1, 4), False)
            for _ in range(rng.randint(1, 4)):
                inner += pick(['<div class="comment">{}</div>', '<li class="comment">{}</li>', '<article class="comment">{}</article>', '<div class="reply">{}</div>']).format(leaf("p", said(3, 60), False))
            return pick(['<section id="comments">{}</section>', '<div class="comments">{}</div>', '<ol class="commentlist">{}</ol>', '<div id="disqus_thread" class="discussion comments">{}</div>']).format(inner)

        def share() -> str:
            labels.append(False)
            return pick(['<div class="share">{}</div>', '<div class="social buttons">{}</div>', '<p class="tags meta">{}</p>', '<div class="byline meta">{}</div>']).format(f'<a href="#">{said(1, 3)}</a>')

        def byline() -> str:
            return pick(["{}", "<header>{}</header>", "<footer>{}</footer>"]).format(leaf(pick(["div", "p"]), said(2, 8), False, pick([' class="byline"', ' class="meta"', ' class="post-meta"', ' class="author"', ' class="date"', ' class="tags"'])))

        def content() -> str:
            kind = rng.random()
            if kind < 0.68:
                text = said(1, 5) if rng.random() < 0.35 else said(5, 160)
                if rng.random() < 0.25:
                    text = f"<b>{text}" + pick(["</b>", "", "<br>"])
                if rng.random() < 0.2:
                    text += f' <a href="/y">{said(1, 5)}</a> {said(1, 10)}.'
                return leaf("p", text, True)
            if kind < 0.76:
                return leaf(pick(["h2", "h3", "h4"]), said(1, 10), True)
            if kind < 0.84:
                return pick(["<ul>{}</ul>", "<ol>{}</ol>"]).format("".join(leaf("li", said(1, 25), True) for _ in range(rng.randint(1, 4))))
            if kind < 0.90:
                return f"<blockquote>{leaf('p', said(5, 60), True)}</blockquote>"
            if kind < 0.94:
                return f"<table><tr>{leaf('td', said(1, 12), True)}{leaf('td', said(1, 12), True)}</tr></table>"
            if kind < 0.97:
                return leaf("pre", said(3, 40), True)
            return leaf("div", said(5, 100), True)

        def article() -> str:
            inner = leaf(pick(["h1", "h1", "h1", "h2"]), said(1, 14), True) if rng.random() < 0.9 else ""
            if rng.random() < 0.2:
                inner = f"<header>{inner}</header>"
            for _ in range(rng.randint(0 if inner and rng.random() < 0.2 else 1, 12)):
                inner += content()
                if rng.random() < 0.16:
                    inner += pick([advert, advert, share, sidebar, notice, notice, form, byline, menu])()
            if rng.random() < 0.25:
                inner += pick([comments, comments, share, footer, byline])()
            if rng.random() < 0.5:
                return pick(["<article>{}</article>", "<article>{}</article>", "<main>{}</main>", "<main><article>{}</article></main>", '<article class="post">{}</article>']).format(inner)
            name = pick(["content", "post", "entry-content", "article-body", "story", "main", "text", "body-copy", "page-content", "article", "single-post", "main-content", "blog-post", "prose"])
            inner = pick(['<div class="{}">', '<div id="{}">', '<section class="{}">', '<div class="wrap {}">']).format(name) + inner
            inner += "</section>" if inner.startswith("<section") else "</div>"
            return pick(["{}", "{}", '<div role="main">{}</div>', "<main>{}</main>", '<div class="page">{}</div>']).format(inner)

        body = ""
        before = [header, menu, notice, advert, form, sidebar]
        after = [sidebar, comments, advert, footer, form, notice, share, menu]
        for f in before:
            body += f() if rng.random() < 0.4 else ""
        body += article()
        for f in after:
            body += f() if rng.random() < 0.4 else ""
        body += pick([plain_footer, footer])() if rng.random() < 0.6 else ""
        if rng.random() < 0.12:  # nothing but the text
            labels.clear()
            if rng.random() < 0.3:
                return said(1, 80), [True]
            body = article() if rng.random() < 0.6 else "".join(content() for _ in range(rng.randint(1, 6)))
        if rng.random() < 0.3:
            body = pick(['<div id="wrapper">{}</div>', '<div class="container"><div class="row">{}</div></div>']).format(body)
        ends = "</body></html>" if rng.random() < 0.9 else ""
        if rng.random() < 0.15:
            return body, labels
        return f"<!DOCTYPE html><html><head><title>{said(1, 8)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body><!-- x -->{body}{ends}", labels

    return [page() for _ in range(count)]


def fit(pages: DataFrame, page_id: str = "page_id", html_col: str = "html") -> Field:
    """A field trained on ``TRAINING_PAGES`` labelled layouts, filled with words of ``TRAINING_ROWS`` pages of the table."""
    rows = pages.select(F.substring(F.regexp_replace(html_col, r"(?s)<[^>]*>", " "), 1, 4000).alias("t"), page_id, html_col)
    some = rows.orderBy(F.xxhash64(page_id, html_col), page_id).limit(TRAINING_ROWS).select("t").toLocalIterator()
    return train(labelled_pages([html.unescape(w) for r in some for w in (r[0] or "").split()]))


def extract(pages: DataFrame, field: Field | None = None, html_col: str = "html", text: str = "text") -> DataFrame:
    """Every row with its main text in column ``text`` (replaced if there).

    Blocks labelled main are joined in page order by two line ends; character references are decoded, white space in a block is one space.
    Null, empty and text-less pages: empty text. Whole pages of any length are read. Rows and other columns stay as they are.
    """
    field = field or fit(pages)
    shared = pages.sparkSession.sparkContext.broadcast((field.weights, field.transitions, field.start))
    rest = [c for c in pages.columns if c != text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            for part in common.slices(batch, "_html"):
                got = pa.array([own.extract(h.as_py()) for h in part.column("_html")], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in range(part.num_columns - 1)), got], names=[*rest, text])

    fields = ", ".join([*(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest), f"`{text}` string"])
    return pages.select(*[F.col(f"`{c}`") for c in rest], F.col(html_col).alias("_html")).mapInArrow(run, fields)
