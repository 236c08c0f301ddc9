"""Main text of HTML pages by a linear-chain conditional random field over leaf blocks.

A page becomes the sequence of its leaf blocks: runs of text between block
boundaries, each with its open elements.  Features are the ancestor tags, the
words of their class, id and role attributes, and shape, punctuation and links
of the text.  The field has two labels, article and boilerplate; it is trained
in numpy on labelled pages by the exact likelihood (forward-backward), and
pages are decoded by Viterbi.

Labelled pages are a bounded sample of the corpus, labelled by its own markup
(blocks of an ``article`` outside navigation and the like), and pages laid out
here from the sample's sentences in many ways, whose labels are known.
"""

from __future__ import annotations

import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.llm.common import ship

#: Pages read for training (smallest id hashes, of at most so many characters), pages laid out, and training steps.
SAMPLE, SAMPLE_CHARS, LAID_OUT, STEPS = 300, 50_000, 700, 120

#: Elements that begin and end a block, that have no end, whose content is not text, and that end at a sibling.
BLOCK = set(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table "
    "tbody td textarea tfoot th thead title tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIP = set("script style noscript template svg math iframe object head title textarea select".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>"
    r"|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']*+(?:\"[^\"<]*+\"|'[^'<]*+'))*+[^>\"']*+>|[^>]*+(?:>|\Z))",
    re.S,
)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[a-z]+")
_SPACE = re.compile(r"\s+")
_END = {t: re.compile(rf"</{t}\b", re.I) for t in SKIP}
#: Of these, all up to the end of the page belongs to one that is not closed; of the others, nothing.
RAW = set("script style textarea title".split())


class Block:
    __slots__ = ("text", "path", "names", "linked")

    def __init__(self, text: str, path: list[str], names: list[str], linked: int):
        self.text, self.path, self.names, self.linked = text, path, names, linked


def blocks(page: str | None) -> list[Block]:
    """Leaf blocks of a page in order: references decoded, white space made one space, empty ones left out."""
    out: list[Block] = []
    stack: list[tuple[str, list[str]]] = []
    run: list[str] = []
    linked, pos = 0, 0
    unclosed: set[str] = set()

    def flush() -> None:
        nonlocal linked
        if run:
            text = _SPACE.sub(" ", html.unescape("".join(run))).strip()
            if text:
                out.append(Block(text, [t for t, _ in stack if t in BLOCK or t == "a"], [w for _, ws in stack for w in ws], linked))
            run.clear()
        linked = 0

    def add(raw: str) -> None:
        nonlocal linked
        if raw:
            run.append(raw)
            if any(t == "a" for t, _ in stack[-4:]):
                linked += len(raw)

    def pop(at: int) -> None:
        if any(t in BLOCK for t, _ in stack[at:]):
            flush()
        del stack[at:]

    page = page or ""
    while m := _TAG.search(page, pos):
        add(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                pop(at)
            elif tag in BLOCK:
                flush()
        elif tag == "br":
            run.append(" ")
        elif tag in VOID:
            if tag in BLOCK:
                flush()
        elif tag in SKIP:
            if tag in BLOCK:
                flush()
            if tag == "head":
                body = re.compile(r"</head\b|<body\b", re.I).search(page, pos)
                pos = body.start() if body else pos
            elif not m[3].rstrip(">").endswith("/"):
                end = None if tag in unclosed else _END[tag].search(page, pos)
                if end:
                    pos = end.start()
                elif tag in RAW:
                    pos = len(page)
                else:
                    unclosed.add(tag)
        else:
            if tag in BLOCK:
                p = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == "p"), None)
                if p is not None and tag not in ("button", "label") and not any(t in ("td", "th", "button") for t, _ in stack[p:]):
                    pop(p)
                if tag in SIBLINGS:
                    for i in range(len(stack) - 1, -1, -1):
                        if stack[i][0] in FENCE[tag]:
                            break
                        if stack[i][0] in SIBLINGS[tag]:
                            pop(i)
                            break
                flush()
            names = [w for x in _NAMES.findall(m[3]) for w in _WORD.findall("".join(x).lower())] if "=" in m[3] else []
            stack.append((tag, names))
    add(page[pos:])
    flush()
    return out


def features(bs: list[Block]) -> list[list[str]]:
    """Feature names of each block."""
    out = []
    for i, b in enumerate(bs):
        t, n = b.text, len(b.text)
        words = t.count(" ") + 1
        f = {"on", f"words:{min(words, 64).bit_length()}", f"links:{4 * min(b.linked, n) // n}", f"last:{t[-1] if t[-1] in '.!?:,;' else '-'}"}
        f.update("in:" + x for x in b.path)
        f.update("name:" + x for x in b.names)
        if b.path:
            f.add("leaf:" + b.path[-1])
        if "©" in t or "(c)" in t.lower():
            f.add("rights")
        if sum(map(str.isdigit, t)) * 4 > n:
            f.add("digits")
        if words > 4 and t[-1] in ".!?":
            f.add("prose")
        if i == 0:
            f.add("first")
        if i == len(bs) - 1:
            f.add("final")
        out.append(list(f))
    return out


class Field:
    """Weights of a two-label chain: features, start and transitions."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, start: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.start, self.move = names, emit, start, move

    def decode(self, rows: list[list[str]]) -> list[int]:
        """The most probable labels (Viterbi); 1 is article."""
        if not rows:
            return []
        get, w0, w1 = self.names.get, self.emit[:, 0].tolist(), self.emit[:, 1].tolist()
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = self.start.tolist()
        back = []
        for i, row in enumerate(rows):
            ids = [k for x in row if (k := get(x)) is not None]
            e0, e1 = sum(w0[k] for k in ids), sum(w1[k] for k in ids)
            if i:
                back.append((0 if a + m00 >= b + m10 else 1, 0 if a + m01 >= b + m11 else 1))
                a, b = max(a + m00, b + m10), max(a + m01, b + m11)
            a, b = a + e0, b + e1
        labels = [0 if a >= b else 1]
        for pair in reversed(back):
            labels.append(pair[labels[-1]])
        return labels[::-1]


def fit(pages: list[tuple[list[list[str]], list[int]]], steps: int = STEPS) -> Field:
    """Maximum likelihood with a small quadratic penalty, by Adam steps over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    for rows, _ in pages:
        for row in rows:
            for x in row:
                names.setdefault(x, len(names))
    long = max((len(r) for r, _ in pages), default=0)
    x = np.zeros((len(pages), long, len(names)), np.float32)
    y, on = np.zeros((len(pages), long), int), np.zeros((len(pages), long), bool)
    for i, (rows, labels) in enumerate(pages):
        on[i, : len(rows)], y[i, : len(rows)] = True, labels
        for j, row in enumerate(rows):
            x[i, j, [names[k] for k in row]] = 1
    flat, k = x.reshape(-1, len(names)), len(names)
    truth = np.eye(2)[y] * on[..., None]
    moves = np.einsum("pti,ptj->ij", truth[:, :-1], truth[:, 1:]) if long else np.zeros((2, 2))
    w, m, v = np.zeros(2 * k + 6), np.zeros(2 * k + 6), np.zeros(2 * k + 6)
    lse = lambda z, axis: np.logaddexp(*np.moveaxis(z, axis, 0))
    for t in range(1, steps + 1 if pages else 1):
        emit, start, move = w[: 2 * k].reshape(k, 2), w[2 * k : 2 * k + 2], w[2 * k + 2 :].reshape(2, 2)
        e = (flat @ emit.astype(np.float32)).astype(np.float64).reshape(len(pages), long, 2)
        fwd, bwd = np.zeros_like(e), np.zeros_like(e)
        fwd[:, 0] = start + e[:, 0]
        for j in range(1, long):
            fwd[:, j] = np.where(on[:, j, None], lse(fwd[:, j - 1, :, None] + move, 1) + e[:, j], fwd[:, j - 1])
        for j in range(long - 2, -1, -1):
            bwd[:, j] = np.where(on[:, j + 1, None], lse(move + (e[:, j + 1] + bwd[:, j + 1])[:, None, :], 2), 0)
        z = lse(fwd[:, -1], 1)[:, None, None]
        node = np.exp(fwd + bwd - z) * on[..., None]
        edge = np.exp(fwd[:, :-1, :, None] + move + (e + bwd)[:, 1:, None, :] - z[..., None]) * on[:, 1:, None, None]
        g = np.concatenate([
            (flat.T @ (node - truth).reshape(-1, 2).astype(np.float32)).ravel(),
            (node[:, 0] - truth[:, 0]).sum(0),
            (edge.sum((0, 1)) - moves).ravel(),
        ]) / len(pages) + 2e-3 * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return Field(names, w[: 2 * k].reshape(k, 2), w[2 * k : 2 * k + 2], w[2 * k + 2 :].reshape(2, 2))


#: Fixed values of the laid-out pages: names of containers by what they hold.
BODY = "article content post entry story main text body post-content entry-content article-body story-body page-content blog-post".split()
AROUND = {
    "menu": "nav navbar menu navigation breadcrumb breadcrumbs topbar main-menu toc pagination tabs".split(),
    "header": "header masthead site-header top-bar page-header branding logo tagline".split(),
    "footer": "footer site-footer page-footer copyright colophon bottom legal imprint".split(),
    "side": "sidebar aside widget side related related-posts trending popular recommended more-stories teaser tags".split(),
    "notice": "cookie cookie-notice notice banner alert consent gdpr popup modal overlay message privacy-notice toast".split(),
    "advert": "ad ads advert advertisement sponsored promo sponsor ad-slot adsbox banner-ad promotion".split(),
    "form": "form search search-form login newsletter subscribe signup contact-form subscription".split(),
    "comments": "comments comment comment-list comment-body reply responses disqus discussion reader-comments user-comment".split(),
    "share": "share social social-share sharing follow byline meta post-meta author-box print tools".split(),
}
TAGS = {"menu": "nav div ul", "header": "header div", "footer": "footer div", "side": "aside div section", "notice": "div section aside p",
        "advert": "div aside section", "form": "form div", "comments": "section div ol aside", "share": "div ul p"}


def laid_out(texts: list[str], rng: random.Random) -> tuple[str, list[int]]:
    """A page made of the sentences, and the labels of its blocks."""
    labels: list[int] = []

    def say(lo: int, hi: int, label: int) -> str:
        labels.append(label)
        words = rng.choice(texts).split() if texts else ["text"]
        n = rng.randint(lo, hi)
        at = rng.randint(0, max(0, len(words) - n))
        return html.escape(" ".join(words[at : at + n]) or "x") + (rng.choice(["", ".", "."]) if hi > 8 else "")

    def named(kind: str) -> str:
        return rng.choice(["", f' class="{rng.choice(AROUND[kind])}"', f' id="{rng.choice(AROUND[kind])}"'])

    def around(kind: str) -> str:
        tag = rng.choice(TAGS[kind].split())
        name = named(kind)
        if tag in ("div", "section", "p", "ul", "ol") and not name:
            name = f' class="{rng.choice(AROUND[kind])}"'
        link = lambda a, b: f'<a href="/x">{say(a, b, 0)}</a>'
        item = {"menu": "li", "share": "li"}.get(kind)
        if tag in ("ul", "ol") or (item and rng.random() < 0.6):
            inner = "".join(f"<li>{link(1, 4) if kind != 'comments' else '<p>' + say(4, 40, 0) + '</p>'}</li>" for _ in range(rng.randint(2, 6)))
            return f"<{tag}{name}>{inner}</{tag}>" if tag in ("ul", "ol") else f"<{tag}{name}><ul>{inner}</ul></{tag}>"
        if kind == "form":
            inner = f"<label>{say(1, 4, 0)}</label><input type='text'><button>{say(1, 2, 0)}</button>"
            inner = (f"<p>{say(4, 20, 0)}</p>" if rng.random() < 0.5 else "") if tag == "div" and rng.random() < 0.3 else inner
            return f"<{tag}{name}>{inner}</{tag}>" if inner else f"<{tag}{name}>{say(3, 10, 0)}</{tag}>"
        if kind == "comments":
            inner = f"<h3>{say(1, 3, 0)}</h3>" if rng.random() < 0.7 else ""
            for _ in range(rng.randint(1, 5)):
                who = f"<div class='author'>{say(1, 2, 0)}</div>" if rng.random() < 0.5 else ""
                inner += f"<div class=\"{rng.choice(AROUND['comments'])}\">{who}<p>{say(4, 60, 0)}</p></div>"
            return f"<{tag}{name}>{inner}</{tag}>"
        if kind == "footer":
            mark = rng.choice(["&copy; ", "&#169; ", ""])
            return f"<{tag}{name}>{mark}{say(2, 20, 0)}</{tag}>"
        if tag == "p" or rng.random() < 0.3:
            return f"<{tag}{name}>{say(4, 30, 0)}</{tag}>"
        inner = "".join(
            rng.choice([lambda: f"<p>{say(4, 40, 0)}</p>", lambda: f"<h4>{say(1, 6, 0)}</h4>", lambda: f"<div>{link(2, 8)}</div>"])()
            for _ in range(rng.randint(1, 4))
        )
        return f"<{tag}{name}>{inner}</{tag}>"

    def some(kinds: str, p: float) -> str:
        return "".join(around(k) for k in kinds.split() if rng.random() < p)

    top = some("notice header menu advert", 0.5) + some("side", 0.15)
    title = rng.random()
    article = f"<h1>{say(2, 12, 1)}</h1>" if title < 0.7 else f"<header><h1>{say(2, 12, 1)}</h1></header>" if title < 0.8 else ""
    article += some("share", 0.15)
    for _ in range(rng.randint(2, 9)):
        kind = rng.random()
        if kind < 0.75:
            article += f"<p>{say(3, 90, 1)}</p>"
        elif kind < 0.83:
            level = rng.randint(2, 3)
            article += f"<h{level}>{say(1, 8, 1)}</h{level}>"
        elif kind < 0.89:
            article += "<ul>" + "".join(f"<li>{say(2, 20, 1)}</li>" for _ in range(rng.randint(2, 4))) + "</ul>"
        elif kind < 0.93:
            article += f"<blockquote>{say(5, 30, 1)}</blockquote>"
        else:
            article += some("advert side form", 0.5)
    tag = rng.choice(["article", "article", "main", "div", "section"])
    name = f' class="{rng.choice(BODY)}"' if tag in ("div", "section") or rng.random() < 0.3 else ""
    inside = rng.random() < 0.2
    article = f"<{tag}{name}>{article}{some('share comments', 0.5) if inside else ''}</{tag}>"
    end = some("share side advert", 0.25) + (some("comments", 0.5) if not inside else "") + some("form footer notice", 0.5)
    return f"<html><head><title>x</title></head><body>{top}{article}{end}</body></html>", labels


NOT_ARTICLE = {"nav", "aside", "footer", "form", "button", "header", "menu"}


def labelled(pages: list[str], laid: int = LAID_OUT) -> list[tuple[list[list[str]], list[int]]]:
    """Feature rows and labels of the sampled pages that have an article, and of pages laid out from their sentences."""
    rng = random.Random(0)
    out, texts = [], []
    for page in pages:
        bs = blocks(page)
        texts += [b.text for b in bs if len(b.text) > 40]
        if any("article" in b.path for b in bs):
            bad = {w for ws in AROUND.values() for n in ws for w in n.split("-")} - set(BODY)
            mark = [int("article" in b.path and not NOT_ARTICLE & {*b.path} and not bad & {*b.names}) for b in bs]
            # long pages repeat: the first and last blocks are enough to learn from
            keep = bs if len(bs) <= 60 else bs[:30] + bs[-30:]
            out.append((features(keep), mark if len(bs) <= 60 else mark[:30] + mark[-30:]))
    for _ in range(laid):
        page, mark = laid_out(texts[:5000], rng)
        bs = blocks(page)
        if len(bs) == len(mark) <= 80:
            out.append((features(bs), mark))
    return out


def train(pages: DataFrame) -> Field:
    """Fits on a bounded sample of ``pages`` (page_id, html)."""
    short = pages.where(F.length("html").between(1, SAMPLE_CHARS))
    sample = short.orderBy(F.xxhash64("page_id"), "page_id", F.xxhash64("html")).select("html").limit(SAMPLE).collect()
    return fit(labelled([r["html"] for r in sample]))


def main_text(page: str | None, field: Field) -> str:
    bs = blocks(page)
    return "\n".join(b.text for b, label in zip(bs, field.decode(features(bs))) if label)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without their HTML and with ``text`` string and ``n_chars`` long added.

    text has the article's blocks in page order, one a line.  Null or empty
    HTML, and pages without an article, give an empty text; pages of any length
    are read whole; unclosed and stray tags are tolerated; repeated rows are
    treated alike; an empty table gives an empty result; other columns are
    kept, but for those named text or n_chars.
    """
    ship(pages.sparkSession)
    shared = pages.sparkSession.sparkContext.broadcast(train(pages.withColumnRenamed(html_col, "html")))

    @F.pandas_udf("string")
    def text_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([main_text(p, shared.value) for p in b], dtype="object")

    out = pages.withColumn("text", text_of(html_col))
    return out.drop(html_col).withColumn("n_chars", F.length("text").cast("long"))
