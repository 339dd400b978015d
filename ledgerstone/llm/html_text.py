"""Operator 7: main text of web pages by a recurrent block labeller.

A page is cut into its leaf blocks of text in page order. Each block is a vector: hashed names of its tag path with their classes and
ids, hashed words, and a few figures on its length, links and place. A bidirectional LSTM in numpy reads the whole sequence of a page
and says for each block whether it belongs to the article; many pages are read in step. The model is trained here, once per
process, on pages that a seeded generator writes with known labels (layouts with menus, headers, sidebars, notices, adverts, forms,
comments and footers); no row of the input is used.

Text of script, style, noscript, template, iframe, svg, form controls, comments and head elements is never a block. White space inside a block becomes one space,
references are decoded; head, option, button, select and svg end where the standard implies it. Cutting is linear in the page, however deep its elements are and
wherever quotes or tags stay open. Blocks are joined by two line feeds. A null or empty page gives an empty text. Repeated rows give
repeated rows; a page of any length is one sequence.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trim

PATH_FEATURES, WORD_FEATURES, HIDDEN = 192, 64, 24
#: Pages of the generator, passes over them, and pages that are read in step.
TRAINING_PAGES, EPOCHS, TOGETHER = 700, 5, 256

#: Elements by what they do to text.
_SILENT = frozenset("script style noscript template head title textarea select option button svg iframe".split())
_RAW = frozenset("script style textarea title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data dfn em font i img kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr input ins del object canvas audio video math mi mo mn ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mstyle semantics annotation".split())
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
#: What may stand in a head; anything else ends a head that is left open. Likewise what ends an open svg,
#: and the elements of svg and math in which HTML goes on.
_IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
_BREAKS_OUT = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
_GOES_ON = frozenset("foreignobject desc title annotation-xml mi mo mn ms mtext".split())

#: What ends a start tag, or begins a quoted value in it.
_IN_TAG = re.compile(r">|=\s*+[\"']")
_TAG_NAME = re.compile(r"/?[a-zA-Z][^\s/>]*+")
_ATTRIBUTE = re.compile(r"(class|id|role)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[a-z]+")


class Block:
    __slots__ = ("path", "text", "links", "tag")

    def __init__(self, path: np.ndarray, text: str, links: int, tag: str):
        self.path, self.text, self.links, self.tag = path, text, links, tag


def _tokens(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Markup of a page as (start, end, name, closes, attributes); name is empty for comments and the like. Linear: nothing is searched for
    again once it is known to be missing. A tag that never ends goes to the end of the page, a quote that never ends is ordinary."""
    n, at, missing = len(page), 0, set()

    def find(what: str, start: int) -> int:
        k = -1 if what in missing else page.find(what, start)
        if k < 0:
            missing.add(what)
        return k

    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("!", at) or page.startswith("?", at):
            close = "-->" if page.startswith("!--", at) else "]]>" if page.startswith("![CDATA[", at) else ">"
            k = find(close, at)
            at = n if k < 0 else k + len(close)
            yield start, at, "", False, ""
            continue
        m = _TAG_NAME.match(page, at)
        if m is None:
            continue
        name, stop = m[0].lower(), m.end()
        while True:
            e = _IN_TAG.search(page, stop)
            if e is None:
                end = at = n
                break
            if e[0] == ">":
                end, at = e.start(), e.end()
                break
            k = find(e[0][-1], e.end())
            stop = e.end() if k < 0 else k + 1
        raw = yield start, at, name.lstrip("/"), name[0] == "/", page[m.end() : end]
        if raw:  # the reader has gone on by itself
            at = raw
            yield at, at, "", False, ""


def _slash_closes(attributes: str) -> bool:
    """Whether the slash at the end of a start tag is its own, not the end of a value without quotes."""
    last = attributes.rsplit(None, 1)[-1]
    before = attributes[: len(attributes) - len(last)].rstrip()
    value = last if before.endswith("=") else last.partition("=")[2]
    return not value or value[0] in "\"'"


def blocks(page: str) -> list[Block]:
    """Leaf blocks of a page in order, with the hashed names on their path."""
    out: list[Block] = []
    stack: list[tuple[str, list[int]]] = []
    places: dict[str, list[int]] = {}  # where in the stack each name is open
    outer: list[str] = [""]  # open elements that aren't inline
    on_path = np.zeros(PATH_FEATURES, np.int64)
    parts: list[str] = []
    links = silent = 0
    path = np.zeros(0, np.int64)

    def flush() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(path, text, min(links, len(text)), outer[-1]))
            parts, links = [], 0

    def last(*names: str) -> int:
        """Where the innermost open element of these names is, or -1."""
        return max((places[x][-1] for x in names if places.get(x)), default=-1)

    def enter(tag: str, buckets: list[int]) -> None:
        nonlocal silent
        places.setdefault(tag, []).append(len(stack))
        stack.append((tag, buckets))
        for x in buckets:
            on_path[x] += 1
        silent += tag in _SILENT
        if tag not in _INLINE:
            outer.append(tag)

    def leave(k: int) -> None:
        """Closes all elements from the k-th on."""
        nonlocal silent
        while len(stack) > k:
            tag, buckets = stack.pop()
            places[tag].pop()
            for x in buckets:
                on_path[x] -= 1
            silent -= tag in _SILENT
            if tag not in _INLINE:
                outer.pop()

    def imply(tag: str) -> None:
        """Closes what a start tag ends in the standard where the end tag was left out."""
        if stack[-1][0] == "head" and tag not in _IN_HEAD:
            leave(len(stack) - 1)
        elif tag == "body":
            if (k := last("head")) > last("template"):
                leave(k)
        elif tag in ("option", "optgroup") and stack[-1][0] == "option":
            leave(len(stack) - 1)
        elif tag in ("button", "select"):
            if (k := last(tag)) > last("template", "table", "td", "th", "caption", "object"):
                leave(k)
        elif tag in ("input", "textarea"):
            if (k := last("select")) > last("template"):
                leave(k)
        if tag in _BREAKS_OUT and silent and (k := last("svg")) > last("template", *_GOES_ON):
            leave(k)

    def foreign(tag: str) -> bool:
        """Whether a start tag belongs to svg or math, where alone a slash closes it."""
        return tag in ("svg", "math") or last("svg", "math") > last("template", *_GOES_ON)

    def say(piece: str) -> None:
        nonlocal path, links
        if not parts:
            path = np.flatnonzero(on_path)
        parts.append(piece)
        if places.get("a"):
            links += len(piece)

    def text_between(a: int, b: int) -> None:
        if silent and b > a and stack[-1][0] == "head" and not page[a:b].isspace():
            leave(len(stack) - 1)  # text ends a head, too
        if b > a and not silent:
            say(page[a:b])

    at, tokens = 0, _tokens(page)
    for start, end, tag, closes, attributes in tokens:
        text_between(at, start)
        at = end
        if not tag:
            continue
        if closes:
            k = last(tag)
            if tag not in _INLINE and tag not in _SILENT:
                flush()
            if k >= 0:
                leave(k)
            continue
        if silent:
            imply(tag)
        if tag not in _INLINE and tag not in _SILENT and not silent:
            flush()
        if tag == "br" and not silent:
            say(" ")
        if tag in _CLOSES_P and not silent:
            if (k := last("p")) >= 0:
                leave(k)
        elif tag == "li" and (k := last("li")) > last("ul", "ol"):
            leave(k)
        if tag in _VOID or attributes.endswith("/") and foreign(tag) and _slash_closes(attributes):
            continue
        names = [tag]
        if "=" in attributes:
            for a in _ATTRIBUTE.finditer(attributes):
                names += [f".{x}" for x in _NAME.findall((a[2] or a[3] or a[4] or "").lower())]
        enter(tag, [_bucket(x, PATH_FEATURES) for x in names])
        if tag in _RAW:
            close = re.compile(f"</{tag}", re.I).search(page, at)
            at = close.start() if close else len(page)
            tokens.send(at)
    text_between(at, len(page))
    flush()
    return out


@lru_cache(200_000)
def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % size


SIZE = PATH_FEATURES + WORD_FEATURES + 8


def vectors(page: list[Block]) -> np.ndarray:
    out = np.zeros((len(page), SIZE), np.float32)
    base = PATH_FEATURES + WORD_FEATURES
    for i, b in enumerate(page):
        row = out[i]
        row[b.path] = 1
        words = b.text.lower().split()
        np.add.at(row, [PATH_FEATURES + _bucket(w, WORD_FEATURES) for w in words], 2 / len(words))
        n = len(b.text)
        row[base:] = (np.log1p(n) / 6, b.links / n, i / len(page), (len(page) - i) / len(page), b.tag == "p", b.tag[:1] == "h" and b.tag[1:].isdigit(), b.tag == "li", b.text[-1] in ".!?")
    return out


# -- the network ---------------------------------------------------------------------------------------------


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one layer and a logistic output for each block."""

    def __init__(self, seed: int = 7):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"W{d}"] = (rng.standard_normal((SIZE, 4 * h)) * 0.1).astype(np.float32)
            self.p[f"U{d}"] = (rng.standard_normal((h, 4 * h)) / np.sqrt(h)).astype(np.float32)
            self.p[f"b{d}"] = np.r_[np.zeros(h), np.ones(h), np.zeros(2 * h)].astype(np.float32)
        self.p["out"] = (rng.standard_normal(2 * h) * 0.1).astype(np.float32)
        self.p["bias"] = np.zeros(1, np.float32)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool):
        """Hidden states (time, page, unit); masked steps leave the state as it is."""
        h = HIDDEN
        steps, n = mask.shape
        a = x @ self.p[f"W{d}"] + self.p[f"b{d}"]
        s, c = np.zeros((n, h), np.float32), np.zeros((n, h), np.float32)
        out, trace = np.zeros((steps, n, h), np.float32), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = a[t] + s @ self.p[f"U{d}"]
            i, f, o = _sigmoid(z[:, :h]), _sigmoid(z[:, h : 2 * h]), _sigmoid(z[:, 2 * h : 3 * h])
            g = np.tanh(z[:, 3 * h :])
            m = mask[t][:, None]
            c2 = np.where(m, f * c + i * g, c)
            tc = np.tanh(c2)
            s2 = np.where(m, o * tc, s)
            if keep:
                trace.append((t, s, c, i, f, o, g, tc, m))
            s, c = s2, c2
            out[t] = s
        return out, trace

    def predict(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Probabilities of each page's blocks; pages of similar length are read together."""
        result = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i in range(len(pages)) if len(pages[i])), key=lambda i: len(pages[i]))
        a = 0
        while a < len(order):
            b = min(a + TOGETHER, len(order))
            while b > a + 1 and len(pages[order[b - 1]]) * (b - a) > 40_000:
                b = a + max((b - a) // 2, 1)
            part = order[a:b]
            x, mask = self._padded([pages[i] for i in part])
            y = self._out(self._run(x, mask, "f", False)[0], self._run(x, mask, "b", False)[0])
            for k, i in enumerate(part):
                result[i] = y[: len(pages[i]), k]
            a = b
        return result

    @staticmethod
    def _padded(pages: list[np.ndarray]):
        steps = max(map(len, pages))
        x, mask = np.zeros((steps, len(pages), SIZE), np.float32), np.zeros((steps, len(pages)), bool)
        for k, p in enumerate(pages):
            x[: len(p), k], mask[: len(p), k] = p, True
        return x, mask

    def _out(self, f: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _sigmoid(f @ self.p["out"][:HIDDEN] + b @ self.p["out"][HIDDEN:] + self.p["bias"])

    def gradients(self, pages: list[np.ndarray], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        h = HIDDEN
        x, mask = self._padded(pages)
        y = np.zeros(mask.shape, np.float32)
        for k, lab in enumerate(labels):
            y[: len(lab), k] = lab
        runs = {d: self._run(x, mask, d, True) for d in "fb"}
        err = np.where(mask, self._out(runs["f"][0], runs["b"][0]) - y, 0) / max(mask.sum(), 1)
        g = {"bias": np.array([err.sum()], np.float32), "out": np.concatenate([np.einsum("tn,tnh->h", err, runs[d][0]) for d in "fb"])}
        for d, w in (("f", self.p["out"][:h]), ("b", self.p["out"][h:])):
            ds, dc = np.zeros((mask.shape[1], h), np.float32), np.zeros((mask.shape[1], h), np.float32)
            dz_all = np.zeros((*mask.shape, 4 * h), np.float32)
            gu = np.zeros_like(self.p[f"U{d}"])
            for t, s0, c0, i, f, o, gg, tc, m in reversed(runs[d][1]):
                ds = ds + err[t][:, None] * w
                do = ds * tc
                dct = dc + ds * o * (1 - tc * tc)
                dz = np.concatenate([dct * gg * i * (1 - i), dct * c0 * f * (1 - f), do * o * (1 - o), dct * i * (1 - gg * gg)], 1) * m
                dz_all[t] = dz
                gu += s0.T @ dz
                ds = np.where(m, dz @ self.p[f"U{d}"].T, ds)
                dc = np.where(m, dct * f, dc)
            g[f"U{d}"] = gu
            g[f"b{d}"] = dz_all.sum((0, 1))
            g[f"W{d}"] = x.reshape(-1, SIZE).T @ dz_all.reshape(-1, 4 * h)
        return g

    def fit(self, pages: list[np.ndarray], labels: list[np.ndarray], epochs: int = EPOCHS, rate: float = 0.01) -> None:
        rng = np.random.default_rng(11)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        t = 0
        for _ in range(epochs):
            order = rng.permutation(len(pages))
            for a in range(0, len(order), 32):
                part = order[a : a + 32]
                g = self.gradients([pages[i] for i in part], [labels[i] for i in part])
                norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
                t += 1
                for k, p in self.p.items():
                    d = g[k] * min(1.0, 1.0 / max(norm, 1e-9))
                    m[k] = 0.9 * m[k] + 0.1 * d
                    v[k] = 0.99 * v[k] + 0.01 * d * d
                    p -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)


# -- pages with known labels ---------------------------------------------------------------------------------


#: Names of classes and ids that the generator gives to what surrounds an article and to the article's own wrapper, and words that
#: notices and comments use. The first set is for training; the other names, wrappers and words are held out, for tests.
_TRAINED = {
    "advert": ("ad", "ads", "advert", "advertisement", "banner", "sponsored", "promo"),
    "menu": ("menu", "nav", "navbar", "navigation", "topbar", "breadcrumb", "breadcrumbs"),
    "header": ("header", "masthead", "site-header", "head"),
    "notice": ("cookie", "cookies", "notice", "consent", "alert", "gdpr", "cookie-banner"),
    "aside": ("sidebar", "related", "widget", "share", "social", "recommended", "rail"),
    "comments": ("comments", "comment-list", "responses", "discussion", "disqus", "replies"),
    "footer": ("footer", "site-footer", "bottom", "copyright", "legal"),
    "body": ("content", "post", "article", "entry", "story", "main", "body-text"),
    "words": ("cookies", "Comments"),
}
_HELD_OUT = {
    "advert": ("partner-box", "teaser", "commercial"),
    "menu": ("links", "toolbar", "crumbs"),
    "header": ("top", "brandbar", "hero-strip"),
    "notice": ("privacy-bar", "hint", "popup"),
    "aside": ("column-right", "more-stories", "box"),
    "comments": ("feedback", "reader-voices", "thread"),
    "footer": ("imprint", "end-matter", "colophon"),
    "body": ("text", "report", "reading-pane"),
    "words": ("privacy", "Replies"),
}


def write_page(rng: random.Random, names: dict = _TRAINED) -> tuple[str, list[str]]:
    """A page and the texts of its article's blocks."""
    vowels, letters = "aeiouéüáö", "bcdfghklmnprstvwz"
    word = lambda: "".join(rng.choice(letters) + rng.choice(vowels) for _ in range(rng.randint(1, 3)))
    words = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: words(3, 14).capitalize() + rng.choice(".....!?")
    prose = lambda a=1, b=6: " ".join(sentence() for _ in range(rng.randint(a, b)))
    main: list[str] = []
    say = lambda *xs: rng.choice(xs)

    def links(n: int) -> str:
        return "".join(f'<li><a href="/{word()}">{words(1, 2)}</a></li>' for _ in range(n))

    def side(tag: str, names: tuple, inner: str) -> str:
        name = rng.choice(names)
        how = rng.random()
        attribute = f' class="{name}"' if how < 0.6 else f' id="{name}"' if how < 0.85 else f' class="{word()} {name}-{word()}"'
        return f"<{tag}{attribute}>{inner}</{tag}>"

    def text_block(tag: str, text: str) -> str:
        main.append(text)
        inner = text
        parts = text.split(" ")
        if len(parts) > 4 and rng.random() < 0.3:
            k = rng.randrange(len(parts) - 2)
            mark = say("b", "em", "i", "strong", f'a href="/{word()}"', "span")
            parts[k] = f"<{mark}>{parts[k]}</{mark.split(' ')[0]}>"
            inner = " ".join(parts)
        if tag == "p" and rng.random() < 0.15:  # end tags left out
            return f"<p>{say('<b>', '<i>', '<font size=2>', '<span>', '')}{inner}{say('<br>', '<hr>', '')}"
        return f"<{tag}>{inner}" + ("" if tag in ("p", "li") and rng.random() < 0.2 else f"</{tag}>")

    def article() -> str:
        out = [text_block(say("h1", "h1", "h2"), words(2, 12).capitalize() if rng.random() < 0.6 else prose(1, 3))] if rng.random() < 0.95 else []
        for _ in range(rng.randint(1, 9)):
            r = rng.random()
            if r < 0.78:
                out.append(text_block("p", prose(1, 7) if rng.random() < 0.85 else words(1, 3).capitalize() + "."))
            elif r < 0.86:
                out.append(text_block(say("h2", "h3"), words(1, 6).capitalize()))
            elif r < 0.91:
                out.append(f"<{(t := say('ul', 'ol'))}>" + "".join(text_block("li", words(2, 12)) for _ in range(rng.randint(2, 4))) + f"</{t}>")
            elif r < 0.94:
                out.append(f"<blockquote>{text_block('p', prose(1, 3))}</blockquote>")
            elif r < 0.97:
                out.append("<table><tr>" + "".join(text_block("td", words(1, 3)) for _ in range(3)) + "</tr></table>")
            else:
                out.append(advert())
        return "".join(out)

    def advert() -> str:
        return side(say("div", "div", "aside", "section"), names["advert"], say(prose(1, 2), f"<p>{prose(1, 2)}</p>", f'<a href="/x">{words(2, 5)}</a>'))

    before, after = [], []
    nav = say(f"<nav><ul>{links(rng.randint(2, 8))}</ul></nav>", f"<nav>{links(4)}</nav>", side("ul", names["menu"], links(rng.randint(3, 8))), side("div", names["menu"], "".join(f'<a href="/{word()}">{word()}</a> ' for _ in range(rng.randint(2, 6)))))
    if rng.random() < 0.85:
        before.append(nav)
    if rng.random() < 0.5:
        before.append(f"<header>{say(words(1, 4), f'<h1>{words(1, 4)}</h1>', f'<p>{prose(1, 2)}</p>', f'<div class=logo>{word()}</div>')}</header>" if rng.random() < 0.6 else side("div", names["header"], f"<p>{prose(1, 2)}</p>"))
    if rng.random() < 0.6:
        before.append(advert())
    notice = lambda: side(say("div", "section", "p"), names["notice"], say(prose(1, 2), f"{prose(1, 2)} {names['words'][0]} {words(1, 3)}", f"{prose(1, 1)}<button>ok</button>"))
    if rng.random() < 0.4:
        (before if rng.random() < 0.5 else after).append(notice())
    aside = lambda: (f"<aside>{say(f'<h3>{words(1, 3)}</h3><ul>{links(4)}</ul>', f'<p>{prose(1, 3)}</p>', prose(1, 2))}</aside>" if rng.random() < 0.5 else side("div", names["aside"], say(f"<h3>{words(1, 3)}</h3><p>{prose(1, 3)}</p>", f"<ul>{links(5)}</ul>", f"<p>{prose(1, 2)}</p>")))
    if rng.random() < 0.5:
        (before if rng.random() < 0.4 else after).append(aside())
    if rng.random() < 0.4:
        comment = lambda: say(f"<div class=\"comment\"><p>{prose(1, 3)}</p></div>", f"<li>{prose(1, 2)}</li>", f"<article class=\"comment\"><p>{prose(1, 3)}</p></article>", f"<p>{prose(1, 3)}</p>")
        after.append(side(say("section", "div", "ol"), names["comments"], f"<h2>{say(names['words'][1], words(1, 2))}</h2>" + "".join(comment() for _ in range(rng.randint(1, 5)))))
    if rng.random() < 0.35:
        (before if rng.random() < 0.3 else after).append(f"<form action=\"/s\">{say(f'<label>{words(1, 3)}</label><input name=q>', f'<p>{prose(1, 1)}</p><input><button>{word()}</button>', f'<textarea>{prose()}</textarea>{words(1, 4)}')}</form>")
    if rng.random() < 0.85:
        end = say(f"&copy; {word()} &middot; {prose(1, 3)}", f"<p>{prose(1, 3)}</p>", f"<p>&copy; 2020 {words(1, 4)}</p><ul>{links(3)}</ul>")
        after.append(f"<footer>{end}</footer>" if rng.random() < 0.7 else side("div", names["footer"], end))
    body = article()
    r = rng.random()
    if r < 0.5:
        body = f"<article>{body}</article>"
    elif r < 0.65:
        body = f"<main>{body}</main>"
    elif r < 0.75:
        body = f"<main><article>{body}</article></main>"
    else:
        body = side(say("div", "section"), names["body"], body)
    rng.shuffle(before) if rng.random() < 0.3 else None
    page = f"<body>{''.join(before)}<!-- {word()} -->{body}{''.join(after)}</body>"
    if rng.random() < 0.2:
        page = f'<body><div class="{say("wrapper", "page", "container", "layout")}">{page[6:-7]}</div></body>'
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{words(2, 6)}</title>{say("", f"<style>.{word()}{{color:red}}</style>")}{say("", f"<script>{word()}({rng.randrange(99)} < 3);</script>")}</head>{page}</html>', main


def labelled(seed: int, names: dict = _TRAINED) -> tuple[list[Block], np.ndarray]:
    page, main = write_page(random.Random(seed), names)
    cut = blocks(page)
    wanted = [" ".join(t.split()) for t in main]
    labels, k = np.zeros(len(cut), np.float32), 0
    for i, b in enumerate(cut):  # article blocks come in order; a block of the same words before them is not one
        if k < len(wanted) and b.text == wanted[k]:
            labels[i] = 1
            k += 1
    return cut, labels


@lru_cache(1)
def trained() -> Labeller:
    data = [labelled(s) for s in range(TRAINING_PAGES)]
    net = Labeller()
    net.fit([vectors(b) for b, _ in data], [y for _, y in data])
    return net


def main_texts(pages: list[str], net: Labeller) -> list[str]:
    cut = [blocks(p) for p in pages]
    chosen = net.predict([vectors(b) for b in cut])
    return ["\n\n".join(x.text for x, p in zip(b, y) if p > 0.5) for b, y in zip(cut, chosen)]


def extract_main_text(pages: DataFrame, page: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of pages; the network is trained once on the driver and sent to the tasks with its fixed size."""
    weights = trained().p
    keys = pages.schema["page_id"].dataType.simpleString(), pages.schema["url"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = Labeller()
        net.p = weights
        for batch in batches:
            trim()
            for a in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(a, TOGETHER)
                texts = main_texts([p or "" for p in part.column(2).to_pylist()], net)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", F.col(page)).mapInArrow(run, f"page_id {keys[0]}, url {keys[1]}, text string, n_chars long")


def op7_html_lstm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
