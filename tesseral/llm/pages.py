"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is read into leaf blocks: runs of text that no block-level tag interrupts, each with its open ancestors.
Every block gets features of its ancestors (tags, words in class, id and role) and of its text (length, share of
links, punctuation and so on). The field has two labels, main text or not, with a weight for each feature and
for each pair of neighbouring labels; it is trained on labelled pages by maximum likelihood and decoded by
Viterbi. ``example_pages`` writes labelled pages in many layouts; others can be given to ``fit``.

Defined results: null html counts as empty; pages without main text give an empty text; head, scripts, styles,
templates and comments are never text; ``<br>`` is white space; unclosed tags close where HTML says that the
next tag ends them, or with their parent; character references are decoded; white space inside a block becomes
one space, blocks are joined by newlines. Quotes matter after an equals sign only, and one that is never closed is a
character like others; ``object``, ``svg``, ``video`` and the like are skipped up to their end or that of their parent,
and are ignored if their end is missing altogether; an unclosed ``script``, ``style`` or comment takes the rest, as in
browsers. Reading is linear in the page's length. Of very deep nesting the innermost ``DEPTH`` elements are ancestors.
Repeated rows get equal texts, other columns of the input stay as they are, and one named like the output goes.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import free_names, quoted, ship, slices, text_of, without

#: How HTML's elements behave.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript iframe title xmp noembed noframes".split())
SKIPPED = frozenset("template object svg math canvas audio video".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}),
    "option": ({"option"}, {"select"}),
}
DEPTH = 64
#: A well-formed tag; possessive throughout, so that matching never goes back.
TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:\s++[^\s\"'<>/=]++(?:\s*+=\s*+(?:\"[^\"<]*+\"|'[^'<]*+'|[^\s\"'<>`=]++))?)*+)\s*+/?>")
OPENING = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
BETWEEN = re.compile(r"[\s/]*+")
ATTRIBUTE = re.compile(r"([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]*+)))?")
UNQUOTED = re.compile(r"([^\s/>=]++|=[^\s/>=]*+)(?:\s*+=\s*+([^\s>]*+))?")
NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
SPACE = re.compile(r"[\s ]+")


class Block:
    __slots__ = ("linked", "path", "text")

    def __init__(self, text: str, path: tuple[str, ...], linked: int):
        self.text, self.path, self.linked = text, path, linked


def described(tag: str, attributes: list[tuple[str, str]]) -> str:
    """A tag with the words of its class, id and role: ``div.cookie.notice``."""
    words = []
    for name, value in attributes:
        name = name.lower()
        if name in ("class", "id", "role", "itemprop", "data-role"):
            words += [w.lower() for w in NAMES.findall(html.unescape(value))]
        elif name == "hidden" or (name == "style" and re.search(r"display\s*+:\s*+none", value)) or (name == "aria-hidden" and value == "true"):
            words.append("hidden")
    return ".".join([tag, *dict.fromkeys(words)])


class Scanner:
    """Reads a page's tags from left to right."""

    def __init__(self, page: str):
        self.page = page
        self.low = low if len(low := page.lower()) == len(page) else re.sub("[A-Z]+", lambda m: m[0].lower(), page)
        self.last = {q: page.rfind(q) for q in "\"'"}
        self.ends: dict[str, int] = {}

    def closes(self, tag: str, at: int) -> bool:
        """Whether an end of this tag comes later."""
        if tag not in self.ends:
            self.ends[tag] = self.low.rfind(f"</{tag}")
        return self.ends[tag] >= at

    def after(self, mark: str, at: int) -> int:
        """Behind the next ``mark``, or the page's end."""
        found = self.page.find(mark, at)
        return found + len(mark) if found >= 0 else len(self.page)

    def tag(self, at: int) -> tuple[int, bool, str, list[tuple[str, str]], bool] | None:
        """(its end, is it an end tag, name, attributes, does it end with a slash) of the tag at ``<``."""
        page = self.page
        if (m := TAG.match(page, at)) is not None:
            return m.end(), bool(m[1]), m[2].lower(), [(a[1], a[2] or a[3] or a[4] or "") for a in ATTRIBUTE.finditer(m[3])] if m[3] else [], page[m.end() - 2] == "/"
        if (m := OPENING.match(page, at)) is None:
            return None
        attributes, at = [], m.end()
        while True:
            at = BETWEEN.match(page, at).end()
            if at >= len(page) or page[at] == ">":
                return min(at + 1, len(page)), bool(m[1]), m[2].lower(), attributes, page[at - 1 : at] == "/"
            whole = at <= self.last["\""] or at <= self.last["'"]
            a = (ATTRIBUTE if whole else UNQUOTED).match(page, at)
            attributes.append((a[1], next((v for v in a.groups()[1:] if v is not None), "")))
            at = a.end()


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in order."""
    out: list[Block] = []
    stack: list[tuple[str, str]] = []
    open_: Counter = Counter()
    pieces: list[str] = []
    linked, at, skipped = 0, 0, 0
    scan = Scanner(page)

    def flush():
        nonlocal pieces, linked
        if pieces:
            text = SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append(Block(text, tuple(d for _, d in stack[-DEPTH:] if d not in ("html", "body")), min(linked, len(text))))
            pieces, linked = [], 0

    def drop(i: int) -> None:
        nonlocal skipped
        for tag, _ in stack[i:]:
            open_[tag] -= 1
            skipped -= tag in SKIPPED
        del stack[i:]

    def close(names, stops) -> None:
        if any(open_[n] for n in names):
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in names:
                    flush()
                    drop(i)
                    return
                if stack[i][0] in stops:
                    return

    def say(text: str) -> None:
        nonlocal linked
        if text and not skipped:
            pieces.append(text)
            if open_["a"]:
                linked += len(text)

    while (sign := page.find("<", at)) >= 0:
        say(page[at:sign])
        at = sign
        if page.startswith("<!--", at):
            at = scan.after("-->", at + 4)
            continue
        if page.startswith("<![CDATA[", at):
            end = scan.after("]]>", at + 9)
            say(html.escape(page[at + 9 : end].removesuffix("]]>")))
            at = end
            continue
        if page[at + 1 : at + 2] in ("!", "?") or page.startswith("</", at) and not page[at + 2 : at + 3].isascii():
            at = scan.after(">", at + 2)
            continue
        found = scan.tag(at)
        if found is None:
            say("<")
            at += 1
            continue
        at, is_end, tag, attributes, slash = found
        if is_end:
            if tag not in INLINE and not skipped:
                flush()
            if open_[tag]:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == tag:
                        drop(i)
                        break
                    if tag in INLINE and stack[i][0] not in INLINE:
                        break
            continue
        if tag == "head":  # one without an end ends where the body begins
            ends = [i for i in (scan.low.find("</head", at) if scan.closes("head", at) else -1, scan.low.find("<body", at)) if i >= 0]
            at = min(ends) if ends else at
            continue
        if tag in RAW:
            if scan.closes(tag, at):
                at = scan.after(">", scan.low.find(f"</{tag}", at))
            elif tag in ("script", "style"):
                at = len(page)
            continue
        if tag in SKIPPED and (slash or not scan.closes(tag, at)):
            continue
        if tag == "br":
            say(" ")
        if tag in VOID:
            if tag == "hr" and not skipped:
                flush()
            continue
        if tag not in INLINE and tag not in SKIPPED and not skipped:
            flush()
            close({"p"}, {"article", "div", "section", "td", "li", "body", "table", "blockquote"})
            if tag in CLOSES:
                close(*CLOSES[tag])
        if tag in SKIPPED:
            skipped += 1
        open_[tag] += 1
        stack.append((tag, described(tag, attributes)))
    say(page[at:])
    flush()
    return out


def _bucket(x: float) -> int:
    return int(math.log2(x + 1))


def path_features(path: tuple[str, ...]) -> list[str]:
    out = set()
    for i, item in enumerate(path):
        tag, *words = item.split(".")
        out.add(f"in {tag}")
        out.update(f"word {w}" for w in words)
        if i == len(path) - 1:
            out.add(f"parent {tag}")
        if not any("." in later for later in path[i + 1 :]):
            out.update(f"near {w}" for w in words)  # the innermost element that has names
    out.update(f"below {a.split('.')[0]} {b.split('.')[0]}" for a, b in zip(path[:-1], path[1:]))
    return sorted(out) or ["bare"]


def text_features(b: Block, place: float) -> list[str]:
    t = b.text
    words = t.split(" ")
    stops = sum(t.count(c) for c in ".!?。")
    return [
        f"length {_bucket(len(t))}", f"words {min(7, _bucket(len(words)))}", f"links {int(4 * b.linked / len(t))}", f"stops {min(4, _bucket(stops))}",
        f"commas {min(3, _bucket(t.count(',')))}", f"ends {t[-1] in '.!?…。:»\"”'}", f"digits {int(4 * sum(c.isdigit() for c in t) / len(t))}",
        f"mark {any(c in t for c in '©®»›·')}", f"place {int(4 * place)}", f"short link {b.linked * 2 > len(t)} {len(words) < 6}",
    ]


class Field:
    """Weights of the conditional random field; label 1 is main text."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, pairs: np.ndarray, first: float):
        self.index, self.weights, self.pairs, self.first = index, weights, pairs, first
        self.known: dict[tuple[str, ...], float] = {}

    def scores(self, blocks: list[Block]) -> list[float]:
        w, index, n, out = self.weights, self.index, max(1, len(blocks)), []
        for i, b in enumerate(blocks):
            s = self.known.get(b.path)
            if s is None:
                if len(self.known) > 100_000:
                    self.known.clear()
                s = self.known[b.path] = float(sum(w[index[f]] for f in path_features(b.path) if f in index))
            out.append(s + float(sum(w[index[f]] for f in text_features(b, i / n) if f in index)))
        return out

    def decode(self, blocks: list[Block]) -> list[bool]:
        """Viterbi."""
        if not blocks:
            return []
        (aa, ab), (ba, bb) = self.pairs.tolist()
        scores, back = self.scores(blocks), []
        no, yes = 0.0, scores[0] + self.first
        for s in scores[1:]:
            back.append((no + aa < yes + ba, no + ab < yes + bb))
            no, yes = max(no + aa, yes + ba), max(no + ab, yes + bb) + s
        label = yes > no
        out = [label]
        for from_no, from_yes in reversed(back):
            label = from_yes if label else from_no
            out.append(label)
        return out[::-1]


def fit(pages: list[tuple[str, list[str]]], rounds: int = 250, rate: float = 0.1, damping: float = 1e-4) -> Field:
    """Train on pages with the texts of their main blocks; full-batch ascent of the penalised likelihood."""
    rows, labels = [], []
    for page, main in pages:
        found, wanted = blocks_of(page), Counter(SPACE.sub(" ", t).strip() for t in main)
        y = []
        for b in found:
            y.append(int(wanted[b.text] > 0))
            wanted[b.text] -= y[-1]
        if found:
            rows.append([path_features(b.path) + text_features(b, i / len(found)) for i, b in enumerate(found)])
            labels.append(y)
    seen = Counter(f for row in rows for fs in row for f in set(fs))
    index = {f: i for i, f in enumerate(sorted(f for f, n in seen.items() if n >= 3))}
    pages_n, steps = len(rows), max(map(len, rows))
    y = np.zeros((pages_n, steps), np.int64)
    live = np.zeros((pages_n, steps), bool)
    who, what = [], []
    for p, (row, lab) in enumerate(zip(rows, labels, strict=True)):
        y[p, : len(lab)], live[p, : len(lab)] = lab, True
        for t, fs in enumerate(row):
            got = [index[f] for f in fs if f in index]
            who += [p * steps + t] * len(got)
            what += got
    who, what = np.array(who), np.array(what)
    both = live[:, 1:]
    theta = np.zeros(len(index) + 5)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    pair_seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & both).sum() for b in (0, 1)] for a in (0, 1)], float)
    for step in range(1, rounds + 1):
        w, pairs, first = theta[: len(index)], theta[-5:-1].reshape(2, 2), theta[-1]
        e = np.bincount(who, w[what], pages_n * steps).reshape(pages_n, steps)
        e[:, 0] += first
        ahead, behind = np.zeros((steps, pages_n, 2)), np.zeros((steps, pages_n, 2))
        ahead[0, :, 1] = e[:, 0]
        for t in range(1, steps):
            now = np.logaddexp(ahead[t - 1, :, :1] + pairs[0], ahead[t - 1, :, 1:] + pairs[1])
            now[:, 1] += e[:, t]
            ahead[t] = np.where(live[:, t, None], now, ahead[t - 1])
        for t in range(steps - 2, -1, -1):
            later = behind[t + 1] + np.stack([np.zeros(pages_n), e[:, t + 1]], axis=1)
            now = np.logaddexp(later[:, :1] + pairs[:, 0], later[:, 1:] + pairs[:, 1])
            behind[t] = np.where(live[:, t + 1, None], now, 0)
        total = np.logaddexp(ahead[-1, :, 0], ahead[-1, :, 1])
        p_one = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total).T * live
        gap = (y - p_one) * live
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                joint = ahead[:-1, :, a] + pairs[a, b] + behind[1:, :, b] + (e[:, 1:].T if b else 0) - total
                expected[a, b] = (np.exp(np.minimum(joint, 0)).T * both).sum()
        gradient = np.concatenate([np.bincount(what, gap.ravel()[who], len(index)), (pair_seen - expected).ravel(), [gap[:, 0].sum()]]) / pages_n - damping * theta
        m1, m2 = 0.9 * m1 + 0.1 * gradient, 0.999 * m2 + 0.001 * gradient**2
        theta = theta + rate * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return Field(index, theta[: len(index)].copy(), theta[-5:-1].reshape(2, 2).copy(), float(theta[-1]))


#: Words that pages use in class and id, by what they hold.
ROLES = {
    "nav": ["nav", "menu", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "topbar", "tabs", "toc"],
    "header": ["header", "masthead", "branding", "logo", "site-header", "page-header", "hero-bar", "tagline"],
    "footer": ["footer", "copyright", "site-footer", "colophon", "legal", "bottom", "credits"],
    "aside": ["sidebar", "aside", "widget", "related", "recommended", "trending", "side", "rail", "more-stories", "complementary"],
    "notice": ["cookie", "notice", "consent", "gdpr", "popup", "modal", "alert", "banner", "overlay", "cookie-banner", "announcement"],
    "ad": ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "promotion", "ad-slot", "sponsor", "adsense"],
    "form": ["newsletter", "subscribe", "signup", "search", "login", "contact-form", "form", "search-box"],
    "comments": ["comments", "comment", "comment-list", "replies", "reply", "discussion", "respond", "user-comments", "responses"],
    "share": ["share", "social", "share-bar", "follow", "tags", "meta-links"],
}
MAIN = ["content", "main", "article", "post", "entry", "story", "post-body", "entry-content", "article-body", "text", "page-content", "main-content", ""]
NEUTRAL = ["container", "wrapper", "row", "col", "inner", "box", "section", "block", "grid", "page", ""]


def example_pages(n: int = 1000, seed: int = 7) -> list[tuple[str, list[str]]]:
    """Labelled pages in random layouts: (html, texts of the main blocks in order)."""
    rng = random.Random(seed)
    syllables = [a + b for a in ("", "b", "d", "st", "th", "r", "l", "m", "n", "sch", "tr") for b in ("a", "e", "i", "on", "er", "an", "é", "ü", "os")]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) or "a"
    phrase = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b)))
    sentence = lambda: phrase(1, 22).capitalize() + rng.choice([".", ".", ".", "?", "!", ", " + phrase(2, 9) + "."])
    prose = lambda a, b: " ".join(sentence() for _ in range(rng.randint(a, b)))

    def attribute(names: list[str]) -> str:
        name = rng.choice(names)
        if name and rng.random() < 0.3:
            name += rng.choice([" ", "-"]) + rng.choice(["inner", "box", "1", "top", "wide", "list", "item"])
        return f' {rng.choice(["class", "class", "id"])}="{name}"' if name else ""

    def link() -> str:
        return f'<a href="/{word()}">{phrase(1, 3)}</a>'

    def items(k: int) -> str:
        return "<ul>" + "".join(f"<li>{link()}" + rng.choice(["</li>", "</li>", ""]) for _ in range(k)) + "</ul>"

    def owner() -> str:
        return f"{rng.choice(['&copy;', '©', '(c)'])} {rng.choice(['', 'blog.', 'www.', '2020 '])}{word()}{rng.choice(['.example.com', '.example.org', ''])} {rng.choice(['&middot;', '·', '|', '-', ''])} "

    def boiler(role: str) -> str:
        tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside", "form": "form", "comments": "section"}.get(role, "div")
        plain = rng.random() < 0.5
        tag, names = (tag, ROLES[role] + [""]) if plain and tag != "div" and tag != "section" else (rng.choice(["div", "div", "section", "aside"] if role == "aside" else ["div", "div", "section"]), ROLES[role])
        body = {
            "nav": lambda: items(rng.randint(2, 8)),
            "header": lambda: rng.choice(["", f"<h1>{phrase(1, 3)}</h1>", f'<a href="/">{phrase(1, 2)}</a>']) + rng.choice([f"<p>{phrase(2, 8)}</p>", phrase(2, 6), items(4)]),
            "footer": lambda: rng.choice([f"&copy; {rng.randint(1999, 2030)} {phrase(1, 3)} &middot; {prose(1, 2)}", f"<p>&copy; {phrase(1, 4)}</p>" + items(3), f"{word()}.example.com | {link()} | {link()}", f"<p>{prose(1, 2)}</p>", owner() + prose(1, 5), f"<p>{owner()}{prose(1, 5)}</p>", owner() + phrase(2, 30)]),
            "aside": lambda: f"<h{(k := rng.randint(2, 4))}>{phrase(1, 3)}</h{k}>" + rng.choice([items(rng.randint(2, 6)), f"<p>{prose(1, 3)}</p>", "".join(f"<p>{link()} {phrase(2, 8)}</p>" for _ in range(3))]),
            "notice": lambda: rng.choice([f"<p>{prose(1, 3)}</p><button>{word()}</button>", f"{prose(1, 2)} {link()}"]),
            "ad": lambda: rng.choice([prose(1, 2), f"<p>{prose(1, 3)}</p>", f"{link()} {phrase(2, 9)}", f"<a href='/x'>{prose(1, 1)}</a>"]),
            "form": lambda: f"<label>{phrase(1, 3)}</label><input type='text'><p>{prose(1, 1)}</p><button>{word()}</button>" + rng.choice(["", f"<select><option>{word()}<option>{word()}</select>", f"<textarea>{phrase(1, 4)}</textarea>"]),
            "comments": lambda: f"<h3>{rng.randint(1, 99)} {word()}</h3>" + "".join(f"<{t}{attribute(ROLES['comments'])}><b>{word()}</b><p>{prose(1, 4)}</p></{t}>" for t in [rng.choice(["div", "li", "article"])] * rng.randint(1, 4)),
            "share": lambda: " ".join(link() for _ in range(rng.randint(2, 5))),
        }[role]()
        return f"<{tag}{attribute(names)}>{body}</{tag}>"

    out = []
    for number in range(n):
        main: list[str] = []

        def text(inner: str, main=main) -> str:
            main.append(inner)
            marked = re.sub(r"\b(\w{4,})\b", lambda m: f"<{t}>{m[1]}</{t}>" if rng.random() < 0.02 and (t := rng.choice(["b", "em", "i", "a href='#'"])) and " " not in t else m[1], inner)
            return marked.replace(" ", rng.choice([" ", " ", "\n  "]), 1)

        def paragraph() -> str:
            return f"<p>{'<b>' if rng.random() < 0.15 else ''}{text(prose(1, 7))}" + rng.choice(["</p>", "</p>", "</p>", "", "<br>"])

        def body(k: int) -> str:
            parts = []
            for _ in range(k):
                r = rng.random()
                if r < 0.75:
                    parts.append(paragraph())
                elif r < 0.82:
                    parts.append(f"<h2>{text(phrase(1, 6).capitalize())}</h2>")
                elif r < 0.88:
                    parts.append("<ul>" + "".join(f"<li>{text(phrase(2, 12))}</li>" for _ in range(rng.randint(1, 4))) + "</ul>")
                elif r < 0.91:
                    parts.append(f"<blockquote><p>{text(prose(1, 2))}</p></blockquote>")
                elif r < 0.93:
                    parts.append("<table>" + "".join(f"<tr><td>{text(phrase(1, 3))}</td><td>{text(phrase(1, 6))}</td></tr>" for _ in range(2)) + "</table>")
                elif r < 0.95:
                    parts.append(f"<figure><img src='/i.png'><figcaption>{text(phrase(2, 9))}</figcaption></figure>")
                else:
                    parts.append(boiler(rng.choice(["ad", "ad", "share", "form", "aside", "notice"])))
            return "".join(parts)

        title = phrase(3, 12).capitalize()
        heading = f"<h1>{text(title)}</h1>" if rng.random() < 0.85 else ""
        if heading and rng.random() < 0.15:
            heading = f"<header>{heading}</header>"
        opening, closing = rng.choice([("<article>", "</article>"), ("<article>", "</article>"), (f"<article{attribute(MAIN)}>", "</article>"), (f"<main{attribute(MAIN)}>", "</main>"), (f"<div{attribute(MAIN[:-1])}>", "</div>"), (f"<main><article><div{attribute(MAIN)}>", "</div></article></main>"), (f"<div{attribute(NEUTRAL)}><div{attribute(MAIN[:-1])}>", "</div></div>"), (f"<td{attribute(MAIN)}>", "</td>")])
        inside = heading + body(rng.choice([1, 2, 4, 7, 12]))
        tail = boiler("comments") if rng.random() < 0.35 else ""
        inner_tail = rng.random() < 0.4
        article = opening + inside + (tail if inner_tail else "") + closing + ("" if inner_tail else tail)
        before = "".join(boiler(r) for r in ("notice", "header", "nav", "ad", "form", "share", "aside") if rng.random() < {"nav": 0.8, "ad": 0.5, "header": 0.5}.get(r, 0.2))
        after = "".join(boiler(r) for r in ("aside", "share", "form", "ad", "nav", "notice", "footer") if rng.random() < {"footer": 0.85, "aside": 0.4}.get(r, 0.2))
        if number % 40 == 39:
            article, main = "", []
        shell = f"<div{attribute(NEUTRAL)}>{before}{article}{after}</div>" if rng.random() < 0.3 else before + article + after
        out.append((f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>{shell}</body></html>", main))
    return out


def extract(pages: DataFrame, field: Field | None = None, page: str = "html", out: str = "text") -> DataFrame:
    """All columns of ``pages`` and ``out``: the main text. ``field`` is trained on ``example_pages`` if not given."""
    spark = pages.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field or fit(example_pages()))
    kept = without(pages, out).columns
    (whole,) = free_names(pages, "whole_page")
    rows = pages.select(*[quoted(c) for c in kept], text_of(pages, page).alias(whole))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField(out, T.StringType(), False)])

    def run(batches):
        f = shared.value
        for batch in slices(batches):
            texts = []
            for page_ in batch.column(batch.num_columns - 1).to_pylist():
                found = blocks_of(page_)
                texts.append("\n".join(b.text for b, main in zip(found, f.decode(found), strict=True) if main))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[x.name for x in schema.fields])

    return rows.mapInArrow(run, schema)
