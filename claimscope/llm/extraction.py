"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimscope.llm.common import ROW, kept_columns, map_arrow, with_row

# How HTML nests.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style template title textarea iframe noembed noframes xmp svg math object canvas audio video".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript ol optgroup option p pre "
    "search section select summary table tbody td tfoot th thead tr ul".split()
)
# An opening tag ends these open elements, up to the nearest of the second list.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
INLINE_IN_P = frozenset({"button", "label"})  # blocks of their own that may stand in a paragraph

_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(?:[!?]|/[^a-zA-Z>])[^>]*(?:>|\Z)|</>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Element:
    tag: str
    names: tuple[str, ...] = ()


@dataclass
class Block:
    """A run of text inside one innermost block element."""

    tags: tuple[str, ...]  # from the root to the block
    names: frozenset[str]  # words of class, id and role, of the block and of all around it
    near: tuple[str, ...]  # those of the innermost element that has any
    text: str
    linked: int  # characters inside links


def _names(attributes: str) -> tuple[str, ...]:
    found: list[str] = []
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name == "style":
            words = ["hidden"] if _INVISIBLE.search(value) else []
        elif name in ("hidden", "aria-hidden"):
            words = [] if value.lower() == "false" else ["hidden"]
        else:
            words = [w[:-1] if len(w) > 2 and w.endswith("s") else w for w in _TOKEN.findall(_CAMEL.sub(" ", value).lower())]
        found += words
    return tuple(dict.fromkeys(found))


def leaf_blocks(page: str) -> list[Block]:
    """Blocks in page order, white space collapsed, character references decoded, none empty.

    Follows HTML's nesting where it is broken: paragraphs, items and cells end where the next
    begins, stray end tags are ignored. Scripts, styles, comments and titles are no text; a
    line break is white space.
    """
    stack: list[Element] = []
    out: list[Block] = []
    run: list[tuple[str, bool]] = []
    links = 0

    def flush() -> None:
        if not run:
            return
        text = " ".join("".join(t for t, _ in run).split())
        if text:
            linked = sum(len(t.strip()) for t, in_link in run if in_link)
            blocks = tuple(e.tag for e in stack if e.tag in BLOCK)
            near = next((e.names for e in reversed(stack) if e.names and e.tag in BLOCK), ())
            names = frozenset(n for e in stack if e.tag in BLOCK for n in e.names)
            out.append(Block(blocks, names, near, text, linked))
        run.clear()

    def add(text: str) -> None:
        if text:
            run.append((html.unescape(text) if "&" in text else text, links > 0))

    def end(tags: set[str] | frozenset[str], bounds: set[str]) -> None:
        nonlocal links
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                flush()
                links -= sum(e.tag == "a" for e in stack[k:])
                del stack[k:]
                return
            if stack[k].tag in bounds:
                return

    at, size = 0, len(page)
    while at < size:
        tag = _TAG.search(page, at)
        if tag is None:
            add(page[at:])
            break
        add(page[at : tag.start()])
        at = tag.end()
        name = (tag[2] or tag[5] or "").lower()
        if not name:
            continue
        if tag[1] or tag[4]:
            if name in BLOCK:
                end(HEADINGS if name in HEADINGS else {name}, {"table"} if name not in ("table", "html", "body") else set())
            else:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k].tag == name:
                        links -= name == "a"
                        del stack[k]
                        break
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
            continue
        if name == "br":
            run.append((" ", False))
            continue
        if name in BLOCK:
            flush()
            if name not in INLINE_IN_P:
                end({"p"}, {"table", "button"})
            if name in HEADINGS and stack and stack[-1].tag in HEADINGS:
                end(HEADINGS, set())
            if name in ENDS:
                end(*ENDS[name])
        if name in VOID:
            continue
        stack.append(Element(name, _names(tag[3] or tag[6] or "")))
        links += name == "a"
    flush()
    return out


# --- the model ---------------------------------------------------------------------------


def _grade(value: float, bounds: Sequence[float]) -> int:
    return sum(value >= b for b in bounds)


LANDMARKS = frozenset("article main nav header footer aside form section".split())


def features(blocks: Sequence[Block]) -> list[list[str]]:
    """Names of the features of each block: ancestors, names on them, and what its text is like."""
    out = []
    last = max(len(blocks) - 1, 1)
    for k, b in enumerate(blocks):
        words = b.text.count(" ") + 1
        tag = b.tags[-1] if b.tags else "none"
        held = set(b.tags)
        marks = [t for t in b.tags if t in LANDMARKS]
        length, link = _grade(words, (2, 5, 10, 20, 40)), _grade(b.linked / len(b.text), (0.01, 0.4, 0.8))
        inside = "in" if "article" in held or "main" in held else "out"
        one = [f"tag {tag}", f"length {length}", f"link {link}", f"{length} {link}", f"{inside} {tag}", f"place {10 * k // last}"]
        one += [f"around {t}" for t in held]
        one += [f"name {n}" for n in b.names]
        one += [f"start {n[:5]}" for n in {m[:5] for m in b.names}]
        one += [f"near {n}" for n in b.near]
        one.append(f"mark {marks[-1] if marks else 'none'}")
        one.append(f"parent {b.tags[-2] if len(b.tags) > 1 else 'none'} {tag}")
        end_mark = b.text[-1]
        one.append(f"end {'stop' if end_mark in '.!?…' else 'colon' if end_mark == ':' else 'other'}")
        one.append(f"commas {_grade(b.text.count(','), (1, 3))}")
        if "©" in b.text:
            one.append("sign")
        if not b.names:
            one.append("no names")
        out.append(one)
    return out


@dataclass(frozen=True)
class Model:
    """Scores of main text over other text: per feature, at the start, and between neighbours."""

    weights: dict[str, float] = field(repr=False)
    start: tuple[float, float] = (0.0, 0.0)
    steps: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 0.0), (0.0, 0.0))

    def decode(self, blocks: Sequence[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks (Viterbi); a tie is other text."""
        if not blocks:
            return []
        get = self.weights.get
        scores = [sum(get(f, 0.0) for f in one) for one in features(blocks)]
        (aa, ab), (ba, bb) = self.steps
        other, main = self.start[0], self.start[1] + scores[0]
        back: list[tuple[bool, bool]] = []
        for s in scores[1:]:
            to_other, to_main = main + ba > other + aa, main + bb > other + ab
            back.append((to_other, to_main))
            other, main = (main + ba if to_other else other + aa), (main + bb if to_main else other + ab) + s
        label = main > other
        out = [label]
        for to_other, to_main in reversed(back):
            label = to_main if label else to_other
            out.append(label)
        return out[::-1]


def _sums(scores: np.ndarray, mask: np.ndarray, start: np.ndarray, steps: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log of the partition functions, marginals of main text, of first labels, and of label pairs."""
    pages, length = scores.shape
    level = np.stack([np.zeros_like(scores), scores], axis=2)
    ahead = np.empty((length, pages, 2))
    ahead[0] = start + level[:, 0]
    for t in range(1, length):
        moved = np.logaddexp(ahead[t - 1][:, :1] + steps[0], ahead[t - 1][:, 1:] + steps[1]) + level[:, t]
        ahead[t] = np.where(mask[:, t, None], moved, ahead[t - 1])
    whole = np.logaddexp(ahead[-1][:, 0], ahead[-1][:, 1])
    behind = np.zeros((pages, 2))
    main = np.zeros_like(scores)
    pairs = np.zeros((2, 2))
    for t in range(length - 1, -1, -1):
        main[:, t] = np.where(mask[:, t], np.exp(ahead[t][:, 1] + behind[:, 1] - whole), 0)
        if t:
            after = level[:, t] + behind
            joint = ahead[t - 1][:, :, None] + steps[None] + after[:, None, :] - whole[:, None, None]
            pairs += (np.exp(joint) * mask[:, t, None, None]).sum(axis=0)
            moved = np.logaddexp(steps[:, 0] + after[:, :1], steps[:, 1] + after[:, 1:])
            behind = np.where(mask[:, t, None], moved, behind)
    first = np.stack([1 - main[:, 0], main[:, 0]], axis=1).sum(axis=0)
    return float(whole.sum()), main, first, pairs


def fit(pages: Sequence[tuple[Sequence[Block], Sequence[bool]]], rounds: int = 150, rate: float = 0.1, decay: float = 0.3) -> Model:
    """A field that makes the labels of ``pages`` likely: gradient steps on the penalised likelihood."""
    pages = [(features(blocks), labels) for blocks, labels in pages if blocks]
    if not pages:
        return Model({})
    seen = Counter(f for rows, _ in pages for f in {f for row in rows for f in row})
    index = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n > 1))}
    length = max(len(rows) for rows, _ in pages)
    mask = np.array([[t < len(rows) for t in range(length)] for rows, _ in pages])
    truth = np.zeros(mask.shape)
    ids, cells = [], []
    for p, (rows, labels) in enumerate(pages):
        truth[p, : len(labels)] = labels
        for t, row in enumerate(rows):
            mine = [index[f] for f in row if f in index]
            ids += mine
            cells += [p * length + t] * len(mine)
    ids, cells = np.array(ids), np.array(cells)
    want_first = np.stack([1 - truth[:, 0], truth[:, 0]], axis=1).sum(axis=0)
    old, new, both = truth[:, :-1], truth[:, 1:], mask[:, 1:]
    want_pairs = np.array([[(((1 - old) if a == 0 else old) * ((1 - new) if b == 0 else new) * both).sum() for b in (0, 1)] for a in (0, 1)])

    value = np.zeros(len(index) + 6)
    mean, square = np.zeros_like(value), np.zeros_like(value)
    for step in range(1, rounds + 1):
        w, start, steps = value[: len(index)], value[-6:-4], value[-4:].reshape(2, 2)
        scores = np.bincount(cells, weights=w[ids], minlength=mask.size).reshape(mask.shape)
        _, main, first, pairs = _sums(scores, mask, start, steps)
        error = ((main - truth) * mask).ravel()
        slope = np.concatenate([np.bincount(ids, weights=error[cells], minlength=len(index)), first - want_first, (pairs - want_pairs).ravel()])
        slope = (slope + decay * value) / len(pages)
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        value = value - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
    steps = value[-4:].reshape(2, 2).tolist()
    return Model(dict(zip(index, value[: len(index)].tolist(), strict=True)), tuple(value[-6:-4].tolist()), tuple(map(tuple, steps)))


# --- labelled pages ----------------------------------------------------------------------

SAMPLE_PAGES = 200  # pages that lend their texts and, where they declare their article, labels
SAMPLE_CHARS = 100_000  # the longest page of that sample
LAYOUTS = 900  # labelled pages that are laid out from those texts
LAYOUT_BLOCKS = 120  # the longest labelled page

MAIN, OTHER = "\ue000", "\ue001"

ARTICLES = """<article>|<article class="post">|<main>|<main><article>|<main id="main">|<div class="content">|<div id="content">|
<div class="entry-content">|<div class="post-body">|<section class="article">|<div class="story">|<div itemprop="articleBody">|<div role="main">|
<div class="article-body">|<div class="post"><div class="text">|<article itemprop="article"><section>|<section>|<div>|<td>|""".replace("\n", "").split("|")
KINDS = {
    "menu": """<nav>|<nav class="main-nav">|<div class="menu">|<div id="nav">|<ul class="navbar">|<div class="breadcrumbs">|<div role="navigation">|
<ul class="menu">|<div class="pagination">|<div class="toc">|<menu>|<div class="navigation">|<nav role="navigation">|<div class="links">""",
    "header": """<header>|<div class="header">|<div id="masthead">|<div class="site-header">|<div class="topbar">|<div role="banner">|
<header class="site-header">|<div id="header">|<div class="logo">|<header class="page-header">|<div class="branding">""",
    "footer": """<footer>|<div class="footer">|<div id="footer">|<div class="site-footer">|<div role="contentinfo">|<div id="colophon">|
<div class="copyright">|<footer class="site-footer">|<div class="legal">|<div class="imprint">|<div class="bottom">""",
    "sidebar": """<aside>|<div class="sidebar">|<div id="sidebar">|<div class="widget">|<div class="related">|<div class="recommended">|
<div role="complementary">|<aside class="related-posts">|<div class="popular">|<div class="trending">|<div id="secondary">|<div class="teaser">|
<section class="related">|<div class="more-stories">|<div class="side">|<div class="see-also">|<div class="author-bio">|<div class="rail">""",
    "notice": """<div class="cookie-notice">|<div class="cookie-banner">|<div id="consent">|<div class="gdpr">|<div class="alert">|<div class="notice">|
<div class="popup">|<div class="modal">|<div class="newsletter">|<div class="subscribe">|<div role="alert">|<div role="dialog">|<dialog>|
<div class="disclaimer">|<div class="paywall">|<noscript>|<p class="notice">|<div class="privacy">|<section class="cookies">|<div hidden>|
<div class="message">|<div class="warning">|<div class="announcement">|<div class="overlay">|<div class="banner">|<div class="toast">""",
    "advert": """<div class="ad">|<div class="ads">|<div class="advert">|<div class="advertisement">|<div class="adsbygoogle">|<div class="sponsored">|
<div class="sponsor">|<div class="promo">|<div id="ad-top">|<div class="promotion">|<aside class="ad">|<p class="ad">|<div class="ad-slot">|
<section class="sponsored">|<div class="advertising">|<div class="commercial">|<div class="adbox">|<div class="partner">|<div class="outbrain">""",
    "form": """<form>|<form class="search">|<form id="login">|<div class="search-form"><form>|<form class="signup">|<fieldset>|<form class="contact">|
<div class="login">|<div class="search">|<form action="/search">|<div class="poll">""",
    "comments": """<section id="comments">|<div class="comments">|<div id="comments">|<ol class="commentlist">|<section class="comments">|
<div class="comment">|<div class="reply">|<div id="respond">|<div class="disqus">|<ul class="comment-list">|<div class="responses">|
<div class="discussion">|<div class="user-comments">|<div class="feedback">|<div class="reviews">|<aside class="comments">""",
    "share": """<div class="share">|<div class="social">|<ul class="share-buttons">|<div class="tags">|<div class="follow">|<div class="sharing">""",
}
KINDS = {kind: names.replace("\n", "").split("|") for kind, names in KINDS.items()}
FRAMES = ["", "", '<div class="container">', '<div class="wrapper">', '<div id="page">', '<div class="row"><div class="col">', "<table><tr>", "<div>", '<div class="site"><div class="inner">']
WITHIN = ("advert", "sidebar", "comments", "share", "notice", "form", "menu", "footer")
PLAIN = "The first line says what it is about, and the second says more. Others follow here; some are short. Some are not."


def _within(opening: str, inner: str) -> str:
    return opening + inner + "".join(f"</{t}>" for t in reversed(re.findall(r"<(\w+)", opening)))


class _Layouts:
    """Pages laid out at random from given texts, each text marked with its label."""

    def __init__(self, articles: Sequence[Sequence[str]], others: Sequence[str], seed: int):
        self.rng = random.Random(seed)
        self.articles = [a for a in articles if a] or [[PLAIN] * 4]
        self.others = list(others) or [PLAIN]
        self.sentences = [s for a in self.articles for t in a for s in re.findall(r"[^.!?]+[.!?]?", t) if s.strip()] or [PLAIN]

    def text(self, label: str, text: str) -> str:
        return label + html.escape(text.replace(MAIN, "").replace(OTHER, ""), quote=False)

    def phrase(self, most: int) -> str:
        words = self.rng.choice(self.others).split() or ["more"]
        at = self.rng.randrange(len(words))
        return self.text(OTHER, " ".join(words[at : at + self.rng.randint(1, most)]))

    def prose(self) -> str:
        rng = self.rng
        if rng.random() < 0.4:
            return self.text(OTHER, rng.choice(self.others))
        at = rng.randrange(len(self.sentences))
        return self.text(OTHER, "".join(self.sentences[at : at + rng.randint(1, 4)]))

    def link(self, most: int = 4) -> str:
        return f'<a href="/{self.rng.randrange(999)}">{self.phrase(most)}</a>'

    def link_list(self) -> str:
        rng, links = self.rng, [self.link() for _ in range(self.rng.randint(2, 7))]
        form = rng.randrange(4)
        if form == 0:
            return "<ul>" + "".join(f"<li>{x}</li>" for x in links) + "</ul>"
        if form == 1:
            return " | ".join(links)
        if form == 2:
            return "".join(f"<li>{x}" for x in links)
        return "".join(f"<div>{x}</div>" for x in links)

    def boilerplate(self, kind: str) -> str:
        rng = self.rng
        opening = rng.choice(KINDS[kind])
        pieces: list[str] = []
        if kind in ("menu", "share"):
            pieces.append(self.link_list())
        elif kind == "header":
            site = self.phrase(4)
            pieces.append(rng.choice([f"<h1>{site}</h1>", f"<a>{site}</a>", f"<div>{site}</div>", f"<p>{self.prose()}</p>", site, f"<h2>{site}</h2>"]))
            if rng.random() < 0.4:
                pieces.append(rng.choice([f"<p>{self.prose()}</p>", self.link_list()]))
        elif kind == "footer":
            sign = rng.choice(["&copy; ", "", "", "&#169; 2020 "])
            pieces.append(rng.choice([sign + self.prose(), f"<p>{sign}{self.prose()}</p>", f"<div>{sign}{self.phrase(6)}</div>", self.link_list()]))
        elif kind == "sidebar":
            pieces += [f"<h3>{self.phrase(4)}</h3>"] * rng.randint(0, 1)
            pieces += [rng.choice([f"<p>{self.prose()}</p>", self.link_list(), self.prose(), f"<div>{self.prose()}</div>"]) for _ in range(rng.randint(1, 3))]
        elif kind == "form":
            pieces += [f"<label>{self.phrase(3)}</label><input name=x>" for _ in range(rng.randint(0, 3))]
            pieces += [f"<p>{self.prose()}</p>"] * rng.randint(0, 1)
            pieces.append(rng.choice([f"<button>{self.phrase(2)}</button>", f"<select><option>{self.phrase(2)}<option>{self.phrase(2)}</select>", self.phrase(3)]))
        elif kind == "comments":
            pieces += [f"<h3>{self.phrase(3)}</h3>"] * rng.randint(0, 1)
            for _ in range(rng.randint(1, 5)):
                item = rng.choice(["<li>", "<div>", '<div class="comment">', '<li class="comment">', '<article class="comment">', '<div class="comment-body">'])
                who = rng.choice(["", f"<cite>{self.phrase(2)}</cite> ", f"<div>{self.phrase(2)}</div>", f"<b>{self.phrase(2)}</b>: "])
                pieces.append(_within(item, who + rng.choice([f"<p>{self.prose()}</p>", self.prose()])))
        else:
            pieces += [rng.choice([self.prose(), f"<p>{self.prose()}</p>", self.link(8), f"<div>{self.prose()}</div>"]) for _ in range(rng.randint(1, 2))]
            if kind == "notice" and rng.random() < 0.4:
                pieces.append(f"<button>{self.phrase(2)}</button>")
        return _within(opening, "".join(pieces))

    def page(self) -> str:
        rng = self.rng
        texts = list(rng.choice(self.articles))
        at = rng.randrange(len(texts))
        texts = texts[at : at + rng.randint(1, 25)]
        parts = []
        if rng.random() < 0.8:
            title = self.text(MAIN, " ".join(texts[0].split()[:9]))
            parts.append(rng.choice([f"<h1>{title}</h1>"] * 3 + [f"<h2>{title}</h2>", f"<header><h1>{title}</h1></header>", f'<h1 class="title">{title}</h1>']))
        style = rng.randrange(5)
        for t in texts:
            x = self.text(MAIN, t)
            if rng.random() < 0.06:
                parts.append(_within(f"<h{rng.randint(2, 4)}>", self.text(MAIN, " ".join(t.split()[:6]))))
            if rng.random() < 0.08:
                words = t.split()
                items = "".join(f"<li>{self.text(MAIN, ' '.join(words[k : k + 8]))}</li>" for k in range(0, min(len(words), 32), 8))
                parts.append(_within(rng.choice(["<ul>", "<ol>"]), items))
            if rng.random() < 0.08:
                x = f'{x} <a href="/x">{html.escape(" ".join(t.split()[:2]), quote=False)}</a>'
            plain = [f"<p>{x}</p>", f"<p>{x}", f"<p><b>{x}<br>", f"<div>{x}</div>", f"<p>{x}</p>"][style]
            parts.append(rng.choice([plain] * 12 + [f"<blockquote>{x}</blockquote>", f"<pre>{x}</pre>", f"<figure><figcaption>{x}</figcaption></figure>", f"<section><p>{x}</p></section>", f"<table><tr><td>{x}</td></tr></table>"]))
        for kind in rng.sample(WITHIN, rng.choice([0, 0, 1, 1, 2, 3])):
            where = len(parts) if kind in ("comments", "footer", "share") else rng.randint(0, len(parts))
            parts.insert(where, self.boilerplate(kind))
        article = _within(rng.choice(ARTICLES), "".join(parts))
        before = [self.boilerplate(k) for k in rng.choices(["menu", "header", "notice", "advert", "form", "sidebar", "share"], k=rng.randint(0, 4))]
        after = [self.boilerplate(k) for k in rng.choices(["footer", "sidebar", "comments", "advert", "notice", "share", "menu", "form"], k=rng.randint(0, 4))]
        body = _within(rng.choice(FRAMES), "".join(before) + article + "".join(after))
        return f"<!DOCTYPE html><html><head><title>x</title></head><body>{body}</body></html>" if rng.random() < 0.9 else body


def _declared(blocks: Sequence[Block]) -> list[bool]:
    """Which blocks lie in what a page declares as its article, and in none of the parts that never belong to one."""
    never = {"nav", "aside", "footer", "form", "header"}
    return [("article" in b.tags or "main" in b.tags) and not never & set(b.tags) and not b.names for b in blocks]


def labelled_pages(pages: Sequence[str], layouts: int = LAYOUTS, seed: int = 13) -> list[tuple[list[Block], list[bool]]]:
    """Pages with labels, from a sample of real ones.

    A page that declares its article labels itself. The texts of all pages, of articles and of
    the rest, are then laid out anew in many ways, with articles and boilerplate under other
    tags and names or none, so that the declaration alone does not decide.
    """
    out, articles, others = [], [], []
    for page in pages:
        blocks = leaf_blocks(page)[:LAYOUT_BLOCKS]
        labels = _declared(blocks)
        articles.append([b.text for b, main in zip(blocks, labels, strict=True) if main])
        others += [b.text for b, main in zip(blocks, labels, strict=True) if not main]
        if any(labels) and len(out) < layouts // 6:
            out.append((blocks, labels))
    make = _Layouts(articles, others, seed)
    for _ in range(layouts):
        blocks = leaf_blocks(make.page())[:LAYOUT_BLOCKS]
        labels = [MAIN in b.text for b in blocks]
        for b in blocks:
            b.text = " ".join(b.text.replace(MAIN, "").replace(OTHER, "").split()) or "x"
        out.append((blocks, labels))
    return out


def trained(pages: DataFrame, page_html: str = "html", sample_pages: int = SAMPLE_PAGES) -> Model:
    """A model fitted on labelled pages made from at most ``sample_pages`` pages of the table.

    The sample is the pages with the smallest hashes of their html, each counted once, of at
    most ``SAMPLE_CHARS`` characters, so it does not depend on how the table is stored.
    """
    text = F.col(f"`{page_html}`").cast("string")
    drawn = pages.select(text.alias("html")).where(F.length("html").between(1, SAMPLE_CHARS))
    drawn = drawn.select(F.xxhash64("html", F.lit(13)).alias("h"), "html")
    # Hashes first: only they are dealt out, not the pages.
    least = [r["h"] for r in drawn.select("h").distinct().orderBy("h").limit(sample_pages).collect()]
    some = drawn.where(F.col("h").isin(least)).dropDuplicates(["h"]).orderBy("h").collect()
    return fit(labelled_pages([r["html"] for r in some]))


def main_text(page: str | None, model: Model) -> str:
    """Blocks of the article, joined by line feeds; empty if there is none."""
    blocks = leaf_blocks(page or "")
    return "\n".join(b.text for b, main in zip(blocks, model.decode(blocks), strict=True) if main)


def extract(pages: DataFrame, page_html: str = "html", model: Model | None = None) -> DataFrame:
    """Every page with ``text``, its main text, and ``n_chars``, the code points of that.

    Keeps the other columns of ``pages``, html left out; one called ``text`` or ``n_chars``
    becomes ``row_text`` or ``row_n_chars``. NULL html counts as empty; an empty page, or one
    without main text, has an empty text. Repeated rows are repeated; an empty table gives
    no rows. Every page is read whole.
    """
    found = model or trained(pages, page_html)
    packed = with_row(pages, html=F.col(f"`{page_html}`").cast("string"))
    rest = [c for c in pages.columns if c != page_html]
    packed = packed.select(F.struct(*(F.col(ROW)[c].alias(c) for c in rest)).alias(ROW) if rest else F.struct(F.lit(0).alias("_")).alias(ROW), "html")

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page, found) for page in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [ROW, "text", "n_chars"])

    schema = T.StructType([packed.schema[ROW], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    return map_arrow(packed, step, schema).select(*kept_columns(rest, ["text", "n_chars"]), "text", "n_chars")
