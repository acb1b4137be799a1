"""HTML extraction: a linear-chain conditional random field over the leaf blocks of a page.

A page becomes its leaf blocks in page order: the text between block-level tags, with
the tags and the class, id and role words of its ancestors. Features of a block are
these tags and words, kinds of them, and what the text looks like (length, share of
links, ends of sentences, position, typical phrases). The field has two labels (main
text or not), emission weights for each feature and transition weights; it is trained
by gradient ascent on the conditional likelihood of labelled pages and decoded by
Viterbi. Blocks labelled as main text are joined by one space.

The labelled pages are laid out here, with known labels, around texts from a bounded
sample of the given pages: menus, headers, sidebars, notices, adverts, forms, reader
comments and footers in many common markups around articles in as many.

Results for odd rows: a null or empty page, or one without main text, has an empty
text; pages are extracted one by one, so repeated rows give repeated results and other
columns are ignored; unclosed tags, quotes and comments end with the page; very long texts
and blocks are taken whole; formulas (without their annotations) and xmp are text like other text; an empty
table gives an empty result (the field is then trained on stock texts).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollbook.llm.common import in_batches, text_of

#: Pages whose texts fill the labelled pages, and labelled pages: the bounds of training.
SAMPLE_PAGES, LABELLED_PAGES = 200, 400
#: Characters of a sampled page from which the driver takes texts for the labelled pages; extraction reads whole pages.
SAMPLE_CHARS = 20_000

# Kinds of elements in HTML: fixed values.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr "
    # formulas are text within a line
    "math semantics mrow mi mn mo ms mtext mspace mstyle mpadded msup msub msubsup mfrac msqrt mroot munder mover munderover "
    "mmultiscripts mfenced merror annotation annotation-xml".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
UNSEEN = frozenset("head noscript template svg select object canvas audio video datalist annotation annotation-xml".split())
P_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
#: Elements of one kind that end an open one before them, up to the element that holds them.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
#: Words of classes and ids that designers use for what surrounds a text, and for the text.
AROUND = frozenset(
    "ad ads adv advert advertisement adverts banner sponsor sponsored promo promotion nav navbar navigation menu menus "
    "breadcrumb breadcrumbs header head masthead topbar top footer foot bottom copyright legal sidebar side aside rail "
    "widget widgets related recommended trending popular more cookie cookies consent gdpr notice notices alert popup "
    "modal overlay toast newsletter subscribe signup login search form forms share sharing social follow comment "
    "comments commentlist reply replies respond disqus discussion pagination pager tags toolbar skip complementary "
    "contentinfo dialog hidden".split()
)
TEXT = frozenset("article post entry story content main body text prose page blog news single".split())
AROUND_TAGS = frozenset("nav header footer aside form dialog fieldset menu button search".split())
TEXT_TAGS = frozenset("article main".split())
PHRASES = re.compile(
    r"©|copyright|all rights reserved|cookie|subscribe|newsletter|sign (?:in|up)|log ?in|password|share|tweet|"
    r"advert|sponsor|comment|repl(?:y|ies)|read more|related|privacy|terms|contact|menu|search|\bposted\b",
    re.I,
)

_token = re.compile(
    r"<!--(?:.*?-->|.*)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>?|"
    r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>",
    re.S,
)
_attribute = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_word = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    """A leaf block: its text, its ancestors (tag, words), and how many of its characters are links."""

    text: str
    path: tuple
    linked: int


def _element(tag: str, attributes: str) -> tuple[str, tuple[str, ...]]:
    """A tag with the words of its class, id and role."""
    words = []
    if attributes:
        for name, *values in _attribute.findall(attributes):
            value = "".join(values)
            kind = name.lower()
            if kind == "hidden" or (kind == "aria-hidden" and value.lower() == "true"):
                words.append("hidden")
            elif kind == "style":
                if "display:none" in value.replace(" ", "").lower():
                    words.append("hidden")
            elif kind != "aria-hidden":
                words += [w.lower() for w in _word.findall(value)]
    return tag, tuple(dict.fromkeys(words))


def blocks_of(page: str) -> list[Block]:
    """The leaf blocks of a page in page order."""
    out: list[Block] = []
    path: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    link_parts: list[str] = []
    unseen = links = 0
    at = 0

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Block(text, tuple(path), sum(len(" ".join(p.split())) for p in link_parts)))
            parts.clear()
            link_parts.clear()

    def pop(to: int) -> None:
        nonlocal unseen, links
        if any(e[0] not in INLINE for e in path[to:]):
            flush()
        for tag, _ in path[to:]:
            unseen -= tag in UNSEEN
            links -= tag == "a"
        del path[to:]

    def add(piece: str) -> None:
        if piece and not unseen:
            piece = html.unescape(piece) if "&" in piece else piece
            parts.append(piece)
            if links:
                link_parts.append(piece)

    while (found := _token.search(page, at)) is not None:
        add(page[at : found.start()])
        at = found.end()
        closing, tag, attributes = found.groups()
        if tag is None:
            continue
        tag = tag.lower()
        if closing:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == tag:
                    pop(k)
                    break
            else:
                if tag not in INLINE:
                    flush()
            continue
        if tag in RAW:
            if not attributes.endswith("/") or tag in ("script", "style"):
                end = re.compile(f"</{tag}[^>]*>?", re.I).search(page, at)
                raw = page[at : len(page) if end is None else end.start()]
                at = len(page) if end is None else end.end()
                if tag == "xmp" and not unseen:  # shown as it stands, without references
                    flush()
                    path.append(_element(tag, attributes))
                    parts.append(raw)
                    if links:
                        link_parts.append(raw)
                    pop(len(path) - 1)
            continue
        if tag == "body" and unseen:  # a head without its end
            for k, (name, _) in enumerate(path):
                if name == "head":
                    pop(k)
                    break
        if tag in P_ENDS:
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] == "p":
                    pop(k)
                    break
                if path[k][0] in P_ENDS or path[k][0] in ("td", "th", "button", "li"):
                    break
        if tag in SIBLINGS:
            ended, holders = SIBLINGS[tag]
            for k in range(len(path) - 1, -1, -1):
                if path[k][0] in ended:
                    pop(k)
                    if tag != "tr" or path[-1:] == [] or path[-1][0] not in ended:
                        break
                elif path[k][0] in holders:
                    break
        if tag == "br":
            add("\n")
        elif tag not in INLINE:
            flush()
        if tag not in VOID and not attributes.endswith("/"):
            path.append(_element(tag, attributes))
            unseen += tag in UNSEEN
            links += tag == "a"
    add(page[at:])
    flush()
    return out


def _level(x: float, steps: tuple) -> int:
    return sum(x >= s for s in steps)


def path_features(path: tuple) -> list[str]:
    """What a block's ancestors say."""
    out = []
    around = text = 0
    nearest = "none"
    for tag, words in path:
        if tag in INLINE:
            continue
        out.append(f"under {tag}")
        out += [f"word {w}" for w in words]
        if any(w in AROUND for w in words):
            around, nearest = around + 1, "around"
        elif any(w in TEXT for w in words):
            text, nearest = text + 1, "text"
        elif tag in AROUND_TAGS:
            nearest = "around"
        elif tag in TEXT_TAGS:
            nearest = "text"
    blocks = [e for e in path if e[0] not in INLINE]
    if blocks:
        out.append(f"in {blocks[-1][0]}")
    articles = sum(e[0] == "article" for e in blocks)
    out += [f"around {min(around, 2)}", f"text {min(text, 2)}", f"articles {min(articles, 2)}", f"nearest {nearest}"]
    return list(dict.fromkeys(out))


def text_features(block: Block, place: int, total: int) -> list[str]:
    """What a block's text and place say."""
    text = block.text
    words = text.count(" ") + 1
    out = [
        f"words {_level(words, (2, 4, 8, 16, 32, 64))}",
        f"links {_level(block.linked / len(text), (0.01, 0.3, 0.7, 0.99))}",
        f"place {_level(place / total, (0.1, 0.9))}",
        f"ends {text[-1] in '.!?…:;»”'}",
    ]
    if PHRASES.search(text):
        out.append(f"phrase {words >= 32}")
    return out


@dataclass
class Field:
    """Weights of the field: for each feature, from label to label, at the start and at the end."""

    features: dict
    emission: np.ndarray
    step: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def labels(self, blocks: list[Block], known: dict) -> list[int]:
        """The likeliest labels by Viterbi. ``known`` keeps the scores of paths seen before."""
        if not blocks:
            return []
        (t00, t01), (t10, t11) = self.step.tolist()
        back, (a, b) = [], self.start.tolist()
        total = len(blocks)
        for k, block in enumerate(blocks):
            score = known.get(block.path)
            if score is None:
                if len(known) > 50_000:
                    known.clear()
                score = known[block.path] = self._sum(path_features(block.path))
            own = self._sum(text_features(block, k, total))
            if k:
                back.append((a + t00 < b + t10, a + t01 < b + t11))
                a, b = max(a + t00, b + t10), max(a + t01, b + t11)
            a, b = a + score[0] + own[0], b + score[1] + own[1]
        now = int(a + float(self.end[0]) < b + float(self.end[1]))
        out = [now]
        for pointer in reversed(back):
            now = int(pointer[now])
            out.append(now)
        return out[::-1]

    def _sum(self, names: list[str]) -> tuple[float, float]:
        rows = [self.features[n] for n in names if n in self.features]
        total = self.emission[rows].sum(axis=0) if rows else (0.0, 0.0)
        return float(total[0]), float(total[1])


def train(pages: list[tuple[list[Block], list[int]]], rounds: int = 150, rate: float = 0.3, decay: float = 1e-3) -> Field:
    """Fit the field to labelled pages: gradient ascent on the mean conditional log likelihood, step by AdaGrad."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, marks, sizes = [], [], []
    for blocks, labels in pages:
        sizes.append(len(blocks))
        marks += labels
        for k, block in enumerate(blocks):
            found = path_features(block.path) + text_features(block, k, len(blocks))
            rows.append([names.setdefault(n, len(names)) for n in found])
    flat = np.concatenate(rows)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    label = np.array(marks)
    longest, count = max(sizes), len(sizes)
    page = np.repeat(np.arange(count), sizes)
    place = np.concatenate([np.arange(s) for s in sizes])
    last = np.array(sizes) - 1
    weights = [np.zeros((len(names), 2)), np.zeros((2, 2)), np.zeros(2), np.zeros(2)]
    grown = [np.full_like(w, 1e-8) for w in weights]
    inside = np.arange(longest)[None, :] < np.array(sizes)[:, None]
    truth = np.zeros((count, longest), int)
    truth[page, place] = label
    for _ in range(rounds):
        emission, step, start, end = weights
        own = np.zeros((len(rows), 2))
        np.add.at(own, owner, emission[flat])
        score = np.zeros((count, longest, 2))
        score[page, place] = own
        ahead, behind = np.zeros_like(score), np.zeros_like(score)
        ahead[:, 0] = start + score[:, 0]
        for k in range(1, longest):
            ahead[:, k] = np.logaddexp.reduce(ahead[:, k - 1, :, None] + step, axis=1) + score[:, k]
        behind[np.arange(count), last] = end
        for k in range(longest - 2, -1, -1):
            value = np.logaddexp.reduce(step + (score[:, k + 1] + behind[:, k + 1])[:, None, :], axis=2)
            behind[:, k] = np.where((k < last)[:, None], value, behind[:, k])
        whole = np.logaddexp.reduce(ahead[np.arange(count), last] + end, axis=1)
        chance = np.exp(ahead + behind - whole[:, None, None]) * inside[:, :, None]
        pairs = ahead[:, :-1, :, None] + step + (score[:, 1:] + behind[:, 1:])[:, :, None, :] - whole[:, None, None, None]
        pairs = np.exp(np.where(inside[:, 1:, None, None], pairs, -700)) * inside[:, 1:, None, None]
        hit = np.eye(2)[truth] * inside[:, :, None]
        more = (hit - chance)[page, place]
        slopes = [np.zeros_like(w) for w in weights]
        np.add.at(slopes[0], flat, more[owner])
        seen = np.einsum("pki,pkj->ij", hit[:, :-1], hit[:, 1:])
        slopes[1] = seen - pairs.sum(axis=(0, 1))
        slopes[2] = (hit - chance)[:, 0].sum(axis=0)
        slopes[3] = (hit - chance)[np.arange(count), last].sum(axis=0)
        for w, g, s in zip(weights, grown, slopes, strict=True):
            s = s / count - decay * w
            g += s * s
            w += rate * s / np.sqrt(g)
    return Field(names, *weights)


# ---- labelled pages -------------------------------------------------------------------------------------------------

#: Ways to lay out what is around a text: (markup before, markup after). {x} is a random number.
FRAMES = {
    "header": [
        ("<header>", "</header>"),
        ('<div class="header">', "</div>"),
        ('<div id="masthead">', "</div>"),
        ('<div class="site-header top-bar">', "</div>"),
        ('<div role="banner">', "</div>"),
    ],
    "nav": [
        ("<nav><ul>", "</ul></nav>"),
        ('<div class="menu"><ul>', "</ul></div>"),
        ('<ul class="nav navbar">', "</ul>"),
        ('<div id="navigation"><ul>', "</ul></div>"),
        ('<ol class="breadcrumb">', "</ol>"),
        ('<nav class="pagination"><ul>', "</ul></nav>"),
    ],
    "ad": [
        ('<div class="ad">', "</div>"),
        ('<div class="ads">', "</div>"),
        ('<div class="advert">', "</div>"),
        ('<div id="banner-ad-{x}">', "</div>"),
        ('<aside class="sponsored"><p>', "</p></aside>"),
        ('<div class="advertisement"><p>', "</p></div>"),
        ('<div class="promo"><p>', "</p></div>"),
    ],
    "notice": [
        ('<div class="cookie-notice">', "</div>"),
        ('<div id="cookie-consent"><p>', "</p></div>"),
        ('<div class="notice">', "</div>"),
        ('<div class="alert"><p>', "</p></div>"),
        ('<div role="dialog" class="popup"><p>', "</p></div>"),
        ('<section class="gdpr consent"><p>', "</p></section>"),
        ('<div class="modal overlay"><p>', "</p></div>"),
        ("<dialog><p>", "</p></dialog>"),
    ],
    "sidebar": [
        ("<aside>", "</aside>"),
        ('<div class="sidebar">', "</div>"),
        ('<div id="sidebar"><div class="widget">', "</div></div>"),
        ('<section class="related">', "</section>"),
        ('<div class="right-rail">', "</div>"),
        ('<aside class="sidebar">', "</aside>"),
        ('<div class="recommended more">', "</div>"),
    ],
    "comment": [
        ('<section class="comments">', "</section>"),
        ('<div id="comments">', "</div>"),
        ('<div class="comment-list">', "</div>"),
        ('<section id="discussion" class="comments">', "</section>"),
        ('<div id="disqus_thread">', "</div>"),
        ('<div class="reader-comments">', "</div>"),
        ('<ol class="commentlist">', "</ol>"),
    ],
    "form": [
        ("<form>", "</form>"),
        ('<form class="newsletter">', "</form>"),
        ('<form id="search">', "</form>"),
        ('<div class="subscribe signup"><form>', "</form></div>"),
        ('<fieldset class="login">', "</fieldset>"),
    ],
    "share": [
        ('<div class="share">', "</div>"),
        ('<div class="social follow"><ul>', "</ul></div>"),
        ('<div class="tags">', "</div>"),
    ],
    "footer": [
        ("<footer>", "</footer>"),
        ('<div class="footer">', "</div>"),
        ('<div id="footer"><p>', "</p></div>"),
        ('<div class="copyright">', "</div>"),
        ('<div role="contentinfo">', "</div>"),
        ('<footer class="site-footer"><p>', "</p></footer>"),
    ],
    "main": [
        ("<article>", "</article>"),
        ("<main>", "</main>"),
        ("<main><article>", "</article></main>"),
        ('<div class="content">', "</div>"),
        ('<div id="content"><div class="post">', "</div></div>"),
        ('<div class="article-body">', "</div>"),
        ('<div class="entry-content">', "</div>"),
        ('<section class="story">', "</section>"),
        ('<div id="main">', "</div>"),
        ('<div itemprop="articleBody">', "</div>"),
        ("<div>", "</div>"),
    ],
}
STOCK = (
    "The river rose after three days of rain. Farmers moved their herds to higher ground, and the mill stopped.",
    "A short note.",
    "She opened the letter, read it twice, and put it back into the drawer without a word.",
    "Most of the town had gone to the fair; only the baker stayed behind.",
)


class Layout:
    """Lays out one labelled page at a time around texts of a pool."""

    def __init__(self, pool: list[str], seed: int = 20260103):
        self.pool, self.random = pool or list(STOCK), np.random.default_rng(seed)
        self.mark = 0

    def pick(self, options):
        return options[int(self.random.integers(len(options)))]

    def words(self, low: int, high: int) -> str:
        words = self.pick(self.pool).split()
        at = int(self.random.integers(max(1, len(words) - low)))
        return " ".join(words[at : at + int(self.random.integers(low, high + 1))]) or "More"

    def text(self, kind: int) -> str:
        """A text that says its label: \\x01 in front of main text, \\x02 in front of all other."""
        long = self.pick(self.pool) if self.random.random() < 0.7 else self.words(3, 20)
        if kind and self.random.random() < 0.2:
            long = f"<b>{long}</b>" if self.random.random() < 0.5 else f'{long} <a href="/x">{self.words(1, 3)}</a> {self.words(3, 9)}'
        return ("\x01" if kind else "\x02") + long

    def links(self) -> str:
        return "".join(f'<li><a href="/{k}">\x02{self.words(1, 3)}</a></li>' for k in range(int(self.random.integers(3, 9))))

    def around(self, kind: str) -> str:
        before, after = self.pick(FRAMES[kind])
        before = before.replace("{x}", str(int(self.random.integers(99))))
        if "<ul" in before or "<ol class=\"breadcrumb" in before:
            inner = self.links()
        elif kind == "form":
            inner = f'<label>\x02{self.words(1, 3)}</label><input name="q"><p>\x02{self.words(3, 20)}</p><button>\x02{self.words(1, 2)}</button>'
        elif kind == "comment":
            item = self.pick(("<p>{t}</p>", '<div class="comment"><p>{t}</p></div>', '<article class="comment"><p>{t}</p></article>', "<li><p>{t}</p></li>"))
            inner = f"<h3>\x02{self.words(1, 3)}</h3>" + "".join(item.replace("{t}", self.text(0)) for _ in range(int(self.random.integers(1, 6))))
        elif kind == "sidebar":
            inner = f"<h3>\x02{self.words(1, 4)}</h3>" + (
                "<ul>" + self.links() + "</ul>" if self.random.random() < 0.4 else "".join(f"<p>{self.text(0)}</p>" for _ in range(int(self.random.integers(1, 4))))
            )
        elif kind == "footer":
            inner = self.pick(("\x02&copy; 2024 example.com &middot; ", "\x02Copyright ", "\x02")) + self.words(2, 12)
            if "<p" not in before and self.random.random() < 0.4:
                inner = f"<p>{inner}</p><p>{self.text(0)}</p>"
        elif kind == "share":
            inner = f'<a href="#">\x02{self.words(1, 2)}</a>'
        elif kind == "header":
            tag = self.pick(("h1", "h2", "p", "div", "a"))
            inner = f"<{tag}>\x02{self.words(1, 5)}</{tag}>" + ("<p>\x02" + self.words(2, 12) + "</p>") * (self.random.random() < 0.5)
        else:
            inner = self.text(0) if self.random.random() < 0.7 else "\x02" + self.words(2, 12)
        return before + inner + after

    def article(self) -> str:
        before, after = self.pick(FRAMES["main"])
        out = [before]
        if self.random.random() < 0.8:
            out.append(f"<h1>\x01{self.words(3, 12)}</h1>")
        if self.random.random() < 0.15:
            out.append(self.around("share"))
        for _ in range(int(self.random.integers(1, 12))):
            x = self.random.random()
            if x < 0.7:
                out.append(f"<p>{self.text(1)}" + ("</p>" if self.random.random() < 0.9 else "<br>"))
            elif x < 0.76:
                out.append(f"<h2>\x01{self.words(2, 8)}</h2>")
            elif x < 0.82:
                out.append("<ul>" + "".join(f"<li>\x01{self.words(3, 20)}</li>" for _ in range(3)) + "</ul>")
            elif x < 0.87:
                out.append(f"<blockquote><p>{self.text(1)}</p></blockquote>")
            elif x < 0.9:
                out.append(f"<pre>{self.text(1)}</pre>")
            elif x < 0.93:
                out.append(f"<table><tr><td>\x01{self.words(1, 5)}</td><td>\x01{self.words(1, 5)}</td></tr></table>")
            else:
                out.append(self.around(self.pick(("ad", "share", "form", "sidebar", "notice"))))
        return "".join(out) + after

    def page(self) -> tuple[list[Block], list[int]]:
        """The blocks of a new page and their labels."""
        some = lambda kind, share: self.around(kind) if self.random.random() < share else ""
        body = "".join(
            [
                some("notice", 0.4),
                some("header", 0.5),
                some("nav", 0.7),
                some("ad", 0.5),
                some("sidebar", 0.25),
                self.article(),
                some("share", 0.2),
                some("ad", 0.2),
                some("sidebar", 0.3),
                some("form", 0.35),
                some("comment", 0.4),
                some("nav", 0.15),
                some("footer", 0.8),
                some("notice", 0.1),
            ]
        )
        blocks = blocks_of(f"<html><head><title>x</title></head><body>{body}</body></html>")
        labels = [int("\x01" in b.text) for b in blocks]
        for b in blocks:
            b.text = b.text.replace("\x01", "").replace("\x02", "").strip() or "More"
        return blocks, labels


def fit_field(pages: DataFrame, sample: int = SAMPLE_PAGES, labelled: int = LABELLED_PAGES) -> Field:
    """The field from ``labelled`` pages around texts of the ``sample`` pages whose ids hash lowest."""
    hashed = pages.filter("html is not null").withColumn("page_hash", F.xxhash64(F.col("page_id").cast("string")))
    lowest = {r[0] for r in hashed.select("page_hash").orderBy("page_hash").limit(sample).collect()}
    start = F.substring(F.col("html").cast("string"), 1, SAMPLE_CHARS)
    rows = hashed.filter(F.col("page_hash").isin(*lowest)).groupBy("page_hash").agg(F.min(start).alias("start")).collect()
    texts = (b.text for r in rows for b in blocks_of(r["start"]))
    pool = sorted({html.escape(t).translate({1: " ", 2: " "}) for t in texts})
    layout = Layout(pool)
    return train([layout.page() for _ in range(labelled)])


def main_text(page: str, field: Field, known: dict) -> str:
    """The main text of a page."""
    blocks = blocks_of(page)
    return " ".join(b.text for b, label in zip(blocks, field.labels(blocks, known), strict=True) if label)


def extract(pages: DataFrame, field: Field | None = None) -> DataFrame:
    """page_id, url, text and n_chars (code points of text) of each page. No shuffle of pages."""
    field = field or fit_field(pages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict = {}
        for batch in batches:
            texts = [main_text(page, field, known) for page in batch.column(2).to_pylist()]
            lengths = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), lengths],
                names=["page_id", "url", "text", "n_chars"],
            )

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), text_of("html").alias("html"))
    return own.transform(in_batches, run, "page_id long, url string, text string, n_chars long")
