"""Main text of web pages by a linear-chain CRF over DOM leaf blocks (operator 10).

A tolerant scanner reads the page into leaf blocks: runs of text between block-level tags, each with
the chain of its open ancestors. Features are the ancestors' tags and class words and the text's shape;
a linear-chain conditional random field over the blocks of a page, trained here on generated labelled
pages (training_pages, a documented bound), is decoded by Viterbi into main text and everything else.

Defined results: null and empty html give an empty text; a page without main text gives an empty text;
markup that isn't closed is closed by what follows or the page's end; long pages are read whole; repeated
rows give repeated results; other columns aren't read.
"""

from __future__ import annotations

import html as _html
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, map_arrow, table

#: Pages that the model is fitted on, and passes over them.
TRAIN_PAGES, TRAIN_STEPS, SEED = 800, 160, 7

TOKEN = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.DOTALL)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
#: Elements that hold text up to their end tag only; elements whose content is no text of the page if their end tag closes them; void elements; elements that don't end a block.
RAW = frozenset("script style noscript textarea title iframe".split())
APART = frozenset("template svg select datalist option button object audio video canvas".split())
APART_TAG = re.compile(rf"<(?:{'|'.join(sorted(APART))})[\s/>]", re.IGNORECASE)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MATH = "math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover munderover mspace semantics"
INLINE = frozenset(f"{MATH} a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table article section div aside nav main header footer form body".split())


def class_words(attributes: str) -> tuple[str, ...]:
    if "=" not in attributes:
        return ()
    found = []
    for _, a, b, c in ATTRIBUTE.findall(attributes):
        found += [w.lower() for w in WORD.findall(a or b or c)]
    return tuple(found)


def raw_end(page: str, tag: str, attributes: str, at: int) -> int:
    """Where the text of an element of RAW ends, whose tag ends at `at`."""
    if tag == "title" and attributes.rstrip().endswith("/"):
        return at
    end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.IGNORECASE).search(page, at)
    return end.end() if end else len(page)


class Nest:
    """Open elements from the outermost in, and where those of each tag, those that end a block, and those of SCOPE are."""

    def __init__(self) -> None:
        self.items: list = []
        self.tags: list[str] = []
        self.where: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.scopes: list[int] = []

    def push(self, tag: str, item) -> None:
        at = len(self.tags)
        self.tags.append(tag)
        self.items.append(item)
        self.where.setdefault(tag, []).append(at)
        if tag not in INLINE:
            self.blocks.append(at)
        if tag in SCOPE:
            self.scopes.append(at)

    def cut(self, at: int) -> None:
        """Close everything from there in."""
        while len(self.tags) > at:
            self.where[self.tags.pop()].pop()
            self.items.pop()
        for marks in (self.blocks, self.scopes):
            while marks and marks[-1] >= at:
                marks.pop()

    def innermost(self, *tags: str) -> int:
        return max((self.where[t][-1] for t in tags if self.where.get(t)), default=-1)

    def ended_by(self, tag: str) -> int:
        """The element that an end tag closes, -1 for none: that of an inline element only if no block has begun since."""
        at = self.innermost(tag)
        return -1 if tag in INLINE and self.blocks and self.blocks[-1] > at else at

    def in_scope(self, *tags: str) -> int:
        """The innermost of the tags, -1 if there is none or one of SCOPE lies inside it."""
        at = self.innermost(*tags)
        return -1 if self.scopes and self.scopes[-1] > at else at


def is_empty(tag: str, attributes: str) -> bool:
    """Self-closed elements of APART: HTML honours the slash in svg only."""
    return tag == "svg" and attributes.rstrip().endswith("/")


def apart(page: str) -> dict[int, int]:
    """End of the start tag to end of the end tag, for the elements of APART that their own end tag closes.

    One that an outer end tag or the page's end closes isn't here, so nothing is lost behind it.
    """
    ends: dict[int, int] = {}
    if not APART_TAG.search(page):
        return ends
    nest, at = Nest(), 0
    while m := TOKEN.search(page, at):
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if not closing:
            if tag in RAW:
                at = raw_end(page, tag, attributes, at)
            elif tag not in VOID and not is_empty(tag, attributes) and (tag in APART or not attributes.endswith("/")):
                nest.push(tag, at)
        elif (i := nest.ended_by(tag)) >= 0:
            if tag in APART:
                ends[nest.items[i]] = at
            nest.cut(i)
    return ends


class Open:
    """An open element: whether it lies in a link, and the features of its chain of block elements, made from its parent's."""

    __slots__ = ("tag", "link", "chain", "article", "leaf", "outer", "known")

    def __init__(self, parent: "Open | None", tag: str, words: tuple[str, ...]) -> None:
        self.tag, self.link, self.known = tag, tag == "a" or (parent is not None and parent.link), None
        if parent is None:
            self.chain, self.article, self.leaf, self.outer = frozenset(), False, "-", "-"
        else:
            self.chain, self.article, self.leaf, self.outer = parent.chain, parent.article, parent.leaf, parent.outer
        if tag and tag not in INLINE:
            new = {f"in={tag}", *(f"class={w}" for w in words)}
            if self.article and tag in ("header", "footer", "section", "aside", "div", "form", "nav"):
                new.add(f"article>{tag}")
            if not new <= self.chain:
                self.chain = self.chain | new
            self.article = self.article or tag in ("article", "main")
            self.leaf, self.outer = tag, self.leaf

    def features(self) -> frozenset:
        if self.known is None:
            more = ("bias", f"leaf={self.leaf}", f"parent={self.outer}", f"article={self.article}&leaf={self.leaf}", *(() if self.article else ("no-article",)))
            self.known = self.chain.union(more)
        return self.known


def blocks_of(page: str | None) -> list[tuple[frozenset, str, int]]:
    """Leaf blocks in page order: features of the ancestors, text, characters inside links."""
    page = page or ""
    ends = apart(page)
    out: list[tuple[frozenset, str, int]] = []
    root = Open(None, "", ())
    nest = Nest()
    parts: list[str] = []
    links, at, n = 0, 0, len(page)
    block = root

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(_html.unescape("".join(parts)).split())
            if text:
                out.append((block.features(), text, min(links, len(text))))
            parts.clear()
        links = 0

    def pop_to(i: int) -> None:
        nonlocal block
        nest.cut(i)
        block = nest.items[-1] if nest.items else root

    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start()] if m else page[at:]
        if text:
            parts.append(text)
            if nest.items and nest.items[-1].link:
                links += len(text)
        if not m:
            break
        at = m.end()
        closing, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if not tag:
            continue
        tag = tag.lower()
        if closing:
            if tag in VOID:
                continue
            if tag in APART:  # its start tag is behind
                parts.append(" ")
                continue
            if tag not in INLINE:
                flush()
            if (i := nest.ended_by(tag)) >= 0:
                pop_to(i)
            continue
        if tag in RAW or tag in APART:
            at = raw_end(page, tag, attributes, at) if tag in RAW else ends.get(at, at)
            parts.append(" ")
            continue
        if tag == "br":
            parts.append(" ")
        if tag not in INLINE:
            flush()
            if tag in CLOSES_P and (i := nest.in_scope("p")) >= 0:
                pop_to(i)
            if tag == "body" and nest.where.get("head"):
                pop_to(nest.where["head"][0])
            while tag in SIBLINGS and (i := nest.in_scope(*SIBLINGS[tag])) >= 0:
                pop_to(i)
        if tag in VOID or attributes.endswith("/"):
            continue
        nest.push(tag, Open(nest.items[-1] if nest.items else root, tag, class_words(attributes) if tag not in INLINE else ()))
        if tag not in INLINE:
            block = nest.items[-1]
    flush()
    return out


def path_features(path: frozenset) -> list[str]:
    return sorted(path)


def text_features(text: str, links: int, at: int, n: int) -> list[str]:
    size = len(text)
    words = text.count(" ") + 1
    return [
        f"words={min(6, words.bit_length())}",
        f"links={0 if not links else 1 + int(2.99 * links / size)}",
        f"stop={text[-1] in '.!?…。'}",
        f"commas={min(3, text.count(','))}",
        f"mark={'|' in text or '»' in text}",
        f"copyright={'©' in text or 'rights reserved' in text or text.startswith('Copyright')}",
        f"first={at == 0}",
        f"only={n == 1}",
    ]


class Crf:
    """Two labels, one weight per feature for label 1 against label 0, and transitions."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray) -> None:
        self.weights, self.start, self.step = weights, start.tolist(), step.tolist()
        self.paths: dict[frozenset, float] = {}

    def score(self, features) -> float:
        return sum(self.weights.get(f, 0.0) for f in features)

    def label(self, blocks: list[tuple[frozenset, str, int]]) -> list[int]:
        """Viterbi: the likeliest labels of all blocks of a page together (ties: label 0)."""
        n, back = len(blocks), []
        if not n:
            return []
        (s00, s01), (s10, s11) = self.step
        a, b = self.start
        for i, (path, text, links) in enumerate(blocks):
            known = self.paths.get(path)
            if known is None:
                if len(self.paths) > 50_000:
                    self.paths.clear()
                known = self.paths[path] = self.score(path_features(path))
            e = known + self.score(text_features(text, links, i, n))
            if i:
                x0, y0, x1, y1 = a + s00, b + s10, a + s01, b + s11
                back.append((int(y0 > x0), int(y1 > x1)))
                a, b = max(x0, y0), max(x1, y1)
            b += e
        out = [int(b > a)]
        for choice in reversed(back):
            out.append(choice[out[-1]])
        return out[::-1]


def fit(pages: list[tuple[list, list[int]]], steps: int = TRAIN_STEPS, rate: float = 0.3, decay: float = 1e-3) -> Crf:
    """Maximum likelihood with a quadratic penalty; forward-backward over all pages at once."""
    pages = [p for p in pages if p[0]]
    names: dict[str, int] = {}
    rows, cols = [], []
    size, longest = len(pages), max(len(b) for b, _ in pages)
    y = np.zeros((size, longest), int)
    live = np.zeros((size, longest), bool)
    for p, (blocks, labels) in enumerate(pages):
        y[p, : len(labels)], live[p, : len(labels)] = labels, True
        for t, (path, text, links) in enumerate(blocks):
            for f in [*path_features(path), *text_features(text, links, t, len(blocks))]:
                rows.append(p * longest + t)
                cols.append(names.setdefault(f, len(names)))
    rows, cols = np.array(rows), np.array(cols)
    w, start, step = np.zeros(len(names)), np.zeros(2), np.zeros((2, 2))
    seen = [np.full(len(names), 1e-6), np.full(2, 1e-6), np.full((2, 2), 1e-6)]
    gold_step = np.zeros((2, 2))
    both = live[:, 1:] & live[:, :-1]
    np.add.at(gold_step, (y[:, :-1][both], y[:, 1:][both]), 1)
    gold_start = np.bincount(y[:, 0], minlength=2)
    for _ in range(steps):
        e = np.bincount(rows, w[cols], size * longest).reshape(size, longest)
        emit = np.stack([np.zeros_like(e), e], -1)
        fwd, bwd = np.zeros((size, longest, 2)), np.zeros((size, longest, 2))
        fwd[:, 0] = start + emit[:, 0]
        for t in range(1, longest):
            nxt = np.logaddexp(fwd[:, t - 1, 0, None] + step[0], fwd[:, t - 1, 1, None] + step[1]) + emit[:, t]
            fwd[:, t] = np.where(live[:, t, None], nxt, fwd[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = emit[:, t + 1] + bwd[:, t + 1]
            nxt = np.stack([np.logaddexp(step[k, 0] + after[:, 0], step[k, 1] + after[:, 1]) for k in (0, 1)], -1)
            bwd[:, t] = np.where(live[:, t + 1, None], nxt, 0)
        z = np.logaddexp(fwd[:, -1, 0], fwd[:, -1, 1])
        prob = np.where(live[..., None], np.exp(fwd + bwd - z[:, None, None]), 0)
        g = (live & (y == 1)) - prob[..., 1]
        gw = np.bincount(cols, g.reshape(-1)[rows], len(names)) - decay * size * w
        gs = gold_start - prob[:, 0].sum(0)
        gt = gold_step.copy()
        for i in (0, 1):
            for j in (0, 1):
                joint = fwd[:, :-1, i] + step[i, j] + emit[:, 1:, j] + bwd[:, 1:, j] - z[:, None]
                gt[i, j] -= np.exp(np.where(both, joint, -np.inf)).sum()
        for value, grad, acc in ((w, gw, seen[0]), (start, gs, seen[1]), (step, gt, seen[2])):
            acc += grad**2
            value += rate * grad / np.sqrt(acc)
    return Crf({f: float(w[i]) for f, i in names.items()}, start, step)


def training_pages(n: int = TRAIN_PAGES, seed: int = SEED) -> list[tuple[str, list[tuple[str, int]]]]:
    """Generated pages: html, and the text and label (1: main text) of every block in order."""
    rng = random.Random(seed)
    syllables = "ra to mi se lu ka ne po vi do an er is on ta le qu be fo gri sta ment tion ing".split()

    def word() -> str:
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    def sentence(lo: int = 4, hi: int = 18) -> str:
        words = [word() for _ in range(rng.randint(lo, hi))]
        if len(words) > 6 and rng.random() < 0.5:
            words[3] += ","
        return " ".join(words).capitalize() + rng.choice("...!?")

    pages = []
    for _ in range(n):
        truth: list[tuple[str, int]] = []

        def put(tag: str, text: str, label: int, inner: str | None = None) -> str:
            truth.append((" ".join(text.split()), label))
            end = f"</{tag}>" if tag not in ("p", "li") or rng.random() < 0.85 else ""
            return f"<{tag}>{inner or text}{end}"

        def linked(n_items: int) -> str:
            items = []
            for _ in range(n_items):
                t = " ".join(word() for _ in range(rng.randint(1, 3)))
                items.append(put("li", t, 0, f'<a href="/{word()}">{t}</a>'))
            return "<ul>" + "".join(items) + "</ul>"

        def junk(kind: str) -> str:
            if kind in ("nav", "menu", "breadcrumb", "tags", "share", "social", "pagination") and rng.random() < 0.3:  # links in a row
                names = [" ".join(word().capitalize() for _ in range(rng.randint(1, 2))) for _ in range(rng.randint(1, 6))]
                body = " ".join(f'<a href="/{word()}">{t}</a>' for t in names)
                truth.append((" ".join(names), 0))
            elif kind in ("nav", "menu", "breadcrumb", "related", "tags", "share", "social", "pagination") or kind in ("sidebar", "aside") and rng.random() < 0.6:
                body = put(rng.choice(["h2", "h3", "h4"]), " ".join(word() for _ in range(rng.randint(1, 3))).capitalize(), 0) if kind in ("related", "sidebar", "aside") and rng.random() < 0.7 else ""
                body += linked(rng.randint(1, 8))
            elif kind in ("comment", "reply") and rng.random() < 0.7:  # a single one
                body = put("p", " ".join(sentence(2, 16) for _ in range(rng.randint(1, 3))), 0)
            elif kind in ("comments", "comment", "reader", "replies", "reply"):
                body = put(rng.choice(["h2", "h3"]), word().capitalize(), 0) if rng.random() < 0.5 else ""
                body += "".join(f'<div class="{rng.choice(["comment", "reply", "comment-body"])}">' + put("p", sentence(3, 25), 0) + "</div>" for _ in range(rng.randint(1, 4)))
            elif kind in ("form", "newsletter", "subscribe", "search", "login"):
                body = "<form>" + put("p", sentence(2, 8), 0) + '<input type="text"><button>Go</button></form>'
            elif kind in ("footer", "copyright") and rng.random() < 0.8:
                body = rng.choice([f"© {word()}.example · {sentence(3, 14)}", f"© {rng.randint(1990, 2030)} {word().capitalize()}. All rights reserved.", f"Copyright {word()} | {sentence(2, 6)}"])
                if rng.random() < 0.4:
                    body = put("p", body, 0)
                else:
                    truth.append((body, 0))
            elif rng.random() < 0.5:  # text straight in the container
                body = sentence(3, 14)
                truth.append((body, 0))
            else:
                body = "".join(put(rng.choice(["p", "div", "p"]), sentence(2, 14), 0) for _ in range(rng.randint(1, 3)))
            return body

        def wrap(kind: str) -> str:
            if kind in ("nav", "menu", "breadcrumb", "related", "pagination", "login", "copyright") and rng.random() < 0.15:  # names that say nothing
                tag = rng.choice(["div", "td", "section"])
                return f'<{tag} class="{word()}">{junk(kind)}</{tag}>'
            semantic = {"nav": "nav", "menu": "nav", "header": "header", "footer": "footer", "sidebar": "aside", "aside": "aside", "form": "form"}
            if kind in semantic and rng.random() < 0.6:
                tag, extra = semantic[kind], ""
            else:
                tag, extra = rng.choice(["div", "section", "div"]), f' {rng.choice(["class", "id"])}="{kind}{rng.choice(["", "", "-box", "-list", " box"])}"'
            body = junk(kind)
            return f"<{tag}{extra}>{body}</{tag}>"

        def article() -> str:
            out = []
            if rng.random() < 0.8:
                title = sentence(3, 9).rstrip(".")
                heading = put(rng.choice(["h1", "h1", "h2"]), title, 1)
                out.append(f"<header>{heading}</header>" if rng.random() < 0.2 else heading)
            for _ in range(rng.randint(1, 12)):
                kind = rng.random()
                if kind < 0.66:
                    t = " ".join(sentence(1, 20) for _ in range(rng.randint(1, 5)))
                    if rng.random() < 0.15:
                        out.append(put("p", t, 1, f"<b>{t}<br>"))
                    elif rng.random() < 0.15:
                        first, _, rest = t.partition(" ")
                        out.append(put("p", t, 1, f'<a href="/{word()}">{first}</a> {rest}'))
                    else:
                        out.append(put("p", t, 1))
                elif kind < 0.72:
                    out.append(put(rng.choice(["h2", "h3", "h4"]), sentence(2, 6).rstrip("."), 1))
                elif kind < 0.78:
                    out.append("<ul>" + "".join(put("li", sentence(2, 10), 1) for _ in range(rng.randint(2, 4))) + "</ul>")
                elif kind < 0.82:
                    out.append("<blockquote>" + put("p", sentence(), 1) + "</blockquote>")
                elif kind < 0.85:
                    out.append(put("pre", word() + " = " + word(), 1))
                elif kind < 0.87:
                    out.append("<table><tr>" + put("td", word(), 1) + put("td", sentence(1, 4), 1) + "</tr></table>")
                elif kind < 0.97:
                    out.append(wrap(rng.choice(["ad", "advert", "promo", "related", "share", "newsletter", "sponsored", "comments", "comment", "comment", "comment", "comment", "reply", "notice"])))
                else:
                    out.append("<figure>" + put("figcaption", sentence(2, 8), 1) + "</figure>")
            if rng.random() < 0.2:
                out.append(wrap(rng.choice(["comments", "share", "related", "tags"])))
            return "".join(out)

        outer = rng.choice(['<article>{}</article>', '<main>{}</main>', '<main><article>{}</article></main>', '<div class="content">{}</div>', '<div id="content"><article>{}</article></div>', '<div class="post">{}</div>', '<div class="entry-content">{}</div>', '<div class="article-body">{}</div>', '<section class="story">{}</section>', '<article>{}</article>'])
        if rng.random() < 0.5:  # frames that say nothing
            outer = rng.choice(["{}", "{}", "<div>{}</div>", '<div class="' + word() + '">{}</div>', '<div class="' + word() + '"><div class="' + word() + "-" + str(rng.randint(1, 12)) + '">{}</div></div>', '<div id="' + word() + '"><section>{}</section></div>', '<table><tr><td class="' + word() + '">{}</td></tr></table>'])
        before = [k for k in ("header", "nav", "menu", "breadcrumb", "ad", "banner", "notice", "cookie", "consent", "search", "login") if rng.random() < 0.3]
        after = [k for k in ("sidebar", "aside", "related", "comments", "form", "newsletter", "share", "social", "advert", "pagination", "promo", "footer", "copyright", "disclaimer") if rng.random() < 0.3]
        if rng.random() < 0.7 and "footer" not in after:
            after.append("footer")
        pieces = [f"<!DOCTYPE html><html><head><title>{word()}</title><style>p{{margin:0}}</style><script>var a='</p>';</script></head><body>"]
        pieces += [wrap(k) for k in before]
        if rng.random() < 0.06:  # nothing but words
            words = " ".join(sentence(2, 20) for _ in range(rng.randint(1, 4)))
            truth.append((words, 1))
            pieces, outer, after = pieces[:1], "", []
            truth[:] = truth[-1:]
            pieces.append(words)
        if outer:
            pieces.append(outer.format(article()))
        pieces += [wrap(k) for k in after]
        pieces.append("</body></html>" if rng.random() < 0.9 else "")
        pages.append(("".join(pieces), truth))
    return pages


def labelled(pages: list[tuple[str, list[tuple[str, int]]]]) -> list[tuple[list, list[int]]]:
    """Blocks with labels, for pages whose blocks come out as they were written."""
    out = []
    for page, truth in pages:
        blocks = blocks_of(page)
        if [b[1] for b in blocks] == [t for t, _ in truth]:
            out.append((blocks, [label for _, label in truth]))
    return out


_MODEL: dict[tuple, Crf] = {}


def model(n: int = TRAIN_PAGES, seed: int = SEED) -> Crf:
    if (n, seed) not in _MODEL:
        _MODEL[n, seed] = fit(labelled(training_pages(n, seed)))
    return _MODEL[n, seed]


def main_text(page: str | None, crf: Crf) -> str:
    blocks = blocks_of(page)
    return "\n".join(b[1] for b, keep in zip(blocks, crf.label(blocks)) if keep)


def extract(spark: SparkSession, pages: DataFrame, crf: Crf | None = None) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(crf or model())

    def run(batch: dict) -> dict:
        texts = [main_text(h, shared.value) for h in batch["html"].to_pylist()]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": list(map(len, texts))}

    src = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), "html")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    return map_arrow(src, run, "page_id long, url string, text string, n_chars long", schema)


def op10_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return extract(spark, table(spark, sf_dir, "pages"))
