"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks (operator 4).

A page is cut into leaf blocks: the text between block-level tags, with the tags, classes and ids of its ancestors.
Each block is main text or not; a chain over the blocks in page order scores each block by its features and each
neighbouring pair by its labels, and Viterbi finds the best labelling. The field is trained by its likelihood
(forward-backward) on labelled pages: MADE_PAGES made-up pages of many layouts, whose labels are known, and a sample
by hash of at most TRAIN_PAGES pages of the table, whose labels are read off explicit article elements. Bounds of that
sample: pages of TRAIN_CHARS characters and LONGEST blocks at most. They bound what is trained on, nothing else: every
page is cut and decoded whole, and features look at whole blocks.

Character references are decoded, white space inside a block is one space, blocks are joined by one space.

Defined results: null and empty html give the empty text. Tags left open, closing tags without opening ones and pages
that are cut off are read as browsers do in outline: a new block closes an open paragraph, a closing tag closes what
is open inside, a quote that is never closed does not hold its tag open, a tag or comment that the page ends in is no
text, and elements nested deeper than DEEPEST count as siblings. The scanner reads a page once, whatever its markup.
Repeated rows come out repeated; a null page_id or url stays null. Extra columns are not read. Empty tables give
empty tables.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pages of the table and made-up pages that are trained on; gradient steps over the made-up ones and then over all.
TRAIN_PAGES, MADE_PAGES, STEPS, MORE_STEPS = 300, 400, 150, 50
#: Bounds of the table's pages that are trained on: characters and blocks. Every page is decoded, and whole.
TRAIN_CHARS, LONGEST = 20_000, 150
#: Nesting beyond which elements count as siblings, as in browsers.
DEEPEST = 512
#: Elements that begin a block of their own, elements without content, elements that a block stands in,
#: and elements whose content is never text.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
LANDMARKS = frozenset("article aside footer form header main nav section".split())
RAW = frozenset("script style noscript template svg iframe textarea".split())
TAG = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:-]*)|!--|[!?/])")
COMMENT_END, ABRUPT = re.compile("--!?>"), re.compile("-?>")
STOP = re.compile(r""">|=\s*["']""")
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
WORD = re.compile(r"[a-z]+")
SENTENCE = re.compile(r"[.!?…]['\")»]?(?:\s|$)")


class Node:
    """An open element and, by its parent, all its ancestors; new: the features that no ancestor has."""

    __slots__ = ("parent", "tag", "names", "new", "near", "score")

    def __init__(self, parent: Node | None, tag: str, names: str, new: tuple[str, ...]):
        self.parent, self.tag, self.names, self.new, self.score = parent, tag, names, new, None
        # the landmark that a block stands in
        self.near = (tag, names) if names or tag in LANDMARKS else parent.near if parent else None

    def path(self) -> list[Node]:
        """The elements from the outermost to this one."""
        out, node = [], self
        while node:
            out.append(node)
            node = node.parent
        return out[::-1]


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node | None, text: str, linked: float):
        self.node, self.text, self.linked = node, text, linked


def content_end(html: str, name: str, at: int) -> int:
    """Where the content of an element that begins at `at` and its closing tag end; -1 if it is not closed.

    Elements of the same name lie within templates and svg, in other raw content there are no elements.
    """
    depth, nests = 1, name in ("template", "svg")
    for m in re.compile(f"<(/?){name}(?=[\\s/>])", re.I).finditer(html, at):
        end = html.find(">", m.end())
        if end < 0:
            return -1
        if m[1]:
            depth -= 1
        elif nests and not html.endswith("/", m.end(), end):
            depth += 1
        if not depth:
            return end + 1
    return -1


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """start, end, slash, name and attributes of the tags in order; comments, declarations and raw content have no name.

    The page is read once: what was not found from some place on is not looked for again.
    """
    at, size, quotes, open_svg = 0, len(html), True, False
    while (m := TAG.search(html, at)) is not None:
        start, name = m.start(), (m[2] or "").lower()
        if m[0] == "<!--":
            short = ABRUPT.match(html, m.end())
            end = short or COMMENT_END.search(html, m.end())
            at = end.end() if end else size
            yield start, at, "", "", ""
            continue
        end, seen = -1, m.end()
        while name and quotes:
            stop = STOP.search(html, seen)
            if stop is None:
                break
            if stop[0] == ">":
                end = stop.start()
                break
            closed = html.find(stop[0][-1], stop.end())
            if closed < 0:
                break
            seen = closed + 1
        if end < 0:
            quotes = quotes and not name  # the rest of the page closes no tag outside quotes: they no longer count
            end = html.find(">", m.end())
        if end < 0:
            yield start, size, "", "", ""  # the page ends inside a tag
            return
        at = end + 1
        if name in RAW and not m[1]:
            # an icon that closes itself, or that is never closed, holds nothing
            if name != "svg" or not (open_svg or html.endswith("/", m.end(), end)):
                last = content_end(html, name, at)
                open_svg = open_svg or name == "svg" and last < 0
                at = last if last >= 0 else at if name == "svg" else size
            name = ""
        yield start, at, m[1] or "", name, html[m.end() : end]


def blocks(html: str | None) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack: list[Node] = []
    opened: Counter[str] = Counter()
    features: Counter[str] = Counter()
    parts: list[str] = []
    linked = links = at = 0

    def close():
        nonlocal linked
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                out.append(Block(stack[-1] if stack else None, text, linked / max(sum(map(len, parts)), 1)))
            parts.clear()
        linked = 0

    def pop():
        node = stack.pop()
        opened[node.tag] -= 1
        for f in node.new:
            del features[f]

    html = html or ""
    for start, end, slash, name, attributes in tags(html):
        if start > at:
            parts.append(html[at:start])
            if links:
                linked += start - at
        at = end
        if not name:
            continue
        if name not in BLOCKS:
            if name == "a":
                links = 0 if slash else 1
            elif name == "br":
                parts.append(" ")
            continue
        close()
        if slash:
            if opened[name] > 0:
                while stack[-1].tag != name:
                    pop()
                pop()
            links = 0
        elif name not in VOID:
            if stack and (stack[-1].tag == "p" or stack[-1].tag == name and name in ("li", "td", "th", "tr", "dt", "dd", "option")):
                pop()
            if len(stack) >= DEEPEST:
                pop()
            names = " ".join(a or b or c for a, b, c in NAMES.findall(attributes)).lower() if attributes else ""
            here = ["name:" + w for w in WORD.findall(names)]
            if name not in ("html", "body"):
                here.append("tag:" + name)
            new = tuple(f for f in dict.fromkeys(here) if f not in features)
            features.update(new)
            opened[name] += 1
            stack.append(Node(stack[-1] if stack else None, name, names, new))
    if at < len(html):
        parts.append(html[at:])
    close()
    return out


def near_features(node: Node | None) -> list[str]:
    """The nearest tag and the landmark that a block stands in, with its names."""
    out = ["bias", "in:" + (node.tag if node else "-")]
    if node and node.near:
        out.append("at:" + node.near[0])
        out += dict.fromkeys("at-name:" + w for w in WORD.findall(node.near[1]))
    return out


def path_features(node: Node | None) -> list[str]:
    """Features of the ancestors: the nearest ones, all tags, and the words of all names."""
    return near_features(node) + [f for n in (node.path() if node else []) for f in n.new]


def text_features(b: Block, position: float) -> list[str]:
    n = b.text.count(" ") + 1
    out = ["words:%d" % min(n.bit_length(), 7), "linked" if b.linked > 0.5 else "unlinked", "part:%d" % int(position * 5)]
    if SENTENCE.search(b.text):
        out.append("sentence")
    low, size = b.text.lower(), "says:" if n <= 40 else "long-says:"  # a word says less in a long block
    out += [size + w for w in CUES if w in low]
    return out


#: Words that furniture of pages tends to hold.
CUES = ("©", "copyright", "cookie", "subscribe", "newsletter", "sign up", "log in", "login", "share", "advert", "sponsored", "comment", "reply", "related", "privacy", "terms", "menu", "search", "read more", "all rights reserved")


def labelled_page(rnd: random.Random) -> str:
    """A made-up page of a random layout; MAIN marks the beginning of each block of main text."""
    words = ["".join(rnd.choice("bcdfglmnprstv") + rnd.choice("aeiou") for _ in range(rnd.randint(1, 4))) for _ in range(60)]
    say = lambda a, b: " ".join(rnd.choice(words) for _ in range(rnd.randint(a, b)))
    sentence = lambda a, b: say(a, b).capitalize() + rnd.choice([".", ".", ".", "!", "?"])
    prose = lambda: " ".join(sentence(1, 18) for _ in range(rnd.choice([1, 1, 2, 4, 8])))
    one = rnd.choice

    def box(tag, names, inner):
        kind = one(["class", "id"]) if names else ""
        return f'<{tag}{f" {kind}={chr(34)}{one(names)}{chr(34)}" if names else ""}>{inner}</{tag}>'

    def menu():
        items = "".join(f'<li><a href="/{w}">{w.title()}</a></li>' for w in rnd.sample(words, rnd.randint(2, 8)))
        return box(*one([("nav", []), ("div", ["menu", "nav", "navigation", "navbar", "breadcrumbs", "top-menu"]), ("header", ["nav"])]), f"<ul>{items}</ul>")

    ad = lambda: box(*one([("div", ["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-slot", "banner"]), ("aside", ["ad", "promo", "sponsor"])]), one(["", "<p>"]) + one([prose(), "Advertisement " + say(1, 5), sentence(3, 9)]))
    notice = lambda: box(*one([("div", ["cookie", "cookie-banner", "notice", "alert", "consent", "gdpr", "popup", "message"]), ("section", ["notice", "banner"])]), f"<p>{one([sentence(4, 12), 'We use cookies. ' + sentence(3, 8)])}</p>" + one(["", "<button>Accept</button>"]))
    side = lambda: box(*one([("aside", []), ("aside", ["sidebar", "related"]), ("div", ["sidebar", "side", "related", "widget", "rail", "recommended", "trending"])]), f"<h3>{one(['Related', 'Popular', say(1, 3)])}</h3>" + one([f"<p>{prose()}</p>", "<ul>" + "".join(f'<li><a href="#">{say(2, 8)}</a></li>' for _ in range(4)) + "</ul>"]))
    form = lambda: box("form", one([[], ["newsletter", "signup", "search", "subscribe", "contact", "login"]]), f"<label>{say(1, 4)}</label><input name=q>{one(['', f'<p>{sentence(4, 12)}</p>'])}<button>{say(1, 2)}</button>")
    share = lambda: box("div", ["share", "social", "tools", "tags", "meta", "byline"], one([f'<a href="#">{say(1, 2)}</a> <a href="#">Share</a>', say(1, 4)]))
    remark = lambda: box(one(["div", "li", "article"]), ["comment", "reply", "comment-body", "response"], f"<p>{prose()}</p>" + one(["", '<a href="#">Reply</a>']))
    comments = lambda: box(*one([("section", ["comments", "discussion", "responses", "respond"]), ("div", ["comments", "comment-list", "disqus", "reader-comments", "replies"]), ("ol", ["commentlist", "comments"])]), one(["", f"<h2>{rnd.randint(2, 9)} comments</h2>"]) + "".join(remark() for _ in range(rnd.randint(1, 4))))
    header = lambda: box("header", one([[], ["site-header", "masthead", "top"]]), f"<h1>{say(1, 3).title()}</h1>" if rnd.random() < 0.3 else f"<div class=logo>{say(1, 3)}</div><p>{sentence(2, 6)}</p>")
    footer = lambda: box(*one([("footer", []), ("footer", ["site-footer"]), ("div", ["footer", "foot", "bottom", "copyright", "legal"])]), one([f"<p>© {say(1, 4)}. All rights reserved.</p>", f"{say(2, 6)}", f'<a href="#">Privacy</a> | <a href="#">Terms</a> {prose()}']))

    def main_block():
        kind = rnd.random()
        if kind < 0.7:
            return f"<p>{MAIN}{one(['', '', '<b>'])}{prose()}{one(['</p>', '</p>', '', '<br>'])}"
        if kind < 0.8:
            return f"<h{rnd.randint(2, 4)}>{MAIN}{say(1, 7).capitalize()}</h2>"
        if kind < 0.87:
            return "<ul>" + "".join(f"<li>{MAIN}{one([say(1, 6), prose()])}</li>" for _ in range(rnd.randint(1, 4))) + "</ul>"
        if kind < 0.92:
            return f"<blockquote>{MAIN}{prose()}</blockquote>"
        if kind < 0.96:
            return f"<pre>{MAIN}{say(3, 20)}</pre>"
        return f"<table><tr><td>{MAIN}{say(1, 4)}</td><td>{MAIN}{say(1, 4)}</td></tr></table>"

    body = f"<h1>{MAIN}{say(2, 9).capitalize()}</h1>" if rnd.random() < 0.8 else ""
    for _ in range(rnd.choice([0, 1, 3, 6, 12])):
        body += main_block()
        if rnd.random() < 0.12:
            body += one([ad, side, share, form, notice])()
    body += f"<p>{MAIN}{prose()}</p>"
    if rnd.random() < 0.25:
        body += one([share, comments, form])()
    article = box(*one([("article", []), ("article", []), ("article", ["post", "story"]), ("main", []), ("div", ["content", "main", "article", "post-body", "entry-content", "story", "article-body", "text", "page-content"]), ("section", ["content", "article", "body"])]), body)
    if rnd.random() < 0.2:
        article = box(one(["main", "div"]), one([[], ["wrapper", "container", "page"]]), article)
    before = [f() for f in (menu, header, ad, notice, form, side) if rnd.random() < 0.35]
    after = [f() for f in (comments, side, ad, form, notice, menu, footer) if rnd.random() < 0.4]
    rnd.shuffle(before)
    html = f"<!DOCTYPE html><html><head><title>{say(2, 8)}</title><style>p{{}}</style></head><body>{''.join(before)}{article}{''.join(after)}{one(['</body></html>', ''])}"
    return html


MAIN = ""
#: Elements and names inside an article that are not its text.
FURNITURE = frozenset("nav aside footer form button".split())
FURNITURE_NAMES = frozenset("ad ads advert advertisement sponsored promo banner comment comments reply menu nav sidebar related share social cookie notice newsletter".split())


def marked(html: str) -> tuple[list[Block], list[int]]:
    found = blocks(html)
    labels = [int(b.text.startswith(MAIN)) for b in found]
    for b in found:
        b.text = b.text.replace(MAIN, "")
    return found, labels


def read_labels(html: str) -> tuple[list[Block], list[int]] | None:
    """Labels of a page with exactly one article element; None for other pages."""
    found = blocks(html)
    if len(re.findall(r"<article\b", html, re.I)) != 1:
        return None
    labels = []
    for b in found:
        path = b.node.path() if b.node else []
        inside = [n.tag for n in path]
        inner = path[inside.index("article") + 1 :] if "article" in inside else None
        furniture = inner is not None and any(n.tag in FURNITURE or FURNITURE_NAMES & set(WORD.findall(n.names)) for n in inner)
        labels.append(int(inner is not None and not furniture))
    return found, labels


def block_features(found: list[Block]) -> list[list[str]]:
    return [path_features(b.node) + text_features(b, k / len(found)) for k, b in enumerate(found)]


class Field:
    """A trained field: feature weights for main text against other, and the chain's start and step scores."""

    def __init__(self, weights: dict[str, float], start: np.ndarray, step: np.ndarray):
        self.weights, self.start, self.step = weights, start.tolist(), step.tolist()

    def path_score(self, node: Node) -> float:
        """The features that all blocks below an element share; a node keeps its sum."""
        todo = []
        while node is not None and node.score is None:
            todo.append(node)
            node = node.parent
        score = node.score if node is not None else 0.0
        for node in reversed(todo):
            score = node.score = score + sum(self.weights.get(f, 0.0) for f in node.new)
        return score

    def score(self, b: Block, position: float) -> float:
        own = near_features(b.node) + text_features(b, position)
        return (self.path_score(b.node) if b.node else 0.0) + sum(self.weights.get(f, 0.0) for f in own)

    def decode(self, found: list[Block]) -> list[int]:
        """Viterbi over two labels."""
        if not found:
            return []
        (aa, ab), (ba, bb) = self.step
        back = []
        other, main = self.start[0], self.start[1] + self.score(found[0], 0.0)
        for k in range(1, len(found)):
            s = self.score(found[k], k / len(found))
            to_other, to_main = (other + aa, 0) if other + aa >= main + ba else (main + ba, 1), (other + ab, 0) if other + ab > main + bb else (main + bb, 1)
            back.append((to_other[1], to_main[1]))
            other, main = to_other[0], to_main[0] + s
        label = int(main > other)
        out = [label]
        for b in reversed(back):
            label = b[label]
            out.append(label)
        return out[::-1]

    def text(self, html: str | None) -> str:
        found = blocks(html)
        return " ".join(b.text for b, y in zip(found, self.decode(found)) if y)


class Trainer:
    """Maximum likelihood with forward-backward sums over all pages at once, by adaptive gradient steps."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.w, self.start, self.step = np.zeros(1), np.zeros(2), np.zeros((2, 2))
        self.sums = [np.zeros_like(x) for x in (self.w, self.start, self.step)]

    def run(self, pages: list[tuple[list[Block], list[int]]], steps: int, decay: float = 1e-4) -> Trainer:
        pages = sorted((p for p in pages if p[0]), key=lambda p: -len(p[0]))
        if not pages:
            return self
        sequences = [block_features(p[0]) for p in pages]
        for f in sorted({f for s in sequences for b in s for f in b} - self.number.keys()):
            self.number[f] = len(self.number)
        none = len(self.number)
        old = len(self.w) - 1
        self.w, self.sums[0] = (np.concatenate([x[:old], np.zeros(none + 1 - old)]) for x in (self.w, self.sums[0]))
        long, n, width = len(sequences[0]), len(sequences), max(len(b) for s in sequences for b in s)
        # step by step over places; the pages that reach a place are the first so many
        reach = [sum(len(s) > t for s in sequences) for t in range(long)]
        ids = [np.full((k, width), none) for k in reach]
        gold = [np.array([p[1][t] for p in pages[:k]]) for t, k in enumerate(reach)]
        for i, s in enumerate(sequences):
            for t, b in enumerate(s):
                ids[t][i, : len(b)] = [self.number[f] for f in b]
        flat, truth = np.concatenate(ids), np.concatenate(gold)
        bounds = np.cumsum([0, *reach])
        both_gold = np.array([[sum(int(((a[: len(b)] == y) & (b == z)).sum()) for a, b in zip(gold, gold[1:])) for z in (0, 1)] for y in (0, 1)])
        first_gold = np.array([(gold[0] == y).sum() for y in (0, 1)])
        for _ in range(steps):
            main_score = self.w[flat].sum(axis=1)
            emit = [np.stack([np.zeros(b - a), main_score[a:b]], axis=1) for a, b in zip(bounds, bounds[1:])]
            alpha = [self.start + emit[0]]
            for t in range(1, long):
                x = alpha[-1][: reach[t], :, None] + self.step
                alpha.append(np.logaddexp(x[:, 0], x[:, 1]) + emit[t])
            beta = [np.zeros((k, 2)) for k in reach]
            for t in range(long - 2, -1, -1):
                x = self.step + (emit[t + 1] + beta[t + 1])[:, None, :]
                beta[t][: reach[t + 1]] = np.logaddexp(x[..., 0], x[..., 1])
            first = alpha[0] + beta[0]
            total = np.logaddexp(first[:, 0], first[:, 1])
            main = np.concatenate([np.exp(a[:, 1] + b[:, 1] - total[: len(a)]) for a, b in zip(alpha, beta)])
            grads = [np.bincount(flat.ravel(), np.repeat(truth - main, width), none + 1) / n]
            starts = main[: reach[0]].sum()
            grads.append((first_gold - np.array([n - starts, starts])) / n)
            met = np.zeros((2, 2))
            for t in range(long - 1):
                k = reach[t + 1]
                met += np.exp(alpha[t][:k, :, None] + self.step + (emit[t + 1] + beta[t + 1])[:, None, :] - total[:k, None, None]).sum(axis=0)
            grads.append((both_gold - met) / n)
            for x, g, s in zip((self.w, self.start, self.step), grads, self.sums):
                g = g - decay * x
                s += g * g
                x += 0.5 * g / np.sqrt(s + 1e-8)
            self.w[-1] = 0
        return self

    def copy(self) -> Trainer:
        out = Trainer()
        out.number, out.w, out.start, out.step, out.sums = dict(self.number), self.w.copy(), self.start.copy(), self.step.copy(), [s.copy() for s in self.sums]
        return out

    def field(self) -> Field:
        return Field(dict(zip(self.number, self.w[:-1].tolist())), self.start, self.step)


def train(pages: list[tuple[list[Block], list[int]]], steps: int = STEPS) -> Field:
    return Trainer().run(pages, steps).field()


@lru_cache(maxsize=2)
def made_up(made: int) -> tuple[list[tuple[list[Block], list[int]]], Trainer]:
    """The made-up pages and a training on them alone; they are the same for every table."""
    rnd = random.Random(11)
    pages = [marked(labelled_page(rnd)) for _ in range(made)]
    return pages, Trainer().run(pages, STEPS)


def fit(pages: DataFrame, key: str = "page_id", html: str = "html", rows: int = TRAIN_PAGES, made: int = MADE_PAGES) -> Field:
    """A field from made-up pages and at most `rows` pages of the table that have one article element.

    Pages are chosen by a hash of id and html: a share of about twice as many by its range, then the smallest hashes, so
    neither a task nor the driver gets more than that.
    """
    pages = pages.select(F.col(key).alias("id"), F.col(html).cast("string").alias("html"))
    share = min(1.0, 2 * rows / max(pages.count(), 1))
    drawn = pages.withColumn("h", F.xxhash64("id", "html")).where(F.col("h") < int(-(2**63) + share * (2**64 - 1))) if share < 1 else pages.withColumn("h", F.xxhash64("id", "html"))
    fair = drawn.where(F.length("html").between(1, TRAIN_CHARS)).groupBy("h").agg(F.min("html").alias("html")).orderBy("h", "html").limit(rows)
    known, trained = made_up(made)
    told = [x for r in fair.collect() if (x := read_labels(r["html"])) and len(x[0]) <= LONGEST]
    return trained.copy().run(known + told, MORE_STEPS).field() if told else trained.field()


def main_text(pages: DataFrame, field: Field | None = None, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url, text of every page."""
    pages = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), F.col(html).cast("string").alias("html"))
    shared = pages.sparkSession.sparkContext.broadcast(field or fit(pages))  # of the features seen in training

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                b = whole.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([shared.value.text(h) for h in b.column(2).to_pylist()], pa.string())], ["page_id", "url", "text"])

    return pages.mapInArrow(run, "page_id long, url string, text string")
