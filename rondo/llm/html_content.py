"""HTML main-text extraction by a tree-structured graphical model (operator 3).

A page becomes a tree: block-level elements, and below them their text blocks (runs of text and inline markup between two
block boundaries). Every node is content or not. A node's features give its own potential, and each parent and child share
a potential by the child's kind. One sum-product pass up and one down the tree give exact marginals; text blocks whose
marginal exceeds one half are the text. The weights maximise the conditional likelihood of labelled pages: LABELLED
pages from a seeded grammar of page layouts, whose labels are known. That set is bounded and independent of the corpus.

Parsing is lenient: unclosed and crossed tags, raw script and style bodies, quoted angle brackets and comments
are taken as browsers do, near enough, and it takes time in proportion to the page however broken that is. Blocks join by two newlines; white space inside a block becomes one space.

Edge cases: null and empty pages give an empty text; markup without text gives an empty text; a page without any markup is one
block; a tag that never ends is text; repeated rows get equal texts; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import defaultdict
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, lean, sliced

LABELLED, ROUNDS, RATE, DECAY, SEED = 400, 150, 0.5, 1e-3, 5
AT_ONCE = 1 << 20
#: Elements nested deeper hang on the parent of the one at this depth, as in browsers.
DEEPEST = 512

# Element names by the role that HTML gives them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style iframe textarea title noembed noframes xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup "
    "time tt u var "
    "math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msup msub msubsup munder mover munderover mstyle mpadded mphantom menclose semantics".split()
)
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre section summary table ul".split()
)
SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("table ul ol dl html body article section div td th".split())
KINDS = {
    "text": (), "article": ("article", "main"), "nav": ("nav", "menu"), "edge": ("header", "footer"), "aside": ("aside",), "form": ("form", "fieldset"),
    "list": ("ul", "ol", "dl"), "item": ("li", "dt", "dd"), "head": ("h1", "h2", "h3", "h4", "h5", "h6"), "par": ("p", "blockquote", "pre", "figcaption"),
    "table": ("table", "thead", "tbody", "tr", "td", "th"), "control": ("button", "select", "svg", "template"), "box": (),
}
KIND_OF = {t: i for i, (_, tags) in enumerate(KINDS.items()) for t in tags}
TEXT, BOX = 0, len(KINDS) - 1
#: Nodes of their own within a running text, which goes on behind them.
CONTROL = frozenset(KINDS["control"])
# Words in class, id and role values, by what they say about an element.
SAYS = {
    "nav": "nav navbar navigation menu breadcrumb breadcrumbs toc pagination pager tabs skip",
    "header": "header masthead topbar banner branding logo site-header",
    "footer": "footer colophon copyright legal bottom contentinfo imprint",
    "side": "sidebar side aside rail widget widgets related recommended trending popular more complementary tags categories",
    "ad": "ad ads advert adverts advertisement sponsor sponsored promo promotion adsense dfp banner-ad",
    "notice": "cookie cookies consent gdpr notice alert modal popup overlay toast warning message notification disclaimer paywall",
    "comment": "comment comments reply replies respond discussion disqus thread reader-comments",
    "form": "form search login signup signin register subscribe subscription newsletter contact",
    "share": "share sharing social follow buttons toolbar actions",
    "meta": "meta byline author date timestamp posted",
    "content": "article content post entry story text body main prose page-content post-body entry-content article-body",
}
SAY_OF = {w: k for k, words in SAYS.items() for w in words.split()}

_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
#: In a tag: its end, or a quoted value. A quote elsewhere is a character like others.
_IN_TAG = re.compile(r""">|=\s*(["'])""")
_MARK = re.compile(r"""\bdata-label\s*=\s*["']?([01])\b""")
_NAMED = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORDS = re.compile(r"[a-z]+(?:-[a-z]+)*")
_HIDDEN = re.compile(r"""\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_END_RAW = {t: re.compile(rf"</{t}\s*>", re.I) for t in RAW}


@dataclass
class Tree:
    """Nodes in page order, parents first. A text node has its block; an element has its tag and what its names say."""

    parent: list[int] = field(default_factory=list)
    kind: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    says: list[tuple] = field(default_factory=list)
    text: list[str | None] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    mark: list[tuple[int, str]] = field(default_factory=list)  # data-label of labelled pages

    def add(self, parent: int, kind: int, tag: str, says: tuple = (), text: str | None = None, linked: int = 0) -> int:
        if parent >= 0 and self.depth[parent] == DEEPEST:
            parent = self.parent[parent]
        depth = self.depth[parent] + 1 if parent >= 0 else 0
        for column, value in zip((self.parent, self.kind, self.tag, self.says, self.text, self.linked, self.depth), (parent, kind, tag, says, text, linked, depth)):
            column.append(value)
        return len(self.parent) - 1


def named(attributes: str) -> tuple[str, ...]:
    """What the class, id and role values of an element say."""
    return _kept(attributes) if len(attributes) <= 200 else _said(attributes)


def _said(attributes: str) -> tuple[str, ...]:
    out = set()
    for m in _NAMED.finditer(attributes):
        for w in _WORDS.findall((m[1] or m[2] or m[3] or "").lower()):
            for x in (w, *w.split("-")):
                if x in SAY_OF:
                    out.add(SAY_OF[x])
    if _HIDDEN.search(attributes):
        out.add("hidden")
    return tuple(sorted(out))


_kept = lru_cache(8192)(_said)


class Tokens:
    """The tokens of a page from left to right: (text before, name or None, whether it closes, attributes).

    Each character is passed a bounded number of times: once a tag was found to have no end with its quotes respected, tags
    end at their next angle bracket; once no bracket is left, the rest is text.
    """

    def __init__(self, page: str):
        self.page, self.at, self.loose = page, 0, False
        self.last = page.rfind(">")

    def skip_raw(self, name: str) -> None:
        """Past the end tag of a raw-text element, or to the end of the page."""
        e = _END_RAW[name].search(self.page, self.at)
        self.at = e.end() if e else len(self.page)

    def _end(self, at: int) -> int:
        """Place of the bracket that ends the tag whose attributes begin at a place, at or before self.last."""
        page, start = self.page, at
        while not self.loose:
            m = _IN_TAG.search(page, at)
            if not m:
                self.loose = True
            elif not m[1]:
                return m.start()
            else:
                at = page.find(m[1], m.end()) + 1
                self.loose = at == 0
        return page.find(">", start)

    def __iter__(self):
        page, begin = self.page, 0
        while (lt := page.find("<", self.at)) >= 0:
            name, closes, attributes = None, False, ""
            if page.startswith("<!--", lt):
                end = page.find("-->", lt + 2)
                end = len(page) if end < 0 else end + 3
            elif lt > self.last:
                break
            elif page[lt + 1 : lt + 2] in ("!", "?"):
                end = page.find(">", lt) + 1
            elif m := _NAME.match(page, lt):
                end = self._end(m.end()) + 1
                name, closes, attributes = m[1].lower(), page[lt + 1] == "/", page[m.end() : end - 1]
            else:
                self.at = lt + 1
                continue
            self.at = end
            yield page[begin:lt], name, closes, attributes
            begin = self.at
        yield page[begin:], None, False, ""


class Builder:
    """The open elements of a page while its tree grows. Inline ones share the node of the block that they are in."""

    def __init__(self):
        self.tree = Tree()
        self.stack: list[tuple[str, int]] = [("#root", self.tree.add(-1, BOX, "#root"))]
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements, by name
        self.blocks = [0]  # places of those that aren't inline
        self.scopes = [0]  # places of those that a paragraph's end doesn't reach over
        self.held: list[str] = []
        self.outer: list[tuple[list[str], int]] = []  # text held, and how much of it is linked, around each open control
        self.linked = 0

    def text(self, text: str) -> None:
        if text:
            self.held.append(text)
            if self.places["a"]:
                self.linked += len(text)

    def flush(self) -> None:
        if self.held:
            block = " ".join(entities.unescape("".join(self.held)).split())
            if block:
                self.tree.add(self.stack[-1][1], TEXT, self.stack[-1][0], (), block, self.linked)
            self.held = []
        self.linked = 0

    def push(self, name: str, node: int) -> None:
        at = len(self.stack)
        self.places[name].append(at)
        if name not in INLINE:
            self.blocks.append(at)
        if name in SCOPE:
            self.scopes.append(at)
        self.stack.append((name, node))

    def close(self, upto: int) -> None:
        """Close all elements from a place on."""
        if self.blocks[-1] >= upto:
            self.flush()
        while len(self.stack) > upto:
            name, at = self.stack[-1][0], len(self.stack) - 1
            if name not in INLINE:
                self.flush()
                self.blocks.pop()
            if name in SCOPE:
                self.scopes.pop()
            self.places[name].pop()
            self.stack.pop()
            if name in CONTROL:  # the text around it goes on
                self.held, self.linked = self.outer.pop()

    def innermost(self, names) -> int:
        """Place of the innermost open element with one of these names; 0 if there is none."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)

    def open(self, name: str, attributes: str) -> int | None:
        """Open an element; the number of its node if it has one."""
        if name in INLINE:
            self.push(name, self.stack[-1][1])
            return None
        if name in CLOSES_P:
            if self.outer:  # a control that was not closed ends where a block begins
                self.close(min(self.places[x][0] for x in CONTROL if self.places.get(x)))
            p = self.innermost(("p",))
            if p > self.scopes[-1]:
                self.close(p)
        if name in SAME:
            other = self.innermost(SAME[name])
            if other > self.innermost(("ul", "ol", "dl", "table")):
                self.close(other)
        if name in CONTROL:
            if attributes.rstrip().endswith("/"):
                return None
            self.outer.append((self.held, self.linked))
            self.held, self.linked = [], 0
        else:
            self.flush()
        node = self.tree.add(self.stack[-1][1], KIND_OF.get(name, BOX), name, named(attributes) if attributes.strip() else ())
        self.push(name, node)
        return node


def parse(page: str | None, marks: bool = True) -> Tree:
    """The tree of a page, in time proportional to its length. With marks, data-label attributes (of labelled pages) are kept."""
    grown = Builder()
    tokens = Tokens(page or "")
    for text, name, closes, attributes in tokens:
        grown.text(text)
        if name is None:
            continue
        if closes:
            at = grown.innermost((name,))
            if at > (grown.blocks[-1] if name in INLINE else 0):
                grown.close(at)
        elif name in RAW:
            if name in ("script", "style") or not attributes.endswith("/"):
                tokens.skip_raw(name)
        elif name in VOID:
            if name == "hr":
                grown.flush()
            grown.held.append(" ")
        elif name not in ("html", "head", "body"):
            node = grown.open(name, attributes)
            if marks and node is not None and (m := _MARK.search(attributes)):
                grown.tree.mark.append((node, m[1]))
    grown.close(1)
    grown.flush()
    return grown.tree


# Features: kind, tag, what names say (with kind), and of texts their length, share of links and looks.
FEATURES = ["bias-text", "bias-box", *[f"kind:{k}" for k in KINDS], *[f"says:{s}" for s in (*SAYS, "hidden")], *[f"tag:{t}" for t in sorted(KIND_OF)]]
FEATURES += [*[f"length:{n}" for n in range(8)], *[f"links:{n}" for n in range(4)], "stops", "copyright"]
AT = {f: i for i, f in enumerate(FEATURES)}
KIND_NAMES = list(KINDS)


def features(tree: Tree) -> list[list[int]]:
    out = []
    for kind, tag, says, text, linked in zip(tree.kind, tree.tag, tree.says, tree.text, tree.linked):
        f = [AT["bias-text" if text is not None else "bias-box"]]
        if text is None:
            f.append(AT[f"kind:{KIND_NAMES[kind]}"])
            f += [AT[f"says:{s}"] for s in says]
            if tag in KIND_OF:
                f.append(AT[f"tag:{tag}"])
        else:
            n = len(text)
            f.append(AT[f"length:{min(7, max(0, n.bit_length() - 3))}"])
            f.append(AT[f"links:{min(3, int(4 * min(linked, n) / n))}"])
            if text[-1] in ".!?…":
                f.append(AT["stops"])
            if "©" in text or "all rights reserved" in text.lower()[:200]:
                f.append(AT["copyright"])
        out.append(f)
    return out


class Forest:
    """Trees side by side, with what message passing needs: parents, kinds, levels."""

    def __init__(self, trees: list[Tree]):
        sizes = [len(t.parent) for t in trees]
        base = np.cumsum([0, *sizes])
        self.base = base
        self.parent = np.concatenate([np.where((p := np.array(t.parent)) < 0, -1, p + b) for t, b in zip(trees, base)]) if trees else np.zeros(0, int)
        self.kind = np.concatenate([np.array(t.kind) for t in trees]) if trees else np.zeros(0, int)
        self.kinds = self.kind[np.maximum(self.parent, 0)] * len(KINDS) + self.kind
        depth = np.concatenate([np.array(t.depth) for t in trees]) if trees else np.zeros(0, int)
        order = np.argsort(depth, kind="stable")
        cut = np.searchsorted(depth[order], np.arange(depth.max() + 2 if len(depth) else 1))
        self.levels = [order[a:b] for a, b in zip(cut[:-1], cut[1:])]
        rows = [f for t in trees for f in features(t)]
        self.node = np.repeat(np.arange(len(rows)), [len(f) for f in rows])
        self.feature = np.array([x for f in rows for x in f], int)


@dataclass
class Model:
    unary: np.ndarray  # weight of each feature for content
    pair: np.ndarray  # (kinds of parent and child, parent's label, child's label)


def _lse(a: np.ndarray, axis: int) -> np.ndarray:
    m = a.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(a - m).sum(axis=axis))


def marginals(model: Model, f: Forest) -> tuple[np.ndarray, np.ndarray]:
    """Sum-product up and down all trees: P(label) of each node, P(parent's label, label) of each node with a parent."""
    n = len(f.parent)
    own = np.zeros((n, 2))
    np.add.at(own[:, 1], f.node, model.unary[f.feature])
    pair = model.pair[f.kinds]
    below = own.copy()  # own potential and all messages from children
    up = np.zeros((n, 2))
    for level in f.levels[:0:-1]:
        up[level] = _lse(pair[level] + below[level][:, None, :], 2)
        np.add.at(below, f.parent[level], up[level])
    full = below.copy()
    joint = np.zeros((n, 2, 2))
    for level in f.levels[1:]:
        p = f.parent[level]
        rest = full[p] - up[level]  # the parent without this child
        joint[level] = pair[level] + below[level][:, None, :] + rest[:, :, None]
        full[level] = below[level] + _lse(pair[level] + rest[:, :, None], 1)
    norm = _lse(full, 1)
    p = np.exp(full - norm[:, None])
    j = np.exp(joint - _lse(joint.reshape(n, 4), 1)[:, None, None])
    return p, j


def train(trees: list[Tree], labels: list[np.ndarray], rounds: int = ROUNDS) -> Model:
    """Maximum conditional likelihood with a little decay, by AdaGrad on the exact gradient."""
    f = Forest(trees)
    y = np.concatenate(labels)
    model = Model(np.zeros(len(FEATURES)), np.zeros((len(KINDS) ** 2, 2, 2)))
    child = np.flatnonzero(f.parent >= 0)
    want_u = np.bincount(f.feature, y[f.node], minlength=len(FEATURES))
    want_p = np.zeros_like(model.pair)
    np.add.at(want_p, (f.kinds[child], y[f.parent[child]], y[child]), 1)
    seen_u, seen_p = np.full_like(model.unary, 1e-6), np.full_like(model.pair, 1e-6)
    n = len(trees)
    for _ in range(rounds):
        p, j = marginals(model, f)
        g = (want_u - np.bincount(f.feature, p[f.node, 1], minlength=len(FEATURES))) / n - DECAY * model.unary
        got = np.zeros_like(model.pair)
        np.add.at(got, f.kinds[child], j[child])
        h = (want_p - got) / n - DECAY * model.pair
        seen_u += g * g
        seen_p += h * h
        model.unary += RATE * g / np.sqrt(seen_u)
        model.pair += RATE * h / np.sqrt(seen_p)
    return model


# --- Labelled pages -------------------------------------------------------------------------------------------------


def labelled_pages(n: int = LABELLED, seed: int = SEED) -> list[str]:
    """Pages of many layouts; data-label tells where content begins ("1") and ends ("0")."""
    rng = random.Random(seed)
    letters = "aeioulnrstdmc"

    def words(lo, hi):
        out = ["".join(rng.choices(letters, k=rng.randint(1, 11))) for _ in range(rng.randint(lo, hi))]
        return " ".join(out).capitalize()

    def sentences(k):
        return " ".join(words(2, 18) + rng.choice("...!?") for _ in range(k))

    def links(k):
        return "".join(f'<li><a href="#">{words(1, 3)}</a></li>' for _ in range(k))

    def box(kind: str, inner: str, tags: tuple[str, ...] = ()) -> str:
        """A non-content part, named by its tag, by class or id, or both."""
        names = {
            "nav": ("nav", "menu", "navbar", "breadcrumb", "site-nav", "pagination"), "header": ("header", "masthead", "topbar", "site-header"),
            "footer": ("footer", "site-footer", "copyright", "colophon", "legal"), "side": ("sidebar", "related", "widget", "trending", "aside"),
            "ad": ("ad", "ads", "advert", "sponsored", "promo", "ad-box"), "notice": ("cookie-notice", "notice", "consent", "alert", "popup", "disclaimer"),
            "comment": ("comments", "comment", "replies", "discussion", "reader-comments"), "form": ("newsletter", "search", "subscribe", "login-form", "contact"),
            "share": ("share", "social", "toolbar"),
        }[kind]
        tag = rng.choice((*tags, *tags, "div", "section" if rng.random() < 0.3 else "div"))
        name = f' {rng.choice(("class", "class", "id"))}="{rng.choice(names)}"' if tag in ("div", "section", "p", "ul") or rng.random() < 0.5 else ""
        return f'<{tag}{name} data-label="0">{inner}</{tag}>'

    def thread() -> str:
        """Reader comments: boxes, or a list whose items are named or hold paragraphs."""
        style, n = rng.random(), rng.randint(1, 5)
        if style < 0.4:
            return "".join(f'<div class="comment"><b>{words(1, 2)}</b><p>{sentences(rng.randint(1, 4))}</p></div>' for _ in range(n))
        named = rng.choice(("", ' class="comment"', ' class="reply"'))
        item = (lambda: f"<b>{words(1, 2)}</b><p>{sentences(rng.randint(1, 4))}</p>") if style < 0.75 else lambda: sentences(2)
        items = "".join(f"<li{named}>{item()}</li>" for _ in range(n))
        return items if rng.random() < 0.3 else f"<ol>{items}</ol>" if rng.random() < 0.5 else f"<ul>{items}</ul>"

    def clutter(kind: str) -> str:
        para = "".join(f"<p>{sentences(rng.randint(1, 3))}</p>" for _ in range(rng.randint(1, 3)))
        bare = sentences(rng.randint(1, 3)) if rng.random() < 0.6 else para
        return {
            "nav": lambda: box("nav", f"<ul>{links(rng.randint(2, 9))}</ul>" if rng.random() < 0.8 else " | ".join(f"<a>{words(1, 2)}</a>" for _ in range(5)), ("nav",)),
            "header": lambda: box("header", (f"<h1>{words(1, 4)}</h1>" if rng.random() < 0.5 else f"<div>{words(1, 4)}</div>") + (f"<p>{words(2, 8)}</p>" if rng.random() < 0.5 else ""), ("header",)),
            "footer": lambda: box("footer", rng.choice((f"&copy; {words(1, 3)} &middot; {sentences(1)}", f"<p>&copy; 2020 {words(2, 5)}. All rights reserved.</p>", bare, f"<ul>{links(4)}</ul>")), ("footer",)),
            "side": lambda: box("side", rng.choice((f"<h3>{words(1, 3)}</h3><ul>{links(rng.randint(2, 7))}</ul>", f"<h2>{words(1, 3)}</h2>{para}", bare)), ("aside",)),
            "ad": lambda: box("ad", rng.choice((bare, f"<a>{words(2, 8)}</a>", f"<p>{words(2, 9)}</p>")), ()),
            "notice": lambda: box("notice", rng.choice((bare, para + "<button>OK</button>")), ()),
            "comment": lambda: box("comment", f"<h2>{words(1, 2)}</h2>" * rng.randint(0, 1) + thread(), ()),
            "form": lambda: box("form", f"<label>{words(1, 5)}</label><input><p>{sentences(1)}</p><button>{words(1, 2)}</button>", ("form", "form")),
            "share": lambda: box("share", "".join(f"<a>{words(1, 1)}</a> " for _ in range(4)), ()),
        }[kind]()

    def content() -> str:
        parts = [f"<h1>{words(2, 12)}</h1>"] if rng.random() < 0.85 else []
        if parts and rng.random() < 0.1:
            parts = [f"<header>{parts[0]}</header>"]
        for _ in range(rng.randint(1, 12)):
            kind = rng.random()
            if kind < 0.72:
                text = sentences(rng.choice((1, 1, 2, 4, 8, 40))) if rng.random() < 0.85 else words(1, 2) + rng.choice((".", ".", "", "!!", "|"))
                if rng.random() < 0.25:
                    text = f"<b>{text}</b>" if rng.random() < 0.5 else f'{text} <a href="#">{words(1, 4)}</a> {words(1, 6)}.'
                parts.append(f"<p>{text}" + ("</p>" if rng.random() < 0.8 else ""))
            elif kind < 0.8:
                parts.append(f"<h2>{words(1, 7)}</h2>")
            elif kind < 0.86:
                parts.append("<ul>" + "".join(f"<li>{words(2, 14)}</li>" for _ in range(rng.randint(2, 5))) + "</ul>")
            elif kind < 0.89:
                parts.append(f"<blockquote><p>{sentences(2)}</p></blockquote>")
            elif kind < 0.92:
                parts.append("<table>" + "".join(f"<tr><td>{words(1, 3)}</td><td>{words(1, 3)}</td></tr>" for _ in range(3)) + "</table>")
            elif kind < 0.94:
                parts.append(f"<pre>{words(3, 12)}</pre>")
            elif kind < 0.96:
                parts.append(f"<figure><figcaption>{words(3, 12)}</figcaption></figure>")
            else:
                parts.append(clutter(rng.choice(("ad", "share", "form", "side", "notice"))))
        if rng.random() < 0.2:
            parts.append(clutter("comment"))
        return "".join(parts)

    out = []
    for _ in range(n):
        inner = content()
        style = rng.random()
        if style < 0.5:
            main = f'<article data-label="1">{inner}</article>'
        elif style < 0.6:
            main = f'<main data-label="1">{inner}</main>'
        elif style < 0.64:  # nothing around the article at all
            main = re.sub(r"<(h1|h2|p|ul|blockquote|table|pre|figure|header)>", r'<\1 data-label="1">', inner)
        elif style < 0.72:  # nothing tells but the text itself
            main = f'<div data-label="1">{inner}</div>'
        else:
            main = f'<div {rng.choice(("class", "id"))}="{rng.choice(("content", "article", "post", "entry-content", "story", "article-body", "main", "post-body"))}" data-label="1">{inner}</div>'
        if style >= 0.72 and rng.random() < 0.2:  # columns by a table
            beside = f'<td data-label="0">{clutter(rng.choice(("nav", "side")))}</td>'
            cells = re.sub(r"^<div (.*)</div>$", r"<td \1</td>", main, flags=re.S)
            main = f"<table><tr>{beside}{cells}</tr></table>" if rng.random() < 0.5 else f"<table><tr>{cells}{beside}</tr></table>"
        if rng.random() < 0.3:
            main += clutter("comment") * (rng.random() < 0.3)
            main = f"<main>{main}</main>" if rng.random() < 0.5 else f"<div>{main}</div>"
        before = [clutter(k) for k in ("notice", "header", "nav", "ad") if rng.random() < 0.5]
        after = [clutter(k) for k in ("side", "comment", "ad", "form", "share", "footer", "nav") if rng.random() < 0.4]
        if rng.random() < 0.8:
            after.append(clutter("footer"))
        if 0.6 <= style < 0.66:
            before, after = [], after[-1:] * (rng.random() < 0.5)
        body = "".join(before) + main + "".join(after)
        out.append(f"<html><head><title>{words(2, 6)}</title></head><body>{f'<div>{body}</div>' if rng.random() < 0.3 else body}</body></html>")
    return out


def labels(tree: Tree) -> np.ndarray:
    """Label of each node of a labelled page: a text's nearest data-label; an element's by most of the text below it."""
    mark = dict(tree.mark)
    near = [0] * len(tree.parent)
    for i, p in enumerate(tree.parent):
        near[i] = int(mark[i]) if i in mark else near[p] if p >= 0 else 0
    weight = np.zeros((len(near), 2))
    for i in range(len(near) - 1, -1, -1):
        if tree.text[i] is not None:
            weight[i, near[i]] += len(tree.text[i])
        if tree.parent[i] >= 0:
            weight[tree.parent[i]] += weight[i]
    return np.where(weight.sum(axis=1) > 0, weight[:, 1] > weight[:, 0], np.array(near, bool)).astype(int)


@lru_cache(1)
def default_model() -> Model:
    """The model of the labelled pages."""
    trees = [parse(p) for p in labelled_pages()]
    return train(trees, [labels(t) for t in trees])


def extract(model: Model, pages: list[str | None]) -> list[list[tuple[str, float]]]:
    """Text blocks of each page with their content marginals."""
    trees = [parse(p, marks=False) for p in pages]
    f = Forest(trees)
    p, _ = marginals(model, f)
    out = []
    for t, b in zip(trees, f.base.tolist()):
        plain = all(x == "#root" for x in t.tag)  # no element that could tell: all of it is content
        out.append([(x, 1.0 if plain else float(p[b + i, 1])) for i, x in enumerate(t.text) if x is not None])
    return out


def main_texts(pages: DataFrame, model: Model | None = None, html: str = "html", keys: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The key columns, text and n_chars of each page."""
    model = model or default_model()

    @lean
    def run(batches):
        for b in sliced(batches, len(keys)):
            source = b.column(len(keys)).to_pylist()
            texts = []
            for s, e in chunks([len(x or "") for x in source], AT_ONCE):
                texts += ["\n\n".join(x for x, p in blocks if p > 0.5) for blocks in extract(model, source[s:e])]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*keys, "text", "n_chars"])

    kept = pages.select(*keys, pages[html].cast("string").alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[: len(keys)])
    return kept.mapInArrow(run, f"{kinds}, text string, n_chars long")
