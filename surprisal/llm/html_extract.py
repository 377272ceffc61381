"""Main text of web pages by a recurrent block labeller.

A page becomes a sequence of leaf blocks: stretches of text between block-level tags, each with the
path of open block elements above it. A bidirectional LSTM, in numpy, reads one vector per leaf (hashed
tag path with class and id words, hashed words of the whole text, and a few counts, such as the share
of the page's text in the elements around it) and labels each block as article or not, from the whole
document's context. Its weights (html_weights.npz) come from train_html.

Elements know their parent and the sum of their path's vectors, so that a page costs time and memory in
proportion to its length, however deep its elements lie.

Text of scripts, styles, heads, forms' controls and comments of the markup never becomes a block.
White space inside a block, `<br>` included, becomes one space; character references are decoded.

Defined results: a null or empty page has the empty text; pages of any length are labelled whole; the
blocks' order is the page's; repeated rows each get their result.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from surprisal.llm.common import map_batches, prepare

PATH_SIZE, WORD_SIZE, COUNTS, UNITS = 96, 48, 12, 24
INPUT = PATH_SIZE + WORD_SIZE + COUNTS
#: Elements whose content is no text of the page: those whose content is no markup either, so that an open
#: one reaches to the end of the page, and others. Then those that start a block of their own, those that
#: never close, and those that end an open element of the same kind (fixed values of HTML).
RAW = {"script", "style", "textarea", "title"}
HIDDEN = {"noscript", "template", "iframe", "svg", "select", "button", "object", "canvas", "audio", "video", "annotation", "annotation-xml"}
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SAME = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CONTAINERS = set("ul ol table dl div article section td body blockquote".split())
ENDS_P = BLOCK - {"html", "body", "head", "p"}
_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_ANY = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
_LOOSE = re.compile(r"(/?)([a-zA-Z][^\s/>]*)([^>]*+)>")
_NAMES = re.compile(r"(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_TOKEN = re.compile(r"\w+")


class Node:
    """An open element: its parent, the hashed words of its path, and the text in blocks just below it."""

    __slots__ = ("depth", "fresh", "mass", "parent", "tag", "vector", "whole")

    def __init__(self, parent: Node | None, tag: str, fresh: list[str]) -> None:
        self.parent, self.tag, self.fresh, self.mass, self.whole = parent, tag, fresh, 0, None
        self.depth = parent.depth + len(fresh) if parent else 0
        self.vector = parent.vector.copy() if parent else np.zeros(PATH_SIZE, np.float32)
        for word in fresh:
            if word not in ("html", "body"):
                i, sign = place(word, PATH_SIZE)
                self.vector[i] += sign

    def path_vector(self) -> np.ndarray:
        """The words of the path, its last tag and its last three."""
        if self.whole is None:
            self.whole = self.vector.copy()
            up = self.parent or self
            for word in (f"last {self.tag}", f"three {(up.parent or up).tag} {up.tag} {self.tag}"):
                i, sign = place(word, PATH_SIZE)
                self.whole[i] += sign
        return self.whole

    def path(self) -> tuple[str, ...]:
        """The tags from the page's root on, each with its names behind it where they are new on the path."""
        out, node = [], self
        while node.parent:
            out += [w for w in reversed(node.fresh) if "." in w] + [node.tag]
            node = node.parent
        return tuple(reversed(out))


class Leaf:
    """A block: its text, the innermost open element, and how much of it is links."""

    __slots__ = ("linked", "node", "text")

    def __init__(self, node: Node, text: str, linked: float) -> None:
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> tuple[str, ...]:
        return self.node.path()


@lru_cache(200_000)
def place(word: str, size: int) -> tuple[int, float]:
    """Where a word falls in a hashed vector, and its sign."""
    h = xxhash.xxh64_intdigest(word, 9)
    return (h >> 1) % size, 1.0 if h & 1 else -1.0


def hidden_end(page: str, at: int, name: str) -> int:
    """Where a HIDDEN element opened before at ends: behind its end tag, or, if it is not closed before another
    of its name opens or the block around it ends, at the first block's tag."""
    first, inside = None, []
    for m in _ANY.finditer(page, at):
        tag = m[2].lower()
        if tag == name:
            if m[1]:
                gt = page.find(">", m.end())
                return len(page) if gt < 0 else gt + 1
            return m.start() if first is None else first
        if tag in BLOCK:
            first = m.start() if first is None else first
            if not m[1]:
                if tag not in VOID:
                    inside.append(tag)
            elif tag in inside:
                while inside.pop() != tag:
                    pass
            else:
                return first
    return at if first is None else first


def leaves(page: str) -> list[Leaf]:
    """The page's blocks in order; blocks without text are left out."""
    out: list[Leaf] = []
    root = Node(None, "", [])
    stack: list[Node] = []
    tags, words = Counter(), Counter()
    parts: list[str] = []
    link_depth, link_chars, chars = 0, 0, 0
    n, at, lower = len(page), 0, None

    def flush() -> None:
        nonlocal link_chars, chars
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text and not tags["head"]:
                node = stack[-1] if stack else root
                out.append(Leaf(node, text, link_chars / max(chars, 1)))
                for _ in range(2):
                    node = node.parent or node
                    node.mass += len(text)
            parts.clear()
        link_chars = chars = 0

    def opens(name: str, rest: str) -> None:
        said = () if not rest else tuple(w for x in _NAMES.finditer(rest) for w in _WORD.findall((x[1] or x[2] or x[3] or "").lower()))
        fresh = [w for w in dict.fromkeys([name, *(f"{name}.{w}" for w in said), *said]) if not words[w]]
        words.update(fresh)
        tags[name] += 1
        stack.append(Node(stack[-1] if stack else root, name, fresh))

    def closes(down_to: int) -> None:
        while len(stack) > down_to:
            node = stack.pop()
            tags[node.tag] -= 1
            words.subtract(node.fresh)

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            piece = page[at:lt]
            parts.append(piece)
            chars += len(piece)
            link_chars += len(piece) * (link_depth > 0)
        if lt >= n:
            break
        nxt = page[lt + 1 : lt + 2]
        if nxt == "!" or nxt == "?":
            close = "-->" if page.startswith("<!--", lt) else ">"
            end = page.find(close, lt + 2)
            at = n if end < 0 else end + len(close)
            continue
        m = _TAG.match(page, lt + 1) or _LOOSE.match(page, lt + 1)
        if not m:
            parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        name = m[2].lower()
        if name in RAW:
            if not m[1] and not m[3].endswith("/"):
                if lower is None:
                    lower = page.lower() if len(page.lower()) == n else page
                end = lower.find(f"</{name}", at)
                if end < 0:
                    at = n
                else:
                    gt = page.find(">", end)
                    at = n if gt < 0 else gt + 1
            parts.append(" " if name not in BLOCK else "")
            continue
        if name in HIDDEN:
            if not m[1] and not m[3].endswith("/"):
                at = hidden_end(page, at, name)
            parts.append(" ")
            continue
        if name == "br":
            parts.append(" ")
        elif name == "a":
            link_depth = max(0, link_depth + (-1 if m[1] else 1))
        elif name in BLOCK:
            flush()
            if m[1]:
                if tags[name]:
                    closes(next(k for k in range(len(stack) - 1, -1, -1) if stack[k].tag == name))
                link_depth = 0
                continue
            ends = SAME.get(name, set()) | ({"p"} if name in ENDS_P else set())
            if name == "body" and tags["head"]:
                closes(next(k for k, s in enumerate(stack) if s.tag == "head"))
            elif name == "html" and stack:
                continue
            # An open element of the same kind ends, unless another container has been opened within.
            for k in range(len(stack) - 1, -1, -1) if any(tags[t] for t in ends) else ():
                if stack[k].tag in ends:
                    closes(k)
                    break
                if stack[k].tag in CONTAINERS:
                    break
            if name not in VOID and not m[3].endswith("/"):
                opens(name, m[3])
    flush()
    return out


def features(page: list[Leaf]) -> np.ndarray:
    """One row per leaf."""
    out = np.zeros((len(page), INPUT), np.float32)
    total = sum(len(leaf.text) for leaf in page)
    for i, leaf in enumerate(page):
        row, words = out[i], _TOKEN.findall(leaf.text.lower())
        row[:PATH_SIZE] = leaf.node.path_vector()
        for w in set(words):
            k, sign = place(w, WORD_SIZE)
            row[PATH_SIZE + k] += sign
        row[PATH_SIZE : PATH_SIZE + WORD_SIZE] *= 1 / max(1.0, len(words)) ** 0.5
        n, node = len(leaf.text), leaf.node
        up = node.parent or node
        over = up.parent or up
        same = [0 <= j < len(page) and (page[j].node.parent or page[j].node) is up for j in (i - 1, i + 1)]
        row[-COUNTS:] = np.log1p(n) / 5, leaf.linked, n < 25, n > 200, i / len(page), leaf.text[-1] in ".!?…", np.log1p(node.depth) / 3, "©" in leaf.text, up.mass / total, over.mass / total, *same
    return out


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def run_lstm(x: np.ndarray, lengths: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: list | None = None) -> np.ndarray:
    """Hidden states of padded sequences (pages, leaves, INPUT), longest first; keep gathers what training needs."""
    n, steps, size = x.shape[0], x.shape[1], u.shape[0]
    z = x @ w + b
    h, c = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    out = np.zeros((n, steps, size), x.dtype)
    for t in range(steps):
        live = int(np.searchsorted(-lengths, -t))  # pages longer than t
        g = z[:live, t] + h[:live] @ u
        i, f, o = sigmoid(g[:, :size]), sigmoid(g[:, size : 2 * size]), sigmoid(g[:, 2 * size : 3 * size])
        a = np.tanh(g[:, 3 * size :])
        before_h, before_c = h[:live].copy(), c[:live].copy()
        c[:live] = f * c[:live] + i * a
        h[:live] = o * np.tanh(c[:live])
        out[:live, t] = h[:live]
        if keep is not None:
            keep.append((live, i, f, o, a, before_h, before_c, c[:live].copy()))
    return out


def reverse(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each sequence backwards, padding still behind."""
    at = np.arange(x.shape[1])[None, :]
    back = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, back[:, :, None], axis=1)


class Labeller:
    """The trained network."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.weights = {k: v.astype(np.float32) for k, v in weights.items()}

    def scores(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """The score of every leaf of each page (none empty): article if above 0."""
        order = sorted(range(len(pages)), key=lambda i: -len(pages[i]))
        out: list[np.ndarray] = [np.zeros(0)] * len(pages)
        w, start = self.weights, 0
        while start < len(order):
            # Pages of like length go together; the padded block stays small.
            longest = len(pages[order[start]])
            group = order[start : start + max(1, min(256, 40_000 // longest))]
            start += len(group)
            lengths = np.array([len(pages[i]) for i in group])
            x = np.zeros((len(group), longest, INPUT), np.float32)
            for k, i in enumerate(group):
                x[k, : lengths[k]] = pages[i]
            forth = run_lstm(x, lengths, w["wf"], w["uf"], w["bf"])
            back = reverse(run_lstm(reverse(x, lengths), lengths, w["wb"], w["ub"], w["bb"]), lengths)
            y = forth @ w["vf"] + back @ w["vb"] + x @ w["vx"] + w["c"]
            for k, i in enumerate(group):
                out[i] = y[k, : lengths[k], 0]
        return out


@lru_cache(1)
def labeller() -> Labeller:
    with np.load(Path(__file__).with_name("html_weights.npz")) as f:
        return Labeller(dict(f))


def extract(pages: list[str | None]) -> list[str]:
    """The main text of each page."""
    found = [leaves(p or "") for p in pages]
    full = [i for i, p in enumerate(found) if p]
    scores = labeller().scores([features(found[i]) for i in full])
    out = [""] * len(pages)
    for i, y in zip(full, scores, strict=True):
        out[i] = "\n\n".join(leaf.text for leaf, s in zip(found[i], y, strict=True) if s > 0)
    return out


def report(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    prepare(pages.sparkSession)

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = extract(batch.column("html").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(made, pa.string()), pa.array([len(x) for x in made], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return map_batches(pages.select("page_id", "url", "html"), "page_id bigint, url string, text string, n_chars bigint", step)
