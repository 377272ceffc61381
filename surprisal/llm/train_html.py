"""Train the block labeller of html_extract on invented pages: python -m surprisal.llm.train_html

Pages are put together from parts of known kind (articles; menus, headers, footers, sidebars, notices,
adverts, forms, reader comments), in several languages' letters, with markup as loose as pages have it.
Wrappers and kinds are crossed: an article may stand in any container or in none, and every other part
loses its telling tags and classes in PLAIN of all pages, so that what a block says, how long it is and
what stands around it decide, not the name of a tag. The written weights are a few tens of kilobytes.
"""

from __future__ import annotations

import random
import re
import sys
from pathlib import Path

import numpy as np

from surprisal.llm.html_extract import INPUT, UNITS, features, leaves, reverse, run_lstm

MARK = "\x02"
#: The part of pages whose other parts have no telling markup.
PLAIN = 0.4
SYLLABLES = ["the", "an", "er", "ti", "on", "in", "es", "qu", "la", "de", "ein", "sch", "ung", "ñ", "ó", "é", "è", "ou", "ra", "do", "ver", "keit", "eau", "ment", "ing", "st", "ко", "на", "ly", "ble"]
MENU = ["Home", "About", "Contact", "News", "Login", "Shop", "Impressum", "Inicio", "Accueil", "Kontakt", "Archive", "Next", "Previous", "Tags", "RSS", "Search"]
NOTICE = ["We use cookies", "Subscribe to our newsletter", "Accept all", "Sign up now", "Your privacy matters", "Please enable JavaScript", "Advertisement", "Sponsored", "Free shipping today"]
COMMENT = ["Great post!", "I disagree", "Thanks for sharing", "Reply", "Share", "Report", "posted 3 hours ago"]


class Pages:
    """Invented pages; every word of an article carries MARK, which is taken out again with the label."""

    def __init__(self, seed: int) -> None:
        self.r, self.plain = random.Random(seed), 0

    def word(self) -> str:
        return "".join(self.r.choices(SYLLABLES, k=self.r.randint(1, 4)))

    def words(self, low: int, high: int) -> str:
        r = self.r
        out = [self.word() for _ in range(r.randint(low, high))]
        style = r.random()
        if style < 0.08:
            out = [w.upper() + "!!" for w in out]
        elif style < 0.16:
            out = [w + r.choice(["%%%", "&amp;&amp;&amp;", "###", "$$$", "***"]) for w in out]
        elif style < 0.2:
            out = [" | ".join(out)]
        text = " ".join(out)
        return (text[:1].upper() + text[1:]) + r.choice([".", ".", ".", "", "!", "?"])

    def good(self, text: str) -> str:
        return MARK + text

    def article(self) -> str:
        r, out = self.r, []
        long = r.choice([8, 40, 120])
        if r.random() < 0.85:
            out.append(f"<h1>{self.good(self.words(1, 12))}</h1>")
        if r.random() < 0.15:
            out.append(self.worn(self.advert()))
        for _ in range(r.choice([1, 1, 2, 4, 8, 15, 30])):
            kind = r.random()
            inner = self.good(self.words(1, long))
            if r.random() < 0.3:
                inner += "<br>" + self.words(1, 20)
            if r.random() < 0.15:
                inner += f' <a href="/x">{self.words(1, 3)}</a> ' + self.words(1, 20)
            if r.random() < 0.3:
                inner = "<b>" + inner + ("</b>" if r.random() < 0.5 else "")
            if kind < 0.8:
                out.append(f"<p>{inner}" + ("</p>" if r.random() < 0.7 else ""))
            elif kind < 0.85:
                out.append(f"<h{(k := r.randint(2, 4))}>{self.good(self.words(1, 8))}</h{k}>")
            elif kind < 0.9:
                out.append("<ul>" + "".join(f"<li>{self.good(self.words(2, 20))}</li>" for _ in range(r.randint(1, 5))) + "</ul>")
            elif kind < 0.94:
                out.append(f"<blockquote><p>{inner}</p></blockquote>")
            elif kind < 0.97:
                out.append(f"<table><tr><td>{self.good(self.words(1, 4))}</td><td>{self.good(self.words(1, 4))}</td></tr></table>")
            else:
                out.append(f"<pre>{inner}</pre>")
        body = "".join(out)
        if r.random() < 0.08:
            body += self.worn(self.comments())
        kind = r.random()
        if kind < 0.4:
            return f"<article>{body}</article>"
        if kind < 0.5:
            return f"<main>{body}</main>"
        if kind < 0.62:
            return f"<section>{body}</section>"
        if kind < 0.8:
            return f"<div>{body}</div>"
        if kind < 0.84:
            return f"<table><tr><td>{body}</td></tr></table>"
        if kind < 0.88:
            return body
        return f'<div class="{r.choice(["content", "post", "entry-content", "article-body", "story", "main-text", "post-content", self.word()])}">{body}</div>'

    def worn(self, part: str) -> str:
        """A part of the page as it is, or without its telling tags and classes."""
        if not self.plain:
            return part
        bare = re.sub(r"<(/?)(?:nav|header|footer|aside|section|form)\b[^>]*>", r"<\1div>", part)
        bare = re.sub(r'<div (?:class|id)="[^"]*"', lambda _: f'<div class="{self.word()}"' if self.plain == 2 else "<div", bare)
        if self.r.random() < 0.5:
            bare = re.sub(r"<(/?)(?:ul|li)>", r"<\1div>", bare)
        return bare

    def menu(self) -> str:
        r = self.r
        items = [r.choice(MENU) if r.random() < 0.4 else self.word() for _ in range(r.randint(2, 10))]
        inner = "<ul>" + "".join(f'<li><a href="/{i}">{i}</a></li>' for i in items) + "</ul>"
        return r.choice([f"<nav>{inner}</nav>", f'<div class="{r.choice(["menu", "navbar", "nav", "navigation", "breadcrumb"])}">{inner}</div>', f"<nav>{inner}</nav>"])

    def advert(self) -> str:
        text = self.r.choice([self.words(1, 12), self.words(1, 12), self.r.choice(NOTICE)])
        return f'<div class="{self.r.choice(["ad", "ad", "ads", "advert", "banner", "sponsored", "promo"])}">{text}</div>'

    def comments(self) -> str:
        r = self.r
        inner = "".join(f'<{(t := r.choice(["p", "div", "li"]))}>{r.choice([r.choice(COMMENT), self.words(1, 40)])}</{t}>' for _ in range(r.randint(1, 6)))
        return r.choice([f'<section id="comments"><h2>Comments</h2>{inner}</section>', f'<div class="{r.choice(["comments", "comment-list", "discussion", "reader-comments"])}">{inner}</div>'])

    def sidebar(self) -> str:
        r = self.r
        inner = f"<h3>{self.words(1, 4)}</h3>" + "".join(f"<p>{self.words(1, 25)}</p>" for _ in range(r.randint(1, 4)))
        return r.choice([f"<aside>{inner}</aside>", f'<div class="{r.choice(["sidebar", "related", "widget", "side"])}">{inner}</div>'])

    def notice(self) -> str:
        r = self.r
        return f'<div class="{r.choice(["notice", "cookie", "cookie-banner", "popup", "newsletter", "alert"])}">{r.choice([r.choice(NOTICE), self.words(1, 15)])}</div>'

    def form(self) -> str:
        return f'<form action="/s"><label>{self.words(1, 3)}</label><input name="q"><p>{self.words(1, 8)}</p><button>Go</button></form>'

    def header(self) -> str:
        return f"<header>{self.r.choice(['<p>', '<h1>', '<div>', ''])}{self.words(1, 6)}</header>"

    def footer(self) -> str:
        r = self.r
        text = r.choice([f"&copy; {self.word()}.example.org &middot; {self.words(1, 20)}", self.words(1, 25), "Copyright 2020 " + self.word()])
        tail = r.choice(["</footer></body></html>", "</footer>", "</footer></body></html>"])
        return f"<footer>{text}{tail}" if r.random() < 0.75 else f'<div class="footer">{text}</div>'

    def page(self) -> str:
        r = self.r
        before = [self.menu] * (r.random() < 0.8) + [self.advert] * (r.random() < 0.6)
        some = [self.header, self.notice, self.sidebar, self.form, self.advert, self.menu]
        before += r.sample(some, r.choice([0, 0, 1, 2]))
        after = r.sample([self.comments, self.sidebar, self.advert, self.form, self.notice, self.menu], r.choice([0, 0, 0, 1, 2]))
        self.plain = 0 if r.random() > PLAIN else r.choice([1, 1, 2])
        parts = [self.worn(f()) for f in before] + [self.article()] + [self.worn(f()) for f in after]
        if r.random() < 0.85:
            parts.append(self.worn(self.footer()))
        head = f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{self.words(1, 8)}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head><body>'
        return head + "".join(parts)


def examples(seed: int, count: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Feature rows and labels of invented pages."""
    made, out = Pages(seed), []
    while len(out) < count:
        page = leaves(made.page())
        label = np.array([MARK in leaf.text for leaf in page], np.float32)
        for leaf in page:
            leaf.text = leaf.text.replace(MARK, "") or "."
        if len(page):
            out.append((features(page), label))
    return out


def lstm_back(x: np.ndarray, d_out: np.ndarray, kept: list, u: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slopes of the weights of one direction."""
    n, size = x.shape[0], u.shape[0]
    dw, du, db = np.zeros((x.shape[2], 4 * size), x.dtype), np.zeros_like(u), np.zeros(4 * size, x.dtype)
    dh, dc = np.zeros((n, size), x.dtype), np.zeros((n, size), x.dtype)
    for t in range(len(kept) - 1, -1, -1):
        live, i, f, o, a, before_h, before_c, c = kept[t]
        if not live:
            continue
        h_slope = dh[:live] + d_out[:live, t]
        tc = np.tanh(c)
        c_slope = dc[:live] + h_slope * o * (1 - tc * tc)
        g = np.concatenate([c_slope * a * i * (1 - i), c_slope * before_c * f * (1 - f), h_slope * tc * o * (1 - o), c_slope * i * (1 - a * a)], axis=1)
        dw += x[:live, t].T @ g
        du += before_h.T @ g
        db += g.sum(axis=0)
        dh[:live] = g @ u.T
        dc[:live] = c_slope * f
    return dw, du, db


def train(count: int = 4000, rounds: int = 10, size: int = 32, rate: float = 0.004, seed: int = 1) -> dict[str, np.ndarray]:
    """Weights, by Adam on the log loss of every leaf."""
    r = np.random.default_rng(seed)
    data = examples(seed, count)
    draw = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
    w = {"wf": draw(INPUT, 4 * UNITS), "uf": draw(UNITS, 4 * UNITS), "bf": np.zeros(4 * UNITS, np.float32), "wb": draw(INPUT, 4 * UNITS), "ub": draw(UNITS, 4 * UNITS), "bb": np.zeros(4 * UNITS, np.float32), "vf": draw(UNITS, 1), "vb": draw(UNITS, 1), "vx": np.zeros((INPUT, 1), np.float32), "c": np.zeros(1, np.float32)}
    for b in ("bf", "bb"):
        w[b][UNITS : 2 * UNITS] = 1
    mean, square, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    for turn in range(rounds):
        order = sorted(r.permutation(len(data)).tolist(), key=lambda i: -len(data[i][1]) + r.random() * 6)
        batches = [order[i : i + size] for i in range(0, len(order), size)]
        loss = wrong = seen = 0.0
        for k in r.permutation(len(batches)).tolist():
            some = sorted(batches[k], key=lambda i: -len(data[i][1]))
            lengths = np.array([len(data[i][1]) for i in some])
            x, y = np.zeros((len(some), lengths[0], INPUT), np.float32), np.zeros((len(some), lengths[0], 1), np.float32)
            for j, i in enumerate(some):
                x[j, : lengths[j]], y[j, : lengths[j], 0] = data[i]
            real = (np.arange(lengths[0])[None, :] < lengths[:, None])[:, :, None]
            kf, kb, back_x = [], [], reverse(x, lengths)
            forth = run_lstm(x, lengths, w["wf"], w["uf"], w["bf"], kf)
            back = reverse(run_lstm(back_x, lengths, w["wb"], w["ub"], w["bb"], kb), lengths)
            s = forth @ w["vf"] + back @ w["vb"] + x @ w["vx"] + w["c"]
            p = 1 / (1 + np.exp(-np.clip(s, -30, 30)))
            loss -= float((np.log(np.where(y > 0, p, 1 - p) + 1e-9) * real).sum())
            wrong += float((((s > 0) != (y > 0)) & real).sum())
            seen += float(real.sum())
            ds = (p - y) * real / real.sum()
            g = {"vf": np.einsum("nti,ntj->ij", forth, ds), "vb": np.einsum("nti,ntj->ij", back, ds), "vx": np.einsum("nti,ntj->ij", x, ds), "c": ds.sum(axis=(0, 1))}
            g["wf"], g["uf"], g["bf"] = lstm_back(x, ds @ w["vf"].T, kf, w["uf"])
            g["wb"], g["ub"], g["bb"] = lstm_back(back_x, reverse(ds @ w["vb"].T, lengths), kb, w["ub"])
            step += 1
            now = rate * min(1.0, 3 * (1 - (step - 1) / (rounds * len(batches))))
            for name, v in g.items():
                v = v + 1e-5 * w[name]
                mean[name] = 0.9 * mean[name] + 0.1 * v
                square[name] = 0.999 * square[name] + 0.001 * v * v
                w[name] -= (now * (mean[name] / (1 - 0.9**step)) / (np.sqrt(square[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        print(f"round {turn + 1}: loss {loss / seen:.5f}, wrong {wrong:.0f} of {seen:.0f}", file=sys.stderr)
    return w


if __name__ == "__main__":
    np.savez_compressed(Path(__file__).with_name("html_weights.npz"), **{k: v.astype(np.float16) for k, v in train().items()})
