"""Main text of web pages by a recurrent block labeller.

A page is cut into leaf blocks: runs of text between block-level tags. Each block gets a vector
of hashed tag-path tokens (tags, classes, ids of all open elements, folded into bits as elements
open, however deep), hashed words, numbers of its own (length, link share, punctuation, place) and
of all blocks that stand under the same path (their share of the page's text, their mean length and
punctuation). A bidirectional LSTM in numpy reads the blocks of a page in order, so every block is
classified knowing the whole document; blocks labelled main are kept.

The model is trained here, on the driver, on pages that ``page()`` makes up from many layouts
(semantic tags, classes on plain divs, tables) with known labels; in a third of them the names are
dropped, or replaced by meaningless ones, and in a third the semantic tags are plain divs, so that
the verdict does not hang on names. Seeds are fixed, so each run trains the same model; it is kept
for the life of the process.

Scripts, styles, comments of the markup and similar elements never make blocks. Character
references are decoded, white space in a block becomes one space, blocks are joined by a line
feed. Null html is empty and gives an empty text. Repeated rows each get their text; markup that
is cut off or unbalanced is read as far as it goes, in time that grows with its length. Long pages
are classified in parts that pass the state on, so memory does not grow with them but for their
blocks. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed, small_batches, unpacked

#: Elements that break text into blocks, have no content, or hold no text of the page.
BLOCK = frozenset("address article aside blockquote body br button caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg iframe object math canvas textarea".split())
CLOSES = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
NAME = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
PLAIN = re.compile(r"[^\"'>]*")
NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
PART = re.compile(r"[a-z]+")

PATH, WORD, NUMBERS, HIDDEN = 256, 64, 20, 32
INPUT = PATH + WORD + NUMBERS


@lru_cache(maxsize=1 << 16)
def _slot(token: str, size: int) -> tuple[int, float]:
    h = xxhash.xxh64_intdigest(token.encode("utf-8", "surrogatepass"), 11)
    return h % size, 1.0 if h >> 40 & 1 else -1.0


@lru_cache(maxsize=1 << 14)
def _bits(names: tuple[str, ...]) -> tuple[int, int]:
    """Bits of the tokens by their sign."""
    plus = minus = 0
    for token in names:
        i, sign = _slot(token, PATH)
        if sign > 0:
            plus |= 1 << i
        else:
            minus |= 1 << i
    return plus, minus


class Path:
    """The open elements, outermost first, as a chain: tokens of the innermost, bits of the hashed tokens of all, their number, and a key equal for equal paths."""

    __slots__ = ("depth", "key", "minus", "names", "outer", "plus")

    def __init__(self, outer: Path | None, names: tuple[str, ...]):
        self.outer, self.names = outer, names
        self.plus, self.minus, self.depth, self.key = (outer.plus, outer.minus, outer.depth + 1, hash((outer.key, names))) if outer else (0, 0, 0, 0)
        plus, minus = _bits(names)
        self.plus |= plus
        self.minus |= minus

    def tokens(self) -> list[str]:
        out, at = [], self
        while at:
            out.append(at.names)
            at = at.outer
        return [t for names in reversed(out) for t in names]


Block = tuple[Path, str, int]  # path, text, characters inside links


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, slash, name, attributes) of each piece of markup; what is no element has an empty name.

    Every character is passed once: where a tag is never closed, quotes are no longer heeded.
    """
    at, quotes, closing = 0, True, {}
    last = page.rfind(">")
    while (start := page.find("<", at)) >= 0:
        at = start + 1
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else len(page)
            yield start, at, "", "", ""
        elif start >= last:
            continue
        elif page.startswith(("!", "?"), at):
            at = page.find(">", at) + 1
            yield start, at, "", "", ""
        elif m := NAME.match(page, at):
            k = page.find(">", m.end())
            quoted = quotes and (page.find('"', m.end(), k) >= 0 or page.find("'", m.end(), k) >= 0)
            k = m.end() if quoted else k
            while quoted and quotes:
                k = PLAIN.match(page, k).end()
                if k == len(page):
                    quotes = False
                elif page[k] == ">":
                    break
                else:
                    end = page.find(page[k], k + 1)
                    if end < 0:
                        quotes = False
                    k = end + 1
            if not quotes:
                k = page.find(">", m.end())
            at, name, said = k + 1, m[2].lower(), page[m.end():k]
            if not m[1] and name in SILENT and not said.endswith("/"):
                if name not in closing:
                    closing[name] = re.compile(rf"</{name}\s*>", re.I)
                end = closing[name].search(page, at)
                at = end.end() if end else len(page)
                name = ""
            yield start, at, m[1], name, said


def blocks(page: str | None) -> list[Block]:
    page = page or ""
    out: list[Block] = []
    root = Path(None, ())
    stack: list[tuple[str, Path]] = []
    open_: Counter[str] = Counter()
    text: list[str] = []
    where = root
    linked = at = 0
    worded = False  # whether the text so far is more than white space

    def flush() -> None:
        nonlocal linked, worded
        if text:
            body = " ".join("".join(text).split())
            if body:
                out.append((where, body, linked))
            text.clear()
        linked, worded = 0, False

    def take(raw: str) -> None:
        nonlocal where, linked, worded
        if raw:
            said = entities.unescape(raw) if "&" in raw else raw
            if not said.isspace():
                if not worded:
                    where, worded = stack[-1][1] if stack else root, True
                if open_["a"]:
                    linked += len(said)
            text.append(said)

    def close(name: str, stops: tuple[str, ...] = ()) -> None:
        """Closes the innermost open element of that name and all inside it."""
        if open_[name]:
            if stack[-1][0] == name:
                stack.pop()
                open_[name] -= 1
                return
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    open_.subtract(t for t, _ in stack[k:])
                    del stack[k:]
                    return
                if stack[k][0] in stops:
                    return

    for start, end, slash, name, said in tags(page):
        take(page[at:start])
        at = end
        if not name:
            continue
        if name in BLOCK:
            flush()
        if slash:
            close(name)
        elif name not in VOID:
            for old in CLOSES.get(name, ()):
                close(old, ("ul", "ol", "table", "div", "dl", "article", "section", "td"))
            if not said.rstrip().endswith("/"):
                names = [name]
                for value in NAMES.findall(said) if said else ():
                    names += ["." + p for p in PART.findall(value.lower())]
                stack.append((name, Path(stack[-1][1] if stack else root, tuple(names))))
                open_[name] += 1
    take(page[at:])
    flush()
    return out


class _WordSlots(dict):
    """Memo of the place of a word, twice, and its sign; emptied when it grows past its bound."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 1 << 17:
            self.clear()
        i, sign = _slot(word.lower(), WORD)
        value = self[word] = i << 1 | (sign > 0)
        return value


_WORDS = _WordSlots()


@lru_cache(maxsize=1 << 14)
def _path_vector(plus: int, minus: int, leaf: tuple[str, ...]) -> np.ndarray:
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(PATH // 8, "little"), np.uint8), bitorder="little").astype(np.float32)
    v = bits(plus) - bits(minus)
    for token in leaf:
        i, sign = _slot("leaf " + token, PATH)
        v[i] += sign
    return v


def _numbers(page: list[Block]) -> np.ndarray:
    """Numbers of each block of a whole page, and of the blocks under its path."""
    own = np.zeros((len(page), 8), np.float32)
    group: dict[tuple, int] = {}
    of = np.zeros(len(page), np.int64)
    for k, (path, text, linked) in enumerate(page):
        n, words = len(text), text.count(" ") + 1
        own[k] = n, words, min(1.0, linked / n), text.count(".") + text.count("!") + text.count("?"), text.count(",") + text.count(";"), sum(map(text[:200].count, "0123456789")), text[-1] in ".!?:\"\u201d\u3002", text[:1].isupper()
        of[k] = group.setdefault(path.key, len(group))
    count = np.bincount(of).astype(np.float32)
    mean = lambda x: (np.bincount(of, x) / count)[of]
    n, words, link, stops, commas, digits, ends, upper = own.T
    total, place = n.sum() + 1, np.arange(len(page))
    share = np.bincount(of, n)[of] / total
    best = np.bincount(of, n * (1 - link)).max() + 1
    return np.stack([np.log1p(n) / 5, np.log1p(words) / 4, link, place / len(page), (len(page) - place) / len(page), stops / words, np.array([p.depth for p, _, _ in page]) ** 0.5 / 5, np.ones(len(page)),
                     commas / words, digits / np.minimum(n, 200), ends, upper, share, np.bincount(of, n * (1 - link))[of] / best, np.log1p(count[of]) / 4, np.log1p(mean(n)) / 5, mean(link), mean(ends), mean(stops / words), np.cumsum(n) / total], 1).astype(np.float32)


def features(page: list[Block], lo: int = 0, hi: int | None = None, numbers: np.ndarray | None = None) -> np.ndarray:
    """Vectors of the blocks lo to hi of a page."""
    part = page[lo:hi]
    x = np.zeros((len(part), INPUT), np.float32)
    words = [text.split(" ") for _, text, _ in part]
    for k, (path, _, _) in enumerate(part):
        x[k, :PATH] = _path_vector(path.plus, path.minus, path.names[-2:])
    count = np.fromiter(map(len, words), np.int64, len(part))
    code = np.fromiter(map(_WORDS.__getitem__, chain.from_iterable(words)), np.int64, int(count.sum()))
    sums = np.bincount(np.repeat(np.arange(len(part)) * WORD, count) + (code >> 1), (code & 1) * 2 - 1, len(part) * WORD).reshape(-1, WORD)
    x[:, PATH:PATH + WORD] = sums * (0.3 / np.maximum(count, 1) ** 0.5)[:, None]
    x[:, PATH + WORD:] = (_numbers(page) if numbers is None else numbers)[lo:hi]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Model:
    """Two LSTMs, one for each direction, and a logistic output over both states."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        make = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.p = {f"{name}{d}": make(*shape) for d in "fb" for name, shape in (("W", (INPUT, 4 * HIDDEN)), ("U", (HIDDEN, 4 * HIDDEN)))}
        self.p |= {"bf": np.zeros(4 * HIDDEN, np.float32), "bb": np.zeros(4 * HIDDEN, np.float32), "v": make(2 * HIDDEN), "c": np.zeros(1, np.float32)}
        for d in "fb":
            self.p["b" + d][HIDDEN:2 * HIDDEN] = 1  # remember at first

    def _run(self, z: np.ndarray, mask: np.ndarray, d: str, tape: list | None = None, state: np.ndarray | None = None) -> np.ndarray:
        """States (pages, blocks, HIDDEN) from inputs z; masked steps pass the state on. ``state`` holds h and c before and after."""
        n, t, _ = z.shape
        h, c = state if state is not None else np.zeros((2, n, HIDDEN), np.float32)
        out = np.zeros((n, t, HIDDEN), np.float32)
        for k in range(t) if d == "f" else range(t - 1, -1, -1):
            g = z[:, k] + h @ self.p["U" + d]
            (i, f, o), a = np.split(_sigmoid(g[:, :3 * HIDDEN]), 3, axis=1), np.tanh(g[:, 3 * HIDDEN:])
            m = mask[:, k, None]
            new_c = f * c + i * a
            new_h = o * np.tanh(new_c)
            if tape is not None:
                tape.append((k, i, f, o, a, c, h, new_c, m))
            c, h = np.where(m, new_c, c), np.where(m, new_h, h)
            out[:, k] = h
        if state is not None:
            state[:] = h, c
        return out

    def _inputs(self, x: np.ndarray, d: str) -> np.ndarray:
        return x @ self.p["W" + d] + self.p["b" + d]

    def predict(self, pages: list[list[Block]], cells: int = 1 << 14) -> list[np.ndarray]:
        """Which blocks of each page are main text. Pages run in groups of about ``cells`` steps, padding included; longer ones alone, in parts."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
        while order:
            n = next((n for n, k in enumerate(order) if (n + 1) * len(pages[k]) > cells), len(order))
            mine, order = order[:max(n, 1)], order[max(n, 1):]
            if n == 0:
                out[mine[0]] = self._long(pages[mine[0]], cells)
                continue
            # Inputs of the blocks alone, then set among the padding.
            x, size = np.concatenate([features(pages[k]) for k in mine]), np.array([len(pages[k]) for k in mine])
            mask = np.arange(size.max()) < size[:, None]
            states = []
            for d in "fb":
                z = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
                z[mask] = self._inputs(x, d)
                states.append(self._run(z, mask, d))
            states = np.concatenate(states, axis=2)
            score = states @ self.p["v"] + self.p["c"]
            for row, k in enumerate(mine):
                out[k] = score[row, :len(pages[k])] > 0
        return out

    def _long(self, page: list[Block], cells: int) -> np.ndarray:
        score, numbers = np.full(len(page), self.p["c"][0], np.float32), _numbers(page)
        parts = [(lo, min(lo + cells, len(page))) for lo in range(0, len(page), cells)]
        for side, d in enumerate("fb"):
            state = np.zeros((2, 1, HIDDEN), np.float32)
            for lo, hi in parts if d == "f" else parts[::-1]:
                z = self._inputs(features(page, lo, hi, numbers)[None], d)
                h = self._run(z, np.ones((1, hi - lo), bool), d, state=state)
                score[lo:hi] += h[0] @ self.p["v"][side * HIDDEN:(side + 1) * HIDDEN]
        return score > 0

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        tapes: dict[str, list] = {"f": [], "b": []}
        states = {d: self._run(self._inputs(x, d), mask, d, tapes[d]) for d in "fb"}
        both = np.concatenate([states["f"], states["b"]], axis=2)
        p = _sigmoid(both @ self.p["v"] + self.p["c"])
        count = mask.sum()
        loss = float(-(mask * (y * np.log(p + 1e-7) + (1 - y) * np.log(1 - p + 1e-7))).sum() / count)
        e = (mask * (p - y) / count).astype(np.float32)
        g = {"v": np.einsum("nt,nth->h", e, both), "c": np.array([e.sum()], np.float32)}
        for side, d in enumerate("fb"):
            up = e[:, :, None] * self.p["v"][side * HIDDEN:(side + 1) * HIDDEN]
            dz, dh, dc, du = np.zeros((*x.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(up[:, 0]), np.zeros_like(up[:, 0]), np.zeros_like(self.p["U" + d])
            for k, i, f, o, a, c, h, new_c, m in reversed(tapes[d]):
                dh = dh + up[:, k]
                t = np.tanh(new_c)
                gh, gc = np.where(m, dh, 0), np.where(m, dc, 0)
                gc = gc + gh * o * (1 - t * t)
                gate = np.concatenate([gc * a * i * (1 - i), gc * c * f * (1 - f), gh * t * o * (1 - o), gc * i * (1 - a * a)], axis=1)
                dz[:, k] = gate
                du += h.T @ gate
                dh, dc = np.where(m, gate @ self.p["U" + d].T, dh), np.where(m, gc * f, dc)
            g |= {"U" + d: du, "W" + d: np.einsum("nti,ntj->ij", x, dz, optimize=True), "b" + d: dz.sum(axis=(0, 1))}
        return loss, g


def _padded(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    longest = max(map(len, pages))
    x, mask = np.zeros((len(pages), longest, INPUT), np.float32), np.zeros((len(pages), longest), bool)
    for row, page in enumerate(pages):
        x[row, :len(page)], mask[row, :len(page)] = page, True
    return x, mask


# Made-up pages.

_SYLLABLES = "th er on an re he in ed nd ha at en es of or nt ea ti to it st io le is ou ar as de rt ve ung ich lich que tion ción eau".split()
_STOCK = ("Home", "About us", "Contact", "Subscribe", "Log in", "Share", "Read more", "All rights reserved", "Cookies", "Accept", "Related", "Comments", "Reply", "Next", "Privacy", "Advertisement", "Search")
_NAMES = {
    "menu": ("nav", "nav menu", "div.menu", "div#nav", "ul.nav", "div.navbar", "header nav", "div.top-menu", "div.breadcrumb", "div.pagination", "ul#menu", "div.topbar", "div.navigation"),
    "head": ("header", "div.header", "div#header", "div.masthead", "div.site-title", "div.logo", "header.site-header"),
    "advert": ("div.ad", "div.ads", "aside.ad", "div.advert", "div.advertisement", "div#banner", "div.promo", "div.sponsored", "div.ad-slot", "section.promo"),
    "side": ("aside", "aside.sidebar", "div.sidebar", "div#sidebar", "div.related", "div.widget", "div.share", "aside.related", "div.side", "section.recommended", "div.social"),
    "notice": ("div.notice", "div.cookie", "div.cookie-banner", "div#gdpr", "div.alert", "p.notice", "div.consent", "div.message", "div.warning", "div.popup", "div.banner", "div.newsletter", "div.disclaimer"),
    "form": ("form", "form.search", "div.login form", "form.newsletter", "div.subscribe form", "form#contact"),
    "foot": ("footer", "div.footer", "div#footer", "footer.site-footer", "div.copyright", "div.legal", "div.bottom", "p.copyright", "div"),
    "reply": ("section.comments", "div#comments", "div.comments", "ol.comment-list", "div.comment", "ul.comments", "section.replies", "div.responses", "div.disqus", "section#reader-comments", "div.discussion"),
}
_MAIN = ("article", "article", "article", "main article", "main", "div#content", "div.content", "div.post", "div.post-content", "div.entry-content", "div#main div.article", "section.article-body", "div.story", "table td.content", "div.article", "main div.text", "div.page article.post", "div.wrapper div.main", "div#article", "div.body-text", "div", "div div", "div", "td", "section")


def page(rng: random.Random) -> tuple[str, set[str]]:
    """A made-up page and the texts of its main blocks (all texts of a page are different)."""
    main: set[str] = set()
    seen: set[str] = set()
    word = lambda: "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 4)))

    def said(low: int, high: int) -> str:
        while True:
            out = " ".join(word() for _ in range(rng.randint(low, high))).capitalize() + rng.choice((".", ".", ".", "", "!"))
            if rng.random() < 0.05:
                out = re.sub(" ", lambda m: rng.choice((" ", "### ", "!! ", " | ")), out)
            if out not in seen:
                seen.add(out)
                return out

    def nest(spec: str, body: str) -> str:
        for part in reversed(spec.split()):
            tag, _, name = re.match(r"(\w+)([.#]?)(.*)", part).groups()
            mark = f' {"id" if "#" in part else "class"}="{name.replace("_", " ")}{rng.choice(("", "", " " + word()))}"' if name else ""
            body = f"<{tag}{mark}>{body}</{tag}>"
        return body

    def stock() -> str:
        return rng.choice(_STOCK) + " " + word() if rng.random() < 0.3 else said(1, 4)

    def junk(kind: str, scale: int = 1) -> str:
        spec = rng.choice(_NAMES[kind])
        if kind == "menu" or kind == "side" and rng.random() < 0.5:
            items = [f'<a href="/{word()}">{stock()}</a>' for _ in range(rng.randint(2, 9))]
            body = "".join(rng.choice((f"<li>{x}</li>",)) for x in items) if rng.random() < 0.7 else f"<p>{' '.join(items)}</p>"
            return nest(spec, body if spec.startswith("ul") else f"<ul>{body}</ul>" if "<li>" in body else body)
        if kind == "form":
            return nest(spec, f"<label>{stock()}</label><input name=q><p>{said(2, 12)}</p><button>{stock()}</button>")
        if kind == "reply":
            each = [nest(rng.choice(("div", "li", "div.comment", "article.comment", "div.reply")), f"{rng.choice(('<b>', '<span class=author>', '<h4>'))}{said(1, 2)}{rng.choice(('</b>', '</span>', '</h4>'))}<p>{said(3, 40)}</p>") for _ in range(rng.randint(1, 6))]
            return nest(spec, (f"<h3>{stock()}</h3>" if rng.random() < 0.6 else "") + "".join(each))
        long = rng.random() < 0.3
        inner = said(8, 45) if long else said(2, 14)
        if kind == "foot" and rng.random() < 0.5:
            inner = f"{rng.choice(('©', '&copy;', 'Copyright', '(c)', 'Copyright ©'))} {rng.randint(1990, 2026)} {said(1, 4)} {rng.choice(('All rights reserved.', '', 'Imprint', 'Ltd.'))}".strip() if rng.random() < 0.6 else f"{rng.choice(('©', '&copy;', 'Copyright'))} {word()}.{word()} · {said(3, 45)}"
        return nest(spec, rng.choice((inner, f"<p>{inner}</p>", f"<p>{inner}</p><p>{said(2, 20)}</p>", f"<span>{inner}</span>", f"<h3>{said(1, 4)}</h3><p>{inner}</p>")))

    def part() -> str:
        chance = rng.random()
        t = said(1, 7) if chance < 0.2 else f"{rng.choice(_STOCK)} {said(1, 3)}" if chance < 0.25 else said(8, 70)
        main.add(t)
        kind = rng.random()
        if bare:
            return bare.format(t)
        if kind < 0.6:
            if rng.random() < 0.15:
                return f"<p><b>{t}<br>"
            if rng.random() < 0.2:
                a, _, b = t.partition(" ")
                return f'<p><a href="/{word()}">{a}</a> {b}</p>' if b else f"<p>{t}</p>"
            return f"<p>{t}</p>" if rng.random() < 0.9 else f"<p>{t}"
        if kind < 0.7:
            return f"<h{rng.randint(2, 4)}>{t}</h2>"
        if kind < 0.8:
            more = [said(2, 15) for _ in range(rng.randint(1, 4))]
            main.update(more)
            return "<ul>" + "".join(f"<li>{x}</li>" for x in (t, *more)) + "</ul>"
        return rng.choice(("<blockquote><p>{}</p></blockquote>", "<pre>{}</pre>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>", "<figure><figcaption>{}</figcaption></figure>", "<section><p>{}</p></section>", "<div class=text>{}</div>")).format(t)

    # Some pages have no paragraphs: every part of the text is the same component.
    body, bare = [], rng.random() < 0.15 and rng.choice(("<div>{}</div>", "<div class=part><span>{}</span></div>", "<div class=line>{}</div>", "<div><div>{}</div></div>", "<span class=row>{}</span><br><br>", "<div class=cell><div class=inner><span>{}</span></div></div>"))
    for _ in range(rng.randint(0, 3)):
        body.append(junk(rng.choice(("menu", "menu", "head", "advert", "notice", "form"))))
    if rng.random() < 0.96:
        title = said(2, 12)
        main.add(title)
        head = rng.choice((*["<h1>{}</h1>"] * 6, "<h2>{}</h2>", "<div class=title>{}</div>", "<p><b>{}</b></p>")).format(title)
        inner = [f"<header>{head}</header>" if rng.random() < 0.15 else head]
        odd = rng.random()
        if odd < 0.08:  # a line that is said again and again
            t = said(1, 12)
            main.add(t)
            inner += [rng.choice((f"<p>{t}</p>", f"<p><b>{t}<br>", f"<p>{t}")) for _ in range(rng.randint(4, 40))]
        elif odd < 0.16:  # shouted, or full of signs
            for _ in range(rng.randint(2, 12)):
                t = said(4, 40).upper()
                t = re.sub(" ", lambda m: rng.choice(("!! ", "### ", " $$ ", "!! ", " ")), t) if rng.random() < 0.7 else t
                main.add(t)
                inner.append(rng.choice((f"<p>{t}</p>", f"<p>{t}</p>", f"<p><b>{t}<br>")))
        for _ in range(rng.choice((1, 2, 3, 5, 8, 14, 25))):
            inner.append(part())
            if rng.random() < 0.06:
                inner.append(junk(rng.choice(("advert", "side", "notice", "form"))))
        if rng.random() < 0.12:
            inner.append(junk(rng.choice(("reply", "side", "foot"))))
        if rng.random() < 0.2:  # the text in a box of its own, with lists of links in the box around it
            cut = rng.choice((0, 1))
            around = [junk(rng.choice(("side", "menu", "advert", "foot"))) for _ in range(rng.randint(1, 2))]
            inner = [*inner[:cut], nest(rng.choice(("div.text", "div", "div#body", "div.output", "section", "div.inner div.block")), "".join(inner[cut:])), *around]
        body.append(nest(rng.choice(_MAIN), "".join(inner)))
        if rng.random() < 0.1:
            body.append(nest(rng.choice(_MAIN), "".join(part() for _ in range(rng.randint(1, 5)))))
    for _ in range(rng.randint(0, 4)):
        body.append(junk(rng.choice(("reply", "reply", "side", "foot", "foot", "advert", "notice", "form", "menu"))))
    if rng.random() < 0.3:
        body = [nest(rng.choice(("div.container", "div#page", "div.wrap", "div")), "".join(body))]
    title = f"<head><title>{said(2, 9)}</title><style>p{{}}</style></head>" if rng.random() < 0.8 else ""
    return f"<html>{title}<body>{''.join(body)}</body></html>", main


_PLAIN = re.compile(r"<(/?)(?:article|main|nav|header|footer|aside|section)\b(?!-)")
_NAMED = re.compile(r' (?:class|id)="([^"]*)"| class=(\w+)')


def disguised(rng: random.Random, text: str) -> str:
    """The page with other names, the same for the same, or none, and with plain divs; or as it is."""
    how, made = rng.random(), {}
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(rng.randint(1, 6))) if how < 0.26 else "".join(rng.choice(_SYLLABLES) for _ in range(rng.randint(1, 3)))
    if how < 0.15:
        text = _NAMED.sub("", text)
    elif how < 0.36:
        text = _NAMED.sub(lambda m: f' class="{made.setdefault(m[0], word())}"', text)
    return _PLAIN.sub(r"<\1div", text) if rng.random() < 0.35 else text


def labelled(n: int, seed: int, plain: bool = True) -> tuple[list[list[Block]], list[np.ndarray]]:
    """Made-up pages as blocks, and which of them are main text."""
    rng, pages, ys = random.Random(seed), [], []
    while len(pages) < n:
        html, main = page(rng)
        found = blocks(disguised(rng, html) if plain else html)
        if found:
            pages.append(found)
            ys.append(np.array([t in main for _, t, _ in found], np.float32))
    return pages, ys


@lru_cache(maxsize=2)
def trained(pages: int = 7000, epochs: int = 11, seed: int = 5) -> Model:
    """Adam over batches of pages of similar length."""
    model, (made, ys), rng = Model(seed), labelled(pages, seed), np.random.default_rng(seed)
    xs = [features(x) for x in made]
    first, second, step = {k: np.zeros_like(v) for k, v in model.p.items()}, {k: np.zeros_like(v) for k, v in model.p.items()}, 0
    order = np.argsort([len(x) for x in xs], kind="stable")
    batches = np.array_split(order, max(1, pages // 32))
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            x, mask = _padded([xs[k] for k in batches[b]])
            y = np.zeros(mask.shape, np.float32)
            for row, k in enumerate(batches[b]):
                y[row, :len(ys[k])] = ys[k]
            _, g = model.gradients(x, mask, y)
            size, step = np.sqrt(sum(float((v * v).sum()) for v in g.values())), step + 1
            for k, v in g.items():
                v = v * min(1.0, 1.0 / (size + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * v
                second[k] = 0.99 * second[k] + 0.01 * v * v
                model.p[k] -= np.float32(0.01 * 0.65**epoch) * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)
    return model


def extract(pages: DataFrame, model: Model | None = None, html: str = "html") -> DataFrame:
    """The columns of ``pages`` without ``html``, and ``text`` (in place of one of that name)."""
    small_batches(pages.sparkSession, 100)
    shared = pages.sparkSession.sparkContext.broadcast(model or trained())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = [blocks(h.as_py()) for h in batch.column("text")]
            keep = shared.value.predict(cut)
            text = ["\n".join(t for (_, t, _), k in zip(b, m, strict=True) if k) for b, m in zip(cut, keep, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(text, pa.string())], ["row", "text"])

    source = packed(pages, html)
    return source.mapInArrow(run, source.schema).select(*unpacked([c for c in pages.columns if c != html], html, text="text"))


def digest(pages: DataFrame) -> DataFrame:
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
