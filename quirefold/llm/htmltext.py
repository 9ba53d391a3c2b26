"""Main text of HTML pages by a recurrent block labeller.

A page is cut into blocks, the leaf runs of text between block elements, in page order. Each block has a vector: hashed
names, classes and ids of the elements around it (nearer ones also by nearness), hashed words, and some measures. A
bidirectional LSTM in numpy reads the blocks of the whole page and gives every block the probability of being main
text; the blocks above one half are the text. The network is trained here, on pages made by rule (`made_page`), once
per process, on the driver; the weights (about 100 KB) go to the executors.

Nulls: a null or empty page has an empty text; null ids and urls are carried; repeated rows are worked on each by itself.
Text after an unclosed tag is read as browsers do, up to the next '<' that begins one. White space is that of Unicode.
Characters in comments, scripts and styles are no text. Pages are worked on whole, whatever their length.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm import bytewords as B

PATH, WORDS, MEASURES, HIDDEN = 96, 32, 8, 24
SIZE = PATH + WORDS + MEASURES

# Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg xmp".split())
SKIPPED = frozenset("script style noscript template textarea title iframe svg xmp select option button head".split())
# Which open elements a start tag ends.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>|(<|[^<]+)", re.DOTALL)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_NAME = re.compile(r"[a-zA-Z]+")


def blocks(page: str) -> list[tuple[tuple[str, ...], str, int]]:
    """(labels of the elements around, from the root; text with single blanks; characters of it in links) of each block.

    A label is an element's name, followed by the words of its class, id and role, as "div.ad.top".
    """
    out: list = []
    names: list[str] = []
    labels: list[str] = []
    held: list[str] = []
    linked = 0
    skip = links = 0
    at, end, match = 0, len(page), _TOKEN.match

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text:
                out.append((tuple(x for n, x in zip(names, labels) if n not in INLINE), text, min(linked, len(text))))
            held.clear()
            linked = 0

    def close(k: int) -> None:
        nonlocal skip, links
        for n in names[k:]:
            skip -= n in SKIPPED
            links -= n == "a"
        del names[k:], labels[k:]

    while at < end:
        m = match(page, at)
        if m is None:  # '<' of a tag that never ends
            at += 1
            continue
        at = m.end()
        shut, name, rest, text = m.groups()
        if text is not None:
            if not skip:
                held.append(text)
                if links:
                    linked += len(text)
            continue
        if name is None:
            continue
        name = name.lower()
        if name == "br":
            held.append(" ")
        elif shut:
            if name in names:
                k = len(names) - 1 - names[::-1].index(name)
                if name in INLINE:
                    if all(n in INLINE for n in names[k:]):
                        close(k)
                else:
                    flush()
                    close(k)
        else:
            if name not in INLINE:
                flush()
                if name in ENDS_P and "p" in names:
                    k = len(names) - 1 - names[::-1].index("p")
                    if all(n == "p" or n in INLINE for n in names[k:]):
                        close(k)
                if name in ENDS and names:
                    k = len(names)
                    while k and names[k - 1] in INLINE:
                        k -= 1
                    while k and names[k - 1] in ENDS[name]:
                        k -= 1
                        close(k)
            if name in VOID or rest.endswith("/") and name not in RAW:
                continue
            if name in RAW and not (shut or name in ("noscript", "template", "svg")):
                found = re.compile(rf"</{name}\b[^>]*>", re.IGNORECASE).search(page, at)
                at = found.end() if found else end
                continue
            marks = [w.lower() for a in _ATTRIBUTE.findall(rest) for w in _NAME.findall(" ".join(a[1:]))] if rest else ()
            names.append(name)
            labels.append(".".join((name, *marks)))
            skip += name in SKIPPED
            links += name == "a"
    flush()
    return out


@lru_cache(1 << 14)
def _path_vector(path: tuple[str, ...]) -> np.ndarray:
    v = np.zeros(PATH, np.float32)
    for near, label in enumerate(reversed(path)):
        for k, w in enumerate(label.split(".")):
            h = zlib.crc32(f"{'c' if k else 't'}{w}".encode())
            v[h % (PATH * 2 // 3)] += 1.0 if h >> 20 & 1 else -1.0
            if near < 2:
                h = zlib.crc32(f"{near}{'c' if k else 't'}{w}".encode())
                v[PATH * 2 // 3 + h % (PATH // 3)] += 1.0 if h >> 20 & 1 else -1.0
    v.flags.writeable = False
    return v


def vectors(pages: list[list]) -> np.ndarray:
    """One row per block, of all pages in turn."""
    flat = [(b, k, len(p)) for p in pages for k, b in enumerate(p)]
    x = np.zeros((len(flat), SIZE), np.float32)
    if not flat:
        return x
    x[:, :PATH] = [_path_vector(b[0]) for b, _, _ in flat]
    data, at = B.arrow_bytes(pa.array([b[1] for b, _, _ in flat], pa.large_string()))
    for i, j in B.each_group(at):
        h, row = B.hashed_words(data, at, i, j)
        sign = np.where(h >> np.uint64(40) & np.uint64(1), 1.0, -1.0)
        w = np.bincount((row + i) * WORDS + (h % np.uint64(WORDS)).astype(np.int64) - i * WORDS, sign, (j - i) * WORDS).reshape(j - i, WORDS)
        n = np.bincount(row, minlength=j - i)
        x[i:j, PATH : PATH + WORDS] = 0.5 * w / np.sqrt(np.maximum(n, 1))[:, None]
        x[i:j, -1] = np.log1p(n) / 4
    x[:, -2] = [b[2] / len(b[1]) for b, _, _ in flat]
    x[:, -3] = [np.log1p(len(b[1])) / 6 for b, _, _ in flat]
    x[:, -4] = [k / n for _, k, n in flat]
    x[:, -5] = [1.0 / (1 + k) for _, k, n in flat]
    x[:, -6] = [1.0 / (n - k) for _, k, n in flat]
    x[:, -7] = [len(b[0]) / 8 for b, _, _ in flat]
    x[:, -8] = [b[1][-1] in ".!?" for b, _, _ in flat]
    return x


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _cells(x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray, b: np.ndarray, keep: bool):
    """One direction of the LSTM over x[time, page, feature]: hidden states, and with keep what the gradient needs."""
    steps, n, _ = x.shape
    size = u.shape[0]
    z_in = x.reshape(steps * n, -1) @ w + b
    z_in = z_in.reshape(steps, n, -1)
    h, c = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    hs, saved = np.zeros((steps, n, size), np.float32), []
    for t in range(steps):
        z = z_in[t] + h @ u
        i, f, o = _sigmoid(z[:, :size]), _sigmoid(z[:, size : 2 * size]), _sigmoid(z[:, 2 * size : 3 * size])
        g = np.tanh(z[:, 3 * size :])
        m = mask[t][:, None]
        c_new = f * c + i * g
        tc = np.tanh(c_new)
        if keep:
            saved.append((h, c, i, f, o, g, tc))
        h, c = np.where(m, o * tc, h), np.where(m, c_new, c)
        hs[t] = h
    return hs, saved


def _cells_back(x, mask, w, u, dhs, saved):
    """Gradients of the direction's weights, given those of its hidden states."""
    steps, n, _ = x.shape
    size = u.shape[0]
    dw, du, db = np.zeros_like(w), np.zeros_like(u), np.zeros(w.shape[1], np.float32)
    dh, dc = np.zeros((n, size), np.float32), np.zeros((n, size), np.float32)
    for t in reversed(range(steps)):
        h, c, i, f, o, g, tc = saved[t]
        m = mask[t][:, None]
        full = dh + dhs[t]
        dt = np.where(m, full, 0)
        dct = np.where(m, dc, 0) + dt * o * (1 - tc * tc)
        dz = np.concatenate([dct * g * i * (1 - i), dct * c * f * (1 - f), dt * tc * o * (1 - o), dct * i * (1 - g * g)], axis=1)
        dw += x[t].T @ dz
        du += h.T @ dz
        db += dz.sum(axis=0)
        dh = np.where(m, dz @ u.T, full)
        dc = np.where(m, dct * f, dc)
    return dw, du, db


def _padded(x: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x[block] as [time, page], and which cells are blocks."""
    mask = np.arange(sizes.max())[:, None] < sizes[None, :]
    out = np.zeros((*mask.shape, x.shape[1]), np.float32)
    out.transpose(1, 0, 2)[mask.T] = x
    return out, mask


def _turned(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Each page's steps in reverse order, the padding at the end again."""
    t = np.arange(len(x))[:, None]
    at = np.where(t < sizes, sizes - 1 - t, t)
    return np.take_along_axis(x, at[..., None] if x.ndim == 3 else at, axis=0)


class Labeller:
    """The network: two LSTMs, and a logistic layer on both hidden states."""

    def __init__(self, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        draw = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(np.float32)
        b = np.zeros(4 * HIDDEN, np.float32)
        b[HIDDEN : 2 * HIDDEN] = 1
        self.p = [draw(SIZE, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), b, draw(SIZE, 4 * HIDDEN), draw(HIDDEN, 4 * HIDDEN), b.copy(), draw(2 * HIDDEN + SIZE, 1)[:, 0] * 0.3, np.zeros(1, np.float32)]

    def _run(self, x, mask, sizes, keep=False):
        w1, u1, b1, w2, u2, b2, v, a = self.p
        left, s1 = _cells(x, mask, w1, u1, b1, keep)
        xr = _turned(x, sizes)
        right, s2 = _cells(xr, mask, w2, u2, b2, keep)
        both = np.concatenate([left, _turned(right, sizes), x], axis=2)
        return _sigmoid(both @ v + a), (both, xr, s1, s2)

    def probabilities(self, x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of each block of pages with these numbers of blocks (none of them 0)."""
        padded, mask = _padded(x, sizes)
        p, _ = self._run(padded, mask, sizes)
        return p.T[mask.T]

    def trained(self, pages: list[tuple[list, list[bool]]], rounds: int = 6, batch: int = 24, rate: float = 0.01, seed: int = 6) -> Labeller:
        """Adam on the log loss over (blocks, labels) of pages."""
        rng = np.random.default_rng(seed)
        m1, m2 = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p]
        step = 0
        made = [(vectors([b]), np.array(y, np.float32)) for b, y in pages if b]
        for k in range(rounds):
            order = rng.permutation(len(made))
            for i in range(0, len(order), batch):
                some = [made[j] for j in order[i : i + batch]]
                sizes = np.array([len(y) for _, y in some])
                x, mask = _padded(np.concatenate([a for a, _ in some]), sizes)
                y, _ = _padded(np.concatenate([b for _, b in some])[:, None], sizes)
                p, (both, xr, s1, s2) = self._run(x, mask, sizes, keep=True)
                d = np.where(mask, p - y[..., 0], 0).astype(np.float32) / mask.sum()
                w1, u1, _, w2, u2, _, v, _ = self.p
                dv, da = np.einsum("tn,tnk->k", d, both), np.array([d.sum()], np.float32)
                dboth = d[..., None] * v
                g1 = _cells_back(x, mask, w1, u1, dboth[..., :HIDDEN], s1)
                g2 = _cells_back(xr, mask, w2, u2, _turned(dboth[..., HIDDEN : 2 * HIDDEN], sizes), s2)
                step += 1
                for q, g in enumerate([*g1, *g2, dv, da]):
                    g = np.clip(g, -1, 1)
                    m1[q] = 0.9 * m1[q] + 0.1 * g
                    m2[q] = 0.999 * m2[q] + 0.001 * g * g
                    slow = rate * (0.5 ** (k / 2))
                    self.p[q] = (self.p[q] - slow * (m1[q] / (1 - 0.9**step)) / (np.sqrt(m2[q] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


# Names that pages give to their parts.
MAIN_NAMES = "content main article post entry story body text page-content post-content entry-content article-body story-body main-content markdown prose single".split()
MENU_NAMES = "nav menu navbar navigation main-nav breadcrumb breadcrumbs tabs toc pagination pager links topbar".split()
HEAD_NAMES = "header masthead site-header top banner brand logo site-title".split()
FOOT_NAMES = "footer site-footer bottom copyright legal colophon foot".split()
SIDE_NAMES = "sidebar side aside widget related recommended more trending popular rail right-column tags recent".split()
AD_NAMES = "ad ads advert advertisement sponsor sponsored promo banner-ad adsense ad-slot promoted".split()
NOTICE_NAMES = "cookie cookies consent notice gdpr alert popup modal overlay banner newsletter warning privacy announcement".split()
FORM_NAMES = "form search login signup subscribe newsletter-form contact search-box".split()
COMMENT_NAMES = "comment comments comment-list discussion replies reader-comments respond disqus responses thread".split()
SHARE_NAMES = "share social sharing byline-share buttons follow meta-links share-bar".split()


def made_page(rng: random.Random) -> tuple[str, list[bool]]:
    """A page by rule, and for each of its blocks whether it is main text."""
    vocabulary = ["".join(rng.choice("bcdfghlmnprst") + rng.choice("aeiouéü") for _ in range(rng.randint(1, 3))) for _ in range(60)]
    labels: list[bool] = []
    main = False

    def words(lo: int, hi: int) -> str:
        return " ".join(rng.choice(vocabulary) for _ in range(rng.randint(lo, hi))).capitalize()

    def sentence(lo: int = 4, hi: int = 40) -> str:
        return words(lo, hi) + rng.choice([".", ".", "!", "?", ""])

    def leaf(text: str) -> str:
        labels.append(main)
        return text

    def inline(text: str) -> str:
        return rng.choice(["{}", "{}", "{}", "<b>{}</b>", "<em>{}</em>", "<span>{}</span>", '<a href="/x">{}</a> more'] if main else ["{}"]).format(text)

    def tag(names: list[str], inside, plain: str = "", also: tuple[str, ...] = ()) -> str:
        """A part, by its own element or by a div or section of such a class or id."""
        name = rng.choice(names)
        kind = rng.choice([plain, plain, "div", "section"] if plain else ["div", "section", "div", *also])
        mark = "" if kind == plain and plain and rng.random() < 0.6 else f' {rng.choice(["class", "class", "id"])}="{name}{rng.choice(["", "", " " + rng.choice(names), "-inner", " box"])}"'
        return f"<{kind}{mark}>{inside()}</{kind}>"

    def linklist() -> str:
        if rng.random() < 0.7:
            return "<ul>" + "".join(f'<li><a href="/{k}">{leaf(words(1, 3))}</a></li>' for k in range(rng.randint(2, 8))) + "</ul>"
        return "".join(f'<div><a href="/{k}">{leaf(words(1, 3))}</a></div>' for k in range(rng.randint(2, 6)))

    def lines(lo: int = 1, hi: int = 3, element: tuple[str, ...] = ("p", "div", "p")) -> str:
        if rng.random() < 0.3:
            return leaf(sentence(3, 25))
        return "".join(f"<{e}>{leaf(inline(sentence(3, 25)))}</{e}>" for e in (rng.choice(element) for _ in range(rng.randint(lo, hi))))

    def off(make):
        nonlocal main
        was, main = main, False
        out = make()
        main = was
        return out

    menu = lambda: off(lambda: tag(MENU_NAMES, linklist, "nav"))
    head = lambda: off(lambda: tag(HEAD_NAMES, lambda: rng.choice([lines, lambda: f"<h1>{leaf(words(1, 4))}</h1>", linklist])(), "header"))
    foot = lambda: off(lambda: tag(FOOT_NAMES, lambda: lines() if rng.random() < 0.6 else leaf("&copy; " + words(2, 8)) + linklist(), "footer"))
    side = lambda: off(lambda: tag(SIDE_NAMES, lambda: (f"<h3>{leaf(words(1, 3))}</h3>" if rng.random() < 0.6 else "") + rng.choice([linklist, lines])(), "aside"))
    ad = lambda: off(lambda: tag(AD_NAMES, lambda: rng.choice([lines, lambda: leaf(sentence(3, 20)), lambda: f'<a href="/buy">{leaf(words(2, 6))}</a>'])(), also=("aside",)))
    notice = lambda: off(lambda: tag(NOTICE_NAMES, lambda: lines(1, 2), also=("aside",)))
    share = lambda: off(lambda: tag(SHARE_NAMES, rng.choice([linklist, lambda: leaf(words(1, 4))])))
    form = lambda: off(lambda: (lambda inner: f"<form>{inner}</form>" if rng.random() < 0.6 else f'<div class="{rng.choice(FORM_NAMES)}">{inner}</div>')(f"<label>{leaf(words(1, 4))}</label><input type=text><button>ok</button>" + (f"<p>{leaf(sentence(3, 10))}</p>" if rng.random() < 0.5 else "")))
    comments = lambda: off(lambda: tag(COMMENT_NAMES, lambda: (f"<h3>{leaf(words(1, 3))}</h3>" if rng.random() < 0.6 else "") + "".join(rng.choice(['<div class="comment">{}</div>', "<li>{}</li>", "<article>{}</article>", "<p>{}</p>"]).format(lines(1, 2)) for _ in range(rng.randint(1, 6)))))

    def paragraph() -> str:
        roll = rng.random()
        if roll < 0.06:
            return "<ul>" + "".join(f"<li>{leaf(sentence(2, 15))}</li>" for _ in range(rng.randint(2, 5))) + "</ul>"
        if roll < 0.12:
            return f"<h2>{leaf(words(1, 6))}</h2>"
        if roll < 0.16:
            return f"<blockquote>{leaf(sentence())}</blockquote>"
        if roll < 0.19:
            return f"<pre>{leaf(sentence())}</pre>"
        if roll < 0.22:
            return "<table><tr>" + "".join(f"<td>{leaf(words(1, 4))}</td>" for _ in range(rng.randint(2, 4))) + "</tr></table>"
        if roll < 0.27:
            return f"<p>{leaf(words(1, 3) + '.')}</p>"
        if roll < 0.32:
            return f"<p><b>{leaf(sentence())}<br>"  # not closed
        if roll < 0.36:
            return f"<div>{leaf(sentence())}</div>"
        if roll < 0.38:
            return f"<figure><img src=x><figcaption>{leaf(sentence(3, 10))}</figcaption></figure>"
        return f"<p>{leaf(inline(sentence(5, 80)))}</p>"

    def article() -> str:
        nonlocal main
        main = True
        out = [rng.choice(["<h1>{}</h1>", "<h1>{}</h1>", "<header><h1>{}</h1></header>", "<h2>{}</h2>"]).format(leaf(words(2, 12))) if rng.random() < 0.85 else ""]
        for _ in range(rng.choice([0, 1, 2, 4, 7, 10, 16, 24])):
            out.append(paragraph())
            if rng.random() < 0.07:
                out.append(rng.choice([ad, share, side, form, notice])())
        if rng.random() < 0.15:
            out.append(comments())
        main = False
        return "".join(out)

    def core() -> str:
        kind = rng.random()
        if kind < 0.5:
            return f"<article>{article()}</article>"
        if kind < 0.65:
            return f"<main>{article()}</main>"
        if kind < 0.72:
            return f"<main><article>{article()}</article></main>"
        return f'<{(e := rng.choice(["div", "div", "section"]))} {rng.choice(["class", "id"])}="{rng.choice(MAIN_NAMES)}">{article()}</{e}>'

    before = [make for make, p in ((notice, 0.2), (head, 0.35), (menu, 0.8), (form, 0.1), (ad, 0.45), (menu, 0.08), (side, 0.12)) if rng.random() < p]
    after = [make for make, p in ((share, 0.1), (comments, 0.3), (side, 0.35), (ad, 0.25), (form, 0.12), (notice, 0.1), (foot, 0.85)) if rng.random() < p]
    bare = rng.random()  # pages of an article and little else
    before, after = before[: 0 if bare < 0.08 else None], after[: 0 if bare < 0.14 else None]
    if rng.random() < 0.3:
        rng.shuffle(before)
        rng.shuffle(after)
    body = "".join(make() for make in before) + core() + "".join(make() for make in after)
    if rng.random() < 0.3:
        body = f'<div class="{rng.choice(["wrapper", "container", "site", "page", "layout", "row"])}">{body}</div>'
    page = f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title><style>p{{}}</style></head><body>{body}"
    return page + ("</body></html>" if rng.random() < 0.9 else ""), labels


@lru_cache(4)
def trained(n_pages: int = 1500, seed: int = 7) -> Labeller:
    """The labeller, trained on so many made pages."""
    rng = random.Random(seed)
    pages = []
    while len(pages) < n_pages:
        page, labels = made_page(rng)
        got = blocks(page)
        if len(got) == len(labels):
            pages.append((got, labels))
    return Labeller().trained(pages)


def main_text(pages: list[str], model: Labeller) -> list[str]:
    """The main text of each page."""
    cut = [blocks(p) for p in pages]
    out = [""] * len(cut)
    full = sorted((k for k, c in enumerate(cut) if c), key=lambda k: len(cut[k]))
    at = 0
    while at < len(full):
        some, cells = [], 0
        while at < len(full) and (not some or (len(some) + 1) * len(cut[full[at]]) <= 4096):
            some.append(full[at])
            at += 1
        sizes = np.array([len(cut[k]) for k in some])
        p = model.probabilities(vectors([cut[k] for k in some]), sizes)
        for k, own in zip(some, np.split(p, np.cumsum(sizes)[:-1])):
            out[k] = " ".join(b[1] for b, q in zip(cut[k], own) if q > 0.5)
    return out


def extracted(pages: DataFrame, n_train: int = 1500) -> DataFrame:
    """page_id, url, text, n_chars of every row."""
    model = trained(n_train)
    of = pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                text = main_text([p or "" for p in part.column(2).to_pylist()], model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return of.mapInArrow(run, f"page_id {of.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")
