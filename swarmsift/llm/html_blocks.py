"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: the text between block-level tags.  Each
block enters a bidirectional LSTM (numpy) as the mean of hashed vectors of its tag path
(tags, classes and ids), the mean of hashed vectors of its words and a few numbers
(length, share of link text, how it ends); the states of both directions, which have
seen the whole page, decide whether the block is main text.

There are no labels, so it is trained on weak ones: a bounded sample of pages
(``sample_pages``, in hash order) whose markup names the article, and pages made from
the sampled paragraphs under other layouts (other containers, page headers, sidebars,
notices, adverts, forms, reader comments), whose labels are known because they were
made.  Words of content and clutter come from the same pages, so that structure decides.

Kept blocks have character references decoded and white space runs turned into one
space, and are joined by two newlines; nothing else is changed, dropped or cut.

Defined results: null or empty html: empty text; a page without tags is one block; tags
left open or cut off end with the page, but a head or title left open ends with the first
tag (a head also with the first text) that cannot stand in it; null url stays null; repeated rows each get a
row; no page to train on: the markup's own names decide; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

# Element names of HTML by their role.
BLOCK_TAGS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup "
    "option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TAGS = frozenset("script style noscript template iframe svg".split())
HIDDEN_TAGS = frozenset("head title".split())
HEAD_TAGS = frozenset("head title base basefont bgsound link meta script style noscript template".split())  # may stand in a head
# Names that pages give to clutter and to the article.
CLUTTER = frozenset(
    "nav menu footer aside sidebar ad ads adv advert advertisement banner sponsor sponsored promo cookie cookies "
    "consent notice notices alert popup modal overlay form login signup subscribe newsletter search breadcrumb "
    "breadcrumbs pagination pager related recommended share sharing social comment comments reply replies respond "
    "discussion widget copyright legal toolbar tags meta button select option textarea fieldset dialog".split())
ARTICLE = frozenset("article main content post entry story body-text article-body post-content entry-content".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)"
                   r"|</?[a-zA-Z][^>]*(?:>|\Z)", re.S)  # the last one: a quote left open
NAMES = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", re.I)
TITLE = re.compile(r"(?:(?!<body|</head|<svg).)*?</title\s*>", re.I | re.S)  # tags in a title are text
SPLIT = re.compile(r"[\s_]+")
SPACE = re.compile(r"\s+")
PATH_BITS, WORD_BITS, DIM, HIDDEN, NUMS = 11, 12, 10, 12, 6


def leaves(page: str) -> list[tuple[str, tuple[str, ...], float]]:
    """(text, path names from the outside in, share of link text) per block in page order."""
    out: list = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    text: list[str] = []
    linked = 0
    in_link = 0

    def flush():
        nonlocal linked
        if text:
            t = SPACE.sub(" ", html.unescape("".join(text))).strip()
            if t and not any(tag in HIDDEN_TAGS for tag, _ in stack):
                out.append((t, tuple(n for _, names in stack for n in names), min(1.0, linked / max(1, len(t)))))
            text.clear()
        linked = 0

    def close(upto: int):
        nonlocal in_link
        for tag, _ in stack[upto:]:
            in_link -= tag == "a"
        del stack[upto:]

    pos, end = 0, len(page)
    while pos < end:
        m = TOKEN.search(page, pos)
        chunk = page[pos:m.start()] if m else page[pos:]
        if chunk:
            if stack and stack[-1][0] == "head" and chunk.strip():  # text cannot stand in a head
                close(len(stack) - 1)
            text.append(chunk)
            linked += len(chunk) if in_link else 0
        if not m:
            break
        pos = m.end()
        if m[1] is not None:
            text.append(html.escape(m[1], quote=False))
        if m[3] is None:
            continue
        tag, closing = m[3].lower(), bool(m[2])
        if not closing and tag in RAW_TAGS:
            if not m[4].endswith("/") or tag in ("script", "style"):
                stop = re.compile(rf"</{tag}\s*>", re.I).search(page, pos)
                pos = stop.end() if stop else end
            continue
        if tag == "br":
            text.append(" ")
            continue
        block = tag in BLOCK_TAGS
        if block:
            flush()
        if tag == "title" and not closing and (whole := TITLE.match(page, pos)):
            pos = whole.end()
            continue
        if tag not in HEAD_TAGS and (not closing or tag in ("body", "html")) and (block or not stack or stack[-1][0] != "title"):
            at = next((i for i, (name, _) in enumerate(stack) if name in HIDDEN_TAGS), None)
            if at is not None:  # a head or title left open ends here
                flush()
                close(at)
        if closing:
            at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if at is not None:
                close(at)
            continue
        if block:
            own = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "td": ("td", "th"), "th": ("td", "th"),
                   "tr": ("tr", "td", "th"), "option": ("option",)}.get(tag, ()) + ("p",)
            for i in range(len(stack) - 1, -1, -1):  # what this tag ends without saying so
                if stack[i][0] in own:
                    close(i)
                elif stack[i][0] in BLOCK_TAGS:
                    break
        if tag in VOID_TAGS or m[4].endswith("/") and tag not in BLOCK_TAGS:
            continue
        names = [tag]
        for k in NAMES.finditer(m[4]):
            value = next(v for v in k.groups()[1:] + ("",) if v is not None)
            names += ["." + w for w in SPLIT.split(value.lower()) if w]
        if tag == "a":
            in_link += 1
        stack.append((tag, tuple(names)))
    flush()
    return out


def _words(name: str) -> list[str]:
    name = name.lstrip(".")
    return [name, *re.split(r"[-:]", name)]


def named(path: tuple[str, ...]) -> int:
    """1 article, 0 clutter, -1 unnamed, by the names on the path alone."""
    words = [w for n in path for w in _words(n)]
    inside = any(w in ARTICLE for w in words)
    if any(w in CLUTTER for w in words) or ("header" in path and "article" not in path) or ".header" in path:
        return 0
    return 1 if inside else -1


# ---------------------------------------------------------------- network

def _bucket(name: str, bits: int) -> int:
    return zlib.crc32(name.encode()) & ((1 << bits) - 1)


def inputs(blocks):
    """Path buckets, word buckets (each with offsets) and numbers of a list of blocks."""
    names = [{_bucket(n, PATH_BITS) for n in (*path, "leaf " + (next((p for p in reversed(path) if p[0] != "."), "")))}
             for _, path, _ in blocks]
    split = [t.encode().lower().split() or [b""] for t, _, _ in blocks]
    codes, uniq = pd.factorize(np.array([w for s in split for w in s] + [b""], object))
    word = np.array([zlib.crc32(w) & ((1 << WORD_BITS) - 1) for w in uniq], np.int64)[codes[:-1]]
    num = np.array([(min(len(t), 5000) ** 0.5 / 20, link, len(s) / (len(s) + 10), t[-1] in ".!?:\"", t[0].isupper(), 1.0)
                    for (t, _, link), s in zip(blocks, split, strict=True)], np.float32)
    np_, nw = np.array([len(n) for n in names]), np.array([len(s) for s in split])
    return (np.array([b for n in names for b in sorted(n)], np.int64), np.cumsum(np_) - np_,
            word, np.cumsum(nw) - nw, num)


def _mean(table, rows, offsets):
    n = np.diff(np.append(offsets, len(rows)))[:, None].astype(np.float32)
    return np.add.reduceat(table[rows], offsets, axis=0) / n


def init(seed: int = 3):
    rng = np.random.default_rng(seed)
    f = lambda *s, k: (rng.standard_normal(s) * k).astype(np.float32)
    p = {"path": f(1 << PATH_BITS, DIM, k=0.5), "word": f(1 << WORD_BITS, DIM, k=0.05), "out": f(2 * HIDDEN, k=0.3),
         "bias": np.zeros(1, np.float32)}
    for d in "fb":
        p["W" + d] = f(2 * DIM + NUMS, 4 * HIDDEN, k=0.3)
        p["U" + d] = f(HIDDEN, 4 * HIDDEN, k=0.2)
    return p


def _sig(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


def _lstm(x, mask, U, reverse, keep):
    """x: step x page x 4H; padded steps leave the state as it is."""
    T, n, _ = x.shape
    h = np.zeros((n, HIDDEN), x.dtype)
    c = np.zeros_like(h)
    hs, cache = np.zeros((T, n, HIDDEN), x.dtype), []
    for t in (range(T - 1, -1, -1) if reverse else range(T)):
        s = x[t] + h @ U
        g = _sig(s[:, :3 * HIDDEN])
        i, f, o = g[:, :HIDDEN], g[:, HIDDEN:2 * HIDDEN], g[:, 2 * HIDDEN:]
        u = np.tanh(s[:, 3 * HIDDEN:])
        m = mask[t][:, None]
        c2 = m * (f * c + i * u) + (1 - m) * c
        tc = np.tanh(c2)
        h2 = m * (o * tc) + (1 - m) * h
        if keep:
            cache.append((t, h, c, i, f, o, u, tc, m))
        h, c = h2, c2
        hs[t] = h
    return hs, cache


def forward(p, X, at, keep=False):
    """Logit of each block; ``at`` (step x page) holds block numbers, -1 for padding."""
    mask = (at >= 0).astype(X.dtype)
    outs = [_lstm((X @ p["W" + d])[at], mask, p["U" + d], d == "b", keep) for d in "fb"]
    H = np.concatenate([outs[0][0], outs[1][0]], axis=2)
    return H @ p["out"] + p["bias"][0], (H, outs[0][1], outs[1][1])


def backward(p, X, at, cache, dlogit):
    H, *runs = cache
    g = {"bias": np.array([dlogit.sum()]), "out": np.einsum("tn,tnh->h", dlogit, H)}
    dX = np.zeros_like(X)
    for k, d in enumerate("fb"):
        U = p["U" + d]
        dxw, dU = np.zeros((len(X), 4 * HIDDEN), X.dtype), np.zeros_like(U)
        dh, dc = np.zeros((at.shape[1], HIDDEN), X.dtype), np.zeros((at.shape[1], HIDDEN), X.dtype)
        for t, h, c, i, f, o, u, tc, m in reversed(runs[k]):
            dh = dh + dlogit[t][:, None] * p["out"][k * HIDDEN:(k + 1) * HIDDEN]
            dhm = dh * m
            dcm = dc + dhm * o * (1 - tc * tc)
            dci = dcm * m
            ds = np.concatenate([dci * u * i * (1 - i), dci * c * f * (1 - f), dhm * tc * o * (1 - o),
                                 dci * i * (1 - u * u)], axis=1)
            dU += h.T @ ds
            ok = at[t] >= 0
            dxw[at[t][ok]] += ds[ok]  # each block once
            dh = dh * (1 - m) + ds @ U.T
            dc = dci * f + dcm * (1 - m)
        g["U" + d], g["W" + d] = dU, X.T @ dxw
        dX += dxw @ p["W" + d].T
    return g, dX


def layout(sizes: np.ndarray) -> np.ndarray:
    """Step x page block numbers of pages that lie one after another."""
    first = np.cumsum(sizes) - sizes
    t = np.arange(int(sizes.max()) if len(sizes) else 0)[:, None]
    return np.where(t < sizes, first + t, -1)


def embed(p, feats):
    path, po, word, wo, num = feats
    return np.concatenate([_mean(p["path"], path, po), _mean(p["word"], word, wo), num], axis=1)


def train(pages: list[tuple[list, list[int]]], epochs: int = 6, batch: int = 16, seed: int = 3):
    """Fit on (blocks, labels) pages."""
    rng = np.random.default_rng(seed)
    p = init(seed)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(w) for k, w in p.items()}
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(pages))
        for lo in range(0, len(order), batch):
            part = [pages[i] for i in order[lo:lo + batch]]
            sizes = np.array([len(b) for b, _ in part])
            at, feats = layout(sizes), inputs([x for b, _ in part for x in b])
            y = np.array([x for _, l in part for x in l], np.float32)
            X = embed(p, feats)
            logit, cache = forward(p, X, at, keep=True)
            dlogit = np.where(at >= 0, (_sig(logit) - y[at]) / len(y), 0).astype(np.float32)
            g, dX = backward(p, X, at, cache, dlogit)
            for name, k in (("path", 0), ("word", 2)):
                rows, offs = feats[k], feats[k + 1]
                n = np.diff(np.append(offs, len(rows)))
                d = dX[:, k // 2 * DIM:(k // 2 + 1) * DIM] / n[:, None]
                g[name] = np.zeros_like(p[name])
                np.add.at(g[name], rows, np.repeat(d, n, axis=0))
            step += 1
            rate = 0.02 * (1 - epoch / epochs) + 0.002
            for k in p:
                m[k] = 0.9 * m[k] + 0.1 * g[k]
                v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
                p[k] = p[k] - (rate * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.99 ** step)) + 1e-7)).astype(np.float32)
    return p


def predict(p, pages: list[list]) -> list[np.ndarray]:
    """Whether each block of each page is main text."""
    if p is None:
        return [np.array([named(b[1]) == 1 for b in blocks], bool) for blocks in pages]
    out: list = [np.zeros(0, bool)] * len(pages)
    order = sorted((i for i in range(len(pages)) if pages[i]), key=lambda i: len(pages[i]))
    lo = 0
    while lo < len(order):
        hi = lo + 1  # pages of like length, some 20,000 blocks at once or one longer page
        while hi < len(order) and (hi + 1 - lo) * len(pages[order[hi]]) <= 20_000:
            hi += 1
        part = order[lo:hi]
        sizes = np.array([len(pages[i]) for i in part])
        at = layout(sizes)
        logit, _ = forward(p, embed(p, inputs([b for i in part for b in pages[i]])), at)
        for k, i in enumerate(part):
            out[i] = logit[:sizes[k], k] > 0
        lo = hi
    return out


# ---------------------------------------------------------------- weak labels

CONTAINERS = ["<article>{}</article>", "<main>{}</main>", '<main role="main"><article>{}</article></main>',
              '<div class="content">{}</div>', '<div id="post"><div class="entry">{}</div></div>',
              '<section class="story">{}</section>', '<div id="main"><div class="article-body">{}</div></div>', "<div>{}</div>"]
BEFORE = ['<header><div class="logo">{s}</div><p>{s}</p></header>', "<nav><ul>{li}</ul></nav>", '<div class="menu">{links}</div>',
          '<div class="cookie-notice"><p>{s}</p><button>{w}</button></div>', '<div class="ad">{s}</div>',
          '<div class="banner"><p>{s}</p></div>', '<div class="breadcrumbs">{links}</div>', '<div id="header"><h2>{s}</h2></div>',
          '<form action="/s"><label>{w}</label><input name=q><button>{w}</button></form>', "<aside><h3>{s}</h3><ul>{li}</ul></aside>"]
INSIDE = ['<div class="ad">{s}</div>', "<aside><p>{s}</p></aside>", '<div class="share">{links}</div>',
          '<div class="newsletter"><p>{s}</p><form><input><button>{w}</button></form></div>', "", "", "", ""]
AFTER = ["<footer><p>{s}</p></footer>", "<footer>{s}</footer>", '<div class="sidebar"><h3>{s}</h3><ul>{li}</ul></div>',
         '<section class="comments"><h3>{s}</h3><div class="comment"><p>{s}</p></div><div class="comment"><p>{long}</p></div></section>',
         '<div id="comments"><p>{long}</p><p>{s}</p></div>', '<div class="related"><ul>{li}</ul></div>',
         '<div class="footer"><p>{s}</p><p>{links}</p></div>', '<div class="ads">{s}</div>', '<form class="login"><p>{s}</p></form>']


def made_page(rng, paragraphs: list[str], other: list[str]) -> str:
    """A page under a random layout.  Main text is marked by a control character, which
    ``labelled`` reads and takes out."""
    def fill(tpl):
        pick = lambda: html.escape(" ".join(other[rng.integers(len(other))].split()[:rng.integers(2, 16)]))
        a = lambda: f'<a href="/x">{pick()[:30]}</a>'
        return tpl.replace("{long}", html.escape(other[rng.integers(len(other))])).replace("{s}", pick()) \
            .replace("{w}", pick()[:12]).replace("{links}", " | ".join(a() for _ in range(4))) \
            .replace("{li}", "".join(f"<li>{a()}</li>" for _ in range(rng.integers(2, 7))))
    body = []
    if rng.random() < 0.7:
        body.append(f"<h1>\x01{html.escape(paragraphs[0][:60])}</h1>")
    for t in paragraphs:
        kind = rng.random()
        t = "\x01" + html.escape(t)
        body.append(f"<ul><li>{t}</li></ul>" if kind < 0.06 else f"<blockquote>{t}</blockquote>" if kind < 0.1
                    else f"<h2>{t[:50]}</h2>" if kind < 0.16 else f"<p>{t}</p>")
        body.append(fill(INSIDE[rng.integers(len(INSIDE))]))
    pick = lambda parts: "".join(fill(parts[i]) for i in rng.choice(len(parts), rng.integers(1, 5), replace=False))
    whole = pick(BEFORE) + CONTAINERS[rng.integers(len(CONTAINERS))].replace("{}", "".join(body)) + pick(AFTER)
    return f"<html><head><title>x</title></head><body>{whole}</body></html>"


def labelled(page: str):
    blocks = leaves(page)
    return [(t.replace("\x01", "") or " ", path, link) for t, path, link in blocks], [int("\x01" in t) for t, _, _ in blocks]


def fit(pages: DataFrame, text: str = "html", sample_pages: int = 300, made: int = 900, seed: int = 3,
        sample_chars: int = 200_000):
    """Train on a bounded sample: ``sample_pages`` pages chosen by hash, of each the first
    ``sample_chars`` characters; None if there is nothing to learn from."""
    # Hashes are sampled first, so that only the chosen pages travel, and each of many copies once.
    able = pages.filter(F.col(text).isNotNull()).select(F.xxhash64(text).alias("__h"), F.substring(text, 1, sample_chars).alias("__t"))
    low = [r[0] for r in able.select("__h").distinct().orderBy("__h").limit(sample_pages).collect()]
    rows = able.filter(F.col("__h").isin(low)).groupBy("__h").agg(F.min("__t").alias("__t")) \
        .orderBy("__h").select("__t").collect() if low else []
    rng = np.random.default_rng(seed)
    real = []
    for r in rows:
        blocks = leaves((r[0] or "").replace("\x01", " "))
        marks = [named(b[1]) for b in blocks]
        if 1 in marks:
            real.append((blocks, [int(k == 1) for k in marks]))
    texts = [[b[0] for b, y in zip(bs, ys, strict=True) if y and len(b[0]) > 20] for bs, ys in real]
    texts = [t for t in texts if t]
    if not texts:
        return None
    other = [t for ts in texts for t in ts]
    pages_ = real + [labelled(made_page(rng, texts[rng.integers(len(texts))][:30], other)) for _ in range(made)]
    return train([p for p in pages_ if p[0]])


def extract(pages: DataFrame, model, text: str = "html", carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """``carry`` columns, ``text`` and ``n_chars`` per row."""
    shared = pages.sparkSession.sparkContext.broadcast(model)
    names = [f"c{i}" for i in range(len(carry))]
    rows = pages.select(*[F.col(c).alias(n) for c, n in zip(carry, names, strict=True)],
                        F.coalesce(F.col(text), F.lit("")).alias("html"))
    kinds = dict(rows.dtypes)

    def run(it):
        for pdf in batches(it, 400, 2_000_000, "html"):
            found = [leaves(h) for h in pdf["html"]]
            keep = predict(shared.value, found)
            out = ["\n\n".join(b[0] for b, k in zip(bs, ks, strict=True) if k) for bs, ks in zip(found, keep, strict=True)]
            yield pd.DataFrame({**{n: pdf[n] for n in names}, "text": out})

    # Numbers travel as strings, so that nulls do not turn them into floats.
    done = rows.select(*[F.col(n).cast("string").alias(n) for n in names], "html") \
        .mapInPandas(run, ", ".join(f"{n} string" for n in names) + ", text string")
    return done.select(*[F.col(n).cast(kinds[n]).alias(c) for n, c in zip(names, carry, strict=True)], "text",
                       F.length("text").cast("long").alias("n_chars"))
