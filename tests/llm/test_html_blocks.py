import html
import re

import numpy as np
import pytest

from swarmsift.llm import html_blocks as H
from swarmsift.llm import queries

PAGES = "page_id long, url string, html string"


def article(page):
    """Main text by the given pages' own template."""
    inner = page[page.index("<article>") + 9:].split("</article>")[0].split("<footer>")[0]
    blocks = (SPACE.sub(" ", html.unescape(re.sub("<[^>]*>", " ", s))).strip() for s in re.split("</?p>|</?h1>", inner))
    return "\n\n".join(filter(None, blocks))


SPACE = re.compile(r"\s+")


def test_whole_table(spark):
    sf = "/root/testdata/sf0.1"
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op6_html_extract(spark, sf).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == article(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_other_layouts(spark):
    """Held-out layouts: every clutter kind inside and around other containers."""
    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(400)]
    texts = [[" ".join(rng.choice(words, rng.integers(8, 60))).capitalize() + "." for _ in range(5)] for _ in range(60)]
    other = [t for ts in texts for t in ts]
    train = [H.labelled(H.made_page(rng, texts[i % 40], other)) for i in range(500)]
    p = H.train(train)
    test = [H.labelled(H.made_page(rng, texts[40 + i % 20], other)) for i in range(200)]
    got = np.concatenate(H.predict(p, [b for b, _ in test]))
    want = np.concatenate([np.array(y, bool) for _, y in test])
    assert (got == want).mean() > 0.995


def test_leaves():
    page = ("<!DOCTYPE html><head><title>t</title></head><body><script>if (a < b) x = '</p>';</script><style>p{}</style><!-- <p>no -->"
            "<p>A&amp;B <b>bold\n  x<p>two<br>lines <a href='#'>link</a></p><ul><li>one<li>two</ul>&lt;tag&gt; &eacute;&#233;&#xe9; &am"
            "<div class='Ad big' id=x>sale</div><table><tr><td>c1<td>c2</table> 1 < 2 <noscript><p>off</p></noscript><p>open")
    got = H.leaves(page)
    assert [b[0] for b in got] == ["A&B bold x", "two lines link", "one", "two", "<tag> ééé &am", "sale", "c1", "c2", "1 < 2", "open"]
    assert got[5][1] == ("body", "div", ".ad", ".big", ".x")
    assert H.leaves("") == [] and [b[0] for b in H.leaves("just  text")] == ["just text"]
    assert [b[0] for b in H.leaves("<p>cut <a href='")] == ["cut"]
    assert len(H.leaves("<div>" * 5000 + "x" + "<p>y" * 2000)) == 2001


@pytest.mark.parametrize("start", [
    "<html><head><title>x</title><body>", "<head><title>x</title>", "<html><head><title>x <p> y</title><meta charset=a><style>p</style>",
    "<head><title>x<body>", "<head><title>x <b>y</b> z</head><body>", "<html><head><title>x</title></head><body>"])
def test_head_left_open(start):
    got = H.leaves(start + "<article><p>One two.</p><p>Three.</p></article>")
    assert [(b[0], H.named(b[1])) for b in got] == [("One two.", 1), ("Three.", 1)]
    assert [b[0] for b in H.leaves("<head><title>x</title>Bare text<p>More")] == ["Bare text", "More"]


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in H.init(1).items()}
    X, at = rng.standard_normal((9, 2 * H.DIM + H.NUMS)), H.layout(np.array([4, 3, 2]))
    up = np.where(at >= 0, rng.standard_normal(at.shape), 0)
    _, cache = H.forward(p, X, at, keep=True)
    g, dX = H.backward(p, X, at, cache, up)
    for k in [*g, "X"]:
        t = X if k == "X" else p[k]
        i = tuple(rng.integers(0, n) for n in t.shape)
        old, eps, val = t[i], 1e-5, []
        for d in (eps, -eps):
            t[i] = old + d
            val.append((H.forward(p, X, at)[0] * up).sum())
        t[i] = old
        assert (val[0] - val[1]) / (2 * eps) == pytest.approx((dX if k == "X" else g[k])[i], rel=1e-3, abs=1e-6), k


def test_edges(spark, write_tables):
    art = "<html><body><nav>menu</nav><article><p>{}</p></article><footer>f</footer></body></html>"
    rows = [(1, None, None), (1, "u", ""), (2, "u", art.format("Hello there, this is the text of it.")),
            (2, "u", art.format("Hello there, this is the text of it.")), (None, "v", art.format("x " * 100_000 + "&amp;"))]
    rows += [(10 + i, "u", art.format(f"Text number {i} of this small fixture.")) for i in range(20)]
    sf = write_tables(pages=(rows, PAGES))
    out = queries.op6_html_extract(spark, sf).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r.page_id, []).append(r.text)
    assert by[1] == ["", ""] and by[2] == ["Hello there, this is the text of it."] * 2
    assert by[None] == [("x " * 100_000 + "&").strip()]
    empty = spark.createDataFrame([], PAGES)
    assert H.fit(empty) is None and H.extract(empty, None).count() == 0


def test_every_class_name_and_formula_text_is_read():
    names = " ".join(f"a{i}" for i in range(12)) + " sidebar"
    path = H.leaves(f'<article><div class="{names}">x</div></article>')[0][1]
    assert ".sidebar" in path and ".a11" in path
    text = " ".join(b[0] for b in H.leaves("<p>Energy <math><mi>E</mi></math> and <object>fallback</object> end</p>"))
    assert text == "Energy E and fallback end"


def test_long_pages_train_too(spark):
    body = "<p>plain words of the article go on and on.</p>" * 6000
    page = f"<html><body><nav><a href=x>Home</a></nav><article>{body}</article></body></html>"
    model = H.fit(spark.createDataFrame([(1, "u", page)], PAGES), made=20)
    assert model is not None
