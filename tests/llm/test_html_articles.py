"""Articles in elements whose names only sound like sidebars, and articles beside longer main texts."""

import pytest

from arbiter.llm import html_template

LONG = "the whole story of the day told at length in many words"
TEASER = "<article class='card'>teaser</article>"


@pytest.mark.parametrize(
    "body, want",
    [
        (f"<div class='page has-sidebar'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div id='content' class='no-comments'><article><p>{LONG}</p></article></div>{TEASER}", f"{LONG} teaser"),
        (f"<div class='sidebar-layout'><p>{LONG}</p></div><div>x</div>", LONG),
        (f"<div class='sidebar'><article><p>{LONG}</p></article></div>", LONG),
        (f"<div role='form'><p>{LONG}</p></div>", LONG),
        (f"<form><article><p>{LONG}</p></article></form>", LONG),
        (f"<main><p>{LONG}</p>{TEASER}</main>", f"{LONG} teaser"),
        (f"<main><h1>x</h1><article><p>{LONG}</p></article></main>", LONG),
        (f"<article><p>short</p></article><div class='comment-list'><article><p>{LONG}</p></article></div>", "short"),
        (f"<article><p>{LONG}</p><div class='share-buttons'>share</div></article><div class='related'>{TEASER}</div>", LONG),
    ],
)
@pytest.mark.parametrize("alone", [True, False])
def test_articles_are_found(spark, body, want, alone):
    urls = ["http://a.test/1"] if alone else [f"http://a.test/{k}" for k in range(3)]
    pages = [(k, u, f"<html><body>{body}<p>{k}</p></body></html>".replace(f"<p>{k}</p>", f"<!-- {k} -->")) for k, u in enumerate(urls)]
    out = html_template.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in out] == [want] * len(urls)


def test_template_texts_leave_the_slots(spark):
    words = "amber birch cedar dune ember fjord".split()
    notice = "<p class='lead'>Read the terms of use before you go on</p>"
    page = lambda text, n=notice: f"<html><body><article>{n}<p>{text}</p></article></body></html>"
    story = lambda k: f"{words[k]} is what this page tells about, at some length"
    rows = [(k, f"http://a.test/{k}", page(story(k))) for k in range(4)]
    rows += [(10 + k, f"http://copies.test/{k}", page(story(0))) for k in range(5)]  # one page, five times
    rows += [(20 + k, f"http://near.test/{k}", page(words[k], f"<p>{LONG}</p>")) for k in range(5)]
    rows += [(30 + k, f"http://two.test/{k}", page(story(k))) for k in range(2)]
    out = {r["page_id"]: r["text"] for r in html_template.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    whole = lambda k: f"Read the terms of use before you go on {story(k)}"
    want = {k: story(k) for k in range(4)} | {10 + k: whole(0) for k in range(5)}
    want |= {20 + k: f"{LONG} {words[k]}" for k in range(5)} | {30 + k: whole(k) for k in range(2)}
    assert out == want


def _brute_template(pages, least=3):
    """Blocks on most pages of a host, by whole occurrence vectors of all tokens."""
    counts = [html_template.tokens_of(p)[0] for p in dict.fromkeys(pages)]
    vectors = {}
    for token in {t for c in counts for t in c}:
        vectors.setdefault(tuple(c.get(token, 0) for c in counts), []).append(token)
    out = set()
    for v, tokens in vectors.items():
        on, size = sum(x > 0 for x in v), sum(2 if "\n2" in t[-1] else 1 for t in tokens)
        if 2 * on >= len(counts) and size >= 2:
            out |= {"/".join(t) for t in tokens if "\n" not in t[-1] or on >= least}
    return out


@pytest.mark.parametrize("wrap, box", [("div", "div"), ("x-page", "x-box"), ("section", "div")])
def test_template_without_telling_names(spark, wrap, box):
    """Nothing but what repeats tells the article: unknown elements, classes without meaning, page after page."""
    top = f"<{box} class='qa'><p>All of our stories, every morning and every night</p><p>Read on paper</p></{box}>"
    page = lambda k: f"<html><body><{wrap}>{top}<{box} class='qb'><p>{k} came home late</p><p>and {k * 3} left at noon</p></{box}><{box} class='qc'>Write to the desk at any time</{box}></{wrap}></body></html>"
    names = ["amber", "birch", "cedar", "dune"]
    rows = [(k, f"http://a.test/{k}", page(n)) for k, n in enumerate(names)] + [(9, "http://a.test/9", page("amber"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r["page_id"]: r["text"] for r in html_template.main_text(df).collect()}
    text = lambda n: f"{n} came home late and {n * 3} left at noon"
    assert out == {k: text(n) for k, n in enumerate(names)} | {9: text("amber")}
    assert {r["token"] for r in html_template.template(df).collect()} == _brute_template([p for _, _, p in rows])


def test_nothing_else_is_dropped(spark):
    inner = "<p>one</p><div hidden>two</div><p style='display:none'>three</p><p><svg><text>four</text></svg></p><p><math><mi>five</mi></math></p><p><video>six</video></p><p><object>seven</object></p>"
    df = spark.createDataFrame([(1, "http://a.test/1", f"<html><body><nav>no</nav><article>{inner}</article></body></html>")], "page_id long, url string, html string")
    assert html_template.main_text(df).first()["text"].split() == "one two three four five six seven".split()
