"""Article text in blocks whose names hold a boilerplate word, in short and long articles."""

import random

import pytest

from tidemark.llm import html


def pages_of(spark, made):
    return {r["page_id"]: r["text"] for r in html.extract_main_text(spark.createDataFrame([(i, f"http://h/{i}", h) for i, h in enumerate(made)], "page_id long, url string, html string")).collect()}


def words(rng, n=12):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) + str(rng.randrange(1000)) for _ in range(n))


def test_names_are_boilerplate_as_a_whole():
    assert all(map(html.boilerplate_name, ["ad", "share", "share-buttons", "site-footer", "cookie-notice", "social_share", "nav-menu-items", "comment-list", "side-bar", "legal", "post-tags", "ads2".replace("2", "")]))
    assert not any(map(html.boilerplate_name, ["share-price", "search-analysis", "legal-analysis", "header2024news", "adventure", "story", "", "navigator", "comments-of-the-judge"]))


@pytest.mark.parametrize("n", [1, 30, 150])
@pytest.mark.parametrize("name", ["search-analysis", "legal-analysis", "share-price"])
def test_text_under_such_a_name_stays(spark, n, name):
    rng = random.Random(n)
    want, made = [], []
    for i in range(n):
        body, extra = words(rng, 40), words(rng)
        block = f'<div class="{name}"><p>{body}</p></div>'
        more = f'<div class="{name}">{extra}</div>' if i % 2 else ""
        made.append(f"<html><body><nav>Home News</nav><article><h1>Title {i}</h1>{block}{more}</article><div class='share-buttons'>tweet this</div><footer>All rights</footer></body></html>")
        want.append(f"Title {i} {body}" + (f" {extra}" if i % 2 else ""))
    assert pages_of(spark, made) == dict(enumerate(want))


@pytest.mark.parametrize("blocks", [6, 80])
def test_long_articles_are_judged_as_short_ones(spark, blocks):
    """A named block that stands once in each article, after few or many different blocks."""
    rng = random.Random(blocks)
    want, made = [], []
    for i in range(30):
        parts = [(f"b{k}", words(rng, 5)) for k in range(blocks)]
        rng.shuffle(parts)
        legal = words(rng, 8)
        made.append("<article><h1>T</h1>" + "".join(f'<div class="x{c}">{t}</div>' for c, t in parts) + f'<div class="legal">{legal}</div></article>')
        want.append(" ".join(["T", *(t for _, t in parts), legal]))
    assert pages_of(spark, made) == dict(enumerate(want))
