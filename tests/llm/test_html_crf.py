import html
import re
from itertools import product

import numpy as np
import pytest

from leafquery.llm.common import table
from leafquery.llm.html_crf import Block, Field, blocks_of, default_field, extract_pages, labelled_pages, path_features, text_features, train


@pytest.fixture(scope="module")
def model():
    return default_field()


def test_held_out_pages(model):
    test = labelled_pages(100, seed=99)
    right = sum(a == b for blocks, labels in test for a, b in zip(model.decode(blocks), labels, strict=True))
    assert right / sum(len(labels) for _, labels in test) > 0.98


def test_table_of_pages(spark, sf_dir, model):
    rows = {r.page_id: r for r in table(spark, sf_dir, "pages").collect()}
    got = extract_pages(table(spark, sf_dir, "pages"), model).collect()
    assert len(got) == len(rows)
    for r in got:
        inside = re.search(r"<article>(.*?)</article>", rows[r.page_id].html, re.S).group(1)
        want = " ".join(html.unescape(re.sub(r"<[^>]+>", " ", re.sub(r"</?b>", "", inside))).split())
        assert r.text == want and r.n_chars == len(want) and r.url == rows[r.page_id].url


def test_viterbi_equals_enumeration(model):
    rnd = np.random.default_rng(0)
    blocks = [Block("Some text here, for a test.", ("body|", "p|"), 0), Block("Home", ("body|", "nav|", "a|"), 4), Block("x", ("div|ad",), 0), Block("y z", ("article|", "p|"), 0)]
    for _ in range(20):
        f = Field({"bias": rnd.normal(), **{k: rnd.normal() for b in blocks for k in path_features(b.path)}}, rnd.normal(size=(2, 2)), rnd.normal(size=2), rnd.normal(size=2))
        e = f.emissions(blocks)
        value = lambda y: f.first[y[0]] + f.last[y[-1]] + sum(e[i] * v for i, v in enumerate(y)) + sum(f.step[a, b] for a, b in zip(y, y[1:]))  # noqa: B023, E731
        assert f.decode(blocks) == list(max(product((0, 1), repeat=4), key=value))


def test_training_raises_the_likelihood_to_the_optimum():
    pages = labelled_pages(12, seed=5)
    f = train(pages, rounds=200)
    assert np.mean([f.decode(b) == y for b, y in pages]) > 0.9


@pytest.mark.parametrize(
    "page, want",
    [
        ("<nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>two</b>\n three.<p>Four&nbsp;five.</article><footer>&copy; x</footer>", "A & B One two three. Four five."),
        ("<body><article><h1>Title</h1><p>Text of it, long enough to be read by all of us.</p></article><section id=comments><h3>Comments</h3><div class=comment><p>I like it, thank you very much.</p></div></section>", "Title Text of it, long enough to be read by all of us."),
        ("<article><p>Keep this sentence, it is the story.</p><script>var a = '<p>no</p>';</script><style>p{}</style><form><label>Name</label><input></form></article>", "Keep this sentence, it is the story."),
        ("", ""),
        ("<<<>>><!-- open", None),
        ("<p>" * 3000 + "deep" + "<div>" * 2000, None),
    ],
)
def test_pages(model, page, want):
    got = model.extract(page)
    assert want is None or got == want


def test_blocks():
    assert text_features("x", 1, 0.0) and not blocks_of("<script>x</script><title>t</title>")


def test_odd_rows(spark, model):
    rows = [(1, None, None, 1), (None, "u", "", 2), (2, "u", "<article><p>" + "Word and word, more. " * 30000 + "</p></article>", 3), (2, "u", "plain text without any tag", 4), (2, "u", "plain text without any tag", 4)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, text int"), model).collect()
    assert len(got) == 5 and [r.text for r in got][:2] == ["", ""] and max(r.n_chars for r in got) == len(("Word and word, more. " * 30000).strip())
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string"), model).count() == 0


def test_stray_quotes_and_unclosed_tags():
    import time

    from leafquery.llm.html_crf import blocks_of

    assert [b.text for b in blocks_of("<article><p title=it's>Hello there, it's fine</p><p class='a > b'>Next</p></article>")] == ["Hello there, it's fine", "Next"]
    assert [b.text for b in blocks_of("<html><head><title>t</title><p>No end of head, no body")] == ["No end of head, no body"]
    began = time.time()
    for page in ("<a " * 350_000, "<a x='" * 200_000, "<p>" + "<" * 500_000, "<b x=" * 200_000, "<!--" * 200_000):
        blocks_of(page)
    assert time.time() - began < 20
