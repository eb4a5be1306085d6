"""Cases in which an operator once did less than its whole job."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from cases import frame, prose
from test_operators import brute_substrings

from spendlens.llm import html_blocks, html_extract, labelled_pages, pii, simhash, substring


def test_seed_with_many_surroundings_is_hot(spark):
    """One short passage between 4,500 different texts: the true count reaches the hot seeds,
    although a flush sends a seed only twice, and the results are those of every window."""
    rng = np.random.default_rng(4)
    passage = "This footer stands below a third of all the documents there are, with its own words"
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz "))
    around = ["".join(letters[rng.integers(0, 27, 140)]) for _ in range(4500)]
    rows = [(i, a[:70] + passage + a[70:], "en", None, 223) for i, a in enumerate(around)]
    # some share a surrounding, so that there is something to remove
    rows += [(5000 + i, around[i][40:70] + passage + around[i][70:90], "en", None, 133) for i in range(50)]
    docs = frame(spark, rows, clashes=False)
    source = docs.selectExpr("doc_id as key", "doc_id as id", "xxhash64(text) as row", "text")
    seeds, hot = substring.repeated_seeds(source, substring.LENGTH, 4, substring.HOT_ROWS)
    common = Counter(s for r in rows for s in set(substring.phrases(r[1].encode())[2].tolist()))
    assert set(hot.tolist()) == {s for s, n in common.items() if n > substring.HOT_ROWS} != set()
    want = brute_substrings(rows)
    found = substring.dedup_substrings(docs).collect()
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == {
        (r[0], *want[r[0], r[1]]) for r in rows
    }
    assert sum(r.n_removed for r in found) > 0


@pytest.mark.parametrize(
    "text, kind, found",
    [
        ("mail jane{ at }example{ dot }org now", "email", "jane{ at }example{ dot }org"),
        ("mail jane< at >example.org now", "email", "jane< at >example.org"),
        ("mail jane[ @ ]example.org now", "email", "jane[ @ ]example.org"),
        ("mail jane@example[ dot ]org now", "email", "jane@example[ dot ]org"),
        ("mail jane@example dot com now", "email", "jane@example dot com"),
        ("mail jane [at] example dot com now", "email", "jane [at] example dot com"),
        ("mail jane dot doe [at] mail.example dot com now", "email", "jane dot doe [at] mail.example dot com"),
        ("mail a.b.c.d.e.f@example dot com now", "email", "a.b.c.d.e.f@example dot com"),
        ("mail jane at example dot jp now", "email", "jane at example dot jp"),
        ("mail jane at firm dot ru now", "email", "jane at firm dot ru"),
        ("mail jane @ example . com now", "email", "jane @ example . com"),
        ("mail jane. doe@ mail .example.org now", "email", "jane. doe@ mail .example.org"),
        ("call +49 one five one 2345 67890 now", "phone", "+49 one five one 2345 67890"),
        ("call plus 49 one five one 2345 67890 now", "phone", "plus 49 one five one 2345 67890"),
        ("host 192 dot 168 dot 0 dot 1 is up", "ip", "192 dot 168 dot 0 dot 1"),
        ("host one dot two dot three dot four is up", "ip", "one dot two dot three dot four"),
        ("host 192 point one six eight dot 0.1 is up", "ip", "192 point one six eight dot 0.1"),
    ],
)
def test_mixed_disguises(text, kind, found):
    base, every = pii.text_spans(text)
    assert [text[a:b] for a, k, b in every if k == kind] == [found]
    assert pii.masked(text) == text.replace(found, f"<{kind.upper()}>")


def test_no_number_without_four_parts():
    for text in ("see you @ home . It was late", "call +1 or 2 or one day", "look at the dot there", "1. 2. 3. 4 steps", "one point five dot", "ratio 300 dot 1 dot 1 dot 1", "see @example dot com"):
        assert pii.text_spans(text) == ([], []), text


@pytest.mark.parametrize("body", ["<body><p>{}</p>", "<body><div>{}</div></body></html>", "<p>{}", "{}", "<a href=x>{}</a>"])
def test_head_without_end_tag(body):
    head = '<html><head><meta charset="utf-8"><title>T</title>\n<link rel=x><script>s()</script> '
    text = "The whole article stands here."
    want = html_blocks.leaf_blocks(head + "</head>" + body.format(text))
    found = html_blocks.leaf_blocks(head + body.format(text))
    assert found == want and [b.text for b in found] == [text]


def test_page_without_head_end_tag():
    """The same text comes out of a page with and without the optional tag."""
    model = html_extract.fit()
    for seed in range(9000, 9010):
        page = labelled_pages.page(seed)
        assert "</head>" in page
        want = html_extract.main_blocks(model, page)
        assert want and html_extract.main_blocks(model, page.replace("</head>", "")) == want


def test_keep_one_of_each_component_when_ids_repeat(spark):
    """One id with two unrelated texts names two components: each keeps a document."""
    one, other = prose(21, 300), prose(22, 300)
    texts = [(7, one), (7, other), (8, one), (9, other), (None, prose(23, 300))]
    rows = [(i, t, "en", None, len(t)) for i, t in texts]
    docs = frame(spark, rows)
    kept = simhash.keep_one(docs).collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([texts[0], texts[1], texts[4]])
    assert kept and set(kept[0].asDict()) == set(docs.columns)
