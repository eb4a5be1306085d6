"""Main-text extraction: a linear-chain CRF over the leaf blocks of a page.

Each block's features come from the tags above it, the words of their class, id and role, and the
shape of its text; the CRF is trained on labelled pages (``labelled_pages``), whose number is a
parameter, and decodes each page by Viterbi. Pages are row-local work: no shuffle.

Defined results: a null or empty page and a page without main text give the empty string;
repeated rows get equal rows; an empty table gives an empty result; only id, url and html are
read.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import map_slices
from .crf import Crf, train
from .html_blocks import Block, leaf_blocks
from .labelled_pages import MARK, page

TRAINING_PAGES = 400

# Words of class, id and role names by what they tell of the part they name.
NAMES = {
    "nav": "nav navigation menu navbar breadcrumb breadcrumbs toc pagination pager tabs skip sitemap",
    "ad": "ad ads advert adverts advertisement adsense adsbygoogle sponsor sponsored promo promoted promotion commercial",
    "comment": "comment comments disqus reply replies discussion respond reader reviews",
    "side": "sidebar side widget rail related recommended recommendations popular trending complementary teaser teasers more latest",
    "footer": "footer colophon copyright legal contentinfo imprint",
    "header": "header masthead branding logo topbar banner",
    "notice": "cookie cookies consent notice notification alert gdpr popup modal toast dialog warning paywall disclaimer",
    "form": "form newsletter subscribe subscription signup login register search contact",
    "share": "share sharing social follow tags print",
    "main": "content article post entry story main body text articlebody",
}
_GROUP = {w: g for g, words in NAMES.items() for w in words.split()}
_TAGS = frozenset(
    "article aside button details dialog dl fieldset figure footer form header label main menu nav select table ul ol".split()
)
# Wording of notices, forms and comments, looked for in blocks of under 50 words.
_CUES = {
    "copyright": ("©", "(c) ", "copyright", "all rights reserved", "tous droits", "alle rechte", "derechos reservados"),
    "cookie": ("cookie", "privacy policy", "terms of use", "terms of service"),
    "call": ("subscribe", "sign up", "log in", "login", "newsletter", "share on", "tweet", "follow", "reply",
             "advertisement", "sponsored", "read more"),
    "said": (" says", " wrote", "posted by", "commented"),
}
_STEPS = (2, 5, 10, 20, 50)


def _place_features(b: Block) -> frozenset[str]:
    """What the tags and names above a block tell, whatever its text."""
    groups = {g for w in b.names if (g := _GROUP.get(w))}
    above = _TAGS.intersection(b.above)
    found = {"bias", f"own={b.own}"}
    found.update(f"name={g}" for g in groups)
    found.update(f"above={t}" for t in above)
    if not groups and not above & {"nav", "aside", "footer", "header", "form", "menu", "dialog"}:
        found.add("plain")
    return frozenset(found)


def block_features(blocks: list[Block]) -> list[set[str]]:
    out, places = [], {}
    for i, b in enumerate(blocks):
        key = (b.own, b.above, b.names)
        if key not in places:
            places[key] = _place_features(b)
        found = set(places[key])
        words = b.text.count(" ") + 1
        size = sum(words >= s for s in _STEPS)
        found.add(f"size={size}")
        found.add(f"own={b.own} size={size}")
        if "plain" in found:
            found.add(f"plain size={size}")
        found.add("link=" + ("0" if b.links == 0 else "1" if b.links < 0.3 else "2" if b.links < 0.8 else "3"))
        found.add("stop" if b.text[-1] in ".!?…:;\"”)" else "no stop")
        if size < 5:
            low = b.text.lower()
            found.update(f"cue={c}" for c, cues in _CUES.items() if any(cue in low for cue in cues))
        found.add(f"place={min(3, 4 * i // len(blocks))}")
        if i == 0 or i == len(blocks) - 1:
            found.add("first" if i == 0 else "last")
        out.append(found)
    return out


def labelled_sequence(text: str) -> tuple[list[set[str]], list[int]]:
    """Features and labels of a labelled page."""
    blocks = leaf_blocks(text)
    labels = [int(MARK in b.text) for b in blocks]
    kept = []
    for b, label in zip(blocks, labels, strict=True):
        b.text = " ".join(b.text.replace(MARK, " ").split()) or "."
        kept.append((b, label))
    return block_features([b for b, _ in kept]), labels


@lru_cache(maxsize=1)
def fit(pages: int = TRAINING_PAGES) -> Crf:
    return train([s for seed in range(pages) if (s := labelled_sequence(page(seed)))[0]])


def main_blocks(model: Crf, text: str | None) -> list[str]:
    blocks = leaf_blocks(text)
    return [b.text for b, label in zip(blocks, model.viterbi(block_features(blocks)), strict=True) if label]


def extract(
    pages: DataFrame, model: Crf | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """One row per input row: id, url, text (main blocks joined by a blank line), n_chars."""
    model = model or fit()
    schema = StructType(
        [pages.schema[id_col], pages.schema[url_col], StructField("text", StringType()), StructField("n_chars", LongType())]
    )

    def make():
        def rows(ids, urls, texts):
            for key, url, text in zip(ids, urls, texts, strict=True):
                found = "\n\n".join(main_blocks(model, text))
                yield key, url, found, len(found)

        return rows

    return map_slices(pages.select(F.col(id_col), F.col(url_col), F.col(html_col)), schema, make)
