"""Labelled training pages: page layouts in common use with known main text.

Each layout wraps an article and its surroundings in the markup that sites use; words are drawn
at random, so that a model learns from structure and text shape rather than from vocabulary.
"""

from __future__ import annotations

import random

# Fixed values: (opening tag, kind) of the article's wrapper; an empty name leaves only text shape.
CONTENT = (
    "<article>", "<main>", "<main><article>", "<div class=content>", '<div id="content">', '<div class="post-body">',
    '<div class="entry-content">', '<section class="story">', '<div role="main">', '<div class="article-text">',
    '<article class="post">', "<div>", "<section>", "<table><tr><td>", '<div class="page-wrap"><div class="text">',
)
SURROUNDINGS = {
    "nav": ("<nav>", '<div class="nav">', '<ul class="menu">', '<div id="navbar">', '<div role="navigation">',
            '<div class="breadcrumbs">', '<div class="pagination">', '<ul class="tabs">', '<div class="toc">', "<menu>"),
    "header": ("<header>", '<div class="header">', '<div id="masthead">', '<div class="site-branding">',
               '<div role="banner">', '<div class="topbar">'),
    "footer": ("<footer>", '<div class="footer">', '<div id="colophon">', '<div role="contentinfo">',
               '<div class="copyright">', '<div class="legal">'),
    "side": ("<aside>", '<div class="sidebar">', '<div class="widget">', '<div id="related">',
             '<section class="recommended">', '<div class="trending">', '<div role="complementary">', '<div class="more-stories">'),
    "ad": ('<div class="ad">', '<div class="ads">', '<div class="advert">', '<div id="banner-ad">',
           '<div class="sponsored">', '<div class="promo">', '<ins class="adsbygoogle">', '<p class="advertisement">'),
    "notice": ('<div class="cookie-notice">', '<div id="consent">', '<div class="alert">', '<div class="notice">',
               '<div role="dialog">', "<dialog>", '<div class="gdpr popup">', '<div class="paywall">'),
    "form": ("<form>", '<form class="search">', '<div class="newsletter">', '<form id="signup">', '<div class="subscribe">',
             "<fieldset>"),
    "share": ('<div class="share">', '<ul class="social">', '<div class="follow-us">', '<div class="tags">'),
    "comments": ('<section class="comments">', '<div id="comments">', '<ol class="comment-list">',
                 '<div class="discussion">', '<div id="respond">', '<div class="reader-comments">', '<div class="replies">'),
}
PHRASES = {
    "footer": ("© {w} {w}. All rights reserved.", "&copy; 2021 {w}", "{w} &middot; {w} &middot; {w}", "&copy; {w}.example.com &middot; {s}"),
    "notice": ("We use cookies. {s}", "{s} Accept", "By using this site you agree. {s}"),
    "form": ("Subscribe to {w}", "Your email", "Search", "{w} {w}:"),
    "share": ("Share on {w}", "Tweet", "Follow {w}"),
    "comments": ("{w} says:", "Reply", "{s}", "{s} {s}", "Posted by {w} on 3 May 2020"),
    "side": ("Related: {w} {w}", "{s}", "{w} {w} {w}"),
    "ad": ("{s}", "Advertisement", "{s} {s}", "Buy {w} now!"),
    "header": ("{w} {w}", "{w}", "{s}"),
}


class Words:
    def __init__(self, rng: random.Random):
        self.rng = rng

    def word(self) -> str:
        return "".join(self.rng.choices("etaoinshrdlucmféüñ", k=self.rng.choice((2, 3, 4, 5, 7, 9))))

    def sentence(self, most: int = 22) -> str:
        words = [self.word() for _ in range(self.rng.randint(1, most))]
        return " ".join(words).capitalize() + self.rng.choice("....?!")

    def fill(self, phrase: str) -> str:
        while "{w}" in phrase:
            phrase = phrase.replace("{w}", self.word().capitalize(), 1)
        while "{s}" in phrase:
            phrase = phrase.replace("{s}", self.sentence(), 1)
        return phrase

    def paragraph(self) -> str:
        if self.rng.random() < 0.15:  # prose without sentences: rows, lists, fragments
            return self.rng.choice((" ", ", ", " | ")).join(self.word() for _ in range(self.rng.randint(2, 40)))
        return " ".join(self.sentence() for _ in range(self.rng.choice((1, 1, 2, 3, 5, 8))))


def _closing(opening: str) -> str:
    tags = [t.split(">")[0].split()[0] for t in opening.split("<")[1:]]
    return "".join(f"</{t}>" for t in reversed(tags))


def _surrounding(kind: str, w: Words) -> str:
    rng = w.rng
    opening = rng.choice(SURROUNDINGS[kind])
    parts = []
    if kind in ("nav", "share") or rng.random() < 0.25:
        items = "".join(f'<li><a href="/{i}">{w.word()}</a></li>' for i in range(rng.randint(2, 7)))
        parts.append(items if opening.startswith("<ul") else f"<ul>{items}</ul>")
    if kind not in ("nav",):
        for _ in range(rng.randint(1, 4 if kind == "comments" else 2)):
            tag = rng.choice(("p", "div", "", "span", "h3", "li") if kind != "comments" else ("p", "div", "li", "p"))
            text = w.fill(rng.choice(PHRASES.get(kind, ("{s}",))))
            parts.append(f"<{tag}>{text}</{tag}>" if tag else text)
    return opening + "".join(parts) + _closing(opening)


MARK = "\x01"  # put before the text of main blocks and taken away when the page is read


def _article(w: Words) -> str:
    rng = w.rng
    out = []
    if rng.random() < 0.8:
        title = w.sentence(10)
        out.append(f"<h1>{MARK}{title if rng.random() < 0.5 else title[:-1]}</h1>")
    if rng.random() < 0.3:
        out.append(f'<p class="byline">{MARK}{w.word().capitalize()} {w.word()}</p>')
    for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 9))):
        kind = rng.random()
        text = f"{MARK}{w.paragraph()}"
        if kind < 0.6:
            out.append(f"<p>{text}</p>" if rng.random() < 0.7 else f"<p><b>{text}<br>")
        elif kind < 0.7:
            out.append(f"<h2>{MARK}{w.sentence(6)}</h2><p>{text}</p>")
        elif kind < 0.78:
            items = "".join(f"<li>{MARK}{w.sentence(9)}</li>" for _ in range(rng.randint(2, 5)))
            out.append(f"<ul>{items}</ul>")
        elif kind < 0.84:
            out.append(f"<blockquote>{text}</blockquote>")
        elif kind < 0.88:
            out.append(f"<pre>{text}</pre>")
        elif kind < 0.92:
            out.append(f"<figure><figcaption>{MARK}{w.sentence()}</figcaption></figure>")
        elif kind < 0.95:
            out.append(f"<table><tr><td>{MARK}{w.word()}</td><td>{MARK}{w.sentence(4)}</td></tr></table>")
        else:
            out.append(f'<p>{text} <a href="/x">{w.word()} {w.word()}</a>.</p>')
        if rng.random() < 0.08:
            out.append(_surrounding(rng.choice(("ad", "share", "side", "form", "notice")), w))
    return "".join(out)


def page(seed: int) -> str:
    """One page; the text of each main block begins with MARK."""
    rng = random.Random(seed)
    w = Words(rng)
    parts = []
    for kind, odds in (("notice", 0.3), ("header", 0.6), ("nav", 0.9), ("form", 0.2), ("ad", 0.5), ("side", 0.3)):
        if rng.random() < odds:
            parts.append(_surrounding(kind, w))
    opening = rng.choice(CONTENT)
    if rng.random() < 0.25:
        opening = rng.choice(("<div>", '<div class="row">', "<section>")) + opening
    parts.append(opening + _article(w) + _closing(opening))
    for kind, odds in (
        ("share", 0.3), ("ad", 0.3), ("comments", 0.5), ("side", 0.5), ("form", 0.3), ("nav", 0.2), ("notice", 0.2), ("footer", 0.9),
    ):
        if rng.random() < odds:
            parts.append(_surrounding(kind, w))
    body = "".join(parts)
    for _ in range(rng.choice((0, 0, 1, 2))):
        opening = rng.choice(("<div>", '<div class="wrapper">', '<div id="page">', "<center>", '<div class="container">'))
        body = opening + body + _closing(opening)
    return f"<!DOCTYPE html><html><head><title>{w.sentence(6)}</title></head><body>{body}</body></html>"
