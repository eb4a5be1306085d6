"""Leaf blocks of an HTML page: their text, the tags and names above them, their link share."""

from __future__ import annotations

import html
import re
from collections import Counter
from dataclasses import dataclass

# Elements that start and end a block, those without content, those whose content
# is no text of the page, and those that end an open element of their own kind.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol "
    "optgroup option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = "script|style|template|noscript|iframe|object|svg|math|textarea|canvas|audio|video|title"
ENDS_OWN = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"),
    "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
}
# A block that starts ends an open paragraph.
ENDS_P = BLOCKS - {"button", "label", "option", "optgroup", "legend", "caption"}
SCOPES = frozenset("table td th div section article main aside nav ul ol body".split())

# Possessive and never past the next "<": each character is looked at a bounded number of times.
_ATTRS = r"(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+"
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<hidden>{HIDDEN})\b{_ATTRS}>.*?(?:</(?P=hidden)\b[^>]*(?:>|\Z)|\Z)"
    rf"|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>{_ATTRS})>"
    r"|(?P<text>[^<]+|<)",
    re.S | re.I,
)
_NAMES = re.compile(r"(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDES = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)


@dataclass
class Block:
    text: str
    own: str  # the innermost open block element, "none" outside of all
    above: frozenset[str]  # all open block elements
    names: frozenset[str]  # words of class, id and role above the text
    links: float = 0.0  # share of the characters inside links


@dataclass
class _Open:
    """An open block element with what holds for everything in it: the sets are those of the
    element around it wherever it adds nothing, so that deep nesting shares them."""

    tag: str
    above: frozenset[str] = frozenset()
    names: frozenset[str] = frozenset()
    hidden: bool = False


def leaf_blocks(page: str | None) -> list[Block]:
    """Blocks with text in page order. Text is cut at block elements; character references are
    decoded, white space becomes one space; scripts, styles, comments and hidden parts are out."""
    out: list[Block] = []
    stack: list[_Open] = []
    texts: list[str] = []
    linked = in_link = 0
    in_head = False
    opened: Counter[str] = Counter()  # open elements by tag: a tag that is not open is not looked for
    outside = _Open("none")
    unseen, depth = "", 0  # the hidden inline element that is open, and how often within itself

    def flush():
        nonlocal linked, depth
        depth = 0  # an inline element ends with its block
        if not texts:
            return
        text = " ".join(html.unescape("".join(texts)).split())
        inner = stack[-1] if stack else outside
        if text and not inner.hidden and "head" not in inner.above:
            out.append(Block(text, inner.tag, inner.above, inner.names, min(1.0, linked / max(1, len(text)))))
        texts.clear()
        linked = 0

    def close(tags, scopes=frozenset()):
        if not any(opened[t] for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].tag in tags:
                opened.subtract(e.tag for e in stack[i:])
                del stack[i:]
                return
            if stack[i].tag in scopes:
                return

    for m in _TOKEN.finditer(page or ""):
        if (text := m["text"]) is not None:
            # the end tag of a head is optional: text, or a block of the body, ends it too
            if in_head and not text.isspace():
                flush()
                close(("head",))
                in_head = False
            if depth:
                continue
            texts.append(text)
            if in_link:
                linked += len(text.strip())
            continue
        if m["hidden"]:
            continue
        tag = (m["tag"] or "").lower()
        if tag not in BLOCKS and tag not in VOID:
            if depth:
                depth += (-1 if m["close"] else 1) if tag == unseen else 0
            elif not m["close"] and m["attrs"] and _HIDES.search(m["attrs"]) and not m["attrs"].rstrip().endswith("/"):
                unseen, depth = tag, 1
        if tag == "a":
            in_link = 0 if m["close"] else 1
        elif tag == "br":
            texts.append(" ")
        elif tag == "hr":
            flush()
        elif tag in BLOCKS:
            flush()
            in_link = 0 if tag not in ("h1", "h2", "h3", "h4", "div", "li", "p") else in_link
            if m["close"]:
                close((tag,))
                in_head = in_head and tag != "head"
                continue
            if in_head and tag not in ("html", "head"):
                close(("head",))
                in_head = False
            in_head = in_head or tag == "head"
            if tag in ENDS_P:
                close(("p",), SCOPES)
            if tag in ENDS_OWN:
                close(ENDS_OWN[tag], frozenset(("table", "ul", "ol", "dl", "select", "div", "section")))
            attrs = m["attrs"]
            names: set[str] = set()
            if attrs and not attrs.isspace():
                for found in _NAMES.findall(attrs):
                    names.update(w.lower() for w in _NAME.findall(" ".join(found)))
            around = stack[-1] if stack else outside
            above = around.above if tag in around.above else around.above | {tag}
            own = around.names if names <= around.names else around.names | names
            stack.append(_Open(tag, above, own, around.hidden or bool(attrs and _HIDES.search(attrs))))
            opened[tag] += 1
    flush()
    return out
