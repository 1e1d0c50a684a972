"""Main text of HTML pages by the line-block distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import ship

#: Lines in a block, and the text length of a block from which it counts as content.
WIDTH = 3
SURGE = 80
#: How often a character inside <article> or <main> counts.
MARK = 4

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|noscript|template|iframe|svg|annotation|textarea|select|button|object|canvas|title)\b"
    r"(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</\1\s*>|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_UNSEEN = re.compile(r"(?:\A|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b", re.I)
_PARTS = re.compile(r"[-_:]+")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rp rt s "
    "samp small span strike strong sub sup time tt u var wbr img input br "
    "math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle msup msub msubsup mover munder munderover semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_ASIDE = frozenset("nav footer aside form menu dialog head".split())
_MAIN = frozenset("article main".split())
_CELLS = ("td", "th", "caption")
_TABLE = frozenset("tr td th thead tbody tfoot caption colgroup".split())
_IN_HEAD = frozenset("head meta link base basefont bgsound".split())
#: Start tags that end an open <p>, and those that end others: which, and within what.
_ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
_IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu", *_CELLS)),
    "dt": (("dt", "dd"), ("dl", *_CELLS)),
    "dd": (("dt", "dd"), ("dl", *_CELLS)),
    "td": (("td", "th", "caption", "colgroup"), ("table",)),
    "th": (("td", "th", "caption", "colgroup"), ("table",)),
    "tr": (("tr", "caption", "colgroup"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot", "tr", "caption", "colgroup"), ("table",)),
    "thead": (("thead", "tbody", "tfoot", "tr", "caption", "colgroup"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot", "tr", "caption", "colgroup"), ("table",)),
    "option": (("option",), ("datalist", *_CELLS)),
    "optgroup": (("option", "optgroup"), ("datalist", *_CELLS)),
}
_NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion "
    "sidebar nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies "
    "consent gdpr notice notices alert popup modal overlay newsletter subscribe signup comment comments "
    "reply replies disqus respond share sharing social related recommended widget toolbar pagination "
    "pager login search contentinfo complementary dialog form copyright".split()
)
_NOT_NOISE = frozenset("article main content post entry body story text".split())
#: Of readers, also beside a word of content, as in post-comments.
_READERS = frozenset("comment comments reply replies disqus respond".split())
#: What says how a page is laid out, as in no-sidebar.
_LAYOUT = frozenset("has no with without is".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())


def _attributes(raw: str) -> dict[str, str]:
    """The attributes of a tag, of a repeated one the first; those without a value have ''."""
    found: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(raw):
        found.setdefault(name.lower(), unescape("".join(values)))
    return found


def _is_noise(tag: str, attributes: str, in_main: bool) -> bool:
    """Whether the element's tag, a hidden attribute or style, or its names say noise.

    A class counts whole or by its first or last part, beside no word of content. An id
    does so outside articles, with two parts at most; inside them it counts whole, and on
    headings and inline elements, where it is the target of a link, not at all. A role
    counts whole. No other attribute is looked at.
    """
    if tag in _ASIDE or tag == "header" and not in_main:
        return True
    if not attributes:
        return False
    has = _attributes(attributes)
    if has.get("hidden", "until-found").lower() != "until-found" or _UNSEEN.search(has.get("style", "")):
        return True
    if tag in _MAIN or tag in ("body", "html"):
        return False
    if has.get("role", "").strip().lower() in _NOISE:
        return True
    classes = [_PARTS.split(name) for name in has.get("class", "").lower().split()]
    of_content = any(_NOT_NOISE.intersection(parts) for parts in classes)
    if any(_names_noise(parts, of_content, tag) for parts in classes):
        return True
    if tag in _HEADINGS or tag in _INLINE:
        return False
    parts = _PARTS.split(has.get("id", "").strip().lower())
    return len(parts) <= (1 if in_main else 2) and _names_noise(parts, bool(_NOT_NOISE.intersection(parts)), tag)


def _names_noise(parts: list[str], of_content: bool, tag: str) -> bool:
    if parts[0] in _LAYOUT:
        return False
    ends = {parts[0], parts[-1]}
    if tag in _HEADINGS:
        ends.discard("header")
    return bool(ends & _READERS) or not of_content and bool(ends & _NOISE)


def blocks_of(html: str) -> list[tuple[str, int]]:
    """The page's blocks in order: text, '' where something was taken out, and the article's number or 0.

    What its name marks as noise is taken out, but not what holds more than half of the
    page's text (of a footer and the like, half of the text in articles). There, text in
    links does not count, and in articles it counts MARK times.
    """
    blocks: list[tuple[str, int]] = []
    counts: list[int] = []  # what each block's text counts
    # of each element named so its first block, the one after its last, and whether its tag says it
    noise: list[list[int]] = []
    part: list[str] = []
    at, main, articles, marked = 0, 0, 0, 0
    linked, in_link = 0, False
    # open elements: tag, and the number of its noise or -1; and where each tag is open
    stack: list[tuple[str, int]] = []
    where: dict[str, list[int]] = {}

    def close() -> None:
        nonlocal linked
        if part:
            text = " ".join(unescape("".join(part)).split())
            part.clear()
            if text:
                blocks.append((text, articles if main else 0))
                counts.append(max(0, len(text) - linked) * (MARK if main else 1))
        linked = 0

    def put(text: str) -> None:
        nonlocal linked
        part.append(text)
        if in_link:
            linked += len(text)

    def end(tags: tuple[str, ...], inside: tuple[str, ...]) -> None:
        """Close the outermost of `tags` that is open within the innermost of `inside`, and all in it."""
        nonlocal main, marked
        if not any(map(where.get, tags)):
            return
        least = max((where[t][-1] for t in inside if where.get(t)), default=-1)
        to = min((where[t][-1] for t in tags if where.get(t) and where[t][-1] > least), default=len(stack))
        while len(stack) > to:
            tag, nth = stack.pop()
            where[tag].pop()
            if tag in _MAIN or nth >= 0:
                close()
            main -= tag in _MAIN
            if nth >= 0:
                noise[nth][1] = len(blocks)
                marked -= tag in _INLINE

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            put(html[at : m.start()])
        at = m.end()
        tag = m.group(3)
        if tag is None:
            if m.group(1):
                part.append(" ")
            continue
        tag, attributes = tag.lower(), m.group(4)
        ending = bool(m.group(2))
        alone = tag in _VOID or attributes.endswith("/")
        if tag == "a":
            in_link = not ending and "href" in attributes.lower()
        if tag in _INLINE:
            if tag == "br":
                part.append(" ")
            if ending:
                end((tag,), _CELLS)
            elif not alone:
                is_noise = _is_noise(tag, attributes, main > 0)
                if is_noise:
                    close()
                    noise.append([len(blocks), -1, 0])
                    marked += 1
                if marked:
                    where.setdefault(tag, []).append(len(stack))
                    stack.append((tag, len(noise) - 1 if is_noise else -1))
            continue
        close()
        if ending:
            if not alone:
                end((tag,), () if tag in _MAIN or tag == "table" else ("table",) if tag in _TABLE else _CELLS)
            continue
        if tag in _ENDS_P:
            end(("p",), _CELLS)
        if tag in _IMPLIED:
            end(*_IMPLIED[tag])
        if where.get("head") and tag not in _IN_HEAD:
            end(("head",), ())
        if alone or tag in ("html", "body"):
            continue
        is_noise = _is_noise(tag, attributes, main > 0)
        if is_noise:
            noise.append([len(blocks), -1, tag in _ASIDE and tag != "form"])
        where.setdefault(tag, []).append(len(stack))
        stack.append((tag, len(noise) - 1 if is_noise else -1))
        if tag in _MAIN:
            articles += main == 0
            main += 1
    if at < len(html):
        # a tag that the page's end cuts off is no text
        put(re.sub(r"<[a-zA-Z/!?][^<]*\Z", "", html[at:]))
    close()
    return _without(blocks, counts, noise)


def _without(
    blocks: list[tuple[str, int]], counts: list[int], noise: list[list[int]]
) -> list[tuple[str, int]]:
    """`blocks` with '' for each outermost noise that holds no more than half of what counts."""
    every = [0, *accumulate(counts)]
    inside = [0, *accumulate(c if article else 0 for c, (_, article) in zip(counts, blocks))]
    kept: list[tuple[str, int]] = []
    done = 0
    for a, z, by_tag in noise:
        z = len(blocks) if z < 0 else z
        upto = inside if by_tag else every
        if a < done or 2 * (upto[z] - upto[a]) > upto[-1]:
            continue
        kept += blocks[done:a]
        kept.append(("", blocks[a][1] if a < len(blocks) else 0))
        done = z
    return kept + blocks[done:]


def main_text(html: str | None) -> str:
    """The blocks between surges and dives of the block distribution, joined by one space.

    Line i's block is the text of lines i to i + WIDTH - 1. The text surges where a block
    reaches SURGE, and dives where a whole block is empty. Lines outside articles are one
    sequence, in which articles leave no gap. Each article is one of its own, where a
    character counts MARK times; its tags are its surge and dive if its text surges
    anywhere. The stretch with the highest count is taken, with the others of at least a
    quarter as much, so one outside stays if it is as long as the longest article.
    """
    if not html:
        return ""
    blocks = blocks_of(html)
    lines: dict[int, list[int]] = {}
    for i, (_, article) in enumerate(blocks):
        lines.setdefault(article, []).append(i)
    runs: list[tuple[list[int], int]] = []
    for article, own in lines.items():
        sizes = [len(blocks[i][0]) * (MARK if article else 1) for i in own]
        found = _stretches(sizes)
        if article and found:
            found = [(0, len(own))]
        runs += [(own[a:z], sum(sizes[a:z])) for a, z in found]
    if runs:
        most = max(size for _, size in runs)
        taken = sorted(i for own, size in runs if 4 * size >= most for i in own)
    else:
        inside = sum(len(text) for text, article in blocks if article)
        outside = sum(len(text) for text, article in blocks if not article)
        taken = [i for i, (_, article) in enumerate(blocks) if article or MARK * inside < outside]
    return " ".join(blocks[i][0] for i in taken if blocks[i][0])


def _stretches(sizes: list[int]) -> list[tuple[int, int]]:
    """(surge, dive) of each stretch of lines."""
    n = len(sizes)
    total = [sum(sizes[i : i + WIDTH]) for i in range(n)]
    found = []
    i = 0
    while i < n:
        if total[i] < SURGE:
            i += 1
            continue
        end = i
        while end < n and total[end] > 0:
            end += 1
        found.append((i, end))
        i = end
    return found


def extract_pages(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(page_id, url, text, n_chars) for each row; null, empty or textless html has ''.

    Nothing but the html of its own row enters a result: null ids and urls stay null,
    repeated rows repeat their result, other columns are not read.
    """

    def extract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame(
                {"page_id": b["page_id"].astype("Int64"), "url": b["url"], "text": text, "n_chars": [len(t) for t in text]}
            )

    rows = ship(pages).select(
        F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")
    )
    return rows.mapInPandas(extract, "page_id bigint, url string, text string, n_chars bigint")
