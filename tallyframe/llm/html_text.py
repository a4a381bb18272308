"""Operator 4: the main text of web pages by the distribution of text over line blocks.

Markup is stripped to lines: a block-level tag ends a line, an inline tag does not. Lines of menus, headers, footers,
sidebars, notices, adverts, forms and reader comments, told by their elements, are taken out; lines that are mostly
links count as empty. Text lengths are summed over a window of lines that slides down the page. The text surges where a
sum rises above a threshold and dives where it falls to nothing. A surge is widened back over the lines that lead to it;
the main text is every stretch from the first surge to the last dive. What lies in a dive, a list of links, is not text;
fewer lines of links inside a stretch, or beside its ends in the same element, are. Marks of articles choose nothing: they
only say that links are part of a line's text, that where an article begins or ends a stretch does, and that of stretches
without a surge between others those stay that are, as the others, inside or outside of articles.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts

WINDOW = 3
SURGE = 86  # characters in a window

# Element names of HTML and names that pages give to what is not their text.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark meter output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
SKIPPED = frozenset("nav header footer aside form button select textarea dialog menu fieldset option datalist head title".split())
RAW = frozenset("script style noscript template svg math iframe object canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
ARTICLE = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar alertdialog".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement adsense banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar aside footer header masthead cookie cookies consent"
    " notice notification alert popup modal overlay newsletter subscribe signup login share sharing social related recommended pagination pager comment comments commentlist disqus replies respond widget toolbar skip".split()
)
#: What else a name of several words may consist of and still be that of a page part: `cookie-bar`, not `cookie-recipes`.
PARTS = frozenset(
    "site page main top bottom left right side box block list bar wrap wrapper container section area link links button buttons post posts article articles story stories item items icon icons form panel slot"
    " unit inner outer group row column col primary secondary global mobile desktop sticky fixed center middle small large text title content body message module to".split()
)
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']+|\"[^\"]*\"|'[^']*')*+)[^>]*>", re.S)
_CLOSED = re.compile(r"\A<!---?>\Z|--!?>\Z")
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


def names_a_part(value: str) -> bool:
    """Whether a class or id names a part of a page that is not its text: one of its names is in NAMES, or is made of words
    of which one is and all others are in PARTS or numbers."""
    for name in value.lower().split():
        words = [w for w in re.split("[_-]+", name) if w]
        if any(w in NAMES for w in words) and all(w in NAMES or w in PARTS or w.isdigit() for w in words):
            return True
    return False


def _not_text(tag: str, attributes: str) -> bool:
    if tag in SKIPPED:
        return True
    if not attributes or tag in ("body", "html", "article", "main") and "comment" not in attributes.lower():
        return False
    for name, a, b, c in _NAMED.findall(attributes):
        value = a or b or c
        name = name.lower()
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "role" and value.lower() in ROLES or name in ("class", "id") and names_a_part(value):
            return True
    return False


def lines(page: str) -> list[tuple[str, int, int, bool, int]]:
    """(text, characters in links, number of the article it is in or 0, is not text, number of its element) of each line of a page."""
    out: list[tuple[str, int, int, bool, int]] = []
    text: list[str] = []
    link = 0
    stack: list[tuple[str, bool, int, int]] = []  # open elements: name, skipped, article, number
    held: Counter[str] = Counter()  # how many of each are open
    articles = elements = at = 0
    n = page.rfind(">") + 1  # no markup ends behind it
    if 0 <= (left := page.find("<!--", n)):
        page = page[:left]  # a comment that is never closed

    def end_line():
        nonlocal link
        whole = " ".join("".join(text).split())
        if whole:
            _, skip, inside, element = stack[-1] if stack else ("", False, 0, 0)
            out.append((whole, link, inside, skip, element))
        text.clear()
        link = 0

    def leave(tag):
        nonlocal links
        gone = None
        while gone != tag:
            gone = stack.pop()[0]
            held[gone] -= 1
            links = 0

    links = 0
    while at < len(page):
        m = _TOKEN.search(page, at, n)
        got = page[at : m.start() if m else len(page)]
        if got:
            got = html.unescape(got)
            text.append(got)
            if links:
                link += len(got.strip())
        if not m:
            break
        at = m.end()
        if not m[2]:
            if at == n and m[0].startswith("<!--") and not _CLOSED.search(m[0]):
                break  # so is this one
            continue
        tag = m[2].lower()
        if tag in RAW and not m[1]:
            if m[3].rstrip().endswith("/") and tag in ("svg", "math"):
                continue
            close = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag in INLINE:
            if tag == "a":
                links = 0 if m[1] else 1
            if not m[1] and tag not in VOID and m[3] and _not_text(tag, m[3]):
                end_line()
                stack.append((tag, True, stack[-1][2] if stack else 0, 0))
                held[tag] += 1
            elif m[1] and stack and stack[-1][0] == tag:
                end_line()
                stack.pop()
                held[tag] -= 1
            continue
        end_line()
        if tag in VOID:
            continue
        if held["p"]:  # only paragraphs that are not text are held; a block's tag ends one that is open
            leave("p")
        if tag == "p":
            if not m[1] and m[3] and _not_text(tag, m[3]):
                stack.append((tag, True, stack[-1][2] if stack else 0, 0))
                held[tag] += 1
            continue
        if m[1]:
            if held[tag]:
                leave(tag)
        else:
            skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, 0)
            skip = skip or _not_text(tag, m[3])
            if tag in ARTICLE or re.search(r"role\s*=\s*[\"']?main\b", m[3] or "", re.I):
                if not inside or tag == "article" and not held["article"]:
                    articles += 1
                    inside = articles
            elements += 1
            stack.append((tag, skip, inside, elements))
            held[tag] += 1
    end_line()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    got: list = []
    for line in lines(page):
        if line[3]:
            continue
        if got and (got[-1][2] > 0) != (line[2] > 0):  # where an article begins or ends the window sums fall to nothing
            got += [_GAP] * (WINDOW + 1)
        got.append(line)
    size = np.array([len(t) for t, *_ in got], dtype=np.int64)
    inside = np.array([a for _, _, a, _, _ in got], dtype=np.int64)
    linked = np.array([2 * link > len(t) for t, link, *_ in got], dtype=bool)
    size[linked & (inside == 0)] = 0
    keep = np.zeros(len(size), dtype=bool)
    found = _stretches(size)
    kinds = {inside[first] > 0 for first, _, surged in found if surged}
    for first, last, surged in found:
        if kinds and not surged and (inside[first] > 0) not in kinds:
            continue  # few words between articles, or an article of few words between other text
        keep[first:last] = True
        for at, step in ((first, -1), (last - 1, 1)):
            own = at + step
            while 0 <= own < len(size) and not size[own] and got[own][4] == got[at][4]:
                own += step
            if abs(own - at) <= WINDOW:
                keep[min(own - step, at) : max(own - step, at) + 1] = True
    return " ".join(line[0] for line, k in zip(got, keep) if k and line[0])


_GAP = ("", 0, -1, False, -1)


def _stretches(size: np.ndarray) -> list[tuple[int, int, bool]]:
    """Lines of each stretch from the first surge to the last dive, and whether the text surges in it."""
    on = np.flatnonzero(size)
    if not on.size:
        return []
    sums = np.convolve(size, np.ones(WINDOW, dtype=np.int64))[WINDOW - 1 :]
    starts = np.flatnonzero(np.diff(on, prepend=-WINDOW - 1) > WINDOW)  # after a dive, or the page's first
    ends = np.append(starts[1:], on.size) - 1
    surged = np.searchsorted(starts, np.flatnonzero(sums[on] > SURGE), "right") - 1
    first, last = (surged[0], surged[-1]) if surged.size else (0, len(starts) - 1)  # a page of few words: all of them
    own = np.isin(np.arange(len(starts)), surged)
    return [(int(on[a]), int(on[b]) + 1, bool(s)) for a, b, s in zip(starts[first : last + 1], ends[first : last + 1], own[first : last + 1])]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points of text).

    Null, empty and text-free pages give an empty text. Broken markup (elements left open, stray ends, `<` in text)
    is read as browsers do in the main: an element left open lasts to the end of what holds it. No shuffle.
    """
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(page).cast("string").alias("html"))
    got = map_texts(rows, "html", lambda: lambda texts: [[main_text(t) for t in texts]], "text string")
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
