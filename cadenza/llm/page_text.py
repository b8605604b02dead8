"""Main text of web pages by line-block distribution.

Markup is stripped from a page as if each tag of a container (div, section, list, table ...) stood on
a line of its own and each block (paragraph, heading, item, cell ...) on one too: tags leave blank
lines, blocks leave lines of text. A line's length is its characters outside of links. The sums of
lengths over sliding windows of ``WINDOW`` lines give the page's distribution. A region dives where a
whole window is empty (markup closing and opening containers, lists of links, what was stripped) and
surges where a window reaches the least size; all text between the ends of a region with a surge is kept.

What names itself as something else is stripped with its text and leaves an empty window: scripts,
styles, menus, forms and so on by tag, side bars, adverts, notices, comments and the like by tag,
role, class or id. If a page declares its main part (``main``, ``article``), lines outside of it have no length.

A page is one row and one Python call; pages never leave their partition.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Lines of a window; a surge's least size in characters, and in shares of the page's largest window for pages with little text.
WINDOW, SURGE, SHARE = 3, 86, 0.5
#: The part of a page's text that several declared articles must hold to be its main part.
DECLARED = 0.25
#: Pages that are handled at once in a task.
AT_ONCE = 200

# Elements and names of HTML.
RAW = "script style noscript template iframe svg math object canvas video audio head title textarea select"
DROPPED = "nav footer aside form button dialog menu"
CONTAINERS = "html body div section article main header nav footer aside form table tbody thead tfoot ul ol dl blockquote figure fieldset details center dialog menu"
BLOCKS = "p li h1 h2 h3 h4 h5 h6 tr td th dt dd pre hr figcaption caption address summary legend option"
ROLES = "navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form toolbar"
NAMES = (
    "ad ads adv advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar aside header masthead footer colophon copyright "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall "
    "comment comments commentlist disqus replies respond share sharing social related recommended widget pagination pager toc login search skip"
)
#: Words that turn a name's sense round: a layout "with-sidebar" is no side bar, a wrapper "nav-open" no menu.
TURNED = "has no with without is not open opened closed enabled"

_dropped, _containers, _blocks, _roles, _names, _turned = (frozenset(x.split()) for x in (DROPPED, CONTAINERS, BLOCKS, ROLES, NAMES, TURNED))
#: A comment, a declaration, a raw element with all it holds, a tag, or text. What isn't closed ends with the page.
TOKEN = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)"
    rf"|<({'|'.join(RAW.split())})(?=[\s/>])((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|[^>]*>).*?(?:</\1\s*[^>]*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^\"'>]|\"[^\"]*\"|'[^']*')*+>|[^>]*(?:>|\Z))"
    r"|([^<]+|<)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[^a-z0-9]+")


def is_named(name: str, first_only: bool = False) -> bool:
    """Whether one word of a class or id begins (or ends) with a name of what isn't main text."""
    parts = [p for p in PARTS.split(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower()) if p]
    if not parts or not _turned.isdisjoint(parts):
        return False
    return parts[0] in _names or (not first_only and parts[-1] in _names)


def is_other(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element says by tag or attributes that it is no part of the article. ``inside`` of it, a header is its title's."""
    if tag in _dropped:
        return True
    if not attributes.strip("/> \n\t"):
        return tag == "header" and not inside
    found = {m[1].lower(): next((x for x in m.groups()[1:] if x is not None), "") for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or HIDDEN.search(found.get("style", "")):
        return True
    if tag in ("html", "body", "main"):
        return False
    if (tag == "header" and not inside) or found.get("role", "").lower() in _roles:
        return True
    return any(is_named(word, tag == "article") for word in f"{found.get('class', '')} {found.get('id', '')}".split())


def lines_of(page: str) -> list[tuple[str, int, bool, bool]]:
    """A page's lines: text, characters outside of links, whether declared as main, whether stripped."""
    # Elements in the page's order: parent, whether it is something else, main or article, holds one of these, holds a title.
    parent, other, main, holds, titled = [-1], [False], [False], [False], [False]
    stack: list[tuple[str, int]] = [("", 0)]
    raw: list[tuple[str, int, int]] = []  # text, characters outside of links, element
    texts: list[str] = []
    opened: dict[str, int] = {}
    plain, in_link = 0, 0

    def mark(which: list[bool]) -> None:
        for _, e in reversed(stack):
            if which[e]:
                break
            which[e] = True

    def close_line() -> None:
        nonlocal plain
        if line := " ".join(html.unescape("".join(texts)).split()):
            raw.append((line, plain, stack[-1][1]))
        texts.clear()
        plain = 0

    for m in TOKEN.finditer(page):
        text = m[6]
        if text is not None:
            texts.append(text)
            if not in_link:
                plain += len("".join(text.split()))
            continue
        tag = (m[4] or "").lower()
        if not tag:
            continue
        if tag == "a":
            in_link = int(not m[3])
        elif tag == "br":
            texts.append(" ")
        elif tag in _blocks:
            close_line()
            if tag == "h1" and not m[3]:
                mark(titled)
        elif tag in _containers:
            close_line()
            in_link = 0
            if m[3]:
                # An end tag closes what is open inside its element; without an open one it is nothing.
                while opened.get(tag, 0):
                    name, _ = stack.pop()
                    opened[name] -= 1
                    if name == tag:
                        break
            elif not (m[5] or "").endswith("/>") or tag in ("div", "section"):
                is_main = tag in ("main", "article") or bool(re.search(r"role\s*=\s*[\"']?main\b|itemprop\s*=\s*[\"']?articleBody\b", m[5] or "", re.I))
                above = stack[-1][1]
                out = is_other(tag, m[5] or "", main[above])
                if is_main and not out:
                    mark(holds)
                parent.append(above)
                other.append(out)
                main.append(is_main or main[above])
                holds.append(False)
                titled.append(False)
                stack.append((tag, len(parent) - 1))
                opened[tag] = opened.get(tag, 0) + 1
            raw.append(("", 0, stack[-1][1]))
    close_line()
    size = [0] * len(parent)
    for _, n, e in raw:
        size[e] += n
    for e in range(len(parent) - 1, 0, -1):
        size[parent[e]] += size[e]
    # A wrapper named like something else isn't it if it holds the main part, or the title and half of the text.
    # Parents come before children.
    for e in range(1, len(parent)):
        holds[e] = holds[e] or (titled[e] and 2 * size[e] >= size[0])
        other[e] = other[parent[e]] or (other[e] and not holds[e])
    return [(text, n, main[e], other[e]) for text, n, e in raw]


def kept_lines(lengths: np.ndarray, stripped: np.ndarray, least: int | None = None) -> np.ndarray:
    """Which lines lie between a surge and a dive. ``stripped`` lines are followed by an empty window."""
    n = len(lengths)
    if not n:
        return np.zeros(0, bool)
    # Each run of stripped lines counts as a whole window.
    place = np.arange(n) + np.cumsum(stripped) * WINDOW
    spread = np.zeros(place[-1] + 1 + 2 * (WINDOW - 1), np.int64)
    spread[place + WINDOW - 1] = np.where(stripped, 0, lengths)
    sums = np.convolve(spread, np.ones(WINDOW, np.int64), "valid")  # sums[i]: lines i - WINDOW + 1 to i
    filled = sums > 0
    starts = np.flatnonzero(filled & ~np.concatenate([[False], filled[:-1]]))
    ends = np.flatnonzero(filled & ~np.concatenate([filled[1:], [False]]))
    keep = np.zeros(len(sums), bool)
    if len(starts):
        surge = min(SURGE, SHARE * sums.max()) if least is None else least
        for start, end in zip(starts, ends, strict=True):
            # Windows start to end are filled: their lines are start to end - WINDOW + 1.
            if sums[start : end + 1].max() >= surge:
                keep[start : end - WINDOW + 2] = True
    return keep[place] & ~stripped


def main_text(page: str | None) -> tuple[str, int, int]:
    """The main text of a page, its number of lines with text, and how many of these it took."""
    lines = lines_of(page or "")
    if not lines:
        return "", 0, 0
    texts, plain, declared, stripped = zip(*lines, strict=True)
    lengths, declared, stripped = np.array(plain, np.int64), np.array(declared), np.array(stripped)
    mine = np.where(stripped, 0, lengths)
    inside = mine[declared].sum()
    if inside and inside >= DECLARED * mine.sum():
        keep = kept_lines(mine, stripped | ~declared, least=1)
    else:
        keep = kept_lines(mine, stripped)
    kept = [t for t, k in zip(texts, keep, strict=True) if k and t]
    return " ".join(kept), sum(map(bool, texts)), len(kept)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, AT_ONCE):
            part = batch.slice(i, AT_ONCE)
            found = [main_text(page) for page in part.column("html").to_pylist()]
            text, n_lines, n_kept = (list(x) for x in zip(*found, strict=True)) if found else ([], [], [])
            columns = [part.column("page_id"), part.column("url"), pa.array(text, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_kept, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "text", "n_lines", "n_kept"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_lines (with text), n_kept (of these): one row for each row of ``pages``.

    Null and empty pages, and pages without text, give an empty text. Null ids and urls and repeated
    rows stay as they are. Character references are decoded, white space inside a block is one
    space, and blocks are joined by one space. Other columns of ``pages`` are ignored; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    done = rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_lines bigint, n_kept bigint")
    return done.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_lines", "n_kept")
