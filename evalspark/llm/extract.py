"""Main text of web pages by the distribution of text over lines.

Markup is stripped to lines, one per block of text.  Boilerplate containers leave lines of length zero where they stood.
Text lengths are summed over a window of lines; the text starts where the sum surges, ends where it dives to nothing, and
the surge with the most text between it and its dive is the main one.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 3  # lines on each side whose lengths are summed up
# Names of HTML.
BLOCKS = frozenset((
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main nav ol option p pre section summary table tbody td tfoot th thead title tr ul").split())
DROPPED = frozenset((
    "head script style noscript template svg math iframe object embed canvas audio video nav header footer aside form button "
    "select textarea input dialog menu").split())
RAW = ("script", "style", "textarea", "title", "noscript", "iframe", "template")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = frozenset(("article", "main"))
# Words in class, id or role that name what is no part of the text.
NOISE = frozenset((
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie "
    "cookies disclaimer disqus footer gdpr header masthead menu menubar modal nav navbar navigation newsletter notice notices overlay "
    "pagination popup promo promoted promotion related reply replies respond share sharing sidebar social sponsor sponsored subscribe "
    "subscription toolbar widget widgets alert complementary contentinfo search toc").split())
# Words beside them that do not change what a name stands for.
NEUTRAL = frozenset((
    "left right top bottom inner outer primary secondary list box area bar block section container wrapper item items link links "
    "button buttons icon icons content inline form").split())
# Never boilerplate by their own name.
PLAIN = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
TALK = frozenset("comment comments commentlist disqus reply replies respond".split())  # may be longer than what it is about
LEAST = 200  # characters outside of links that make a run of an unmarked page a part of its text
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S)
_NAMED = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def _hidden(attributes: str) -> bool:
    return bool(_HIDDEN.search(re.sub(r"""(class|id|href|src|title|alt|content)\s*=\s*("[^"]*"|'[^']*')""", "", attributes, flags=re.I)))


def _named(attributes: str) -> set[str]:
    """The words of NOISE in class, id and role, of names that hold no other words."""
    out = set()
    for m in _NAMED.finditer(attributes):
        for name in (m[2] or m[3] or m[4] or "").split():
            words = {w.lower() for w in _WORD.findall(name)}
            if words <= NOISE | NEUTRAL:
                out |= words & NOISE
    return out


def _blocks(page: str) -> list[tuple[str, bool, bool, int]]:
    """Like ``lines``, and the characters of each block that are in links.

    Wrappers that hold over three quarters of the page's text, and look like boilerplate by their names only, are spared.
    """
    spared: frozenset[int] = frozenset()
    while True:
        out, suspects, total = _walk(page, spared)
        more = spared | {at for at, (size, top, talk) in suspects.items() if 4 * size > 3 * total and (top or not talk)}
        if more == spared:
            return out
        spared = frozenset(more)


def lines(page: str) -> list[tuple[str, bool, bool]]:
    """The page's blocks in order: (text, is boilerplate, lies in an article).  Boilerplate blocks have no text."""
    return [row[:3] for row in _blocks(page)]


def _walk(page: str, spared: frozenset[int]) -> tuple[list[tuple[str, bool, bool, int]], dict[int, list], int]:
    """(blocks, {place: [characters, has main or h1, talk]} of elements that look like boilerplate by name, all characters)."""
    out: list[tuple[str, bool, bool, int]] = []
    open_tags: list[tuple[str, bool, bool, int]] = []  # (name, boilerplate from here on, article from here on, place)
    suspects: dict[int, list] = {}
    total = linked = 0
    text: list[str] = []

    def suspect(name: str, attributes: str, at: int) -> bool:
        """Whether the element is boilerplate by itself."""
        if _hidden(attributes) or (name in DROPPED and name != "form"):
            return True
        words = set() if name in PLAIN else _named(attributes)
        if at in spared or not (words or name == "form"):
            return False
        suspects.setdefault(at, [0, False, bool(words & TALK)])
        return True

    def close() -> None:
        nonlocal total, linked
        noise, inside = (open_tags[-1][1], open_tags[-1][2]) if open_tags else (False, False)
        block = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if block:
            out.append(("" if noise else block, noise, inside, 0 if noise else min(linked, len(block))))
            total += len(block)
            for tag in open_tags:
                if tag[3] in suspects:
                    suspects[tag[3]][0] += len(block)
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text.append(page[at:m.start()] if m else page[at:])
        if any(t[0] == "a" for t in open_tags[-4:]):
            linked += len(text[-1])
        if not m:
            break
        at, name = m.end(), (m[2] or "").lower()
        if not name:
            continue
        if m[1]:  # an end tag closes up to its start tag, if there is one
            for k in range(len(open_tags) - 1, -1, -1):
                if open_tags[k][0] == name:
                    if any(t[0] in BLOCKS or t[1] != (open_tags[k - 1][1] if k else False) for t in open_tags[k:]):
                        close()
                    del open_tags[k:]
                    break
                # a stray end tag of an inline element never closes a container
                if open_tags[k][0] in ("article", "main", "body", "nav", "footer", "aside", "header", "form", "div", "section") and name not in BLOCKS | DROPPED:
                    break
            continue
        if name in RAW and not m[3].rstrip().endswith("/"):  # its content is no markup
            end = re.compile(rf"</{name}\s*>|\Z", re.I).search(page, at)
            if name in BLOCKS or name == "noscript":
                close()
            at = end.end()
            continue
        if name == "br":
            text.append(" ")
            continue
        above = open_tags[-1] if open_tags else ("", False, False, -1)
        own = suspect(name, m[3], m.start())
        noise = above[1] or own
        if name in ("main", "h1"):
            for tag in open_tags:
                if tag[3] in suspects:
                    suspects[tag[3]][1] = True
        if name in BLOCKS or noise != above[1]:
            close()
        if name in VOID or m[3].rstrip().endswith("/"):
            continue
        if name == "p" and open_tags and any(t[0] == "p" for t in open_tags):  # a paragraph ends the one before it
            k = max(i for i, t in enumerate(open_tags) if t[0] == "p")
            if all(t[0] not in BLOCKS for t in open_tags[k + 1:]):
                del open_tags[k:]
                above = open_tags[-1] if open_tags else ("", False, False, -1)
                noise = above[1] or own
        open_tags.append((name, noise, above[2] or (name in CONTENT and not noise), m.start()))
    close()
    return out, suspects, total


def main_text(page: str | None, window: int = WINDOW) -> str:
    """The main text, blocks joined by an empty line; empty for a page without any.

    Lengths count for lines of text that are not boilerplate, and if the page marks an article, for lines in it.  The sum
    over ``window`` lines to either side surges where it leaves zero and dives where it is back at zero; what lies between
    is one run.  In a marked article all runs are main text, else the run with most text is, of equal ones the first, and all others
    with ``LEAST`` characters outside of links and fewer in them.
    """
    rows = _blocks(page or "")
    marked = any(inside and block for block, _, inside, _ in rows)
    size = [len(block) if inside or not marked else 0 for block, _, inside, _ in rows]
    runs, n = [], len(size)
    total = [0]
    for s in size:
        total.append(total[-1] + s)
    mass = [total[min(n, i + window + 1)] - total[max(0, i - window)] for i in range(n)]
    i = 0
    while i < n:
        if mass[i]:
            surge = i
            while i < n and mass[i]:
                i += 1
            runs.append((sum(size[surge:i]), -surge, i))
        else:
            i += 1
    if not runs:
        return ""
    if not marked:
        def plain(run: tuple[int, int, int]) -> bool:
            links = sum(rows[k][3] for k in range(-run[1], run[2]))
            return run[0] - links >= max(LEAST, links)

        runs = [r for r in runs if r == max(runs) or plain(r)]
    chosen = sorted(runs, key=lambda r: -r[1])
    return "\n\n".join(rows[k][0] for _, surge, dive in chosen for k in range(-surge, dive) if size[k])


def extracted(pages: DataFrame, html_col: str = "html", text_col: str = "text") -> DataFrame:
    """All columns of ``pages`` and ``text_col``, the main text of each whole page; NULL html counts as empty.

    A column of ``pages`` that has the name ``text_col`` is replaced.
    """
    names = [c for c in pages.columns if c != text_col]
    pages = pages.select(*names)
    at = names.index(html_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, text_col])

    return pages.mapInArrow(run, pages.select("*", F.lit("").alias(text_col)).schema)
