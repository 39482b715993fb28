"""Main text of web pages by block rules in two passes.

What the markup itself names as menu, header, footer, sidebar, notice, advert, form or reader comments is left out; that is all it
decides. First pass: every other block is judged alone by link density, stop-word density and length: as text, as no text, or as
ambiguous, which most short ones are. Second pass: ambiguous blocks take the labels of the nearest decided blocks around them, by
rules for their length and stop words; blocks of an article element look for neighbours inside it.
"""

from __future__ import annotations

import html
import itertools
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, bounded

#: Characters from which a block can be judged by its words, and from which stop words make it text by themselves.
LENGTH_LOW, LENGTH_HIGH = 70, 200
#: Characters below which unmarked words at the ends of a page, with no mark at their end, are taken for a menu's.
LENGTH_BARE = 25
#: Shares of stop words: from the first on a long block is text, from the second on one with text on either side is; one under the
#: third is text only with text on all sides.
STOP_HIGH, STOP_LOW, STOP_NONE = 0.32, 0.20, 0.01
#: Share of a block's characters that may be in links.
LINKS_HIGH = 0.2

#: Frequent function words of the four languages.
STOP_WORDS = frozenset(
    """a an the and or of to in on at by for with from as is are was were be been it its he she they we you that this which who not but if has have had will can
    der die das den dem des ein eine einer eines einem einen und oder in im zu zum zur mit von auf für an am als bei nach aus über es er sie wir ist sind war wird sich nicht auch
    le la les un une des du de et ou à au aux en dans par pour sur avec que qui ne pas est sont il elle ils nous vous ce cette se sa son ses plus
    el los las una unos unas del y o al con por para como es son su sus lo no se más que en""".split()
)

#: Elements whose text is never shown, that start a new block, and that hold no article text.
_RAW = frozenset("script style noscript template textarea select svg iframe object canvas math title button option head".split())
_BLOCK = frozenset("p div h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre section article main header footer nav aside form fieldset figure figcaption address hr body html details summary center legend menu dialog".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_BAD = frozenset("nav footer aside form menu dialog".split())
#: Elements that may hold a part of a page, so that their names say what the part is, and those that are no part by themselves.
_PARTS = frozenset("div section ul ol dl table header fieldset details figure center".split())
_LOOSE = frozenset("p li td th tr dt dd".split())
_BAD_NAME = frozenset(
    """ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsors sponsored promo promotion banner sidebar menu menus nav navbar navigation
    breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter popup modal overlay comment comments disqus header footer masthead""".split()
)
_BAD_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())

_OPEN = re.compile(r"<(/?)([a-z][a-z0-9:-]*)", re.I)
_STOP = re.compile(r"""[>"']""")
_ATTR = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_WORD = re.compile(r"[^\W\d_]+")


def _names_bad(attrs: str) -> bool:
    """Whether class, id or role names a part that holds no article."""
    for name, *values in _ATTR.findall(attrs):
        name, words = name.lower(), "".join(values).lower().split()
        if name == "role" and any(x in _BAD_ROLE for x in words):
            return True
        if name in ("class", "id") and any(y in _BAD_NAME for x in words for y in re.split(r"[-_]+", x)):
            return True
    return False


class _Finder:
    """Finds in page from ever later places; what isn't there is looked for once, so that all searches together read the page a bounded number of times."""

    def __init__(self, page: str) -> None:
        self.page, self.found = page, {}

    def __call__(self, what: str, start: int) -> int:
        at = self.found.get(what, 0)
        if 0 <= at < start or what not in self.found:
            if what[:2] == "</":
                m = re.compile(what, re.I).search(self.page, start)
                at = m.start() if m else -1
            else:
                at = self.page.find(what, start)
            self.found[what] = at
        return at


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """(start, end, name, whether it ends, attributes) of every piece of markup. Comments and elements never shown are one piece each, the latter with name " "."""
    find, at, size = _Finder(page), 0, len(page)
    while (start := page.find("<", at)) >= 0:
        m = _OPEN.match(page, start)
        if m is None:
            at = start + 1
            if page[at : at + 1] in ("!", "/", "?"):  # a comment goes on to its end, other declarations, or one without an end, to the next >
                end = find("-->", start + 4) + 3 if page.startswith("!--", at) else 0
                if end < 4:
                    end = find(">", at) + 1
                at = end if end > 0 else size
                yield start, at, "", False, ""
            continue
        name, to = m[2].lower(), m.end()
        while (stop := _STOP.search(page, to)) and stop[0] != ">":
            close = find(stop[0], stop.end())
            to = close + 1 if close >= 0 else stop.end()  # a quote that never ends is a character like others
        at = stop.end() if stop else size
        if name in _RAW and not m[1]:
            end = find("</" + name, at)
            if end >= 0:
                end = find(">", end) + 1
                at = end if end > 0 else size
                yield start, at, " ", False, ""
                continue
        yield start, at, name, bool(m[1]), page[m.end() : at - 1]


def blocks(page: str) -> list[tuple[str, int, bool, bool, int]]:
    """(text, characters inside links, whether inside a part left out, whether a heading, number of the article around it or 0) of every block that has text."""
    out: list[tuple[str, int, bool, bool, int]] = []
    stack: list[tuple[str, int]] = []
    text: list[str] = []
    open_now: Counter[str] = Counter()
    # parts left open before an article end where it begins: they count in an era of their own
    links, at, link, bad, era, head, article = 0, 0, False, 0, 1, False, 0

    def close() -> None:
        nonlocal links
        if text:
            joined = " ".join(html.unescape("".join(text)).split())
            if joined:
                out.append((joined, links, bad > 0, head, article))
            text.clear()
        links = 0

    for start, end, tag, ends, attrs in itertools.chain(_tags(page), [(len(page), len(page), "", False, "")]):
        if start > at:
            piece = page[at:start]
            text.append(piece)
            if link and not piece.isspace():
                links += len(" ".join(html.unescape(piece).split()))
        at = end
        if tag == "a":
            link = not ends
        elif tag in ("br", " "):
            text.append(" ")
        if tag not in _BLOCK:
            continue
        close()
        link, head = False, tag in _HEADINGS and not ends
        if tag == "hr" or tag in _LOOSE:
            continue
        if not ends:
            if tag in ("article", "main") and not article:
                era, bad = era + 1, 0
                article = era - 1
            is_bad = tag in _BAD or tag == "header" and not article or tag in _PARTS and _names_bad(attrs)
            stack.append((tag, era if is_bad else 0))
            open_now[tag] += 1
            bad += is_bad
        elif open_now[tag]:
            while True:
                name, was_bad = stack.pop()
                open_now[name] -= 1
                bad -= was_bad == era
                if name == tag:
                    break
            if not open_now["article"] + open_now["main"]:
                article = 0
    close()
    return out


def classify(found: list[tuple[str, int, bool, bool, int]]) -> list[bool]:
    """Whether each block is main text. Blocks left out by their markup are no text, and no neighbours either."""
    left = [i for i, b in enumerate(found) if not b[2]]
    marked = any(found[i][4] for i in left)
    labels: list[bool | None] = []
    density = []
    for i in left:
        text, links = found[i][:2]
        words = _WORD.findall(text.lower())
        density.append(sum(w in STOP_WORDS for w in words) / max(1, len(words)))
        if links > LINKS_HIGH * len(text):
            labels.append(False)
        elif len(text) > LENGTH_HIGH and density[-1] >= STOP_HIGH:
            labels.append(True)
        else:
            labels.append(None)
    if not marked:  # bare words before the first decided block and after the last one
        for order in (range(len(left)), range(len(left) - 1, -1, -1)):
            for k in itertools.takewhile(lambda k: labels[k] is None, order):
                text, heading = found[left[k]][0], found[left[k]][3]
                if True in labels and len(text) < LENGTH_BARE and not heading and text[-1].isalnum():
                    labels[k] = False
    # one sweep from each end finds the nearest decided block of the same region on that side
    near: list[list[tuple[int, bool]]] = [[] for _ in left]
    for step in (1, -1):
        last, region = None, None
        for k in range(len(left))[::step]:
            if found[left[k]][4] != region:
                region = found[left[k]][4]
                last = (k - step, False) if marked and not region else None  # beside an article, a region's ends are no text
            if labels[k] is not None:
                last = (k, labels[k])
            elif last is not None:
                near[k].append((abs(k - last[0]), last[1]))
    out = [False] * len(found)
    for k, i in enumerate(left):
        label, sides, text = labels[k], near[k], found[i][0]
        if label is None and not sides:
            label = True  # nothing decided in an article, or on a page without one
        elif label is None:
            least = min(d for d, _ in sides)
            close = [good for d, good in sides if d == least]
            if found[i][3]:
                label = sides[-1][1]  # a heading belongs to what follows it
            elif len(text) < LENGTH_LOW or STOP_NONE <= density[k] < STOP_LOW:
                label = any(close) if found[i][4] or not marked else all(close)
            else:  # enough words to go by
                label = any(good for _, good in sides) if density[k] >= STOP_LOW else all(good for _, good in sides)
        out[i] = label
    return out


def main_text(page: str) -> str:
    found = blocks(page)
    return "\n".join(b[0] for b, good in zip(found, classify(found)) if good)


_OUT = "page_id long, url string, text string, n_chars long"


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of pages: id, url, text, n_chars (code points).

    Null or empty html gives an empty text; so does a page without main text. Repeated rows give repeated results. Parts left
    open, cut-off tags and stray end tags are taken as browsers mostly do; whole pages are read whatever their length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for page_id, url, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                text = main_text(page.as_py() or "")
                out.append((page_id, url, text, len(text)))
            if out:
                yield batch(out, _OUT)

    return bounded(pages).select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).mapInArrow(run, _OUT)
