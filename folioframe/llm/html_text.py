"""Main text of web pages by the line-block distribution.

Markup is stripped into lines, one for each block of a page; what surrounds an article by element, role,
class or id (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader
comments) is no line. Each line has a weight: its text's length without links, raised where the page
marks an article (an article or main element that is no teaser), lowered outside it. Weights are summed over a sliding window of
lines; text surges where the sum reaches SURGE and dives where it falls below a fraction of it.
Of the stretches between surge and dive the heaviest is kept, those in the element or the marked articles around it, and others that have a fair share of its weight; headings and up to
WINDOW short lines of the same element right before a stretch belong to it, and short lines between two kept ones within one element. Marked articles that hold the heaviest stretch
are kept whole, whatever the sums within them.

Nulls and edges: null or empty html, and pages without text outside what is stripped, give the empty
text; markup that is cut off or never closed ends with the page; a page without a surge keeps all lines that are not links; a null url or page_id is kept;
repeated pages give repeated rows; an empty table gives none. Other columns are never read.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>script|style|title|textarea|xmp|iframe|noembed|noframes)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)|<(?P<odd>/?[a-zA-Z])[^>]*(?:>|\Z)",
    re.S | re.I,
)
#: One attribute after the other, values included, so that no name is looked for within a value or another name.
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
#: Elements that are never part of the text.
_DROPPED = frozenset("nav footer aside form button select option noscript template svg canvas head object audio video dialog menu fieldset input label".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
#: Parts of class and id names that say what surrounds an article, and those of them that say so within one, where headers and
#: other parts of the text have names as well.
_INSIDE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense sponsor sponsored sponsors promo promos promoted promotion cookie cookies consent gdpr notice notices alert alerts menu menus nav navbar navigation sidebar sidebars aside asides comment comments commentlist disqus respond popup modal overlay subscribe subscription newsletter signup login".split())
_AROUND = _INSIDE | frozenset("banner banners side breadcrumb breadcrumbs footer footers header masthead topbar replies discussion share sharing social related recommend recommended recommendations search widget widgets toolbar pagination pager skip legal copyright".split())
#: In a name with one of these parts the others say what the page has or lacks around, not what the element is.
_SAYS_OF_PAGE = frozenset("has have no not non with without is hide hides show shows".split())
_REMARKS = frozenset("comment comments reply replies related promo promos ad ads advert adverts teaser teasers sponsor sponsored".split())
#: Elements whose lines belong together.
_HOLDERS = frozenset("body article main section div td".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())


class Line:
    __slots__ = ("article", "heading", "linked", "parent", "text")

    def __init__(self, text: str, article: int, heading: bool, linked: int, parent: int) -> None:
        self.text, self.article, self.heading, self.linked, self.parent = text, article, heading, linked, parent


def _named(value: str, words: frozenset[str]) -> bool:
    """Whether one of the names in a class or id value has a part in `words`: `site-footer` has, `has-footer` has not."""
    for name in value.split():
        parts = {re.sub(r"\d+$", "", x) for x in re.split(r"[-_:]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", name).lower())}
        if parts & words and not parts & _SAYS_OF_PAGE:
            return True
    return False


def _around(name: str, rest: str, inside: bool, in_article: bool = False) -> bool:
    """Whether an element surrounds the article rather than being part of it; `inside` an article or main element."""
    if name in _DROPPED or name == "header" and not inside:
        return True
    if not rest or name in ("html", "body"):
        return False
    words = _REMARKS if name in ("article", "main") else _INSIDE if in_article else _AROUND
    for key, a, b, c in _ATTRIBUTE.findall(rest):
        value, key = entities.unescape(a or b or c), key.lower()
        if key in ("class", "id") and _named(value, words - {"header"} if inside else words):
            return True
        if key == "role" and value.strip().lower() in _ROLES or key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I) or key == "itemprop" and value.lower() == "comment":
            return True
    return False


def page_lines(html: str | None) -> list[Line]:
    """The blocks of a page outside what surrounds the article, in order."""
    lines: list[Line] = []
    open_: list[tuple[str, bool, int, int]] = []  # name, whether it began a dropped part, the article and the parent around it
    is_open: Counter[str] = Counter()
    parts: list[str] = []
    state = {"dropped": 0, "article": 0, "articles": 0, "parent": 0, "parents": 0, "link": 0, "linked": 0, "heading": False}

    def flush() -> None:
        text = " ".join("".join(parts).split())
        if text:
            lines.append(Line(text, state["article"], state["heading"], state["linked"], state["parent"]))
        parts.clear()
        state["linked"] = 0

    def add(text: str) -> None:
        if text and not state["dropped"]:
            text = entities.unescape(text) if "&" in text else text
            parts.append(text)
            if state["link"]:
                state["linked"] += len("".join(text.split()))

    def pop(name: str, around: bool, article: int, parent: int) -> None:
        is_open[name] -= 1
        state["dropped"] -= around
        state["article"], state["parent"] = article, parent
        if name == "a":
            state["link"] -= 1

    source, at = html or "", 0
    for m in _TOKEN.finditer(source):
        add(source[at : m.start()])
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:
            continue
        if name not in _INLINE:
            flush()
        elif name == "br":
            add(" ")
        if m["close"]:
            if is_open[name]:
                while True:
                    last = open_.pop()
                    pop(*last)
                    if last[0] == name:
                        break
            state["heading"] = False
            continue
        state["heading"] = name in ("h1", "h2", "h3", "h4", "h5", "h6") or state["heading"] and name in _INLINE
        if name in _VOID or m["rest"].endswith("/") and name in ("svg", "path", "circle"):
            continue
        if name in ("p", "li", "option", "dt", "dd", "tr", "td", "th"):  # closed by the next of their kind
            stop = {"p": (), "li": ("ul", "ol"), "option": ("select",), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table")}[name]
            for k in range(len(open_) - 1, -1, -1):
                if open_[k][0] == name:
                    if name != "p" or all(x[0] in _INLINE for x in open_[k + 1 :]):
                        while len(open_) > k:
                            pop(*open_.pop())
                    break
                if open_[k][0] in stop:
                    break
        around = not state["dropped"] and _around(name, m["rest"], state["article"] > 0, is_open["article"] > 0)
        if around:
            flush()
        open_.append((name, bool(around), state["article"], state["parent"]))
        is_open[name] += 1
        if name in _HOLDERS:
            state["parents"] += 1
            state["parent"] = state["parents"]
        state["dropped"] += around
        if name == "a":
            state["link"] += 1
        if name in ("article", "main") and not state["dropped"] and not state["article"]:
            state["articles"] += 1
            state["article"] = state["articles"]
    add(source[at:])
    flush()
    return lines


def _articles(lines: list[Line]) -> set[int]:
    """The marked elements that hold the article: the largest by text, and others that are no teasers. A
    teaser is half links or more, or is headed by a link and has less than half the text of the largest."""
    parts: dict[int, list[Line]] = {}
    for x in lines:
        if x.article:
            parts.setdefault(x.article, []).append(x)
    size = {k: sum(len(x.text) for x in own) for k, own in parts.items()}
    largest = max(size, key=lambda k: (size[k], -k), default=0)

    def teaser(k: int) -> bool:
        heading = next((x for x in parts[k] if x.heading), None)
        headed = heading is not None and heading.linked >= len("".join(heading.text.split()))
        return 2 * sum(x.linked for x in parts[k]) >= size[k] or headed and 2 * size[k] < size[largest]

    return {k for k in parts if k == largest or not teaser(k)}


SURGE, DIVE, WINDOW, FAIR, MARKED = 120, 12, 3, 0.2, 4


def marked_articles(lines: list[Line]) -> set[int]:
    """The articles that the page marks, if they hold no less text than the rest; else none."""
    kept = _articles(lines)
    outside = sum(max(0, len(x.text) - 2 * x.linked) for x in lines if x.article not in kept)
    return kept if sum(len(x.text) for x in lines if x.article in kept) >= outside else set()


def weights(lines: list[Line], marked: set[int]) -> list[int]:
    """A line's length without its links, at twice; lines of marked articles weigh MARKED times their length, all others of such a page a quarter."""
    plain = [max(0, len(x.text) - 2 * x.linked) for x in lines]
    if not marked:
        return plain
    return [MARKED * len(x.text) if x.article in marked else n // MARKED for x, n in zip(lines, plain, strict=True)]


def main_lines(lines: list[Line]) -> list[Line]:
    """The lines between surge and dive. The window's sum at a line counts it and the WINDOW - 1 lines after it.

    The heaviest stretch names the holder: the marked articles if it lies in one, else the element around it. All stretches of
    the holder are kept, others from FAIR of the heaviest on; marked articles that hold it are kept whole."""
    marked = marked_articles(lines)
    weight = weights(lines, marked)
    n, sums = len(lines), [sum(weight[k : k + WINDOW]) for k in range(len(weight))]
    stretches, k = [], 0
    while k < n:
        if weight[k] < DIVE or sums[k] < SURGE:
            k += 1
            continue
        first = k
        while k < n and sums[k] >= DIVE:
            k += 1
        last = k
        while weight[last - 1] < DIVE and not (last < n and lines[last - 1].parent == lines[first].parent and weight[last - 1]):
            last -= 1
        stretches.append((sum(weight[first:last]), first, last))
    if not stretches:  # nowhere enough text for a surge: the marked articles, else all lines that are not links
        return [x for x, w in zip(lines, weight, strict=True) if w and (x.article in marked or not marked)]
    most, heaviest, _ = max(stretches)
    held = lambda x: x.article in marked if lines[heaviest].article in marked else x.parent == lines[heaviest].parent
    keep: set[int] = set()
    before = None
    for total, first, last in stretches:
        if total < FAIR * most and not held(lines[first]):
            continue
        surge = first
        while first and weight[first - 1] and (lines[first - 1].heading or surge - first < WINDOW and lines[first - 1].parent == lines[surge].parent):
            first -= 1
        keep.update(range(first, last))
        if before is not None and len({lines[k].parent for k in range(before - 1, first + 1)}) == 1:
            keep.update(k for k in range(before, first) if weight[k])
        before = last
    if lines[heaviest].article in marked:
        keep.update(k for k, x in enumerate(lines) if x.article in marked)
    return [lines[k] for k in sorted(keep)]


def main_text(html: str | None) -> str:
    return "\n".join(x.text for x in main_lines(page_lines(html)))


def extract(pages: DataFrame, *, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page", "address", "text", "n_chars"])

    source = pages.select(F.col(page_id).cast("long").alias("page"), F.col(url).cast("string").alias("address"), F.col(html).cast("string").alias("markup"))
    return source.mapInArrow(run, "page long, address string, text string, n_chars long").withColumnsRenamed({"page": page_id, "address": url})


def op10_rows(pages: DataFrame) -> DataFrame:
    return extract(pages)
