"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one for each block of the page.  Sums of text
lengths over sliding windows of lines rise steeply where the article begins
(the surge point) and fall where it ends (the dive point), measured against the
page's middle window; the lines between them, and those next to them up to the
next furniture, are kept.  Lines inside page furniture (navigation, adverts, forms,
comments) weigh nothing and are never kept (a hint in the class of an element
that holds most of the page's text does not count), link text weighs nothing, and
the two points are moved to the ends of the article element they lie in.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vulnlake.llm.common import in_batches

#: Lines in a window, and the share of the middle window that counts as text.
WINDOW, SURGE_SHARE = 3, 0.15
#: Element names of HTML by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "object", "canvas", "title")
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
FURNITURE = frozenset("head nav footer aside form button select dialog menu".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert menu menubar form".split())
HINTS = frozenset("""ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation
    breadcrumb breadcrumbs footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe signup comment comments reply replies disqus
    respond share sharing social related recommended recommendations widget toolbar pagination pager masthead topbar login search skip""".split())
ARTICLE_WORDS = frozenset("article post entry content main story".split())
READERS = frozenset("comment comments reply replies disqus respond".split())
#: First parts of class words that say what a page has, not what the element is.
HAVING = frozenset("has have no with without hide show".split())

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<!--.*?(?:-->|$)|<[!?/][^>]*>""", re.S)
_LOOSE = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>")
_ATTR = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_LETTERS = re.compile(r"[a-z]+")


@dataclass
class Line:
    """One block: its text, the length of its text outside links, whether it is
    furniture, and the number of the article or main element round it (0: none)."""

    text: str
    weight: int
    furniture: bool
    article: int


_NO, _YES, _HINTED, _READERS = range(4)


def _is_furniture(name: str, attrs: str, in_article: bool) -> int:
    """_NO, _YES, or, where only the class or id says so, _HINTED or _READERS."""
    if name in FURNITURE or (name == "header" and not in_article):
        return _YES
    if not attrs:
        return _NO
    words: set[str] = set()
    hinted = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and "display:none" in value.replace(" ", "")):
            return _YES
        if key == "role" and value in ROLES:
            return _YES
        if key in ("class", "id"):
            for token in value.split():
                named = _LETTERS.findall(token)
                if not named or (named[0] in HAVING and len(named) > 1):
                    continue
                parts = set(named)
                hinted |= "header" in parts and not parts & ARTICLE_WORDS and not in_article
                words |= parts
    if name in ("html", "body", "main", "article"):
        return _READERS if (name == "article" and words & READERS) else _HINTED if hinted else _NO
    return _READERS if words & READERS else _HINTED if hinted or words & HINTS else _NO


def _tags(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text before, "" or "/", name, attributes) of each tag; raw elements and
    comments are passed over.  The last item has no tag."""
    at, text = 0, []
    while True:
        m = _TAG.search(page, at)
        if m and m.group(2) is None and not m.group(0).startswith("<!--"):
            loose = None
        elif m is None or "<" in page[at: m.start()]:
            loose = _LOOSE.search(page, at)  # a quote that never closes
        else:
            loose = None
        if loose and (m is None or loose.start() < m.start()):
            m = loose
        if m is None:
            text.append(page[at:])
            yield "".join(text), "", "", ""
            return
        text.append(page[at: m.start()])
        at = m.end()
        if m.group(2) is None:
            continue
        name = m.group(2).lower()
        if not m.group(1) and name in RAW and not m.group(3).endswith("/"):
            end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        yield "".join(text), m.group(1), name, m.group(3)
        text = []


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order, markup stripped.  A class is no hint on an
    element that holds most of the page's text, unless an article element has
    text without it, or it names comments and the page has text elsewhere."""
    lines, held, total = _lines(page, frozenset())
    kept = [x for x in lines if x.weight and not x.furniture]
    if any(x.article for x in kept):
        return lines
    most = frozenset(number for (number, kind), weight in held.items() if 2 * weight > total and not (kind == _READERS and kept))
    return _lines(page, most)[0] if most else lines


def _lines(page: str, ignored: frozenset[int]) -> tuple[list[Line], dict[tuple[int, int], int], int]:
    """The blocks; the weight of the text in every element (its number in the
    page, kind) that a hint makes furniture, and that of all text outside sure
    furniture.  Hints on the ``ignored`` elements do not count."""
    out: list[Line] = []
    held: dict[tuple[int, int], int] = {}
    total = number = 0
    open_: list[tuple[str, int, int, int]] = []  # name, furniture, article number, number in the page
    parts: list[str] = []
    linked: list[str] = []
    articles = links = 0
    state = (False, 0)

    def furniture(name: str, attrs: str, in_article: bool) -> int:
        kind = _is_furniture(name, attrs, in_article)
        return _NO if kind >= _HINTED and number in ignored else kind

    def flush() -> None:
        nonlocal total
        text = " ".join(entities.unescape("".join(parts)).split())
        if text:
            inside = len("".join(entities.unescape("".join(linked)).split()))
            out.append(Line(text, max(0, len(text.replace(" ", "")) - inside), *state))
            if not any(f == _YES for _, f, _, _ in open_):
                total += out[-1].weight
                for _, f, _, n in open_ if state[0] else ():
                    if f:
                        held[n, f] = held.get((n, f), 0) + out[-1].weight
        parts.clear()
        linked.clear()

    for text, close, name, attrs in _tags(page):
        parts.append(text)
        if links:
            linked.append(text)
        if not name:
            break
        number += 1
        if name == "a":
            links = max(0, links - 1) if close else 1
        if name == "br":
            parts.append(" ")
        if name in ("td", "th"):
            parts.append(" ")
            continue
        if name in VOID:
            if name not in INLINE:
                flush()
            continue
        if name in INLINE:
            if close:
                if any(x[0] == name for x in open_) and open_[-1][0] == name:
                    open_.pop()
            elif kind := furniture(name, attrs, state[1] > 0):
                flush()
                open_.append((name, kind, state[1], number))
            state_now = (any(x[1] for x in open_), state[1])
            if state_now != state:
                flush_state, state = state, state_now
                if flush_state[0]:
                    parts, linked = [], []
            continue
        flush()
        links = 0
        if close:
            if any(x[0] == name for x in open_):
                while open_.pop()[0] != name:
                    pass
        else:
            if name in ("article", "main") and not furniture(name, attrs, False) and state[0] and not state[1]:
                while open_ and open_[-1][0] in ("div", "p", "span", "li", "ul") and open_[-1][1]:
                    open_.pop()  # an advert that was never closed does not swallow the article
            if name in ("p", "li", "dt", "dd", "option", "tr") and open_ and open_[-1][0] == name:
                open_.pop()
            if name == "p" or not open_ or open_[-1][0] != "p":
                pass
            else:
                open_.pop()  # a block ends an open paragraph
            here = open_[-1][2] if open_ else 0
            if name in ("article", "main"):
                articles += 1
                here = here or articles
            if not attrs.endswith("/"):
                open_.append((name, furniture(name, attrs, here > 0 and name != "article"), here, number))
        state = (any(x[1] for x in open_), open_[-1][2] if open_ else 0)
    flush()
    return out, held, total


def main_lines(lines: list[Line]) -> list[Line]:
    """The lines between the surge and the dive point."""
    weight = [0 if x.furniture else x.weight for x in lines]
    if not any(weight):
        return []
    sums = [sum(weight[i: i + WINDOW]) for i in range(len(weight))]
    level = max(1.0, SURGE_SHARE * median(x for x in sums if x))  # one very long paragraph does not move it
    dense = [i for i, s in enumerate(sums) if s >= level]
    surge = next(i for i in range(dense[0], len(weight)) if weight[i])
    dive = max(i for i in range(dense[-1], min(dense[-1] + WINDOW, len(weight))) if weight[i])
    # the article element that holds most of the span sets its ends
    held: dict[int, int] = {}
    for i in range(surge, dive + 1):
        held[lines[i].article] = held.get(lines[i].article, 0) + weight[i]
    best = max(held, key=lambda k: (held[k], -k))
    if best and held[best] * 2 >= sum(held.values()):
        return [x for x in lines if x.article == best and not x.furniture]
    for i in range(surge - 1, -1, -1):  # short lines beside the span, as far as no furniture parts them from it
        if lines[i].furniture:
            break
        surge = i if weight[i] else surge
    for i in range(dive + 1, len(lines)):
        if lines[i].furniture:
            break
        dive = i if weight[i] else dive
    return [x for x in lines[surge: dive + 1] if not x.furniture]


def main_text(page: str | None) -> str:
    return "\n".join(x.text for x in main_lines(lines_of(page or "")))


def extract(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page.

    Null and empty html, and pages without text outside furniture, give an
    empty text.  Broken markup never fails: an unclosed element ends with its
    parent, an unclosed script or comment with the page.  Repeated rows are
    extracted each; columns beyond these three are not looked at."""
    in_batches(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            texts = [main_text(x) for x in frame["html"]]
            yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = dict(pages.select("page_id").dtypes)["page_id"]
    return pages.select("page_id", "url", F.col("html")).mapInPandas(run, f"page_id {kind}, url string, text string, n_chars long")
