"""Main text of web pages by line-block distribution.

The page is cut into lines at block-level tags; markup goes, and so does what declares itself as
no article (menus, forms, adverts, comments and so on), without parting the text around it. Where a page marks
articles, only the lines within them are looked at. A line weighs its characters, or nothing where more than half of one is
within links (outside marked articles). Weights are summed over sliding windows of WINDOW lines: text begins at a surge, a line
with weight behind a window without, and ends at a dive, before such a window; what lies between is kept, short lines and few links included.
A threshold above nothing is not used: it would drop short articles. Time is linear in the page's length.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, takewhile

import pyarrow as pa
from pyspark.sql import DataFrame

from sievemark.llm.common import arrow_schema, batch_of, bounded_chunks, documents, texts_of

WINDOW = 3

#: Fixed values of HTML: elements without content, with raw text, that start a line, and that hold others.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript textarea title template iframe svg math object select button canvas audio video".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split())
HOLDER = frozenset("article aside blockquote body details dialog div dl fieldset figure footer form head header main menu nav ol section table ul".split())
#: Elements that are never article, and the words of class, id and role that say so.
NOT_ARTICLE = frozenset("aside dialog fieldset footer form head menu nav".split())
SAYS_NOT = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion promotions banner banners "
    "menu menus nav navbar navigation breadcrumb breadcrumbs toolbar sidebar sidebars aside complementary footer masthead contentinfo "
    "cookie cookies consent gdpr notice notices alert alerts popup modal overlay disclaimer newsletter subscribe subscription signup login "
    "share sharing social related recommended recommendations teaser teasers comment comments commentlist respond reply replies disqus discussion search pagination pager".split()
)
TAG = re.compile(r"""<!--(?:.*?-->|.*\Z)|<(/?)([A-Za-z][A-Za-z0-9:-]*)((?:[^>"']+|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>|<[!?][^>]*>""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Words that make a class tell of what the element has or lacks, not of what it is.
QUALIFIES = frozenset("has have with without no not hide show".split())
#: What may hold <article> elements of its own that are not the page's: comments, teasers, adverts.
OTHERS = SAYS_NOT & frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promoted promotion promotions related recommended recommendations teaser teasers comment comments commentlist respond reply replies disqus discussion".split())
#: The slash of an empty element, not the end of a value without quotes.
EMPTY = re.compile(r"""(?:^|[\s"'])/$""")


def _class_words(value: str) -> set[str]:
    """The words of a class, id or role, of each name those before the first qualifying word ("layout" of "layout-with-sidebar")."""
    return {w for name in value.split() for w in takewhile(lambda w: w not in QUALIFIES, (w.lower() for w in WORD.findall(name)))}


def _declared(name: str, attributes: str, in_article: bool) -> tuple[bool, set[str], bool]:
    """Whether an element cannot be article, the words of its classes that say it is none, and whether it says it is one."""
    if name in NOT_ARTICLE or (name == "header" and not in_article):
        return True, set(), False
    region, says = name in ("article", "main"), set()
    if attributes and not attributes.isspace():
        for m in NAMED.finditer(attributes):
            key, value = m[1].lower(), (m[2] or "").strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and re.search(r"display\s*:\s*none", value, re.I)):
                return True, set(), False
            if key in ("class", "id", "role") and name not in ("html", "body", "article", "main"):
                words = _class_words(value)
                says |= words & SAYS_NOT
                if key == "role" and words & {"main", "article"}:
                    region = True
            if key == "itemprop" and value.lower() == "articlebody":
                region = True
    return False, says, region


def lines_of(page: str, opened: set[int] = frozenset(), around: set[int] | None = None, within: set[int] | None = None) -> list[tuple[str, int, int]]:
    """The page's lines: text, characters within links, and the number of the outermost article element around it (0: none).

    Elements are dropped for their classes, but those that begin at a place in opened. Of those dropped so, around takes the places of
    what holds an article element, and within those of what is in one and holds text; comments, teasers and adverts are neither.
    """
    out: list[tuple[str, int, int]] = []
    buffer: list[str] = []
    stack: list[tuple[str, bool, bool, bool, bool]] = []  # name, dropped, article, dropped for its classes, for such as comments
    classed: list[int] = []  # where the open ones dropped for their classes begin
    others = 0  # open ones dropped for more than layout's classes
    open_names: Counter[str] = Counter()
    dropped = links = linked = region = regions = 0
    at, n = 0, len(page)

    def flush() -> None:
        nonlocal linked
        if buffer:
            text = " ".join(html.unescape("".join(buffer)).split())
            if text:
                out.append((text, linked, region))
            buffer.clear()
        linked = 0

    def pop() -> None:
        nonlocal dropped, others, region
        name, was_dropped, was_region, was_classed, was_other = stack.pop()
        open_names[name] -= 1
        dropped -= was_dropped
        others -= was_other
        if was_classed:
            classed.pop()
        if was_region:
            region = 0

    last = page.rfind(">")
    while at < n:
        # behind the last mark that closes a tag there is none but an open comment: looking for one would cost a scan for each "<"
        m = TAG.search(page, at) if at <= last else None
        end = m.start() if m else n
        if not m and (comment := page.find("<!--", at)) >= 0:
            end = comment
        if end > at and not dropped:
            piece = page[at:end]
            buffer.append(piece)
            if links:
                linked += len(piece)
        elif within is not None and region and classed and not others and end > at and not page[at:end].isspace():
            within.add(classed[0])
        if not m:
            break
        at = m.end()
        name = (m[2] or m[5] or "").lower()
        if not name:
            continue
        closing, attributes = (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if name in BLOCK:
            flush()
        elif name in ("br", "td", "th"):
            buffer.append(" ")
        if closing:
            if name == "a":
                links = 0
            if open_names[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        if name == "a":
            links = 1
        if name in VOID or EMPTY.search(attributes):
            continue
        if name in RAW:
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else n
            continue
        if stack and ((name in BLOCK and stack[-1][0] == "p") or (name == "li" and stack[-1][0] == "li") or (name in ("dt", "dd") and stack[-1][0] in ("dt", "dd"))):
            pop()
        never, says, yes = _declared(name, attributes, region > 0)
        by_class = bool(says) and m.start() not in opened
        no, other = never or by_class, never or (by_class and bool(says & OTHERS))
        if around is not None and yes and classed and not others and not other and not region:
            for place in reversed(classed):  # those below a known one are known
                if place in around:
                    break
                around.add(place)
        if name in HOLDER or no:
            starts = yes and not region and not dropped and not no
            if starts:
                regions += 1
                region = regions
            stack.append((name, no, starts, by_class and not never, other))
            open_names[name] += 1
            dropped += no
            others += other
            if by_class and not never:
                classed.append(m.start())
    flush()
    return out


def distribution(weights: list[int], window: int = WINDOW) -> list[int]:
    """The weight of the window lines that begin at each line."""
    sums = [0, *accumulate(weights)]
    n = len(weights)
    return [sums[min(n, i + window)] - sums[i] for i in range(n)]


def stretches(weights: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """Lines from surge to dive: a surge is a line with weight where the window before it has none, a dive the last before such a window."""
    ahead = distribution(weights, window)
    behind = distribution(weights[::-1], window)[::-1]
    n = len(weights)
    surges = [i for i in range(n) if weights[i] and not (behind[i - 1] if i else 0)]
    dives = [i + 1 for i in range(n) if weights[i] and not (ahead[i + 1] if i + 1 < n else 0)]
    return list(zip(surges, dives, strict=True))


def _text_of(lines: list[tuple[str, int, int]]) -> str:
    if any(region for *_, region in lines):
        lines = [(text, 0, region) for text, _, region in lines if region]
    weights = [0 if 2 * links > len(text) else len(text) for text, links, _ in lines]
    return "\n\n".join(text for a, b in stretches(weights) for text, *_ in lines[a:b])


def main_text(page: str) -> str:
    """The main text: blocks in page order, joined by an empty line.

    A class such as "sidebar" is not believed of a wrapper around everything: where no article element with text is left, what was dropped for
    its classes and holds one (or else is in one) is opened, if that gives more text. Comments, teasers and adverts never are.
    """
    around: set[int] = set()
    within: set[int] = set()
    lines = lines_of(page, around=around, within=within)
    text = _text_of(lines)
    if (around or within) and not any(region for *_, region in lines):
        text = max(text, _text_of(lines_of(page, around or within)), key=len)
    return text


def extract(pages: DataFrame) -> DataFrame:
    """Per page: page_id, url, text, n_chars (code points). One narrow pass.

    A null html is an empty page; a page without main text has an empty one. A null page_id or url
    stays null, repeated rows give repeated rows, and no row gives no row.
    """
    fields = pages.sparkSession.createDataFrame([], "page_id long, url string, text string, n_chars long").schema
    out_schema = arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_chunks(batch, "html"):
                texts = [main_text(x) for x in texts_of(part.column("html"))]
                yield batch_of(out_schema, [part.column("page_id").cast(pa.int64()), part.column("url").cast(pa.string()), texts, [len(t) for t in texts]])

    return documents(pages, "page_id", "url", "html").mapInArrow(run, fields)
