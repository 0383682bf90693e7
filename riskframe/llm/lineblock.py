"""Main-text extraction by the line-block distribution.

Markup is stripped into lines, one for each block element. Lines inside boilerplate
elements (menus, headers, footers, forms and the like, by tag or by class and id words) are
taken out, and so are runs of ``window`` or more lines that hold nothing but links. The
length of a line is its text outside links, times ``SENTENCE`` when it ends a sentence. An
article or main element that holds most of this text outweighs the rest: lines inside it
count ``MAIN`` times, lines outside it have length zero. The block at line i is the sum of
the lengths of ``window`` lines from i on. A surge is a block above the threshold after one
that is not, a dive is a block that falls to it; the lines from a surge to its dive are
kept, on every page. The threshold is ``floor`` or, on pages of little text, ``share`` of the
largest block, so one long paragraph does not raise it above ``floor``.

Null and empty pages give an empty text. White space inside a line becomes one space and
lines are joined by one space. Repeated pages are extracted alike. Only the named columns
are read. Elements left open end with the element around them, scripts, styles and other
elements without markup inside with the page. Very long pages are scanned once, forward.
Lines of equal length are treated alike, so ties do not arise; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

WINDOW = 3
SHARE = 0.25
FLOOR = 80
#: Weights of a line: at the end of a sentence, and inside an article or main that holds most text.
SENTENCE = 4
MAIN = 32

#: Elements whose content is no markup; left open they reach to the end of the page, as in browsers.
_RAW = "script|style|iframe|textarea|title"
#: Elements with markup inside that hold no text of the article.
_DROPPED = frozenset("noscript template svg math object select canvas audio video".split())
# Each alternative ends at the end of the page or at the next "<" outside quotes, so no start is scanned far in vain.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{_RAW})\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+[^<>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/<>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_ATTR = re.compile(r"\b(class|id|role|style|hidden|aria-hidden)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
#: Elements that begin and end a line (fixed values of HTML).
_BLOCK = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot "
    "th thead tr ul".split()
)
_SENTENCE_END = re.compile(r"[.!?\u2026\u3002\uff01\uff1f][\"')\]\u00bb\u2019\u201d]*\Z")
_HREF = re.compile(r"\bhref\b", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_MAIN = frozenset(("article", "main"))
_BOILER_TAGS = frozenset("nav header footer aside form button dialog menu head".split())
_BOILER_WORD = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisement|advertising|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|"
    r"gdpr|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notices?|pagination|popup|promo|promoted|related|"
    r"replies|share|sharing|sidebar|signup|social|sponsor(?:ed)?|subscribe|toolbar|topbar|widget|search|login|hidden|"
    r"complementary|contentinfo)(?=$|[\s_-])",
    re.I,
)
#: An open element of these ends when one of the same kind begins (optional end tags).
_IMPLIED = {
    "p": _BLOCK - {"br"}, "li": frozenset(("li",)), "dt": frozenset(("dt", "dd")), "dd": frozenset(("dt", "dd")),
    "tr": frozenset(("tr", "tbody", "tfoot")), "td": frozenset(("td", "th", "tr")), "th": frozenset(("td", "th", "tr")),
    "option": frozenset(("option",)),
}


def _is_boiler(tag: str, attrs: str) -> bool:
    if tag in _BOILER_TAGS or tag in _DROPPED:
        return True
    if not attrs or tag in _MAIN and "comment" not in attrs.lower() or tag in ("html", "body"):
        return False
    for m in _ATTR.finditer(attrs):
        name, value = m[1].lower(), (m[2] or "").strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
        if name in ("class", "id", "role") and _BOILER_WORD.search(value):
            return True
    return False


def lines(html: str) -> list[tuple[str, bool, bool, int]]:
    """(text, inside boilerplate, inside an article or main element, length outside links) for each line with text."""
    out: list[tuple[str, bool, bool, int]] = []
    text: list[str] = []
    plain: list[str] = []
    stack: list[tuple[str, bool, bool]] = []
    boiler = main = 0
    #: Depth of the stack where the open link began, -1 outside links.
    link = -1

    def flush() -> None:
        nonlocal text, plain
        if text:
            line = " ".join(unescape("".join(text)).split())
            if line:
                n = len(line) if len(plain) == len(text) else len(" ".join(unescape("".join(plain)).split()))
                out.append((line, boiler > 0, main > 0, n))
            text, plain = [], []

    def add(part: str) -> None:
        text.append(part)
        if link < 0:
            plain.append(part)

    def pop() -> None:
        nonlocal boiler, main, link
        _, b, m = stack.pop()
        boiler -= b
        main -= m
        if link > len(stack):
            link = -1

    at = 0
    for t in _TOKEN.finditer(html):
        if t.start() > at:
            add(html[at:t.start()])
        at = t.end()
        tag = t["tag"]
        if tag is None:
            if t["raw"]:
                add(" ")
            continue
        tag = tag.lower()
        if tag == "a":
            link = len(stack) if not t["close"] and _HREF.search(t["attrs"]) else -1
            continue
        if tag in _BLOCK:
            flush()
        if t["close"]:
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if depth is not None:
                if stack[depth][1] or stack[depth][2]:
                    flush()
                while len(stack) > depth:
                    pop()
            continue
        while stack and tag in _IMPLIED.get(stack[-1][0], ()):
            pop()
        if tag in _VOID or t["attrs"].endswith("/"):
            continue
        b, m = _is_boiler(tag, t["attrs"]), tag in _MAIN
        # A header inside the article carries its headline.
        b = b and not (tag == "header" and main)
        if b or m:
            flush()
        if tag in _BLOCK or b or m:
            stack.append((tag, b, m))
            boiler += b
            main += m
    add(html[at:])
    flush()
    return out


def _without_boilerplate(found: list[tuple[str, bool, bool, int]], window: int) -> list[tuple[str, bool, int]]:
    """(text, inside an article or main, length outside links), without boilerplate and long runs of links."""
    out: list[tuple[str, bool, int]] = []
    run = 0
    for line, b, m, n in [*((x, b, m, n) for x, b, m, n in found if not b), ("", False, False, 1)]:
        if n:
            if run >= window:
                del out[-run:]
            run = 0
        else:
            run += 1
        out.append((line, m, n))
    return out[:-1]


def main_text(html: str | None, window: int = WINDOW, share: float = SHARE, floor: float = FLOOR) -> str:
    """Text between the surge and dive points of the line-block distribution."""
    found = _without_boilerplate(lines(html or ""), window)
    inner = sum(n for _, m, n in found if m)
    wins = 2 * inner > sum(n for _, _, n in found)
    size = [
        0 if wins and not m else n * (SENTENCE if _SENTENCE_END.search(x) else 1) * (MAIN if wins else 1)
        for x, m, n in found
    ]
    total = [0]
    for n in size:
        total.append(total[-1] + n)
    block = [total[min(i + window, len(size))] - total[i] for i in range(len(size))]
    least = min(floor, share * max(block, default=0))
    # Between surge and dive nothing is left out but what lies outside the winning element.
    return " ".join(x for (x, m, _), n in zip(found, block) if n > least and (m or not wins))


def text_column(html: Column, window: int = WINDOW, share: float = SHARE, floor: float = FLOOR) -> Column:
    @F.pandas_udf(T.StringType())
    def of(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in pages:
            yield pd.Series([main_text(h, window, share, floor) for h in batch], dtype=object)

    return of(html)


def extract(pages: DataFrame, keep: tuple[str, ...] = ("page_id", "url"), html: str = "html", **options) -> DataFrame:
    """The ``keep`` columns, text and n_chars (code points)."""
    text = pages.select(*keep, text_column(F.col(html), **options).alias("text"))
    return text.select(*keep, "text", F.length("text").cast("bigint").alias("n_chars"))
