"""HTML extraction by two-pass block rules.

Pass 1 cuts a page into blocks and classifies each by link density, length and stop-word density: good, bad,
or undecided when it is short or in between. Pass 2 gives undecided blocks the label of their nearest decided
neighbours (the nearer one; at equal distance the one in the same container, a heading looks ahead first, and good wins).

Structure is used where the page states it: blocks inside menus, headers, footers, sidebars, adverts, notices,
forms and comment sections are bad from the start, and inside ``article`` or ``main`` running text is never
bad for want of stop words. Scripts, styles, comments and hidden markup are no blocks at all.

Edge cases: null or empty html gives an empty text; a page without a good block gives an empty text; a cut-off
tag or reference at the end of the page is handled as browsers do. A quote in an unquoted value is an ordinary character; a quoted value
without its end, an open head, and an open element that is skipped (other than script, style and their like, which run to the end of the page)
do not swallow the page. The work is linear in the page, whatever its tags. Repeated rows give equal results.
"""

from __future__ import annotations

import html as _html
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortspark.llm.common import plain

#: Frequent function words of English, French, German, Spanish, Italian, Portuguese and Dutch.
STOP_WORDS = frozenset("""
the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were all we
le la les de des du et un une est que qui dans en pour au aux sur pas par avec ce il elle ne se sont son mais plus nous vous
der die das und ist in den von zu mit sich auf für ein eine im dem nicht als auch es an werden aus er hat dass sie nach bei
el los las y en un una por con no para al lo como más o pero sus le ha me sin sobre este ya entre cuando del se su
il di che e per non sono una con da si come anche della nel alla dei gli
o os as um uma com não do da no na em são mais foi ao dos
het een van en dat op te zijn met voor niet aan er om ook door maar
""".split())
#: HTML element classes.
BLOCK_TAGS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer
form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot
th thead title tr ul""".split())
SKIP_TAGS = frozenset("script style noscript template svg math iframe object textarea select button head title canvas audio video map noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BOILER_TAGS = frozenset("nav header footer aside form menu dialog fieldset".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
BOILER_NAMES = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright
disqus footer gdpr header masthead menu modal nav navbar navigation newsletter notice pagination pager popup promo promotion related
reply replies search share sharing sidebar skip social sponsor sponsored subscribe subscription tags toolbar topbar widget widgets""".split())
BOILER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alertdialog".split())

#: An attribute: a name, then perhaps a value; quotes count only where a value begins, as in browsers.
_VALUE = r"""(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+"""
_TAG = re.compile(rf"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+{_VALUE.replace("([^", "(?:[^")})*+)(?:>|\Z)|<[!?/][^>]*+(?:>|\Z)""", re.S)
_ATTR = re.compile(rf"""([^\s/>][^\s/>=]*+){_VALUE}""", re.S)
#: Elements whose text runs to their end tag, or to the end of the page without one.
RAW_TAGS = frozenset("script style textarea title iframe noframes".split())
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[a-z]+")
_WORDS = re.compile(r"[^\W\d_]+")

LENGTH_LOW, LENGTH_HIGH, STOP_LOW, STOP_HIGH, LINK_HIGH = 70, 200, 0.30, 0.32, 0.2


class Block:
    __slots__ = ("bad", "heading", "inside", "link", "parts", "path", "text")

    def __init__(self, path, bad, inside, heading):
        self.parts, self.link, self.path, self.bad, self.inside, self.heading, self.text = [], 0, path, bad, inside, heading, ""


_BODY = re.compile("<body", re.I)


@cache
def _end_tag(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}\s*>?", re.I)


def _boilerplate(tag: str, attrs: str, inside: bool) -> bool:
    if tag in BOILER_TAGS and not (inside and tag == "header"):
        return True
    if not attrs or tag in ("body", "html", "article", "main"):
        return False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), (a or b or c).lower()  # other names, data-id say, are none of these
        if name in ("class", "id") and any(part in BOILER_NAMES for part in _NAME.findall(value)):
            return True
        if name == "role" and value in BOILER_ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
            return True
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
    return False


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, with their container, link share and markup verdict."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, int]] = []  # tag, in boilerplate, in article or main, container number
    links, number, block = 0, 0, None
    pos, end = 0, len(page)
    open_tags: Counter = Counter()  # of the stack, so that end tags without a start cost nothing
    endless: set[str] = set()       # tags that have no end tag in the rest of the page

    def push(tag: str, bad: bool, inside: bool, container: int) -> None:
        stack.append((tag, bad, inside, container))
        open_tags[tag] += 1

    def pop() -> str:
        tag = stack.pop()[0]
        open_tags[tag] -= 1
        return tag

    def add(text: str) -> None:
        nonlocal block
        if not text:
            return
        if block is None:
            top = stack[-1] if stack else ("", False, False, 0)
            block = Block(top[3], top[1], top[2], top[0] in HEADINGS)
            out.append(block)
        block.parts.append(text)
        if links:
            block.link += len(text.strip())

    while pos < end:
        m = _TAG.search(page, pos)
        if m is None:
            add(page[pos:])
            break
        if m.start() > pos:
            add(page[pos:m.start()])
        pos = m.end()
        close, tag, attrs = m[1], m[2], m[3]
        if not tag:
            continue
        tag = tag.lower()
        if not close and tag in SKIP_TAGS and not attrs.rstrip().endswith("/"):
            shut = None if tag in endless else _end_tag(tag).search(page, pos)
            if shut:
                pos = shut.end()
                continue
            endless.add(tag)
            if tag in ("head", "noframes"):
                body = _BODY.search(page, pos)
                pos = body.start() if body else pos if tag == "head" else end  # a head ends where the page's text begins
            elif tag in RAW_TAGS:
                pos = end
            continue
        if tag == "a":
            links = 0 if close else 1
        elif tag == "br":
            add(" ")
        elif tag in BLOCK_TAGS:
            block = None
            if close:
                while open_tags[tag] and pop() != tag:
                    pass
                links = 0
            elif tag not in VOID_TAGS:
                if tag in ("p", "li") and stack and stack[-1][0] == tag:
                    pop()
                _, bad, inside, container = stack[-1] if stack else ("", False, False, 0)
                bad = bad or _boilerplate(tag, attrs, inside)
                inside = inside or tag in ("article", "main")
                if tag not in ("p", "li", *HEADINGS):
                    number += 1
                    container = number
                push(tag, bad, inside, container)
        elif tag not in VOID_TAGS and not close and attrs and _boilerplate(tag, attrs, bool(stack and stack[-1][2])):
            # an inline element that names itself boilerplate: its text stands apart
            block = None
            _, _, inside, container = stack[-1] if stack else ("", False, False, 0)
            push(tag, True, inside, container)
        elif close and stack and stack[-1][0] == tag:
            block = None
            pop()
    kept = []
    for b in out:
        raw = "".join(b.parts)
        b.text = _SPACE.sub(" ", _html.unescape(raw) if "&" in raw else raw).strip()
        if b.text:
            kept.append(b)
    return kept


def classify(bs: list[Block]) -> list[bool]:
    """True for the blocks that belong to the main text."""
    label: list[int | None] = []
    for b in bs:
        n = len(b.text)
        if b.bad or b.link > LINK_HIGH * n and (not b.inside or b.link > 0.8 * n and n < LENGTH_LOW):
            label.append(0)
            continue
        w = _WORDS.findall(b.text.lower())
        stop = sum(x in STOP_WORDS for x in w) / len(w) if w else 0.0
        if n < LENGTH_LOW:
            label.append(None)
        elif stop >= STOP_HIGH and n > LENGTH_HIGH or b.inside and stop >= STOP_LOW / 3:
            label.append(1)
        elif stop >= STOP_LOW / 3:
            label.append(None)
        else:
            label.append(None if b.inside else 0)
    n = len(bs)
    running = sum(len(x.text) for x in bs if not x.bad)
    before, after = [-1] * n, [n] * n
    for i in range(n):
        before[i] = i if label[i] is not None else before[i - 1] if i else -1
    for i in range(n - 1, -1, -1):
        after[i] = i if label[i] is not None else after[i + 1] if i + 1 < n else n
    out = []
    for i, b in enumerate(bs):
        if label[i] is not None:
            out.append(bool(label[i]))
            continue
        near = [j for j in (before[i], after[i]) if 0 <= j < n]
        own = [j for j in near if bs[j].path == b.path or b.inside and bs[j].inside and not bs[j].bad]
        if b.heading and after[i] in own:
            out.append(bool(label[after[i]]))
            continue
        near = own or near
        if not near:
            out.append(b.inside or running >= LENGTH_LOW)
        else:
            least = min(abs(j - i) for j in near)
            out.append(any(label[j] for j in near if abs(j - i) == least))
    if not any(out) and any(b.inside and not b.bad for b in bs):
        out = [b.inside and not b.bad for b in bs]  # an article of short blocks only
    return out


def main_text(page: str | None) -> str:
    bs = blocks(page or "")
    return "\n".join(b.text for b, good in zip(bs, classify(bs), strict=True) if good)


def extract(df: DataFrame, html_col: str = "html") -> DataFrame:
    """Append text and n_chars (code points) to every row of ``df``."""

    @F.pandas_udf("string")
    def text(pages: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for page in pages:
            yield page.map(main_text, na_action=None).astype("object")

    out = df.withColumn("text", text(F.col(f"`{html_col}`")))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op4_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(plain(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
