"""Main text of web pages by tag-path ratios.

A page is read as a sequence of text blocks, each with its tag path: the block elements from the root down, with their class
names. What is a menu, advert, notice and the like by its element or role is left out first. So is what a whole class or id
names so, unless it holds most of the page's text or its largest article, and a form, unless the whole page is one; a part of a name only lowers a ratio. Text length and punctuation are summed per path and divided by its number of blocks; the fused ratios are smoothed along the
page, and paths whose blocks stay under a share of their standard deviation are no content. The blocks that are content span
a container; everything that stands in it is kept (of an article or main element in which the ratios chose a block, all of it), so a short paragraph or a heading between long ones is not lost.
Every page is read by itself in one task; nothing grows with the number of pages. Elements point to their parents, so that time
and memory grow with the length of a page, however deep it is.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Share of the standard deviation of the smoothed ratios that content reaches.
SHARE = 0.5
#: What the ratio of a path within an article or main element counts for, beside others.
BONUS = 2.0
#: What an element counts for whose class or id holds a listed word beside others.
PART = 0.5
KERNEL = np.array([0.25, 0.5, 0.25])
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe xmp svg math object canvas audio video select".split())
INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp "
             "small span strike strong sub sup time tt u var wbr".split())
LEFT_OUT = set("head nav footer aside button dialog menu".split()) | RAW
#: Left out unless they hold the largest article, or, on a page without one, most of the text.
FORMS = {"form", "fieldset"}
ROLES = set("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar "
            "tablist tooltip status".split())
#: Names that mark what surrounds an article: a class or id all of whose words are among them.
NAMES = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav "
            "navbar navigation menu submenu breadcrumb breadcrumbs footer sidebar aside cookie cookies consent gdpr notice "
            "alert popup modal overlay newsletter subscribe subscription signup login signin comment comments respond "
            "reply replies disqus share sharing social related recommended recommendations pagination pager masthead topbar toolbar "
            "search widget skip hidden copyright legal disclaimer teaser".split())
HEADER = {"header"}
KEEPERS = {"html", "body", "main"}
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
          "th": {"td", "th"}, "option": {"option"}}
STOPS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*>
    | <(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>"']|"[^"]*"|'[^']*')*+)>
    | <(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
POINTS = re.compile(r"[.,;:!?…。，、！？]")


def _attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if "=" in rest or rest.strip() else {}


def _named(tag: str, given: dict[str, str], inside: bool) -> float:
    """What a block's ratio counts for by the names of an element: 0 if a whole class or id is listed, half if a part is."""
    if not given or tag in KEEPERS:
        return 1.0
    parts = [{w.lower() for w in WORDS.findall(x)} for x in f"{given.get('class', '')} {given.get('id', '')}".split()]
    listed = NAMES if inside or tag == "article" else NAMES | HEADER
    if any(x and x <= listed for x in parts):
        return 0.0
    return 1.0 if all(x.isdisjoint(listed) for x in parts) else PART


def _left_out(tag: str, given: dict[str, str], inside: bool) -> bool:
    """inside: within an article or main element, whose own header belongs to it."""
    if tag in LEFT_OUT or tag in HEADER and not inside:
        return True
    if not given or tag in KEEPERS:
        return False
    return "hidden" in given or given.get("aria-hidden") == "true" or given.get("role", "").lower() in ROLES \
        or bool(re.search(r"display\s*:\s*none", given.get("style", "")))


@dataclass
class Page:
    """Elements in the order in which they open, by number, and the text blocks that are not left out, in page order.

    Element 0 stands for the page. A block belongs to the innermost block element around it; ``inner`` is the innermost element at all.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    weight: list[float] = field(default_factory=lambda: [1.0])      # by names
    form: list[bool] = field(default_factory=lambda: [False])
    path: list[int] = field(default_factory=lambda: [0])            # number of the tag path; equal paths are one
    article: list[int] = field(default_factory=lambda: [0])         # the outermost article or main element around, or 0
    text: list[str] = field(default_factory=list)
    linked: list[int] = field(default_factory=list)                 # characters within links
    inner: list[int] = field(default_factory=list)
    block: list[int] = field(default_factory=list)

    def summed(self, values: list[int], at: list[int]) -> list[int]:
        """Per element the sum of the values of the blocks in it."""
        out = [0] * len(self.parent)
        for e, v in zip(at, values):
            out[e] += v
        for e in range(len(out) - 1, 0, -1):                        # an element opens after its parent
            out[self.parent[e]] += out[e]
        return out

    def __getitem__(self, k: int) -> tuple[int, str, int]:
        """Of block ``k`` the number of its tag path, the text, and the characters within links."""
        return self.path[self.block[k]], self.text[k], self.linked[k]

    def ancestors(self, e: int) -> set[int]:
        out = set()
        while e:
            out.add(e)
            e = self.parent[e]
        return out


def blocks(page: str) -> Page:
    found, paths = Page(), {}
    stack: list[tuple[str, int, bool, bool]] = []           # tag, number, left out, is a link
    around, blocked = [0], [0]                              # innermost element, innermost block element
    opened: dict[str, list[int]] = defaultdict(list)        # by tag the places of open elements in the stack
    words, linked, links, at = [], 0, 0, 0

    def flush():
        nonlocal words, linked
        text = " ".join("".join(words).split())
        if text:
            found.text.append(text)
            found.linked.append(linked)
            found.inner.append(around[-1])
            found.block.append(blocked[-1])
        words, linked = [], 0

    def pop_to(k):
        nonlocal links
        if any(s[0] not in INLINE for s in stack[k:]):
            flush()
        for tag, _, _, link in stack[k:]:
            links -= link
            opened[tag].pop()
            around.pop()
            if tag not in INLINE:
                blocked.pop()
        del stack[k:]

    def last(tags):
        """Place of the innermost open element of these tags."""
        return max((opened[t][-1] for t in tags if opened[t]), default=None)

    while at < len(page):
        m = TOKEN.search(page, at)
        end = m.start() if m else len(page)
        if end > at and not (stack and stack[-1][2]):
            text = html.unescape(page[at:end])
            words.append(text)
            if links:
                linked += len("".join(text.split()))
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if m["close"] or m["close2"]:
            k = last((tag,))
            if k is not None:
                pop_to(k)
            continue
        hidden = bool(stack) and stack[-1][2]
        if tag in VOID:
            if tag in ("br", "wbr"):
                words.append(" " if tag == "br" and not hidden else "")
            elif tag == "hr" and not hidden:
                flush()
            continue
        if tag in RAW:                                      # its content is no markup
            close = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            at = close.end() if close else len(page)
            continue
        if tag not in INLINE:
            k = last(("p",))
            if k is not None:                               # a block ends an open paragraph
                pop_to(k)
            if tag in CLOSES:
                k, stop = last(CLOSES[tag]), last(STOPS.get(tag, ()))
                if k is not None and (stop is None or k > stop):
                    pop_to(k)
            flush()
        if tag == "a":                                      # ends an open one
            k = last(("a",))
            if k is not None and all(s[0] in INLINE for s in stack[k:]):
                pop_to(k)
        hidden = bool(stack) and stack[-1][2]
        given = _attributes(m["rest"] or "")
        inside = bool(opened["article"] or opened["main"])
        link = tag == "a" and "href" in given
        links += link
        name = f"{tag}.{given['class'].strip()}" if given.get("class") else tag
        up, number = around[-1], len(found.parent)
        found.parent.append(up)
        found.tag.append(tag)
        found.weight.append(_named(tag, given, inside))
        found.form.append(tag in FORMS or given.get("role", "").lower() == "form")
        found.article.append(found.article[up] or (number if tag in ("article", "main") else 0))
        found.path.append(found.path[up] if tag in INLINE else paths.setdefault((found.path[blocked[-1]], name), len(paths) + 1))
        opened[tag].append(len(stack))
        stack.append((tag, number, hidden or _left_out(tag, given, inside), link))
        around.append(number)
        if tag not in INLINE:
            blocked.append(number)
    flush()
    return found


def weights(page: Page) -> np.ndarray:
    """The least weight that names give each block.

    Names don't count on an element that holds most of the page's text, or the article or main element with the most text. Beside
    an article, a lone block is not taken for most of the page, as an advert next to a few words would be. A form counts for
    nothing unless it holds that article, or, on a page without one, most of the text.
    """
    size = [len(t) for t in page.text]
    held, blocks_in = page.summed(size, page.inner), page.summed([1] * len(size), page.inner)
    marked: dict[int, int] = defaultdict(int)
    for e, n in zip(page.block, size):
        if page.article[e]:
            marked[page.article[e]] += n
    best = max(marked, key=marked.get, default=0)
    around, half = page.ancestors(best), sum(size) / 2
    least = [1.0] * len(page.parent)
    for e in range(1, len(least)):
        own = page.weight[e]
        if e in around or held[e] > half and not (marked and blocks_in[e] == 1):
            own = 1.0
        if page.form[e] and e not in around and (marked or held[e] <= half):
            own = 0.0
        least[e] = min(least[page.parent[e]], own)
    return np.array([least[e] for e in page.inner])


def ratios(page: Page, kept: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The fused ratio of the path of each kept block, times its weight."""
    length, points, n = defaultdict(int), defaultdict(int), defaultdict(int)
    names = [page.path[page.block[k]] for k in kept]
    for name, k in zip(names, kept):
        length[name] += max(0, len(page.text[k]) - page.linked[k])
        points[name] += len(POINTS.findall(page.text[k]))
        n[name] += 1
    return weight * np.array([length[x] / n[x] * (1 + points[x] / n[x]) for x in names])


def main_text(page: str | None) -> str:
    """Blocks of the main text, one a line; empty if there are none.

    >>> main_text("<nav>Home</nav><article><h1>A  title</h1><p>First &amp; best.<p>Second.</article>")
    'A title\\nFirst & best.\\nSecond.'
    """
    found = blocks((page or "").replace("\0", ""))
    if not found.text:
        return ""
    weight = weights(found)
    blocks_left = np.flatnonzero(weight > 0)
    if not len(blocks_left):
        return ""
    weight = weight[blocks_left]
    block = [found.block[k] for k in blocks_left]
    size = np.array([len(found.text[k]) for k in blocks_left])
    heading = np.array([re.fullmatch("h[1-6]", found.tag[e]) is not None for e in block])
    of = np.array([found.article[e] for e in block])
    marked = of > 0
    linky = (2 * np.array([found.linked[k] for k in blocks_left]) > size) & ~heading       # mostly links, headings aside
    list_like = linky & (np.r_[False, linky[:-1]] | np.r_[linky[1:], False])     # runs of two or more
    fused = ratios(found, blocks_left, np.where(marked, BONUS * weight, weight))
    smooth = np.convolve(np.pad(fused, 1, mode="edge"), KERNEL, mode="valid")
    limit = SHARE * smooth.std()
    passed = (smooth >= limit) & (marked | ~linky)
    if not passed.any():
        return ""
    alone = passed & (fused >= limit)                       # not only by what its neighbours lend
    alone = alone if alone.any() else passed
    within = np.isin(of, of[alone & marked]) & marked
    if within.any() and BONUS * size[alone & marked].sum() >= size[alone & ~marked].sum():
        kept = np.flatnonzero(within)                       # an article closes all gaps around what was chosen in it
    else:
        out = marked & ~within                              # articles that the ratios left out, as cards
        chosen = np.flatnonzero((passed | within) & ~out)
        ends = [block[k] for k in chosen]
        top = _container(found, min(ends), max(ends))
        loose = found.tag[top] in ("", "html", "body")      # the whole page is no container of an article
        after = _next_outside(found, top)
        held = [k for k, e in enumerate(block) if top <= e < after and not (out[k] or loose and list_like[k])]
        first, inside = chosen[0], set(held)
        while first - 1 in inside and heading[first - 1]:
            first -= 1                                      # headings right before the first content
        kept = [k for k in held if first <= k <= chosen[-1]]
    return "\n".join(found.text[blocks_left[k]] for k in kept)


def _container(page: Page, a: int, b: int) -> int:
    """The innermost block element around both ``a`` and ``b``; around all elements that open between them, too."""
    above = page.ancestors(a)
    while b and b not in above:
        b = page.parent[b]
    while page.tag[b] in INLINE:
        b = page.parent[b]
    return b


def _next_outside(page: Page, top: int) -> int:
    """The number of the first element that opens after ``top`` and not in it."""
    inside = {top}
    for e in range(top + 1, len(page.parent)):
        if page.parent[e] not in inside:
            return e
        inside.add(e)
    return len(page.parent)


def extract(pages: DataFrame) -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars (code points).

    A null or empty html gives an empty text; null ids and urls stay; repeated rows are kept; other columns are ignored.
    Pages are read whole, whatever their length and depth; of articles with equally much text the first counts as the largest. No
    rows give no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:2], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
