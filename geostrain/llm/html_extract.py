"""Operator 8: the main text of a web page.

The standard library's parser streams events; every block element makes a
line.  A line's text-to-tag ratio is its text outside links over its tags; the
ratios are smoothed with a Gaussian along the page, and the lines above a
threshold, of which most isn't links, form the content clusters.  The clusters
choose the regions: of articles and main elements those that hold a clustered
line, on a page without any the innermost container that holds all of them.
Every line of a region is returned, whatever its own ratio.

Menus, footers, asides, forms, scripts, styles and the like are never lines.
A name (class, id, role) that stands for an advert, a notice, reader comments
and so on is evidence only: lines under it stand back behind the others, and if
there are no others, as in a wrapper around the whole page, it means nothing.
Such a name counts if each of its parts does: ``cookie-notice`` and
``comment-list`` do, ``no-sidebar`` and ``legal-analysis`` don't.

Time is linear in the page, however deep its elements lie and whatever end tags
are missing.

Defined results: a null or empty page, or one without text, gives an empty
string; unclosed elements end with the block or the page; equal pages, and rows
with equal or null ids, give a row each; of regions with equal ratios all stay;
pages of any size are read whole; an empty table gives an empty result; further
columns are ignored whatever their names are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, trimmed

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SKIPPED = frozenset("aside canvas datalist dialog footer head iframe input menu nav noscript object option script select style svg template textarea title video audio".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CONTAINERS = frozenset("article main section div body td".split())
INLINE = frozenset("a b button em font i label small span strong u".split())
#: Elements that a head may hold; any other closes it, as text does.
IN_HEAD = frozenset("base basefont bgsound head html link meta noscript script style template title".split())
#: Inline elements of forms: a line of nothing else is no text.
CONTROLS = frozenset({"button", "label"})
#: Words of class, id and role that mark an element as no part of the article.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments commentlist disqus reply replies cookie cookies consent discussion discussions notice notices alert popup modal overlay newsletter subscribe subscription signup social share sharing related recommended widget toolbar pagination pager copyright legal disclaimer search login complementary contentinfo".split())
#: Words that may stand beside those in one name.
NEUTRAL = frozenset("area bar block body bottom box button buttons col container content form global google group holder icon icons inner item items left link links list main outer page panel placement post posts primary reader right row secondary section site slot text thread top unit user users widget wrap wrapper".split())
#: Elements that close an open element of the named kinds.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SIGMA = 1.5
#: The threshold is the standard deviation of the smoothed ratios, or this share of their mean if that is less.
LEAST_SHARE = 0.2
#: Lines of a container that can stand apart from the content, at least.
APART = 3
_SPACES = re.compile(r"\s+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")


def stands_back(name: str) -> bool:
    """Whether one name of an element stands for something beside the article."""
    parts = [p.lower() for p in _PARTS.findall(name)]
    return any(p in BOILERPLATE for p in parts) and all(p in BOILERPLATE or p in NEUTRAL or p.isdigit() for p in parts)


class Open(NamedTuple):
    """An open element and what it and those around it mean for its text."""

    name: str
    skipped: bool
    container: int  # the innermost one
    region: int  # the outermost article or main element, or 0
    doubt: bool  # a name that stands back, outside the region
    inner_doubt: bool  # one inside it
    form: int  # the outermost form, or 0


class Line(NamedTuple):
    text: str
    tags: int
    linked: int  # characters in links
    place: Open


_PAGE = Open("", False, 0, 0, False, False, 0)


class _Lines(HTMLParser):
    """The lines of a page, and of each container the one around it."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack = [_PAGE]
        self.inline = [Counter()]  # of each open block, the elements open in it
        self.blocks = Counter()
        self.lines: list[Line] = []
        self.parts: list[str] = []
        self.above = [0]  # 0 is the page
        self.tags = self.linked = self.links = self.skips = self.regions = self.controls = 0
        self.free = False  # whether the line has text outside controls
        self.forms = [True]  # of each form, whether it holds a region; 0 is none

    def flush(self) -> None:
        text = _SPACES.sub(" ", "".join(self.parts)).strip()
        if text and self.free:
            self.lines.append(Line(text, self.tags, self.linked, self.stack[-1]))
        self.parts, self.tags, self.linked, self.free = [], 0, 0, False

    def push(self, item: Open) -> None:
        self.stack.append(item)
        self.skips += item.skipped
        self.links += item.name == "a"
        self.controls += item.name in CONTROLS
        if item.name in BLOCKS or item.name in SKIPPED:
            self.blocks[item.name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][item.name] += 1

    def pop(self) -> None:
        item = self.stack.pop()
        self.skips -= item.skipped
        self.links -= item.name == "a"
        self.controls -= item.name in CONTROLS
        if item.name in BLOCKS or item.name in SKIPPED:
            self.blocks[item.name] -= 1
            self.inline.pop()
        else:
            self.inline[-1][item.name] -= 1

    def handle_starttag(self, tag, attrs):
        if self.stack[-1].name == "head" and tag not in IN_HEAD:
            self.pop()
        if tag in BLOCKS:
            self.flush()
            while self.stack[-1].name in INLINE:
                self.pop()  # an inline element that its block didn't close
            if self.stack[-1].name in CLOSES.get(tag, {"p"}):
                self.pop()
        self.tags += 1
        if tag in VOID:
            if tag in ("br", "hr", "img"):
                self.parts.append(" ")
            return
        around = self.stack[-1]
        skipped = tag in SKIPPED or tag == "header" and not around.region
        doubt = False
        for name, value in attrs:
            if name == "hidden" or name == "style" and value and "display:none" in value.replace(" ", "").lower():
                skipped = skipped or tag not in ("html", "body")
            elif value and (name == "aria-label" and stands_back(value) or name in ("class", "id", "role") and any(map(stands_back, value.split()))):
                doubt = True
        container, region = around.container, around.region
        if tag in CONTAINERS:
            self.above.append(container)
            container = len(self.above) - 1
        inner = around.inner_doubt or doubt and region > 0
        form = around.form
        if tag == "form" and not form:
            self.forms.append(False)
            form = len(self.forms) - 1
        if tag in ("article", "main"):
            self.forms[form] = True
            if not region:
                self.regions += 1
                region = self.regions
        self.push(Open(tag, skipped, container, region, around.doubt or doubt and not around.region, inner, form))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in BLOCKS:
            self.flush()
        self.tags += 1
        if self.blocks[tag] if tag in BLOCKS or tag in SKIPPED else self.inline[-1][tag]:
            while self.stack[-1].name != tag:
                self.pop()
            self.pop()

    def handle_data(self, data):
        if self.stack[-1].name == "head" and not data.isspace():
            self.pop()
        if not self.skips:
            self.parts.append(data)
            self.free = self.free or not self.controls and not data.isspace()
            if self.links:
                self.linked += len(data.strip())


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian smoothing; the kernel is cut at three sigmas and renormalised."""
    reach = math.ceil(3 * sigma)
    kernel = [math.exp(-(d * d) / (2 * sigma * sigma)) for d in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = kernel[lo - i + reach : hi - i + reach]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def candidates(lines: list[Line]) -> list[bool]:
    """The lines that don't stand back; names that would leave none mean nothing."""
    inside = [x.place.region > 0 for x in lines]
    for chosen in (
        [r and not x.place.doubt and not x.place.inner_doubt for r, x in zip(inside, lines, strict=True)],
        [r and not x.place.inner_doubt for r, x in zip(inside, lines, strict=True)],
        [not r and not x.place.doubt for r, x in zip(inside, lines, strict=True)] if not any(inside) else inside,
    ):
        if any(chosen):
            return chosen
    return [True] * len(lines)


def clustered(lines: list[Line], chosen: list[bool]) -> list[bool]:
    """Lines whose smoothed ratio reaches the threshold, and of which most isn't links.

    Smoothing also lifts what is next to the content, so a cluster begins and
    ends with a line whose own ratio reaches the threshold, or a heading.
    """
    raw = [max(0, len(x.text) - x.linked) / (1 + x.tags) if c else 0.0 for x, c in zip(lines, chosen, strict=True)]
    ratio = smoothed(raw)
    own = [r for r, c in zip(ratio, chosen, strict=True) if c]
    mean = sum(own) / len(own)
    threshold = min(mean * LEAST_SHARE, math.sqrt(sum((r - mean) ** 2 for r in own) / len(own))) * (1 - 1e-9)
    content = [c and r >= threshold and 2 * x.linked < len(x.text) for x, r, c in zip(lines, ratio, chosen, strict=True)]
    firm = [c and (v >= threshold or x.place.name in HEADINGS) for x, v, c in zip(lines, raw, content, strict=True)]
    for order in (range(len(lines)), range(len(lines) - 1, -1, -1)):
        edge = True
        for i in order:
            edge = not content[i] or edge and not firm[i]
            content[i] = content[i] and not edge
    return content


def outside_forms(lines: list[Line], forms: list[bool]) -> list[Line]:
    """The lines that don't lie in a form, save one around the page.

    A form is around the page if it holds an article or main element, or on a page
    without any most of the text.
    """
    if len(forms) == 1:
        return lines
    if any(x.place.region for x in lines):
        return [x for x in lines if forms[x.place.form]]
    size = [0] * len(forms)
    for x in lines:
        size[x.place.form] += len(x.text) - x.linked
    return [x for x in lines if not x.place.form or 2 * size[x.place.form] > sum(size)]


def apart(lines: list[Line], content: list[bool], above: list[int]) -> list[bool]:
    """Of each container, whether it stands apart from the content around it.

    That is one of ``APART`` lines or more, none of a cluster, most of whose text
    is links, or which has more tags than characters.
    """
    sums = [[0, 0, 0, 0, 0] for _ in above]
    for x, c in zip(lines, content, strict=True):
        for i, v in enumerate((c, len(x.text), x.linked, x.tags, 1)):
            sums[x.place.container][i] += v
    for c in range(len(above) - 1, 0, -1):
        for i in range(5):
            sums[above[c]][i] += sums[c][i]
    out = [False] * len(above)
    for c in range(1, len(above)):
        held, size, linked, tags, n = sums[c]
        out[c] = out[above[c]] or n >= APART and not held and (2 * linked > size or tags > size)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, above = outside_forms(parser.lines, parser.forms), parser.above
    if not lines:
        return ""
    chosen = candidates(lines)
    content = clustered(lines, chosen)
    if any(content):
        gone = apart(lines, content, above)
        chosen = [c and not gone[x.place.container] for x, c in zip(lines, chosen, strict=True)]
    if any(c and x.place.region for x, c in zip(lines, chosen, strict=True)):
        regions = {x.place.region for x, c in zip(lines, content, strict=True) if c} or {x.place.region for x in lines}
        return "\n".join(x.text for x, c in zip(lines, chosen, strict=True) if c and x.place.region in regions)
    held = [0] * len(above)
    for x, c in zip(lines, content, strict=True):
        held[x.place.container] += c
    for c in range(len(held) - 1, 0, -1):  # a container comes after the one around it
        held[above[c]] += held[c]
    root = max(c for c in range(len(held)) if held[c] == held[0]) if held[0] else 0
    under = [root == 0]
    for c in range(1, len(held)):
        under.append(c == root or under[above[c]])
    return "\n".join(x.text for x, c in zip(lines, chosen, strict=True) if c and under[x.place.container])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page; a map without a shuffle."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "html"):
            text = [main_text(html) for html in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(trimmed(extracted), "page_id long, url string, text string, n_chars long")
