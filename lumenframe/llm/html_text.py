"""Main text of web pages (op 10): parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A line is a block of the page: the text between two block-level tags. The ratio of a line's
characters to its tags is smoothed over its neighbours; lines above the threshold form clusters.
An article or main element with most of their text is the content region; on a page without one,
the search goes down from the page to the container that holds nearly all of it, and boxes in
there with few clustered lines (menus, link lists) go. The region's lines are the result, short
ones included, without those in menus, headers, footers, sidebars, notices, adverts, forms and
reader comments. These are told by tag and role, and by a class or id all of whose words
speak of such boxes; where only some do (``share-prices``), a box goes if most of its lines are
outside the clusters. A header within an article or main element is the article's own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr img".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("script style head template noscript iframe object svg math canvas audio video map select textarea button title".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog".split())
CONTAINERS = frozenset("article main".split())
PARAGRAPH = frozenset(["p"])
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
SIBLINGS = {"li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "tr": frozenset(["tr", "td", "th"]), "td": frozenset(["td", "th"]), "th": frozenset(["td", "th"]), "option": frozenset(["option"])}
SCOPES = {"li": frozenset(["ul", "ol", "menu"]), "dt": frozenset(["dl"]), "dd": frozenset(["dl"]), "tr": frozenset(["table"]), "td": frozenset(["table", "tr"]), "th": frozenset(["table", "tr"]), "option": frozenset(["select"])}
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words that go along with marks in class and id values.
PARTS = frozenset("area bar block body bottom box buttons center col column container content count feed form group head heading header here icon icons image inline inner item items label left line link links list main message more module on outer page panel post row right section site slot text thread title top unit us wrap wrapper".split())
# Words of class and id values that mark boilerplate.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner nav navbar navigation menu menus breadcrumb breadcrumbs sidebar aside footer masthead cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments respond disqus replies widget widgets pagination pager skip toolbar".split()
)
WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+")
COMMENT_END = re.compile("--!?>")
SPACE = re.compile(r"\s+")
RADIUS, SIGMA = 2, 1.0
KERNEL = [math.exp(-(i * i) / (2 * SIGMA * SIGMA)) for i in range(-RADIUS, RADIUS + 1)]
MOST, FEW = 0.8, 1 / 3  # share of the clusters' text that leads into a container; share of clustered lines under which a box goes
EDGE = 2  # a step into a container that would leave out no more lines than these is not taken: they are its title and by-line
HEAVY = 0.5  # a container is the content region when it has this share of the clusters' text


class Lines(HTMLParser):
    """Collects lines: (text, tags, innermost container), and each container's parent; 0 is the page.

    A page is fed whole, so what has no end is left out to the page's end, as browsers do, and every
    construct is looked at once: time is linear in the page.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, bool]] = []  # open tags and whether they drop their text
        self.open: dict[str, list[int]] = {}  # places in the stack by tag
        self.blocks: list[tuple[int, int]] = [(-1, 0)]  # places of open containers, and their ids
        self.parent: dict[int, int] = {}
        self.kinds: dict[int, str] = {}
        self.soft: set[int] = set()
        self.lines: list[tuple[str, int, int]] = []
        self.text: list[str] = []
        self.tags, self.dropping = 0, 0

    def parse_comment(self, i: int, report: int = 1) -> int:
        for short in ("<!-->", "<!--->"):
            if self.rawdata.startswith(short, i):
                return i + len(short)
        m = COMMENT_END.search(self.rawdata, i + 4)
        return m.end() if m else len(self.rawdata)

    def parse_html_declaration(self, i: int) -> int:
        page, size = self.rawdata, len(self.rawdata)
        end = page.find(">", i + 2)
        if page[i + 2 : i + 9].lower() == "doctype":
            inner = page.find("[", i, end if end >= 0 else size)
            if inner >= 0:  # declarations of its own
                close = page.find("]>", inner)
                return close + 2 if close >= 0 else size
        return end + 1 if end >= 0 else size

    def parse_pi(self, i: int) -> int:
        return self.to_end(super().parse_pi(i))

    def parse_starttag(self, i: int) -> int:
        return self.to_end(super().parse_starttag(i))

    def parse_endtag(self, i: int) -> int:
        return self.to_end(super().parse_endtag(i))

    def to_end(self, at: int) -> int:
        return at if at >= 0 else len(self.rawdata)

    def flush(self) -> None:
        if self.text:
            text = SPACE.sub(" ", "".join(self.text)).strip()
            if text:
                self.lines.append((text, max(self.tags, 1), self.blocks[-1][1]))
                self.tags = 0
            self.text = []

    def pop_to(self, at: int) -> None:
        for tag, drops in self.stack[at:]:
            self.dropping -= drops
            self.open[tag].pop()
        del self.stack[at:]
        while self.blocks[-1][0] >= at:
            self.blocks.pop()

    def last(self, tags: frozenset[str]) -> int:
        """Place of the innermost open tag of some kinds, -1 if there is none."""
        return max((at[-1] for t in tags if (at := self.open.get(t))), default=-1)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P and (p := self.last(PARAGRAPH)) >= 0 and p == self.blocks[-1][0]:
            self.pop_to(p)
        if tag in SIBLINGS and (at := self.last(SIBLINGS[tag])) > self.last(SCOPES[tag]):
            self.pop_to(at)
        marked = self.marked(tag, attrs)
        drops = tag in HIDDEN or marked == 2
        if tag not in INLINE:
            made = len(self.kinds) + 1
            self.kinds[made], self.parent[made] = tag, self.blocks[-1][1]
            self.blocks.append((len(self.stack), made))
            if marked == 1:
                self.soft.add(made)
        self.open.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, drops))
        self.dropping += drops

    def marked(self, tag: str, attrs: list) -> int:
        """2 for boilerplate, 1 for what may be, 0 else."""
        if tag == "header" and self.last(CONTAINERS) >= 0:
            return 0
        if tag in BOILERPLATE:
            return 2
        if tag in ("html", "body", *CONTAINERS):
            return 0
        out = 0
        for name, value in attrs:
            if name in ("class", "id") and value:
                for one in value.split():
                    found = [w.lower() for w in WORD.findall(one)]
                    if any(w in MARKS for w in found):
                        out = max(out, 2 if all(w in MARKS or w in PARTS for w in found) else 1)
            elif name == "role" and value and value.lower() in ROLES or name == "hidden" or name == "aria-hidden" and value == "true":
                out = 2
            elif name == "style" and value and "display:none" in value.replace(" ", "").lower():
                out = 2
        return out

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag not in INLINE:
            self.flush()
        at = self.last(frozenset([tag]))
        if at >= 0 and (tag not in INLINE or at > self.blocks[-1][0]):  # a stray end of an inline tag closes no block
            self.pop_to(at)

    def handle_data(self, data: str) -> None:
        if not self.dropping:
            self.text.append(data)


def smoothed(ratios: list[float]) -> list[float]:
    out = []
    for i in range(len(ratios)):
        total = weight = 0.0
        for j in range(-RADIUS, RADIUS + 1):
            if 0 <= i + j < len(ratios):
                total += KERNEL[j + RADIUS] * ratios[i + j]
                weight += KERNEL[j + RADIUS]
        out.append(total / weight)
    return out


def threshold(values: list[float]) -> float:
    """Their standard deviation, but never above the mean: uniform pages are content throughout."""
    mean = sum(values) / len(values)
    return min(mean, math.sqrt(sum((v - mean) ** 2 for v in values) / len(values)))


def summed(values: dict[int, int], parent: dict[int, int]) -> dict[int, int]:
    """Values of containers with those of all containers within; a container's id is above its parent's."""
    out = {0: 0, **dict.fromkeys(parent, 0)}
    for box, value in values.items():
        out[box] += value
    for box in sorted(parent, reverse=True):
        out[parent[box]] += out[box]
    return out


def by_box(lines: list[tuple[str, int, int]], values: list[int]) -> dict[int, int]:
    out: dict[int, int] = {}
    for (_, _, box), value in zip(lines, values, strict=True):
        out[box] = out.get(box, 0) + value
    return out


def within(boxes: set[int], parent: dict[int, int]) -> set[int]:
    """``boxes`` and all containers within them."""
    out = set(boxes)
    for box in sorted(parent):
        if parent[box] in out:
            out.add(box)
    return out


def main_text(html: str | None) -> str:
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.flush()
    lines, parent = parser.lines, parser.parent
    if not lines:
        return ""
    ratio = smoothed([len(text) / tags for text, tags, _ in lines])
    limit = threshold(ratio)
    heavy = [len(text) if r >= limit else 0 for (text, _, _), r in zip(lines, ratio, strict=True)]
    if parser.soft:  # a box that may be boilerplate goes if most of its lines are outside the clusters
        n, rich = (summed(by_box(lines, v), parent) for v in ([1] * len(lines), [int(w > 0) for w in heavy]))
        gone = within({box for box in parser.soft if 2 * rich[box] < n[box]}, parent)
        keep = [i for i, x in enumerate(lines) if x[2] not in gone]
        lines, heavy = [lines[i] for i in keep], [heavy[i] for i in keep]
    total, weight = sum(heavy), summed(by_box(lines, heavy), parent)
    count = summed(by_box(lines, [1] * len(lines)), parent)
    named = [c for c, kind in parser.kinds.items() if kind in CONTAINERS and count[c] and weight[c] >= HEAVY * total]
    if named:
        region = max(named, key=lambda c: (parser.kinds[c] == "article", weight[c]))
        inner = within({region}, parent)
        lines = [x for x in lines if x[2] in inner]
    else:
        lines = clustered(lines, heavy, parent, weight, count)
    return "\n".join(text for text, _, _ in lines)


def clustered(lines: list[tuple[str, int, int]], heavy: list[int], parent: dict[int, int], weight: dict[int, int], count: dict[int, int]) -> list[tuple[str, int, int]]:
    """Lines of the container that the clusters lead to, without its boxes of few clustered lines."""
    children: dict[int, list[int]] = {}
    for box in parent:  # in page order
        if count[box]:
            children.setdefault(parent[box], []).append(box)
    rich = summed(by_box(lines, [int(w > 0) for w in heavy]), parent)
    at = 0
    while True:
        best = max(children.get(at, ()), key=weight.__getitem__, default=None)
        if best is None or count[best] < 2:
            break
        if count[best] != count[at] and (weight[best] < MOST * weight[at] or count[at] - count[best] <= EDGE):
            break
        at = best
    poor = {c for c in children.get(at, ()) if count[c] > 1 and rich[c] < FEW * count[c]}
    inner, gone = within({at}, parent), within(poor, parent)
    return [x for x in lines if x[2] in inner and x[2] not in gone]


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages(page_id, url, html, ...)``: page_id, url, text, n_chars.

    Null and empty html give an empty text; repeated rows and null ids give a row each; other
    columns are ignored; an empty table gives an empty result. Whole pages are parsed.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
            )

    chosen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return chosen.mapInArrow(run, "page_id long, url string, text string, n_chars long")
