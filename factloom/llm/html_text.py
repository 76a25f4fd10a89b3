"""Main text of web pages: parser events, text-to-tag ratio, smoothing, threshold clustering.

The standard library's parser streams events. They cut a page into lines: the text between two block-level
tags, with the number of its tags. A line's ratio is its characters outside links over its tags. The ratios are smoothed
with a Gaussian, and lines over the threshold are the cluster of content. Content lines vote for the regions
(articles, main, or containers) that hold them: articles unless main says more than twice as much, and of a page without
either the containers whose own ratio is near that of the largest one. Regions of links without a content line are no part of it. The
text of a page is the headlines before and around it, and every line of the chosen regions, in page order, but for what its tags or names say to be a menu,
header, footer, sidebar, notice, advert, form or reader comment. Names that say less (legal, tags, search) only drop
lines that the ratio doesn't find to be content.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches

#: Elements of the HTML standard by their part in a page.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DROPPED = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object embed svg canvas dialog menu audio video map applet".split())
REGIONS = frozenset("article main section div td body".split())
SCOPES = frozenset("article main section div td th table body html nav footer aside form header ul ol dl".split())
NAMED = re.compile(
    r"(?:^|[-_\s])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|sidebar|aside|widgets?|comments?|commentlist|disqus|replies|respond|cookies?|consent|gdpr|notices?|alert|popup|modal|overlay|menu\w*|nav\w*|navigation|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|share\w*|sharing|social|related|recommend\w*|newsletter|subscri\w*|signup|login)(?:$|[-_\s\d])",
    re.I,
)
#: Names of what may be the topic as well: the ratio decides.
WEAK = re.compile(r"(?:^|[-_\s])(?:side|search|pagination|pager|tags|copyright|legal|disclaimer)(?:$|[-_\s\d])", re.I)
#: Names that say what a container stands beside (with-sidebar).
BESIDE = re.compile(r"\b(?:with|has|no|without)[-_]\w+", re.I)
#: Within an article names are also topics (related-work, shareholders): each part of a class must be one of these, and one of the first.
FURNITURE = frozenset("ad ads advert adverts advertisement advertisements advertising adsense adbox banner sponsor sponsors sponsored promo promos promotion sidebar aside widget widgets comment comments commentlist disqus replies respond cookie cookies consent gdpr popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs footer toolbar share sharing sharebar social related recommended newsletter subscribe signup login search pagination pager tags".split())
GENERIC = frozenset("area article articles bar block bottom box button buttons container content entry form group header icons inner item items left link links list media notice outer page panel post posts right section site slot stories thread title top unit wrap wrapper".split())
#: An id is often a heading's words: alone, only these count.
ID_FURNITURE = frozenset("ad ads adbox adsense sidebar comments commentlist disqus respond breadcrumbs newsletter".split())
PART = re.compile(r"[-_]+")
#: How a short line outside of articles says that it is a notice of rights.
NOTICE = re.compile(r"^(?:©|\(c\)|copyright\b).*\b(?:19|20)\d\d\b|\ball rights reserved\b", re.I)
NOTICE_CHARS = 160
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LONG_REFERENCE = re.compile(r"&#([0-9]{1000,})")
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())


#: What is known of the text within an element: kept, dropped unless it is content, dropped.
KEPT, DOUBTED, DROPPED_TEXT = 0, 1, 2


class _Lines(HTMLParser):
    """Cuts a page into lines: (text, characters in links, tags, region, what is known of it, whether it is a headline)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int]] = []  # name, what is known, region
        self.open: Counter = Counter()  # names on the stack
        self.lines: list[tuple[str, int, int, int, int, bool]] = []
        self.regions: list[tuple[str, int, bool]] = [("page", -1, False)]  # kind, parent, whether in an article or main
        self.text: list[str] = []
        self.tags = self.links = self.linked = 0

    def cut(self) -> None:
        if self.text:
            line = " ".join("".join(self.text).split())
            if line:
                _, known, region = self.stack[-1] if self.stack else ("", KEPT, 0)
                if known == KEPT and not self.regions[region][2] and len(line) <= NOTICE_CHARS and NOTICE.search(line):
                    known = DROPPED_TEXT
                self.lines.append((line, min(self.linked, len(line)), self.tags, region, known, self.open["h1"] > 0))
            self.text = []
        self.tags = self.linked = 0

    def parse_html_declaration(self, i: int) -> int:
        try:
            return super().parse_html_declaration(i)
        except AssertionError:  # a marked section of no known name is a comment to the next >
            return self.parse_bogus_comment(i)

    def boilerplate(self, tag: str, name: str, value: str, region: int) -> int:
        if not self.regions[region][2]:
            value = BESIDE.sub("", value)
            if tag in HEADINGS and name == "id":
                return KEPT
            return DROPPED_TEXT if NAMED.search(value) else DOUBTED if WEAK.search(value) else KEPT
        if tag not in SCOPES:
            return KEPT
        for token in value.lower().split():
            parts = [p.rstrip("0123456789") for p in PART.split(token)]
            parts = [p for p in parts if p]
            if len(parts) == 1 and name == "id":
                if parts[0] in ID_FURNITURE:
                    return DROPPED_TEXT
            elif any(p in FURNITURE for p in parts) and all(p in FURNITURE or p in GENERIC for p in parts):
                return DROPPED_TEXT
        return KEPT

    def shut(self, i: int) -> None:
        """Take the elements from place i off the stack."""
        for name, _, _ in self.stack[i:]:
            self.open[name] -= 1
        del self.stack[i:]

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in INLINE:
            self.tags += 1
            self.links += tag == "a"
            return
        self.cut()
        self.tags, self.links = 1, 0
        if tag in VOID:
            return
        if tag in ("p", "li") and self.open[tag]:  # an open one ends here
            for i in range(len(self.stack) - 1, -1, -1):
                if self.stack[i][0] in SCOPES:
                    break
                if self.stack[i][0] == tag:
                    self.shut(i)
                    break
        _, known, region = self.stack[-1] if self.stack else ("", KEPT, 0)
        if known < DROPPED_TEXT:
            if tag in DROPPED or (tag == "header" and self.regions[region][0] not in ("article", "main")):
                known = DROPPED_TEXT
            if tag == "article":  # its classes also name topics: only a whole name counts
                if any(NAMED.fullmatch(x) for name, value in attrs if name in ("class", "id") for x in (value or "").split()):
                    known = DROPPED_TEXT
            elif tag not in ("html", "body", "main"):
                for name, value in attrs:
                    if value and name in ("class", "id"):
                        known = max(known, self.boilerplate(tag, name, value, region))
                    elif name == "hidden" or value and (name == "role" and value.lower() in ROLES or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")):
                        known = DROPPED_TEXT
        if tag in REGIONS:
            self.regions.append((tag, region, self.regions[region][2] or tag in ("article", "main")))
            region = len(self.regions) - 1
        self.stack.append((tag, known, region))
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # a slash doesn't end an element of HTML

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            self.tags += 1
            self.links -= tag == "a" and self.links > 0
            return
        self.cut()
        self.tags, self.links = 1, 0
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                self.shut(i)
                return
            if tag in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "tr", "dt", "dd") and self.stack[i][0] in SCOPES:
                return

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        if self.links:
            self.linked += len(data.strip())


def _smoothed(x: np.ndarray, sigma: float) -> np.ndarray:
    reach = max(1, round(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel)[reach : reach + len(x)]
    return np.convolve(x, kernel)[reach : reach + len(x)] / weight


def main_text(html: str, sigma: float = 1.0, threshold: float = 0.5) -> str:
    """The main text of a page; empty if it has none. threshold is in standard deviations of the smoothed ratios."""
    parser = _Lines()
    # int() refuses thousands of digits; eight tell a number that no character has
    parser.feed(LONG_REFERENCE.sub(lambda m: "&#" + (m[1].lstrip("0")[:8] or "0"), html))
    parser.close()
    parser.cut()
    lines, regions = parser.lines, parser.regions
    possible = [i for i, x in enumerate(lines) if x[4] < DROPPED_TEXT]
    if not possible:
        return ""
    plain = np.array([(len(x[0]) - x[1]) / max(1, x[2]) for x in lines])
    ratio = _smoothed(plain, sigma)
    content = ratio >= min(threshold * ratio.std(), ratio[possible].max())
    kept = [i for i in possible if lines[i][4] == KEPT or content[i]]
    weight: dict[int, int] = {}
    told: dict[int, list[int]] = {}  # of each region without those in it: characters, of which in links, lines over half of which is plain content
    for i in kept:
        text, linked, _, r, _, _ = lines[i]
        if content[i]:
            weight[r] = weight.get(r, 0) + len(text) - linked
        t = told.setdefault(r, [0, 0, 0])
        t[0] += len(text)
        t[1] += linked
        t[2] += bool(content[i]) and 2 * linked < len(text)
    # the outermost article and main around each region, or -1
    outer = {kind: np.full(len(regions), -1) for kind in ("article", "main")}
    for r, (kind, up, _) in enumerate(regions):
        for k, at in outer.items():
            at[r] = at[up] if up >= 0 and at[up] >= 0 else r if kind == k else -1
    best: dict[str, dict[int, int]] = {"article": {}, "main": {}}
    for r, w in weight.items():
        for kind, found in best.items():
            if outer[kind][r] >= 0:
                found[outer[kind][r]] = found.get(outer[kind][r], 0) + w
    if best["article"] or best["main"]:
        # articles, unless main says more than twice as much as they do
        whole = {kind: sum(found.values()) for kind, found in best.items()}
        kind = "article" if best["article"] and 2 * whole["article"] >= whole["main"] else "main"
        found, chars = best[kind], {}
        for r, (n, linked, _) in told.items():
            if outer[kind][r] >= 0:
                t = chars.setdefault(outer[kind][r], [0, 0])
                t[0] += n
                t[1] += linked
        # every one that isn't a card: small beside the largest one, and with a link to what it tells of
        most = max(found.values())
        chosen = {r for r, w in found.items() if (20 * w >= most or not chars[r][1]) and 2 * chars[r][1] <= chars[r][0]} or {max(found, key=found.get)}
    else:  # containers with at least a tenth of the largest one's content, so that sections of one text stay together
        most = max(weight.values(), default=0)
        chosen = {r for r, w in weight.items() if 10 * w >= most}
        # the ratio of each container as a whole tells blocks of the page that aren't of its text: half the largest one's at least
        dense = {r: sum(plain[i] for i in kept if lines[i][3] == r) / sum(lines[i][3] == r for i in kept) for r in chosen}
        top = max(chosen, key=weight.get, default=-1)
        chosen = {r for r in chosen if 2 * dense[r] >= dense[top] or regions[r][0] == "section" or regions[regions[r][1]][0] not in ("page", "body")}
        # and their smaller siblings with content: a page's own blocks only if they are sections
        parents = {regions[r][1] for r in chosen}
        chosen |= {r for r in weight if (up := regions[r][1]) in parents and up >= 0 and (regions[r][0] == "section" or regions[up][0] not in ("page", "body"))}
    # regions of links, where no article says that they belong to it
    links = {r for r, (n, linked, plain_lines) in told.items() if 2 * linked > n and not plain_lines and not regions[r][2]}
    within = np.zeros(len(regions), bool)
    for r, (_, up, _) in enumerate(regions):
        within[r] = r in chosen or (up >= 0 and within[up])
    told_of = [i for i in kept if within[lines[i][3]] and lines[i][3] not in links]
    # headlines before the text, in what surrounds it
    around, r = set(), lines[told_of[0]][3] if told_of else -1
    while r >= 0:
        around.add(r)
        r = regions[r][1]
    heads = [i for i in kept if told_of and i < told_of[0] and lines[i][5] and lines[i][3] in around and 2 * lines[i][1] <= len(lines[i][0])]
    return " ".join(lines[i][0] for i in (*heads, *told_of))


def _batches(sigma: float, threshold: float):
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            texts = [main_text(h, sigma, threshold) if h else "" for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return batches


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", sigma: float = 1.0, threshold: float = 0.5) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages: text is the main text, n_chars its code points.

    Character references are decoded, white space within a block becomes one space, blocks are joined by one
    space. Null and empty pages, and pages without content, have an empty text. Repeated rows give repeated
    rows; null ids and addresses stay null; other columns are ignored, whatever their names. Long and deeply nested
    pages take time in proportion to their length. No shuffle: a page is one row's work.
    """
    bounded_batches(pages.sparkSession, 500)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(_batches(sigma, threshold), "page_id long, url string, text string, n_chars long")
