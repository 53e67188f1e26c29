"""Main text of web pages by line-block distribution."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# HTML's element names by their role, and words in class, id and role that name what is not the article.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
DROPPED = set("script style noscript template title iframe object svg math canvas audio video nav aside footer button select textarea dialog menu".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = set("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CHROME = set(
    "ad ads adv advert adverts advertisement adsense sponsor sponsored promo promotion banner sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer masthead topbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter "
    "subscribe signup share sharing social related recommended widget widgets pagination pager search login toolbar contentinfo complementary dialog form".split()
)
COMMENTS = set("comment comments commentlist disqus respond reply replies".split())
PAGE_HEADER = {"header", "banner"}
# First words of class names that say what a page has or lacks, not what the element is.
ABOUT = set("has have with no without not is".split())
# Elements that hold the text of an article itself; inside one, their class names do not make them something else.
TEXT_ELEMENTS = INLINE | set("p h1 h2 h3 h4 h5 h6 blockquote pre li dd dt table thead tbody tr td th figure figcaption hr".split())
SPACE = re.compile(r"\s+")
NAME_WORD = re.compile(r"[a-z0-9]+")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
GONE = -1

Line = tuple[str, int, int]  # text, characters in links, number of the article or main element around it (0: none)


def named(attrs: dict[str, str | None]) -> set[str]:
    """Words of the class, id and role, but for names like has-sidebar."""
    out: set[str] = set()
    for key in ("class", "id", "role"):
        for name in (attrs.get(key) or "").split():
            words = NAME_WORD.findall(CAMEL.sub(" ", name).lower())
            if words and words[0] not in ABOUT:
                out.update(words)
    return out


class Lines(HTMLParser):
    """Strips markup: lines, without those of scripts, menus, footers, comments and of boxes named as something else.

    A box is a form, a page header or an element with a name of CHROME. One that holds most of the page's text, in three
    lines or more or in an article element, is a wrapper and stays, if no article or main element holds text outside boxes;
    boxes in it are judged alike.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, int, bool]] = []  # element, its box or GONE, its article, in link
        self.boxes = [0]  # the box around each box; 0 is the page
        self.found: list[tuple[str, int, int, int]] = []  # lines and their boxes
        self.parts: list[str] = []
        self.linked = self.article = self.articles = self.box = 0

    def state(self) -> tuple[int, int, bool]:
        return self.open[-1][1:] if self.open else (0, 0, False)

    def flush(self) -> None:
        text = SPACE.sub(" ", "".join(self.parts)).strip()
        if text:
            self.found.append((text, self.linked, self.article, self.box))
        self.parts, self.linked = [], 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.flush()
        if tag in VOID:
            return
        if tag in CLOSES_P:
            self.close_open("p", {"article", "body", "div", "section", "main", "td", "th", "li", "blockquote", "button"})
        elif tag == "li":
            self.close_open("li", {"ul", "ol", "menu"})
        box, article, link = self.state()
        if box != GONE:
            box = self.box_of(tag, dict(attrs), article, box)
        if tag in ("article", "main") and not article:
            self.articles += 1
            article = self.articles
        self.open.append((tag, box, article, link or tag == "a"))

    def box_of(self, tag: str, attrs: dict[str, str | None], article: int, box: int) -> int:
        """The box that the element's text is in, GONE if it is in none that could stay."""
        if tag in DROPPED or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return GONE
        if "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return GONE
        if article and tag in TEXT_ELEMENTS:
            return box
        words = named(attrs) if attrs else set()
        if tag in ("html", "body", "main") or (tag == "article" and not words & COMMENTS):
            return box
        if words & COMMENTS:
            return GONE
        if tag != "form" and not words & CHROME and (article or not (tag == "header" or words & PAGE_HEADER)):
            return box
        if tag in INLINE:
            return GONE
        self.boxes.append(box)
        return len(self.boxes) - 1

    def lines(self) -> list[Line]:
        mass, count = [0] * len(self.boxes), [0] * len(self.boxes)
        for text, linked, article, box in self.found:
            while True:
                mass[box] += net(text, linked)
                count[box] += 3 if article else 1
                if not box:
                    break
                box = self.boxes[box]
        stays = [True]
        marked = any(article and not box for _, _, article, box in self.found)
        for box in range(1, len(self.boxes)):
            stays.append(stays[self.boxes[box]] and not marked and count[box] >= 3 and 2 * mass[box] > mass[0])
        return [(text, linked, article) for text, linked, article, box in self.found if stays[box]]

    def close_open(self, tag: str, stop: set[str]) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if self.open[i][0] in stop:
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.flush()
        inline = tag in INLINE
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return
            if inline and self.open[i][0] not in INLINE:
                return  # an inline end tag doesn't close the block around it

    def handle_data(self, data: str) -> None:
        box, article, link = self.state()
        if box == GONE:
            return
        self.parts.append(data)
        self.article, self.box = article, box
        if link:
            self.linked += len(data.strip())


def net(text: str, linked: int) -> int:
    """Characters outside links, none if most are in links."""
    return 0 if 2 * linked > len(text) else len(text) - linked


def weights(lines: list[Line], mark: int = 60) -> list[int]:
    """What each line weighs: its characters outside links, by the side that it stands on.

    Lines in article or main elements are one side, all others the other. Where the first side holds at least half of the
    text, its lines weigh all their characters, links too, and `mark` more. Lines of the lesser side weigh a quarter.
    """
    plain = [net(text, linked) for text, linked, _ in lines]
    inside = sum(w for w, line in zip(plain, lines) if line[2])
    if any(line[2] for line in lines) and 2 * inside >= sum(plain):
        return [len(line[0]) + mark if line[2] else w // 4 for w, line in zip(plain, lines)]
    return [w // 4 if line[2] else w for w, line in zip(plain, lines)]


def main_lines(lines: list[Line], window: int = 3, surge: int = 60, mark: int = 60) -> list[str]:
    """The lines between the surge and dive points of the text's distribution over line windows.

    The weights of `window` lines are summed at each line; the edge of an article element counts as so many empty lines.
    Where the sums rise from nothing a region begins, where they are back at nothing it ends, and it is text if it surges
    to `surge` or more anywhere. All text regions stay whole, from the first to the last line that weighs something.
    If no region surges, all lines that weigh something are the text.
    """
    if not lines:
        return []
    weight = np.array(weights(lines, mark))
    article = np.array([int(line[2]) for line in lines])
    place = np.arange(len(lines)) + window * np.append(0, np.cumsum(article[1:] != article[:-1]))
    spread = np.zeros(int(place[-1]) + 2 * window, dtype=np.int64)
    spread[place + window] = weight  # the first window holds nothing
    total = np.append(0, np.cumsum(spread))
    block = total[window:] - total[:-window]
    rises = np.flatnonzero((block[1:] > 0) & (block[:-1] == 0)) + 1
    dives = np.append(np.flatnonzero((block[1:] == 0) & (block[:-1] > 0)) + 1, len(block))
    kept: list[str] = []
    for rise, dive in zip(rises, dives):
        if block[rise:dive].max() >= surge:
            # windows begin up to `window` - 1 lines ahead of what they sum, so the first to rise ends in the region's first line
            first, end = np.searchsorted(place, (rise - 1, dive - window))
            kept += [lines[i][0] for i in range(first, end)]
    return kept or [line[0] for line, w in zip(lines, weight) if w]


def main_text(html: str | None) -> str:
    parser = Lines()
    parser.feed((html or "").replace("\x00", ""))
    parser.close()
    parser.flush()
    return " ".join(main_lines(parser.lines()))


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row.

    Null or empty html, and pages that are chrome only, give the empty text of no characters. Any columns may be null;
    repeated rows stay repeated, and other columns are left out. One page is held at a time; nothing is shuffled.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("string").alias("html"))
    return source.mapInPandas(run, "page_id long, url string, text string, n_chars long")
