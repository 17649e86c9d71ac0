"""Main text of web pages: parser events, text-to-tag ratios per line, Gaussian smoothing, threshold clustering.

The standard-library parser gets a page only after one linear pass that leaves it nothing to fail on or to scan twice:
comments, declarations and scripts go, tags and quotes that never end become text, endless character references become one.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from mixloom.llm.arrow import with_columns

# Elements whose text is never part of an article.
DROPPED = frozenset(
    "script style noscript template svg math iframe object canvas audio video map head title nav footer aside form"
    " button select option textarea label input fieldset dialog menu".split()
)
# Elements that end a line, and those whose lines belong together.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr"
    " ul".split()
)
CONTAINERS = frozenset("article main section div td body".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
# Words of class, id and role that mark menus, adverts, notices, comments and other parts around an article.
AROUND = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr"
    " notice notices alert popup modal overlay sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer"
    " masthead topbar toolbar comment comments respond reply replies disqus share sharing social related recommended"
    " newsletter subscribe subscription signup login widget widgets pagination pager tags tagcloud search skip hidden"
    " complementary contentinfo".split()
)
# Words that may stand beside them in a class or id; any other word gives it another meaning (ad-hoc, notice-period).
BESIDE = frozenset(
    "site page top bottom left right box block wrapper wrap container area list item items section inner outer global"
    " primary secondary slot unit link links bar form panel text content main header body button buttons col column".split()
)
# Smoothing width in lines, and the threshold as a share of the ratios' standard deviation.
SIGMA = 1.5
THRESHOLD = 1.0
# So many lines of nothing but links, one after the other, are a menu wherever they lie.
MENU_LINES = 3
_NAME = re.compile(r"[a-z]+")
_TAG = re.compile(
    r"""<[a-zA-Z][^\t\n\r\f />\x00]*+(?:[\s/]++|=++\s*+(?:"[^"]*+"|'[^']*+'|(?!["'])[^>\s]*+)|[^\s/>=]++)*+"""
)
_COMMENT_END = re.compile(r"--!?\s*>")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in ("script", "style", "title", "textarea")}
_NUMBER = re.compile(r"&#([0-9]{8,});?")


def _bounded(reference: re.Match) -> str:
    """A long decimal reference without its zeros; one beyond all characters stands for the replacement character."""
    digits = reference[1].lstrip("0") or "0"
    return f"&#{digits};" if len(digits) < 8 else "&#xFFFD;"


def tidied(page: str) -> str:
    """The page without what is never text, and with `&lt;` for every `<` that starts nothing; in one pass."""
    page = _NUMBER.sub(_bounded, page)
    out: list[str] = []
    at, size = 0, len(page)
    # Ends that were looked for in vain lie nowhere behind either.
    missing: set[str] = set()

    def end_of(kind: str, start: int) -> int:
        if kind in missing:
            return -1
        if kind == "-->":
            found = _COMMENT_END.search(page, start)
            end = found.end() if found else -1
        else:
            end = page.find(kind, start)
            end = end + len(kind) if end >= 0 else -1
        if end < 0:
            missing.add(kind)
        return end

    while at < size:
        i = page.find("<", at)
        if i < 0:
            out.append(page[at:])
            break
        out.append(page[at:i])
        follows = page[i + 1 : i + 2]
        if follows and follows in "!?":
            kind = "-->" if page.startswith("<!--", i) else "]]>" if page[i : i + 9].lower() == "<![cdata[" else ">"
            end = end_of(kind, i + 4 if kind == "-->" else i + 2)
            if end < 0:
                out.append("&lt;")
            at = end if end >= 0 else i + 1
        elif follows == "/":
            end = end_of(">", i + 2)
            out.append(page[i:end] if end >= 0 else "&lt;")
            at = end if end >= 0 else i + 1
        elif follows.isascii() and follows.isalpha():
            end = _TAG.match(page, i).end()
            if page[end : end + 1] != ">":
                # The page ends within the tag or within a quote of it: no tag before that place ends either.
                out.append(page[i : end + 1].replace("<", "&lt;"))
                at = end + 1
                continue
            tag = page[i : end + 1]
            out.append(tag)
            at = end + 1
            name = _NAME.match(tag.lower(), 1)
            raw = _RAW_END.get(name[0]) if name and not tag.endswith("/>") else None
            if raw:
                close = raw.search(page, at) if raw.pattern not in missing else None
                if close:
                    at = close.start()
                else:
                    missing.add(raw.pattern)
                    at = size if name[0] in ("script", "style") else at
        else:
            out.append("&lt;")
            at = i + 1
    return "".join(out)


def around(value: str) -> bool:
    """Whether a class, id or role marks a part around an article: one of its names consists of such words only."""
    for token in value.lower().split():
        words = set(_NAME.findall(token))
        if words & AROUND and words <= AROUND | BESIDE:
            return True
    return False


class LineReader(HTMLParser):
    """Streams a page into lines: text, number of tags, characters inside links, container."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[tuple[str, int, int, int]] = []
        self.parts: list[str] = []
        self.tags = self.linked = self.links = 0
        self.skip: list[str] = []
        self.open: list[tuple[str, int, bool]] = [("", 0, False)]
        self.opened: Counter[str] = Counter()
        self.containers = 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, self.open[-1][1]))
            self.tags = 0
        self.parts, self.linked = [], 0

    @staticmethod
    def _around(attributes) -> bool:
        for name, value in attributes:
            if value and name in ("class", "id", "role"):
                if around(value):
                    return True
            elif name in ("hidden", "aria-hidden") and value in (None, "", "hidden", "true"):
                return True
        return False

    def handle_starttag(self, tag, attributes):
        outside = bool(attributes) and tag not in ("body", "html") and tag not in VOID and self._around(attributes)
        if self.skip:
            inner = tag in ("article", "main", "body") and not outside
            if inner and self.skip[0] in ("head", "title", "nav", "header", "footer"):
                self.skip = []  # what was open is never closed
            else:
                if tag == self.skip[0] and tag not in VOID:
                    self.skip.append(tag)
                return
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            article = self.open[-1][2]
            if tag in DROPPED or outside or (tag == "header" and not article):
                self._end_line()
                self.skip = [tag]
                return
            if tag in CONTAINERS:
                self.containers += 1
                self.open.append((tag, self.containers, article or tag in ("article", "main")))
                self.opened[tag] += 1
            if tag == "a":
                self.links += 1

    def handle_startendtag(self, tag, attributes):
        if not self.skip:
            self.tags += 1
            if tag in BLOCKS:
                self._end_line()
            elif tag == "br":
                self.parts.append(" ")

    def handle_endtag(self, tag):
        if self.skip:
            if tag == self.skip[0]:
                self.skip.pop()
            elif tag in ("article", "main", "body") and self.opened[tag]:
                self.skip = []
            if self.skip or tag not in CONTAINERS:
                return
        self.tags += 1
        if tag in BLOCKS:
            self._end_line()
        if tag in CONTAINERS and self.opened[tag]:
            closed = None
            while closed != tag:
                closed = self.open.pop()[0]
                self.opened[closed] -= 1
        if tag == "a":
            self.links = max(0, self.links - 1)

    def handle_data(self, data):
        if not self.skip:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)

    def read(self, page: str):
        self.feed(tidied(page))
        self.close()
        self._end_line()
        return self.lines


def smoothed(values: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian smoothing whose weights always add up to one, also at the ends."""
    reach = min(len(values) - 1, int(np.ceil(3 * sigma)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    total = np.convolve(values, kernel)[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel)[reach : reach + len(values)]


def main_text(page: str | None, sigma: float = SIGMA, threshold: float = THRESHOLD) -> str:
    """The article of a page: its lines in page order, joined by newlines; empty if there is none.

    Every line that is not inside menus, forms and the like gets the ratio of its characters outside links to its tags.
    The smoothed ratios of the page make the threshold. Where the ratio reaches it, smoothed and by itself, lies a content
    region: its whole container belongs to the text, but for runs of lines that are nothing but links. Malformed markup is
    text where it starts nothing that ends; time is linear in the page.
    """
    if not page:
        return ""
    lines = LineReader().read(page)
    if not lines:
        return ""
    size = np.array([max(0, len(t) - linked) for t, _, linked, _ in lines], float)
    tags = np.array([max(1, n) for _, n, _, _ in lines], float)
    container = np.array([c for *_, c in lines])
    own = size / tags
    ratio = smoothed(own, sigma)
    least = min(threshold * ratio.std(), 0.5 * ratio.max())
    content = np.minimum(ratio, own) >= least
    chosen = np.isin(container, np.unique(container[content]))
    run = np.cumsum(np.diff(size == 0, prepend=False))
    menu = (size == 0) & (np.bincount(run)[run] >= MENU_LINES)
    return "\n".join(line[0] for line, keep in zip(lines, chosen & ~menu) if keep)


def extract(pages: DataFrame, html: str = "html") -> DataFrame:
    """Replace nothing, add `text` and `n_chars` (code points) of every whole page; a null page has an empty text."""

    def kernel():
        def run(column):
            texts = [main_text(p) for p in column.to_pylist()]
            return pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())

        return run

    return with_columns(pages, html, "text string, n_chars bigint", kernel)
