"""HTML main-text extraction from streamed parser events, text-to-tag ratios, smoothing and clustering."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestone.llm.common import map_arrow, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol option p pre search section summary table tbody tfoot thead tr ul".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never shown as text, and those that never are an article's own text.
UNSEEN = frozenset("script style head title noscript template svg math iframe object canvas audio video map".split())
APART = frozenset("nav header footer aside form menu dialog search button select textarea input label fieldset".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar status".split())
#: Words in a class or id that say the same, and those that say so only of a part whose own text is thin or mostly links.
CERTAIN = frozenset("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored cookie cookies consent gdpr comment comments commentlist respond disqus newsletter subscribe subscription nav navbar navigation menu breadcrumb breadcrumbs sidebar pagination pager".split())
LIKELY = frozenset("banner promo promotion aside header footer masthead notice notices alert popup modal signup login reply replies discussion share sharing social related recommended widget toolbar copyright legal disclaimer".split())
#: Words that may stand beside them; any other makes a name of its own, such as share-price or related-work.
PLACES = frozenset("list box wrap wrapper container section block inner outer area item items group row col column bar panel pane site page global main top bottom left right primary secondary unit slot zone region module mod post article entry user reader".split())
#: Start tags that end an open element of the other kinds, up to the nearest list or table.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl menu table select body".split())
CONTAINERS = frozenset("body main article section div".split())

WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
TAG_NAME = re.compile(r"[a-zA-Z][^\s/>\0]*")
#: Character references beyond what int() reads, and beyond Unicode.
HUGE = re.compile(r"&#0*[1-9][0-9]{7,};?")
ZEROS = re.compile(r"(&#)0{8,}(?=[0-9])")


def _hidden(attrs: dict[str, str | None]) -> bool:
    """Whether role or visibility tell that an element isn't article text."""
    if "hidden" in attrs or (attrs.get("aria-hidden") or "").lower() == "true" or (attrs.get("role") or "").lower() in ROLES:
        return True
    return bool(re.search(r"display\s*:\s*none", attrs.get("style") or "", re.I))


def _hint(attrs: dict[str, str | None]) -> int:
    """Whether class or id tell so: 2 if surely, 1 if likely. All words of a name must go together."""
    found = 0
    for name in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = {w.lower() for w in WORDS.findall(name)}
        if parts <= CERTAIN | LIKELY | PLACES and not ("header" in parts and parts & {"article", "post", "entry"}):
            found = max(found, 2 * bool(parts & CERTAIN), bool(parts & LIKELY))
    return found


#: An open element: tag, unseen, apart, whether its block is apart, its container, the outermost article around it, and the outermost part that is likely apart.
Open = tuple[str, bool, bool, bool, int, int, int]
ROOT: Open = ("", False, False, False, 0, 0, 0)


class _Reader(HTMLParser):
    """Gathers lines: (text, tags since the line before, characters in links, apart, container, article, likely, heading) of each block.

    Containers are numbered as they open; inside and names hold the container around each and its tag. places holds where
    the open elements of each tag stand, so that closing one takes no search. Pages are fed whole, so markup that doesn't
    end ends the page, as browsers have it; nothing of it is text.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = [ROOT]
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.in_tag = False
        self.lines: list[tuple[str, int, int, bool, int, int, int, bool]] = []
        self.inside, self.names = [0], [""]
        self.parts: list[str] = []
        self.tags = self.linked = self.links = self.likely = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.lines.append((text, self.tags, self.linked, *self.open[-1][3:], self.open[-1][0] in HEADINGS))
            self.tags = 0
        self.parts.clear()
        self.linked = 0

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
            self._close("p", SCOPES | CONTAINERS)
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        for kind in ENDS.get(tag, ()):
            self._close(kind, SCOPES)
        if tag in VOID:
            return
        if tag == "a":
            self.links += 1
        above, unseen, apart, block, container, article, likely = self.open[-1]
        unseen = unseen or tag in UNSEEN
        if tag in HEADINGS and article and above == "header" and not self.open[-2][2]:
            apart = False  # an article's own title
        elif tag not in ("html", "body", "main"):
            given = dict(attrs)
            hint = _hint(given) if "class" in given or "id" in given else 0
            apart = apart or tag in APART or hint == 2 or _hidden(given)
            if hint == 1 and tag in BLOCKS and not likely:
                self.likely += 1
                likely = self.likely
        if tag in BLOCKS:
            block = apart
        if tag in CONTAINERS:
            self.inside.append(container)
            self.names.append(tag)
            container = len(self.inside) - 1
            article = article or container * (tag == "article")
        self.places.setdefault(tag, []).append(len(self.open))
        if tag in BLOCKS:
            self.blocks.append(len(self.open))
        self.open.append((tag, unseen, apart, block, container, article, likely))

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in ("svg", "math"):
            self.handle_endtag(tag)

    def _last(self, tag: str) -> int:
        at = self.places.get(tag)
        return at[-1] if at else -1

    def _close(self, tag: str, scopes: frozenset[str]) -> None:
        """Closes the last open element of the tag and those inside it, unless one of scopes is between."""
        k = self._last(tag)
        if k < 0 or (max(self.blocks[-1:], default=-1) if scopes is BLOCKS else max(map(self._last, scopes), default=-1)) > k:
            return
        if tag in BLOCKS:
            self.flush()
        for name, *_ in self.open[k:]:
            self.places[name].pop()
            if name in BLOCKS:
                self.blocks.pop()
        del self.open[k:]

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag == "a" and self.links:
            self.links -= 1
        if tag in BLOCKS:
            self.flush()
        if tag not in VOID:
            self._close(tag, frozenset() if tag in BLOCKS else BLOCKS)

    def _ended(self, k: int) -> int:
        return k if k >= 0 else len(self.rawdata)

    def parse_starttag(self, i: int) -> int:
        self.in_tag = True  # what the parser can't read in a tag isn't text
        k = super().parse_starttag(i)
        if k < 0 and (end := self.rawdata.find(">", i)) >= 0:
            self.handle_starttag(TAG_NAME.match(self.rawdata, i + 1)[0].lower(), [])
            k = end + 1
        self.in_tag = False
        return self._ended(k)

    def parse_endtag(self, i: int) -> int:
        return self._ended(super().parse_endtag(i))

    def parse_comment(self, i: int, report: int = 1) -> int:
        return self._ended(super().parse_comment(i, report))

    def parse_pi(self, i: int) -> int:
        return self._ended(super().parse_pi(i))

    def parse_html_declaration(self, i: int) -> int:
        return self._ended(self.parse_bogus_comment(i))

    def handle_data(self, data: str) -> None:
        if self.in_tag:
            return
        _, unseen, apart, block, *_ = self.open[-1]
        if not unseen and apart == block:
            self.parts.append(data)
            if self.links:
                self.linked += len(data)


def _threshold(values: np.ndarray) -> float:
    """Where two clusters of values part, but not above a third of the upper one's mean."""
    low, high = float(values.min()), float(values.max())
    for _ in range(20):
        upper = values >= (low + high) / 2
        if upper.all():
            break
        low, high = float(values[~upper].mean()), float(values[upper].mean())
    return min((low + high) / 2, high / 3)


def main_text(html: str, sigma: float = 1.0) -> str:
    """The main text of a page: blocks joined by an empty line, their white space as single spaces.

    Parser events make lines, one for each block element's own text, with the number of tags they took. A line's ratio is
    its text outside links to its tags; ratios are smoothed by a Gaussian over neighbouring lines, and two clusters of
    them give a threshold. The region is a container of nine tenths of the text above it: of those that hold so much, the
    outermost article, else the outermost main element, else the smallest. All lines of an article are content, lists of links
    too; of another region without lines below the threshold that are links for the most part, and of any without an
    article inside most of whose text is below it. Where no element
    but the page holds so much, the first and last line whose own ratio passes as well bound it, with headings right before.
    Lines elsewhere are content if they are above the threshold and their own ratio is too, or they are a heading outside other articles.
    Lines in elements that are apart by kind, role, class or id (menus, headers, footers, sidebars, notices, adverts,
    forms, comments) take part in the ratios but never in the text. Where class or id only make that likely, an element is apart if
    its own ratio is below the threshold or half of its text is links.
    """
    reader = _Reader()
    reader.feed(HUGE.sub("\ufffd", ZEROS.sub(r"\1", html)) if "&#" in html else html)
    reader.close()
    reader.flush()
    lines = reader.lines
    if not lines:
        return ""
    ratios = np.array([(len(text) - min(linked, len(text))) / (1 + tags) for text, tags, linked, *_ in lines])
    reach = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    middle = slice(len(reach) // 2, len(reach) // 2 + len(ratios))
    smooth = np.convolve(ratios, kernel)[middle] / np.convolve(np.ones(len(ratios)), kernel)[middle]
    limit = _threshold(smooth)
    parts: dict[int, list[int]] = {}
    for text, tags, linked, _, _, _, likely, _ in lines:
        if likely:
            sums = parts.setdefault(likely, [0, 0, 0])
            for i, n in enumerate((len(text), min(linked, len(text)), 1 + tags)):
                sums[i] += n
    thin = {k for k, (n, linked, tags) in parts.items() if n - linked < limit * tags or 2 * linked >= n}
    own = [(line, high, dense) for line, high, dense in zip(lines, (smooth >= limit).tolist(), (ratios >= limit).tolist(), strict=True) if not line[3] and line[6] not in thin]
    held = [0] * len(reader.inside)
    for line, high, _ in own:
        held[line[4]] += len(line[0]) * high
    if not any(held):
        for line, _, _ in own:
            held[line[4]] += len(line[0])
    for k in range(len(held) - 1, 0, -1):
        held[reader.inside[k]] += held[k]
    most = [k for k, n in enumerate(held) if n and 10 * n >= 9 * held[0]]  # each inside the one before
    named = {name: k for k in reversed(most) if (name := reader.names[k]) in ("article", "main")}
    region = named.get("article", named.get("main", most[-1] if most else 0))
    within = [k == region for k in range(len(held))]
    for k in range(region + 1, len(held)):
        within[k] = within[k] or within[reader.inside[k]]
    shares: dict[int, int] = {}
    for line, high, _ in own:
        shares[line[5]] = shares.get(line[5], 0) + (len(line[0]) if high else -len(line[0]))
    first, last = 0, len(own)
    if reader.names[region] in ("", "body"):  # nothing but the ratios tells where the text begins and ends
        clear = [k for k, (_, high, dense) in enumerate(own) if high and dense] or [0, len(own) - 1]
        first, last = clear[0], clear[-1]
        while first and own[first - 1][0][7]:
            first -= 1
    kept = []
    listing = reader.names[region] != "article"
    for k, ((text, _, linked, _, container, article, _, heading), high, dense) in enumerate(own):
        if within[container]:
            faint = (listing and 2 * linked >= len(text)) or (article > region and shares[article] < 0)
            if first <= k <= last and (high or not faint):
                kept.append(text)
        elif high and (dense or (heading and article <= region)):
            kept.append(text)
    return "\n\n".join(kept)


def extract(pages: DataFrame, sigma: float = 1.0) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html), from the whole html by main_text().

    Null html is empty and gives an empty text. Pages are handled where they are read, one at a time; repeated rows give
    equal rows; no rows give none; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py() or "", sigma) for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return map_arrow(pages.select("page_id", "url", "html"), run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars long")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
