"""Main text of web pages by site template removal.

Every element subtree of a page is hashed (tag, class, text and children). Spark
counts on how many pages of a host each subtree stands; subtrees that recur
across many different pages of the host are its template and are deleted, along with
elements that are no article text by their meaning: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments. What is
left of the page's article (its <article>, else <main>, else the body) is given
block by block.

Recurring containers are deleted from TEMPLATE_SHARE of the host's pages on.
Paragraphs and headings inside an article may quote what other articles quote,
so they go only when practically every page has them (QUOTE_SHARE).

Copies of a page have one vote: pages of a host count as one, in the subtree's count
and in the host's total, when their articles read the same before templates go.

The counts go through a shuffle of hashes. The templates found (a subtree on
half of a host's pages: few per host) are copied to the tasks when they are at
most BROADCAST_TEMPLATES, else each page is joined with the templates it holds.

Defined results. A null or empty html gives an empty text. Pages without a host
(null url) share one. Rows that repeat are rows of their own in the result and one
page in the counts; a null page_id is kept. Malformed markup is read as far as it makes sense, in time that grows
with the page: unknown end tags are ignored, unclosed elements end with their parent. Extra columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wartaframe.llm.words import pieces
from wartaframe.session import checkpointed

TEMPLATE_SHARE = 0.5
QUOTE_SHARE = 0.9
#: Pages of a host on which a template stands at least.
TEMPLATE_PAGES = 5
BROADCAST_TEMPLATES = 500_000

# Fixed values of the markup language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody "
    "td tfoot th thead tr ul".split()
)
#: Elements that end an open paragraph.
ENDS_PARAGRAPH = BLOCKS - frozenset("body html caption legend td th tr tbody thead tfoot summary".split())
#: Start tag -> open elements that it ends, up to the list or table around them.
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
#: No article text by meaning.
OTHER_ELEMENTS = frozenset(
    "nav footer aside form noscript template svg math button select menu dialog head object canvas audio video map "
    "script style textarea title xmp iframe noembed noframes datalist".split()
)
OTHER_ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split()
)
#: Words of a class or id that tell the same.
OTHER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adsbygoogle sponsor sponsored promo promotion banner "
    "menu nav navbar navigation breadcrumb breadcrumbs sidebar widget widgets footer cookie cookies consent gdpr "
    "notice notices alert popup modal overlay newsletter subscribe subscription signup login social share sharing "
    "related recommended comment comments commentlist reply replies respond disqus discussion pagination pager "
    "copyright disclaimer toolbar masthead search".split()
)
#: The same outside an article only: inside, they name the article's own head.
OUTER_NAMES = frozenset("header topbar top".split())
KEPT = frozenset("html body main article".split())
QUOTED = frozenset("p h1 h2 h3 h4 h5 h6 li blockquote pre td th dt dd figcaption b i em strong span a".split())

#: A tag with no "<" or ">" in its quotes, read without going back and at most up to the next tag.
_PLAIN_TAG = re.compile(
    r"<(/?)([a-zA-Z][^\s/<>\"']*+)(?=[\s/>])((?:[^\"'<>]++|\"[^\"<>]*+\"|'[^'<>]*+')*+)>"
)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_UNQUOTED = re.compile(r"[^\"'>]*")
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden")
_HOST = re.compile(r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


class Element:
    __slots__ = ("tag", "other", "parts", "inside", "digest")

    def __init__(self, tag: str, other: bool = False, inside: bool = False):
        self.tag, self.other, self.inside = tag, other, inside
        self.parts: list[str | Element] = []
        self.digest = 0

    def close(self, names: str = "") -> None:
        """Hash of the subtree; white space and page order of its parts count, formatting of text does not."""
        seen = [self.tag, names]
        seen += [" ".join(p.split()) if isinstance(p, str) else f"\x01{p.digest:x}" for p in self.parts]
        self.digest = xxhash.xxh64_intdigest("\0".join(seen)) >> 1


def is_other(tag: str, attributes: str, inside: bool) -> tuple[bool, str]:
    """Whether an element is no article text by its name, role, class or id; and its class."""
    other = tag in OTHER_ELEMENTS or (tag == "header" and not inside)
    names = ""
    if attributes and not attributes.isspace():
        found = {k.lower(): (v or "").strip("\"'") for k, v in _ATTRIBUTE.findall(attributes)}
        names = found.get("class", "")
        if tag not in KEPT or inside:
            words = {w.lower() for w in _NAME_PARTS.findall(names + " " + found.get("id", ""))}
            other = (
                other
                or not words.isdisjoint(OTHER_NAMES)
                or (not inside and not words.isdisjoint(OUTER_NAMES))
                or found.get("role", "").lower() in OTHER_ROLES
                or "hidden" in found
                or found.get("aria-hidden") == "true"
                or bool(_HIDDEN.search(found.get("style", "").lower()))
            )
    return other, names


class Tags:
    """Markup of a page from left to right, in time that grows with its length.

    A tag whose quotes do not close is no tag and goes up to its first ">"; the places from
    which reading a tag ran into the end are remembered, so no later tag reads on from them.
    """

    def __init__(self, page: str):
        self.page = page
        self.last = page.rfind(">")
        self.hopeless: set[int] = set()

    def close(self, at: int) -> int:
        """Place of the ">" that ends a tag's attributes from ``at`` on, -1 if there is none."""
        page, passed = self.page, []
        while at <= self.last and at not in self.hopeless:
            passed.append(at)
            at = _UNQUOTED.match(page, at).end()
            if at <= self.last and page[at] == ">":
                return at
            quote = page.find(page[at], at + 1) if at < self.last else -1
            if quote < 0:
                break
            at = quote + 1
        self.hopeless.update(passed)
        return -1

    def __iter__(self) -> Iterator[tuple[int, int, str | None, bool, str]]:
        """(begin, end, name, whether an end tag, attributes); other markup has no name.

        The reader may send the place to go on from, past text that is not markup.
        """
        page, at = self.page, 0
        while (begin := page.find("<", at)) >= 0:
            if (plain := _PLAIN_TAG.match(page, begin)) is not None:
                at = (yield begin, plain.end(), plain[2].lower(), bool(plain[1]), plain[3]) or plain.end()
                continue
            at = begin + 1
            name, ended, attributes = None, page.startswith("/", at), ""
            if page.startswith("!--", at):
                stop = page.find("-->", at + 3)
                stop = len(page) if stop < 0 else stop + 3
            elif (found := _NAME.match(page, begin)) is not None:
                stop = self.close(found.end()) + 1
                if stop:
                    name, attributes = found[1].lower(), page[found.end() : stop - 1]
                elif begin < self.last:
                    stop = page.index(">", at) + 1
                elif ended:
                    stop = len(page)
                else:
                    continue
            elif page.startswith(("!", "?", "/"), at):
                stop = page.find(">", at)
                stop = len(page) if stop < 0 else stop + 1
            else:
                continue
            at = (yield begin, stop, name, ended, attributes) or stop


class OpenElements:
    """Elements not yet closed, with the depths at which each tag and any block stands."""

    def __init__(self, root: Element):
        self.stack, self.names = [root], [""]
        self.depths: dict[str, list[int]] = {}
        self.blocks: list[int] = []

    def push(self, element: Element, names: str) -> None:
        self.depths.setdefault(element.tag, []).append(len(self.stack))
        if element.tag in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)
        self.names.append(names)

    def pop(self) -> None:
        element = self.stack.pop()
        element.close(self.names.pop())
        if self.stack:
            self.depths[element.tag].pop()
            if element.tag in BLOCKS:
                self.blocks.pop()

    def nearest(self, tags) -> int:
        if tags is BLOCKS:
            return self.blocks[-1] if self.blocks else 0
        return max((d[-1] for t in tags if (d := self.depths.get(t))), default=0)

    def end(self, tags, stop=()) -> None:
        """Close the nearest open element of ``tags``, unless one of ``stop`` is nearer."""
        if self.stack[-1].tag in tags:
            if len(self.stack) > 1:
                self.pop()
            return
        depth = self.nearest(tags)
        if depth and depth >= self.nearest(stop):
            while len(self.stack) > depth:
                self.pop()


def parse(page: str) -> Element:
    """Element tree of a page."""
    root = Element("#page")
    still_open = OpenElements(root)
    stack, end = still_open.stack, still_open.end
    at, tags = 0, iter(Tags(page))
    found = next(tags, None)
    while found is not None:
        begin, stop, tag, ended, attributes = found
        if begin > at:
            stack[-1].parts.append(page[at:begin])
        at = stop
        if tag is None:
            pass
        elif ended:
            end((tag,), () if tag in ("article", "main", "body", "html") else ("article",) if tag in BLOCKS else BLOCKS)
        else:
            if tag in ENDS_PARAGRAPH:
                end(("p",), ("article", "div", "section", "li", "td", "table"))
            if tag in SIBLINGS:
                end(*SIBLINGS[tag])
            inside = stack[-1].inside
            other, classes = is_other(tag, attributes, inside)
            element = Element(tag, other, inside or tag == "article")
            stack[-1].parts.append(element)
            if tag in VOID or attributes.endswith("/"):
                element.close(classes)
            elif tag in RAW:
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                at = close.start() if close else len(page)
                element.close(classes)
            else:
                still_open.push(element, classes)
        try:
            found = tags.send(at)
        except StopIteration:
            break
    if at < len(page):
        stack[-1].parts.append(page[at:])
    while stack:
        still_open.pop()
    return root


def elements(root: Element) -> Iterator[Element]:
    """All elements outside parts that are no article text, in page order."""
    todo = [root]
    while todo:
        element = todo.pop()
        yield element
        todo.extend(p for p in reversed(element.parts) if not isinstance(p, str) and not p.other)


def subtrees(root: Element) -> dict[int, bool]:
    """Digests of the subtrees that may be template; True for those that may be quotes."""
    return {
        e.digest: e.inside and e.tag in QUOTED
        for e in elements(root)
        if e.parts and e.tag not in KEPT and e.tag != "#page"
    }


def text_of(root: Element, template: set[int]) -> str:
    """Blocks of the page's article, one per line."""
    every = list(elements(root))
    tops, covered = [], set()
    for tag in ("article", "main"):
        for e in every:
            if e.tag == tag and id(e) not in covered:
                tops.append(e)
                covered.update(map(id, elements(e)))
        if tops:
            break
    blocks, line = [], []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(line)).split())
        if text:
            blocks.append(text)
        line.clear()

    todo: list = list(reversed(tops or [root]))
    while todo:
        part = todo.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            line.append(part)
        elif part.tag == "br":
            line.append(" ")
        elif part.other or (part.digest in template and part.tag not in KEPT):
            if part.tag in BLOCKS:
                flush()
        elif part.tag in BLOCKS or part.tag == "#page":
            flush()
            todo.append(None)
            todo.extend(reversed(part.parts))
        else:
            todo.extend(reversed(part.parts))
    flush()
    return "\n".join(blocks)


def _site(host: str) -> int:
    return xxhash.xxh64_intdigest(host) >> 1


def _content(root: Element) -> int:
    """Hash of the article's text, which copies of a page share."""
    return xxhash.xxh64_intdigest(text_of(root, set())) >> 1


def recurring(pages: DataFrame) -> DataFrame:
    """(site, digest): subtrees that recur across many different pages of their host."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                found: list[tuple[int, int, int, bool]] = []
                for url, page in zip(piece.column("url").to_pylist(), piece.column("html").to_pylist()):
                    site, root = _site(host_of(url)), parse(page or "")
                    content = _content(root)
                    found.append((site, -1, content, False))
                    found += [(site, d, content, quote) for d, quote in subtrees(root).items()]
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_())
                columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["site", "digest", "content", "quote"])

    seen = pages.select("url", "html").mapInArrow(rows, "site long, digest long, content long, quote boolean")
    seen = seen.groupBy("site", "digest", "content").agg(F.max("quote").alias("quote"))
    counts = seen.groupBy("site", "digest").agg(F.count(F.lit(1)).alias("n"), F.max("quote").alias("quote"))
    counts = checkpointed(counts.filter(F.col("n") >= TEMPLATE_PAGES))
    totals = counts.filter("digest = -1").select("site", F.col("n").alias("total"))
    share = F.when(F.col("quote"), F.lit(QUOTE_SHARE)).otherwise(F.lit(TEMPLATE_SHARE))
    found = counts.filter("digest <> -1").join(totals, "site").filter(F.col("n") >= share * F.col("total"))
    return checkpointed(found.select("site", "digest"))


def _pair_key(site: np.ndarray, digest: np.ndarray) -> np.ndarray:
    return site.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + digest.astype(np.uint64)


def main_text(pages: DataFrame, broadcast_templates: int = BROADCAST_TEMPLATES) -> DataFrame:
    """page_id, url, text and n_chars of each row of ``pages`` (page_id, url, html)."""
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    templates = recurring(pages)
    if templates.count() <= broadcast_templates:
        table = templates.toPandas()
        keys = {int(k) for k in _pair_key(table["site"].to_numpy(), table["digest"].to_numpy())}

        def own_templates(site: int, root: Element, listed: list[int] | None) -> set[int]:
            if not keys:
                return set()
            found = list(subtrees(root))
            pair = _pair_key(np.full(len(found), site), np.array(found, np.int64))
            return {d for d, k in zip(found, pair.tolist()) if k in keys}

        rows = pages.withColumn("templates", F.lit(None).cast("array<long>"))
    else:

        def own_templates(site: int, root: Element, listed: list[int] | None) -> set[int]:
            return set(listed or ())

        rows = _with_templates(pages, templates)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                texts = []
                for url, page, listed in zip(
                    piece.column("url").to_pylist(),
                    piece.column("html").to_pylist(),
                    piece.column("templates").to_pylist(),
                ):
                    root = parse(page or "")
                    texts.append(text_of(root, own_templates(_site(host_of(url)), root, listed)))
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("page_id"),
                        piece.column("url"),
                        pa.array(texts, pa.string()),
                        pa.array([len(t) for t in texts], pa.int64()),
                    ],
                    ["page_id", "url", "text", "n_chars"],
                )

    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")


def _with_templates(pages: DataFrame, templates: DataFrame) -> DataFrame:
    """Adds to each page the template subtrees it holds; joins on hashes, then on the page."""

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, "html"):
                found: list[tuple[int, int, int]] = []
                columns = (piece.column(c).to_pylist() for c in ("row", "url", "html"))
                for row, url, page in zip(*columns):
                    found += [(row, _site(host_of(url)), d) for d in subtrees(parse(page or ""))]
                data = [pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], []))]
                yield pa.RecordBatch.from_arrays(data, ["row", "site", "digest"])

    pages = pages.withColumn("row", F.xxhash64("page_id", "url", "html"))
    seen = pages.select("row", "url", "html").mapInArrow(held, "row long, site long, digest long")
    listed = seen.join(templates, ["site", "digest"]).groupBy("row").agg(F.collect_set("digest").alias("templates"))
    return pages.join(listed, "row", "left").drop("row")
