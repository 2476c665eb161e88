"""Main text of web pages: site templates are found by counting element subtrees per host."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.durable import written

MIN_PAGES = 5
MIN_SHARE = 0.6  # a passage that many articles quote stays well below; a site template does not

# Fixed values of the HTML language.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea xmp iframe noembed noframes title".split())
IN_HEAD = frozenset("base link meta noscript script style template title".split())
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "select summary table tbody td tfoot th thead title tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}}
CLOSES |= {"th": CLOSES["td"], "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
CLOSES |= {"tfoot": CLOSES["tbody"], "body": {"head"}}
CONTAINERS = ("ul", "ol", "menu", "dl", "table", "select")
CLOSED_INSIDE = frozenset("li p td tr dd dt".split())
UNWANTED = frozenset(
    "aside button canvas datalist dialog footer form head iframe input label math menu nav noscript object select "
    "svg template textarea".split()
)
# A class, id or role names a part that is not the article if it is made of these words ...
PARTS = frozenset(
    "ad ads adbox adsense advert adverts advertisement advertising alert banner breadcrumb breadcrumbs byline comment "
    "commentlist comments complementary consent contentinfo cookie cookies copyright disqus footer gdpr header hidden "
    "login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo "
    "promoted promotion recommended related replies reply respond search share sharing sidebar sidenav signup skip "
    "social sponsor sponsored subscribe subscription toolbar topbar widget widgets".split()
)
# ... and of words that only say where or how: "ad-slot-2" is a part, "with-sidebar" and "related-work" are not.
PLACES = frozenset(
    "area articles bar bottom box button buttons container fixed form global google inner item items left link links "
    "list main outer page panel posts reader right section site slot sticky stories top unit user wrap wrapper".split()
)
CONTENT = frozenset("article content entry hentry post story".split())
CELLS = frozenset("dd dt li option td th".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>|[^<]+|<",
    re.S,
)
_NAMED = re.compile(r"(?:^|[\s\"'])(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_MAIN = re.compile(r"(?:^|[\s\"'])role\s*=\s*[\"']?main\b", re.I)
_WORDS = re.compile(r"[-_]+|(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])")
_UNSEEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
HOST = "^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


def _names(attributes: str) -> list[str]:
    return " ".join(a or b or c for a, b, c in _NAMED.findall(attributes)).split()


def _is_part(names: list[str]) -> bool:
    for name in names:
        words = {w for w in _WORDS.split(name.strip("-_")) if not w.isdigit()}
        words = {w.lower() for w in words}
        if words & PARTS and words <= PARTS | PLACES:
            return True
    return False


class Element(NamedTuple):
    parent: int
    tag: str
    names: list[str]
    unseen: bool
    main: bool


class Page(NamedTuple):
    """A parsed page. ``digests`` cover an element's tag, its text and its descendants; they are
    -1 for inline elements and those without text. Every element comes after its parent."""

    elements: list[Element]
    digests: list[int]
    blocks: list[tuple[list[tuple[str, int, bool]], int]]  # runs (text, element, in a link) and the block's element


def _squeezed(texts: Iterable[str]) -> str:
    return " ".join("".join(texts).split())


def parse(page: str) -> Page:
    """All elements and text blocks of a page, in page order; nothing is judged here.

    Work and memory grow with the length of the page, however deep it nests: the nearest
    open element of a tag is looked up, not searched for, and an element knows its parent only.
    """
    elements: list[Element] = []
    digests: list[int] = []
    found: list[tuple[list[tuple[str, int, bool]], int]] = []
    parts: list[list[str]] = [[]]
    stack: list[int] = []
    depths: dict[str, list[int]] = {}  # of the open elements of each tag
    pending: list[tuple[str, int, bool]] = []
    around: list[int] = [-1]  # open block elements

    def flush() -> None:
        if pending:
            text = _squeezed(t for t, _, _ in pending)
            if text:
                parts[-1].append(text)
                found.append((pending.copy(), around[-1]))
            pending.clear()

    def close_to(depth: int) -> None:
        while len(stack) > depth:
            element = stack.pop()
            tag = elements[element].tag
            depths[tag].pop()
            if tag in BLOCKS:
                flush()
                around.pop()
                held = parts.pop()
                if held:
                    digests[element] = xxhash.xxh64_intdigest(tag + "\x00" + "\x01".join(held)) >> 1
                    parts[-1].append(str(digests[element]))

    def nearest(tags: Iterable[str]) -> int:
        return max((depths[t][-1] for t in tags if depths.get(t)), default=-1)

    at = 0
    while at < len(page):
        token = _TOKEN.match(page, at)
        at = token.end()
        name = token[2] or token[5]
        if name is None:
            text = token[0]
            if text[0] != "<" or text == "<":
                text = unescape(text) if "&" in text else text
                pending.append((text, stack[-1] if stack else -1, bool(depths.get("a"))))
            continue
        name, closing, attributes = name.lower(), token[1] or token[4], token[3] or token[6] or ""
        block = name in BLOCKS
        if block:
            flush()
        if closing:
            depth = nearest([name])
            if depth >= 0 and not (name in CLOSED_INSIDE and nearest(CONTAINERS) > depth):
                close_to(depth)
            continue
        if name in VOID or name in ("svg", "math") and attributes.endswith("/"):
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I | re.A).search(page, at)
            at = page.find(">", end.start()) + 1 or len(page) if end else len(page)
            continue
        if name not in IN_HEAD and name != "head" and depths.get("head"):
            close_to(depths["head"][0])
        ends = CLOSES.get(name, frozenset())
        if block and depths.get("p"):
            ends = ends | {"p"}
        if ends:
            depth = nearest(ends)
            if depth > nearest(CONTAINERS):
                close_to(depth)
        element = len(elements)
        names = _names(attributes) if attributes else []
        unseen = bool(attributes) and _UNSEEN.search(attributes) is not None
        main = name == "main" or bool(attributes) and _MAIN.search(attributes) is not None
        elements.append(Element(stack[-1] if stack else -1, name, names, unseen, main))
        digests.append(-1)
        depths.setdefault(name, []).append(len(stack))
        stack.append(element)
        if block:
            parts.append([])
            around.append(element)
    flush()
    close_to(0)
    return Page(elements, digests, found)


class Judged(NamedTuple):
    """What is left of a page, as (text, element) blocks, and how many blocks went by which step."""

    blocks: list[tuple[str, int]]
    by_template: int
    by_rule: int
    outside: int
    as_links: int


def judge(page: Page, templates: frozenset[int] = frozenset()) -> Judged:
    """First the subtrees in ``templates`` go. Then parts that tags or names mark as no article; a part
    that holds every article and main element of the page is none, whatever it is called.
    Then the blocks outside of the article, else of the main element, if there is one; else cells
    and list items that are mostly links."""
    elements, n = page.elements, len(page.elements)
    articles = [e.tag == "article" or e.main for e in elements]
    holds = [int(a) for a in articles]
    for i in range(n - 1, -1, -1):
        if elements[i].parent >= 0:
            holds[elements[i].parent] += holds[i]
    total = sum(articles)
    gone, unwanted, article, main, content = ([False] * (n + 1) for _ in range(5))  # the last one is the page's own
    for i, (parent, tag, names, unseen, is_main) in enumerate(elements):
        gone[i] = gone[parent] or page.digests[i] in templates
        article[i] = article[parent] or tag == "article"
        main[i] = main[parent] or is_main
        inside = article[i] or main[i] or content[parent]
        content[i] = inside or not CONTENT.isdisjoint(names)
        part = tag not in ("html", "body") and _is_part(names) and not 0 < holds[i] == total
        unwanted[i] = unwanted[parent] or unseen or part or (tag in UNWANTED or tag == "header" and not content[parent])
    by_template = by_rule = 0
    left = []
    for runs, element in page.blocks:
        if gone[element]:
            by_template += 1
            continue
        kept = [(t, e, link) for t, e, link in runs if not unwanted[e]]
        text = _squeezed(t for t, _, _ in kept)
        if not text:
            by_rule += 1
            continue
        linked = sum(len(t) for t, _, link in kept if link)
        left.append((text, element, kept[0][1], 2 * linked > len(text)))
    for inside in (article, main):
        chosen = [(text, element) for text, element, _, _ in left if inside[element]]
        if chosen:
            return Judged(chosen, by_template, by_rule, len(left) - len(chosen), 0)
    chosen = [(text, element) for text, element, _, link in left if not (link and element >= 0 and elements[element].tag in CELLS)]
    return Judged(chosen, by_template, by_rule, 0, len(left) - len(chosen))


def main_blocks(page: str, templates: frozenset[int] = frozenset()) -> list[tuple[str, int]]:
    """The text blocks of the article, and the elements around them."""
    return judge(parse(page), templates).blocks


def page_subtrees(pages: DataFrame) -> DataFrame:
    """(host, content, hashes): a hash of each page's main text and those of all its elements that hold text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [parse(h.as_py() or "") for h in batch.column(1)]
            texts = [" ".join(t for t, _ in judge(page).blocks) for page in found]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([xxhash.xxh64_intdigest(text) >> 1 for text in texts], pa.int64()),
                    pa.array([sorted(set(page.digests) - {-1}) for page in found], pa.list_(pa.int64())),
                ],
                ["host", "content", "hashes"],
            )

    return pages.select("host", "html").mapInArrow(work, "host string, content long, hashes array<long>")


STEPS = ("n_template_blocks", "n_rule_blocks", "n_outside_blocks", "n_link_blocks")


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text and the blocks each step removed, of rows (page_id, url, html, templates)."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, steps = [], []
            for html, templates in zip(batch.column(2), batch.column(3)):
                found = judge(parse(html.as_py() or ""), frozenset(templates.as_py() or ()))
                texts.append(" ".join(t for t, _ in found.blocks))
                steps.append(found[1:])
            counts = [pa.array(list(c), pa.int64()) for c in zip(*steps)] if steps else [pa.array([], pa.int64())] * len(STEPS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), *counts], ["page_id", "url", "text", *STEPS]
            )

    return pages.select("page_id", "url", "html", "templates").mapInArrow(
        work, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, " + ", ".join(f"{c} long" for c in STEPS)
    )


def extract_main_text(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_pages: int = MIN_PAGES,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """Per page: page_id, url, text, n_chars, and how many text blocks each step removed.

    Site templates go first. Every element of every page is hashed with its subtree, before any
    rule; hashes are counted per host over pages of different main text; and subtrees found
    in at least ``min_pages`` of them and ``min_share`` of the host's are deleted: menus, banners,
    footers and notices, whatever their tags. Copies of one page count once, so an
    article published twice stays.

    What a template does not hold, rules decide: navigation, header, footer, aside, form, hidden
    parts, and parts whose class, id or role is made of words for adverts, notices, comments and
    the like; then the article, else the main element, else the page without link lists.

    White space inside a block is one space; blocks are joined in page order by one space.
    Null or empty html, and a page with nothing left, give an empty text. Rows are
    kept as they are, repeated or without id or url (no host: one host of its own).
    """
    base = pages.select(
        F.col(page_id).alias("page_id"),
        F.col(url).alias("url"),
        F.col(html).alias("html"),
        F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), HOST, 1), F.lit(""))).alias("host"),
    )
    distinct = written(
        page_subtrees(base).groupBy("host", "content").agg(F.first("hashes").alias("hashes")), "page-subtrees"
    )
    sizes = distinct.groupBy("host").agg(F.count(F.lit(1)).alias("pages")).filter(F.col("pages") >= min_pages)
    templates = (
        distinct.select("host", F.explode("hashes").alias("hash"))
        .groupBy("host", "hash")
        .agg(F.count(F.lit(1)).alias("times"))
        .filter(F.col("times") >= min_pages)
        .join(sizes, "host")
        .filter(F.col("times") >= F.lit(min_share) * F.col("pages"))
        .groupBy(F.col("host").alias("t_host"))
        .agg(F.collect_list("hash").alias("templates"))
    )
    # at most 1 / min_share as many as a page of the host has elements; usually few enough to broadcast
    templates = written(templates, "templates")
    found = main_texts(base.join(templates, F.col("host") == F.col("t_host"), "left"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"), *STEPS)
