"""Main text of web pages by site template removal.

A page is parsed to a tree of elements.  Every page sends the hashes of its subtrees (tags and texts, folded from the
leaves up), Spark counts for each host on how many different pages a subtree stands, and subtrees that recur on many of
them are deleted from the whole tree, before anything else is looked at.  Rules come second, for what need not recur:
elements that say by tag, role or class that they are menus, headers, footers, adverts, forms, notices or reader
comments, yet differ from page to page.

For a subtree, pages count as different by their longest block of text outside it, so copies of an article under other
dates or links do not make its parts templates.  Running text inside a declared article is never taken for a template, since passages repeat there by
right; a subtree that holds most of the text of a page without a declared article is not one either.

The text is that of the page's articles, else of its main part, else of its body.
"""

from __future__ import annotations

import hashlib
import heapq
import html as references
import re
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import ensure_package
from ._shared import cut, sized_join

#: A subtree is a template from this many different pages of a host on that are this share of all its pages; running
#: text and parts of a declared article need the second share.
MIN_PAGES = 4
MIN_SHARE, MIN_SHARE_TEXT = 0.02, 0.3
#: Of this many blocks of a page, the longest outside a subtree tells its page from others; none outside is like all.
_LONGEST = 16
#: Template hashes (8 bytes each) up to this count are broadcast; beyond it they are joined to the pages.
BROADCAST_TEMPLATES = 1_000_000

#: Fixed values of HTML: elements without end tags, with raw text, that end a line of text, that close an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes noscript".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li listing main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt li figcaption".split())
#: An element of the first kind ends an open one of the second, up to a border.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select", "datalist", "optgroup"}), "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
_P_BORDER = frozenset("article aside body button caption div html main object section table td th".split())

#: Tags, roles and class or id words of what is not main text.
NOT_TEXT = frozenset("head title script style noscript template svg math canvas audio video object embed iframe select button textarea input form dialog menu nav aside footer".split())
NOT_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
NOT_TEXT_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|banner|breadcrumbs?|comments?|commentlist|consent|cookies?|disqus|footer|gdpr|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|notification|paywall|popup|promo|promoted|promotion|recommended|related|replies|respond|share|sharing|sidebar|signup|social|sponsor|sponsored|subscribe|toolbar|widget)(?:$|[\s_-])"
)
MAIN_ROLES = frozenset({"main", "article"})

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    start: int
    end: int = -1
    children: list = field(default_factory=list)  # elements and strings


def parse(source: str) -> Element:
    """A tree of elements; open paragraphs, items and cells end where HTML ends them, other ends close what they name."""
    root = Element("#root", {}, 0)
    stack, at = [root], 0
    places: dict[str, list[int]] = {}  # of the open elements of each tag in the stack

    def close(upto: int, where: int) -> None:
        while len(stack) > upto:
            e = stack.pop()
            e.end = where
            places[e.tag].pop()

    def innermost(tags) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=-1)

    def find(tags, borders) -> int:
        """The innermost open element of `tags` that no border shuts in."""
        found = innermost(tags)
        return found if found >= innermost(borders) else -1

    n = len(source)
    while at < n:
        m = _TOKEN.search(source, at)
        if not m:
            stack[-1].children.append(source[at:])
            break
        if m.start() > at:
            stack[-1].children.append(source[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if (i := find((tag,), ())) > 0:
                close(i, at)
            continue
        if tag in CLOSES_P and (i := find(("p",), _P_BORDER)) > 0:
            close(i, m.start())
        if tag in _ENDS:
            tags, borders = _ENDS[tag]
            while (i := find(tags, borders)) > 0:
                close(i, m.start())
        attributes = {a[1].lower(): references.unescape(a[2] or a[3] or a[4] or "") for a in _ATTRIBUTE.finditer(m[3])} if m[3].strip(" /") else {}
        made = Element(tag, attributes, m.start())
        stack[-1].children.append(made)
        if tag in VOID or m[3].endswith("/") and tag in ("svg", "path"):
            made.end = at
        elif tag in RAW:
            end = _raw_end(tag).search(source, at)
            stop = end.start() if end else n
            made.children.append(source[at:stop])
            made.end = at = end.end() if end else n
        else:
            places.setdefault(tag, []).append(len(stack))
            stack.append(made)
    close(1, n)
    root.end = n
    return root


@lru_cache(maxsize=64)
def _raw_end(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I)


def says_not_text(e: Element, in_article: bool) -> bool:
    """Whether an element's tag, role or class tells that it is not main text."""
    if e.tag in NOT_TEXT or e.tag == "header" and not in_article:
        return True
    a = e.attributes
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role", "").lower() in NOT_TEXT_ROLES:
        return True
    names = f"{a.get('class', '')} {a.get('id', '')}".strip().lower()
    return bool(names) and e.tag not in ("html", "body", "article", "main") and bool(NOT_TEXT_WORDS.search(names)) or e.tag == "article" and bool(re.search(r"\bcomment", names))


def main_parts(root: Element, dropped: frozenset | set = frozenset()) -> tuple[list[Element], bool]:
    """The elements that hold the main text, and whether the page declares them; `dropped` ones do not count."""
    for wanted in (lambda e: e.tag == "article" or e.attributes.get("role") == "article", lambda e: e.tag == "main" or e.attributes.get("role") == "main"):
        found: list[Element] = []
        todo = [root]
        while todo:
            e = todo.pop()
            if id(e) in dropped:
                continue
            if wanted(e) and not says_not_text(e, True):
                found.append(e)
            elif not says_not_text(e, False):
                todo.extend(c for c in reversed(e.children) if isinstance(c, Element))
        if found:
            return found, True
    todo = [root]
    while todo:
        e = todo.pop()
        if e.tag == "body":
            return [e], False
        todo.extend(c for c in reversed(e.children) if isinstance(c, Element))
    return [root], False


@dataclass(slots=True)
class Subtree:
    """A subtree that may be a template: its hash, whether it needs the larger share of the host's pages, and the hash of
    the longest block of text elsewhere on its page."""

    element: Element
    hash: int
    weak: bool
    page: int


def _hash(*parts: str | bytes) -> bytes:
    joined = b"\xff".join([x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass") for x in parts])
    return hashlib.blake2b(joined, digest_size=8).digest()


def _number(digest: bytes) -> int:
    return int.from_bytes(digest, "little", signed=True)


def subtrees(host: str, root: Element) -> tuple[list[Subtree], int]:
    """(the subtrees of a page that may be templates, the hash of the page's text).

    Hashes are folded from the leaves up, each element's from its tag, its own texts and those of its children, white
    space and attributes apart, so that a page costs time in proportion to its length however deep it nests.  No
    subtree is: a page's body, article or main part; running text inside a declared one; on a page that declares none,
    one with more than half of the text; one without text.
    """
    parts, declared = main_parts(root)
    inside = {id(e) for e in parts} if declared else set()
    order: list[tuple[Element, bool]] = []  # parents first, a subtree in one run
    todo = [(root, False)]
    while todo:
        e, within = todo.pop()
        within = within or id(e) in inside
        order.append((e, within))
        todo.extend((c, within) for c in e.children if isinstance(c, Element))
    digests: dict[int, bytes] = {}
    lengths: dict[int, int] = {}  # characters of text below
    sizes: dict[int, int] = {}  # elements in it
    texts: list[tuple[int, int, bytes]] = []  # (length, place, hash) of blocks of text
    for k in range(len(order) - 1, -1, -1):
        e = order[k][0]
        own, length, held, size = [f"<{e.tag}>"], 0, [], 1
        for c in e.children:
            if isinstance(c, str):
                if text := " ".join(c.split()):
                    own.append(text)
                    held.append(text)
            else:
                own.append(digests[id(c)])
                length += lengths[id(c)]
                size += sizes[id(c)]
        digests[id(e)], sizes[id(e)] = _hash(*own), size
        if e.tag in NOT_TEXT:
            lengths[id(e)] = 0
            continue
        here = sum(map(len, held))
        lengths[id(e)] = length + here
        if here:
            texts.append((here, k, _hash(*held)))
    most = lengths[id(root)] / 2
    whole = _number(_hash(*[h for _, _, h in texts]))
    longest = heapq.nlargest(_LONGEST, texts)
    found = []
    for k, (e, within) in enumerate(order):
        if e.tag not in BLOCK or e.tag in ("html", "body", "article", "main") or within and e.tag in PROSE:
            continue
        if e.tag not in NOT_TEXT and (not lengths[id(e)] or not declared and lengths[id(e)] > most):
            continue
        end = k + sizes[id(e)]
        elsewhere = next((h for _, at, h in longest if not k <= at < end), None)
        page = _number(_hash("") if elsewhere is None else elsewhere)
        found.append(Subtree(e, _number(_hash(host, digests[id(e)])), within or e.tag in PROSE, page))
    return found, whole


def blocks(parts: list[Element], dropped: set[int] | frozenset, declared: bool) -> list[str]:
    """The text of the blocks in page order, white space collapsed, empty ones left out."""
    out: list[str] = []
    line: list[str] = []

    def end_line() -> None:
        if text := " ".join(references.unescape("".join(line)).split()):
            out.append(text)
        line.clear()

    for part in parts:
        todo: list = [part]
        while todo:
            x = todo.pop()
            if x is None:
                end_line()
            elif isinstance(x, str):
                line.append(x)
            elif id(x) in dropped or x is not part and says_not_text(x, declared):
                if x.tag in BLOCK:
                    end_line()
                else:
                    line.append(" ")
            elif x.tag == "br":
                line.append(" ")
            elif x.tag in BLOCK:
                end_line()
                todo.append(None)
                todo.extend(reversed(x.children))
            else:
                todo.extend(reversed(x.children))
        end_line()
    return out


def host_of(url: str | None) -> str:
    """The host of a URL in lower case, without user and port; empty where there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def page_text(source: str | None, url: str | None, is_template) -> tuple[str, int]:
    """(the main text of a page, how many template subtrees were deleted, those within others apart).

    `is_template(hashes)` tells which subtree hashes are templates.
    """
    if not source:
        return "", 0
    root = parse(source)
    found, _ = subtrees(host_of(url), root)
    flags = is_template([x.hash for x in found]) if found else []
    dropped = {id(x.element) for x, gone in zip(found, flags, strict=True) if gone}
    n, todo = 0, [root] if dropped else []
    while todo:
        e = todo.pop()
        if id(e) in dropped:
            n += 1
        else:
            todo.extend(c for c in e.children if isinstance(c, Element))
    return "\n".join(blocks(*_parts(root, dropped))), n


def _parts(root: Element, dropped: set[int] | frozenset) -> tuple[list[Element], set[int] | frozenset, bool]:
    parts, declared = main_parts(root, dropped)
    return parts, dropped, declared


def text_by_rules(source: str | None) -> str:
    """The main text of a page by itself, without its site: tags and rules alone."""
    return "\n".join(blocks(*_parts(parse(source), frozenset()))) if source else ""


def _rows(pages: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    ensure_package(pages.sparkSession)
    return pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))


def site_templates(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """`(template)`: hashes of the subtrees that recur on their host.

    A page speaks for a subtree under the hash of its longest block outside it, so that copies count once.  Counts are
    grouped sums of distinct (subtree, page) pairs, which a large host spreads over all partitions.
    """
    rows = _rows(pages, id_col, url_col, html_col).where("html is not null").select("url", "html")

    def send(batches):
        for batch in batches:
            out: dict[str, list] = {"host": [], "subtree": [], "page": [], "weak": []}
            for url, source in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                host = host_of(url)
                own, whole = subtrees(host, parse(source))
                host_key, found = _number(_hash(host)), {(x.hash, x.page, x.weak) for x in own}
                found_rows = [(host_key, None, whole, False), *[(host_key, *x) for x in found]]
                for c, v in zip(out, zip(*found_rows, strict=True), strict=True):
                    out[c].extend(v)
            if out["page"]:
                yield pa.RecordBatch.from_pydict(out, pa.schema([("host", pa.int64()), ("subtree", pa.int64()), ("page", pa.int64()), ("weak", pa.bool_())]))

    sent = rows.mapInArrow(send, "host long, subtree long, page long, weak boolean")
    counts = sent.groupBy("host", "subtree", "page").agg(F.max("weak").alias("weak"))
    counts = cut(counts.groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("n"), F.max("weak").alias("weak")).where((F.col("n") >= MIN_PAGES) | F.col("subtree").isNull()))
    hosts = counts.where("subtree is null").select("host", F.col("n").alias("pages"))
    recurring = sized_join(counts.where("subtree is not null"), hosts, ["host"], "inner")
    share = F.when(F.col("weak"), MIN_SHARE_TEXT).otherwise(MIN_SHARE)
    return recurring.where(F.col("n") >= share * F.col("pages")).select(F.col("subtree").alias("template")).distinct()


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: `page_id, url, text, n_template_subtrees`.

    Null and empty html has an empty text, and so has a page without main text.  Pages without a URL share the empty
    host.  Very long and very deep pages are read whole.  Rows that repeat an id are separate rows; an empty table gives
    no rows; other columns are not read.
    """
    rows = _rows(pages, id_col, url_col, html_col)
    templates = cut(site_templates(pages, id_col, url_col, html_col))
    schema = f"page_id {rows.schema['page_id'].dataType.simpleString()}, url string, text string, n_template_subtrees int"
    if templates.count() <= BROADCAST_TEMPLATES:
        known = np.sort(np.array([r.template for r in templates.collect()], np.int64))
        shared = rows.sparkSession.sparkContext.broadcast(known)

        def extract(batches):
            templates = shared.value

            def is_template(hashes: list[int]) -> np.ndarray:
                if not len(templates):
                    return np.zeros(len(hashes), bool)
                place = np.minimum(np.searchsorted(templates, hashes), len(templates) - 1)
                return templates[place] == np.asarray(hashes)

            for batch in batches:
                yield _text_rows(batch, [page_text(h, u, is_template) for h, u in zip(batch.column("html").to_pylist(), batch.column("url").to_pylist(), strict=True)])

        return rows.mapInArrow(extract, schema)
    return _extract_joined(rows, templates, schema)


def _text_rows(batch: pa.RecordBatch, found: list[tuple[str, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array([t for t, _ in found], pa.string()), pa.array([n for _, n in found], pa.int32())], ["page_id", "url", "text", "n_template_subtrees"])


def _extract_joined(rows: DataFrame, templates: DataFrame, schema: str) -> DataFrame:
    """Extraction where templates are too many to broadcast: each page is joined with those that it holds."""
    keyed = rows.withColumn("page_key", F.xxhash64("url", "html"))

    def send(batches):
        for batch in batches:
            keys, hashes = [], []
            for key, url, source in zip(*(batch.column(c).to_pylist() for c in ("page_key", "url", "html")), strict=True):
                if source:
                    found = {x.hash for x in subtrees(host_of(url), parse(source))[0]}
                    keys += [key] * len(found)
                    hashes += found
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(hashes, pa.int64())], ["page_key", "template"])

    held = keyed.select("page_key", "url", "html").mapInArrow(send, "page_key long, template long").distinct()
    held = held.join(templates, "template").groupBy("page_key").agg(F.collect_list("template").alias("templates"))  # subtrees of one page

    def extract(batches):
        for batch in batches:
            texts = []
            for source, url, templates in zip(*(batch.column(c).to_pylist() for c in ("html", "url", "templates")), strict=True):
                known = set(templates or ())
                texts.append(page_text(source, url, lambda hashes, known=known: [h in known for h in hashes]))
            yield _text_rows(batch, texts)

    return keyed.join(held, "page_key", "left").select("page_id", "url", "html", "templates").mapInArrow(extract, schema)
