"""Main text of web pages by site style trees.

Pages of a host are merged into one tree: a style node is a path of elements with their classes, and says which sequences of children (presentation) and which texts (content)
the host's pages show there. The entropy of either over the pages, relative to the log of their number, is the node's importance: what looks and reads the same on page after page has
none, and its branch goes, whatever it is called. Boilerplate that differs from page to page, and pages of hosts with few pages, are left to rules on elements and class names. Articles' own paragraphs and
headings stay. A page is parsed once: blocks and style nodes are written, the tree is made of the nodes, and the blocks are filtered by its low branches.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Branches below this importance go, where at least so many different pages of a host show them.
IMPORTANCE, PAGES = 0.2, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|([a-zA-Z-]+)(?=[\s/]|\Z)")
_NAME = re.compile(r"[a-z]+|[0-9]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")

# Fixed values of HTML: elements without content, of raw text, in the line, and those that a new one of the same kind ends.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
ENDS = {"li": {"li"}, "p": {"p"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Blocks that end an open paragraph, and elements that an end stays inside of.
ENDS_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("article aside body button div footer form header html main nav section table td th ul ol dl".split())

#: Elements, roles and words of class or id that are no part of an article.
NO_TEXT = frozenset("head script style textarea title noscript iframe noembed noframes xmp template svg canvas object audio video select button nav footer aside form menu dialog".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
NO_NAME = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments consent cookie cookies copyright disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices pager pagination popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: Words of class or id that are no part of an article outside of one.
NO_NAME_OUTSIDE = frozenset("header topbar branding logo tagline bottom legal imprint".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: Words of class or id of an article's body where no element says so.
BODY_NAME = frozenset("article story post entry".split())
_KEEPS = frozenset("h1 h2 h3 h4 h5 h6 p li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th figure figcaption br hr".split())


@dataclass(slots=True)
class _Node:
    tag: str
    path: int
    out: bool
    article: bool
    content: xxhash.xxh64


@dataclass
class Page:
    """A page's blocks in order: text, whether a rule drops it, whether it is in an article, and its style node; and the style nodes: the one above, the children's sequence, the text below."""

    blocks: list[tuple[str, bool, bool, int]] = field(default_factory=list)
    up: dict[int, int] = field(default_factory=dict)
    looks: dict[int, int] = field(default_factory=dict)
    contents: dict[int, xxhash.xxh64] = field(default_factory=dict)
    kept: set[int] = field(default_factory=set)


_paths: dict[tuple, int] = {}


def _path(parent: int, label: str) -> int:
    found = _paths.get((parent, label))
    if found is None:
        if len(_paths) > 200_000:
            _paths.clear()
        found = _paths[parent, label] = xxhash.xxh64_intdigest(f"{parent}/{label}") - (1 << 63)
    return found


def _attributes(text: str) -> dict[str, str]:
    return {(m[1] or m[5]).lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(text)} if text.strip(" /\n\t") else {}


def parse(page: str | None) -> Page:
    """The blocks and style nodes of a page, in time in proportion to its length; null and empty pages have none."""
    out = Page()
    if not page:
        return out
    stack = [_Node("", 0, False, False, xxhash.xxh64())]
    # Where each kind of element is open in the stack, and where those are that an end stays inside of.
    open_: dict[str, list[int]] = {}
    scopes: list[int] = [0]
    text: list[str] = []
    last: dict[int, str] = {}

    def flush() -> None:
        if text:
            joined = " ".join("".join(text).split())
            text.clear()
            if joined:
                top = stack[-1]
                out.blocks.append((joined, top.out, top.article, top.path))
                top.content.update(joined)
                top.content.update("\n")

    def pop(to: int) -> None:
        while len(stack) > to:
            node = stack[-1]
            if node.tag not in INLINE or node.out != stack[-2].out:
                flush()
            stack.pop()
            open_[node.tag].pop()
            if node.tag in SCOPE:
                scopes.pop()
            above = stack[-1]
            if node.path != above.path:
                digest = node.content.digest()
                out.contents.setdefault(node.path, xxhash.xxh64()).update(digest)
                above.content.update(digest)
            elif node.content is not above.content:
                above.content.update(node.content.digest())

    at = 0
    while at < len(page):
        token = _TOKEN.search(page, at)
        end = token.start() if token else len(page)
        if end > at:
            piece = page[at:end]
            text.append(entities.unescape(piece) if "&" in piece else piece)
        if not token:
            break
        at = token.end()
        if token[0].startswith("<![CDATA["):
            continue
        if token[2] is None:
            continue
        tag = token[2].lower()
        if token[1]:
            places = open_.get(tag)
            if places and (tag in SCOPE or places[-1] > scopes[-1]):
                pop(places[-1])
            elif not places and tag not in INLINE:
                flush()
            continue
        if tag not in INLINE:
            flush()
        if tag in ENDS_P or tag in ENDS:
            ends = ENDS.get(tag, set()) | ({"p"} if tag in ENDS_P else set())
            to = max((open_[e][-1] for e in ends if open_.get(e)), default=0)
            if to and to >= scopes[-1]:
                pop(to)
        if tag in RAW:
            closing = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            continue
        if tag in VOID:
            continue
        top = stack[-1]
        attributes = _attributes(token[3])
        named = f"{attributes.get('class', '')} {attributes.get('id', '')}" if attributes else ""
        names = set(_NAME.findall(_CAMEL.sub(" ", named).lower())) if named.strip() else set()
        role = attributes.get("role", "").lower()
        opens = tag == "article" or tag == "main" or role in ("main", "article") or attributes.get("itemprop") == "articleBody"
        dropped = tag in NO_TEXT or role in NO_ROLE or "hidden" in attributes or attributes.get("aria-hidden") == "true" or (tag == "header" and not top.article)
        dropped = dropped or (not top.article and bool(names & NO_NAME_OUTSIDE) and tag not in ("html", "body", "main", "article")) or bool(_UNSEEN.search(attributes.get("style", "")))
        dropped = dropped or bool(names & NO_NAME and tag not in ("html", "body", "main") and not (tag == "article" and not names & {"comment", "comments", "related", "teaser", "ad", "promo"}))
        label = f"{tag}.{attributes.get('class', '')}#{attributes.get('id', '')}" if names else tag
        styled = tag not in INLINE and tag not in ("html", "body")
        path = _path(top.path, label) if styled else top.path
        if dropped and not top.out:
            flush()
        node = _Node(tag, path, top.out or dropped, (top.article or opens or bool(names & BODY_NAME and tag in ("div", "section"))) and not dropped, xxhash.xxh64() if styled else top.content)
        if styled:
            out.up[path] = top.path
            if last.get(top.path) != label:
                out.looks[top.path] = _path(out.looks.get(top.path, 0), label)
                last[top.path] = label
            out.looks.setdefault(path, 0)
            if opens or (node.article and tag in _KEEPS and not names):
                out.kept.add(path)
        open_.setdefault(tag, []).append(len(stack))
        if tag in SCOPE:
            scopes.append(len(stack))
        stack.append(node)
    flush()
    pop(1)
    return out


def _candidates(page: Page) -> list[bool]:
    """Whether the rules keep each block: those in articles where there are any, else all that no rule drops."""
    inside = any(a and not out for _, out, a, _ in page.blocks)
    return [not out and (a or not inside) for _, out, a, _ in page.blocks]


def _below(paths: list[int], up: list[int], low: set[int]) -> list[bool]:
    """Whether each style node (``up`` is the place of the one above it, which comes before it, or -1) is in ``low`` or under one that is."""
    out: list[bool] = []
    for p, u in zip(paths, up):
        out.append(p in low or (u >= 0 and out[u]))
    return out


def main_text(page: Page, low: frozenset[int] | set[int] = frozenset()) -> str:
    """The page's article without the branches in ``low``."""
    paths = list(page.up)
    place = {p: i for i, p in enumerate(paths)}
    gone = _below(paths, [place.get(page.up[p], -1) for p in paths], low - page.kept)
    return " ".join(t for (t, _, _, p), keep in zip(page.blocks, _candidates(page)) if keep and not (p in place and gone[place[p]]))


def host(url):
    """The host of a url column in lower case; null for null and for what has none."""
    return F.nullif(F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def parsed_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each page read once: row_id, page_id, url, host; texts (of the blocks that the rules keep, else empty), kept and at (each block's style node); paths (of the style nodes, null for
    those that always stay), up, looks, contents; article (a hash of what the rules keep)."""
    common.ship(pages.sparkSession)
    own = common.numbered(pages).select(F.monotonically_increasing_id().alias("row_id"), common.named(pages, id_col).cast("long").alias("page_id"), common.named(pages, url_col).cast("string").alias("url"), common.named(pages, html_col).cast("string").alias("html"))
    own = own.withColumn("host", host(F.col("url"))).select("row_id", "page_id", "url", "host", "html")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for page in map(parse, batch.column(4).to_pylist()):
                paths, keep = list(page.up), _candidates(page)
                place = {p: i for i, p in enumerate(paths)}
                texts = [t if k else "" for (t, _, _, _), k in zip(page.blocks, keep)]
                rows.append((texts, keep, [place.get(p, -1) for _, _, _, p in page.blocks], [None if p in page.kept else p for p in paths], [place.get(page.up[p], -1) for p in paths],
                             [page.looks[p] for p in paths], [page.contents[p].intdigest() - (1 << 63) for p in paths], xxhash.xxh64_intdigest("\n".join(t for t in texts if t)) - (1 << 63)))
            columns = list(zip(*rows)) if rows else [()] * len(_SHAPES)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(c, t) for c, t in zip(columns, _SHAPES.values()))], names=["row_id", "page_id", "url", "host", *_SHAPES])

    schema = "row_id long, page_id long, url string, host string, texts array<string>, kept array<boolean>, at array<int>, paths array<long>, up array<int>, looks array<long>, contents array<long>, article long"
    return common.store(own.mapInArrow(run, schema), "parsed")


_SHAPES = {
    "texts": pa.list_(pa.string()), "kept": pa.list_(pa.bool_()), "at": pa.list_(pa.int32()), "paths": pa.list_(pa.int64()), "up": pa.list_(pa.int32()), "looks": pa.list_(pa.int64()),
    "contents": pa.list_(pa.int64()), "article": pa.int64(),
}


def low_branches(parsed: DataFrame, importance: float = IMPORTANCE, least: int = PAGES) -> DataFrame:
    """(host, path) of the branches whose importance over the host's different pages is low. Pages with the same article count once for each look and content."""
    nodes = parsed.filter("host is not null").select("host", "article", F.inline(F.arrays_zip("paths", "looks", "contents"))).filter("paths is not null")
    # Counts by content first: the texts of a node are many, its looks few.
    each = nodes.distinct().groupBy("host", F.col("paths").alias("path"), "looks", "contents").agg(F.count("*").alias("n"))
    by_content = each.groupBy("host", "path", "looks").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.ln("n")).alias("c"))
    by_look = by_content.groupBy("host", "path").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.ln("n")).alias("l"), F.sum("c").alias("c"))
    entropy = lambda c: (F.ln("m") - F.col(c) / F.col("m")) / F.ln("m")
    return by_look.filter(F.col("m") >= least).filter(F.greatest(entropy("l"), entropy("c")) < importance).select("host", "path")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text (the main text, empty if none), n_chars, n_blocks, n_low (blocks in branches of low importance), n_named (other blocks that the rules drop): one row a row of ``pages``.

    Blocks are joined by a space in page order, white space inside is one space, character references are decoded. A null html is empty; a null url belongs to no host and loses no
    branch for its importance. Repeated rows stay and weigh once; an empty table gives an empty result; further columns are not read.
    """
    parsed = parsed_pages(pages, id_col, url_col, html_col)
    low = common.store(low_branches(parsed), "branches")
    shown = parsed.filter("host is not null").select("row_id", "host", F.explode("paths").alias("path")).filter("path is not null")
    marks = common.store(common.join_sized(shown, low, ["host", "path"], "inner", 96).groupBy("row_id").agg(F.collect_set("path").alias("low")), "marks")
    joined = common.join_sized(parsed, marks, "row_id", "left", 128).select("page_id", "url", "texts", "kept", "at", "paths", "up", "low")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = []
            for texts, kept, at, paths, up, low_ in zip(*(batch.column(i).to_pylist() for i in range(2, 8))):
                gone = _below(paths, up, set(low_)) if low_ else ()
                under = [bool(gone) and a >= 0 and gone[a] for a in at]
                text = " ".join([t for t, k, u in zip(texts, kept, under) if k and not u])
                found.append((text, len(text), len(texts), sum(under), sum(not k and not u for k, u in zip(kept, under))))
            columns = list(zip(*found)) if found else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])], names=["page_id", "url", "text", "n_chars", "n_blocks", "n_low", "n_named"])

    return joined.mapInArrow(run, "page_id long, url string, text string, n_chars long, n_blocks long, n_low long, n_named long")
