"""Main text of web pages: element subtrees that recur across many pages of a host are the site's template."""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glucoframe.llm.common import BROADCAST_ROWS
from glucoframe.session import broadcast_if_small, cut_lineage

# A subtree is the site's template if it recurs on at least so many different pages of the host.
MIN_PAGES = 5
# A text element among the first or last EDGE of an article is one if it does so on this share, and at least so many, of the
# different pages under the same first step of the path: versions of one text share their first and last paragraphs too.
EDGE = 3
MIN_EDGE_PAGES = 25
MIN_EDGE_SHARE = 0.5

# Names of HTML: elements whose content is raw text, has no end tag, flows inside a line, or is never main text.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
DROPPED = frozenset(
    "template noscript head nav footer aside form button select option input fieldset dialog menu svg math canvas audio video object map".split()
)
# An element with a mark inside a longer name is dropped up to this share of the page's text, and articles or the main
# element are taken for the main text from this share on.
MOST_MARKED = 1 / 3
LEAST_MAIN = 1 / 2
# Text elements hold the running text itself; inside an article they are a template at its edges only.
TEXT = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd blockquote pre td th caption figcaption".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()
)
# Words of class, id and role that mark menus, adverts, notices, comments and the like.
MARKS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising sponsor sponsored "
    "promo promotion banner notice notices notification alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login search share sharing "
    "social dialog comment comments commentlist respond replies reply disqus related recommended pagination pager widget toolbar complementary contentinfo skip hidden".split()
)
_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*)")
_REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+>")
_BROKEN = re.compile(r"<(?:/?[A-Za-z]|[!?])")
_MARK = re.compile(r"(?<![\w-])(class|id|role|hidden|aria-hidden)(?![\w-])(?:\s*+=\s*+(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>])", re.IGNORECASE) for name in RAW}
_LONG_NUMBER = re.compile(r"&#0*([0-9]+);?")

# What is known of an element, as bits: its level (2 inside an article, 1 inside main), then these.
LEVEL, BOX, ARTICLE_TEXT, GONE, PERHAPS, TITLE = 3, 4, 8, 16, 32, 64


def _marked(attributes: str, inside: bool) -> tuple[bool, bool, bool]:
    """Whether the attributes mark an element as not main text, perhaps do, and mark it as main text (role=main or article).

    A whole name (class="comments") is a mark; a word inside a longer name (class="has-comments") only may be one. Inside
    an article or main element a header is that of the text and stays.
    """
    main = maybe = False
    for name, value in _MARK.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name == "hidden" and not value or name == "aria-hidden" and value == "true":
            return True, False, False
        if name == "role":
            main = main or value in ("main", "article")
        if name in ("class", "id", "role"):
            marks = {word for word in _WORD.findall(value) if word in MARKS and not (inside and word == "header")}
            if marks.intersection(value.split()):
                return True, False, False
            maybe = maybe or bool(marks)
    return False, maybe, main


def _decoded(text: str) -> str:
    """Character references decoded; a number too large for a character is the replacement character."""
    if "&" not in text:
        return text
    return unescape(_LONG_NUMBER.sub(lambda m: f"&#{m[1]};" if len(m[1]) < 8 else "�", text))


class Page:
    """A page as runs of text inside a tree of block elements (and of inline elements that are marked).

    runs: (text, node, opens) where opens tells whether a block begins; white space is one space, also at a run's ends.
    parents, kinds, hashes: of the nodes, parents first. The hash covers the names and texts of the whole subtree, whatever
    the elements are called. The markup is read once from left to right: the end of a tag is looked for once, and if quotes never
    end they count for nothing in the rest of the page, so the time is in proportion to the page.
    """

    def __init__(self, html: str):
        self.runs: list[tuple[str, int, bool]] = []
        self.parents: list[int] = []
        self.kinds: list[int] = []
        self.hashes: list[int] = []
        self._html, self._quotes = html, True
        self._text: list[str] = []
        self._opens = True
        self._stack: list[tuple[str, int]] = []
        self._open_names: Counter[str] = Counter()
        self._inner: list[list[str]] = []
        self._open("body", 0)
        self._read()
        while self._stack:
            self._close()

    def _open(self, name: str, level: int, extra: int = 0, inline: bool = False) -> None:
        self._flush(ends=not inline)
        parent = self._stack[-1][1] if self._stack else -1
        above = self.kinds[parent] if parent >= 0 else 0
        kind = max(level, above & LEVEL) | extra
        if name in TEXT and above & LEVEL == 2:
            kind |= ARTICLE_TEXT
        elif name not in ("body", "article", "main") and not inline:
            kind |= BOX
        self.parents.append(parent)
        self.kinds.append(kind | (TITLE if name == "h1" else 0))
        self.hashes.append(0)
        self._stack.append((name, len(self.parents) - 1))
        self._open_names[name] += 1
        self._inner.append([name])

    def _close(self) -> None:
        name, node = self._stack[-1]
        self._flush(ends=name not in INLINE)
        self._stack.pop()
        self._open_names[name] -= 1
        value = xxhash.xxh64_intdigest("\x1f".join(self._inner.pop()).encode("utf-8", "surrogatepass"), 0)
        self.hashes[node] = value - (1 << 64) if value >> 63 else value
        if self._inner:
            self._inner[-1].append(f"\x1e{value:x}")

    def _flush(self, ends: bool = True) -> None:
        """The text read so far is a run; a block ends after it unless an inline element goes on."""
        if self._text:
            raw = _decoded("".join(self._text))
            self._text = []
            text = " ".join(raw.split())
            if raw and (text or not self._opens):
                spaced = (" " if raw[0].isspace() else "") + text + (" " if text and raw[-1].isspace() else "")
                self.runs.append((spaced, self._stack[-1][1], self._opens))
                self._inner[-1].append(text)
                self._opens = False
        if ends:
            self._opens = True

    def _tag_end(self, at: int, size: int) -> int:
        """The place behind the > that ends the tag around `at`. There is one before `size`."""
        if self._quotes:
            found = _REST.match(self._html, at, size)
            if found:
                return found.end()
            self._quotes = False
        return self._html.find(">", at, size) + 1

    def _read(self) -> None:
        html, at = self._html, 0
        last = html.rfind(">")
        tail = html.rfind("<")
        size = tail if tail > last and _BROKEN.match(html, tail) else len(html)  # an unfinished tag at the end is left out
        start = 0
        while True:
            at = html.find("<", at, last + 1)
            if at < 0:
                break
            tag = _NAME.match(html, at, last + 1)
            if tag is None:
                if html.startswith("<!--", at):
                    end = html.find("-->", at + 2)
                    end = end + 3 if end >= 0 else size
                elif html[at + 1 : at + 2] in ("!", "?"):
                    end = html.find(">", at) + 1
                else:
                    at += 1
                    continue
                if at > start:
                    self._text.append(html[start:at])
                at = start = end
                continue
            if at > start:
                self._text.append(html[start:at])
            end = self._tag_end(tag.end(), last + 1)
            name, attributes = tag[2].lower(), html[tag.end() : end - 1]
            if tag[1]:
                self._end(name)
            elif name in RAW:
                found = _RAW_END[name].search(html, end)
                end = html.find(">", found.end()) + 1 or size if found else size
                self._flush()
            else:
                self._begin(name, attributes)
            at = start = end
        if start < size:
            comment = html.find("<!--", start, size)  # one that never ends
            self._text.append(html[start : comment if comment >= 0 else size])

    def _begin(self, name: str, attributes: str) -> None:
        if name in VOID:
            if name in ("hr", "embed"):
                self._flush()
            elif name in ("br", "img", "input"):
                self._text.append(" ")
            return
        if name in ("html", "body"):
            self._end("head")
            return
        level = self.kinds[self._stack[-1][1]] & LEVEL
        marked, maybe, main = _marked(attributes, level > 0) if attributes else (False, False, False)
        gone = name in DROPPED or marked and name != "main" or name == "header" and level == 0
        extra = GONE if gone else PERHAPS if maybe and name != "main" else 0
        if name in INLINE:
            if extra or self._open_names[name]:
                self._open(name, 0, extra, inline=True)
            return
        if gone and attributes.endswith("/") and name not in ENDS_P:
            return
        if name in ENDS_P:
            self._implied({"p"})
        if name in CLOSED_BY:
            self._implied(CLOSED_BY[name])
        self._open(name, 2 if name == "article" else 1 if main or name == "main" else 0, extra)

    def _implied(self, names: set[str]) -> None:
        """End the innermost block if it is one of those that the next one ends, with the inline elements inside it."""
        inside = len(self._stack) - 1
        while inside > 0 and self._stack[inside][0] in INLINE:
            inside -= 1
        if inside > 0 and self._stack[inside][0] in names:
            while len(self._stack) > inside:
                self._close()
            if self._stack[-1][0] in names:
                self._implied(names)

    def _end(self, name: str) -> None:
        if name == "br":
            self._text.append(" ")
        elif name in ("html", "body"):
            self._flush()
        elif self._open_names[name]:
            while self._stack[-1][0] != name:
                self._close()
            self._close()
        elif name not in INLINE:
            self._flush()


def main_blocks(runs: list[tuple[str, int, bool]], parents: list[int], kinds: list[int], dead: set[int] | frozenset[int] = frozenset()) -> list[tuple[str, int]]:
    """(text, node) of the blocks of the main text, without the subtrees in `dead`.

    Elements that the markup names as menus and the like go, those that only a longer name marks up to MOST_MARKED of the text.
    Of the rest the main text is what lies inside articles if that holds LEAST_MAIN of it, else inside main if that does, else
    all. A first heading beside them belongs to them if they have none.
    """
    gone = bytearray(len(parents))
    for node, parent in enumerate(parents):
        gone[node] = bool(kinds[node] & GONE) or node in dead or parent >= 0 and gone[parent]
    sizes = [0] * len(parents)
    for text, node, _ in runs:
        if not gone[node]:
            sizes[node] += len(text)
    total = sum(sizes)
    for node in range(len(parents) - 1, 0, -1):
        sizes[parents[node]] += sizes[node]
    for node, parent in enumerate(parents):
        if kinds[node] & PERHAPS and sizes[node] <= MOST_MARKED * total or parent >= 0 and gone[parent]:
            gone[node] = True
    blocks: list[list] = []
    ended = True
    for text, node, opens in runs:
        ended = ended or opens
        if not gone[node]:
            if ended:
                blocks.append([[], node])
            blocks[-1][0].append(text)
            ended = False
    made = [(" ".join("".join(texts).split()), node) for texts, node in blocks]
    made = [(text, node) for text, node in made if text]
    held = [0, 0, 0]
    for text, node in made:
        for level in range((kinds[node] & LEVEL) + 1):
            held[level] += len(text)
    best = next(level for level in (2, 1, 0) if held[level] >= held[0] * LEAST_MAIN)
    titled = any(kinds[node] & LEVEL >= best and kinds[node] & TITLE for _, node in made)
    return [(text, node) for text, node in made if kinds[node] & LEVEL >= best or not titled and kinds[node] & TITLE]


def edges(blocks: list[tuple[str, int]], parents: list[int], kinds: list[int]) -> tuple[list[int], list[int]]:
    """The text elements of an article that hold its first and its last EDGE blocks, the title aside, from the outside in; -1 for
    a block outside of text elements."""
    def holder(node: int) -> int:
        while node >= 0 and not kinds[node] & ARTICLE_TEXT:
            node = parents[node]
        return node

    inner = [node for _, node in blocks if not kinds[node] & TITLE]
    return [holder(node) for node in inner[:EDGE]], [holder(node) for node in inner[: -EDGE - 1 : -1]]


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[^:/?#]*://([^/?#]*)", 1), F.lit("")))


def section_of(url: Column) -> Column:
    """The first step of the path if another one follows, else empty."""
    return F.coalesce(F.regexp_extract(url, r"^[^:/?#]*://[^/?#]*/([^/?#]+)/", 1), F.lit(""))


_RUNS = pa.list_(pa.struct([("text", pa.string()), ("node", pa.int32()), ("opens", pa.bool_())]))
_NODES = pa.list_(pa.struct([("hash", pa.int64()), ("parent", pa.int32()), ("kind", pa.int8())]))
_PAGE = pa.struct([("runs", _RUNS), ("nodes", _NODES), ("boxes", pa.list_(pa.int64())), ("edges", pa.list_(pa.int64())), ("identity", pa.int64())])
_SHAPE = (
    "struct<runs:array<struct<text:string,node:int,opens:boolean>>,nodes:array<struct<hash:bigint,parent:int,kind:tinyint>>,"
    "boxes:array<bigint>,edges:array<bigint>,identity:bigint>"
)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def parse(html: str) -> dict:
    """A page as rows: its runs, the nodes that hold some, the hashes that may be templates, and what tells the page from copies:
    its title, or else its main text."""
    page = Page(html)
    needed, number = [False] * len(page.parents), {}
    for _, node, _ in page.runs:
        while node >= 0 and not needed[node]:
            needed[node] = True
            node = page.parents[node]
    for node, wanted in enumerate(needed):
        if wanted:
            number[node] = len(number)
    parents = [number.get(page.parents[node], -1) for node in number]
    kinds, hashes = [page.kinds[node] for node in number], [page.hashes[node] for node in number]
    runs = [(text, number[node], opens) for text, node, opens in page.runs]
    blocks = main_blocks(runs, parents, kinds)
    title = next((text for text, node in blocks if kinds[node] & TITLE), None)
    said = title if title is not None else "\n".join(text for text, _ in blocks)
    first, last = edges(blocks, parents, kinds)
    return {
        "runs": [{"text": text, "node": node, "opens": opens} for text, node, opens in runs],
        "nodes": [{"hash": h, "parent": p, "kind": k} for h, p, k in zip(hashes, parents, kinds)],
        "boxes": sorted({h for h, kind in zip(hashes, kinds) if kind & BOX}),
        "edges": sorted({hashes[node] for node in (*first, *last) if node >= 0}),
        "identity": _signed(xxhash.xxh64_intdigest(said.encode("utf-8", "surrogatepass"), 1)),
    }


def parsed(html: Column) -> Column:
    @F.arrow_udf(_SHAPE)
    def read(values: pa.Array) -> pa.Array:
        parts = [pa.array([parse(v or "") for v in values.slice(at, 64).to_pylist()], _PAGE) for at in range(0, len(values), 64)]
        return pa.concat_arrays(parts) if parts else pa.array([], _PAGE)

    return read(html)


def without(page: dict, boxes: list[int], at_edges: list[int]) -> tuple[str, int]:
    """The main text of a parsed page without templates, and how many of its subtrees (outermost ones) they were.

    Boxes go wherever they stand; text elements of an article go from its ends inwards as long as they are templates. An
    article that would be left empty by that keeps them.
    """
    runs = [(run["text"], run["node"], run["opens"]) for run in page["runs"]]
    parents, kinds = [node["parent"] for node in page["nodes"]], [node["kind"] for node in page["nodes"]]
    boxes, at_edges = set(boxes), set(at_edges)
    dead, removed = set(), 0
    if boxes:
        inside = bytearray(len(parents))
        for at, node in enumerate(page["nodes"]):
            above = node["parent"] >= 0 and inside[node["parent"]]
            inside[at] = above or bool(node["kind"] & BOX) and node["hash"] in boxes
            if inside[at] and not above:
                dead.add(at)
                removed += 1
    blocks = main_blocks(runs, parents, kinds, dead)
    if at_edges:
        cut = set()
        for side in edges(blocks, parents, kinds):
            for node in side:
                if node < 0 or page["nodes"][node]["hash"] not in at_edges:
                    break
                cut.add(node)
        inside = bytearray(len(parents))
        for node, parent in enumerate(parents):
            inside[node] = node in cut or parent >= 0 and inside[parent]
        left = [(text, node) for text, node in blocks if not inside[node]]
        if any(not kinds[node] & TITLE for _, node in left):
            blocks, removed = left, removed + len(cut)
    return "\n".join(text for text, _ in blocks), removed


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_edge_pages: int = MIN_EDGE_PAGES, min_edge_share: float = MIN_EDGE_SHARE) -> DataFrame:
    """(host, section, hash) of the templates, from rows with host, section and p (the parsed page); section is null for boxes.

    A box counts by the number of different pages of its host it is on, a text element at an article's edge also by their share
    under the first step of the path. Pages with the same title (without one: the same main text) count once, so copies and
    new versions of an article make no template of it. Counts are combined before each shuffle, and a host with a third
    of all pages is spread by its subtrees.
    """
    boxes = pages.select("host", "p.identity", F.explode("p.boxes").alias("hash")).distinct()
    often = boxes.groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_pages)
    ends = pages.select("host", "section", "p.identity", F.explode("p.edges").alias("hash")).distinct()
    common = ends.groupBy("host", "section", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_edge_pages)
    sizes = pages.select("host", "section", "p.identity").distinct().groupBy(F.col("host").alias("of"), F.col("section").alias("under"))
    sizes = sizes.agg(F.count(F.lit(1)).alias("pages"))
    same = (F.col("host") == F.col("of")) & (F.col("section") == F.col("under"))
    usual = common.join(sizes, same).where(F.col("n") >= F.col("pages") * min_edge_share)
    return often.select("host", F.lit(None).cast("string").alias("section"), "hash").unionByName(usual.select("host", "section", "hash"))


def main_text(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", min_pages: int = MIN_PAGES,
    min_edge_pages: int = MIN_EDGE_PAGES, min_edge_share: float = MIN_EDGE_SHARE, broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """(page_id, url, text, n_chars, n_removed): the main text, one block a line, and the number of template subtrees deleted.

    Every block element's subtree is hashed, whatever its name. Subtrees that recur on `min_pages` different pages of the host are deleted;
    inside an article the text elements (paragraphs, headings, list items) only from its edges and if they recur on
    `min_edge_pages` and on `min_edge_share` of the pages under the same first path step. Of what is left, parts that the markup names as menus, footers, forms
    and the like are dropped; the rest is the page's articles or its main element if they hold half of the text, else its body.

    Pages are parsed once and written to the shared folder. Up to `broadcast_rows` templates are broadcast as one list per host and
    section; beyond that hashes meet templates in a join and only those that hit return to their page. Null or empty html: empty
    text. Null url: the pages without a host are a host of their own. Null or repeated ids: every row is a page. Broken markup
    is read as far as it goes; an unfinished tag at the end is left out. Further columns are ignored.
    """
    rows = pages.select(F.col(f"`{id_column}`").alias("page_id"), F.col(f"`{url_column}`").alias("url"), F.col(f"`{html_column}`").alias("html"))
    place = F.monotonically_increasing_id().alias("row")
    read = cut_lineage(rows.select("page_id", "url", place, host_of(F.col("url")).alias("host"), section_of(F.col("url")).alias("section"), parsed(F.col("html")).alias("p")))
    found = cut_lineage(templates(read, min_pages, min_edge_pages, min_edge_share))
    if found.limit(broadcast_rows + 1).count() <= broadcast_rows:
        boxes = found.where(F.col("section").isNull()).groupBy(F.col("host").alias("of")).agg(F.collect_set("hash").alias("often"))
        ends = found.where(F.col("section").isNotNull()).groupBy(F.col("host").alias("under"), F.col("section").alias("step")).agg(F.collect_set("hash").alias("usual"))
        joined = read.join(F.broadcast(boxes), F.col("host") == F.col("of"), "left")
        joined = joined.join(F.broadcast(ends), (F.col("host") == F.col("under")) & (F.col("section") == F.col("step")), "left")
        none = F.array().cast("array<bigint>")
        hits = [F.coalesce(F.array_intersect(have, lists), none) for have, lists in (("p.boxes", "often"), ("p.edges", "usual"))]
        joined = joined.select("page_id", "url", "p.runs", "p.nodes", hits[0].alias("boxes"), hits[1].alias("edges"))
    else:
        held = read.select("row", "host", F.lit(None).cast("string").alias("section"), F.explode("p.boxes").alias("hash"))
        held = held.unionByName(read.select("row", "host", "section", F.explode("p.edges").alias("hash")))
        known = found.select(F.col("host").alias("of"), F.col("section").alias("step"), F.col("hash").alias("known"))
        same = (F.col("host") == F.col("of")) & F.col("section").eqNullSafe(F.col("step")) & (F.col("hash") == F.col("known"))
        lists = [F.collect_set(F.when(F.col("section").isNull() == boxes, F.col("hash"))).alias(name) for boxes, name in ((True, "boxes"), (False, "edges"))]
        hits = held.join(known, same).groupBy(F.col("row").alias("at")).agg(*lists)
        joined = read.join(hits, F.col("row") == F.col("at"), "left").select("page_id", "url", "p.runs", "p.nodes", "boxes", "edges")

    @F.arrow_udf("struct<text:string,removed:bigint>")
    def finished(runs: pa.Array, nodes: pa.Array, boxes: pa.Array, at_edges: pa.Array) -> pa.Array:
        texts, removed = [], []
        for at in range(0, len(runs), 64):
            few = [values.slice(at, 64).to_pylist() for values in (runs, nodes, boxes, at_edges)]
            for r, n, b, e in zip(*few):
                text, count = without({"runs": r or [], "nodes": n or []}, b or [], e or [])
                texts.append(text)
                removed.append(count)
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["text", "removed"])

    cleaned = joined.select("page_id", "url", finished("runs", "nodes", "boxes", "edges").alias("w"))
    return cleaned.select("page_id", "url", F.col("w.text").alias("text"), F.char_length("w.text").cast("long").alias("n_chars"), F.col("w.removed").alias("n_removed"))
