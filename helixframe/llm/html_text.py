"""Main text of web pages, with site templates removed.

An Arrow function parses each page once into blocks of text and the element subtrees that hold them.  A subtree's hash
is made of its tag, class and id and of the hashes of its texts and subtrees, seeded by the host; it comes with the
range of blocks that it covers, so that what a page gives is linear in its length.  Spark counts, for each subtree of a
host, the different pages that have it; subtrees that recur across many of them are templates, and blocks inside one
are deleted.  Equal pages count once.  Pages count by their family: of pages with an article, those whose plain
paragraphs have the same least hash are one family, of others each is its own; where a subtree's pages have fewer
families than half their number, they are near copies of each other, and it is no template.

Counted are the subtrees of the whole page, menus and footers too.  Deleted by their count are subtrees anywhere, but
inside what a page marks as its article (article, or else main) only boxes: an element of PLAIN without class or id is
text there, however often it recurs on the host, as quoted passages do.

The parser's rules go on with what is left: scripts, styles, forms, elements that a tag, role, class or id marks as
menu, header, footer, sidebar, notice, advert or reader comments, and, where a page marks its article, what is outside
it.  removed() counts the blocks that the counts, and those that the rules delete.

Blocks end at the borders of block elements; white space inside one, br included, becomes one space.

Defined results: a null or empty html has no text; a page without a host has no site; very long pages and deep nesting
take linear time; a subtree as frequent as the bound is a template; rows that repeat a page_id each come out; an empty
table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm.common import in_small_batches, join_groups, table, written

#: A subtree is a template from so many different pages of its host on, and from the square root of their number on:
#: a fifth of 25 pages, a thousandth of a million.
LEAST_PAGES = 5
#: Rows of a batch that are parsed at once.
ROWS = 256
#: Pages with deleted blocks that are broadcast at most (some 100 bytes each); more are joined by shuffle.
MOST_BROADCAST_ROWS = 100_000

#: Fixed values of HTML: elements without content, with raw content, and those whose border ends a block of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
#: Which open element a start tag closes: itself a p or item of a list, table or definition.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}, "tfoot": {"tbody", "tr", "td", "th"}}
#: An element of these keeps what is outside it from being closed by CLOSES.
SCOPE = frozenset("ul ol menu dl table html body article section div td th button object template".split())
#: Elements whose border never closes them from inside, by a stray end tag of others than these.
WALLS = frozenset("article main body td th".split())
THROUGH = frozenset("article main body html table tr".split())
#: Elements that are text inside an article, unless they have a class or id.
PLAIN = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol li dl dt dd table tbody thead tfoot tr td th caption figure figcaption hr hgroup header section".split())
#: Never article text, whatever their class.
DROPPED = frozenset("head script style template noscript nav footer aside form iframe object embed svg math button select textarea dialog menu audio video canvas xmp noembed noframes title".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Parts of a class or id that mark what isn't article text.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsbygoogle sponsor sponsored promo promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside rail footer header masthead topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus replies reply respond widget pagination pager copyright disclaimer legal hidden".split()
)

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: One attribute up to a quoted value's first quote (group 2), or the end of the tag (group 1).
ONE_ATTRIBUTE = re.compile(r"""[\s/]*(?:(>)|=?[^\s/>=]*(?:\s*=\s*(?:(["'])|[^\s>"'][^\s>]*)?)?)""")
PARTS = re.compile(r"[a-z]+|[0-9]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
TEXT_BREAK = re.compile(r"<(?=[a-zA-Z/!?])")


def tag_end(page: str, at: int, last_quote: dict[str, int]) -> int:
    """Where the > is that ends the tag whose name ends at `at`, or -1; one inside a quoted value doesn't end it.

    A quote that nothing closes opens no value.
    """
    end = page.find(">", at)
    if end < 0 or page.find('"', at, end) < 0 and page.find("'", at, end) < 0:
        return end
    while True:
        m = ONE_ATTRIBUTE.match(page, at)
        if m[1]:
            return m.end() - 1
        if m.end() == at:
            return -1
        at = m.end()
        if m[2]:
            if last_quote[m[2]] < at:
                return page.find(">", at)
            at = page.find(m[2], at) + 1


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """(kind, name, rest) of what a page consists of: text, start, end; a tag cut off by the end is dropped."""
    at, size, last_quote = 0, len(page), {q: page.rfind(q) for q in "\"'"}
    while at < size:
        m = TEXT_BREAK.search(page, at)
        if not m:
            yield "text", "", page[at:]
            return
        if m.start() > at:
            yield "text", "", page[at : m.start()]
        at = m.end()
        if page.startswith("!--", at):
            end = page.find("-->", at + 1)
            at = size if end < 0 else end + 3
            continue
        if page[at] in "!?" or page[at] == "/" and not NAME.match(page, at + 1):
            end = page.find(">", at)
            at = size if end < 0 else end + 1
            continue
        closing = page[at] == "/"
        name = NAME.match(page, at + closing)
        at = name.end()
        end = tag_end(page, at, last_quote)
        if end < 0:
            return
        tag, rest = name.group().lower(), page[at:end]
        at = end + 1
        yield ("end" if closing else "start"), tag, rest
        if not closing and tag in RAW:
            m = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at)
            stop = m.start() if m else size
            yield "raw", tag, page[at:stop]
            at = stop


def attributes(rest: str) -> dict[str, str]:
    return {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(rest)} if rest.strip(" /\n\t") else {}


def is_dropped(tag: str, found: dict[str, str], in_article: bool) -> bool:
    if tag in DROPPED or tag == "header" and not in_article or "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if found.get("role", "").lower() in ROLES:
        return True
    if tag in ("html", "body"):
        return False
    for name in f"{found.get('class', '')} {found.get('id', '')}".split():
        parts = PARTS.findall(CAMEL.sub("-", name).lower())
        if any(p in MARKS for p in parts) and not (tag in ("article", "main") and not {"comment", "comments", "reply", "ad", "ads"} & set(parts)):
            return True
    return False


class Element:
    __slots__ = ("article", "box", "dropped", "first", "items", "kind", "main", "silent", "tag", "trees")

    def __init__(self, tag: str, kind: str, box: bool, dropped: bool, silent: bool, article: bool, main: bool, first: int, trees: int):
        self.tag, self.kind, self.box, self.article, self.main = tag, kind, box, article, main
        self.dropped, self.silent = dropped, silent  # silent: inside a dropped inline element, whose text isn't that of its block
        self.first, self.trees = first, trees  # of the blocks and subtrees inside
        self.items: list[int] = []  # hashes of texts and elements inside


class Block:
    __slots__ = ("article", "digest", "dropped", "main", "text")

    def __init__(self, text: str, top: Element):
        self.text, self.article, self.main, self.dropped = text, top.article, top.main, top.dropped
        self.digest = xxhash.xxh64_intdigest(text)


class Tree:
    __slots__ = ("article", "box", "digest", "first", "last", "main")

    def __init__(self, digest: int, first: int, last: int, element: Element):
        self.digest, self.first, self.last = digest, first, last  # covers blocks first..last - 1
        self.box, self.article, self.main = element.box, element.article, element.main


def parse(page: str, host: str) -> tuple[list[Block], list[Tree]]:
    """All blocks of a page, in its order, and the subtrees that hold them; a subtree around another that holds the same
    blocks doesn't come out, as it recurs no more often than the inner one."""
    stack = [Element("", "", False, False, False, False, False, 0, 0)]
    open_: dict[str, list[int]] = {}  # where in the stack elements of a tag are
    scopes, walls = [0], [0]
    blocks: list[Block] = []
    trees: list[Tree] = []
    words: list[str] = []
    owner = stack[0]  # the element of the first of words
    seed = xxhash.xxh64_intdigest(host)

    def flush() -> None:
        text = " ".join("".join(words).split())
        words.clear()
        if text:
            blocks.append(Block(text, owner))
            stack[-1].items.append(blocks[-1].digest)

    def push(element: Element) -> None:
        for found in (open_.setdefault(element.tag, []), scopes if element.tag in SCOPE else None, walls if element.tag in WALLS else None):
            if found is not None:
                found.append(len(stack))
        stack.append(element)

    def pop() -> None:
        element = stack[-1]
        if element.tag in BLOCK:
            flush()
        stack.pop()
        open_[element.tag].pop()
        if element.tag in SCOPE:
            scopes.pop()
        if element.tag in WALLS:
            walls.pop()
        if not element.items:
            return
        h = xxhash.xxh64_intdigest(element.kind.encode() + b"\0" + np.array(element.items, "<u8").tobytes(), seed)
        stack[-1].items.append(h)
        if host and element.tag in BLOCK and element.tag not in ("html", "body", "article", "main") and len(blocks) > element.first:
            inner = trees[-1] if len(trees) > element.trees else None
            if not inner or (inner.first, inner.last) != (element.first, len(blocks)) or element.box and not inner.box:
                trees.append(Tree(h, element.first, len(blocks), element))

    def close(tags: set[str]) -> None:
        """Closes the innermost of tags within its scope, with what is open inside it."""
        at = max((open_[t][-1] for t in tags if open_.get(t)), default=0)
        if at and at >= scopes[-1]:
            while len(stack) > at:
                pop()

    for kind, tag, rest in tokens(page):
        if kind == "text":
            if not stack[-1].silent:
                owner = owner if words else stack[-1]
                words.append(html.unescape(rest) if "&" in rest else rest)
        elif kind == "start":
            if tag in BLOCK:
                flush()
                close({"p"})
            if tag in CLOSES:
                close(CLOSES[tag])
            if tag in VOID:
                if words:
                    words.append(" ")
                continue
            top = stack[-1]
            found = attributes(rest) if rest else {}
            dropped = top.dropped or is_dropped(tag, found, top.article or top.main)
            name = f"{found.get('class', '')} {found.get('id', '')}"
            box = tag not in PLAIN or name != " "
            article, main = top.article or tag == "article", top.main or tag == "main" or found.get("role") == "main"
            silent = top.silent or dropped and not top.dropped and tag not in BLOCK
            push(Element(tag, f"{tag} {name}", box, dropped, silent, article and not dropped, main and not dropped, len(blocks), len(trees)))
        elif kind == "end":
            if tag == "br" and words:
                words.append(" ")
            at = open_[tag][-1] if open_.get(tag) else 0
            # A stray end tag doesn't close a wall.
            if at and (tag in THROUGH or at >= walls[-1]):
                while len(stack) > at:
                    pop()
    while len(stack) > 1:
        pop()
    flush()
    return blocks, trees


@dataclass
class Page:
    """What Spark gets of a page: blocks that the rules keep, subtrees that may delete them, and those that only count."""

    family: int
    digest: int  # of its texts
    texts: list[str]
    trees: list[dict[str, int]]  # tree; covers the kept blocks first..last - 1
    elsewhere: list[dict[str, int]]  # tree; n blocks that the rules delete


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def reduced(page: str, host: str) -> Page:
    blocks, trees = parse(page, host)
    part = next((p for p in ("article", "main") if any(getattr(b, p) and not b.dropped for b in blocks)), None)
    kept = [not b.dropped and (not part or getattr(b, part)) for b in blocks]
    number = np.concatenate([[0], np.cumsum(kept, dtype=np.int64)]).tolist()
    may, elsewhere, boxed = [], [], np.zeros(len(blocks) + 1, np.int64)
    for t in trees:
        first, last = number[t.first], number[t.last]
        if first == last:
            elsewhere.append({"tree": signed(t.digest), "n": t.last - t.first})
        elif not part or t.box and getattr(t, part):
            may.append({"tree": signed(t.digest), "first": first, "last": last})
            boxed[t.first] += 1
            boxed[t.last] -= 1
    texts = [b.text for b, k in zip(blocks, kept, strict=True) if k]
    inside = np.cumsum(boxed)
    plain = [b.digest for i, b in enumerate(blocks) if kept[i] and not inside[i]] if part else []
    digest = signed(xxhash.xxh64_intdigest("\0".join(texts)))
    return Page(signed(min(plain)) if plain else digest, digest, texts, may, elsewhere)


HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)")


def host_of(url: str | None) -> str:
    m = HOST.match(url or "")
    return m[1].lower() if m else ""


TREES = "array<struct<tree:bigint,first:int,last:int>>"


def _pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trees = pa.list_(pa.struct([("tree", pa.int64()), ("first", pa.int32()), ("last", pa.int32())]))
    elsewhere = pa.list_(pa.struct([("tree", pa.int64()), ("n", pa.int32())]))
    for batch in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
        hosts = [host_of(url) for url in batch.column(1).to_pylist()]
        found = [reduced(page.as_py() or "", host) for page, host in zip(batch.column(2), hosts, strict=True)]
        columns = [pa.array(hosts, pa.string()), *(pa.array([getattr(x, k) for x in found], pa.int64()) for k in ("family", "digest")), pa.array([x.texts for x in found], pa.list_(pa.string()))]
        columns += [pa.array([x.trees for x in found], trees), pa.array([x.elsewhere for x in found], elsewhere)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["page_id", "url", "host", "family", "digest", "texts", "trees", "elsewhere"])


def parsed(pages: DataFrame) -> DataFrame:
    """row, page_id, url, host, family, digest, texts, trees and elsewhere (see Page) of each page, as a written table."""
    rows = in_small_batches(pages).select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.col("html").cast("string"))
    found = rows.mapInArrow(_pages, f"page_id bigint, url string, host string, family bigint, digest bigint, texts array<string>, trees {TREES}, elsewhere array<struct<tree:bigint,n:int>>")
    # The number is written with its row, so that it doesn't change.
    return written(found.select(F.monotonically_increasing_id().alias("row"), "*"), "parsed-pages")


def templates(found: DataFrame) -> DataFrame:
    """tree, n: the subtrees (hashes are seeded by host) that recur across many different pages of their host."""
    sited = found.where(F.col("host") != "")
    sizes = sited.select("host", "family").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    of_page = F.array_union(F.transform("trees", lambda t: t["tree"]), F.transform("elsewhere", lambda t: t["tree"]))
    trees = sited.select("host", "family", "digest", F.explode(of_page).alias("tree")).distinct()
    families = trees.groupBy("host", "tree", "family").agg(F.count(F.lit(1)).alias("copies"))
    counts = families.groupBy("host", "tree").agg(F.count(F.lit(1)).alias("n"), F.sum("copies").alias("copies"))
    counts = counts.where((F.col("n") >= LEAST_PAGES) & (2 * F.col("n") >= F.col("copies")))
    # A row for each host.
    many = counts.join(sizes, "host").where(F.col("n") >= F.greatest(F.lit(LEAST_PAGES), F.sqrt("pages")))
    return many.groupBy("tree").agg(F.max("n").alias("n"))


def deleted(found: DataFrame) -> DataFrame:
    """row, cut: the ranges of its blocks that templates cover, for each page that has such."""
    trees = written(found.select("row", F.explode("trees").alias("t")).select("row", "t.tree", "t.first", "t.last"), "page-trees")
    counts = trees.groupBy("tree").agg(F.count(F.lit(1)).alias("size")).join(templates(found), "tree", "left_semi")
    hit = join_groups(trees, written(counts, "templates"), "tree", "size", trees.count())
    return hit.groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("cut"))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text of each page."""
    found = parsed(pages)
    marked = written(deleted(found), "deleted")
    joined = F.array_join("texts", "\n\n")
    stays = F.filter("texts", lambda _, i: ~F.exists("cut", lambda c: (c["first"] <= i) & (i < c["last"])))
    text = F.when(F.col("cut").isNull(), joined).otherwise(F.array_join(stays, "\n\n"))
    # Few pages have anything deleted; where these are many they are joined by their row's number.
    few = marked.count() <= MOST_BROADCAST_ROWS
    return found.join(F.broadcast(marked) if few else marked, "row", "left").select("page_id", "url", text.alias("text"))


def removed(pages: DataFrame) -> DataFrame:
    """One row: pages; blocks that templates delete from what the rules keep (by_count), blocks that the rules delete
    (by_rule), and how many of these lie in a template too (by_both)."""
    found = parsed(pages)
    kept = F.filter(F.sequence(F.lit(0), F.size("texts") - 1), lambda i: F.exists("cut", lambda c: (c["first"] <= i) & (i < c["last"])))
    by_count = deleted(found).join(found.select("row", "texts"), "row").agg(F.coalesce(F.sum(F.size(kept)), F.lit(0)).alias("by_count"))
    rest = found.select(F.explode("elsewhere").alias("t")).select("t.tree", "t.n")
    # Innermost subtrees alone would do; nested ones are counted each, so that these two are of subtrees, not blocks.
    marked = rest.join(templates(found).select("tree", F.lit(1).alias("hit")), "tree", "left")
    by_rule = marked.agg(F.count(F.lit(1)).alias("by_rule"), F.count("hit").alias("by_both"))
    pages_ = found.agg(F.count(F.lit(1)).alias("pages"))
    # Each side is one row.
    one = lambda df: df.withColumn("one", F.lit(1))
    return one(pages_).join(one(by_count), "one").join(one(by_rule), "one").drop("one")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("bigint"))
