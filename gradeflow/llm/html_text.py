"""Main text of web pages by a host suffix array (operator 11).

A page is read into blocks, each with the region its markup declares: *article*, *chrome*
(menus, headers, footers, sidebars, notices, adverts, forms, comments, by element, role or class
name) or *open*.  Its token stream has one token per block: a hash of the block's words.  The
streams of all pages of a host are concatenated into one suffix array, which finds every long
substring (``LONG_WORDS`` words or more) that recurs on a distinct page of that host; covered
blocks are boilerplate and unique runs stay.

The suffix array is distributed: suffixes, cut behind the few tokens that can decide about their
first one, are range-partitioned and sorted by (host, tokens) by Spark, so that a host of any size spreads
over many tasks, and each is compared with its nearest neighbours from another page.  Of each
partition four border rows are known to all tasks.  Only pages that hold covered open blocks are
joined with what is covered.

Every block of every page is a token of the array.  Prose inside a declared article is its author's words: passages
that articles share are not boilerplate and stay in the text; of an article's blocks only those that consist of links
(share bars, "read more" lists) go if covered.  Where a page declares no article, its open blocks stand for it, less
those that are covered or consist of links.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeflow.llm.common import cut, spread

LONG_WORDS = 5          # words of a repeated substring that counts as long
COPY_SHARE = 0.75       # a page whose open words are covered beyond this is a copy, not a template
LINK_SHARE = 0.5        # an open block with more of its letters in links is a menu
ARTICLE_SHARE = 1 / 3   # further articles of a page count from this share of the longest

# Element and attribute names of web pages.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
    search section summary table tbody tfoot thead tr ul""".split())
CLOSES_P = BLOCK - {"body", "caption", "head", "html", "legend", "optgroup", "option", "tbody", "tfoot", "thead", "tr"}
SCOPES = frozenset("article aside body footer header html main nav table".split())
CHROME_TAGS = frozenset("""aside audio button canvas dialog embed footer form head iframe input label menu nav noembed noframes noscript
    object optgroup option script search select style svg template textarea title video xmp""".split())
CHROME_ROLES = frozenset("""alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search
    status tablist toolbar""".split())
CHROME_WORDS = frozenset("""ad ads adv advert advertisement advertisements advertising adverts alert banner breadcrumb breadcrumbs
    comment comments consent cookie cookies disqus footer gdpr login menu modal nav navbar navigation newsletter notice notices
    notification overlay pager pagination paywall popup promo promoted promotion recommended recommendations related replies reply
    respond share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar topbar trending widget widgets""".split())
HEADER_WORDS = frozenset("header masthead".split())
ARTICLE_NAMES = frozenset("""article article-body article-content article-text articlebody blog-post entry-content post post-body
    post-content story story-body""".split())
MAIN_NAMES = frozenset("content main main-content maincontent page-content".split())
NEVER_NAMED = frozenset("body h1 h2 h3 h4 h5 h6 html main".split())

TOKEN = re.compile(r"<!--(?:.*?-->|.*)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_SPLIT = re.compile(r"[^a-z0-9]+")

ARTICLE, CHROME, OPEN = "article", "chrome", "open"


@dataclass
class Block:
    region: str
    text: str
    article: int = -1        # which declared article of the page
    in_main: bool = False
    link_letters: int = 0
    words: int = field(init=False)

    def __post_init__(self):
        self.words = self.text.count(" ") + 1

    @property
    def is_links(self) -> bool:
        return self.link_letters > LINK_SHARE * len(self.text)


@dataclass
class _Element:
    tag: str
    chrome: bool = False
    article: int = -1
    in_main: bool = False
    link: bool = False


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source else {}


def _declares_chrome(tag: str, attrs: dict[str, str], inside: bool) -> bool:
    """Whether an element's markup says that it is no part of the article; a ``header`` inside the
    article holds its headline."""
    if tag in CHROME_TAGS or tag == "header" and not inside:
        return True
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or attrs.get("role", "").lower() in CHROME_ROLES \
            or re.search(r"display\s*:\s*none", attrs.get("style", "")):
        return True
    if tag in NEVER_NAMED:
        return False
    for name in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split():
        if not name.startswith(("has-", "no-", "with-", "js-")):
            words = set(NAME_SPLIT.split(name))
            if words & CHROME_WORDS or not inside and words & HEADER_WORDS:
                return True
    return False


def blocks_of(source: str | None) -> list[Block]:
    """The text blocks of a page in order; character references decoded, white space turned into
    single spaces, empty ones left out.  Missing, crossed and unclosed tags are tolerated as browsers do."""
    source = source or ""
    stack, blocks, articles = [_Element("")], [], 0
    text: list[str] = []
    chrome: list[str] = []
    linked = 0

    def flush():
        nonlocal linked
        top = stack[-1]
        for pieces, is_chrome in ((text, False), (chrome, True)):
            line = " ".join("".join(pieces).split()) if pieces else ""
            if line:
                region = CHROME if is_chrome else ARTICLE if top.article >= 0 else OPEN
                blocks.append(Block(region, line, -1 if is_chrome else top.article, top.in_main, 0 if is_chrome else linked))
            pieces.clear()
        linked = 0

    def close(upto: int):
        """Close open elements down to stack position ``upto``; inside chrome nothing is flushed, so that a
        menu is one block."""
        if not stack[upto - 1].chrome and any(e.tag in BLOCK for e in stack[upto:]):
            flush()
        del stack[upto:]

    def find(tags, stops) -> int:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in tags:
                return k
            if stack[k].tag in stops:
                break
        return 0

    at = 0
    while True:
        m = TOKEN.match(source, at)
        if not m:
            break
        at = m.end()
        tag = m[2]
        if tag is None:
            piece = m[0]
            if piece[:2] in ("<!", "<?"):
                continue
            decoded = entities.unescape(piece) if "&" in piece else piece
            top = stack[-1]
            (chrome if top.chrome else text).append(decoded)
            if top.link and not top.chrome:
                linked += len(decoded)
            continue
        tag = tag.lower()
        if m[1]:
            k = find((tag,), () if tag in SCOPES else SCOPES - {tag})
            if k:
                close(k)
            elif tag in ("p", "br"):
                (chrome if stack[-1].chrome else text).append(" ")
            continue
        if tag in CLOSES_P and (k := find(("p",), SCOPES)):
            close(k)
        if tag == "li" and (k := find(("li",), SCOPES | {"ul", "ol", "menu"})):
            close(k)
        elif tag in ("dt", "dd") and (k := find(("dt", "dd"), SCOPES | {"dl"})):
            close(k)
        elif tag == "tr" and (k := find(("tr",), ("table",))):
            close(k)
        parent = stack[-1]
        attrs = _attributes(m[3])
        element = _Element(tag, parent.chrome, parent.article, parent.in_main, parent.link or tag == "a")
        names = {x for x in (attrs.get("class", "") + " " + attrs.get("id", "")).lower().split()} if attrs else set()
        if not parent.chrome:
            element.chrome = _declares_chrome(tag, attrs, parent.article >= 0)
        if not element.chrome:
            if parent.article < 0 and (tag == "article" or names & ARTICLE_NAMES and tag not in NEVER_NAMED
                                       or attrs.get("itemprop") == "articleBody" or attrs.get("role") == "article"):
                flush()
                element.article, articles = articles, articles + 1
            if tag == "main" or attrs.get("role") == "main" or names & MAIN_NAMES:
                flush()
                element.in_main = True
        if not parent.chrome and (tag in BLOCK or tag in RAW):
            flush()
        if tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(source, at)
            at = end.start() if end else len(source)
            tail = source.find(">", at)
            at = len(source) if tail < 0 else tail + 1
            continue
        if tag in ("br", "td", "th", "img") or element.chrome and tag in BLOCK:
            (chrome if element.chrome else text).append(" ")
        if tag not in VOID:
            stack.append(element)
    flush()
    return blocks


def article_of(blocks: list[Block]) -> list[int] | None:
    """Positions of the declared article's blocks; None if the page declares none.  Articles of at least a
    third of the longest one's words count."""
    size: dict[int, int] = {}
    for b in blocks:
        if b.article >= 0:
            size[b.article] = size.get(b.article, 0) + b.words
    if not size:
        return None
    least = max(size.values()) * ARTICLE_SHARE
    return [i for i, b in enumerate(blocks) if b.article >= 0 and size[b.article] >= least]


def candidates(blocks: list[Block]) -> list[int]:
    """Positions that stand for the text of a page without a declared article."""
    main = [i for i, b in enumerate(blocks) if b.region == OPEN and b.in_main]
    return main or [i for i, b in enumerate(blocks) if b.region == OPEN]


def text_of(source: str | None, covered: list[int] | None = None) -> str:
    """The main text: blocks of the declared article but its covered links, else the open blocks that are
    neither covered nor menus; one per line."""
    blocks, gone = blocks_of(source), set(covered or ())
    chosen = article_of(blocks)
    if chosen is not None:
        chosen = [i for i in chosen if not (i in gone and blocks[i].is_links)]
    else:
        chosen = [i for i in candidates(blocks) if not blocks[i].is_links]
        if sum(blocks[i].words for i in chosen if i in gone) <= COPY_SHARE * sum(blocks[i].words for i in chosen):
            chosen = [i for i in chosen if i not in gone]
    return "\n".join(blocks[i].text for i in chosen)


def asks(blocks: list[Block]) -> bool:
    """Whether the text of a page can depend on what the array finds."""
    return all(b.article < 0 or b.is_links for b in blocks) or any(b.article >= 0 and b.is_links for b in blocks)


# -- the suffix array ----------------------------------------------------------------

def stream_of(blocks: list[Block]) -> list[tuple[int, int, bytes]]:
    """(position, words, hash) of the tokens in the array: all blocks of the page."""
    return [(i, b.words, xxhash.xxh64_digest(b.text)) for i, b in enumerate(blocks)]


def suffixes(tokens: list[tuple[int, int, bytes]]) -> Iterator[tuple[int, list[bytes], list[int]]]:
    """(position, hashes, words) of each suffix, cut where it can no longer decide about its first token:
    behind ``LONG_WORDS`` tokens, behind a long token, and before a second long one.

    A token inside a long repeated substring lies in a long repeated one of ``LONG_WORDS`` tokens
    at most (each has a word), and a long token decides for itself."""
    for k, (at, words, digest) in enumerate(tokens):
        hashes, sizes = [digest], [words]
        for at2, words2, digest2 in tokens[k + 1:k + LONG_WORDS]:
            if at2 != at + len(hashes) or words >= LONG_WORDS and words2 >= LONG_WORDS:
                break
            hashes.append(digest2)
            sizes.append(words2)
            if words2 >= LONG_WORDS:
                break
        yield at, hashes, sizes


def pack(host: bytes, hashes: list[bytes], page: bytes, key: bytes, at: int, sizes: list[int], asking: bool) -> bytes:
    """A sortable row: host, tokens with marks that order a shorter suffix first, page, and what is carried."""
    return host + b"\1" + b"\1".join(hashes) + b"\0" + page + key + at.to_bytes(4, "big") + bytes([asking]) \
        + bytes(min(s, LONG_WORDS) for s in sizes)


def unpack(row: bytes) -> tuple[bytes, bytes, bytes, int, int, bytes]:
    """(host and tokens, page, key, position, whether the page asks, sizes) of a packed row."""
    n = 8
    while row[n] == 1:
        n += 9
    return row[:n], row[n + 1:n + 9], row[n + 9:n + 25], int.from_bytes(row[n + 25:n + 29], "big"), row[n + 29], row[n + 30:]


def common(a: bytes, b: bytes) -> int:
    """Tokens that two suffixes of one host share from their start."""
    n = 0
    for k in range(8, min(len(a), len(b)), 9):
        if a[k:k + 9] != b[k:k + 9]:
            break
        n += 1
    return n if a[:8] == b[:8] else 0


def page_signature(blocks: list[Block]) -> bytes:
    """What tells pages apart: the hash of a page's longest block, so that exact and most near copies of a page
    are one page."""
    longest = max((b for b in blocks if b.region != CHROME), key=lambda b: b.words, default=None)
    return xxhash.xxh64_digest(longest.text if longest else "")


def _rows_of_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for host, k1, k2, source in zip(*(batch.column(c).to_pylist() for c in ("host", "k1", "k2", "html"))):
            blocks = blocks_of(source)
            page = page_signature(blocks)
            key = (k1 & (1 << 64) - 1).to_bytes(8, "big") + (k2 & (1 << 64) - 1).to_bytes(8, "big")
            host = xxhash.xxh64_digest(host)
            asking = asks(blocks)
            out += [pack(host, hashes, page, key, at, sizes, asking) for at, hashes, sizes in suffixes(stream_of(blocks))]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["suffix"])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last row of a partition and, at each end, the nearest row of another page."""
    first, last = [], []
    for batch in batches:
        for row in batch.column("suffix").to_pylist():
            page = unpack(row)[1]
            if not first or len(first) == 1 and unpack(first[0])[1] != page:
                first.append(row)
            if last and unpack(last[-1])[1] == page:
                last[-1] = row
            else:
                last = last[-1:] + [row]
    if first:
        yield pa.RecordBatch.from_pylist([{"pid": TaskContext.get().partitionId(), "first": first, "last": last}],
                                         schema=pa.schema([("pid", pa.int32()), ("first", pa.list_(pa.binary())),
                                                           ("last", pa.list_(pa.binary()))]))


def _covered(before: dict[int, list[bytes]], after: dict[int, list[bytes]]):
    """Positions covered by a long substring shared with the nearest suffixes of other pages."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("at", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        edge = [unpack(r) for r in before.get(pid, [])]  # nearest first
        left, pending, out = None, [], []  # pending: neighbouring rows of one page; left: the row before them

        def settle(right):
            for row in pending:
                n = max(common(row[0], o[0]) if o else 0 for o in (left, right)) if row[4] else 0
                if sum(row[5][:n]) >= LONG_WORDS:
                    k1, k2 = (int.from_bytes(row[2][i:i + 8], "big", signed=True) for i in (0, 8))
                    out.extend((k1, k2, row[3] + i) for i in range(n))

        for batch in batches:
            for packed in batch.column("suffix").to_pylist():
                row = unpack(packed)
                if not pending:
                    left = next((e for e in edge if e[1] != row[1]), None)
                elif pending[0][1] != row[1]:
                    settle(row)
                    left, pending = pending[-1], []
                pending.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
                out.clear()
        if pending:
            settle(next((e for e in map(unpack, after.get(pid, [])) if e[1] != pending[0][1]), None))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    return run


def _neighbours(borders: list, forward: bool) -> dict[int, list[bytes]]:
    """Per partition the nearest rows of two distinct pages in the partitions beyond it."""
    out, near = {}, []
    for pid, rows in borders:
        out[pid] = near
        mine = rows if forward else rows[::-1]
        seen = {unpack(r)[1] for r in mine}
        near = (list(mine) + [r for r in near if unpack(r)[1] not in seen])[:2]
    return out


def host_of(url: Column) -> Column:
    """The lower-case host of a URL; null and relative URLs share the empty host."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1))


def covered_blocks(pages: DataFrame) -> DataFrame:
    """(k1, k2, covered): positions of repeated blocks of the pages (host, k1, k2, html) that ask and hold any.
    Pages of equal host and html share their keys and their rows."""
    rows = pages.select("host", "k1", "k2", "html").mapInArrow(_rows_of_pages, "suffix binary")
    ordered = cut(rows.repartitionByRange(spread(pages), "suffix").sortWithinPartitions("suffix"))
    # bounded: four rows a partition
    edges = sorted(((r["pid"], r["first"], r["last"]) for r in ordered.mapInArrow(
        _borders, "pid int, first array<binary>, last array<binary>").collect()))
    before = _neighbours([(p, [bytes(x) for x in last]) for p, _, last in edges], forward=False)
    after = _neighbours([(p, [bytes(x) for x in first]) for p, first, _ in reversed(edges)], forward=True)
    found = ordered.mapInArrow(_covered(before, after), "k1 long, k2 long, at int")
    return found.groupBy("k1", "k2").agg(F.sort_array(F.collect_set("at")).alias("covered"))  # a page's own blocks at most


def _texts(id_type: pa.DataType):
    schema = pa.schema([("page_id", id_type), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [text_of(source, covered) for source, covered in zip(b.column("html").to_pylist(), b.column("covered").to_pylist())]
            if texts:
                yield pa.RecordBatch.from_arrays(
                    [b.column("page_id").cast(id_type), b.column("url").cast(pa.string()), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())], schema=schema)
    return run


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every row of ``pages``.

    A null html has no text; a null url has the empty host; equal rows give equal rows; other
    columns are ignored; an empty table gives none.  Ties do not arise: a block is covered or not."""
    from pyspark.sql.pandas.types import to_arrow_type
    kind = pages.schema["page_id"].dataType
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host_of(F.col("url")).alias("host"))
    rows = rows.withColumn("k1", F.xxhash64("host", "html")).withColumn("k2", F.xxhash64("html", "host"))
    joined = rows.join(covered_blocks(rows), ["k1", "k2"], "left").select("page_id", "url", "html", "covered")
    return joined.mapInArrow(_texts(to_arrow_type(kind)), f"page_id {kind.simpleString()}, url string, text string, n_chars long")
