"""Main text of web pages: what a page shares with the page of the nearest URL on its host is not its own.

Pages of a host stand in order of their path; a page's partner is the neighbour with the
longer common path prefix, or the other one where that is a copy.  Lines are aligned by a longest
common subsequence and shared ones are deleted, inside and outside article and main elements alike.
Markup has two says: menus, adverts, forms, comments and the like are not content even where no
other page has them, and where a page's article is a copy of its partner's, its lines stay.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.store import shuffle_width
from seriesloom.llm.urls import host_of, path_of

# Fixed values of HTML.
RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements that never hold main text.
ASIDE = frozenset(
    "nav header footer aside form script style noscript template svg iframe button select textarea dialog menu head title object canvas".split()
)
MAIN = frozenset(("article", "main"))
#: Words of class, id and role that mark what is not main text.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar sidebars "
    "comment comments commentlist disqus replies respond cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended breadcrumb breadcrumbs menu menus nav navbar "
    "navigation navigationbar footer header masthead topbar pagination pager toolbar widget widgets complementary contentinfo search login signup".split()
)
_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""", re.S)
_MARKED = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?=[\s=/]|$)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
#: Marks of articles are whole names, maybe numbered: a theme's "has-sidebar" or "comments-open" says nothing about the article.
_NAME = re.compile(r"(?:^|(?<=\s))([a-z]+)(?:[-_]?\d+)?(?=\s|$)")

BOILERPLATE, BODY, CONTENT = 0, 1, 2
#: Where pages share at least this part of their lines, they are copies and say nothing about each other's frame; so do articles.
COPY_SHARE = 0.8


def _set_apart(name: str, attributes: str) -> bool:
    """Whether an element's name or marks say that it holds no main text."""
    if name in ASIDE:
        return True
    if not attributes or name in ("html", "body"):
        return False
    for key, a, b, c in _MARKED.findall(attributes):
        key, value = key.lower(), (a or b or c).lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true"):
            return True
        names = () if name == "main" else (_NAME if name == "article" else _WORD).findall(value)
        if key in ("class", "id", "role") and not MARKS.isdisjoint(names):
            return True
    return False


def page_lines(source: str) -> list[tuple[str, int]]:
    """(line, region) of every block of text in page order; white space is one space, lines are trimmed."""
    lines: list[tuple[str, int]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool]] = []  # name, set apart, main
    apart = main = 0

    def close() -> None:
        if parts:
            line = " ".join(html.unescape("".join(parts)).split())
            parts.clear()
            if line:
                lines.append((line, BOILERPLATE if apart else CONTENT if main else BODY))

    def pop() -> None:
        nonlocal apart, main
        _, a, m = stack.pop()
        apart, main = apart - a, main - m

    at = 0
    while tag := _TAG.search(source, at):
        if tag.start() > at:
            parts.append(source[at : tag.start()])
        at = tag.end()
        name = (tag[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS:
            close()
        if name == "br":
            parts.append("\n")
        elif tag[1]:
            if any(x[0] == name for x in stack):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
        elif name not in VOID and not tag[3].endswith("/"):
            if name == "p" and any(x[0] == "p" for x in stack):  # a paragraph ends where the next begins
                last = max(i for i, x in enumerate(stack) if x[0] == "p")
                if not any(x[0] in BLOCKS for x in stack[last + 1 :]):
                    while len(stack) > last:
                        pop()
            a, m = _set_apart(name, tag[3]), name in MAIN
            stack.append((name, a, m))
            apart, main = apart + a, main + m
    parts.append(source[at:])
    close()
    return lines


def common_lines(a: Sequence[int], b: Sequence[int]) -> set[int]:
    """Positions of ``a`` in a longest common subsequence of ``a`` and ``b``."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    shared = set(range(head)) | set(range(len(a) - tail, len(a)))
    places: dict[int, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []  # last place in b of the best chain of each length
    links: list[tuple] = []
    for i in range(head, len(a) - tail):
        for j in places.get(a[i], ()):
            k = bisect_left(ends, j)
            link = (i, links[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                links.append(link)
            else:
                ends[k], links[k] = j, link
    link = links[-1] if links else None
    while link:
        shared.add(link[0])
        link = link[1]
    return shared


def own_lines(regions: bytes, lines: Sequence[int], partners: Sequence[tuple[bytes, Sequence[int]]]) -> list[int]:
    """Positions of the lines that are main text, given the regions and line hashes of a page and of its partners, best first.

    The first partner that is no copy decides; without one, all lines that are not set apart stay.
    """
    open_ = {i for i, r in enumerate(regions) if r != BOILERPLATE}
    for _, other in partners:
        shared = common_lines(lines, other) & open_
        if len(shared) >= COPY_SHARE * len(open_):
            continue
        content = {i for i in open_ if regions[i] == CONTENT}
        # An article copy has its article in common and little else of its own: a teaser beside a longer text is none.
        if len(shared & content) >= COPY_SHARE * len(content) and len(open_ - content - shared) <= len(content):
            shared -= content
        return sorted(open_ - shared)
    return sorted(open_)


def _key(host: str, path: str, page: int | None) -> tuple:
    return host, path, page is not None, page or 0


def _cuts(keys: DataFrame, parts: int) -> list[tuple]:
    """``parts - 1`` cuts of the order of pages, from about 100 hashed keys a part; they only balance work."""
    every = max(1, keys.count() // (100 * parts))
    sample = keys.filter(F.pmod(F.xxhash64("host", "path", "page_id"), F.lit(every)) == 0).distinct().collect()
    order = sorted({_key(r.host, r.path, r.page_id) for r in sample})
    return sorted({order[len(order) * i // parts] for i in range(1, parts)}) if order else []


def _edges(keys: DataFrame, cuts: list[tuple]) -> dict[int, tuple[tuple, tuple]]:
    """First and last key of each part; two keys a part reach the driver."""
    schema = "part int, host string, path string, has boolean, page bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends: dict[int, list[tuple]] = {}
        for batch in batches:
            for key in map(_key, *(batch.column(c).to_pylist() for c in ("host", "path", "page_id"))):
                part = bisect_right(cuts, key)
                low, high = ends.get(part, (key, key))
                ends[part] = [min(low, key), max(high, key)]
        rows = [(p, *k) for p, both in ends.items() for k in both]
        types = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.int64()]
        columns = list(zip(*rows)) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "host", "path", "has", "page"])

    key = F.struct("host", "path", "has", "page")
    found = keys.mapInArrow(run, schema).groupBy("part").agg(F.min(key).alias("low"), F.max(key).alias("high")).collect()
    return {r.part: (tuple(r.low), tuple(r.high)) for r in found}


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every row of ``pages(page_id, url, html)``.

    Null and empty html gives an empty text; a null URL has an empty host and path, so such
    pages are each other's neighbours; a page alone on its host, or between copies only, goes by
    the elements and marks that set text apart.  Other columns are ignored.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "html")
    keys = rows.select("host", "path", "page_id")
    width = shuffle_width(pages)
    cuts = _cuts(keys, 2 * width)
    edges = _edges(keys, cuts)
    spark = pages.sparkSession
    order = sorted(edges)
    neighbours = {}  # a key at the edge of a part also goes, without its text, to the part beside it
    for left, right in zip(order, order[1:]):
        neighbours.setdefault(edges[left][1], set()).add(right)
        neighbours.setdefault(edges[right][0], set()).add(left)
    sent = spark.sparkContext.broadcast((cuts, neighbours))  # at most two keys a part
    schema = "part int, context boolean, host string, path string, page_id bigint, url string, lines binary, regions binary, texts binary"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts, neighbours = sent.value
        press = zstandard.ZstdCompressor(level=3)
        names = [x.split()[0] for x in schema.split(", ")]
        types = [pa.int32(), pa.bool_(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary()]
        out, size = [], 0

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        for batch in batches:
            page_ids, urls, hosts, paths = (batch.column(c).to_pylist() for c in ("page_id", "url", "host", "path"))
            for page, url, host, path, source in zip(page_ids, urls, hosts, paths, batch.column("html")):
                found = page_lines(source.as_py() or "")
                regions = bytes(r for _, r in found)
                lines = np.array([xxhash.xxh3_64_intdigest(t) for t, _ in found], dtype=np.uint64).tobytes()
                texts = press.compress("\n".join("" if r == BOILERPLATE else t for t, r in found).encode())
                key = _key(host, path, page)
                out.append((bisect_right(cuts, key), False, host, path, page, url, lines, regions, texts))
                out += [(p, True, host, path, page, None, lines, regions, None) for p in neighbours.get(key, ())]
                size += len(texts) + len(lines)
                if size > 4 << 20:
                    yield batch_of(out)
                    out, size = [], 0
        if out:
            yield batch_of(out)

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        previous = current = None
        out, size = [], 0

        def rows() -> Iterator[dict]:
            for batch in batches:
                for i in range(batch.num_rows):
                    yield {c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)}
            yield None

        def finished(row, before, after) -> tuple:
            near = [x for x in (before, after) if x and (x["part"], x["host"]) == (row["part"], row["host"])]
            near.sort(key=lambda x: -_prefix(x["path"], row["path"]))
            hashes = lambda x: np.frombuffer(x["lines"], dtype=np.uint64).tolist()
            kept = own_lines(row["regions"], hashes(row), [(x["regions"], hashes(x)) for x in near])
            texts = unpack.decompress(row["texts"]).decode().split("\n") if kept else []
            text = "\n\n".join(texts[i] for i in kept)
            return row["page_id"], row["url"], text, len(text)

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            types = [pa.int64(), pa.string(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["page_id", "url", "text", "n_chars"])

        for row in rows():
            if current and not current["context"]:
                out.append(finished(current, previous, row))
                size += out[-1][3]
                if size > 2 << 20:
                    yield batch_of(out)
                    out, size = [], 0
            previous, current = current, row
        if out:
            yield batch_of(out)

    dealt = rows.mapInArrow(parse, schema).repartition(width, "part")
    dealt = dealt.sortWithinPartitions("part", "host", "path", "page_id", "context")
    return dealt.mapInArrow(pair, "page_id bigint, url string, text string, n_chars bigint")


def _prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)
