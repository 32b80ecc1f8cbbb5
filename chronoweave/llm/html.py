"""HTML extraction by nearest-URL page differencing, with marked articles protected.

1. A page is cut into text blocks in page order, over a stack of open elements with the end tags that HTML implies.
   Menus, headers, footers, sidebars, forms, scripts, styles, and elements whose class, id or role says advert, notice,
   comments and the like are left out on the way. Blocks inside ``article`` or ``main`` are noted.
2. Equal pages of a host (by a hash of their blocks) are one page, at the least of their URL paths. So the nearest page
   always differs, however many copies lie side by side.
3. Pages of a host lie in the order of their URL paths; each is paired with the neighbour whose path shares more with
   its own. The two line lists are aligned by longest common subsequence, and lines in it are deleted as the site's.
4. Structure protects an article: where a page marks one, its blocks stay, shared or not, and all others go. Without
   that, passages that articles quote or copy would be lost.

Lines are aligned by 64-bit hashes of their text; texts themselves stay where the page was read. The order comes from a
range sort, so a host of any size is spread over tasks. Places in it are cut into blocks, and a block also gets the page
before and the page behind it, so the result doesn't depend on how the rows were dealt out.
"""

from __future__ import annotations

import hashlib
import html as _html
import re
from bisect import bisect_left
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, scratch, small, table

#: Pages in a row that one group of a task compares.
BLOCK_PAGES = 500
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*>?|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)([^>]*+)>", re.S)
ATTRIBUTE = re.compile(r"(?i)([a-z_:@][-a-z0-9_:.@]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
UNSEEN = re.compile(r"(?i)display\s*:\s*none|visibility\s*:\s*hidden")
#: Words of class, id or role that mark what isn't the article.
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay "
    "nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside widget related recommended share sharing social comment comments reply replies respond disqus "
    "newsletter subscribe subscription signup login pagination pager toolbar search complementary contentinfo".split()
)
#: A name of several parts is noise if one part is, and the others say only what kind of box it is.
BOXES = frozenset(
    "area bar bottom box btn button buttons center container content element field form frame global group holder icons inner item items layer left line link links list main outer page panel "
    "region right row section site slot space strip thread tool tools top unit wrap wrapper".split()
)
#: An article or main element is noise only by these.
NOT_ARTICLES = frozenset("ad ads advert advertisement sponsored promo comment comments reply replies related recommended".split())
SKIP = frozenset("head script style noscript template nav footer aside form select button textarea iframe object svg canvas audio video dialog menu".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = {t: re.compile(rf"</{t}\b[^>]*>?", re.I) for t in ("script", "style", "textarea", "title", "noscript", "template", "iframe")}
#: Tags that end an open element without its end tag: those elements, and the elements they don't reach beyond.
ENDS = {
    **dict.fromkeys("address article aside blockquote center details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split(), (frozenset({"p"}), frozenset("button table td th caption object template".split()))),
    "li": (frozenset({"li"}), frozenset("ul ol menu".split())),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    **dict.fromkeys(("tbody", "thead", "tfoot"), (frozenset({"tbody", "thead", "tfoot"}), frozenset({"table"}))),
    "option": (frozenset({"option"}), frozenset({"select"})),
}


def _noise(tag: str, attributes: str) -> bool:
    """Whether an element isn't shown, or its class, id or role says that it isn't the article's text."""
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and UNSEEN.search(value)):
            return True
        if name not in ("class", "id", "role"):
            continue
        for word in value.split():
            if tag in ("article", "main"):
                if word in NOT_ARTICLES:
                    return True
            elif word in NOISE:
                return True
            elif "-" in word or "_" in word:
                parts = [x for x in re.split(r"[-_]+", word) if x and not x.isdigit()]
                if not NOISE.isdisjoint(parts) and all(x in NOISE or x in BOXES for x in parts):
                    return True
    return False


def blocks(page: str | None) -> list[tuple[str, bool]]:
    """(text, whether in a marked article) of each block that isn't left out, in page order."""
    out: list[tuple[str, bool]] = []
    text: list[str] = []
    page = page or ""
    at, size = 0, len(page)
    opened: list[str] = []  # elements that are open
    marks: list[int] = []  # places of article and main among them
    skip = -1  # the place of the element that is left out
    count: dict[str, int] = defaultdict(int)  # how many of each name are open

    def end() -> None:
        if text:
            line = " ".join(_html.unescape("".join(text)).split())
            text.clear()
            if line:
                out.append((line, bool(marks)))

    def close(k: int) -> None:
        """The element at place k ends, and all inside it."""
        nonlocal skip
        for x in opened[k:]:
            count[x] -= 1
        del opened[k:]
        if skip >= k:
            skip = -1
        while marks and marks[-1] >= k:
            marks.pop()

    def implied(tag: str) -> None:
        which, bounds = ENDS[tag]
        if not any(count[x] for x in which):
            return
        for k in range(len(opened) - 1, -1, -1):
            if opened[k] in which:
                close(k)
                return
            if opened[k] in bounds:
                return

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            if skip < 0:
                text.append(page[at:])
            break
        if skip < 0 and m.start() > at:
            text.append(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA[") and skip < 0:
                text.append(_html.escape(m[0][9:-3]))
            continue
        tag, closing, attributes = tag.lower(), bool(m[1] or m[4]), m[3] or m[6] or ""
        if not closing and tag in RAW:
            done = RAW[tag].search(page, at)
            at = done.end() if done else size
            continue
        if tag in BLOCK and skip < 0:
            end()
        if closing:
            for k in range(len(opened) - 1, -1, -1) if count[tag] else ():
                if opened[k] == tag:
                    close(k)
                    break
                if opened[k] in BLOCK and tag not in BLOCK:  # an inline end tag doesn't end blocks
                    break
            continue
        if tag == "body" and count["head"]:  # the head was never closed
            close(opened.index("head"))
        if tag in ENDS:
            implied(tag)
        if tag in VOID or attributes.endswith("/"):
            continue
        opened.append(tag)
        count[tag] += 1
        if skip >= 0:
            continue
        own_heading = tag == "header" and bool(marks)
        if tag in SKIP or (tag == "header" and not own_heading) or (attributes and tag not in ("html", "body") and not own_heading and _noise(tag, attributes)):
            end()
            skip = len(opened) - 1
        elif tag in ("article", "main"):
            marks.append(len(opened) - 1)
    end()
    return out


def main_text(page: str | None) -> str:
    """The text of a page that marks its article; of another page all blocks."""
    got = blocks(page)
    inner = [b for b, inside in got if inside]
    return "\n".join(inner if inner else [b for b, _ in got])


def common_lines(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` of a longest common subsequence (Hunt and Szymanski: r log n for r equal pairs)."""
    places: dict[str, list[int]] = defaultdict(list)
    for j, line in enumerate(b):
        places[line].append(j)
    ends: list[int] = []
    chain: list[tuple[int, object]] = []
    for i, line in enumerate(a):
        for j in reversed(places.get(line, ())):
            k = bisect_left(ends, j)
            node = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(node)
            else:
                ends[k], chain[k] = j, node
    out, node = set(), chain[-1] if chain else None
    while node:
        out.add(node[0])
        node = node[1]
    return out


def shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((k for k in range(n) if a[k] != b[k]), n)


def _differenced(rows):
    """rows: (block, own, row, host, path, lines) in order of block and place. Yields (row, places of the lines that the
    nearest page shares) of the block's own pages."""
    before = current = None

    def done(row, left, right):
        near = [x for x in (left, right) if x is not None and (x[0], x[3]) == (row[0], row[3])]
        other = max(near, key=lambda x: shared_prefix(x[4], row[4]), default=None)
        return row[2], sorted(common_lines(row[5], other[5])) if other else []

    for row in rows:
        if current is not None and current[1]:
            yield done(current, before, row)
        before, current = current, row
    if current is not None and current[1]:
        yield done(current, before, None)


def _in_blocks(rows: DataFrame) -> DataFrame:
    """rows: row, host, path, lines. Adds block and own, sorted by block and place: each page in its block, and
    the pages at a block's ends once more in the next one, there as context only."""
    keys = ["host", "path", "row"]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    placed = materialize(placed, "places")
    part = F.shiftright("at", 33)
    # a count for each partition of the sort, so there are as many numbers as partitions
    counts, offsets, n = dict(placed.groupBy(part).count().collect()), [], 0
    for k in sorted(counts):
        offsets.append((k, n))
        n += counts[k]
    starts = rows.sparkSession.createDataFrame(offsets, "part bigint, start bigint")
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    ranked = placed.withColumn("part", part).join(F.broadcast(starts), "part").withColumn("place", place)
    block, size = F.floor(F.col("place") / BLOCK_PAGES), F.lit(BLOCK_PAGES)
    at = lambda b, own, ok: F.when(ok, F.struct(b.alias("block"), F.lit(own).alias("own")))
    first, last = (F.col("place") % size == 0) & (block > 0), F.col("place") % size == size - 1
    copies = F.array_compact(F.array(at(block, True, F.lit(True)), at(block - 1, False, first), at(block + 1, False, last)))
    return ranked.select(F.inline(copies), "place", "row", "host", "path", "lines").repartition("block").sortWithinPartitions("block", "place").drop("place")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars, marked (whether the page marks an article), n_blocks, n_shared (of a page
    that doesn't: its blocks that the nearest page shares) for each page.

    Defined results: a null or empty page has an empty text; a null id or url stays null, and pages without a URL are a
    host of their own; a page alone on its host keeps its lines; repeated rows and copies under other URLs have the text
    that one of them would have; columns beside these three aren't read."""
    kind = pages.schema[id_col].dataType.simpleString()
    url = F.coalesce(F.col(url_col), F.lit(""))
    origin = r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//"
    pages = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.lower(F.regexp_extract(url, origin + r"([^/?#]*)", 1)).alias("host"),
        F.regexp_replace(url, origin + r"[^/?#]*|[?#].*$", "").alias("path"), F.coalesce(html_col, F.lit("")).alias("html"),
    )

    def read(it):
        import pyarrow as pa
        from xxhash import xxh64_intdigest as xxh

        for b in it:
            for k in range(0, b.num_rows, 200):
                part = b.slice(k, 200)
                got = [blocks(h.as_py()) for h in part.column(4)]
                raw = [[x.encode("utf-8", "surrogatepass") for x, _ in g] for g in got]
                digests = [hashlib.md5(b"\n".join(b"%d%s" % (y, x) for x, (_, y) in zip(r, g, strict=True))).digest() for r, g in zip(raw, got, strict=True)]
                hashes = [[xxh(x) - (1 << 63) for x in r] for r in raw]
                marked = [any(y for _, y in g) for g in got]
                text = ["\n".join(x for x, y in g if y) if m else None for g, m in zip(got, marked, strict=True)]
                lines = [None if m else [x for x, _ in g] for g, m in zip(got, marked, strict=True)]
                more = [pa.array(digests, pa.binary()), pa.array(hashes, pa.list_(pa.int64())), pa.array(marked), pa.array(text, pa.string()), pa.array(lines, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*part.columns[:4], *more], ["page_id", "url", "host", "path", "digest", "hashes", "marked", "text", "lines"])

    def differ(it):
        import pyarrow as pa

        rows = (tuple(b.column(c)[k].as_py() for c in range(6)) for b in it for k in range(b.num_rows))
        out = []

        def batch():
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.list_(pa.int32()))], ["row", "gone"])

        for row in _differenced(rows):
            out.append(row)
            if len(out) == BLOCK_PAGES:
                yield batch()
                out = []
        if out:
            yield batch()

    with scratch() as s:
        cut = pages.mapInArrow(read, f"page_id {kind}, url string, host string, path string, digest binary, hashes array<bigint>, marked boolean, text string, lines array<string>")
        cut = s.keep(materialize(cut.withColumn("row", F.monotonically_increasing_id()), "lines"))
        # one row stands for all equal pages of a host
        heads = cut.groupBy("host", "digest").agg(F.min(F.struct("path", "row", "marked")).alias("m")).select("host", "digest", "m.row", "m.marked")
        heads = materialize(heads, "distinct-pages")
        placed = _in_blocks(cut.select("row", "host", "path", F.col("hashes").alias("lines")).join(heads.select("row").hint("shuffle_hash"), "row", "left_semi"))
        shared = materialize(placed.select("block", "own", "row", "host", "path", "lines").mapInArrow(differ, "row long, gone array<int>"), "shared-lines")
        shared = s.keep(materialize(heads.where("not marked").join(shared.hint("shuffle_hash"), "row").select("host", "digest", "gone"), "shared-of-pages"))
    size = F.size("hashes")
    left = F.array_except(F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>")), "gone")
    # the text of a page with a marked article is settled where it was read, and stays there
    settled = cut.where("marked").select("page_id", "url", "text", "marked", size.alias("n"), F.lit(None).cast("int").alias("m"))
    rest = cut.where("not marked").join(small(shared, "shuffle_hash"), ["host", "digest"])
    rest = rest.select("page_id", "url", F.array_join(F.transform(left, lambda i: F.get("lines", i)), "\n").alias("text"), "marked", size.alias("n"), F.size("gone").alias("m"))
    return settled.union(rest).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "marked", F.col("n").cast("long").alias("n_blocks"), F.col("m").cast("long").alias("n_shared"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
