"""Main text of web pages: differencing against the nearest page of the host.

A page becomes blocks of text, each with the path of its containers (names and classes). What lies in
navigation, headers, footers, asides, forms, scripts or elements named as adverts, notices, menus or
comments is never text. Differencing decides the rest: pages are paired by URL path within their host,
the lines of both, with their paths, are aligned by longest common subsequence, and what both share is
the template's and goes: outside article and main elements line by line; inside them the nearest container (a div,
a list, the article itself) if every line of it is shared. A sentence that two articles happen to share stays.
Inside them the header is the article's own, and names count for containers alone. Pages whose lines are
all the same are copies, not a template: they keep theirs. A page of which over half is marked by
article or main and shared is a version of the other's story: it keeps the marked lines. A page with no
other on its host keeps all lines.

Hosts of any size: all pages are cut into ranges in order of host and path, and the first and last
page of a range are also sent to the neighbouring range; a page is paired with whichever neighbour
in order of path shares the longer start of the path. Tasks hold three pages at a time.

Defined results: null html is empty; an empty page has the empty text; a null url is of the
host ''; repeated rows are pages like any other (copies); malformed markup is read as
browsers do where that is simple (an unclosed tag ends with its parent); pages are read whole;
other columns are not read.
"""

from __future__ import annotations

import html as entities
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_batches, written
from .urlrank import host_of, path_of

#: Ranges of pages for each shuffle partition.
RANGES = 4
#: Aligned lines of one page at most this many squared are compared in the plain table of the
#: subsequence; longer ones by their unique lines in order first (patience), exact between them.
TABLE = 4_000_000
#: Lines of the other page that one step compares.
BLOCK_LINES = 4096

# Element names.
SKIP = frozenset("script style noscript template iframe svg math canvas object embed audio video map form button select textarea input label fieldset dialog nav header footer aside menu head title".split())
RAW = frozenset("script style noscript template iframe textarea title".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CONTENT = frozenset(("article", "main"))
#: A new one of these ends an open one of the same kind.
SELF_ENDING = frozenset("p li dt dd tr td th option".split())
#: An open element of these keeps what is around it open.
SCOPES = frozenset("ul ol dl table article main div section td".split())
#: Blocks whose start ends an open paragraph.
ENDS_P = BLOCK - frozenset(("body", "html", "caption", "tbody", "td", "tfoot", "th", "thead", "tr", "option", "legend"))
#: Containers inside an article that a page may share with its neighbour as a whole.
REGION = frozenset("div section ul ol dl table figure blockquote details address center aside nav form header footer".split())
#: Whole words of class, id or role that name what is not the main text.
_WORDS = (
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|nav\w*|menu\w*|breadcrumbs?|sidebar|widget\w*"
    r"|header|masthead|footer|foot|copyright|legal|comments?|disqus|replies|reply|respond|share|sharing|social|related|recommend\w*|pagination|pager|toolbar|search|login|signup|skip|complementary|contentinfo|navigation)"
)
NAMED = re.compile(rf"(?i)(?:^|[\s_-]){_WORDS}(?:$|[\s_-])")
#: Inside an article a name counts if it says nothing else: share-buttons, not share-price.
NAMED_ALONE = re.compile(rf"(?i)(?:^|\s){_WORDS}(?:[_-](?:{_WORDS}|areas?|bars?|blocks?|box|boxes|buttons?|containers?|icons?|links?|lists?|sections?|slots?|units?|wrap|wrapper))*(?:$|\s)")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?i)\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
SPACE = re.compile(r"\s+")

OPEN, TEXT = 0, 1


def unwanted(name: str, attributes: str, content: bool) -> bool:
    """Whether an element, inside an article or main element if ``content``, is no text."""
    if name in SKIP and not (content and name == "header"):
        return True
    if not attributes.strip() or name in ("body", "html", "article", "main"):
        return False
    for key, value in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key in ("class", "id", "role") and (name in REGION and NAMED_ALONE.search(value) if content else NAMED.search(value)):
            return True
        if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"(?i)display\s*:\s*none", value):
            return True
    return False


def classes(attributes: str) -> str:
    return "".join("." + ".".join(sorted(value.strip("\"'").split())) for key, value in ATTRIBUTE.findall(attributes) if key.lower() == "class")


def blocks(page: str) -> list[tuple[int, int, str, str]]:
    """(OPEN or TEXT, region, path, line) of each block that structure does not drop, in page order.

    The region is the number of the nearest container inside an article or main element, or of that; else 0."""
    out: list[tuple[int, int, str, str]] = []
    parts: list[str] = []
    stack: list[tuple[str, bool, bool, int, str]] = []  # name, dropped, content, region, path
    names: Counter = Counter()
    regions, at = 0, 0

    def flush() -> None:
        if parts:
            line = SPACE.sub(" ", entities.unescape("".join(parts))).strip()
            if line:
                out.append((TEXT if stack and stack[-1][2] else OPEN, stack[-1][3] if stack else 0, stack[-1][4] if stack else "", line))
            parts.clear()

    def pop(depth: int) -> None:
        while len(stack) > depth:
            if stack[-1][0] in BLOCK or stack[-1][1]:
                flush()
            names[stack.pop()[0]] -= 1

    end = len(page)
    while at < end:
        m = TOKEN.search(page, at)
        stop = m.start() if m else end
        if stop > at and not (stack and stack[-1][1]):
            parts.append(page[at:stop])
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:  # an end tag closes up to its start, if there is one
            if names[name] > 0:
                pop(next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name))
            elif name in BLOCK and not (stack and stack[-1][1]):
                flush()
            continue
        if name in VOID:
            if not (stack and stack[-1][1]):
                if name == "hr":
                    flush()
                elif name == "br":
                    parts.append(" ")
            continue
        if name in ENDS_P or name in SELF_ENDING:
            own = ("p" if name in ENDS_P else name, name if name in SELF_ENDING else "")
            for i in range(len(stack) - 1, max(-1, len(stack) - 24), -1):
                if stack[i][0] in own:
                    pop(i)
                if i < len(stack) and stack[i][0] in SCOPES or i >= len(stack):
                    break
        if name in BLOCK and not (stack and stack[-1][1]):
            flush()
        above = stack[-1] if stack else ("", False, False, 0, "")
        dropped = above[1] or unwanted(name, m[3], above[2])
        if dropped and not above[1]:
            flush()
        if name in RAW:  # raw text: nothing in it is a tag but its own end
            close = re.compile(rf"</{name}\s*>", re.I).search(page, at)
            at = close.end() if close else end
            continue
        if not m[3].endswith("/") or name in BLOCK:
            region = above[3]
            if name in CONTENT or above[2] and name in REGION:
                regions += 1
                region = regions
            path = f"{above[4]}/{name}{classes(m[3])}" if name in BLOCK and len(above[4]) < 1000 else above[4]
            stack.append((name, dropped, not dropped and (above[2] or name in CONTENT), region, path))
            names[name] += 1
    flush()
    return out


def _parsed(htmls: pa.Array) -> pa.Array:
    """The blocks of each page, compressed: they are shuffled instead of the markup."""
    return pa.array([zlib.compress(json.dumps(blocks(x or ""), ensure_ascii=False).encode()) for x in htmls.to_pylist()], pa.binary())


def prefix_lengths(x: list, y: list) -> np.ndarray:
    """Lengths of the longest common subsequences of ``x`` with y[:0], y[:1], ... y[:len(y)].

    ``y`` is taken in blocks, one step a block and line of ``x``: a bit of ``open_`` turns to 0
    where the length grows, and what overflows is carried to the next block.
    """
    carried, grown = [0] * len(x), []
    for at in range(0, len(y), BLOCK_LINES):
        block = y[at : at + BLOCK_LINES]
        places: dict = {}
        for j, s in enumerate(block):
            places[s] = places.get(s, 0) | (1 << j)
        full = (1 << len(block)) - 1
        open_ = full
        for i, s in enumerate(x):
            hit = open_ & places.get(s, 0)
            total = open_ + hit + carried[i]
            carried[i] = total >> len(block)
            open_ = (total & full) | (open_ ^ hit)
        zeros = np.frombuffer((full ^ open_).to_bytes(len(block) // 8 + 1, "little"), np.uint8)
        grown.append(np.unpackbits(zeros, bitorder="little")[: len(block)])
    return np.concatenate([[0], *grown]).cumsum(dtype=np.int64)


def shared_lines(a: list, b: list) -> set[int]:
    """Positions in ``a`` of its longest common subsequence with ``b``."""
    lead = 0
    while lead < min(len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    tail = 0
    while tail < min(len(a), len(b)) - lead and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(lead), *range(len(a) - tail, len(a))}
    x, y = a[lead : len(a) - tail], b[lead : len(b) - tail]
    if len(x) * len(y) > TABLE:
        if len(x) == 1:
            return found | ({lead} if x[0] in y else set())
        # The best place to cut y where x is halved: no table is held, and the result is as long.
        half = len(x) // 2
        ahead, behind = prefix_lengths(x[:half], y), prefix_lengths(x[half:][::-1], y[::-1])[::-1]
        cut = int(np.argmax(ahead + behind))
        found |= {lead + i for i in shared_lines(x[:half], y[:cut])}
        return found | {lead + half + i for i in shared_lines(x[half:], y[cut:])}
    best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(len(x) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(y) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x[i] == y[j] else max(below[j], row[j + 1])
    i = j = 0
    while i < len(x) and j < len(y):
        if x[i] == y[j]:
            found.add(lead + i)
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return found


def main_text(own: list, other: list | None) -> str:
    """The text of a page, given the blocks of the page it is paired with."""
    lines, theirs = [(path, s) for _, _, path, s in own], [(path, s) for _, _, path, s in other or []]
    gone = shared_lines(lines, theirs) if lines and theirs and lines != theirs else set()
    marked = {i for i, block in enumerate(own) if block[0] == TEXT}
    kept = {own[i][1] for i in marked - gone}  # regions with a line of their own
    gone = {i for i in gone if i not in marked or own[i][1] not in kept}
    if 2 * sum(len(lines[i][1]) for i in marked & gone) > sum(len(s) for _, s in lines):
        gone -= marked
    return "\n".join(s for i, (_, s) in enumerate(lines) if i not in gone)


def start_shared(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a range follow each other in order of host and path; each looks at both neighbours.

    Rows of the ranges beside it are only looked at."""

    def rows():
        for batch in batches:
            for key, url, to, own, host, path, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield key, url, (to, host), path, [tuple(x) for x in json.loads(zlib.decompress(packed))], own

    def result(before, row, after) -> str:
        near = [x for x in (before, after) if x and x[2] == row[2]]
        other = max(near, key=lambda x: start_shared(x[3], row[3])) if near else None
        return main_text(row[4], other[4] if other else None)

    before = row = None
    out: tuple[list, list, list] = ([], [], [])
    held = 0
    for after in _then_none(rows()):
        if row is not None and row[5]:
            text = result(before, row, after)
            held += len(text)
            for column, value in zip(out, (row[0], row[1], text), strict=True):
                column.append(value)
            if held > 8 << 20:
                yield _batch(out)
                out, held = ([], [], []), 0
        before, row = row, after
    if out[0]:
        yield _batch(out)


def _then_none(rows: Iterator) -> Iterator:
    yield from rows
    yield None


def _batch(out: tuple[list, list, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], ["page_id", "url", "text"])


def ranges(pages: DataFrame, parts: int) -> DataFrame:
    """One row: the first and last (host, path, page_id) of each range, in order."""
    cut = pages.select("host", "path", "page_id").repartitionByRange(parts, "host", "path", "page_id").withColumn("range", F.spark_partition_id())
    key = F.struct("host", "path", "page_id")
    ends = cut.groupBy("range").agg(F.min(key).alias("first"), F.max(key).alias("last")).agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("r"))
    return ends.select(F.col("r.first").alias("firsts"), F.col("r.last").alias("lasts"))


def extracted(df: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """page_id, url and main text of every page."""
    text_batches(df.sparkSession)
    keys = df.select(df[page_id].cast("long").alias("page_id"), df[url].alias("url"), host_of(df[url]).alias("host"), path_of(df[url]).alias("path"), df[html].alias("html"))
    pages = keys.withColumn("blocks", F.arrow_udf(_parsed, "binary").asNondeterministic()("html")).drop("html")
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bounds, _ = written(ranges(keys, RANGES * parts), "page-ranges")
    key = F.struct("host", "path", "page_id")
    pages = pages.crossJoin(F.broadcast(bounds)).withColumn("range", F.size(F.filter("firsts", lambda first: first <= key)))
    at = F.col("range")
    ahead = F.when((at > 1) & (key == F.try_element_at("firsts", at)), at - 1)
    behind = F.when((at < F.size("firsts")) & (key == F.try_element_at("lasts", at)), at + 1)
    pages = pages.select("page_id", "url", F.explode(F.array_compact(F.array(at, ahead, behind))).alias("to"), "range", "host", "path", "blocks")
    pages = pages.select("page_id", "url", "to", (F.col("to") == F.col("range")).alias("own"), "host", "path", "blocks")
    ordered = pages.repartition(parts, "to").sortWithinPartitions("to", "host", "path", "page_id", "blocks")
    return ordered.mapInArrow(_extracted, "page_id long, url string, text string")


def op4_html(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extracted(table(spark, sf_dir, "pages")).withColumn("n_chars", F.char_length("text").cast("long"))
