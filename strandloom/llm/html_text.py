"""Main text of HTML pages by nearest-URL page differencing.

Pages of a host are ordered by URL path and paired with their nearest neighbour; the
text lines of a pair are aligned by longest common subsequence and shared lines, the
template of the host, are deleted. Differencing alone cannot see menus and adverts
that change from page to page, nor should it delete a passage that two articles
share, so markup has the last word: lines inside an article stay, lines inside
elements that are never content go. Differencing decides where markup is in doubt:
on lines outside any article, and inside one in elements named like a template's.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .staging import stage, stage_side
from .url_filter import host_of, path_of

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([A-Za-z][^\s/>]*)[^<>]*\Z", re.S)
_ATTRIBUTE = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_RAW = frozenset("script style textarea title noscript template iframe svg math object canvas xmp noembed noframes".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_NEVER = frozenset("nav footer aside form button select dialog menu fieldset head".split())
_MAIN = frozenset(("article", "main"))
_COMMENTS = r"comments?|replies|disqus"
_STRONG = (
    r"ads?|advert\w*|sponsor\w*|promo\w*|sidebar|breadcrumbs?|footer|cookies?|consent|notice|popup|modal|newsletter|subscribe|"
    rf"complementary|contentinfo|navigation|{_COMMENTS}"
)
_WEAK = r"banner|side|menu|nav\w*|discussion|share|sharing|social|related|recommend\w*|login|search|toolbar"


def _hint(names: str) -> re.Pattern:
    return re.compile(rf"(?:^|[\s_-])(?<!has-)(?<!no-)(?<!with-)(?:{names})(?=$|[\s_-])", re.I)


_OF_COMMENTS, _OF_STRONG, _OF_ANY = _hint(_COMMENTS), _hint(_STRONG), _hint(f"{_STRONG}|{_WEAK}")
#: What a line is: free (outside an article, not judged by markup), main, never content, or
#: doubtful (inside an article, in an element whose name may be a template's).
FREE, MAIN, NEVER, DOUBTFUL = 0, 1, 2, 3
#: Bits of a length table that are held; larger ones are halved.
_BITS_HELD = 1 << 26
_CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())


def _kind(tag: str, attributes: str, around: int) -> int:
    """What markup says of the lines inside an element, from its tag, its names and what is around it."""
    inside = around in (MAIN, DOUBTFUL)
    if around == NEVER or tag in _NEVER or (tag == "header" and not inside):
        return NEVER
    names = [a or b or c for a, b, c in _ATTRIBUTE.findall(attributes)]
    if tag in _MAIN:
        return NEVER if tag == "article" and any(map(_OF_COMMENTS.search, names)) else around if inside else MAIN
    if tag in ("html", "body"):
        return around
    if any(map((_OF_STRONG if inside else _OF_ANY).search, names)):
        return NEVER
    return DOUBTFUL if inside and any(map(_OF_ANY.search, names)) else around


def text_lines(page: str | None) -> list[tuple[str, int]]:
    """The blocks of a page in order, each a trimmed line and what markup says of it."""
    lines: list[tuple[str, int]] = []
    if not page:
        return lines
    piece: list[str] = []
    stack: list[tuple[str, int]] = []  # open block elements and the kind inside them
    kind, at, end = FREE, 0, len(page)

    def flush() -> None:
        if piece:
            line = _SPACE.sub(" ", html.unescape("".join(piece))).strip()
            if line:
                lines.append((line, kind))
            piece.clear()

    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            piece.append(page[at:])
            break
        if m.start() > at:
            piece.append(page[at : m.start()])
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:  # a closing tag
            if tag in _INLINE:
                continue
            flush()
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag), None)
            if depth is not None:
                kind = stack[depth - 1][1] if depth else FREE
                del stack[depth:]
            continue
        if tag in _RAW:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else end
            if tag not in ("svg", "math"):
                flush()
            continue
        if tag in _INLINE:
            if tag in ("br", "wbr", "img"):
                piece.append(" " if tag == "br" else "")
            continue
        flush()
        if tag in _VOID:
            continue
        if tag in _CLOSES_P and stack and stack[-1][0] == "p":
            stack.pop()
            kind = stack[-1][1] if stack else FREE
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == tag:
            stack.pop()
            kind = stack[-1][1] if stack else FREE
        kind = _kind(tag, m[3] or "", kind)
        stack.append((tag, kind))
    flush()
    return lines


def _lengths(a: list[int], b: list[int]) -> Iterator[int]:
    """For each start of ``a`` a row of bits: the zeros below bit j count the longest common subsequence with ``b[:j]``."""
    places: dict[int, int] = {}
    for j, h in enumerate(b):
        places[h] = places.get(h, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for h in a:
        hit = row & places.get(h, 0)
        row = ((row + hit) | (row - hit)) & full
        yield row


def _zeros(row: int, n: int) -> np.ndarray:
    """Zero bits of ``row`` below 0, 1, up to n."""
    bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
    return np.concatenate(([0], np.cumsum(bits == 0)))


def _on_common(a: list[int], b: list[int]) -> list[bool]:
    if not a or not b:
        return [False] * len(a)
    if len(a) > 1 and len(a) * len(b) > _BITS_HELD:  # the halves of a meet at the best place of b
        half = len(a) // 2
        for before in _lengths(a[:half], b):
            pass
        for behind in _lengths(a[half:][::-1], b[::-1]):
            pass
        cut = int(np.argmax(_zeros(before, len(b)) + _zeros(behind, len(b))[::-1]))
        return _on_common(a[:half], b[:cut]) + _on_common(a[half:], b[cut:])
    rows, on, j = list(_lengths(a, b)), [False] * len(a), len(b)
    for i in range(len(a) - 1, -1, -1):
        above = rows[i - 1] if i else (1 << len(b)) - 1
        while j and rows[i] >> (j - 1) & 1:  # the last line of b adds nothing
            j -= 1
        if j and above >> (j - 1) & 1 and a[i] == b[j - 1]:
            on[i] = True
            j -= 1
    return on


def common_lines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of ``a`` lie on a longest common subsequence with ``b``.

    Lines of one page only are set aside first. Rows of the length table are bit vectors
    (a carry adds a whole row at once), so long pages cost ``len(a) * len(b) / 64`` steps;
    pages whose table would not fit are halved, so memory stays in proportion to the lines.
    """
    on, inside = np.zeros(len(a), bool), np.flatnonzero(np.isin(a, b))
    on[inside] = _on_common(a[inside].tolist(), b[np.isin(b, a)].tolist())
    return on


def main_text(lines: list[tuple[str, int]], shared: np.ndarray) -> str:
    """Kept lines, joined by an empty line.

    With an article in the page its lines are the text, less doubtful ones that are
    shared with the neighbour. Without one the free lines are, less those shared; if that
    leaves none (two equal pages) sharing says nothing and all free lines stay.
    """
    judged = [(line, kind, hit) for (line, kind), hit in zip(lines, shared.tolist(), strict=True)]
    main = [line for line, kind, hit in judged if kind == MAIN or (kind == DOUBTFUL and not hit)]
    if not any(kind in (MAIN, DOUBTFUL) for _, kind, _ in judged):
        free = [(line, hit) for line, kind, hit in judged if kind == FREE]
        main = [line for line, hit in free if not hit] or [line for line, _ in free]
    return "\n\n".join(main)


def differenced_text(lines: list[tuple[str, int]], shared: np.ndarray) -> str:
    """What differencing keeps by itself, whatever the markup says."""
    return "\n\n".join(line for (line, _), hit in zip(lines, shared.tolist(), strict=True) if not hit)


_PARSED = "page_id string, url string, row long, host string, path string, lines array<string>, kinds array<int>, hashes array<long>"


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines = [text_lines(page) for page in batch["html"]]
        yield batch.drop(columns="html").assign(
            lines=[[x for x, _ in own] for own in lines], kinds=[[k for _, k in own] for own in lines],
            hashes=[[xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in own] for own in lines],
        )


def _differenced(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shared lines of each page, given out where they change its text."""
    for batch in batches:
        rows, flags = [], []
        for row, kinds, hashes, other in zip(batch["row"], batch["kinds"], batch["hashes"], batch["other"], strict=True):
            if MAIN in kinds and DOUBTFUL not in kinds:
                continue
            shared = common_lines(np.asarray(hashes, np.int64), np.asarray(other, np.int64))
            if shared.any():
                rows.append(row)
                flags.append(shared.tolist())
        yield pd.DataFrame({"row": pd.Series(rows, dtype="int64"), "shared": pd.Series(flags, dtype=object)})


def _written(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for lines, kinds, shared in zip(batch["lines"], batch["kinds"], batch["shared"], strict=True):
            hit = np.zeros(len(lines), bool) if shared is None else np.asarray(shared, bool)
            out.append(main_text(list(zip(lines, kinds, strict=True)), hit))
        yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out})


def _neighbours(keys: DataFrame) -> DataFrame:
    """``row, near``: of the pages before and after it by host and path, the nearer one.

    The nearer shares the longer start of the path; of equals the one before. Keys are
    range-sorted, each task pairs the rows of its range, and ranges meet through their
    first and last rows, so no task holds a host.
    """
    spark = keys.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = keys.repartitionByRange(n, "host", "path", "row").sortWithinPartitions("host", "path", "row")
    columns = ["row", "host", "path", "near", "first", "last"]

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before = held = None
        for batch in batches:
            out = []
            for item in zip(batch["row"].tolist(), batch["host"], batch["path"], strict=True):
                if held is not None:
                    out.append((*held, _nearest(held, before, item), before is None, False))
                before, held = held, item
            yield pd.DataFrame(out, columns=columns).astype({"near": "Int64"})
        if held is not None:
            yield pd.DataFrame([(*held, _nearest(held, before, None), before is None, True)], columns=columns).astype({"near": "Int64"})

    paired = stage(
        ranged.mapInPandas(pair, "row long, host string, path string, near long, first boolean, last boolean"), "html-neighbours"
    )
    ends = paired.where("first OR last").orderBy("host", "path", "row").collect()  # at most two a task
    inner = {r.row: r for r in paired.join(F.broadcast(_rows(spark, [e.near for e in ends])), "row").select("row", "host", "path").collect()}
    item = lambda r: None if r is None else (r.row, r.host, r.path)
    fixed = []
    for i, e in enumerate(ends):
        before = item(ends[i - 1] if e.first and i else None if e.first else inner.get(e.near))
        after = item(ends[i + 1] if e.last and i + 1 < len(ends) else None if e.last else inner.get(e.near))
        fixed.append((e.row, _nearest(item(e), before, after)))
    return paired.join(F.broadcast(spark.createDataFrame(fixed, "row long, fixed long")), "row", "left").select(
        "row", F.when(F.col("first") | F.col("last"), F.col("fixed")).otherwise(F.col("near")).alias("near")
    )


def _rows(spark: SparkSession, rows: list[int | None]) -> DataFrame:
    return spark.createDataFrame([(r,) for r in rows if r is not None], "row long")


def _common(a: str, b: str) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def _nearest(own: tuple, before: tuple | None, after: tuple | None) -> int | None:
    options = [(_common(own[2], x[2]), x[0]) for x in (before, after) if x is not None and x[1] == own[1]]
    return max(options, key=lambda x: x[0])[1] if options else None


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row a page: ``page_id, url, text``.

    Character references are decoded, white space inside a block is one space, blocks
    are joined by an empty line in page order. Null and empty pages give an empty
    text. Pages without a host (null URLs) are neighbours of each other; a host's only
    page has none and markup alone decides. Repeated rows are pages of their own.
    """
    rows = pages.select(
        F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), F.monotonically_increasing_id().alias("row"),
        host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"), F.col(html_col).alias("html"),
    )
    parsed = stage(rows.mapInPandas(_parsed, _PARSED), "html-parsed")
    near = stage(_neighbours(parsed.select("row", "host", "path")), "html-near")
    # Only hashes travel; the lines stay where they were written.
    slim = parsed.select("row", "kinds", "hashes")
    others = parsed.select(F.col("row").alias("near"), F.col("hashes").alias("other"))
    pairs = slim.join(near.where("near IS NOT NULL"), "row").join(others, "near").select("row", "kinds", "hashes", "other")
    shared = stage_side(pairs.mapInPandas(_differenced, "row long, shared array<boolean>"), "html-shared")
    both = parsed.select("row", "page_id", "url", "lines", "kinds").join(shared, "row", "left").drop("row")
    kind = pages.select(id_col).schema[0].dataType
    return both.mapInPandas(_written, "page_id string, url string, text string").withColumn("page_id", F.col("page_id").cast(kind))
