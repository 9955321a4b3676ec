"""Main text of web pages by their structure and by the difference to the nearest page.

1. A page's HTML becomes lines, one per block. Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and
   reader comments are left out where elements, roles or class names tell them.
2. Every page is put in order of host and path with the fingerprints of its lines (a range sort: a host with a third of all pages spans many
   tasks). Of the pages before and after it in its host, the one whose path shares more with it is its pair.
3. The lines of both are aligned by their longest common subsequence. Shared lines are template and go, except inside
   the article or main element, where a page has one: two versions of an article share its lines and keep them. Lines outside it
   that are not shared stay. A neighbour that has all lines of the page, or no others than the page has, is a copy and no pair.
4. The numbers of the lines that go meet the pages' texts by one join: texts are shuffled once, all sorting is done with fingerprints.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_rows, partitions_for, slices
from .urls import host_of, path_of

#: Pages (their fingerprints only) that one task sorts.
PART_ROWS = 100_000
_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.S)
# Element and class names of HTML and of common page templates.
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead title tr ul".split()
)
_RAW = frozenset("script style textarea title noscript iframe template noframes xmp".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OUT = frozenset("nav footer aside form svg math button select dialog menu head object canvas audio video search datalist".split())
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription"
    " sidebar menu menus nav navbar navigation breadcrumb breadcrumbs footer comment comments respond disqus share sharing social related widget widgets toolbar pagination pager skip login signup search".split()
)
_OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_NAME = re.compile(r"[^a-z0-9]+")


def _unwanted(name: str, attributes: str) -> str:
    """"out" for an element that is no main text, "header" for a header, else empty."""
    if name in _OUT:
        return "out"
    kind = "header" if name == "header" else ""
    if not attributes or name in ("html", "body", "article", "main") and "class" not in attributes:
        return kind
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values).lower()
        if key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none", value):
            return "out"
        if key == "role" and value in _OUT_ROLES:
            return "out"
        if key in ("class", "id") and name not in ("html", "body", "main"):
            names = _NAME.split(value)
            if not _OUT_NAMES.isdisjoint(names):
                return "out"
            if names == ["header"] or "masthead" in names:
                kind = "header"
    return kind


def page_lines(page: str) -> tuple[list[str], list[bool]]:
    """The blocks of a page that may be main text, in order, and which of them stand in an article (or main) element."""
    lines: list[tuple[str, int]] = []
    text: list[str] = []
    stack: list[tuple[str, str]] = []  # open elements and what kept them out
    inside = {"article": 0, "main": 0}
    out = header = heading = 0
    at = 0

    def flush() -> None:
        line = " ".join(html.unescape("".join(text)).split())
        text.clear()
        if line:
            lines.append((line, 2 * bool(inside["article"]) + bool(inside["main"])))

    def close(index: int) -> None:
        nonlocal out, header, heading
        for name, kind in reversed(stack[index:]):
            out -= kind == "out"
            header -= kind == "header"
            heading -= name in _HEADINGS
            if name in inside:
                inside[name] -= 1
        del stack[index:]

    def said(piece: str) -> None:
        if not out and (not header or heading and (inside["article"] or inside["main"])):
            text.append(piece)

    while at < len(page):
        m = _TAG.search(page, at)
        if not m:
            said(page[at:])
            break
        if m.start() > at:
            said(page[at : m.start()])
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in _BLOCKS:
            flush()
        elif name == "br":
            said(" ")
        if m[1]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    close(i)
                    break
            continue
        if name in _RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in _VOID or m[3].endswith("/"):
            continue
        kind = _unwanted(name, m[3])
        if name in ("article", "main", "body") and kind != "out" and out and not any(n in ("article", "main") for n, _ in stack):
            close(next(i for i, (_, k) in enumerate(stack) if k == "out"))  # something left open before it ends here
        if name in _BLOCKS and stack and stack[-1][0] == "p" or name in ("li", "dt", "dd", "tr", "td", "th", "option") and stack and stack[-1][0] == name:
            close(len(stack) - 1)
        stack.append((name, kind))
        out += kind == "out"
        header += kind == "header"
        heading += name in _HEADINGS
        if name in inside:
            inside[name] += 1
    flush()
    level = 2 if any(k & 2 for _, k in lines) else 1
    return [x for x, _ in lines], [bool(k & level) for _, k in lines]


def shared_lines(a: list, b: list) -> set[int]:
    """The places in ``a`` of a longest common subsequence of both (Hunt and Szymanski, 1977)."""
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    found = {*range(head), *range(len(a) - tail, len(a))}
    places: dict[object, list[int]] = {}
    for j in range(len(b) - tail - 1, head - 1, -1):
        places.setdefault(b[j], []).append(j)
    ends: list[int] = []
    links: list[tuple | None] = []
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
        found.add(link[0])
        link = link[1]
    return found


_ROW = ("host", "path", "url", "page_id", "k1", "k2")
_ROW_KINDS = "host string, path string, url string, page_id long, k1 long, k2 long"


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column html and others: the lines in one text."""
    for batch in slices(batches, 0):
        texts = ["\n".join(page_lines(x or "")[0]) for x in batch.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), *batch.columns[1:]], ["text", *batch.schema.names[1:]])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Column html and others: the lines' fingerprints, and which of them stand in the main element."""
    for batch in slices(batches, 0):
        lines, main = [], []
        for x in batch.column(0).to_pylist():
            found, inside = page_lines(x or "")
            lines.append([int.from_bytes(blake2b(t.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True) for t in found])
            main.append(inside)
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.list_(pa.int64())), pa.array(main, pa.list_(pa.bool_())), *batch.columns[1:]], ["lines", "main", *batch.schema.names[1:]])


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, at = TaskContext.get().partitionId(), 0
    for batch in batches:
        n = batch.num_rows
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int64)), pa.array(np.arange(at, at + n))], [*batch.schema.names, "part", "at"])
        at += n


def template_lines(page: dict, before: dict | None, after: dict | None) -> list[int]:
    """The places of a page's shared lines outside its main element, told by its pair among the pages (host, path, lines, main) before and after it."""
    near = [o for o in (before, after) if o and o["host"] and o["host"] == page["host"] and o["lines"]]
    near.sort(key=lambda o: -len(commonprefix([o["path"], page["path"]])))  # stable: of equally near ones the one before
    for o in near:
        shared = shared_lines(page["lines"], o["lines"])
        if len(shared) < min(len(page["lines"]), len(o["lines"])):
            return sorted(i for i in shared if not page["main"][i])
    return []


def _gone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        gone = [template_lines(r, r["before"], r["after"]) for r in batch.to_pylist()]
        some = pa.array([bool(x) for x in gone], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column("k1"), batch.column("k2"), pa.array(gone, pa.list_(pa.int32()))], ["k1", "k2", "gone"]).filter(some)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns page_id, url, text, gone: the text without these lines."""
    for batch in batches:
        texts = batch.column(2).to_pylist()
        for i in np.flatnonzero(np.asarray(batch.column(3).is_valid())).tolist():
            gone = set(batch.column(3)[i].as_py())
            texts[i] = "\n".join(x for k, x in enumerate(texts[i].split("\n")) if k not in gone)
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string())], ["page_id", "url", "text"])


def template(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """(k1, k2, gone) of the rows (html and ``_ROW``) that share lines with their pair: the places of the lines that go. Equal rows count once."""
    spark = rows.sparkSession
    prints = rows.mapInArrow(_prints, f"lines array<long>, main array<boolean>, {_ROW_KINDS}").dropDuplicates(["k1", "k2"])
    prints = scratch.write(prints, "prints")
    n = partitions_for(prints.count(), PART_ROWS, spark.sparkContext.defaultParallelism)
    schema = f"lines array<long>, main array<boolean>, {_ROW_KINDS}, part long, at long"
    placed = scratch.write(prints.repartitionByRange(n, *_ROW).sortWithinPartitions(*_ROW).mapInArrow(_number, schema), "sorted")
    scratch.drop("prints")
    # the last page of each range also stands before the first of the next one, and the other way round
    ends = placed.groupBy("part").agg(F.max("at").alias("last"))  # a row per range
    ends = ends.select("part", "last", F.lead("part").over(Window.orderBy("part")).alias("next"), F.lag("part").over(Window.orderBy("part")).alias("prior"))
    edge = placed.join(F.broadcast(ends), "part")
    ghosts = edge.where("at = last and next is not null").withColumn("part", F.col("next")).withColumn("at", F.lit(-1).cast("long"))
    ghosts = ghosts.unionByName(edge.where("at = 0 and prior is not null").withColumn("part", F.col("prior")).withColumn("at", F.lit(1 << 60)))
    both = placed.unionByName(ghosts.select(*placed.columns))
    beside = Window.partitionBy("part").orderBy("at")
    other = F.struct("host", "path", "lines")
    both = both.withColumn("before", F.lag(other).over(beside)).withColumn("after", F.lead(other).over(beside)).where(f"at >= 0 and at < {1 << 60}")
    with arrow_rows(spark, 200):
        gone = scratch.write(both.select("k1", "k2", "host", "path", "lines", "main", "before", "after").mapInArrow(_gone, "k1 long, k2 long, gone array<int>"), "gone")
    scratch.drop("sorted")
    return gone


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row: the main text (empty if none) and its code points.

    A null html is empty; very long pages are read whole. Pages with a null url, or one without a host, have no pair and keep all their lines. Of two
    equally near pages the one before (host, path, url, page_id) is the pair; if the nearer one is a copy, the other is. Rows that are equal in
    page_id, url and html have one result. Other columns, whatever their names, are ignored. An empty table gives an empty result.
    """
    rows = pages.select("html", F.col("page_id").cast("long").alias("page_id"), "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.withColumns({"k1": F.xxhash64("page_id", "url", "html"), "k2": F.xxhash64(F.lit(1), "html", "url", "page_id")})
    gone = template(rows.select("html", *_ROW), Scratch(pages.sparkSession, "pages"))
    texts = rows.select("html", "page_id", "url", "k1", "k2").mapInArrow(_texts, "text string, page_id long, url string, k1 long, k2 long")
    joined = texts.join(gone.hint("shuffle_hash"), ["k1", "k2"], "left").select("page_id", "url", "text", "gone")
    return joined.mapInArrow(_cut, "page_id long, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
