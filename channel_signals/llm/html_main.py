"""Main text of web pages: blocks of the markup, less the lines shared with the nearest page."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from channel_signals.llm.common import with_neighbours
from channel_signals.llm.url_filter import host_of, path_of
from channel_signals.session import materialize

SILENT = frozenset("script style noscript template head title svg math iframe object select textarea button".split())
CHROME = frozenset("nav header footer aside form menu dialog".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
MAIN = frozenset(("article", "main"))
#: Words of class, id or role that mark a container as no part of the article.
CHROME_WORDS = frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer "
    "header menu modal nav navbar navigation newsletter notice pagination popup promo promoted related reply replies "
    "share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary contentinfo".split())
#: Beginnings of such words.
CHROME_STEMS = ("advert", "breadcrumb", "comment", "cookie", "newsletter", "promo", "sidebar", "sponsor", "subscri", "adbox", "adsense", "adslot")
#: Inside an article these name its own parts.
OWN_WORDS = frozenset(("header", "banner", "widget"))
#: Names of containers that hold the article where no element says so.
MAIN_NAMES = frozenset("article article-body article-content content entry-content main main-content post-body post-content".split())
_WORD = re.compile(r"[a-z]+")
_WHITE = re.compile(r"\s+")
#: Closing one of these is implied by the start of a block, or of an item of the same list.
_IMPLIED = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Text; 2 inside an article or main element, 1 inside a container named so, else 0; in furniture; open tags.
Block = tuple[str, int, bool, str]


class _Blocks(HTMLParser):
    """Text of the blocks in page order, each with its place (`Block`)."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.blocks: list[Block] = []
        self.open: list[tuple[str, bool, bool, int]] = []
        self.text: list[str] = []
        self.silent = self.chrome = 0
        self.main = [0, 0, 0]

    def cut(self) -> None:
        line = _WHITE.sub(" ", "".join(self.text)).strip()
        self.text = []
        if line:
            self.blocks.append((line, self.level(), self.chrome > 0, ">".join(o[0] for o in self.open)))

    def level(self) -> int:
        return 2 if self.main[2] else 1 if self.main[1] else 0

    def close_top(self) -> None:
        _, chrome, silent, main = self.open.pop()
        self.chrome -= chrome
        self.silent -= silent
        self.main[main] -= 1

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.silent and tag not in SILENT and tag not in ("body",):
            if tag not in VOID:
                self.open.append((tag, False, False, 0))
                self.main[0] += 1
            return
        if tag == "body":
            while self.silent:
                self.close_top()
        if tag in BLOCKS:
            self.cut()
            while self.open and self.open[-1][0] in ("p", "b", "i", "em", "strong", "a", "span", "h1", "h2", "h3", "h4", "h5", "h6") and any(
                    t == "p" for t, *_ in self.open[-8:]) and tag != "span":
                self.close_top()
        for other in _IMPLIED.get(tag, ()):
            if self.open and self.open[-1][0] == other:
                self.close_top()
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            return
        named = " ".join(v or "" for k, v in attrs if k in ("class", "id", "role")).lower()
        furniture = tag in CHROME and not (tag == "header" and self.level())
        main = 2 if tag in MAIN else 0
        if named and tag not in ("body", "html", "article", "main"):
            main = 0 if MAIN_NAMES.isdisjoint(named.split()) else 1
            words = set(_WORD.findall(named))
            words -= OWN_WORDS if self.level() else set()
            furniture |= not main and (not CHROME_WORDS.isdisjoint(words) or any(w.startswith(CHROME_STEMS) for w in words))
        self.open.append((tag, furniture, tag in SILENT, main))
        self.chrome += furniture
        self.silent += tag in SILENT
        self.main[main] += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self.cut()
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k][0] == tag:
                while len(self.open) > k:
                    self.close_top()
                break

    def handle_data(self, data: str) -> None:
        if not self.silent:
            self.text.append(data)


def blocks_of(html: str) -> list[Block]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.cut()
    return parser.blocks


#: What the markup says of a line: in page furniture, outside the article that it names, main text.
FURNITURE, OUTSIDE, MAIN_TEXT = range(3)


def lines_of(html: str) -> tuple[list[tuple[str, str, int]], bool]:
    """(text, open tags, what the markup says) of every line, and whether it names the article.

    With an article or main element its own lines are main text, else those of a container
    named so, else all lines outside furniture.
    """
    blocks = blocks_of(html)
    best = max((level for _, level, chrome, _ in blocks if not chrome), default=0)
    return [(line, tags, FURNITURE if chrome else MAIN_TEXT if level == best else OUTSIDE)
            for line, level, chrome, tags in blocks], best > 0


def candidates_of(html: str) -> tuple[list[str], bool]:
    """The lines that are main text by the markup, and whether it names the article itself."""
    lines, named = lines_of(html)
    return [line for line, _, kind in lines if kind == MAIN_TEXT], named


def deleted(mine: list, kinds: list[int], named: bool, other: list, other_kinds: list[int]) -> tuple[list[int], int]:
    """Lines of a page that go because the nearest page has them too, and how many it shares.

    Lines are the same when text and open tags are; shared ones lie on a longest common
    subsequence. Lines of an article that the markup names are not deleted, and neither is the
    main text of pages one of which holds all of the other's: near copies share what they say.
    """
    found = common_lines(mine, other)
    own = [i for i, k in enumerate(kinds) if k == MAIN_TEXT]
    guarded = named or found.issuperset(own)
    if not guarded:
        theirs = [x for x, k in zip(other, other_kinds) if k == MAIN_TEXT]
        guarded = len(common_lines(theirs, [mine[i] for i in own])) == len(theirs)
    return sorted(i for i in found if not guarded or kinds[i] != MAIN_TEXT), len(found)


def common_lines(a: list, b: list) -> set[int]:
    """Indices in `a` of a longest common subsequence with `b`.

    Matches are run through in the order of `a`, from the last in `b` to the first, and
    the longest rising chain of positions in `b` is kept.
    """
    where: dict = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []
    ends: list[tuple] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            link = (i, ends[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                ends.append(link)
            else:
                tails[k], ends[k] = j, link
    found, at = set(), ends[-1] if ends else None
    while at:
        found.add(at[0])
        at = at[1]
    return found


def line_marks(pages: DataFrame) -> DataFrame:
    """(page_id, host, path, named, marks, kinds): a digest of text and open tags of every line,
    and what the markup says of it; named: the markup names the article."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import blake2b

        for batch in batches:
            marks, kinds, named = [], [], []
            for value in batch.column(3):
                lines, own = lines_of(value.as_py() or "")
                named.append(own)
                kinds.append(bytes(k for _, _, k in lines))
                marks.append([int.from_bytes(blake2b(f"{tags} {x}".encode(errors="replace"), digest_size=8).digest(), "little", signed=True)
                              for x, tags, _ in lines])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), pa.array(named, pa.bool_()), pa.array(marks, pa.list_(pa.int64())),
                 pa.array(kinds, pa.binary())], names=["page_id", "host", "path", "named", "marks", "kinds"])

    url = F.col("url").cast("string")
    return pages.select(F.col("page_id").cast("long"), host_of(url).alias("host"), path_of(url).alias("path"), F.col("html").cast("string")).mapInArrow(
        run, "page_id long, host string, path string, named boolean, marks array<long>, kinds binary")


def shared_lines(marks: DataFrame) -> DataFrame:
    """(page_id, gone, shared): indices of the lines that go for the nearest page, and the number
    of lines that it shares.

    Pages of a host are ordered by path; the nearest is the neighbour with the longer common
    beginning of the path, the one before on a tie.
    """
    key = F.struct("host", "path", "page_id")
    beside = {f"{c}_": F.col(c) for c in ("host", "path", "marks", "kinds")}
    rows = with_neighbours(materialize(marks), key, beside)

    @F.arrow_udf("struct<gone:array<int>,shared:int>")
    def differ(host: pa.Array, path: pa.Array, named: pa.Array, marks: pa.Array, kinds: pa.Array, *beside: pa.Array) -> pa.Array:
        from os.path import commonprefix

        gone, shared = [], []
        for h, p, own, m, k, h0, p0, m0, k0, h1, p1, m1, k1 in zip(*(x.to_pylist() for x in (host, path, named, marks, kinds, *beside))):
            before, after = h0 == h, h1 == h
            if before and after:
                after = len(commonprefix([p, p1])) > len(commonprefix([p, p0]))
            cut, n = deleted(m, list(k), own, *((m1, list(k1)) if after else (m0, list(k0)))) if before or after else ([], 0)
            gone.append(cut)
            shared.append(n)
        return pa.StructArray.from_arrays([pa.array(gone, pa.list_(pa.int32())), pa.array(shared, pa.int32())], names=["gone", "shared"])

    names = ("host_", "path_", "marks_", "kinds_")
    return rows.select("page_id", differ(
        "host", "path", "named", "marks", "kinds", *[f"prev_{n}" for n in names], *[f"next_{n}" for n in names]).alias("d")).select(
        "page_id", "d.gone", "d.shared")


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, n_lines, n_shared), a row per row of `pages`.

    The lines of a page, text with its open tags, are compared with those of the nearest page of
    its host, and shared lines are deleted: menus, notices and whatever else a template repeats.
    The markup guards both ways. Lines of an article that it names stay, and with them the main
    text of near copies; lines of scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms and
    comments go even where no page shares them, and so do lines outside a named article.
    Null or empty html gives an empty text; a page alone on its host, or without one, is not
    compared, nor are pages without an id; rows that share an id lose the lines found for any of
    them, and n_shared (lines that lie on the comparison) is the largest. Other columns are not read.
    """
    found = shared_lines(line_marks(pages).where("page_id is not null and host <> ''"))
    found = found.where("shared > 0").groupBy("page_id").agg(
        F.array_distinct(F.flatten(F.collect_set("gone"))).alias("gone"), F.max("shared").alias("shared"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).join(found, "page_id", "left")

    @F.arrow_udf("struct<text:string,lines:int>")
    def text(html: pa.Array, gone: pa.Array) -> pa.Array:
        out, n = [], []
        for page, drop in zip(html, gone.to_pylist()):
            lines, _ = lines_of(page.as_py() or "")
            less = set(drop or ())
            out.append("\n".join(x for i, (x, _, kind) in enumerate(lines) if kind == MAIN_TEXT and i not in less))
            n.append(len(lines))
        return pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(n, pa.int32())], names=["text", "lines"])

    return rows.select("page_id", "url", text("html", "gone").alias("t"), "shared").select(
        "page_id", "url", "t.text", F.length("t.text").cast("long").alias("n_chars"), F.col("t.lines").alias("n_lines"),
        F.coalesce("shared", F.lit(0)).alias("n_shared"))
