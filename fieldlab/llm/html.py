"""HTML extraction with a suffix array per host.

A page is cut into blocks. Blocks inside `article` or `main` are its main text; scripts, forms, menus, headers, footers, sidebars,
notices, adverts and reader comments are not. The tokens of all blocks outside the main region form the page's stream. The suffixes of
a host's streams are grouped by their first `depth` tokens, which is where a suffix array sorted to that depth has its runs: a run with
two distinct pages or more is a long substring that repeats. Runs are found by the minimum and maximum of their pages; what 500 pages have
of a run is one row, so a host with a third of all pages is no single task. Pages are parsed once and their packed blocks shuffled once, by
page, for the runs and the result alike; of the suffixes, only hashes and places are shuffled, once. Blocks outside the main region stay only if they are ordinary text and no repeated
run covers a token of theirs (or, in a page without a main region, not more than half of their tokens).

Runs are told apart by 128 bits of hash. Null and empty html: empty text. `<![` in any form is a comment; an unfinished tag at the end of
a page is no text. Pages with the same id, address and html count as one page. A page without address has the host "".
"""

from __future__ import annotations

import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from fieldlab.llm.common import per_row

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li"
    " main nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
CHROME = frozenset("aside button dialog footer form head iframe menu nav noscript object script select style svg template textarea title".split())
MAIN = frozenset(("article", "main"))
CHROME_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|banner|breadcrumbs?|comments?|consent|cookies?|disqus|footer|header|masthead|menu|modal|nav\w*|newsletter|notices?|popup|promo\w*"
    r"|related|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget)(?:$|[\s_-])",
    re.IGNORECASE,
)
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"
INSIDE, CHROMED, OUTSIDE = 0, 1, 2


class _Blocks(HTMLParser):
    """(region, text) of every block that has text, in page order."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, bool]] = []  # tag, chrome, main
        self.found: list[tuple[int, str]] = []
        self.text: list[str] = []

    def _cut(self):
        words = " ".join("".join(self.text).split())
        self.text = []
        if words:
            chrome, main = self.open[-1][1:] if self.open else (False, False)
            self.found.append((CHROMED if chrome else INSIDE if main else OUTSIDE, words))

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS or tag in CHROME:
            self._cut()
        if tag in VOID:
            if tag == "br":
                self.text.append(" ")
            return
        if tag in ("p", "li", "td", "th", "tr", "dt", "dd") and self.open and self.open[-1][0] == tag:
            self.open.pop()
        elif tag == "p":  # an open paragraph ends, with the inline marks that were left open in it
            for i in range(len(self.open) - 1, -1, -1):
                if self.open[i][0] == "p":
                    del self.open[i:]
                    break
                if self.open[i][0] in BLOCKS:
                    break
        chrome, main = self.open[-1][1:] if self.open else (False, False)
        given = dict(attrs)
        named = f"{given.get('class') or ''} {given.get('id') or ''} {given.get('role') or ''}"
        main = main or tag in MAIN or given.get("role") == "main"
        hides = tag in CHROME or (tag == "header" and not main) or (tag not in ("html", "body", *MAIN) and bool(CHROME_NAMES.search(named)))
        self.open.append((tag, chrome or hides, main))

    def handle_startendtag(self, tag, attrs):
        if tag in BLOCKS:
            self._cut()
        elif tag == "br":
            self.text.append(" ")

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                if tag in BLOCKS or tag in CHROME:
                    self._cut()
                del self.open[i:]
                return

    def handle_data(self, data):
        self.text.append(data)

    def parse_marked_section(self, i, report=1):
        """`<![...` in any form is a bogus comment, up to the next >."""
        end = self.rawdata.find(">", i + 3)
        return -1 if end < 0 else end + 1


def _closed(html: str) -> str:
    """The page without a tag, comment or declaration at its end that no > ends."""
    last = html.rfind(">") + 1
    open_tag = re.compile("<[A-Za-z/!?]").search(html, last)
    return html[: open_tag.start()] if open_tag else html


def blocks_of(html: str | None) -> list[tuple[int, str]]:
    parser = _Blocks()
    parser.feed(_closed(html or ""))
    parser.close()
    parser._cut()
    return parser.found


def packed(blocks: list[tuple[int, str]]) -> bytes:
    """The regions, a digit each, and the texts, which have no line ends, by lines."""
    return zlib.compress("\n".join(("".join(str(r) for r, _ in blocks), *(t for _, t in blocks))).encode(), 1)


def unpacked(found: bytes) -> list[tuple[int, str]]:
    regions, *texts = zlib.decompress(found).decode().split("\n")
    return list(zip(map(int, regions), texts))


def _stream(blocks: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """(block, token) of everything outside the main region."""
    return [(i, token) for i, (region, text) in enumerate(blocks) if region != INSIDE for token in text.split()]


def _parsed(pages: DataFrame) -> DataFrame:
    def work(frame: pd.DataFrame) -> pd.DataFrame:
        return frame.assign(blocks=[packed(blocks_of(h)) for h in frame["html"]]).drop(columns="html")

    rows = pages.select("page_id", "url", "html").withColumns({
        "host": F.lower(F.coalesce(F.regexp_extract("url", HOST, 1), F.lit(""))),
        "page": F.xxhash64("page_id", "url", "html"),
    })
    return per_row(rows, "page_id long, url string, host string, page long, blocks binary", rows.columns, work)


def repeated_places(parsed: DataFrame, depth: int) -> DataFrame:
    """(page, starts): token numbers where a run begins that another page of the host has too."""

    def suffixes(frame: pd.DataFrame) -> pd.DataFrame:
        heads, pages, starts = [], [], []
        for host, page, blocks in zip(frame["host"], frame["page"], frame["blocks"]):
            tokens = [t for _, t in _stream(unpacked(blocks))]
            n = max(0, len(tokens) - depth + 1)
            heads += [xxh3_128_digest(" ".join((host, *tokens[i : i + depth]))) for i in range(n)]
            pages.append(np.full(n, page, np.int64))
            starts.append(np.arange(n, dtype=np.int32))
        low, high = np.frombuffer(b"".join(heads), np.int64).reshape(-1, 2).T
        page, start = np.concatenate(pages), np.concatenate(starts)
        order = np.lexsort((start, page, high, low))
        low, high, page, start = low[order], high[order], page[order], start[order]
        begin = np.flatnonzero(np.append(True, (low[1:] != low[:-1]) | (high[1:] != high[:-1]))[: len(low)])
        end = np.append(begin[1:], len(low))[: len(begin)]
        out = pd.DataFrame({"low": low[begin], "high": high[begin], "page": page[begin], "start": start[begin], "last": page[end - 1]})
        for name, x in (("pages", page), ("starts", start)):
            out[name] = pd.Series([x[a + 1 : b] if b - a > 1 else None for a, b in zip(begin, end)], dtype=object)
        return out

    # The columns of the result are taken along unread, so that both read one shuffle of the blocks. Pages of a host stand together, as they share runs.
    schema = "low long, high long, page long, start int, last long, pages array<long>, starts array<int>"
    found = per_row(parsed.sortWithinPartitions("host"), schema, ["host", "page", "blocks"], suffixes, unread=["page_id", "url"])
    run = Window.partitionBy("low", "high")
    runs = found.withColumns({"least": F.min("page").over(run), "most": F.max("last").over(run)}).where("least != most")
    rest = F.transform(F.arrays_zip("pages", "starts"), lambda x: F.struct(x["pages"].alias("page"), x["starts"].alias("start")))
    places = F.concat(F.array(F.struct("page", "start")), F.coalesce(rest, F.array().cast("array<struct<page:bigint,start:int>>")))
    return runs.select(F.explode(places).alias("place")).select("place.*").groupBy("page").agg(F.collect_set("start").alias("starts"))


def extract(pages: DataFrame, depth: int = 6) -> DataFrame:
    """page_id, url, text, n_chars, n_boiler (repeated tokens): one row per row of pages(page_id, url, html)."""
    parsed = _parsed(pages).repartition("page")
    joined = parsed.join(repeated_places(parsed, depth), "page", "left")

    def work(frame: pd.DataFrame) -> pd.DataFrame:
        texts_out, boiler = [], []
        for found, starts in zip(frame["blocks"], frame["starts"]):
            blocks = unpacked(found)
            starts = [] if starts is None else sorted(starts)
            stream, covered, size = _stream(blocks), {}, {}
            reach = 0
            total = 0
            for start in starts:
                for at in range(max(start, reach), start + depth):
                    covered[stream[at][0]] = covered.get(stream[at][0], 0) + 1
                    total += 1
                reach = start + depth
            for block, _ in stream:
                size[block] = size.get(block, 0) + 1
            allowed = 0.0 if any(r == INSIDE for r, _ in blocks) else 0.5
            kept = [t for i, (r, t) in enumerate(blocks) if r == INSIDE or (r == OUTSIDE and covered.get(i, 0) <= allowed * size[i])]
            texts_out.append("\n".join(kept))
            boiler.append(total)
        out = pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": texts_out, "n_chars": [len(t) for t in texts_out], "n_boiler": boiler})
        return out

    schema = "page_id long, url string, text string, n_chars long, n_boiler long"
    return per_row(joined, schema, ["page_id", "url", "blocks", "starts"], work, unread=["host", "page"])
