"""Main text of web pages by template deduction from equivalence classes.

Each element of a page gives two tokens, its start and its end, told apart by the path of elements
above. On a page, a path is valid when both tokens occur once (of articles, equally often), so that valid paths nest as the elements do;
one odd page takes nothing from the others. What lies between the tokens are slots. Equal paths of a host's
pages form a class; names (an id, a word of a class) that only one page of the host has are left out of the
path first. Classes are ranked by sums over all pages of the host, and each page gives the text in the best
ranked of its own valid paths, without the parts that pages put around an article: elements that HTML has for them,
and boxes whose whole name says so.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe.llm.scratch import written

#: Between the elements of a path, and between the names of an element; both count as white space, so no name has them.
STEP, NAME = "\x1f", "\x1e"
#: Fixed values from the HTML standard.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "title", "xmp"}
BLOCK = set(
    "address article aside blockquote body dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr "
    "html li main nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
CLOSES |= {t: {"p"} for t in BLOCK if t not in CLOSES and t not in ("html", "body")}
SCOPE = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "blockquote", "td", "th", "aside", "nav", "form", "figure"}
AROUND = {"nav", "header", "footer", "aside", "form", "head", "button", "select", "dialog", "menu"}
AROUND_NAMES = set(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer header masthead "
    "menu modal nav navbar navigation newsletter notice pagination popup promo promoted related share sharing sidebar social sponsor sponsored subscribe widget".split()
)
#: Elements whose names can put them around an article. Headings, paragraphs, cells and words of an article cannot.
BOXES = {"div", "section", "ul", "ol", "dl", "span", "figure", "details", "center"}
#: Words that a name may have beside one of AROUND_NAMES: comment-list and ad-box are around, social-history and post-header are not.
BESIDE = set("area bar block box bottom button buttons container form inner item items left link links list outer panel right section site slot top unit wrap wrapper".split())
MAIN = {"article": 3, "main": 2}
MAIN_NAMES = {"article", "articlebody", "content", "entry", "main", "maincontent", "post", "story"}
_MARK = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAMED = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[^a-z]+")


class Page:
    """One pass over a page: counts of element paths, and text runs with the elements around them."""

    def __init__(self, html: str) -> None:
        self.opened: dict[str, int] = defaultdict(int)
        self.closed: dict[str, int] = defaultdict(int)
        self.level: dict[str, int] = {}
        # runs: text, open elements as (path, around) from the outside in, number of the block, inside a link
        self.runs: list[tuple[str, tuple, int, bool]] = []
        self.block = 0
        stack: list[tuple[str, str, bool, bool]] = []
        at, end = 0, len(html)
        while at < end:
            m = _MARK.search(html, at)
            self._text(html[at : m.start() if m else end], stack)
            if not m:
                break
            at, tag = m.end(), (m[2] or "").lower()
            if not tag:
                continue
            if m[1]:
                self._close(tag, stack)
                continue
            if tag in BLOCK:
                self.block += 1
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in CLOSES.get(tag, ()):
                    self._pop(i, stack)
                    break
                if stack[i][0] in SCOPE:
                    break
            if tag in RAW:
                stop = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(html, at)
                at = stop.end() if stop else end
                continue
            if tag == "br":
                self._text(" ", stack)
            if tag in VOID or m[3].rstrip().endswith("/"):
                continue
            self._open(tag, m[3], stack)
        self._pop(0, stack)

    def _open(self, tag: str, attributes: str, stack: list) -> None:
        names, sign, box = set(), tag, False
        for kind, a, b, c in _NAMED.findall(attributes):
            value = (a or b or c).lower()
            for name in value.split():
                parts = {x for x in _PART.split(name) if x}
                names |= parts
                box = box or bool(parts & AROUND_NAMES) and parts <= AROUND_NAMES | BESIDE
            if kind.lower() in ("class", "id"):
                sign += "".join(f"{NAME}.{x}" for x in value.split()) if kind.lower() == "class" else f"{NAME}#{'_'.join(value.split())}"
        path = f"{stack[-1][1]}{STEP}{sign}" if stack else sign
        inside = any(s[0] in MAIN for s in stack)
        around = tag in AROUND and not (tag == "header" and inside) or tag in BOXES and box
        self.opened[path] += 1
        self.level[path] = MAIN.get(tag, 2 if "main" in names and "role" in attributes else 1 if names & MAIN_NAMES else 0)
        stack.append((tag, path, around or bool(stack and stack[-1][2]), tag == "a" or bool(stack and stack[-1][3])))

    def _close(self, tag: str, stack: list) -> None:
        if tag in BLOCK:
            self.block += 1
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == tag:
                self.closed[stack[i][1]] += 1
                self._pop(i, stack)
                return

    def _pop(self, i: int, stack: list) -> None:
        if any(s[0] in BLOCK for s in stack[i:]):
            self.block += 1
        del stack[i:]

    def _text(self, text: str, stack: list) -> None:
        if text:
            self.runs.append((unescape(text), tuple((s[1], s[2]) for s in stack), self.block, bool(stack and stack[-1][3])))

    def mass(self) -> dict[str, tuple[int, int]]:
        """Characters, and those in links, inside each element path, without what is around articles."""
        out: dict[str, list[int]] = defaultdict(lambda: [0, 0])
        for text, path, _, link in self.runs:
            if path and path[-1][1]:
                continue
            n = len("".join(text.split()))
            for p in {p for p, _ in path}:
                out[p][0] += n
                out[p][1] += n if link else 0
        return {k: (a, b) for k, (a, b) in out.items()}

    def valid(self) -> dict[str, tuple[int, int]]:
        """Level and characters, less two for each in links, of the paths with text whose start and end occur once; articles may be several."""
        whole = lambda p: self.opened[p] == self.closed.get(p) and (self.opened[p] == 1 or self.level[p] == MAIN["article"])
        return {p: (self.level[p], a - 2 * b) for p, (a, b) in self.mass().items() if a and whole(p)}

    def text(self, slot: str | None) -> str:
        """The blocks in the slot, or in all slots of that path; without one, in the whole page."""
        blocks: dict[int, list[str]] = {}
        for text, path, block, _ in self.runs:
            if path and path[-1][1] or slot is not None and all(p != slot for p, _ in path):
                continue
            blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(x).split()) for x in blocks.values())
        return "\n".join(x for x in joined if x)


def host(url: str = "url"):
    return F.lower(F.coalesce(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


PATH_SQL = "key long, host string, path string, level int, score long"


def classes(rows: DataFrame) -> DataFrame:
    """``host, path, level, class``: paths without the names that only one page of the host has.

    A path stays whole where another of its page would get the same class.
    """
    by_path = written(rows.groupBy("host", "path", "level").agg(F.min("key").alias("first"), F.max("key").alias("last")), "paths")
    own = F.split(F.substring_index("path", STEP, -1), NAME)
    names = by_path.select("host", "first", "last", own[0].alias("tag"), F.explode(F.slice(own, 2, 1 << 30)).alias("name"))
    once = names.groupBy("host", "tag", "name").agg(F.min("first").alias("a"), F.max("last").alias("b")).where("a = b")
    once = once.select(F.col("host").alias("h"), F.col("tag").alias("t"), F.col("name").alias("n"), F.lit(True).alias("once"))
    steps = by_path.select("*", F.posexplode(F.split("path", STEP)).alias("i", "step")).select("*", F.split("step", NAME)[0].alias("tag"), F.posexplode(F.split("step", NAME)).alias("j", "name"))
    steps = steps.join(once, (F.col("host") == F.col("h")) & (F.col("tag") == F.col("t")) & (F.col("name") == F.col("n")) & (F.col("j") > 0), "left")
    part = F.when(F.col("j") == 0, F.concat(F.lit(STEP), "name")).when(F.col("once").isNull(), F.concat(F.lit(NAME), "name"))
    kept = steps.groupBy("host", "path", "level", "first").agg(F.array_sort(F.collect_list(F.struct("i", "j", part.alias("part")))).alias("parts"))
    kept = kept.select("host", "path", "level", "first", F.substring(F.array_join(F.col("parts")["part"], ""), 2, 1 << 30).alias("short"))
    alike = F.count("*").over(Window.partitionBy("host", "short", "level", "first"))
    return kept.withColumn("alike", alike).select("host", "path", "level", F.when(F.col("alike") > 1, F.col("path")).otherwise(F.col("short")).alias("class"))


def deduce(pages: DataFrame) -> DataFrame:
    """``key, slot``: the path of the slot that holds a page's main text, for pages that have a valid path.

    Works on sums over all pages; no host is gathered. A host with one page has the template of that page.
    """

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (key, h, path, *v) for key, h, html in zip(batch["key"].to_pylist(), batch["host"].to_pylist(), batch["html"].to_pylist(), strict=True)
                for path, v in Page(html).valid().items()
            ]
            kinds = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], ["key", "host", "path", "level", "score"])

    rows = written(pages.mapInArrow(valid, PATH_SQL), "valid")
    sums = rows.groupBy("host", "path", "level").agg(F.sum("score").alias("score"))
    of = written(classes(rows).join(sums, ["host", "path", "level"]), "classes")
    ranks = of.join(of.groupBy("host", "class", "level").agg(F.sum("score").alias("rank")), ["host", "class", "level"]).select("host", "path", "level", "class", "rank")
    best = F.struct(-F.col("level"), -F.col("rank"), -F.size(F.split("path", STEP)), "class", -F.col("score"), "path")
    return rows.join(ranks, ["host", "path", "level"]).groupBy("key").agg(F.min_by("path", best).alias("slot"))


def main_text(pages: DataFrame) -> DataFrame:
    """One row per input row: ``page_id, url, text``.

    Null or empty html gives an empty text. A null or odd url belongs to the host without a name.
    Repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", host().alias("host"), F.coalesce(F.col("html"), F.lit("")).alias("html"),
        F.xxhash64("page_id", "url", "html").alias("key"),
    )
    slots = deduce(rows.select("host", "html", "key")).withColumnRenamed("key", "of")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [Page(h).text(s) for h, s in zip(batch["html"].to_pylist(), batch["slot"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string())], ["page_id", "url", "text"])

    joined = rows.join(slots, F.col("key") == F.col("of"), "left").select("page_id", "url", "html", "slot")
    return joined.mapInArrow(extract, "page_id long, url string, text string")


def page_table(pages: DataFrame) -> DataFrame:
    """The rows that the page query returns."""
    return main_text(pages).withColumn("n_chars", F.length("text").cast("long"))
