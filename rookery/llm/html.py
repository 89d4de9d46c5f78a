"""HTML extraction by consensus host paths.

Each page is parsed twice. First every container of a page is scored by its text without links, and the page votes for
the generalised path (tags with classes, numbers left out) of its best one. Spark counts the votes of each
host. Then each page is parsed again and the elements on its host's winning path give its text; a page without
such an element uses its own best container. Menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments are left out wherever they stand. A class or id counts as one of these only if a part of it says nothing else and no part names
the article: share-links does, share-price and post recommended do not. An element whose name just holds such a word goes if it is mostly
links or holds less than a quarter of the page's text (in an article, and for elements of running text, it stays).

Null html is an empty page with empty text, an empty table an empty result. Pages of any length and depth are read whole;
other columns, whatever their names, do not matter. Pages without a host in their url vote together. Rows of a repeated page_id are pages of their own.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import stored, table

#: Winning paths are broadcast up to so many characters in all; beyond, pages are joined by shuffle.
BROADCAST_CHARS = 32_000_000
# Elements without content, elements that end a block, and those that hold no article text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
DROPPED = frozenset("aside audio button canvas dialog embed fieldset footer form head iframe input label map menu nav noscript object option script select style svg template textarea title video".split())
CONTAINER = frozenset("article body center div main section td html".split())
CLOSES_P = BLOCK - {"br", "html", "body", "head"}
RAW = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in ("script", "style", "title", "textarea", "iframe", "noscript", "svg", "template")}
# Words of class and id attributes that mark what is not the article.
BOILERPLATE = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs"
    " footer header masthead cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe subscription signup comment comments"
    " commentlist respond disqus replies share sharing social related recommended recommendations widget widgets pagination pager toolbar login search skip".split()
)
# Words that only say what kind of box an element is.
BOX = frozenset("area bar block box btn button buttons container content group icon icons inner item items link links list module outer panel post posts row section site top bottom wrap wrapper".split())
# Words that name the article or the box it is in.
CONTENT = frozenset("article body content entry main page post story text".split())
#: Of the page's text and of its own, how much text without links an element of a doubtful name needs to stay.
SHARE, PLAIN = 0.25, 0.5
# Elements of running text, whose class names speak of the text more often than of the page.
TEXT = frozenset("a b blockquote code em figure h1 h2 h3 h4 h5 h6 i li p pre span strong td th tr".split())
_TOKEN = re.compile(
    r"<(?:(?P<note>!--.*?(?:-->|\Z)|!\[CDATA\[.*?(?:\]\]>|\Z)|[!?][^>]*(?:>|\Z))"
    r"|(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z))",
    re.S,
)
_NAME = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


class Page:
    """Elements in document order, and blocks of text with the innermost element they end in."""

    def __init__(self, html: str):
        self.tags: list[str] = ["#"]
        self.names: list[str] = [""]  # generalised class part of the path
        self.parent: list[int] = [0]
        self.last: list[int] = [0]  # the last element inside
        self.blocks: list[tuple[int, str, int]] = []
        self.box: list[int] = [0]  # the innermost container an element is or is in
        self.key: list[int] = [hash("")]  # of the path
        self._open: Counter = Counter()
        self._stack, self._out, self._dropped, self._anchors = [0], [], 0, 0
        self._length = 0
        self._doubts: list[int] = []
        self._parse(html)
        if self._doubts:
            self._settle()

    def _text(self, raw: str) -> None:
        if raw and not self._dropped:
            text = unescape(raw)
            self._out.append(text)
            if self._anchors:
                self._length += len(text.strip())

    def _flush(self) -> None:
        if self._out:
            text = " ".join("".join(self._out).split())
            if text:
                self.blocks.append((self._stack[-1], text, min(len(text), self._length)))
            self._out, self._length = [], 0

    def _pop(self) -> None:
        at = self._stack.pop()
        self.last[at] = len(self.tags) - 1
        self._open[self.tags[at]] -= 1
        self._dropped -= self._marks.pop()
        self._anchors -= self.tags[at] == "a"

    def _boilerplate(self, tag: str, rest: str) -> tuple[bool, str]:
        """Whether an element goes, and the class part of its path. A name says so if one of its parts says nothing else and no part names the article; a name that just holds such a word is a doubt, settled by ``_settle``."""
        words, tokens, classes, hidden = set(), [], "", False
        for m in _NAME.finditer(rest) if rest else ():
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                hidden = True
                continue
            found = _WORD.findall(_CAMEL.sub(" ", value).lower())
            words.update(found)
            tokens += [set(_WORD.findall(_CAMEL.sub(" ", t).lower())) for t in value.split()]
            if key == "class":
                classes = "." + ".".join(sorted(set(found))) if found else ""
        if tag in ("html", "body", "article", "main"):
            return False, classes
        if tag == "header":  # an article's own header holds its title
            return not (self._open["article"] or self._open["main"]), classes
        if tag in DROPPED or hidden:
            return True, classes
        says = any(t & BOILERPLATE and t <= BOILERPLATE | BOX for t in tokens)  # nothing else, such as share-links but not share-price
        if tag in TEXT or self._open["article"] or self._open["main"]:
            return says, classes
        if says and not any(t & CONTENT and t <= CONTENT | BOX for t in tokens):
            return True, classes
        if not BOILERPLATE.isdisjoint(words) and not self._dropped:
            self._doubts.append(len(self.tags))
        return False, classes

    def _settle(self) -> None:
        """Takes out the text of doubtful elements that are mostly links or hold little of the page's text; those inside are settled first and no longer count."""
        plain, linked = np.zeros(len(self.tags) + 1), np.zeros(len(self.tags) + 1)
        for at, text, links in self.blocks:
            plain[at + 1] += len(text) - links
            linked[at + 1] += links
        plain, linked = plain.cumsum(), linked.cumsum()
        gone: list[tuple[int, float, float]] = []  # from the page's end to its start: element, text and links that went with it
        for i in reversed(self._doubts):
            own, links = (float(c[self.last[i] + 1] - c[i]) for c in (plain, linked))
            inside = 0
            while inside < len(gone) and gone[-1 - inside][0] <= self.last[i]:
                own, links, inside = own - gone[-1 - inside][1], links - gone[-1 - inside][2], inside + 1
            if own < PLAIN * (own + links) or own < SHARE * plain[-1]:
                whole = (float(c[self.last[i] + 1] - c[i]) for c in (plain, linked))
                gone[len(gone) - inside :] = [(i, *whole)]
        starts = [g[0] for g in reversed(gone)]
        if starts:
            self.blocks = [b for b in self.blocks if not ((k := bisect_right(starts, b[0])) and b[0] <= self.last[starts[k - 1]])]

    def _parse(self, html: str) -> None:
        self._marks = [0]
        at, stop = 0, len(html)
        while at < stop:
            m = _TOKEN.search(html, at)
            if m is None:
                self._text(html[at:])
                break
            self._text(html[at : m.start()])
            at = m.end()
            if m["note"] is not None:
                if m["note"].startswith("![CDATA["):
                    self._text(m["note"][8:].removesuffix("]]>").replace("&", "&amp;"))
                continue
            tag = m["tag"].lower()
            if m["end"]:
                if tag in BLOCK:
                    self._flush()
                if tag in VOID:
                    continue
                for depth in range(len(self._stack) - 1, 0, -1) if self._open[tag] else ():
                    if self.tags[self._stack[depth]] == tag:
                        if tag not in BLOCK and any(self.tags[i] in CONTAINER for i in self._stack[depth + 1 :]):
                            break  # an inline end tag does not close containers
                        while len(self._stack) > depth:
                            self._pop()
                        break
                continue
            if tag in BLOCK:
                self._flush()
            if tag in VOID:
                continue
            if tag in CLOSES_P and (self._open["p"] or tag == "li" and self._open["li"]):
                for depth in range(len(self._stack) - 1, 0, -1):
                    open_tag = self.tags[self._stack[depth]]
                    if open_tag in CONTAINER or open_tag in ("ul", "ol", "table", "blockquote", "nav", "aside", "form", "header", "footer") and tag != "li":
                        break
                    if open_tag == "p" or open_tag == tag == "li":
                        while len(self._stack) > depth:
                            self._pop()
                        break
                    if tag == "li" and open_tag in ("ul", "ol"):
                        break
            dropped, classes = self._boilerplate(tag, m["rest"])
            if tag in RAW:
                end = RAW[tag].search(html, at)
                at = end.start() if end else stop
            above, at_new = self._stack[-1], len(self.tags)
            self.tags.append(tag), self.names.append(classes), self.parent.append(above), self.last.append(0)
            self.box.append(at_new if tag in CONTAINER else self.box[above])
            self.key.append(hash((self.key[above], tag + classes)))
            self._open[tag] += 1
            self._stack.append(at_new)
            self._marks.append(int(dropped))
            self._dropped += dropped
            self._anchors += tag == "a"
        self._flush()
        while self._stack:
            self._pop() if len(self._stack) > 1 else self._stack.pop()
        self.last[0] = len(self.tags) - 1

    def path(self, at: int) -> str:
        parts = []
        while at:
            parts.append(self.tags[at] + self.names[at])
            at = self.parent[at]
        return "/".join(reversed(parts))

    def scores(self) -> dict[int, float]:
        """Each container's text without links: its own blocks count whole, those of the containers in it half."""
        found: dict[int, float] = {}
        for at, text, linked in self.blocks:
            worth, own = len(text) - 2.0 * linked, self.box[at]
            found[own] = found.get(own, 0.0) + worth
            if own:
                above = self.box[self.parent[own]]
                found[above] = found.get(above, 0.0) + worth / 2
        return {i: s * (1.5 if self.tags[i] in ("article", "main") else 1.0) for i, s in found.items()}

    def best(self) -> tuple[int, float] | None:
        scores = self.scores()
        return max(scores.items(), key=lambda x: (x[1], -x[0])) if scores else None

    def text(self, path: str | None) -> str:
        """The text of the elements on the path, or, if there are none, of those on the best container's."""
        kept = self._inside(self._on(path)) if path else []
        if not kept and (best := self.best()):
            kept = self._inside(self._on(self.path(best[0])) or [best[0]])
        return "\n".join(kept)

    def _on(self, path: str) -> list[int]:
        key = self.key[0]
        for part in path.split("/") if path else ():
            key = hash((key, part))
        return [i for i in range(1, len(self.tags)) if self.key[i] == key]

    def _inside(self, found: list[int]) -> list[str]:
        """Texts of the blocks in elements that stand in document order; inner ones lie in outer ones' ranges."""
        starts, stops = [], []
        for i in found:
            if not stops or i > stops[-1]:
                starts.append(i), stops.append(self.last[i])
        return [text for at, text, _ in self.blocks if (k := bisect_right(starts, at)) and at <= stops[k - 1]]


def votes(pages: DataFrame) -> DataFrame:
    """host, path and score of every page that has a best container."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
                page = Page(html or "")
                if best := page.best():
                    out.append((host, page.path(best[0]), best[1]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.string(), pa.string(), pa.float64()))], ["host", "path", "score"])

    return pages.select("host", "html").mapInArrow(run, "host string, path string, score double")


def host_paths(pages: DataFrame) -> DataFrame:
    """Each host's path of most votes; ties go to the greater mean score, then to the smaller path."""
    counted = votes(pages).groupBy("host", "path").agg(F.count("*").alias("n"), F.avg("score").alias("score"))
    return counted.groupBy("host").agg(F.max_by("path", F.struct("n", "score", "path")).alias("path"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of ``pages``."""
    rows = pages.select("page_id", "url", "html").withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)))
    paths = stored(host_paths(rows), "html-paths")
    chars = paths.agg(F.sum(F.length("path") + F.length("host"))).first()[0] or 0
    paths = F.broadcast(paths) if chars <= BROADCAST_CHARS else paths
    joined = rows.join(paths, "host", "left").select("page_id", "url", "html", "path")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [Page(html or "").text(path) for html, path in zip(batch.column("html").to_pylist(), batch.column("path").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, url string, text string, n_chars bigint")


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    return extract(table(spark, sf_dir, "pages"))
