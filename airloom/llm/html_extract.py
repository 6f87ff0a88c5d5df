"""Operator 7, main text of web pages by consensus host paths.

Method: each page is read into containers and text blocks (tolerating open and stray tags); its containers are
scored by their text less link text, outside of parts marked as menus, adverts, comments and the like. The path of
the best container, as tags with classes and ids from which digits are taken out, is the page's vote. Votes are
summed per host in Spark, and every page of a host is extracted again from the containers on the winning path;
a page that hasn't it is extracted from its own best container.

Plan: two passes over the pages with a sum per (host, path) between them, combined before the shuffle. The winners,
one row per host, are sent to every task up to ``MAX_SENT`` hosts, counted first; beyond that they are joined.

Classes, ids and roles mark menus, adverts and the like; on a page where they leave no text, those that hold half of it
count for nothing.

Defined results: null or empty html, and pages without a text block, give an empty text; a null or odd url counts as
the host ''; pages are voters as often as they are repeated; ties go to the path with more text, then to the first
by name; an empty table gives no rows. Other columns are ignored. Nothing is capped.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common as C

MAX_SENT = 1_000_000
#: A container's best part replaces it if it has this share of its score.
DESCEND = 0.9
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_MARKS = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
# Element names by what they do to text.
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math object select xmp noembed noframes audio video canvas".split())
_CONTAINERS = frozenset("html body article main section div td th center blockquote figure details".split())
_BLOCKS = _CONTAINERS | frozenset("p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd pre table tbody thead tfoot tr caption figcaption summary address hr nav header footer aside form fieldset menu dialog search head".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_LEFT_OUT = frozenset("nav footer aside form fieldset menu dialog search button label head".split())
_SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_FENCE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}}
#: Words of classes, ids and roles that mark what isn't the article.
_ASIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments complementary consent contentinfo cookie cookies "
    "dialog discussion disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice notices notification outbrain pager pagination "
    "paywall popup promo promotion recommended related replies reply respond search share sharing sidebar signup social sponsor sponsored "
    "subscribe subscription taboola tags toolbar widget widgets topbar".split()
)
_NOT = frozenset("no has with without is".split())


def _marked(tag: str, attrs: str) -> tuple[bool, str]:
    """Whether an element is marked as not the article's, and its generalised name."""
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, tag
    aside, names = False, [tag]
    for key, a, b, c in _MARKS.findall(attrs):
        key, value = key.lower(), a or b or c
        if key == "hidden":
            aside = aside or "aria-hidden" not in attrs.lower()
        elif key == "aria-hidden":
            aside |= value.lower() == "true"
        elif key == "style":
            aside |= "display:none" in value.replace(" ", "").lower()
        else:
            for name in value.split():
                words = [w.lower() for w in _WORDS.findall(name)]
                if words and words[0] not in _NOT:
                    aside |= any(w in _ASIDE for w in words) or "header" in words and key != "id" and tag not in _HEADINGS
                if key != "role":
                    names.append(("#" if key == "id" else ".") + re.sub(r"\d+", "", name))
    return aside, "".join(names)


class Page:
    """``parents``, ``tags``, ``paths`` of the containers and ``blocks`` (container, text, link characters)."""

    def __init__(self, html: str, host_marks: bool = True):
        self.parents, self.tags, self.paths, self.blocks = [-1], [""], [""], []
        self._text, self._links, self._marked = [], 0, [False]
        self._heed = host_marks
        self._read(html)
        if not host_marks:
            self._weigh_marks()

    @classmethod
    def read(cls, html: str) -> Page:
        """The page; one whose marks leave nothing is read again, without those around most of its text."""
        page = cls(html)
        return page if page.blocks or not html else cls(html, False)

    def _weigh_marks(self) -> None:
        """Leaves out the blocks in marked containers, but for those that hold half of the page's text."""
        total = self.scores()
        out = [False] * len(total)
        for k, parent in enumerate(self.parents):
            out[k] = parent >= 0 and out[parent] or self._marked[k] and total[k] < total[0] / 2
        self.blocks = [b for b in self.blocks if not out[b[0]]]

    def _close_block(self, container: int) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            if text:
                self.blocks.append((container, text, self._links))
            self._text, self._links = [], 0

    def _read(self, html: str) -> None:
        # Open elements: tag, container, how deep in left-out parts, how deep in links, how deep in articles.
        stack = [("", 0, 0, 0, 0)]
        at, size = 0, len(html)
        while at < size:
            hit = _TOKEN.search(html, at)
            end = hit.start() if hit else size
            _, container, out, link, _ = stack[-1]
            if end > at and not out:
                text = html[at:end]
                text = unescape(text) if "&" in text else text
                self._text.append(text)
                if link:
                    self._links += len(text.strip())
            if not hit:
                break
            at = hit.end()
            tag = (hit[2] or hit[5] or "").lower()
            if not tag:
                continue
            if hit[1] or hit[4]:
                self._end(stack, tag)
                continue
            if tag in _RAW:
                close = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(html, at)
                if not (hit[3] or hit[6] or "").rstrip().endswith("/"):
                    at = close.end() if close else size
                continue
            if tag in _BLOCKS:
                self._close_block(container)
                self._open(stack, tag, hit[3] or hit[6] or "")
            elif tag == "br" or tag == "img":
                if not out:
                    self._text.append(" ")
            elif tag not in _VOID:
                aside = tag in _LEFT_OUT or _marked(tag, hit[3] or hit[6] or "")[0]
                stack.append((tag, container, out + aside, link + (tag == "a"), stack[-1][4]))
        self._close_block(stack[-1][1])

    def _open(self, stack: list, tag: str, attrs: str) -> None:
        for k in range(len(stack) - 1, 0, -1):  # a block ends an open paragraph, an item the item before it
            name = stack[k][0]
            if name == "p" or name in _SAME.get(tag, ()):
                del stack[k:]
            elif name in _FENCE.get(tag, ()) or name in _CONTAINERS and name not in ("td", "th"):
                break
        _, container, out, link, inside = stack[-1]
        marked, name = _marked(tag, attrs)
        marked = marked and tag not in ("html", "body") and not (inside and tag == "header")
        aside = tag in _LEFT_OUT or tag == "header" and not inside or marked and (self._heed or tag not in _CONTAINERS)
        if tag in _VOID:
            return
        if tag in _CONTAINERS:
            self.parents.append(container)
            self.tags.append(tag)
            self._marked.append(marked)
            self.paths.append(f"{self.paths[container]}/{name}")
            container = len(self.parents) - 1
        stack.append((tag, container, out + aside, link, inside + (tag in ("article", "main"))))

    def _end(self, stack: list, tag: str) -> None:
        if tag in _BLOCKS:
            self._close_block(stack[-1][1])
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] == tag:
                del stack[k:]
                return
            if tag not in _BLOCKS and stack[k][0] in _CONTAINERS:
                return  # a stray inline end tag doesn't close a container

    def scores(self) -> list[float]:
        """Text less link text of each container with all within it."""
        total = [0.0] * len(self.parents)
        for container, text, links in self.blocks:
            total[container] += max(0.0, len(text) - 1.5 * links)
        for k in range(len(total) - 1, 0, -1):
            total[self.parents[k]] += total[k]
        return total

    def best(self) -> tuple[int, float]:
        """The container of the main text and its score."""
        total = self.scores()
        whole = total[0]
        if whole <= 0:
            return 0, 0.0
        for tag in ("article", "main"):
            found = max((k for k, t in enumerate(self.tags) if t == tag), key=lambda k: (total[k], -k), default=0)
            if found and total[found] >= 0.3 * whole:
                return found, total[found]
        here = 0
        while True:
            below = [k for k, p in enumerate(self.parents) if p == here]
            top = max(below, key=lambda k: (total[k], -k), default=0)
            if not top or total[top] < DESCEND * total[here]:
                return here, total[here]
            here = top

    def text(self, path: str | None) -> str:
        """The blocks within the containers on a path, or else within the best one."""
        roots = {k for k, p in enumerate(self.paths) if p == path} if path is not None else set()
        roots = roots or {self.best()[0]}
        inside = [False] * len(self.parents)
        for k, p in enumerate(self.parents):
            inside[k] = k in roots or p >= 0 and inside[p]
        return "\n\n".join(text for container, text, _ in self.blocks if inside[container])


def _host() -> Column:
    """The host of the url in lower case, or ''."""
    return F.lower(F.coalesce(F.expr("try_parse_url(url, 'HOST')"), F.lit("")))


def votes(pages: DataFrame) -> DataFrame:
    """host, path, score of each page's best container."""

    def run(batches):
        for batch in batches:
            got = []
            for host, html in zip(batch.column("host").to_pylist(), batch.column("html"), strict=True):
                page = Page.read(html.as_py() or "")
                k, score = page.best()
                if score > 0:
                    got.append((host, page.paths[k], score))
            host, path, score = zip(*got, strict=True) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(host, pa.string()), pa.array(path, pa.string()), pa.array(score, pa.float64())], names=["host", "path", "score"])

    return C.map_batches(pages.select(_host().alias("host"), "html"), run, "host string, path string, score double")


def host_paths(pages: DataFrame) -> DataFrame:
    """host and its winning path."""
    summed = votes(pages).groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("score").alias("score"))
    first = Window.partitionBy("host").orderBy(F.desc("n"), F.desc(F.round("score", 3)), "path")
    return summed.withColumn("at", F.row_number().over(first)).where("at = 1").select("host", "path")


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, path (the host's winning path): one row per row of ``pages``."""
    winners = C.written(host_paths(pages), "paths")
    hosts = pages.select("page_id", "url", "html", _host().alias("host"))
    few = winners.limit(MAX_SENT + 1).count() <= MAX_SENT
    rows = hosts.join(F.broadcast(winners) if few else winners, "host", "left").select("page_id", "url", "html", "path")

    def run(batches):
        for batch in batches:
            texts = [Page.read(h.as_py() or "").text(p) for h, p in zip(batch.column("html"), batch.column("path").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64()), batch.column("path")], names=["page_id", "url", "text", "n_chars", "path"])

    return C.map_batches(rows, run, "page_id bigint, url string, text string, n_chars bigint, path string")
