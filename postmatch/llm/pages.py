"""The main text of web pages, without what their sites repeat.

Every block element is hashed by its source. Spark counts the hashes per host, and an
element that recurs on many pages of its host is template: it is deleted with all that
it holds. What a site varies from page to page (adverts, forms, reader comments) is
told by its element or class. If a page marks its article, text blocks inside it are
the article's own and stay however often they recur. What is left beside the article goes
too if the article holds at least half of all that is left; a lone teaser does not.
"""

from __future__ import annotations

import functools
import html as references
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postmatch.llm.common import map_batches, staged

#: An element is template from so many pages of a host, and this share of them.
LEAST_PAGES = 5
LEAST_SHARE = 0.01

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is not markup.
RAW = frozenset("script style textarea title noscript iframe xmp template svg math".split())
#: Block elements: text on both sides of their tags is not in one block.
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section select summary table tbody td "
    "tfoot th thead tr ul".split())
#: Elements of text, which an article keeps.
TEXT = frozenset(
    "p h1 h2 h3 h4 h5 h6 li ul ol dl dt dd blockquote pre table thead tbody tfoot tr td th "
    "caption figure figcaption".split())
NEVER = frozenset("html body article main head".split())
DROPPED = frozenset(
    "head title script style noscript template iframe object embed applet svg math canvas audio "
    "video map nav footer aside form button select option textarea dialog menu".split())
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo "
    "promotion sidebar menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies "
    "consent gdpr notice notices newsletter subscribe subscription popup modal overlay comment "
    "comments disqus respond reply replies share sharing social related recommended login signup "
    "widget masthead pagination pager toolbar topbar skip".split())
ARTICLE_NOISE = frozenset("comment comments reply replies ad ads advert sponsored promo related teaser".split())
ROLES = frozenset("navigation banner complementary contentinfo search dialog alert alertdialog form menu menubar".split())
#: What a start tag closes when it stands open.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
    "tbody": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "thead", "tbody"}, {"table"}),
    "body": ({"head"}, set()),
}

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/<>]*)([^<>]*)>"
    r"|<[!?/][^<>]*(?:>|\Z)", re.S)
#: Elements nested deeper are not counted as template of their own, since each level
#: reads its source once more; they go with an outer one, and by kind or class as any.
DEPTH = 256
ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


@functools.lru_cache(maxsize=20_000)
def noise(tag: str, attributes: str) -> bool:
    """Whether the element's own kind, class, id or role says that it is not the text."""
    if tag in DROPPED:
        return True
    if not attributes or tag in ("html", "body", "main"):
        return False
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return True
    if found.get("role", "").lower() in ROLES and tag != "article":
        return True
    known = ARTICLE_NOISE if tag == "article" else NOISE
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", name)
        if not known.isdisjoint(parts) and parts[0] not in ("no", "has", "with", "without"):
            return True
    return False


class Page:
    """A page as elements in order of their start, and texts with block limits."""

    def __init__(self, source: str):
        self.tag, self.up, self.begin, self.end, self.noisy = ["#"], [0], [0], [len(source)], [False]
        self.items: list[tuple[int, str] | None] = []
        self.source = source
        self.level, self.standing = [0], Counter()
        self._read(source)

    def _open(self, stack: list[int], tag: str, attributes: str, at: int) -> None:
        self.tag.append(tag)
        self.up.append(stack[-1])
        self.begin.append(at)
        self.end.append(len(self.source))
        self.noisy.append(noise(tag, attributes))
        self.level.append(len(stack))
        self.standing[tag] += 1
        stack.append(len(self.tag) - 1)

    def _close(self, stack: list[int], names, until, at: int) -> bool:
        """Ends the elements down to the innermost of these names, if it stands open."""
        if not any(self.standing[name] for name in names):
            return False
        for k in range(len(stack) - 1, 0, -1):
            tag = self.tag[stack[k]]
            if tag in names:
                for node in stack[k:]:
                    self.end[node] = at
                    self.standing[self.tag[node]] -= 1
                del stack[k:]
                return True
            if tag in until:
                return False
        return False

    def _read(self, source: str) -> None:
        stack, items, at = [0], self.items, 0
        token = TOKEN.search(source)
        while token:
            start, end = token.span()
            if start > at:
                items.append((stack[-1], source[at:start]))
            tag = (token[2] or token[5] or "").lower()
            at = end
            if tag and (token[1] or token[4]):
                if tag in BLOCK:
                    items.append(None)
                elif tag == "br":
                    items.append((stack[-1], " "))
                # A tag that ends inline text does not end the block around it.
                self._close(stack, (tag,), () if tag in BLOCK else BLOCK, end)
            elif tag:
                attributes = token[3] if token[2] else token[6]
                if tag in BLOCK:
                    items.append(None)
                    self._close(stack, ("p",), ("button", "object", "td", "th", "caption"), start)
                if tag in CLOSES:
                    names, until = CLOSES[tag]
                    while self._close(stack, names, until, start):
                        pass
                if tag == "br":
                    items.append((stack[-1], " "))
                elif tag in RAW:
                    self._open(stack, tag, attributes, start)
                    shut = re.compile(rf"</{re.escape(tag)}\s*[^>]*>", re.I).search(source, end)
                    at = shut.end() if shut else len(source)
                    self.end[stack.pop()] = at
                    self.standing[tag] -= 1
                elif tag not in VOID and not attributes.endswith("/"):
                    self._open(stack, tag, attributes, start)
            token = TOKEN.search(source, at)
        if at < len(source):
            items.append((stack[-1], source[at:]))

    def _article(self) -> list[bool]:
        """Which nodes lie in the marked article: article elements, else main ones."""
        for names in (("article",), ("main",)):
            inside = [False] * len(self.tag)
            quiet = [False] * len(self.tag)
            for k in range(1, len(self.tag)):
                quiet[k] = quiet[self.up[k]] or self.noisy[k]
                inside[k] = inside[self.up[k]] or (self.tag[k] in names and not quiet[k])
            if any(inside):
                return inside
        return [False] * len(self.tag)

    def blocks(self) -> Iterator[tuple[int, int]]:
        """The elements that can be template, with the hashes of their source."""
        inside = self._article()
        for k in range(1, len(self.tag)):
            if self.tag[k] not in BLOCK or self.tag[k] in NEVER or self.up[k] and self.tag[k] == "li":
                continue
            if self.level[k] >= DEPTH:
                continue
            if inside[k] and self.tag[k] in TEXT:
                continue
            piece = " ".join(self.source[self.begin[k]:self.end[k]].split())
            yield k, xxhash.xxh64_intdigest(piece.encode("utf-8", "replace")) - (1 << 63)

    def text(self, template: set[int]) -> str:
        inside = self._article()
        gone = [False] * len(self.tag)
        repeated = {k for k, h in self.blocks() if h in template} if template else ()
        for k in range(1, len(self.tag)):
            page_header = self.tag[k] == "header" and not inside[k]
            gone[k] = gone[self.up[k]] or self.noisy[k] or page_header or k in repeated
        left = [x for x in self.items if x is not None and not gone[x[0]]]
        size = {own: sum(len("".join(t.split())) for k, t in left if inside[k] == own) for own in (True, False)}
        marked = any(inside) and size[True] >= size[False]
        out, part = [], []
        for item in [*self.items, None]:
            if item is None:
                block = " ".join(references.unescape("".join(part)).split()) if part else ""
                if block:
                    out.append(block)
                part = []
            elif not gone[item[0]] and (inside[item[0]] or not marked):
                part.append(item[1])
        return "\n".join(out)


HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)"


def _keyed(pages: DataFrame) -> DataFrame:
    """The needed columns; equal pages of one address share a key."""
    url, source = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    return pages.select(
        "page_id", "url", "html", F.unhex(F.md5(F.concat(url, F.lit("\n"), source))).alias("key"),
        F.lower(F.regexp_extract(url, HOST, 1)).alias("host"))


def template(rows: DataFrame, least_pages: int = LEAST_PAGES, least_share: float = LEAST_SHARE) -> DataFrame:
    """``key, template``: of each page the hashes that recur on its host."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes = [sorted({h for _, h in Page(x or "").blocks()}) for x in batch.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("host"), pa.array(hashes, pa.list_(pa.int64()))],
            ["key", "host", "hashes"])

    seen = staged(map_batches(rows.select("key", "host", "html"), work,
                              "key binary, host string, hashes array<bigint>"), "elements")
    each = seen.select("key", "host", F.explode("hashes").alias("h"))
    sizes = seen.groupBy("host").agg(F.count("*").alias("pages"))
    recurring = (
        each.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
        .join(sizes, "host").where(F.col("n") >= F.col("pages") * least_share).select("host", "h"))
    return each.join(recurring, ["host", "h"]).groupBy("key").agg(F.collect_set("h").alias("template"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page.

    A null page or one without text has an empty text. A null address is a host of its
    own name, the empty one. Null ids are carried along; equal rows give equal rows and
    count as pages of their own; an empty table gives an empty one.
    """
    rows = _keyed(pages)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [Page(x or "").text(set(t or ())) for x, t in zip(
            batch.column("html").to_pylist(), batch.column("template").to_pylist())]
        return pa.RecordBatch.from_arrays(
            [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    found = rows.join(template(rows), "key", "left").select("page_id", "url", "html", "template")
    return map_batches(found, work, "page_id bigint, url string, text string, n_chars bigint")
