"""Main text of web pages by wrapper induction.

Every distinct page of a host is parsed. A text belongs to a node path (labels are tag, class and id).
Of the pages that have a text at a path, if most have the same one there, it is template; the other
texts are slots, whose texts are content. Likewise, if most have the same number of texts there and
all of them are links, these are a frame (a menu, say), template whatever the links say. This is
counted over all pages of the host and over those of each layout (pages with texts at the same set
of paths), so that layouts that share a path do not hide each other's. Simple tree matching only
pairs nodes of the same path, so an equal text that it aligns is counted here too (a test compares
them), whatever the size of the trees; no page is left out. The wrapper of a host is the set of its
template texts and frames, each with its node's path.

Extraction parses every page whole and gives out its blocks (the text between block-level tags) in
page order, without those that the host's wrapper calls template and without those that lie in a
menu, header, footer, sidebar, notice, advert, form, script, style or reader comment by tag, role
or class. If the page marks an article (or main part), blocks outside it are left out, and its
headings, paragraphs, list items, quotes and table cells are content even if other pages have the
same text.

A path that fewer than three distinct pages have a text at has no template. Wrappers reach the pages
by a join on the host. Parsing takes time and memory linear in the page, however deep its markup.

Defined results: a null html is empty and gives the empty text; a null or odd url has no host and
no wrapper; a null page_id is kept; repeated rows each get their row and count once for wrappers;
broken markup (unclosed or cut tags, stray ends and quotes) is read as far as it goes; deep and very
long pages are read whole; an empty table gives an empty result. Only the three named columns are
read, so others may have any name.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearkin.runtime import cut, small

#: Possessive, so no part is read again; a quote that nothing closes is a letter.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+'|[\"'])*+)(>|\Z)|<[!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
BLANK = re.compile(r"[\s ]+")
RAW = frozenset("script style textarea title noscript iframe xmp noframes template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "html head body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "legend li main menu nav ol option p pre section select summary table tbody td tfoot th thead tr ul title".split()
)
TEXTUAL = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote pre td th dd dt figcaption".split())
#: What an opening tag closes if it is open: the tags, and those that the search does not pass.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "option": (frozenset(["option"]), frozenset(["select"])),
    "body": (frozenset(["head"]), frozenset()),
}
P = (frozenset(["p"]), frozenset("article aside blockquote body button div dd details figcaption figure footer form header li main nav section table td th".split()))
JUNK_TAGS = frozenset("head nav footer aside form button select textarea script style noscript iframe svg template menu dialog object canvas title".split())
JUNK_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promotion sponsor sponsored cookie cookies notice notices consent gdpr popup modal overlay alert "
    "newsletter subscribe signup sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments reply replies disqus respond share sharing social "
    "related recommended widget pagination pager skip toolbar search login".split()
)
JUNK_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar".split())
HEADER_WORDS = frozenset("header topbar".split())
SHARE = 0.6
LEAST_PAGES = 3
#: Most wrappers that may be broadcast.
BROADCAST_ROWS = 12_500


def words_of(value: str) -> list[str]:
    return re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower())


@lru_cache(4096)
def tag_info(tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
    """(label, junk, header, main) of an opening tag."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if attributes else {}
    names = set(words_of(f"{found.get('class', '')} {found.get('id', '')}"))
    role = found.get("role", "").lower()
    junk = tag in JUNK_TAGS or role in JUNK_ROLES or (tag not in ("html", "body", "article", "main") or bool(names & {"comment", "comments", "reply"})) and bool(names & JUNK_WORDS)
    header = tag == "header" or bool(names & HEADER_WORDS)
    main = not junk and (tag in ("article", "main") or role in ("main", "article"))
    return ".".join([tag, *sorted(names - {""})]), junk, header, main


def walk(html: str) -> Iterator[tuple[str, str, str]]:
    """(kind, tag, rest): kinds are open, close and text; implied ends are not filled in."""
    at, low = 0, None
    while m := TOKEN.search(html, at):
        if m.start() > at:
            yield "text", "", html[at : m.start()]
        at = m.end()
        if m[2]:
            tag = m[2].lower()
            if m[1]:
                yield "close", tag, ""
            elif m[4]:
                yield "open", tag, m[3]
                if tag in RAW:
                    low = html.lower() if low is None else low
                    end = low.find(f"</{tag}", at)
                    end = len(html) if end < 0 or len(low) != len(html) and (end := _raw_end(html, tag, at)) < 0 else end
                    yield "text", "", html[at:end]
                    at = end
    if at < len(html):
        yield "text", "", html[at:]


def _raw_end(html: str, tag: str, at: int) -> int:
    """As a search in the lowered text, for texts whose lower case has another length."""
    m = re.compile(rf"</{tag}", re.I).search(html, at)
    return m.start() if m else -1


@lru_cache(1 << 16)
def path_key(parent: int, label: str) -> int:
    """The key of a node path: a hash of its parent's key and its label, so deep paths cost no more."""
    return template_key(parent, label)


def template_key(path: int, text: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{path}\n{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def frame_key(path: int, links: int) -> int:
    """A path whose texts on a page are all links, so many of them; a text has no NUL at its start."""
    return template_key(path, f"\0links {links}")


class Block(NamedTuple):
    """A text with its node path, innermost block tag, whether it is junk, in the main part, and all link."""

    path: int
    tag: str
    text: str
    junk: bool
    main: bool
    link: bool


class Open(NamedTuple):
    """An open element, and its innermost block-level element (itself or one around it)."""

    tag: str
    path: int
    junk: bool
    main: bool
    link: bool
    block_tag: str
    block_path: int


class Page:
    """The blocks of a page."""

    def __init__(self, html: str) -> None:
        self.blocks: list[Block] = []
        self.has_main = False
        stack = [Open("#root", 0, False, False, False, "#root", 0)]
        # where in the stack the open elements of each tag are, so that no search walks the stack
        where: dict[str, list[int]] = {}
        held: list[str] = []
        plain = False

        def flush() -> None:
            nonlocal held, plain
            if held:
                text = BLANK.sub(" ", unescape("".join(held))).strip()
                if text:
                    top = stack[-1]
                    self.blocks.append(Block(top.block_path, top.block_tag, text, top.junk, top.main, not plain))
                held, plain = [], False

        def close_to(n: int) -> None:
            if any(e.tag in BLOCK for e in stack[n:]):
                flush()
            for e in stack[n:]:
                where[e.tag].pop()
            del stack[n:]

        def last(tags: frozenset[str]) -> int:
            return max((where[t][-1] for t in tags if where.get(t)), default=0)

        for kind, tag, rest in walk(html):
            top = stack[-1]
            if kind == "text":
                if top.tag not in RAW:
                    held.append(rest)
                    plain = plain or not top.link and not rest.isspace()
            elif kind == "close":
                if where.get(tag):
                    close_to(where[tag][-1])
                elif tag in BLOCK:
                    flush()
            else:
                if tag == "br":
                    held.append("\n")
                    continue
                if tag in BLOCK:
                    flush()
                    ends, stops = CLOSES.get(tag, P)
                    while (n := last(ends)) > last(stops):
                        close_to(n)
                        if tag not in ("tr", "td", "th"):
                            break
                if tag in VOID:
                    continue
                label, junk, header, main = tag_info(tag, rest.strip().rstrip("/"))
                top = stack[-1]
                main |= top.main
                junk |= top.junk or header and not top.main
                self.has_main |= main and not junk
                path = path_key(top.path, label)
                block = (tag, path) if tag in BLOCK else (top.block_tag, top.block_path)
                where.setdefault(tag, []).append(len(stack))
                stack.append(Open(tag, path, junk, main, top.link or tag == "a", *block))
        flush()

    def frames(self) -> dict[int, int]:
        """The paths whose texts are all links, with their frame's key."""
        links, plain = Counter(b.path for b in self.blocks if b.link), {b.path for b in self.blocks if not b.link}
        return {path: frame_key(path, n) for path, n in links.items() if path not in plain}


def places(html: str) -> tuple[int, list[tuple[int, int | None]]]:
    """The layout of a page, and its distinct (path, template key); each path also comes once with None."""
    page = Page(html)
    paths = {b.path for b in page.blocks}
    found = {(b.path, template_key(b.path, b.text)) for b in page.blocks} | set(page.frames().items())
    return template_key(0, "\n".join(map(str, sorted(paths)))), [*found, *((p, None) for p in paths)]


def extract(html: str | None, template: frozenset[int] = frozenset()) -> str:
    """The main text of a page."""
    page = Page(html or "")
    frames = page.frames() if template else {}
    out = []
    for b in page.blocks:
        if b.junk or page.has_main and not b.main:
            continue
        if template and not (b.main and b.tag in TEXTUAL) and (template_key(b.path, b.text) in template or frames.get(b.path) in template):
            continue
        out.append(b.text)
    return "\n".join(out)


def host_of(url: Column) -> Column:
    """The lower-case host of a url; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(host, template): the wrapper of each host that has template texts, from all its distinct pages."""
    rows = pages.select(host_of(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")).filter("host <> ''")
    rows = rows.select("host", F.unhex(F.sha2("html", 256)).alias("sha"), "html")
    kind = pa.list_(pa.struct([("path", pa.int64()), ("key", pa.int64())]))

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            read = [places(h) for h in batch.column(2).to_pylist()]
            found = pa.array([[{"path": p, "key": k} for p, k in f] for _, f in read], kind)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([layout for layout, _ in read], pa.int64()), found], names=["host", "sha", "layout", "found"])

    parsed = rows.mapInArrow(parse, "host string, sha binary, layout long, found array<struct<path: long, key: long>>")
    distinct = parsed.groupBy("host", "sha").agg(F.first("layout").alias("layout"), F.first("found").alias("found"))
    counts = distinct.select("host", "layout", F.inline("found")).groupBy("host", "layout", "path", "key").agg(F.count("*").alias("n"))
    # fewer than LEAST_PAGES pages decide nothing, neither in a layout nor in the host
    of_layout = F.when(F.col("n") >= LEAST_PAGES, F.struct(F.col("layout"), F.col("n")))
    both = counts.groupBy("host", "path", "key").agg(F.sum("n").alias("n"), F.collect_list(of_layout).alias("layouts")).filter(F.col("n") >= LEAST_PAGES)
    each = both.select("host", "path", "key", F.inline(F.expr("concat(array(struct(CAST(NULL AS LONG) AS layout, n)), layouts)")))
    there = F.max(F.when(F.col("key").isNull(), F.col("n"))).over(Window.partitionBy("host", "layout", "path"))
    same = each.withColumn("there", there).filter(F.col("key").isNotNull() & (F.col("n") - 1 >= SHARE * (F.col("there") - 1)))
    return cut(same.groupBy("host").agg(F.sort_array(F.collect_set("key")).alias("template")))


@lru_cache(1024)
def _template(keys: tuple[int, ...]) -> frozenset[int]:
    return frozenset(keys)


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    found = wrappers(rows, "url", "html")
    joined = rows.withColumn("host", host_of(F.col("url"))).join(small(found, BROADCAST_ROWS), "host", "left").select("page_id", "url", "html", "template")
    schema = rows.select("page_id", "url").withColumns({"text": F.lit("").cast("string"), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            templates = batch.column(3).to_pylist()
            texts = [extract(h, _template(tuple(t or ()))) for h, t in zip(batch.column(2).to_pylist(), templates, strict=True)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), sizes], names=schema.names)

    return joined.mapInArrow(run, schema)
