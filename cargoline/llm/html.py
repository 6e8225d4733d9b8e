"""Main text of web pages by site template removal: subtrees that recur on many pages of a host are deleted, and what is left of the article is the text.

A page is read into blocks of text and into elements, each of which covers a run of blocks. An element's subtree hash is made of its tag, its
text and its children's hashes; attributes don't count, since links carry page numbers. Spark counts, per host, the different pages that
have a subtree, and deletes it from all pages where ``LEAST_PAGES`` have it. Two kinds of subtrees are never deleted by their count: an article or main
element itself, and the prose in it (headings, paragraphs, quotations, tables, …), since copies of an article and quoted passages recur
as well. A host with few pages shows no template; there, and for chrome that differs from page to page, elements are deleted by what their tag, role,
class or id says (menus, headers, footers, sidebars, notices, adverts, forms, comments). If an article or main element still has text, that is the main text, else all that is left is.

The parser reads every page in one pass, in time linear in its length, closes what the page leaves open and never recurses, so that neither depth
nor length of a page matters. Only subtree hashes and the blocks that are left are shuffled; a subtree on very many pages of a host is the key of a
count and of a salted join. Equal pages of a host are one page, so copies of a page make no template.

Defined cases: a null or empty page, and one without text, gives an empty text; a null or malformed url belongs to a host of its own, the empty
one; repeated rows, null ids and further columns stay as they are (a column named like a new one is replaced); an empty table gives no rows.
"""

from __future__ import annotations

import html as markup
import re
from collections import Counter
from typing import NamedTuple

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from cargoline.llm.batches import add_columns, chunks
from cargoline.operators.joins import hottest, join_hot
from cargoline.session import materialize

#: Different pages of a host that make a subtree part of the site's template.
LEAST_PAGES = 5

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6
    head header hgroup hr html legend li main menu nav noscript ol option p pre search section select summary svg table tbody td template tfoot th thead title tr ul""".split())
PROSE = frozenset("p h1 h2 h3 h4 h5 h6 hgroup blockquote pre table tbody thead tfoot tr td th caption figure figcaption li dt dd dl address details summary hr".split())
LINES = frozenset("p h1 h2 h3 h4 h5 h6".split())
REGION = frozenset(("article", "main"))
#: Elements without main text, whatever is in them.
CHROME = frozenset("head nav aside footer form script style noscript template iframe noembed noframes textarea title svg button select dialog menu search object audio video canvas".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
CHROME_NAMES = frozenset("""ad ads advert adverts advertisement advertisements advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal
    newsletter subscribe subscription sidebar side menu nav navbar navigation breadcrumb breadcrumbs masthead header footer comment comments discussion disqus replies respond share sharing
    social related recommended pagination pager toolbar login signup""".split())
#: Next to these a name says how a page is laid out ("has-sidebar"), not what the element is.
LAYOUT_NAMES = frozenset(("has", "with", "without", "no"))
#: An opening tag closes an open element of these names.
_CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
           "tbody": ("tbody", "thead", "tfoot", "tr", "td", "th"), "tfoot": ("tbody", "thead", "tr", "td", "th"), "thead": ("caption",), "body": ("head",)}

_NAME = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)")
# quotes count only after an equals sign; possessive, so that no part is read again
_TAG = re.compile(_NAME.pattern + r"""((?:[^>=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|=(?!\s*+["']))*+)>""")
_MARK = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""", re.I)
_PARTS = re.compile(r"[a-z0-9]+")
_HIDDEN = re.compile(r"display\s*+:\s*+none", re.I)
_ENDS = {name: re.compile(rf"</{name}(?=[\s/>]|$)", re.I) for name in RAW}
_LONG_NUMBER = re.compile(r"&#0*+[0-9]{8,};?")


class Page(NamedTuple):
    """Blocks of text in order; elements as (subtree hash, first block, block after the last, may be deleted by count); blocks of chrome and of regions."""

    blocks: list[str]
    elements: list[tuple[int, int, int, bool]]
    chrome: list[tuple[int, int]]
    regions: list[tuple[int, int]]


class _Open:
    __slots__ = ("name", "first", "parts", "chrome", "region")

    def __init__(self, name: str, first: int, chrome: bool, region: bool):
        self.name, self.first, self.parts, self.chrome, self.region = name, first, [], chrome, region


def decode(text: str) -> str:
    """Character references decoded; numbers beyond Unicode are the replacement character."""
    if "&" not in text:
        return text
    return markup.unescape(_LONG_NUMBER.sub("�", text) if "&#" in text else text)


def _says_chrome(name: str, attributes: str, in_region: bool) -> bool:
    if name in CHROME or (name == "header" and not in_region):
        return True
    if not attributes or attributes.isspace():
        return False
    for match in _MARK.finditer(attributes):
        key, value = match[1].lower(), (match[2] or match[3] or match[4] or "").lower()
        if key == "role":
            if value.strip() in CHROME_ROLES:
                return True
        elif key == "hidden":
            if value != "until-found":
                return True
        elif key == "aria-hidden":
            if value.strip() == "true":
                return True
        elif key == "style":
            if _HIDDEN.search(value):
                return True
        elif name not in REGION and name not in ("html", "body"):
            for word in value.split():
                parts = set(_PARTS.findall(word))
                if parts & CHROME_NAMES and not parts & LAYOUT_NAMES:
                    return True
    return False


def parse(page: str | None) -> Page:
    """Read a page; see the module."""
    blocks: list[str] = []
    elements: list[tuple[int, int, int, bool]] = []
    chrome: list[tuple[int, int]] = []
    regions: list[tuple[int, int]] = []
    stack: list[_Open] = [_Open("", 0, False, False)]
    count: Counter = Counter()
    pieces: list[str] = []
    depth = {"chrome": 0, "region": 0}

    def end_block() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                blocks.append(text)
                stack[-1].parts.append(text)

    def close() -> None:
        end_block()
        done = stack.pop()
        count[done.name] -= 1
        depth["chrome"] -= done.chrome
        depth["region"] -= done.region
        if not done.parts:
            return
        kept = done.region or (depth["region"] and done.name in PROSE)
        content = "\x1f".join((done.name, *done.parts))
        if kept and done.name in LINES and not done.chrome:
            stack[-1].parts.append(f"\x1e{content}")
            return
        digest = xxhash.xxh64_intdigest(content.encode("utf-8", "surrogatepass")) - (1 << 63)
        stack[-1].parts.append(f"\x1e{digest}")
        run = (done.first, len(blocks))
        if done.chrome:
            chrome.append(run)
        if done.region and not depth["region"] and not depth["chrome"] and not done.chrome:
            regions.append(run)
        if done.name not in ("html", "body"):
            elements.append((digest, *run, not kept))

    def start(name: str, attributes: str) -> None:
        if name == "br":
            pieces.append(" ")
            return
        if name in BLOCK:
            end_block()
            while stack[-1].name == "p" or (stack[-1].name and stack[-1].name not in BLOCK and count["p"]):
                close()
        if name in VOID:
            return
        for other in _CLOSES.get(name, ()):
            while count[other] and stack[-1].name == other:
                close()
        says = _says_chrome(name, attributes, depth["region"] > 0)
        if name not in BLOCK and not says and not depth["chrome"]:
            return  # inline elements are part of their block
        if says:
            end_block()
        stack.append(_Open(name, len(blocks), says, name in REGION))
        count[name] += 1
        depth["chrome"] += says
        depth["region"] += name in REGION

    def end(name: str) -> None:
        if not count[name]:
            if name in BLOCK:
                end_block()
            return
        if name not in BLOCK:
            # an inline end tag doesn't close blocks
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    break
                if stack[k].name in BLOCK:
                    return
        while True:
            last = stack[-1].name
            close()
            if last == name:
                return

    page = page or ""
    at, size = 0, len(page)
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            tag = size
        if tag > at:
            pieces.append(decode(page[at:tag]))
        if tag == size:
            break
        found = _TAG.match(page, tag)
        named = found or _NAME.match(page, tag)
        if named:
            stop = found.end() if found else page.find(">", named.end()) + 1
            if not stop:
                break  # the page ends in a tag
            name = named[2].lower()
            if named[1]:
                end(name)
            else:
                start(name, found[3] if found else page[named.end() : stop - 1])
                if name in RAW:
                    over = _ENDS[name].search(page, stop)
                    stop = over.start() if over else size
            at = stop
        elif page.startswith("<!--", tag):
            over = page.find("-->", tag + 2)
            at = size if over < 0 else over + 3
        elif page.startswith(("<!", "<?", "</"), tag):
            over = page.find(">", tag + 2)
            at = size if over < 0 else over + 1
        else:
            pieces.append("<")
            at = tag + 1
    while len(stack) > 1:
        close()
    end_block()
    return Page(blocks, elements, chrome, regions)


def _outside(n: int, runs: list[tuple[int, int]]) -> list[bool]:
    """For each of ``n`` blocks, whether no run covers it."""
    step = [0] * (n + 1)
    for lo, hi in runs:
        step[lo] += 1
        step[hi] -= 1
    covered, out = 0, []
    for k in range(n):
        covered += step[k]
        out.append(not covered)
    return out


def left(page: Page, templates: set[int]) -> list[str]:
    """The blocks of the main text when the subtrees in ``templates`` are deleted."""
    return [block for block, is_main in zip(page.blocks, _main(page, templates)) if is_main]


def host(url: Column) -> Column:
    """Lower-cased host of a url, without port; empty where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _keyed(rows: DataFrame) -> DataFrame:
    """Adds ``page host`` and ``page key``, the same for equal pages of a host. Two pages that shared a key would only share their lists of
    templates, of which each page deletes its own."""
    return rows.withColumn("page host", host(F.col("url"))).withColumn("page key", F.xxhash64("page host", "html"))


def _main(page: Page, templates: set[int]) -> list[bool]:
    """For each block, whether it is main text when the subtrees in ``templates`` are deleted."""
    n = len(page.blocks)
    stays = _outside(n, [*page.chrome, *((lo, hi) for digest, lo, hi, free in page.elements if free and digest in templates)])
    inside = [stay and not out for stay, out in zip(stays, _outside(n, page.regions))]
    return inside if any(inside) else stays


def weighed(page: Page) -> dict[int, bool]:
    """The subtrees that count, and whether the page's main text would lose a block with them. Text outside an article is main text
    only if the article has none left, so as long as no subtree takes a block from the article, none changes the page."""
    total = [0]
    for is_main in _main(page, set()):
        total.append(total[-1] + is_main)
    out: dict[int, bool] = {}
    for digest, lo, hi, free in page.elements:
        if free:
            out[digest] = out.get(digest, False) or total[hi] > total[lo]
    return out


def subtrees(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(page key, subtree, matters, copies): the subtrees that may be deleted by count, each once for a page of a host; ``subtree`` names host and hash,
    ``matters`` tells whether the page has main text in it, ``copies`` how many rows the page has."""
    rows = _keyed(pages.select(F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html")))

    def run(column: pa.Array) -> dict[str, pa.Array]:
        found = [[{"hash": h, "matters": m} for h, m in weighed(parse(p)).items()] for p in column.to_pylist()]
        return {"found": pa.array(found, type=pa.list_(pa.struct([("hash", pa.int64()), ("matters", pa.bool_())])))}

    found = add_columns(rows, "html", run, {"found": "array<struct<hash:bigint,matters:boolean>>"})
    each = found.select("page key", "page host", F.inline("found")).select("page key", F.xxhash64("page host").bitwiseXOR(F.col("hash")).alias("subtree"), "matters")
    return each.groupBy("page key", "subtree").agg(F.max("matters").alias("matters"), F.count("*").alias("copies"))


def templates(found: DataFrame, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(subtree, pages) of the subtrees that ``least_pages`` different pages of their host have."""
    return found.groupBy("subtree").agg(F.count("*").alias("pages")).where(F.col("pages") >= least_pages)


def extract(pages: DataFrame, url: str = "url", page: str = "html", least_pages: int = LEAST_PAGES) -> DataFrame:
    """``pages`` without the html, with ``text`` (the blocks of the main text, joined by two line feeds) and ``n_chars`` (its code points).

    Only pages that have main text in a subtree that counts are joined with their host's templates and so shuffled; the others' templates
    lie wholly in what their tags delete or outside their article, so those pages are read where they are.
    """
    found = materialize(subtrees(pages, url, page), "subtrees")
    common = materialize(templates(found, least_pages), "templates")
    exposed = found.where("matters")
    deleted = join_hot(exposed, common, ["subtree"], hottest(common, ["subtree"], "pages"), F.col("page key"), how="left")
    listed = F.collect_set(F.when(F.col("pages").isNotNull(), F.col("subtree")))
    exposed = materialize(deleted.groupBy("page key").agg(listed.alias("page templates"), F.max("copies").alias("copies")), "exposed")

    kept = [c for c in pages.columns if c not in (page, "text", "n_chars")]
    aside = {c: f"own {c}" for c in kept}
    rows = _keyed(pages.select(*[F.col(f"`{c}`").alias(aside[c]) for c in kept], F.col(f"`{url}`").alias("url"), F.col(f"`{page}`").alias("html")))

    def in_place(column: pa.Array) -> dict[str, pa.Array]:
        out = []
        for p in column.to_pylist():
            read = parse(p)
            out.append(None if any(weighed(read).values()) else "\n\n".join(left(read, set())))
        return {"text": pa.array(out, type=pa.string())}

    def joined(batches):
        for batch in chunks(batches, "html"):
            out = []
            for p, common in zip(batch.column("html").to_pylist(), batch.column("common").to_pylist()):
                out.append("\n\n".join(left(parse(p), set(common))))
            yield pa.RecordBatch.from_arrays([*(batch.column(aside[c]) for c in kept), pa.array(out, type=pa.string())], names=[*(aside[c] for c in kept), "text"])

    own = [F.col(f"`{aside[c]}`") for c in kept]
    settled = add_columns(rows, "html", in_place, {"text": "string"}).where("text IS NOT NULL").select(*own, "text")
    many = hottest(exposed, ["page key"], "copies")
    met = join_hot(rows, exposed.select("page key", "page templates"), ["page key"], many, F.monotonically_increasing_id(), how="inner")
    hashes = F.transform("page templates", lambda x: x.bitwiseXOR(F.xxhash64("page host")))
    met = met.select(*own, "html", hashes.alias("common"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*own).schema)
    met = met.mapInArrow(joined, f"{fields}, text string" if kept else "text string")
    return settled.unionByName(met).select(*[F.col(f"`{aside[c]}`").alias(c) for c in kept], "text", F.char_length("text").cast("bigint").alias("n_chars"))
