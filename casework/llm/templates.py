"""Main texts of pages by template deduction: tokens that share their occurrence vector over a host's pages form the template, the rest are slots.

A token is an element, standing for its start and end tag, or a block of text, each told apart by its path of tag names and classes. A token's occurrence
vector has its count on every page of the host. Vectors are never built: a vector is the exclusive or of digests of (page, count), which adds up in any order before the
shuffle. Tokens with equal vectors on enough pages are an equivalence class. A class is valid if its tokens come in one order on all of its pages; elements nest by
their paths, so a valid class lies in the slot of the class that holds its parent. Tokens out of order leave their class, and with them what they enclose.

A host's template is one short row: its valid elements with the words they enclose, and the texts that stand on nearly all of its pages. A page is read again beside the
template of its host. Of its slots, those that belong to a menu, header, footer, sidebar, notice, advert, form or to reader comments (by element, role or class) never
count, nor does a text of the template unless such texts are most of the page (then the pages are copies and the text is theirs). The article is what `article` elements
hold, else `main`; on pages that name neither, the template is descended from the root while one template element that occurs once holds most of the words. Blocks
of text stand in page order, one line each.

Copies of a page count once in a vector. A template has tokens of at least `SUPPORT` of the host's pages only, so its size is bounded by that of an average page. The join of pages and
templates has one row on the template's side per host, so adaptive execution splits a hot host's pages.

Defined cases: a null or empty html, or one without any article text, gives an empty text; pages with a null or unreadable url share one nameless host; on a host of one
page, and for a page unlike its host, the page is its own template. Repeated rows and rows without an id each have a row. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casework.llm.common import stored, text_of
from casework.llm.pagetree import Page, read, text_token, tokens

#: Share of a host's pages that a template token is on, that a template text is on, and share of the words that a container holds to be descended into.
SUPPORT, CONSTANT, MOST = 0.05, 0.9, 0.6
#: Pages that a host needs before a text on all of them is its template's.
LEAST_PAGES = 3
_TOKEN = "struct<token:long,parent:long,n:int,first:int,is_text:boolean,holds:boolean,words:int>"
_TOKEN_TYPE = pa.list_(pa.struct([
    ("token", pa.int64()), ("parent", pa.int64()), ("n", pa.int32()), ("first", pa.int32()), ("is_text", pa.bool_()), ("holds", pa.bool_()),
    ("words", pa.int32()),
]))
#: A template as arrays: elements that can hold an article with their parents and words, and the texts.
TEMPLATE = ("elements", "parents", "words", "texts")


def host_of(url: Column) -> Column:
    """Lower-case host and port; nothing readable: the empty string."""
    return F.lower(F.regexp_extract(F.coalesce(url.cast("string"), F.lit("")), r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("token", "parent", "n", "first", "is_text", "holds", "words")
    for batch in batches:
        rows = [[dict(zip(names, t, strict=True)) for t in tokens(read(h.as_py()))] for h in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, _TOKEN_TYPE)], ["host", "page", "tokens"])


def occurrences(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """host, page, token, parent, n, first, is_text, holds, words: one row per token of each different page of a host."""
    text = text_of(html)
    named = pages.select(host_of(F.col(url)).alias("host"), F.xxhash64(text).alias("page"), text.alias("html")).filter("html <> ''")
    read_ = named.mapInArrow(_occurrences, f"host string, page long, tokens array<{_TOKEN}>")
    once = read_.groupBy("host", "page").agg(F.first("tokens").alias("tokens"))
    return once.select("host", "page", F.explode("tokens").alias("t")).select("host", "page", "t.*")


def classes(found: DataFrame) -> DataFrame:
    """host, pages, token, parent, is_text, holds, on, n, words, vector: tokens on enough pages. Equal vectors of a host are a class."""
    hosts = found.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("pages"))
    vectors = found.groupBy("host", "token").agg(
        F.first("parent").alias("parent"), F.first("is_text").alias("is_text"), F.first("holds").alias("holds"), F.count("*").alias("on"),
        F.sum("n").alias("n"), F.sum("words").alias("words"), F.bit_xor(F.xxhash64("page", "n")).alias("vector"),
    )
    # A text on fewer pages cannot be a template's on any host; it goes before the join, whose key is the host alone.
    vectors = vectors.filter(~F.col("is_text") | (F.col("on") >= LEAST_PAGES * CONSTANT))
    enough = F.when(F.col("is_text"), (F.col("on") >= CONSTANT * F.col("pages")) & (F.col("pages") >= LEAST_PAGES)).otherwise(
        F.col("on") >= SUPPORT * F.col("pages")
    )
    return vectors.join(hosts, "host").filter(enough)


def in_order(found: DataFrame, grouped: DataFrame) -> DataFrame:
    """host, token of the elements that have one place in the order of their class on all pages."""
    members = grouped.filter("not is_text").select("host", "token", "vector", "on")
    placed = found.filter("not is_text").select("host", "page", "token", "first").join(members, ["host", "token"])
    rank = F.row_number().over(Window.partitionBy("host", "page", "vector", "on").orderBy("first"))
    ranked = placed.select("host", "token", rank.alias("rank"))
    return ranked.groupBy("host", "token").agg(F.min("rank").alias("low"), F.max("rank").alias("high")).filter("low = high").select("host", "token")


def templates(found: DataFrame) -> DataFrame:
    """One row per host: its name and the arrays of `TEMPLATE`. `found` is the stored table of `occurrences`."""
    grouped = stored(classes(found), "classes")
    valid = in_order(found, grouped).withColumn("valid", F.lit(True))
    kept = grouped.join(valid, ["host", "token"], "left").filter("is_text or valid")
    # An element is descended into only where it occurs once on each of its pages.
    single = ~F.col("is_text") & F.col("holds") & (F.col("n") == F.col("on"))
    element = F.when(single, F.struct("token", "parent", "words"))
    listed = kept.groupBy("host").agg(
        F.collect_list(element).alias("e"), F.collect_list(F.when(F.col("is_text"), F.col("token"))).alias("texts"),
    )
    return listed.select("host", F.col("e.token").alias("elements"), F.col("e.parent").alias("parents"), F.col("e.words").alias("words"), "texts")


class Template:
    """The template of one host, inside a task."""

    def __init__(self, elements: list[int], parents: list[int], words: list[int], texts: list[int]) -> None:
        self.texts, self.words, self.children = set(texts), dict(zip(elements, words, strict=True)), {}
        for token, parent in zip(elements, parents, strict=True):
            self.children.setdefault(parent, []).append(token)
        self.containers = self._descended()

    @classmethod
    def of_page(cls, page: Page) -> Template:
        held = [(path, e[0], e[4]) for path, e in page.elements.items() if e[3] and e[1] == 1]
        return cls(*([h[i] for h in held] for i in range(3)), [])

    def _descended(self) -> list[int]:
        """Elements from the root down, each of which holds most of the words of the one before."""
        out, at = [], 0
        while children := self.children.get(at):
            best = max(children, key=lambda t: (self.words[t], -t))
            if self.words[best] <= 0 or out and self.words[best] < MOST * self.words[out[-1]]:
                break
            out.append(at := best)
        return out


def main_text(page: Page, template: Template) -> str:
    """The lines of the page's article."""
    slots = [b for b in page.blocks if not b.apart]
    chosen = [b for b in slots if b.article] or [b for b in slots if b.main]
    if not chosen:
        for source in (template, Template.of_page(page)):
            inner = next((c for c in reversed(source.containers) if c in page.elements), None)
            chosen = [b for b in slots if inner in b.inside] if inner is not None else []
            # A block of links only is a menu that nothing names.
            chosen = [b for b in chosen if b.link_words < b.text.count(" ") + 1] or chosen
            if chosen:
                break
        else:
            chosen = slots
    own = [b for b in chosen if text_token(b.owner, b.text) not in template.texts]
    size = [sum(len(b.text) for b in part) for part in (own, chosen)]
    return "\n".join(b.text for b in (own if 2 * size[0] >= size[1] else chosen))


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    host, template = None, Template([], [], [], [])
    for batch in batches:
        texts = []
        for i in range(batch.num_rows):
            if host is None or batch.column(1)[i].as_py() != host:
                host = batch.column(1)[i].as_py()
                template = Template(*(batch.column(k)[i].as_py() or [] for k in range(3, 7)))
            texts.append(main_text(read(batch.column(2)[i].as_py()), template))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), batch.column(7)], ["id", "text", "url"])


def main_texts(pages: DataFrame, key: str = "page_id", html: str = "html", url: str = "url") -> DataFrame:
    """id, text, url: a row per row of `pages`."""
    found = stored(occurrences(pages, html, url), "occurrences")
    deduced = stored(templates(found), "templates")
    rows = pages.select(F.col(key).cast("long").alias("id"), host_of(F.col(url)).alias("host"), text_of(html).alias("html"), F.col(url).alias("url"))
    beside = rows.join(deduced, "host", "left").select("id", "host", "html", *TEMPLATE, F.col("url").cast("string").alias("url"))
    return beside.mapInArrow(_extracted, "id long, text string, url string")
