"""Web pages: main text, links, and one form of their addresses.

Each page is read by itself, so nothing is shuffled but counts by address.  Null pages have no text and no links.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions import html, urls

_LINKS = T.ArrayType(T.StructType().add("href", "string").add("text", "string"))
_BLOCKS = T.ArrayType(T.StructType().add("tag", "string").add("text", "string").add("words", "integer").add("link_words", "integer"))
_READ = T.StructType().add("title", "string").add("base", "string").add("links", _LINKS).add("blocks", _BLOCKS)
_ARROW = pa.struct([("title", pa.string()), ("base", pa.string()), ("links", pa.list_(pa.struct([("href", pa.string()), ("text", pa.string())]))), ("blocks", pa.list_(pa.struct([("tag", pa.string()), ("text", pa.string()), ("words", pa.int32()), ("link_words", pa.int32())])))])
#: Pages read at a time: bounds what is held as Python objects.
_AT_ONCE = 64


def read_pages(pages: DataFrame, column: str = "html", closed: bool = False) -> DataFrame:
    """Replaces the markup by ``title``, ``base``, ``links`` and ``blocks`` (see ``functions.html``; ``closed``: only character references with a semicolon count)."""
    kept = [f for f in pages.schema.fields if f.name != column]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _AT_ONCE):
                part = batch.slice(at, _AT_ONCE)
                found = pa.array([html.page(x.as_py(), closed) for x in part.column(column)], _ARROW)
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), *found.flatten()], [*(f.name for f in kept), *_READ.names])

    return pages.mapInArrow(run, T.StructType([*kept, *_READ.fields]))


#: A block is full text from so many words on; a shorter one, from the second number on, is text beside a full one; more than a third of linked words make it a menu.
FULL, SHORT, LINKED = 15, 5, 3


def main_blocks(blocks: Column) -> Column:
    """The blocks of a page that hold its text, by the density of words and of links of a block and its neighbours."""
    prose = lambda x: (x["words"] >= FULL) & (x["link_words"] * LINKED <= x["words"])
    beside = lambda i: F.coalesce(prose(F.get(blocks, i)), F.lit(False))

    def kept(x: Column, i: Column) -> Column:
        own = x["link_words"] * LINKED <= x["words"]
        heading = x["tag"].rlike("^h[1-6]$") & beside(i + 1)
        return own & ((x["words"] >= FULL) | ((x["words"] >= SHORT) & (beside(i - 1) | beside(i + 1))) | heading)

    return F.filter(blocks, kept)


def main_text(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, title, n_blocks, n_kept, text) of pages (page_id, html)."""
    read = read_pages(pages.select("page_id", "html"), closed=closed).withColumn("kept", main_blocks(F.col("blocks")))
    return read.select("page_id", "title", F.size("blocks").alias("n_blocks"), F.size("kept").alias("n_kept"), F.array_join(F.transform("kept", lambda x: x["text"]), "\n").alias("text"))


def links(pages: DataFrame, closed: bool = False) -> DataFrame:
    """(page_id, n, href, text, url, outside): each link in its order, its address from the page's (or the page's ``base``), and whether
    it leaves the page's host."""
    read = read_pages(pages.select("page_id", "url", "html"), closed=closed)
    own = read.withColumns({"_page": urls.parts(F.trim("url")), "_base": urls.parts(F.trim(F.coalesce("base", F.lit(""))))})
    own = own.withColumns({"_base": urls.resolved(F.col("_page"), F.col("_base")), "_host": urls.host_of(F.col("_page"))})
    each = own.select("page_id", "_base", "_host", F.posexplode("links").alias("n", "link")).withColumn("_link", urls.parts(F.col("link.href")))
    found = each.withColumn("_link", urls.resolved(F.col("_base"), F.col("_link"))).withColumn("_link", urls.normal(F.col("_link"))).withColumn("url", urls.address(F.col("_link")))
    return found.select("page_id", "n", F.col("link.href").alias("href"), F.col("link.text").alias("text"), "url", (F.col("url").isNotNull() & (F.col("_link.host") != F.col("_host"))).alias("outside"))


def page_addresses(pages: DataFrame) -> DataFrame:
    """(page_id, url, canonical_url, host)."""
    read = pages.select("page_id", "url").withColumn("_p", urls.parts(F.trim("url"))).withColumn("_p", urls.normal(F.col("_p")))
    return read.select("page_id", "url", urls.address(F.col("_p")).alias("canonical_url"), F.col("_p.host").alias("host"))


def same_address(pages: DataFrame) -> DataFrame:
    """(canonical_url, n_pages, first_page): pages that share an address in its one form."""
    known = page_addresses(pages).filter(F.col("canonical_url").isNotNull())
    return known.groupBy("canonical_url").agg(F.count(F.lit(1)).alias("n_pages"), F.min("page_id").alias("first_page"))
