"""Pages into books: printed page numbers, contents pages, appendices, slide text."""

from __future__ import annotations

import hashlib
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from leafmark.functions.text import MD_TABLE_ROW, lines, strip
from leafmark.operators.markdown import lines_of
from leafmark.sources.tables import stored

# Thresholds and patterns of the merge step.
TOC_HEADS, TOC_BODY_CHARS, TOC_BODY_LINES, PAGE_TOLERANCE = 8, 30, 1, 3
TABLE_RULE, TABLE_SECTION = r"^\|[\s:|-]+\|$", r"^\|\s*\d+(?:\.\d+)+\s*\|"
APPENDIX, BARE_CHAPTER = r"^附\s*录\s*[A-Za-z]?", r"^(#{1,6})\s*第\s*(\d+)\s*章\s*$"
SHORT_LABEL = r"^[一-鿿A-Za-z0-9·•]{1,8}$"
#: Up to so many books have their one row each broadcast to the pages, so that a long book's pages stay where they are.
BROADCAST_BOOKS = 500_000


def page_offset(pages: DataFrame, book: str = "book") -> DataFrame:
    """(book, offset): the difference of printed number and page order that most pages agree on, within one; first wins.

    Differences are counted by value, so pages are never paired with pages.
    """
    d = pages.where("page_no is not null and page_no <> 0").select(book, "idx", (F.col("page_no") - F.col("idx") - 1).alias("v"))
    by_value = d.groupBy(book, "v").agg(F.count(F.lit(1)).alias("n"), F.min("idx").alias("first"))
    near = by_value.select(book, F.col("v").alias("u"), "n").select(book, "n", F.explode(F.array(F.col("u") - 1, F.col("u"), F.col("u") + 1)).alias("v")).groupBy(book, "v").agg(F.sum("n").alias("votes"))
    best = by_value.join(near, [book, "v"]).groupBy(book).agg(F.max_by("v", F.struct(F.col("votes"), -F.col("first"))).alias("offset"))
    return pages.select(book).distinct().join(best, book, "left").select(book, F.coalesce("offset", F.lit(0)).alias("offset"))


def clean_page_numbers(pages: DataFrame, book: str = "book") -> DataFrame:
    """pages (book, idx, page_no, ...) with page_no put right and fixed, whether it was."""
    return _clean(pages.join(page_offset(pages, book), book))


def _clean(p: DataFrame) -> DataFrame:
    guess = F.col("idx") + 1 + F.col("offset")
    guess = F.when(guess >= 1, guess)
    fits = F.abs(F.col("page_no") - (F.col("idx") + 1) - F.col("offset")) <= PAGE_TOLERANCE
    return p.withColumn("fixed", F.col("page_no").isNotNull() & ~fits).withColumn(
        "page_no", F.when(F.col("page_no").isNotNull() & fits, F.col("page_no")).otherwise(guess)).drop("offset")


def _by_book(pages: DataFrame, books: DataFrame, book: str) -> DataFrame:
    """pages with what books (one row each, not all of them) say, else null."""
    books, _ = stored(pages.sparkSession, books, "by-book")
    return pages.join(F.broadcast(books) if books.count() <= BROADCAST_BOOKS else books, book, "left")


def _toc_counts(text: Column) -> Column:
    """struct<heads, body>: lines of a page that are headings or contents rows, and lines that are prose."""
    def count(ls):
        row, head = lambda s: s.rlike(MD_TABLE_ROW), lambda s: s.rlike(r"^#{1,6}\s+")
        heads = F.filter(ls, lambda s: F.when(row(s), s.rlike(TABLE_SECTION)).otherwise(head(s)))
        body = F.filter(ls, lambda s: ~row(s) & ~head(s) & (F.length(s) >= TOC_BODY_CHARS))
        return F.struct(F.size(heads).alias("heads"), F.size(body).alias("body"))
    kept = F.filter(F.transform(lines(text), strip), lambda s: ~((s == "") | s.startswith("![") | s.rlike(TABLE_RULE)))
    return F.get(F.transform(F.array(kept), count), F.lit(0))


def _is_toc(heads: Column, body: Column) -> Column:
    return (heads >= TOC_HEADS) & (body <= TOC_BODY_LINES)


def toc_pages(pages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, heads, body, is_toc): whether a page is nothing but headings and contents rows."""
    n = pages.select(*keys, _toc_counts(F.col("text")).alias("_n")).groupBy(*keys).agg(F.sum("_n.heads").alias("heads"), F.sum("_n.body").alias("body"))
    return n.withColumn("is_toc", _is_toc(F.col("heads"), F.col("body")))


def normalize_parts(parts: DataFrame, doc: str, order: str, text: str = "text") -> DataFrame:
    """parts (doc, order, text) with text put right and appendix_subs of the part: the first appendix line that two bare chapter
    headings follow becomes a chapter of its own, and the bare chapters after it its sections.

    A line has two bare chapters after it if it stands before the last but one, so a document's lines meet no window.
    """
    bare, appendix = lambda s: s.rlike(BARE_CHAPTER), lambda s: (F.length(s) <= 30) & s.rlike(APPENDIX)
    some = parts.where(F.col(text).contains("第") | F.col(text).contains("附"))
    marks = some.select(doc, order, F.posexplode(F.transform(lines(F.col(text)), strip)).alias("k", "s"))
    marks = marks.select(doc, F.struct(F.col(order).alias("o"), "k").alias("pos"), bare(F.col("s")).alias("bare"), appendix(F.col("s")).alias("appendix")).where("bare or appendix")
    marks, _ = stored(parts.sparkSession, marks, "appendix-marks")
    chapters = marks.where("bare").select(doc, "pos")
    last = chapters.groupBy(doc).agg(F.max("pos").alias("last"))
    second = chapters.join(last, doc).where("pos < last").groupBy(doc).agg(F.max("pos").alias("second"))
    at = marks.where("appendix").join(second, doc).where("pos < second").groupBy(doc).agg(F.min("pos").alias("_at"))
    p = _by_book(parts, at, doc)
    here = F.col(order) == F.col("_at.o")
    after = lambda k: (F.col(order) > F.col("_at.o")) | (here & (k > F.col("_at.k")))

    def put(raw, k):
        s = strip(raw)
        return (F.when(here & (k == F.col("_at.k")) & ~s.startswith("#"), F.concat(F.lit("# "), s))
                .when(after(k) & bare(s), F.concat(F.lit("## 第"), F.regexp_extract(s, BARE_CHAPTER, 2), F.lit("章"))).otherwise(raw))
    subs = F.size(F.filter(lines(F.col(text)), lambda raw, k: after(k) & bare(strip(raw))))
    return p.select(*[c for c in parts.columns if c != text],
                    F.when(F.col("_at").isNull(), F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")).otherwise(F.array_join(F.transform(lines(F.col(text)), put), "\n")).alias(text),
                    F.when(F.col("_at").isNull(), 0).otherwise(subs).alias("appendix_subs"))


def normalize_appendix(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, text, appendix_subs): normalize_parts for whole documents, one row each."""
    parts = docs.select(doc, F.lit(0).alias("_part"), F.col(text).alias("text"))
    return normalize_parts(parts, doc, "_part").select(doc, "text", F.col("appendix_subs").cast("long").alias("appendix_subs"))


def merge_parts(pages: DataFrame, book: str = "book", keep_toc: bool = False) -> tuple[DataFrame, DataFrame]:
    """pages (book, idx, text, page_no) -> (parts (book, idx, text, appendix_subs), stats by book): a book's text is its parts
    by idx, a blank line between."""
    text = strip(F.coalesce("text", F.lit("")))
    p = _clean(_by_book(pages.withColumn("text", text), page_offset(pages, book), book))
    n = _toc_counts(F.col("text"))
    p = p.withColumn("_n", n).withColumn("is_toc", _is_toc(F.col("_n.heads"), F.col("_n.body")) & F.lit(not keep_toc) & (F.col("text") != ""))
    part = F.concat(F.lit("<!-- page "), F.coalesce("page_no", F.col("idx") + 1).cast("string"), F.lit(" -->\n\n"), "text")
    p = p.withColumn("part", F.when((F.col("text") != "") & ~F.col("is_toc"), part))
    stats = p.groupBy(book).agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("text") == "").alias("empty"), F.count_if(F.col("is_toc")).alias("toc_dropped"),
        F.count_if(F.col("fixed")).alias("pageno_fixed"), F.min("page_no").alias("page_min"), F.max("page_no").alias("page_max"),
        F.coalesce(F.sum(F.length("part")), F.lit(0)).alias("chars"))
    kept = p.where("part is not null").select(book, "idx", F.col("part").alias("text"))
    return normalize_parts(kept, book, "idx"), stats


def merge_pages(pages: DataFrame, book: str = "book", keep_toc: bool = False) -> tuple[DataFrame, DataFrame]:
    """pages (book, idx, text, page_no) -> (books (book, text, appendix_subs), stats by book). A book is one row here; for books
    of any length see merge_parts."""
    parts, stats = merge_parts(pages, book, keep_toc)
    books = parts.groupBy(book).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda r: r["text"]), "\n\n").alias("text"), F.sum("appendix_subs").alias("appendix_subs"))
    return books, stats


def book_digests(parts: DataFrame, book: str = "book", between: str = "\n\n") -> DataFrame:
    """(book, chars, text_md5, appendix_subs) of the merged books: parts stream by in order, so that no book is ever one row."""
    key, kind = parts.schema[book], to_arrow_type(parts.schema[book].dataType)

    def rows(batches):
        for b in batches:
            sizes = pc.utf8_length(b.column("text")).to_pylist()
            yield from zip(b.column(0).to_pylist(), sizes, b.column("text"), b.column("appendix_subs").to_pylist(), strict=True)

    def run(batches):
        for name, group in groupby(rows(batches), key=lambda r: r[0]):
            md5, chars, subs = hashlib.md5(), -len(between), 0
            for k, (_, size, text, n) in enumerate(group):
                if k:
                    md5.update(between.encode())
                md5.update(text.as_buffer())
                chars, subs = chars + len(between) + size, subs + n
            yield pa.RecordBatch.from_pydict({book: pa.array([name], kind), "chars": [chars], "text_md5": [md5.hexdigest()], "appendix_subs": [subs]})
    rows_ = parts.select(book, "idx", "text", "appendix_subs").repartition(book).sortWithinPartitions(book, "idx", "text").select(book, "text", "appendix_subs")
    return rows_.mapInArrow(run, f"`{book}` {key.dataType.simpleString()}, chars long, text_md5 string, appendix_subs long")


def clean_slides(docs: DataFrame, doc: str, text: str = "text", most: int = 10) -> DataFrame:
    """(doc, text): blank runs become one blank line; runs of short label lines (blanks inside allowed) one line of
    distinct labels, at most `most`."""
    w = Window.partitionBy(doc).orderBy("pos")
    ln = docs.select(doc, F.posexplode(lines(F.col(text))).alias("pos", "raw")).select(doc, "pos", F.regexp_replace("raw", r"\s+$", "").alias("line"), strip(F.col("raw")).alias("s"))
    blank = F.col("s") == ""
    ln = ln.withColumn("blank", blank).withColumn("_pb", F.coalesce(F.lag("blank").over(w), F.lit(False))).where(~(F.col("blank") & F.col("_pb")))
    ln = ln.withColumn("label", F.col("s").rlike(SHORT_LABEL))
    # a run begins at a label whose last non-blank line is no label; blanks after a label belong to its run
    seen = F.when(~F.col("blank"), F.col("label"))
    ln = ln.withColumn("_last", F.last(seen, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    inside = F.col("label") | (F.col("blank") & F.coalesce("_last", F.lit(False)))
    starts = (~inside) | (F.col("label") & ~F.coalesce("_last", F.lit(False)))
    ln = ln.withColumn("_in", inside).withColumn("_g", F.sum(starts.cast("int")).over(w))
    labels = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col("label"), F.struct("pos", "s")))), lambda r: r["s"]))
    g = ln.groupBy(doc, "_g").agg(F.min("pos").alias("pos"), F.array_join(F.slice(labels, 1, most), "、").alias("joined"), F.max("label").alias("has"), F.min_by("line", "pos").alias("line"))
    out = g.withColumn("out", F.when(F.col("has"), F.col("joined")).otherwise(F.col("line")))
    return out.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda r: r["out"]), "\n").alias("text"))


__all__ = ["book_digests", "clean_page_numbers", "clean_slides", "lines_of", "merge_pages", "merge_parts", "normalize_appendix", "page_offset", "toc_pages"]
