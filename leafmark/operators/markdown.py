"""Markdown into ordered items with section paths, by windows over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import MD_HEADING, MD_IMAGE, MD_TABLE_ROW, PAGE_MARK, infer_chapter, lines, strip


def lines_of(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, pos, line): trimmed lines."""
    return docs.select(doc, F.posexplode(lines(F.col(text))).alias("pos", "raw")).select(doc, "pos", strip(F.col("raw")).alias("line"))


def heading_paths(heads: DataFrame, doc: str) -> DataFrame:
    """Headings (doc, pos, level, title) with their path: a heading stays open until one of its level or above.

    A book that starts half-way gets the chapter that its first title's number tells, as level 1.
    """
    w = Window.partitionBy(doc).orderBy("pos")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    # the stack is empty before a heading that is no deeper than all before it, unless a made-up chapter is there
    h = heads.withColumn("_least", F.min("level").over(before)).withColumn(
        "_cand", F.when(F.col("_least").isNull() | (F.col("level") <= F.col("_least")), infer_chapter(F.col("title"))).otherwise(""))
    h = h.withColumn("_earlier", F.coalesce(F.max(F.col("_cand") != "").over(before), F.lit(False)))
    h = h.withColumn("_chap", F.when((F.col("level") == 1) | ~F.col("_earlier"), F.col("_cand")).otherwise(""))
    h = h.withColumn("_made", F.max(F.when(F.col("_chap") != "", F.struct("pos", "_chap"))).over(upto))
    for k in range(1, 7):
        h = h.withColumn(f"_s{k}", F.max(F.when(F.col("level") == k, F.struct("pos", "title"))).over(upto))
    at = [F.coalesce(F.col(f"_s{k}.pos"), F.lit(-1)) for k in range(1, 7)]
    # a level is open while nothing of a smaller level came after it; a made-up chapter, while no real chapter did
    parts = [F.when(F.col("_made").isNotNull() & (F.col("_made.pos") >= at[0]), F.col("_made._chap"))]
    for k in range(1, 7):
        over = F.greatest(*at[:k - 1]) if k > 2 else at[0] if k == 2 else F.lit(-1)
        parts.append(F.when((at[k - 1] > over) & (F.lit(k) <= F.col("level")), F.col(f"_s{k}.title")))
    path = F.array_join(F.filter(F.array(*parts), lambda x: x.isNotNull()), " > ")
    return h.select(*heads.columns, path.alias("path"))


def parse_items(docs: DataFrame, doc: str, text: str = "text") -> DataFrame:
    """(doc, pos, kind, level, text, url, path, page): headings, paragraphs, tables and figures in order.

    Consecutive table rows are one table; text lines up to a blank line or table are one paragraph. As text is put down only
    when such a line comes, an item keeps the path and page that hold there, and headings or figures met meanwhile come first.
    """
    w = Window.partitionBy(doc).orderBy("pos")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    ln = lines_of(docs, doc, text)
    n = Window.partitionBy(doc)
    c = F.col("line")
    kind = (F.when(c.rlike(MD_TABLE_ROW), "table").when(c.rlike(PAGE_MARK), "page").when(c.rlike(MD_HEADING), "heading")
            .when(c.rlike(MD_IMAGE), "figure").when(c == "", "blank").otherwise("para"))
    ln = ln.withColumn("kind", kind)
    # a paragraph ends at a blank or table line, a table at any other line
    ends_para = F.sum(F.col("kind").isin("blank", "table").cast("int")).over(upto)
    ln = ln.withColumn("_pg", ends_para).withColumn("_prev", F.lag("kind").over(w))
    starts_table = ((F.col("kind") == "table") & (F.coalesce("_prev", F.lit("")) != "table")).cast("int")
    ln = ln.withColumn("_tg", F.sum(starts_table).over(upto)).withColumn("_last", F.max("pos").over(n))
    ln = ln.withColumn("_page", F.last(F.when(F.col("kind") == "page", F.regexp_extract("line", PAGE_MARK, 1).cast("int")), True).over(upto))
    heads = ln.where("kind = 'heading'").select(
        doc, "pos", F.length(F.regexp_extract("line", MD_HEADING, 1)).alias("level"), strip(F.regexp_extract("line", MD_HEADING, 2)).alias("title"))
    paths = heading_paths(heads, doc).select(doc, "pos", "level", "title", "path")
    ln = ln.join(paths, [doc, "pos"], "left").withColumn("_path", F.coalesce(F.last("path", True).over(upto), F.lit("")))
    single = ln.where(F.col("kind").isin("heading", "figure")).select(
        doc, F.col("pos").cast("double").alias("at"), "kind", F.coalesce("level", F.lit(0)).alias("level"),
        F.when(F.col("kind") == "heading", F.col("title")).otherwise(strip(F.regexp_extract("line", MD_IMAGE, 1))).alias("text"),
        F.when(F.col("kind") == "figure", strip(F.regexp_extract("line", MD_IMAGE, 2))).alias("url"), F.col("_path").alias("path"), F.col("_page").alias("page"))
    # where a paragraph is put down: at the line that ends it, with what holds just before it
    marks = ln.select(doc, "_pg", "pos", "_path", "_page", "kind")
    held = marks.groupBy(doc, "_pg").agg(F.max("pos").alias("end"), F.max_by("_path", "pos").alias("p_path"), F.max_by("_page", "pos").alias("p_page"))
    paras = ln.where("kind = 'para'").groupBy(doc, "_pg").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("text")).join(held, [doc, "_pg"]).select(
        doc, (F.col("end") + 0.5).alias("at"), F.lit("para").alias("kind"), F.lit(0).alias("level"), strip(F.col("text")).alias("text"),
        F.lit(None).cast("string").alias("url"), F.col("p_path").alias("path"), F.col("p_page").alias("page"))
    tables = ln.where("kind = 'table'").groupBy(doc, "_tg").agg(
        F.max("pos").alias("end"), F.max_by("_path", "pos").alias("path"), F.max_by("_page", "pos").alias("page"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda r: r["line"]), "\n").alias("text")).select(
        doc, (F.col("end") + 0.25).alias("at"), F.lit("table").alias("kind"), F.lit(0).alias("level"), "text", F.lit(None).cast("string").alias("url"), "path", "page")
    every = single.unionByName(paras).unionByName(tables)
    return every.withColumn("pos", (F.row_number().over(Window.partitionBy(doc).orderBy("at")) - 1)).drop("at").select(doc, "pos", "kind", "level", "text", "url", "path", "page")


def profile(docs: DataFrame, doc: str) -> DataFrame:
    """Counts of headings, table lines, figures, page marks, characters and lines of each document."""
    c = F.col("line")
    return lines_of(docs, doc).groupBy(doc).agg(
        F.count_if(c.rlike(r"^#\s")).alias("h1"), F.count_if(c.rlike(r"^##\s")).alias("h2"), F.count_if(c.rlike(r"^###\s")).alias("h3"),
        F.count_if(c.rlike(MD_TABLE_ROW)).alias("table_lines"), F.count_if(c.rlike(r"^!\[")).alias("figures"), F.count_if(c.rlike(PAGE_MARK)).alias("page_marks"),
        F.sum(F.length(c)).alias("chars"), F.count(F.lit(1)).alias("lines"))


def occurrences(docs: DataFrame, doc: str, word: str, most: int = 6) -> DataFrame:
    """The first `most` lines of each document that hold word: (doc, line_no, hit)."""
    w = Window.partitionBy(doc).orderBy("pos")
    return lines_of(docs, doc).where(F.col("line").contains(word)).withColumn("hit", F.row_number().over(w)).where(F.col("hit") <= most).select(
        doc, (F.col("pos") + 1).alias("line_no"), "hit")
