"""Sentence chunks with overlap, the short-piece rule, and title chunks, by pure expressions and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import SentenceProfile, sentences, strip


def chunk_bounds(sents: Column, target: int = 400) -> Column:
    """array<struct<i, j>>: chunks [i, j) of sentences, each as many as reach target characters, the next one
    starting at the last sentence of the one before (at least one further on)."""
    n = F.size(sents)
    blank = F.expr("cast(array() as array<struct<i:int,j:int>>)")
    state = F.struct(F.lit(0).alias("i"), F.lit(0).alias("len"), blank.alias("out"))

    def pair(a, b):
        return F.array(F.struct(a.cast("int").alias("i"), b.cast("int").alias("j")))

    def step(s, k):
        size = F.length(F.get(sents, k)["s"])
        total = s["len"] + size
        last = k == n - 1
        lone = s["i"] == k
        new = lambda i, ln, out: F.struct(F.cast(F.lit(0), "int").alias("i") if i is None else i.cast("int").alias("i"), ln.cast("int").alias("len"), out.alias("out"))
        grown = F.concat(s["out"], pair(s["i"], k + 1))
        return (F.when((total < target) & ~last, new(s["i"], total, s["out"]))
                .when(last, new(s["i"], total, grown))
                .when(lone, new(k + 1, F.lit(0), grown))
                .when(size >= target, new(k + 1, F.lit(0), F.concat(grown, pair(k, k + 1))))
                .otherwise(new(k, size, grown)))
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), state, step, lambda s: s["out"])).otherwise(blank)


def chunk_text(sents: Column, b: Column) -> Column:
    """The text of chunk b: sentences joined, those that begin a line after a line break."""
    part = F.slice(sents, b["i"] + 1, b["j"] - b["i"])
    return strip(F.array_join(F.transform(part, lambda s, k: F.when(s["first"] & (k > 0), F.concat(F.lit("\n"), s["s"])).otherwise(s["s"])), ""))


def chunk(sections: DataFrame, keys: list[str], text: str = "text", target: int = 400, profile: SentenceProfile = SentenceProfile()) -> DataFrame:
    """keys, piece, i, j, piece_text: the chunks of each row's text."""
    s = sections.select(*keys, sentences(F.col(text), profile).alias("ss"))
    out = s.select(*keys, "ss", F.posexplode(chunk_bounds(F.col("ss"), target)).alias("piece", "b"))
    return out.select(*keys, "piece", F.col("b.i").alias("i"), F.col("b.j").alias("j"), chunk_text(F.col("ss"), F.col("b")).alias("piece_text"))


def settle_short(pieces: DataFrame, doc: str, order: list[str], min_chars: int = 60, keep_short: bool = False) -> DataFrame:
    """Pieces in order, some of them title chunks (is_title): those under min_chars join the passage before them,
    and fall where a title or nothing is before them (keep_short keeps these as chunks of their own)."""
    w = Window.partitionBy(doc).orderBy(*order)
    emits = F.col("is_title") | (F.length("piece_text") >= min_chars)
    p = pieces.withColumn("_emits", emits).withColumn("_g", F.sum(F.col("_emits").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    head = F.max(F.when(F.col("_emits"), F.col("is_title"))).over(Window.partitionBy(doc, "_g"))
    p = p.withColumn("_title", head)
    lost = ~F.col("_emits") & F.coalesce(F.col("_title"), F.lit(True))
    if keep_short:
        p = p.withColumn("_g", F.sum((F.col("_emits") | lost).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        p = p.where(~lost)
    row = F.struct(*order, F.col("piece_text").alias("t"))
    heads = p.groupBy(doc, "_g").agg(
        *[F.min_by(c, F.struct(*order)).alias(c) for c in p.columns if c not in {doc, "_g", "_emits", "_title", "piece_text", *order}],
        F.min(F.struct(*order)).alias("_at"), F.array_join(F.transform(F.array_sort(F.collect_list(row)), lambda r: r["t"]), "\n").alias("text"))
    return heads.withColumn("chunk_no", (F.row_number().over(Window.partitionBy(doc).orderBy("_at")) - 1)).drop("_g", "_at")


def build_chunks(items: DataFrame, doc: str = "doc", target: int = 400, min_chars: int = 60, profile: SentenceProfile = SentenceProfile(), title_level: int = 3, keep_short: bool = False) -> DataFrame:
    """Items (doc, pos, kind, level, text, path, page) -> chunks (doc, chunk_no, is_title, level, section_path, page_no, text).

    Headings down to title_level give a title chunk each; figures are left out; the other items up to the next
    heading are one section, cut into sentence chunks. A section's page is its heading's page, or its first item's.
    """
    w = Window.partitionBy(doc).orderBy("pos")
    it = items.withColumn("_sec", F.coalesce(F.last(F.when(F.col("kind") == "heading", F.col("pos")), True).over(w), F.lit(-1)))
    titles = it.where((F.col("kind") == "heading") & (F.col("level") <= title_level)).select(
        doc, F.col("_sec"), F.lit(-1).alias("piece"), F.lit(True).alias("is_title"), "level", F.col("path").alias("section_path"), F.col("page").alias("page_no"), F.col("path").alias("piece_text"))
    body = it.where(F.col("kind").isin("para", "table"))
    sections = body.groupBy(doc, "_sec").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "\n").alias("text"),
        F.min_by("path", "pos").alias("first_path"), F.min_by("page", F.when(F.col("page").isNotNull(), F.col("pos"))).alias("first_page"))
    heads = it.where(F.col("kind") == "heading").select(doc, "_sec", F.col("path").alias("h_path"), F.col("page").alias("h_page"), F.lit(True).alias("_has"))
    sections = sections.join(heads, [doc, "_sec"], "left").select(
        doc, "_sec", F.coalesce("h_path", "first_path").alias("section_path"), F.coalesce("h_page", "first_page").alias("page_no"), "text")
    pieces = chunk(sections, [doc, "_sec", "section_path", "page_no"], "text", target, profile).select(
        doc, "_sec", "piece", F.lit(False).alias("is_title"), F.lit(None).cast("int").alias("level"), "section_path", "page_no", "piece_text")
    return settle_short(titles.unionByName(pieces), doc, ["_sec", "piece"], min_chars, keep_short)
