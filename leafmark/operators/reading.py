"""Sections of a book: blocks under a path, longest-prefix lookup, enclosing sections, trees, concepts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import TokenProfile, block_html, is_caption, lines, numbers_in, section_order, strip, tokens
from leafmark.sources.tables import stored


def section_blocks(items: DataFrame, targets: DataFrame, doc: str = "doc") -> DataFrame:
    """Items of each target (doc, target path): from the first heading of that path up to the next heading of its level or above."""
    heads = items.where("kind = 'heading'")
    start = heads.join(targets.select(doc, F.col("target").alias("path")), [doc, "path"]).groupBy(doc, F.col("path").alias("target")).agg(
        F.min("pos").alias("start"), F.min_by("level", "pos").alias("top"))
    end = start.join(heads.select(doc, "pos", "level"), doc).where("pos > start and level <= top").groupBy(doc, "target").agg(F.min("pos").alias("end"))
    span = start.join(end, [doc, "target"], "left")
    return items.join(span, doc).where("pos >= start and (end is null or pos < end)").select(
        doc, "target", "pos", "kind", "level", "text", *(["url"] if "url" in items.columns else []), "path", "page", is_caption(F.col("text")).alias("is_caption"))


def longest_prefix(paths: DataFrame, sections: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, path, section): the deepest section (doc, section) that is path or a leading part of it, else null."""
    parts = F.split("path", " > ")
    cand = paths.select(doc, "path", F.posexplode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), " > "))).alias("depth", "section"))
    hit = cand.join(sections.select(doc, "section").distinct(), [doc, "section"]).groupBy(doc, "path").agg(F.max_by("section", "depth").alias("section"))
    return paths.select(doc, "path").join(hit, [doc, "path"], "left")


def enclosing_sections(items: DataFrame, doc: str = "doc", level: int = 3, front: str = "（前言）") -> DataFrame:
    """Each item with the last heading of at most that level before it; items before any belong to the front matter."""
    w = Window.partitionBy(doc).orderBy("pos")
    opens = (F.col("kind") == "heading") & (F.col("level") <= level)
    s = items.withColumn("section_no", F.sum(opens.cast("int")).over(w))
    return s.withColumn("section", F.coalesce(F.last(F.when(opens, F.col("path")), True).over(w), F.lit(front)))


def reader_sections(items: DataFrame, doc: str = "doc") -> DataFrame:
    """One row per reader section: its number, path, and how many blocks, figures and tables it holds."""
    s = enclosing_sections(items, doc)
    return s.groupBy(doc, "section_no", "section").agg(
        F.count_if((F.col("kind") != "heading") | (F.col("level") > 3)).alias("blocks"), F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"))


def tree_paths(items: DataFrame, doc: str = "doc") -> DataFrame:
    """Knowledge tree as rows: (doc, pos, level, title, path, parent, sibling_key)."""
    h = items.where("kind = 'heading'")
    parts = F.split("path", " > ")
    return h.select(doc, "pos", "level", F.col("text").alias("title"), "path",
                    F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), " > ")).otherwise("").alias("parent"), numbers_in(F.col("text")).alias("sibling_key"))


def outline(items: DataFrame, doc: str = "doc") -> DataFrame:
    """Review outline: the paths of each book in order, in one row for each book."""
    return items.where("kind = 'heading'").groupBy(doc).agg(
        F.count(F.lit(1)).alias("n_paths"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "path"))), lambda x: x["path"]).alias("paths"))


def _is_word(stopwords: tuple[str, ...]):
    ok = (F.length("word") >= 2) & (F.length("word") <= 12) & F.col("word").rlike(r"[一-鿿A-Za-z]")
    return ok & ~F.col("word").isin(*stopwords) if stopwords else ok


def word_counts(texts: DataFrame, key: str, profile: TokenProfile = TokenProfile(), stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(key, word, n, pos): words of 2 to 12 characters with a letter, how often and in which text first. Sums of plain
    numbers, so they are hashed and not sorted."""
    t = texts.select(key, "pos", F.explode(tokens(F.col("text"), profile)).alias("word")).where(_is_word(stopwords))
    return t.groupBy(key, "word").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))


def top_concepts(texts: DataFrame, key: str, k: int = 12, profile: TokenProfile = TokenProfile(), stopwords: tuple[str, ...] = (), step: int = 512) -> DataFrame:
    """(key, rank, word, n): the k most frequent words of each key's texts, first seen first among equals, of 2 to 12
    characters with a letter; a word inside a longer word falls.

    Only the most frequent words of each key are looked for inside its other words (which offer their proper substrings of
    2 to 12 characters): step * k of them, and step times as many while some key has fewer than k left and more words.
    """
    spark, most = texts.sparkSession, step * k
    freq, _ = stored(spark, word_counts(texts, key, profile, stopwords), "word-counts")
    order = Window.partitionBy(key).orderBy(F.desc("n"), "pos")
    first = lambda df, m: df.withColumn("_r", F.rank().over(order)).where(F.col("_r") <= m).drop("_r")
    totals, _ = stored(spark, freq.groupBy(key).agg(F.count(F.lit(1)).alias("words")), "word-totals")
    size = F.length("word")
    inner = freq.where(size >= 3).select(key, "word", F.explode(F.sequence(F.lit(2), size - 1)).alias("_n")).select(
        key, "word", "_n", F.explode(F.sequence(F.lit(1), size - F.col("_n") + 1)).alias("_a")).select(key, F.substring("word", F.col("_a"), F.col("_n")).alias("word"))
    while True:
        candidates, _ = stored(spark, first(freq, most), "word-candidates")
        fallen = inner.join(candidates.select(key, "word"), [key, "word"], "left_semi").distinct()
        left, _ = stored(spark, candidates.join(fallen, [key, "word"], "left_anti"), "words-left")
        taken = candidates.groupBy(key).agg(F.count(F.lit(1)).alias("taken"))
        n_left = left.groupBy(key).agg(F.count(F.lit(1)).alias("n_left"))
        short = totals.join(taken, key).join(n_left, key, "left").where((F.col("taken") < F.col("words")) & (F.coalesce("n_left", F.lit(0)) < k))
        if short.isEmpty():
            break
        most *= max(step, 2)
    near, _ = stored(spark, first(left, k), "words-near")
    seen = texts.select(key, "pos", "text").join(near.select(key, "pos").distinct(), [key, "pos"], "left_semi").select(
        key, "pos", F.posexplode(tokens(F.col("text"), profile)).alias("at", "word")).join(near.select(key, "pos", "word"), [key, "pos", "word"], "left_semi")
    at = seen.groupBy(key, "word").agg(F.min("at").alias("at"))
    w = Window.partitionBy(key).orderBy(F.desc("n"), "pos", "at")
    return near.join(at, [key, "word"], "left").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(key, "rank", "word", "n")


def figure_placement(items: DataFrame, doc: str = "doc") -> DataFrame:
    """Quality of figures: how many have their caption as the next paragraph, on the same page."""
    w = Window.partitionBy(doc).orderBy("pos")
    nxt = items.select(doc, "pos", "kind", "text", "page", F.lead("kind").over(w).alias("k"), F.lead("text").over(w).alias("t"), F.lead("page").over(w).alias("p"))
    good = (F.col("k") == "para") & (F.col("t") == F.col("text")) & F.col("p").eqNullSafe(F.col("page"))
    return nxt.where("kind = 'figure'").groupBy(doc).agg(F.count(F.lit(1)).alias("figures"), F.count_if(F.coalesce(good, F.lit(False))).alias("placed"))


def section_concepts(docs: DataFrame, doc: str = "doc", text: str = "text", k: int = 12, profile: TokenProfile = TokenProfile(), stopwords: tuple[str, ...] = (), whole: str = "全章") -> DataFrame:
    """(doc, title, concepts): the key words of each section of Markdown text, most frequent first.

    Sections begin at headings of level 1 to 4; lines before any belong to `whole`. Of sections with the same title the last one
    with text counts; sections without text have no row.
    """
    w = Window.partitionBy(doc).orderBy("pos")
    ln = docs.select(doc, F.posexplode(lines(F.col(text))).alias("pos", "raw")).select(doc, "pos", "raw", strip(F.col("raw")).alias("s"))
    head = F.col("s").rlike(r"^#{1,4}\s+")
    ln = ln.withColumn("head", head).withColumn("seg", F.sum(head.cast("int")).over(w))
    ln = ln.withColumn("title", F.coalesce(F.last(F.when(head, strip(F.regexp_extract("s", r"^#{1,4}\s+(.*)$", 1))), True).over(w), F.lit(whole)))
    body = ln.where("not head and s <> ''")
    last = body.groupBy(doc, "title").agg(F.max("seg").alias("seg"))
    key = F.struct(doc, "title")
    used = body.join(last, [doc, "title", "seg"]).select(key.alias("key"), "pos", F.col("raw").alias("text"))
    top = top_concepts(used, "key", k, profile, stopwords)
    found = top.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda r: r["word"]).alias("concepts"))
    return last.select(key.alias("key")).join(found, "key", "left").select(f"key.{doc}", "key.title", F.coalesce("concepts", F.expr("array()").cast("array<string>")).alias("concepts"))


def tree_concepts(tree: DataFrame, concepts: DataFrame, doc: str = "doc") -> DataFrame:
    """Nodes of the knowledge tree with the key words of their title; none where the title has no section."""
    return tree.join(concepts.select(doc, "title", "concepts"), [doc, "title"], "left").withColumn("concepts", F.coalesce("concepts", F.expr("array()").cast("array<string>")))


def course_tree(tree: DataFrame, doc: str = "doc") -> DataFrame:
    """The trees of a course's books as one: every book is a root (level 0), siblings are numbered in order of their titles'
    numbers, then as they stand. Books without headings have no root."""
    nodes = tree.select(doc, "pos", "level", "title", F.concat(F.col(doc), F.lit(" > "), "path").alias("path"),
                        F.when(F.col("parent") == "", F.col(doc)).otherwise(F.concat(F.col(doc), F.lit(" > "), "parent")).alias("parent"))
    roots = tree.select(doc).distinct().select(doc, F.lit(-1).cast("long").alias("pos"), F.lit(0).alias("level"), F.col(doc).alias("title"), F.col(doc).alias("path"), F.lit("").alias("parent"))
    both = nodes.withColumn("pos", F.col("pos").cast("long")).unionByName(roots)
    return both.withColumn("sibling_no", F.row_number().over(Window.partitionBy(doc, "parent").orderBy(section_order(F.col("title")), "pos")))


def section_html(blocks: DataFrame, by: list[str], keys=None) -> DataFrame:
    """(by, html): blocks (by, pos, kind, level, text, url, page) rendered in order; keys are words to mark."""
    marks = F.array(*[F.lit(k) for k in keys]) if keys else F.expr("array()").cast("array<string>")
    html = block_html(*[F.col(c) for c in ("kind", "level", "text", "url", "page")], marks)
    b = blocks.withColumn("html", html).where("html <> ''")
    return b.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "html"))), lambda r: r["html"]), "\n").alias("html"))


def reader_stats(items: DataFrame, chunks: DataFrame, doc: str = "doc", profile: TokenProfile = TokenProfile()) -> DataFrame:
    """One row for each book: sections, chunks, figures, tables, vocabulary and pages that its reader shows."""
    s = enclosing_sections(items, doc).groupBy(doc).agg(
        F.countDistinct("section_no").alias("sections"), F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if(F.col("kind") == "table").alias("tables"), F.countDistinct("page").alias("pages"))
    c = chunks.where("not is_title").groupBy(doc).agg(F.count(F.lit(1)).alias("chunks"))
    v = chunks.select(doc, F.explode(tokens(F.col("text"), profile)).alias("term")).distinct().groupBy(doc).agg(F.count(F.lit(1)).alias("vocab"))
    return s.join(c, doc, "left").join(v, doc, "left").na.fill(0, ["chunks", "vocab"])


def table_quality(items: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, tables, sound): tables, and those of two rows or more that all have the same number of columns, two or more."""
    rows = F.filter(F.transform(lines(F.col("text")), strip), lambda r: r.startswith("|"))
    sizes = F.transform(rows, lambda r: F.size(F.split(F.regexp_replace(r, r"^\|+|(?<!\\)\|+$", ""), r"(?<!\\)\|")))
    good = (F.size(sizes) >= 2) & (F.size(F.array_distinct(sizes)) == 1) & (F.get(sizes, F.lit(0)) >= 2)
    return items.where("kind = 'table'").groupBy(doc).agg(F.count(F.lit(1)).alias("tables"), F.count_if(good).alias("sound"))


def evidence(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(qid, rank, content, doc_title, section_path, page_no, score): answers with the whole text of their chunks."""
    return hits.join(chunks.select("pos", F.col("text").alias("content"), F.col("doc").alias("doc_title"), "section_path", "page_no"), "pos").select(
        "qid", "rank", "content", "doc_title", "section_path", "page_no", "score")
