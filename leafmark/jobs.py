"""Batch jobs: ``python -m leafmark.jobs corpus|merge|slides|import ...``; each prints what it did and returns an exit code."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions.text import classify_course
from leafmark.operators import chunking, markdown, merging, retrieval
from leafmark.services import import_textbooks
from leafmark.sources import documents
from leafmark.sources.tables import stored


def corpus_job(spark: SparkSession, folder: str, out: str, course: str = "", books: list[str] | None = None, skip: str = "课件版") -> dict:
    """Chunks of a course's books (or of the named ones) as JSON, and statistics of them."""
    found = documents.read_books(spark, folder, course, "" if books else skip)
    if books:
        found = found.where(F.col("doc").isin(*books))
    c = chunking.build_chunks(markdown.parse_items(found, "doc"), "doc")
    c, _ = stored(spark, c.withColumn("pos", F.xxhash64("doc", "chunk_no")), "corpus")
    documents.save_corpus(c.drop("pos"), out)
    return retrieval.corpus_stats(retrieval.build_index(c, store=True)).first().asDict()


def merge_job(spark: SparkSession, pages: DataFrame, out: str, keep_toc: bool = False) -> list[dict]:
    """Books of pages (book, idx, text, page_no) as Markdown files in out; an error where there is nothing to merge."""
    if pages.where("trim(coalesce(text, '')) <> ''").limit(1).count() == 0:
        raise ValueError("no pages to merge")
    books, stats = merging.merge_pages(pages, "book", keep_toc)
    documents.write_books(books.select(F.col("book").cast("string").alias("doc"), "text"), out)
    return [r.asDict() for r in stats.orderBy("book").collect()]  # one row a book


def slides_job(spark: SparkSession, folder: str, out: str | None = None) -> list[tuple[str, int, int]]:
    """(name, lines before, lines after) of the slides cleaned; written to out, or in the place of the folder."""
    docs, _ = stored(spark, documents.read_books(spark, folder, "", ""), "slides")
    clean, _ = stored(spark, merging.clean_slides(docs, "doc"), "slides-clean")
    documents.write_books(clean, out or folder)
    size = lambda c: F.size(F.split(c, "\n"))
    both = docs.select("doc", size(F.col("text")).alias("n")).join(clean.select("doc", size(F.col("text")).alias("m")), "doc").orderBy("doc")
    return [tuple(r) for r in both.collect()]  # one row a file


def import_job(spark: SparkSession, folder: str, out: str, courses: dict[str, list[str]], course: str = "", dry_run: bool = False):
    """Import the files of a folder whose names tell a course (or that course): one Result for each course."""
    raw = spark.read.format("binaryFile").load(folder).select("path", "content")
    name = F.url_decode(F.regexp_extract("path", r"([^/]*)$", 1))
    told = raw.withColumn("course", classify_course(name, courses))
    return {c: import_textbooks(told.where(F.col("course") == c), c, f"{out}/{c}", dry_run) for c in courses if not course or c == course}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="leafmark.jobs")
    sub = p.add_subparsers(dest="job", required=True)
    for name in ("corpus", "merge", "slides"):
        s = sub.add_parser(name)
        s.add_argument("folder")
        s.add_argument("--out", required=name != "slides")
    sub.choices["corpus"].add_argument("--course", default="")
    sub.choices["corpus"].add_argument("--books", nargs="*")
    sub.choices["merge"].add_argument("--keep-toc", action="store_true")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    try:
        if a.job == "corpus":
            print(corpus_job(spark, a.folder, a.out, a.course, a.books))
        elif a.job == "merge":
            pages = spark.read.text(f"{a.folder}/*/*.md", wholetext=True).select(
                F.regexp_extract(F.url_decode(F.col("_metadata.file_path")), r"([^/]*)/[^/]*$", 1).alias("book"),
                F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)", 1).cast("long").alias("idx"), F.col("value").alias("text"), F.lit(None).cast("long").alias("page_no"))
            print(merge_job(spark, pages, a.out, a.keep_toc))
        else:
            print(slides_job(spark, a.folder, a.out))
    except Exception as e:  # noqa: BLE001  told to the caller by exit code
        print(f"{a.job}: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
