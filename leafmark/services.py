"""Results for applications: what the engine's operators answer, as success or failure with a message."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.functions import segment
from leafmark.functions.text import section_title
from leafmark.operators import chunking, markdown, practice, reading, retrieval
from leafmark.sources import documents
from leafmark.sources.tables import stored


@dataclass(frozen=True)
class Result:
    success: bool
    data: Any = None
    error: str = ""
    message: str = ""

    @classmethod
    def ok(cls, data, message: str = "") -> Result:
        return cls(True, data, "", message)

    @classmethod
    def fail(cls, error: str, message: str = "", data=None) -> Result:
        return cls(False, data, error, message)


class Library:
    """Books (doc, text) of one course with their items, chunks and index; refresh() after the books change.

    With a vocabulary (term) texts and queries are cut by the longest match, as CJK text needs.
    """

    def __init__(self, spark: SparkSession, books: DataFrame, target: int = 400, min_chars: int = 60, vocabulary: DataFrame | None = None):
        self.spark, self.books, self.vocabulary = spark, books, vocabulary
        self.target, self.min_chars = target, min_chars
        self._index = self._items = self._corpus = None

    @property
    def items(self) -> DataFrame:
        if self._items is None:
            self._items = stored(self.spark, markdown.parse_items(self.books, "doc"), "items")[0]
        return self._items

    def corpus(self) -> DataFrame:
        if self._corpus is None:
            c = chunking.build_chunks(self.items, "doc", self.target, self.min_chars)
            # only the distinct names of books are ranked in one place
            ranks = self.books.select("doc").distinct().select("doc", F.row_number().over(Window.orderBy("doc")).alias("book_no"))
            c = c.join(ranks, "doc").withColumn("pos", F.col("book_no") * F.lit(1_000_000_000) + F.col("chunk_no")).drop("book_no")
            self._corpus = stored(self.spark, c, "corpus")[0]
        return self._corpus

    def _cut(self, df: DataFrame, key: str, text: str) -> DataFrame:
        if self.vocabulary is None:
            return df
        t = segment.segment(df.select(key, text), self.vocabulary, key, text)
        return df.join(t.withColumn("terms", segment.content_terms(F.col("terms"))), key)

    def warm_up(self) -> Result:
        self._index = retrieval.build_index(self._cut(self.corpus(), "pos", "text"), store=True)
        return Result.ok(self._index.totals.first()["n"])

    def refresh(self) -> None:
        if self._index is not None:
            self._index.drop()
        self._index = self._items = self._corpus = None

    def _ready(self) -> bool:
        return self._index is not None or bool(self.warm_up().data)

    def explain_topic(self, query: str, k: int = 5) -> Result:
        """not_found and empty_query are successful answers; a library without text is a failure."""
        if not self._ready():
            return Result.fail("no_corpus", "the course has no text")
        q = self._cut(self.spark.createDataFrame([(0, query)], "qid long, query string"), "qid", "query")
        head = retrieval.search(self._index, q, k=k).first().asDict()
        hits = retrieval.search_hits(self._index, q, k=k).join(self._index.corpus, "pos").orderBy("kind", "rank")
        got = [r.asDict() for r in hits.select("kind", "rank", "score", "doc", "section_path", "page_no", "text").collect()]  # at most 2k rows
        return Result.ok(head | {"sections": [h for h in got if h["kind"] == "section"], "passages": [h for h in got if h["kind"] == "passage"]}, head["message"])

    def section_content(self, path: str, k: int = 3) -> Result:
        """The passages that answer best to a section's title: the last part of its path is the query."""
        tail = (path or "").split(" > ")[-1].strip()
        if not tail:
            return Result.fail("no_path", "the section has no path")
        if not self._ready():
            return Result.ok([], "the course has no text")
        q = self._cut(self.spark.createDataFrame([(0, tail)], "qid long, query string"), "qid", "query")
        hits = retrieval.search_hits(self._index, q, k=k).where("kind = 'passage'")
        got = [r.asDict() for r in reading.evidence(hits, self._index.corpus).orderBy("rank").drop("qid").collect()]  # at most k rows
        return Result.ok(got, f"{len(got)} passages" if got else "the section has no text of its own")

    def course_tree(self, concepts: bool = False) -> Result:
        tree = reading.tree_paths(self.items)
        return Result.ok(reading.tree_concepts(tree, reading.section_concepts(self.books)) if concepts else tree)

    def whole_tree(self) -> Result:
        """All books as one tree, each a root."""
        return Result.ok(reading.course_tree(reading.tree_paths(self.items)))

    def section(self, doc: str, path: str) -> Result:
        """Blocks of a section in order; without a path the book's headings, without a book the first one that has the path."""
        if not doc:
            held = self.items.where((F.col("kind") == "heading") & (F.col("path") == path)) if path else self.items
            doc = held.agg(F.min("doc")).first()[0] or ""
        if not path:
            heads = self.items.where((F.col("doc") == doc) & (F.col("kind") == "heading"))
            return Result.ok(heads.withColumn("title", F.col("text")).orderBy("pos"))
        blocks = reading.section_blocks(self.items, self.spark.createDataFrame([(doc, path)], "doc string, target string"))
        return Result.ok(blocks.withColumn("title", section_title(F.col("target"))).orderBy("pos"))

    def section_page(self, doc: str, path: str, marks: tuple[str, ...] = ()) -> Result:
        """A section's HTML, its blocks in the book's order."""
        if not path:
            return Result.fail("no_path", "the section has no path")
        row = reading.section_html(self.section(doc, path).data, ["doc", "target"], marks).first()
        return Result.ok(row["html"] if row else "", "" if row else "the section has no text of its own")

    def outline(self) -> Result:
        return Result.ok(reading.outline(self.items))

    def counts(self) -> Result:
        """(doc, n_chunks) of every book."""
        return Result.ok(self.corpus().groupBy("doc").agg(F.count(F.lit(1)).alias("n_chunks")))


def _outcomes(got: DataFrame, course: str, count: bool) -> list[dict]:
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    out = got.withColumn("name", name).withColumn("chunks", F.lit(0).cast("long"))
    if count:
        books = got.where("ok").select(F.col("path").alias("doc"), F.col("markdown").alias("text"))
        n = chunking.build_chunks(markdown.parse_items(books, "doc"), "doc").groupBy("doc").agg(F.count(F.lit(1)).alias("n"))
        out = out.join(n.withColumnRenamed("doc", "path"), "path", "left").withColumn("chunks", F.coalesce("n", F.lit(0)))
    rows = out.select("name", "ok", "error", "chunks", F.lit(course).alias("course")).orderBy("name")
    return [r.asDict() for r in rows.collect()]  # one short row for each file that a user chose


def import_textbooks(files: DataFrame, course: str, folder: str | None = None, dry_run: bool = False) -> Result:
    """Convert files (path, content) to Markdown and count their chunks: success while any file is converted. The Markdown
    goes to folder, unless dry_run."""
    return _import(files, course, folder, dry_run, True)


def import_courseware(files: DataFrame, course: str, folder: str | None = None) -> Result:
    """Archive files as Markdown without chunks; where all fail no outcomes are given."""
    r = _import(files, course, folder, False, False)
    return r if r.success else Result.fail(r.error, r.message)


def _import(files: DataFrame, course: str, folder: str | None, dry_run: bool, count: bool) -> Result:
    if files.limit(1).count() == 0:
        return Result.fail("no_files", "choose files first")
    got, _ = stored(files.sparkSession, documents.convert(files), "converted")
    rows = _outcomes(got, course, count)
    good = sum(r["ok"] for r in rows)
    if folder and good and not dry_run:
        documents.write_books(got.where("ok").select(F.regexp_extract("path", r"([^/]*?)(?:\.[^./]*)?$", 1).alias("doc"), F.col("markdown").alias("text")), folder)
    if not good:
        return Result.fail("all_failed", f"all {len(rows)} files failed", rows)
    return Result.ok(rows, f"{good} files" if good == len(rows) else f"{good} files, {len(rows) - good} failed")


def export_textbooks(books: DataFrame) -> Result:
    """Every book as DOCX: (doc, docx) rows."""
    if books.limit(1).count() == 0:
        return Result.ok(None, "there are no books")
    return Result.ok(documents.export_books(books))


def bank_templates(courses: dict[str, str], there: DataFrame) -> Result:
    """(course, text) of the question banks that are not there (course) yet."""
    spark = there.sparkSession
    wanted = spark.createDataFrame([(c, documents.bank_template(c, b)) for c, b in courses.items()], "course string, text string")
    new = documents.missing(wanted, there, "course")
    n = new.count()
    return Result.ok(new, f"{n} new banks" if n else "all banks are there")


def practice_session(questions: DataFrame, course: str, seed: str = "0", quota: dict[str, int] | None = None) -> Result:
    if not course:
        return Result.fail("no_course", "choose a course first")
    q = questions.where(F.col("course") == course)
    if q.limit(1).count() == 0:
        return Result.fail("no_questions", "the bank has no questions for this course")
    return Result.ok(practice.sample_questions(q, ["type"], F.col("no"), quota or practice.QUOTA, seed))


def chapter_session(questions: DataFrame, course: str, keyword: str, seed: str = "0") -> Result:
    """The course's questions of a chapter in random order."""
    q = practice.chapter_questions(questions.where(F.col("course") == course), keyword)
    return Result.ok(practice.shuffled(q, F.concat_ws(":", "type", "no"), seed))


def wrong_list(book: DataFrame, course: str = "") -> Result:
    got = practice.unmastered(book, course)
    n = got.count()
    return Result.ok(got, f"{n} wrong questions" if n else "no wrong questions yet")


def wrong_session(book: DataFrame, questions: DataFrame, course: str = "", seed: str = "0") -> Result:
    """Wrong questions of a course, or all, to be asked again in random order."""
    q = practice.wrong_review(practice.unmastered(book, course), questions)
    got = practice.shuffled(q, F.concat_ws(":", "course", "type", "no"), seed)
    return Result.ok(got, "" if got.limit(1).count() else "no wrong questions to repeat")


def dashboard(chunks: DataFrame, questions: DataFrame, wrong: DataFrame, documents_made: int = 0, archived: int = 0) -> Result:
    """Counts by course (course, n) of three sources side by side, and their totals."""
    board = practice.dashboard(chunks, questions, wrong)
    return Result.ok({"courses": board, "totals": practice.kpis(board, documents_made, archived)})
