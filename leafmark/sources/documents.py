"""Document sources and sinks: Markdown folders, DOCX and PPTX (zip and XML of the standard library), corpora, templates."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.sources.tables import ship_package

# File types by converter, and the parts of office files.
TEXT_TYPES, OFFICE_TYPES = (".txt", ".md"), (".doc", ".ppt")
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_NUMBERED = re.compile(r"^(\d+(?:\.\d+)*)\s*(.*)$")
_CHAPTER = re.compile(r"^第\s*[0-9一二三四五六七八九十]+\s*章")


def read_books(spark: SparkSession, folder: str, course: str = "", skip: str = "课件") -> DataFrame:
    """(doc, path, text): the Markdown files whose names hold course and not skip, in order of name."""
    d = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
    d = d.withColumn("doc", F.regexp_extract(F.url_decode("path"), r"([^/]*)\.md$", 1)).where(F.col("doc").contains(course))
    return (d.where(~F.col("doc").contains(skip)) if skip else d).select("doc", "path", "text").orderBy("doc")


def find_book(books: DataFrame, name: str) -> DataFrame:
    """The book of that name, else the first in order of name that holds it."""
    return books.where(F.col("doc").contains(name)).orderBy(F.desc(F.col("doc") == name), "doc").limit(1)


def save_corpus(chunks: DataFrame, path: str) -> None:
    chunks.write.mode("overwrite").json(path)


def load_corpus(spark: SparkSession, path: str, schema=None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).json(path)


def page_meta(spark: SparkSession, path: str) -> DataFrame:
    """(idx, page_no, n_boxes, n_paras, n_tables, n_chars) of a meta file; a broken one gives no rows."""
    inner = "struct<page_no:int,n_boxes:int,n_paras:int,n_tables:int,n_chars:int>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{inner}>").alias("m"))
    return raw.where("m is not null").select(F.explode("m").alias("k", "v")).select(F.col("k").cast("int").alias("idx"), "v.*")


def docx_markdown(raw: bytes) -> str:
    """Headings, lists, emphasis and tables of a DOCX file as Markdown."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
        names = {}
        if "word/styles.xml" in z.namelist():
            for s in ElementTree.fromstring(z.read("word/styles.xml")).iter(f"{_W}style"):
                name = s.find(f"{_W}name")
                names[s.get(f"{_W}styleId")] = name.get(f"{_W}val", "") if name is not None else ""
    out = []

    def on(props, tag):
        e = props.find(f"{_W}{tag}") if props is not None else None
        return e is not None and e.get(f"{_W}val", "1") not in ("0", "false")

    def inline(p, marks=True):
        got = []
        for r in p.iter(f"{_W}r"):
            t = "".join((e.text or "") if e.tag == f"{_W}t" else "\t" if e.tag == f"{_W}tab" else "\n" if e.tag == f"{_W}br" else "" for e in r)
            stars = "*" * (2 * on(r.find(f"{_W}rPr"), "b") + on(r.find(f"{_W}rPr"), "i")) if t and marks else ""
            got.append(stars + t + stars)
        return "".join(got)
    for e in body if body is not None else ():
        if e.tag == f"{_W}p":
            text = inline(e)
            style = e.find(f"{_W}pPr/{_W}pStyle")
            key = style.get(f"{_W}val", "") if style is not None else ""
            name = (names.get(key) or key).lower()
            if not text.strip():
                continue
            if name.startswith("heading"):
                n = re.sub(r"\D", "", name)
                out.append("#" * min(max(int(n or 1), 1), 6) + " " + text)
            else:
                out.append("- " + text if name.startswith("list") else text)
        elif e.tag == f"{_W}tbl":
            rows = [["\n".join(inline(p, False) for p in c.iter(f"{_W}p")).strip().replace("\n", "<br>") for c in r.findall(f"{_W}tc")] for r in e.findall(f"{_W}tr")]
            if rows:
                line = lambda r: "| " + " | ".join(r) + " |"
                out.append("\n".join([line(rows[0]), "|" + "|".join(["---"] * len(rows[0])) + "|", *map(line, rows[1:])]))
    return "\n\n".join(out)


def pptx_markdown(raw: bytes) -> str:
    """Numbered headings once each, other text as paragraphs or list items by its indent."""
    out, seen = [], set()
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.sub(r"\D", "", n)))
        for name in slides:
            for p in ElementTree.fromstring(z.read(name)).iter(f"{_A}p"):
                text = "".join(t.text or "" for t in p.iter(f"{_A}t")).strip()
                props = p.find(f"{_A}pPr")
                indent = int(props.get("lvl", 0)) if props is not None else 0
                if not text:
                    continue
                m = _NUMBERED.match(text)
                dots = m[1].count(".") if m else 0
                chapter = bool(_CHAPTER.match(text))
                if len(text) <= 60 and (chapter or (dots and m[2].strip())):
                    key = " ".join(text.split())
                    if key not in seen:
                        seen.add(key)
                        out.append("#" * (1 if chapter else min(dots + 1, 4)) + " " + key)
                else:
                    out.append("  " * (indent - 1) + "- " + text if indent else text)
    return "\n\n".join(out)


def pdf_markdown(text: str) -> str:
    """Extracted PDF text with its heading lines marked."""
    head = re.compile(r"^第[0-9一二三四五六七八九十百]+[章节部分篇]|^(?!\d{4}\s*年)\d+(\.\d+){0,3}\s+[一-鿿A-Za-z]")
    return "\n".join(f"\n## {x.strip()}" if 0 < len(x.strip()) <= 60 and head.match(x.strip()) else x for x in text.splitlines())


def convert(files: DataFrame) -> DataFrame:
    """files (path, content) -> (path, ok, markdown, error): text is copied, DOCX and PPTX are read here; PDF needs pypdf
    where it is installed. A file that fails does not stop the others."""
    ship_package(files.sparkSession)

    def one(path: str, raw: bytes) -> str:
        kind = path[path.rfind("."):].lower() if "." in path else ""
        if kind in TEXT_TYPES:
            return bytes(raw).decode("utf-8")
        if kind == ".docx":
            return docx_markdown(bytes(raw))
        if kind == ".pptx":
            return pptx_markdown(bytes(raw))
        if kind == ".pdf":
            from pypdf import PdfReader

            text = "\n\n".join(t for p in PdfReader(io.BytesIO(bytes(raw))).pages if (t := p.extract_text()).strip())
            if not text.strip():
                raise ValueError("no text in the PDF")
            return pdf_markdown(text)
        raise ValueError(f"cannot convert {kind or 'a file without a type'}")

    def run(batches):
        for pdf in batches:
            rows = []
            for path, raw in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows.append((path, True, one(path, raw), None))
                except Exception as e:  # noqa: BLE001  reported in the row
                    rows.append((path, False, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "ok", "markdown", "error"])
    return files.select("path", "content").mapInPandas(run, "path string, ok boolean, markdown string, error string")


def markdown_docx(text: str) -> bytes:
    """A DOCX file of Markdown lines: headings to level 4, bullets, paragraphs, blanks."""
    body = []
    for raw in text.splitlines():
        s = raw.strip()
        m = re.match(r"^(#{1,6})\s+(.*)$", s)
        style, t = (f"Heading{min(len(m[1]), 4)}", m[2].strip()) if m else ("ListBullet", s[2:]) if s.startswith("- ") else ("", s)
        props = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
        run = f'<w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r>' if t else ""
        body.append(f"<w:p>{props}{run}</w:p>")
    styles = "".join(f'<w:style w:type="paragraph" w:styleId="Heading{k}"><w:name w:val="heading {k}"/></w:style>' for k in range(1, 5)) + '<w:style w:type="paragraph" w:styleId="ListBullet"><w:name w:val="List Bullet"/></w:style>'
    ns, head = f'xmlns:w="{_W[1:-1]}"', '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    kinds = "application/vnd.openxmlformats-officedocument.wordprocessingml."
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{kinds}document.main+xml"/><Override PartName="/word/styles.xml" ContentType="{kinds}styles+xml"/></Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="word/document.xml"/></Relationships>')
        z.writestr("word/_rels/document.xml.rels", f'{head}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("word/styles.xml", f"{head}<w:styles {ns}>{styles}</w:styles>")
        z.writestr("word/document.xml", f"{head}<w:document {ns}><w:body>{''.join(body)}</w:body></w:document>")
    return out.getvalue()


def bank_template(course: str, book: str) -> str:
    """An empty question bank with its three sections."""
    part = "### 1. …\n{opts}**答案**：…\n**解析**：…"
    sec = lambda n, name, opts: f"## {n}、{name}\n\n<!--\n{part.format(opts=opts)}\n-->\n"
    return f"# {course} 题库\n\n> {book}\n\n" + "\n".join([sec("一", "选择题", "- A. …\n- B. …\n- C. …\n- D. …\n"), sec("二", "填空题", ""), sec("三", "大题", "")])


# The number of a chapter in a file's name.
_FILE_CHAPTER = r"第(\d+)章"


def join_chapters(files: DataFrame) -> DataFrame:
    """files (name, markdown) -> one row (markdown): chapters in order of the number in their names, each under its heading;
    files without a number come last, as they are."""
    n = F.regexp_extract("name", _FILE_CHAPTER, 1)
    no = F.when(n != "", n.cast("int")).otherwise(99)
    part = F.when(n != "", F.concat(F.lit("# 第"), n, F.lit("章\n\n"), "markdown")).otherwise(F.col("markdown"))
    return files.select(no.alias("no"), "name", part.alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("no", "name", "part"))), lambda r: r["part"]), "\n\n").alias("markdown"))


def list_files(spark: SparkSession, folder: str, suffix: str, recursive: bool = True) -> DataFrame:
    """(path, name, course, modified): files of a suffix under a folder; course is the first folder on the way."""
    from leafmark.sources.tables import _fs_path

    schema = "path string, name string, course string, modified timestamp"
    fs, at = _fs_path(spark, folder)
    if not fs.exists(at):
        return spark.createDataFrame([], schema)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).option("pathGlobFilter", f"*{suffix}").load(folder)
    path = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    rest = F.element_at(F.split(path, F.concat(F.lit("/"), F.lit(folder.rstrip("/").rsplit("/", 1)[-1]), F.lit("/"))), -1)
    return raw.select(path.alias("path"), F.element_at(F.split(path, "/"), -1).alias("name"), F.when(rest.contains("/"), F.substring_index(rest, "/", 1)).otherwise("").alias("course"), F.col("modificationTime").alias("modified"))


def scan_banks(spark: SparkSession, folder: str) -> DataFrame:
    """(course, path, modified, text): the question banks of a folder, in order of name."""
    d = spark.read.text(f"{folder}/*.md", wholetext=True).select(F.url_decode(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("value").alias("text"))
    return d.withColumn("course", F.regexp_replace(F.regexp_extract("path", r"([^/]*)\.md$", 1), "-?题库$", "")).select("course", "path", "modified", "text").orderBy("path")


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Of what is wanted, the rows whose key is not there yet: pages still to be read, templates still to be written."""
    return wanted.join(there.select(key), key, "left_anti")


def page_cache(spark: SparkSession, folder: str, book: str) -> DataFrame:
    """(book, page, w, h, items) of cached detection boxes, one JSON file a page named by its number; a broken file gives no row,
    so that its page is read again."""
    boxes = "struct<w:double,h:double,items:array<struct<box:array<array<double>>,text:string,score:double>>>"
    raw = spark.read.text(f"{folder}/*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_name"), r"(\d+)\.json$", 1).alias("n"), F.from_json("value", boxes).alias("p"))
    points = F.transform("p.items", lambda it: F.struct(F.transform(it["box"], lambda x: F.struct(F.get(x, F.lit(0)).alias("x"), F.get(x, F.lit(1)).alias("y"))).alias("box"), it["text"].alias("text"), it["score"].alias("score")))
    return raw.where("n <> '' and p.w is not null and p.items is not null").select(F.lit(book).alias("book"), F.col("n").cast("int").alias("page"), "p.w", "p.h", points.alias("items"))


def pages_with_meta(pages: DataFrame, meta: DataFrame, keys: list[str]) -> DataFrame:
    """pages (keys, text) with what their meta (keys, page_no, ...) tells, null where there is none."""
    return pages.join(meta, keys, "left")


def meta_totals(meta: DataFrame, book: str = "book") -> DataFrame:
    """(book, pages, figures, tables, paras): sums over the meta of a book's pages (n_figures, n_tables, n_paras)."""
    return meta.groupBy(book).agg(F.count(F.lit(1)).alias("pages"), *[F.coalesce(F.sum(f"n_{c}"), F.lit(0)).alias(c) for c in ("figures", "tables", "paras")])


def save_meta(meta: DataFrame, path: str) -> None:
    meta.write.mode("overwrite").json(path)


def export_books(books: DataFrame) -> DataFrame:
    """(doc, docx): every book (doc, text) as a DOCX file."""
    ship_package(books.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf["doc"], "docx": [markdown_docx(t or "") for t in pdf["text"]]})
    return books.select("doc", "text").mapInPandas(run, "doc string, docx binary")


def read_wrong_book(spark: SparkSession, path: str) -> DataFrame:
    """The wrong-answer book (key, course, type, no, wrong_count, mastered); empty where nothing was written yet."""
    from leafmark.sources.tables import _fs_path

    schema = "key string, course string, type string, no int, wrong_count long, mastered boolean"
    fs, at = _fs_path(spark, path)
    return spark.read.schema(schema).json(path) if fs.exists(at) else spark.createDataFrame([], schema)


def write_wrong_book(book: DataFrame, path: str) -> None:
    """Put a new state in the book's place: written beside it first, since it may be made from the old one."""
    from leafmark.sources.tables import _fs_path

    fs, at = _fs_path(book.sparkSession, path)
    _, new = _fs_path(book.sparkSession, f"{path.rstrip('/')}.new")
    fs.delete(new, True)
    book.write.json(new.toString())
    fs.delete(at, True)
    if not fs.rename(new, at):
        raise OSError(f"cannot put {path} in place")


def reader_payload(sections: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row (json) for each book: its sections (doc, section_no, title, level) and chunks (doc, chunk_no, section_path, page_no,
    text), with "</" escaped so that it can stand in a script."""
    s = sections.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("section_no", "title", "level"))).alias("sections"))
    c = chunks.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "section_path", "page_no", "text"))).alias("chunks"))
    return s.join(c, "doc", "left").select("doc", F.replace(F.to_json(F.struct("doc", "sections", "chunks")), F.lit("</"), F.lit("<\\/")).alias("json"))


def reader_page(title: str, payloads: list[str]) -> str:
    """A single HTML file that shows the payloads' books; payloads are those of the books that a reader was asked for."""
    show = "for(const b of DATA){const h=document.createElement('h1');h.textContent=b.doc;document.body.append(h);for(const c of b.chunks||[]){const p=document.createElement('p');p.textContent=c.text;document.body.append(p);}}"
    return f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{escape(title)}</title></head><body><script>const DATA=[{','.join(payloads)}];{show}</script></body></html>"


def write_books(books: DataFrame, folder: str) -> int:
    """Books (doc, text) as Markdown files, one after the other; a file that is there is replaced. How many were written."""
    from leafmark.sources.tables import _fs_path

    n = 0
    for r in books.select("doc", "text").toLocalIterator():
        fs, at = _fs_path(books.sparkSession, f"{folder.rstrip('/')}/{r['doc']}.md")
        out = fs.create(at, True)
        out.write(bytearray((r["text"] or "").encode()))
        out.close()
        n += 1
    return n
