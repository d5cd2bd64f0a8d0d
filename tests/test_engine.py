"""The engine's operators against plain-Python specifications, on random and hand-made inputs."""

import io
import random
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.operators import chunking, layout, markdown, merging, practice, reading, retrieval
from leafmark.services import Library, Result, practice_session
from leafmark.sources import documents
from leafmark.streaming import wrong_book as stream


def spec_bounds(sizes, target, overlap=1):
    out, i, n = [], 0, len(sizes)
    while i < n:
        j, total = i, 0
        while j < n and total < target:
            total += sizes[j]
            j += 1
        out.append((i, j))
        if j >= n:
            break
        i = max(i + 1, j - overlap)
    return out


def test_chunk_bounds(spark):
    r = random.Random(1)
    docs = []
    for k in range(60):
        docs.append((k, "\n".join(" ".join("w" * r.randint(1, 90) + r.choice(".!?") for _ in range(r.randint(1, 6))) for _ in range(r.randint(0, 8)))))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {}
    for x in chunking.chunk(df, ["doc_id"], "text", 120, T.LATIN).collect():
        got.setdefault(x.doc_id, []).append((x.i, x.j))
    for k, t in docs:
        sents = [s.strip() for line in t.split("\n") for s in re.findall(r"[^.!?;]*[.!?;]|[^.!?;]+", line.strip()) if s.strip()]
        assert sorted(got.get(k, [])) == spec_bounds([len(s) for s in sents], 120)


def spec_paths(heads):
    stack, out = [], []
    for level, title in heads:
        while stack and stack[-1][0] >= level:
            stack.pop()
        m = re.match(T.LEAD_CHAPTER, title)
        if not stack and m:
            stack.append((1, f"第{m[1]}章"))
        stack.append((level, title))
        out.append(" > ".join(t for _, t in stack))
    return out


def test_heading_paths(spark):
    r = random.Random(2)
    books = {k: [(r.randint(1, 4), r.choice(["5.8 x", "Intro", "6.1 y", "Z", "12．q"]) + str(i)) for i in range(r.randint(1, 14))] for k in range(80)}
    rows = [(k, i, lv, t) for k, h in books.items() for i, (lv, t) in enumerate(h)]
    got = {(x.doc, x.pos): x.path for x in markdown.heading_paths(spark.createDataFrame(rows, "doc long, pos long, level int, title string"), "doc").collect()}
    for k, h in books.items():
        assert [got[k, i] for i in range(len(h))] == spec_paths(h)


def test_short_pieces(spark):
    r = random.Random(3)
    want, rows = {}, []
    for k in range(60):
        out = []
        for i in range(r.randint(1, 12)):
            title, t = r.random() < 0.3, "x" * r.randint(1, 20)
            rows.append((k, i, title, t))
            if title or len(t) >= 10:
                out.append([title, t])
            elif out and not out[-1][0]:
                out[-1][1] += "\n" + t
        want[k] = [t for _, t in out]
    got = {}
    for x in chunking.settle_short(spark.createDataFrame(rows, "doc long, n int, is_title boolean, piece_text string"), "doc", ["n"], 10).orderBy("doc", "chunk_no").collect():
        got.setdefault(x.doc, []).append(x.text)
    assert {k: v for k, v in want.items() if v} == got


def test_search_statuses(spark):
    corpus = [(i, f"water river word{i} common", False, None) for i in range(6)] + [(6, "only here once rare", False, None), (100, "River Basics", True, 2)]
    index = retrieval.build_index(spark.createDataFrame(corpus, "pos long, text string, is_title boolean, level int"))
    q = [(1, "river"), (2, ""), (3, "absent"), (4, "rare once"), (5, "water word3"), (6, "word1 word2 common water"), (7, "word1 absent common")]
    got = {x.qid: x for x in retrieval.search(index, spark.createDataFrame(q, "qid long, query string")).collect()}
    assert [got[k].status for k in range(1, 8)] == ["ok", "empty_query", "not_found", "not_found", "ok", "ok", "ok"]
    assert got[5].relax_rounds == 0 and got[5].n_passages == 1 and got[6].relax_rounds == 1 and got[7].missing_tokens == ["absent"]
    assert got[1].n_sections == 1


def spec_slides(text):
    lines, out, blank = text.splitlines(), [], False
    for x in lines:
        if x.strip() or not blank:
            out.append(x.rstrip())
        blank = not x.strip()
    lab = lambda s: bool(re.match(T.HEADING_STOPS, s)) is False and bool(re.fullmatch(merging.SHORT_LABEL[1:-1], s))
    res, i = [], 0
    while i < len(out):
        if lab(out[i].strip()):
            j, g = i, []
            while j < len(out) and (not out[j].strip() or lab(out[j].strip())):
                if out[j].strip():
                    g.append(out[j].strip())
                j += 1
            res.append("、".join(list(dict.fromkeys(g))[:10]))
            i = j
        else:
            res.append(out[i])
            i += 1
    return "\n".join(res)


def test_slides(spark):
    r = random.Random(4)
    docs = [(k, "\n".join(r.choice(["", " ", "ab", "cd", "# h", "- i", "a longer line, here", "标签"]) for _ in range(r.randint(1, 25)))) for k in range(80)]
    got = {x.d: x.text for x in merging.clean_slides(spark.createDataFrame(docs, "d long, text string"), "d").collect()}
    for k, t in docs:
        assert got[k].rstrip("\n") == spec_slides(t).rstrip("\n")


def test_merge(spark):
    toc = "\n".join(f"## 1.{k}x" for k in range(9))
    pages = [("b", 0, "first page text", 11), ("b", 1, toc, 12), ("b", 2, "", 13), ("b", 3, "text", 901), ("b", 4, "附录A 解答\n# 第1章\nx\n# 第2章", None)]
    books, stats = merging.merge_pages(spark.createDataFrame(pages, "book string, idx long, text string, page_no long"))
    b, s = books.first(), stats.first()
    assert b.text == "<!-- page 11 -->\n\nfirst page text\n\n<!-- page 14 -->\n\ntext\n\n<!-- page 15 -->\n\n# 附录A 解答\n## 第1章\nx\n## 第2章"
    assert (b.appendix_subs, s.pages, s.empty, s.toc_dropped, s.pageno_fixed, s.page_min, s.page_max) == (2, 5, 1, 1, 1, 11, 15)


BANK = "# t\n## 一、选择题\n### 1. Which\none?\n- A. x\n- B. y\n**答案**：B\n**解析**：because\nmore\n### 2. Two\n## 二、填空题\n### 1. Fill ____\n**答案**：TCP\n"


def test_bank_and_grading(spark):
    q = practice.parse_bank(spark.createDataFrame([("net", BANK)], "course string, text string")).orderBy("pos").collect()
    assert [(x.no, x.type, x.stem, x.options, x.answer, x.explanation) for x in q] == [
        (1, "选择题", "Which one?", ["A. x", "B. y"], "B", "because"), (2, "选择题", "Two", [], "", ""), (1, "填空题", "Fill ____", [], "TCP", "")]
    a = spark.createDataFrame([(1, "选择题", ["A. x"], "B", " b "), (2, "选择题", ["A. x"], "", "b"), (3, "填空题", [], "TCP", "对"), (4, "填空题", [], "TCP", "tcp")], "k int, type string, options array<string>, answer string, user_answer string")
    assert [(x.auto, x.correct) for x in practice.grade(a).orderBy("k").collect()] == [(True, True), (True, False), (False, True), (False, False)]


def test_wrong_book_closed_form_is_the_fold(spark):
    r = random.Random(6)
    hist = [(k, t, r.random() < 0.5) for k in range(40) for t in range(r.randint(1, 9))]
    df = spark.createDataFrame(hist, "key long, ts long, correct boolean")
    for counting in (False, True):
        got = {x.key: x.wrong_count for x in practice.wrong_book(df, ["key"], ["ts"], counting).collect()}
        want = {k: stream.fold(0, [c for kk, _, c in hist if kk == k], counting) for k in range(40)}
        assert got == {k: n for k, n in want.items() if n}


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    for k, rows in enumerate([[("a", 1, False), ("b", 1, True)], [("a", 2, False), ("b", 2, False)], [("a", 3, True)]]):
        spark.createDataFrame(rows, "key string, ts long, correct boolean").coalesce(1).write.mode("append").parquet(str(src / f"p={k}"))
    s = spark.readStream.schema("key string, ts long, correct boolean").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream.wrong_book_stream(s, counting=True).writeStream.outputMode("update").format("memory").queryName("wrongs").start()
    q.processAllAvailable()
    q.stop()
    rows = [tuple(x) for x in spark.sql("select key, in_book, wrong_count from wrongs").collect()]
    assert rows and {k for k, *_ in rows} == {"a", "b"}


def box(x0, y0, w, h, t):
    return {"box": [{"x": float(x), "y": float(y)} for x, y in ((x0, y0), (x0 + w, y0), (x0 + w, y0 + h), (x0, y0 + h))], "text": t, "score": 0.9}


def test_layout(spark):
    items = [box(150, 100, 400, 30, "第2章 物理层"), box(210, 160, 1090, 30, "正文第一行从这里开始一直排到右页边"), box(150, 200, 1150, 30, "第二行也排满"), box(150, 240, 300, 30, "到此结束。"),
             box(500, 400, 60, 20, "报文"), box(500, 470, 60, 20, "首部"), box(560, 600, 320, 30, "图2-1数据通信系统"),
             *[box(x, y, 120, 30, f"c{x}{y}") for y in (700, 740, 780) for x in (200, 500, 800)],
             box(1200, 300, 60, 30, "边栏"), box(700, 1950, 40, 20, "· 37 ·"), box(10, 10, 5, 5, " ")]
    df = spark.createDataFrame([("b", 1, 1450.0, 2000.0, items)], "book string, page int, w double, h double, items array<struct<box:array<struct<x:double,y:double>>,text:string,score:double>>")
    r = layout.restore_pages(layout.boxes_of(df), "f/p{page}_{k}.png").first()
    assert r.page_no == 37 and r.dropped == ["边栏"] and sorted(r.figure_text) == ["报文", "首部"] and r.n_tables == 1
    assert r.markdown.split("\n\n")[:4] == ["# 第2章 物理层", "正文第一行从这里开始一直排到右页边第二行也排满到此结束。", "![图2-1数据通信系统](f/p1_1.png)", "图2-1数据通信系统"]
    assert "| c200700 | c500700 | c800700 |\n| --- | --- | --- |" in r.markdown
    ins = lambda md: spark.range(1).select(layout.insert_figure(F.lit(md), F.lit("cap"), F.lit("u")).alias("m")).first().m
    assert ins("a cap b") == "a\n\n![cap](u)\n\ncap\n\nb" and ins("x\n\ncap\n\ny cap") == "x\n\n![cap](u)\n\ncap\n\ny cap" and ins("x") == "x\n\n![cap](u)\n\n"


def test_documents(spark):
    md = "# One\n\ntext & more\n\n- item"
    raw = documents.markdown_docx(md)
    assert documents.docx_markdown(raw) == "# One\n\ntext & more\n\n- item"
    slide = '<p xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main">' + "".join(f'<a:p><a:pPr lvl="{k}"/><a:r><a:t>{t}</a:t></a:r></a:p>' for k, t in ((0, "1.1   Basics"), (0, "body"), (2, "deep"), (0, "1.1 Basics"))) + "</p>"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide1.xml", slide)
    assert documents.pptx_markdown(out.getvalue()) == "## 1.1 Basics\n\nbody\n\n  - deep"
    files = spark.createDataFrame([("a.md", bytearray(b"hi")), ("b.docx", bytearray(raw)), ("c.docx", bytearray(b"no")), ("d.xyz", bytearray(b""))], "path string, content binary")
    got = {x.path: x for x in documents.convert(files).collect()}
    assert [got[k].ok for k in ("a.md", "b.docx", "c.docx", "d.xyz")] == [True, True, False, False] and got["a.md"].markdown == "hi"
    assert documents.pdf_markdown("1.2 Title\n2024 年\nx") == "\n## 1.2 Title\n2024 年\nx"
    banks = practice.parse_bank(spark.createDataFrame([("c", documents.bank_template("c", "b"))], "course string, text string"))
    assert {x.type for x in banks.collect()} == {"选择题", "填空题", "大题"}


def test_library(spark, tmp_path):
    (tmp_path / "net.md").write_text("# 1. Net\n\n## Layers\n\nThe link layer moves frames over a wire between two stations that share it.\n\n## Routing\n\nRouters move packets between many networks, hop by hop, each by its own table.\n", encoding="utf-8")
    (tmp_path / "net课件.md").write_text("# skip\n", encoding="utf-8")
    books = documents.read_books(spark, str(tmp_path), "net")
    lib = Library(spark, books)
    r = lib.explain_topic("frames")
    assert r.success and r.data["status"] == "ok" and r.data["passages"][0]["section_path"].endswith("Layers")
    assert lib.explain_topic("zzz").data["status"] == "not_found" and lib.course_tree().data.count() == 3
    assert lib.section("net", "第1章 > 1. Net > Layers").data.count() == 2 and documents.find_book(books, "ne").first().doc == "net"
    q = spark.createDataFrame([("net", "选择题", k) for k in range(30)], "course string, type string, no int")
    assert practice_session(q, "net").data.count() == 10 and not practice_session(q, "x").success and Result.fail("e").error == "e"


def test_rendering(spark):
    d = spark.createDataFrame([("| a | b |\n| --- | :-: |\n| 1 < 2 | x |", "Tom & tom.")], "t string, s string")
    x = d.select(T.table_html(F.col("t")).alias("h"), T.highlight(F.col("s"), F.array(F.lit("tom"), F.lit("x"))).alias("m"), T.section_title(F.lit("a > b > ")).alias("e")).first()
    assert x.h == "<table><tr><th>a</th><th>b</th></tr><tr><td>1 &lt; 2</td><td>x</td></tr></table>" and x.m.count("<span") == 2 and "&amp;" in x.m and x.e == "b"


def test_concepts(spark):
    d = spark.createDataFrame([("k", 0, "water waterfall waterfall river river river a 123")], "key string, pos long, text string")
    assert [(x.word, x.n) for x in reading.top_concepts(d, "key").orderBy("rank").collect()] == [("river", 3), ("waterfall", 2)]


@pytest.mark.parametrize("name", ["bm25_topk", "df_histogram", "wrong_book", "dashboard", "page_offset"])
def test_queries_run(spark, name):
    import __spark_entry__ as e

    assert e.queries()[name](spark, e.SMALL).count() >= 0
