"""Services, sources, jobs and streams on small inputs made here."""

import io
import json
import random
import zipfile

from pyspark.sql import functions as F

from leafmark import jobs, services
from leafmark.functions import segment
from leafmark.functions import text as T
from leafmark.operators import practice, reading, retrieval
from leafmark.sources import documents, fixtures
from leafmark.streaming import wrong_book as stream

BOOK = """# 1. Net

## Layers

Of all layers the link layer moves frames over a wire between two stations that share it, one frame after the other.

| a | b |
| --- | --- |
| 1 \\| 2 | x |

![图1-1 wire](img/w.png)

图1-1 wire

## Routing

Routers move packets between many networks, hop by hop, each by its own table of routes.
"""


def test_services(spark, tmp_path):
    lib = services.Library(spark, spark.createDataFrame([("net", BOOK)], "doc string, text string"))
    got = lib.section_content("x > Layers")
    assert got.success and got.data[0]["section_path"].endswith("Layers") and "frames" in got.data[0]["content"]
    assert not lib.section_content(" ").success and lib.counts().data.first().n_chunks == 5
    path = "第1章 > 1. Net > Layers"
    html = lib.section_page("", path, ("frames",)).data
    assert html.index("<h4>Layers") < html.index("<table>") < html.index("img/w.png") < html.index('class="caption"') and "<td>1 | 2</td>" in html and html.count("<span") == 1
    assert [r.title for r in lib.section("net", "").data.collect()] == ["1. Net", "Layers", "Routing"]
    tree = {r.title: r for r in lib.course_tree(concepts=True).data.collect()}
    assert tree["Layers"].concepts and not tree["1. Net"].concepts
    whole = {r.path: r.sibling_no for r in lib.whole_tree().data.collect()}
    assert whole["net"] == 1 and whole["net > 第1章 > 1. Net > Routing"] == 2
    lib.refresh()
    assert services.Library(spark, spark.createDataFrame([], "doc string, text string")).explain_topic("x").error == "no_corpus"


def test_imports(spark, tmp_path):
    schema = "path string, content binary"
    files = spark.createDataFrame([("in/net.md", bytearray(BOOK.encode())), ("in/bad.docx", bytearray(b"no"))], schema)
    r = services.import_textbooks(files, "net", str(tmp_path / "md"))
    assert r.success and {x["name"]: (x["ok"], x["chunks"]) for x in r.data} == {"net.md": (True, 5), "bad.docx": (False, 0)}
    assert documents.read_books(spark, str(tmp_path / "md")).first().text.startswith("# 1. Net")
    bad = files.where("path like '%bad%'")
    assert services.import_textbooks(bad, "net").data and services.import_courseware(bad, "net").data is None
    assert services.import_courseware(files.limit(0), "net").error == "no_files" and services.import_courseware(files, "net").success
    assert services.import_textbooks(files, "net", str(tmp_path / "dry"), dry_run=True).success and not (tmp_path / "dry").exists()
    raw = services.export_textbooks(documents.read_books(spark, str(tmp_path / "md"))).data.first().docx
    assert "# 1. Net" in documents.docx_markdown(bytes(raw))
    there = spark.createDataFrame([("net",)], "course string")
    assert [x.course for x in services.bank_templates({"net": "b", "os": "c"}, there).data.collect()] == ["os"]
    with zipfile.ZipFile(tmp_path / "a+b.docx", "w") as z:
        z.writestr("x", "y")
    (tmp_path / "net").mkdir()
    (tmp_path / "net" / "note 1.docx").write_bytes(b"x")
    assert {(x.name, x.course) for x in documents.list_files(spark, str(tmp_path), ".docx").collect()} == {("a+b.docx", ""), ("note 1.docx", "net")}
    assert documents.list_files(spark, str(tmp_path / "none"), ".docx").count() == 0
    slides = spark.createDataFrame([("第10章 z.pptx", "ten"), ("第2章 y.pptx", "two"), ("notes.pptx", "last")], "name string, markdown string")
    assert documents.join_chapters(slides).first().markdown == "# 第2章\n\ntwo\n\n# 第10章\n\nten\n\nlast"


def test_practice_services(spark, tmp_path):
    (tmp_path / "net-题库.md").write_text("## 一、选择题\n### 1. Which layer?\n- A. x\n**答案**：A\n### 2. Which hop?\n- A. x\n**答案**：A\n", encoding="utf-8")
    banks = documents.scan_banks(spark, str(tmp_path))
    assert banks.first().course == "net" and banks.first().modified is not None
    q = practice.parse_bank(banks)
    assert services.chapter_session(q, "net", "hop").data.count() == 1 and services.chapter_session(q, "net", "zzz").data.count() == 2
    assert services.practice_session(q, "").error == "no_course"
    at = str(tmp_path / "wrong")
    book = documents.read_wrong_book(spark, at)
    assert services.wrong_list(book).message == "no wrong questions yet"
    new = spark.createDataFrame([("net:选择题:2", "net", "选择题", 2, 1, False), ("os:选择题:1", "os", "选择题", 1, 2, False), ("os:选择题:3", "os", "选择题", 3, 1, True)], book.schema)
    for state in (new, None):
        documents.write_wrong_book(state if state is not None else documents.read_wrong_book(spark, at), at)
    book = documents.read_wrong_book(spark, at)
    assert book.count() == 3 and services.wrong_list(book, "os").data.count() == 1
    assert [r.stem for r in services.wrong_session(book, q).data.collect()] == ["Which hop?"] and services.wrong_session(book, q, "os").message
    n = spark.createDataFrame([("net", 5), ("os", 2)], "course string, n long")
    board = services.dashboard(n, n.limit(1), n, 3, 4).data
    assert board["courses"].count() == 2 and tuple(board["totals"].first()) == (7, 5, 7, 3, 4)


def test_wrong_book_in_steps_is_the_fold(spark):
    r = random.Random(5)
    hist = [(k, t, r.random() < 0.4) for k in range(40) for t in range(r.randint(1, 12))]
    df = spark.createDataFrame(hist, "key long, ts long, correct boolean")
    for counting in (False, True):
        book = spark.createDataFrame([], "key long, wrong_count long, mastered boolean")
        for lo, hi in ((0, 4), (4, 7), (7, 99)):
            book = practice.update_wrong_book(book, df.where(f"ts >= {lo} and ts < {hi}"), ["key"], ["ts"], counting)
        got = {x.key: x.wrong_count for x in book.collect()}
        want = {k: stream.fold(0, [c for kk, _, c in hist if kk == k], counting) for k in range(40)}
        assert got == {k: n for k, n in want.items() if n}


def test_stream_takes_late_attempts_in_their_place(spark, tmp_path):
    r = random.Random(9)
    hist = [(f"k{k}", t, r.random() < 0.4) for k in range(6) for t in range(8)]
    late = hist[:]
    r.shuffle(late)
    src = tmp_path / "in"
    for i in range(4):
        spark.createDataFrame(late[i::4], "key string, ts long, correct boolean").coalesce(1).write.mode("append").parquet(str(src / f"p={i}"))
    s = spark.readStream.schema("key string, ts long, correct boolean").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(src))
    q = stream.wrong_book_stream(s, counting=True).writeStream.outputMode("update").foreachBatch(lambda df, n: df.withColumn("n", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))).start()
    q.processAllAvailable()
    q.stop()
    last = {}
    for x in spark.read.parquet(str(tmp_path / "out")).orderBy("n").collect():
        last[x.key] = x.wrong_count
    assert last == {f"k{k}": stream.fold(0, [c for kk, _, c in hist if kk == f"k{k}"], True) for k in range(6)}


def test_page_sources(spark, tmp_path):
    page = {"w": 100.0, "h": 200.0, "items": [{"box": [[1, 2], [9, 2], [9, 8], [1, 8]], "text": "hi", "score": 0.5}]}
    (tmp_path / "p0003.json").write_text(json.dumps(page))
    (tmp_path / "p0004.json").write_text("{broken")
    got = documents.page_cache(spark, str(tmp_path), "b").collect()
    assert [(x.page, x["items"][0].box[2].x) for x in got] == [(3, 9.0)]
    wanted = spark.createDataFrame([("b", 3), ("b", 4)], "book string, page int")
    assert [x.page for x in documents.missing(wanted, documents.page_cache(spark, str(tmp_path), "b"), "page").collect()] == [4]
    meta = spark.createDataFrame([("b", 3, 7, 1, 2, 5)], "book string, page int, page_no int, n_figures int, n_tables int, n_paras int")
    assert documents.pages_with_meta(wanted, meta, ["book", "page"]).where("page_no is null").count() == 1
    documents.save_meta(meta, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 1
    chunks = spark.createDataFrame([("b", True, "x </script> y", "p", 1, 0)], "doc string, is_title boolean, text string, section_path string, page_no int, chunk_no int")
    documents.save_corpus(chunks, str(tmp_path / "corpus"))
    assert documents.load_corpus(spark, str(tmp_path / "corpus"), chunks.schema).first() == chunks.first()
    sections = spark.createDataFrame([("b", 1, "t", 2)], "doc string, section_no int, title string, level int")
    pay = documents.reader_payload(sections, chunks).first().json
    assert "</" not in pay and json.loads(pay)["chunks"][0]["text"] == "x </script> y" and "<\\/script>" in documents.reader_page("t", [pay])


def test_jobs(spark, tmp_path, capsys):
    md = tmp_path / "md"
    md.mkdir()
    (md / "net.md").write_text(BOOK, encoding="utf-8")
    (md / "net课件版.md").write_text("# s\n\nab\n\ncd\n", encoding="utf-8")
    assert jobs.main(["corpus", str(md), "--out", str(tmp_path / "c")], spark) == 0 and "'titles': 3" in capsys.readouterr().out
    assert jobs.corpus_job(spark, str(md), str(tmp_path / "c2"), books=["net课件版"])["titles"] == 1
    assert jobs.main(["slides", str(md), "--out", str(tmp_path / "s")], spark) == 0 and (tmp_path / "s" / "net课件版.md").read_text(encoding="utf-8") == "# s\n\nab、cd"
    pages = tmp_path / "pages" / "b"
    pages.mkdir(parents=True)
    (pages / "p1.md").write_text("one page of text", encoding="utf-8")
    (pages / "p0.md").write_text("", encoding="utf-8")
    assert jobs.main(["merge", str(tmp_path / "pages"), "--out", str(tmp_path / "m")], spark) == 0
    assert (tmp_path / "m" / "b.md").read_text() == "<!-- page 2 -->\n\none page of text"
    (pages / "p1.md").write_text(" ", encoding="utf-8")
    assert jobs.main(["merge", str(tmp_path / "pages"), "--out", str(tmp_path / "m")], spark) == 1
    got = jobs.import_job(spark, str(md), str(tmp_path / "i"), {"net": [], "os": []}, dry_run=True)
    assert got["net"].success and got["os"].error == "no_files"


def test_segment(spark):
    voc = spark.createDataFrame([("物理层",), ("物理",), ("层",), ("tcp",)], "term string")
    q = spark.createDataFrame([(1, "什么是物理层？TCP x"), (2, None), (3, "量子物理"), (4, "的"), (5, "物，理")], "qid long, query string")
    got = {r.qid: (r.terms, r.unknown) for r in segment.segment(q, voc).collect()}
    assert got == {1: (["物理层", "tcp", "x"], ["什么是"]), 2: ([], []), 3: (["物理"], ["量子"]), 4: ([], []), 5: ([], [])}
    assert segment.segment(q, voc.limit(0)).where("size(terms) > 0").count() == 1
    f = spark.createDataFrame([("什么是",), ("量子",)], "r string").select(segment.is_function_run(F.col("r")).alias("f"))
    assert [x.f for x in f.collect()] == [True, False]


def test_content_terms(spark):
    d = spark.createDataFrame([(["什么", "物理层", "层", "a", "tcp", "+", "c++", "7", "é"],)], "t array<string>")
    assert d.select(segment.content_terms(F.col("t")).alias("t")).first().t == ["物理层", "a", "tcp", "7"]


def test_chinese_course_answers(spark):
    """Nine queries: six found in their chapter, one unknown, one of function words, one said once only."""
    c = fixtures.zh_corpus(spark).join(segment.segment(fixtures.zh_corpus(spark), fixtures.zh_vocabulary(spark), "pos", "text").select("pos", "terms"), "pos")
    q = fixtures.zh_queries(spark).join(segment.segment(fixtures.zh_queries(spark), fixtures.zh_vocabulary(spark)), "qid")
    index = retrieval.build_index(c, store=True)
    got = {r.qid: r.status for r in retrieval.search(index, q).collect()}
    assert [got[k] for k in range(9)] == ["ok"] * 6 + ["not_found", "empty_query", "not_found"]
    hits = retrieval.search_hits(index, q).where("rank = 1").join(fixtures.zh_corpus(spark).select("pos", "text"), "pos").collect()
    first = {(r.qid, r.kind): r.text for r in hits}
    assert "物理层" in first[0, "section"] and "拥塞控制" in first[1, "passage"] and "差错检测" in first[2, "passage"] and "窗口" in first[3, "passage"] and "域名系统" in first[4, "passage"]


def test_chinese_library(spark):
    text = "# 第1章 网络\n\n## 1.1 物理层\n\n" + "物理层把比特送过信道，编码由协议规定。" * 4 + "\n\n## 1.2 网络层\n\n" + "网络层用路由器转发分组，每个地址有路由。" * 4 + "\n"
    lib = services.Library(spark, spark.createDataFrame([("网络", text)], "doc string, text string"), vocabulary=fixtures.zh_vocabulary(spark))
    r = lib.explain_topic("什么是信道")
    assert r.data["status"] == "ok" and r.data["passages"][0]["section_path"].endswith("物理层") and r.data["used_tokens"] == ["信道"]
    assert lib.explain_topic("红烧肉").data["status"] == "not_found" and lib.explain_topic("什么是").data["status"] == "empty_query"


def test_section_concepts(spark):
    md = "intro words here\n# A\nalpha beta alpha\n##### deep\n# B\n# A\ngamma gamma delta\n# C\n \n"
    got = {r.title: r.concepts for r in reading.section_concepts(spark.createDataFrame([("d", md)], "doc string, text string")).collect()}
    assert set(got) == {"全章", "A"} and got["A"][0] == "gamma" and set(got["全章"]) == {"intro", "words", "here"}


def test_question_terms_may_repeat_rows(spark):
    d = spark.createDataFrame([("a \\| b",)], "t string").select(T.table_rows(F.concat(F.lit("| "), "t", F.lit(" | c |"))).alias("r"))
    assert d.first().r == [["a | b", "c"]]
    assert zipfile.is_zipfile(io.BytesIO(documents.markdown_docx("# x")))
