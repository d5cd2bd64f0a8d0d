"""Queries whose plans used to grow faster than their input, or to leave their SQL, on small tables that show it."""

import collections
import hashlib
import random
import re

import duckdb
import pandas as pd

from leafmark.operators import layout, merging, reading, retrieval
from leafmark.plans import catalog


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def spec_book(parts):
    lines = re.split("\r\n|\r|\n", "\n\n".join(parts))
    bare = [k for k, s in enumerate(lines) if re.match(merging.BARE_CHAPTER, s.strip())]
    at = next((k for k, s in enumerate(lines) if len(s.strip()) <= 30 and re.match(merging.APPENDIX, s.strip()) and sum(b > k for b in bare) >= 2), None)
    if at is None:
        return "\n".join(lines), 0
    subs = [k for k in bare if k > at]
    out = ["# " + s.strip() if k == at else "## 第" + re.match(merging.BARE_CHAPTER, s.strip())[2] + "章" if k in subs else s for k, s in enumerate(lines)]
    return "\n".join(out), len(subs)


def test_merged_books_have_no_window_over_a_book(spark):
    r = random.Random(9)
    pick = ["附录A 解答", "附 录", "# 第1章", " ## 第 12 章 ", "# 第1章 名", "text", "", "line\rcut"]
    books = {b: ["\n".join(["x", *(r.choice(pick) for _ in range(r.randint(0, 5))), "y"]) for _ in range(r.randint(1, 5))] for b in range(60)}
    pages = spark.createDataFrame([(b, k, t, k + 1) for b, ts in books.items() for k, t in enumerate(ts)], "book long, idx long, text string, page_no long")
    whole, _ = merging.merge_pages(pages)
    digests = merging.book_digests(merging.merge_parts(pages)[0])
    got, md5 = {x.book: (x.text, x.appendix_subs) for x in whole.collect()}, {x.book: (x.chars, x.text_md5, x.appendix_subs) for x in digests.collect()}
    want = {b: spec_book([f"<!-- page {k + 1} -->\n\n{t}" for k, t in enumerate(ts)]) for b, ts in books.items()}
    assert got == want and any(n for _, n in want.values())
    assert md5 == {b: (len(t), hashlib.md5(t.encode()).hexdigest(), n) for b, (t, n) in want.items()}
    assert "Window" not in plan_of(whole) and "collect_list" not in plan_of(digests)


def same_as_sql(name, df, **tables):
    """Rows of a registered query and of its SQL over the same small tables."""
    sql = duckdb.connect()
    for t, rows in tables.items():
        sql.register(t, rows)
    want = sql.sql(catalog.SQL[name])
    key = lambda r: tuple((x is None, x) for x in r)
    return sorted(map(tuple, df.select(*want.columns).collect()), key=key) == sorted(want.fetchall(), key=key)


def test_long_pages_are_restored_as_in_sql(spark, tmp_path):
    """Pages of up to 45 lines: lines below the usual height of a page are no footers."""
    r = random.Random(5)
    rows = [(page, r.randint(1, 1_200_000), r.randint(1, 60_000), r.randint(1, 7), r.choice("ANR")) for page in range(1, 31) for _ in range(r.choice([3, 17, 19, 25, 45]))]
    li = pd.DataFrame(rows, columns=["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_returnflag"]).astype({"l_linenumber": "int32"})
    spark.createDataFrame(li).write.parquet(str(tmp_path / "lineitem.parquet"))
    assert len(set(map(tuple, rows))) == len(rows)
    for name in ("restored_pages", "figure_regions", "detected_tables"):
        assert same_as_sql(name, catalog.QUERIES[name](spark, str(tmp_path)), lineitem=li), name


def test_queries_keep_their_best_rows_in_every_task(spark, monkeypatch, tmp_path):
    """Best rows of each query by task, as the join of all pairs of queries and rows has them; that join's rows are never made."""
    monkeypatch.setattr(retrieval, "CELLS", 50)
    r = random.Random(11)
    words = [f"w{k}" for k in range(30)]
    text = lambda n: " ".join(words[min(r.randrange(30), r.randrange(30))] for _ in range(n))
    rows = [(k, text(r.randint(0, 12)), k % 4 == 0, None if k % 3 else k % 5) for k in range(300)]
    corpus = spark.createDataFrame(rows, "pos long, text string, is_title boolean, level int").repartition(3)
    queries = spark.createDataFrame([(f"q{k}", text(k % 4)) for k in range(25)], "qid string, query string")
    index = retrieval.build_index(corpus, store=True)
    assert {(x.pos, x.term): x.tf for x in index.tf.collect()} == {(k, w): n for k, t, _, _ in rows for w, n in collections.Counter(t.split()).items()}
    terms = retrieval.query_terms(queries)
    for ranking in (None, retrieval.READER):
        got = [sorted(map(tuple, f(index, queries, ranking=ranking).collect()), key=repr) for f in (retrieval.search, retrieval.search_hits)]
        assert "Aggregate [qid, pos" not in plan_of(retrieval.passage_hits(index, terms)) and "MapInArrow" in plan_of(retrieval.title_hits(index, terms))
        with monkeypatch.context() as m:
            m.setattr(retrieval, "BROADCAST_TERMS", -1)
            assert got == [sorted(map(tuple, f(index, queries, ranking=ranking).collect()), key=repr) for f in (retrieval.search, retrieval.search_hits)]
    none = spark.createDataFrame([("a", "zzz")], "qid string, query string")
    assert retrieval.search(index, none).first().status == "not_found" and retrieval.search_hits(index, none).count() == 0


def test_key_words_are_weighed_without_pairs_of_all_words(spark):
    """Key words by a plain fold: most of the frequent words fall, so that candidates are taken in steps; equals by first sight."""
    r = random.Random(13)
    docs = [(k % 3, k, " ".join(r.choice(["a" * r.randint(1, 12), "b" * r.randint(1, 5) + "c", f"x{r.randint(0, 60)}", "7", "toolongofaword"]) for _ in range(60))) for k in range(40)]
    d = spark.createDataFrame(docs, "key long, pos long, text string")
    want = []
    for key in range(3):
        said = [w for k, _, t in docs if k == key for w in t.split() if 2 <= len(w) <= 12 and re.search("[A-Za-z]", w)]
        n, first = collections.Counter(said), {w: k for k, w in reversed(list(enumerate(said)))}
        best = sorted((w for w in n if not any(w != v and w in v for v in n)), key=lambda w: (-n[w], first[w]))
        want += [(key, k + 1, w, n[w]) for k, w in enumerate(best[:5])]
    got = reading.top_concepts(d, "key", 5)
    assert sorted(map(tuple, got.collect())) == want
    counts = reading.word_counts(d, "key")
    assert "SortAggregate" not in counts._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, reading.top_concepts(d, "key", 5, step=1).collect())) == want


def spec_lines(boxes):
    """Boxes (x0, x1, y0, y1, text) of a page from top to bottom, each to the first line whose first box is level with it."""
    lines = []
    for b in sorted(boxes, key=lambda b: b[2] + b[3]):
        least = lambda a, b=b: min(a[3] - a[2], b[3] - b[2])
        home = next((ln for ln in lines if 0 < least(ln[0]) and abs(ln[0][2] + ln[0][3] - b[2] - b[3]) < 2 * layout.LINE_Y * least(ln[0])), None)
        lines.append([b]) if home is None else home.append(b)
    for ln in lines:
        ln.sort(key=lambda b: b[0])
    return [(k, min(b[0] for b in ln), max(b[1] for b in ln), min(b[2] for b in ln), max(b[3] for b in ln), [b[4] for b in ln])
            for k, ln in enumerate(sorted(lines, key=lambda ln: min(b[2] for b in ln)))]


def test_lines_of_all_pages_at_once(spark):
    """Lines as the plain rule deals them, with flat boxes, ties and pages cut by batches; no row of Python objects for each box."""
    r = random.Random(17)
    pages = {(b, p): [(float(x := r.randint(0, 40) * 10), float(x + r.randint(1, 90)), float(y := r.randint(0, 30) * 5), float(y + r.choice([0, 10, 20, 30])), f"t{k}") for k in range(r.randint(1, 25))]
             for b in ("a", None) for p in range(40)}
    rows = [(b, p, 1450.0, k, *box) for (b, p), boxes in pages.items() for k, box in enumerate(boxes)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = layout.lines_of(spark.createDataFrame(rows, "book string, page int, w double, ord long, x0 double, x1 double, y0 double, y1 double, text string"))
        assert "MapInPandas" not in plan_of(got)
        found = {}
        for x in got.orderBy("line").collect():
            found.setdefault((x.book, x.page), []).append((x.line, x.x0, x.x1, x.y0, x.y1, [b.text for b in x.boxes]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {k: spec_lines(v) for k, v in pages.items()}
