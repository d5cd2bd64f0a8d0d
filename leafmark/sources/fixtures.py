"""The engine's inputs as they come from the driver's tables: corpora, books, pages of books, attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as passages and the h1 headings of pages as titles of level 1 to 3."""
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("pos"), "text", F.lit(False).alias("is_title"), F.lit(None).cast("int").alias("level"))
    pages = read(spark, sf_dir, "pages").select(
        (F.lit(1_000_000_000) + F.col("page_id")).alias("pos"), F.regexp_extract("html", "<h1>(.*?)</h1>", 1).alias("text"), F.lit(True).alias("is_title"), (F.col("page_id") % 3 + 1).cast("int").alias("level"))
    return docs.unionByName(pages)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark's texts, and one query for each way to be refused."""
    own = spark.createDataFrame([(-1, ""), (-2, "zzqqzz"), (-3, "zzqqzz the of"), (-4, "!!! ???"), (-5, "the of and")], "qid long, query string")
    return read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("query")).unionByName(own)


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text): one Markdown book for each region: nations are chapters on pages, customers their sections."""
    r, n, c = (read(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    cust = c.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "c_name", "c_mktsegment"))), lambda x: F.concat(
        F.lit("### "), x["c_name"], F.lit("\n\n"), x["c_name"], F.lit(" buys in "), x["c_mktsegment"], F.lit(".\n\n"))), "").alias("body"))
    nat = n.join(cust, "n_nationkey", "left").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", F.coalesce("body", F.lit("")).alias("body")))), lambda x: F.concat(
        F.lit("<!-- page "), (x["n_nationkey"] + 1).cast("string"), F.lit(" -->\n\n## "), x["n_name"], F.lit("\n\n"), x["body"])), "").alias("body"))
    return r.join(nat, F.col("r_regionkey") == F.col("n_regionkey"), "left").select(F.col("r_name").alias("doc"), F.concat(F.lit("# "), "r_name", F.lit("\n\n"), F.coalesce("body", F.lit(""))).alias("text"))


def numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(book, idx, page_no): orders of a customer as pages, some numbers missing and some misread."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("book"), "o_orderkey", (F.row_number().over(w) - 1).cast("long").alias("idx"))
    true = F.col("idx") + 1 + F.col("book") % 7
    return o.select("book", "idx", F.when(F.col("o_orderkey") % 5 == 0, None).when(F.col("o_orderkey") % 7 == 0, true + 100).otherwise(true).alias("page_no"))


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, event_id, ts, correct): purchases are right answers, errors wrong ones, other events skips."""
    e = read(spark, sf_dir, "events")
    return e.select("user_id", "event_id", "ts", F.when(F.col("event_type") == "purchase", True).when(F.col("event_type") == "error", False).alias("correct"))


def rich_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc, text): one Markdown book for each region: nations are sections on pages with a paragraph, a table and a figure
    whose caption follows it; every third figure stands without one."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    caption = F.concat(F.lit("图"), k, F.lit("-1 map of "), name)
    bad = F.when(F.col("n_nationkey") % 4 == 0, F.concat(F.lit("| only "), k, F.lit(" |"))).otherwise(F.concat(F.lit("| "), k, F.lit(" | "), name, F.lit(" |")))
    body = F.concat(F.lit("<!-- page "), (F.col("n_nationkey") + 1).cast("string"), F.lit(" -->\n\n## "), k, F.lit(".1 "), name, F.lit("\n\nThe nation "), name, F.lit(" lies in its region and trades with many others by sea.\n\n| key | name |\n| --- | --- |\n"), bad,
                    F.lit("\n\n!["), caption, F.lit("](img/"), k, F.lit(".png)\n\n"), F.when(F.col("n_nationkey") % 3 != 0, F.concat(caption, F.lit("\n\n"))).otherwise(""))
    each = n.select("n_regionkey", "n_nationkey", body.alias("body")).groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "body"))), lambda x: x["body"]), "").alias("body"))
    return r.join(each, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("doc"), F.concat(F.lit("# "), "r_name", F.lit("\n\n"), "body").alias("text"))


def banks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(course, text): a question bank for each region: choices about even nations, blanks about odd ones."""
    r, n = read(spark, sf_dir, "region"), read(spark, sf_dir, "nation")
    k, name = F.col("n_nationkey").cast("string"), F.col("n_name")
    even = F.col("n_nationkey") % 2 == 0
    q = F.concat(F.lit("### "), k, F.lit(". Which key has "), name, F.lit("?\n"), F.when(even, F.concat(F.lit("- A. "), k, F.lit("\n- B. none\n"))).otherwise(""), F.lit("**答案**："), F.when(even, "A").otherwise(k), F.lit("\n**解析**：see "), name, F.lit("\n"))
    part = lambda cond: F.array_join(F.transform(F.filter("a", cond), lambda x: x["q"]), "")
    g = n.select("n_regionkey", F.struct("n_nationkey", q.alias("q")).alias("x")).groupBy("n_regionkey").agg(F.array_sort(F.collect_list("x")).alias("a"))
    text = F.concat(F.lit("# bank\n## 一、选择题\n"), part(lambda x: x["n_nationkey"] % 2 == 0), F.lit("## 二、填空题\n"), part(lambda x: x["n_nationkey"] % 2 == 1))
    return r.join(g, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("course"), text.alias("text"))


#: A small Chinese course: vocabulary, chunks (title level, text) and queries with what they must come to.
ZH_TERMS = ("计算机", "网络", "计算机网络", "物理层", "数据链路层", "网络层", "运输层", "应用层", "协议", "拥塞控制", "拥塞", "路由", "路由器", "分组", "信道", "编码", "帧", "差错", "检测", "差错检测", "窗口", "滑动窗口", "连接", "可靠", "传输", "域名", "系统", "域名系统", "地址", "密码", "量子")
ZH_CHUNKS = ((1, "第1章 计算机网络"), (2, "2.1 物理层"), (0, "物理层把比特送过信道，编码由协议规定。"), (2, "3.1 数据链路层"), (0, "数据链路层把分组装成帧，并作差错检测。"), (0, "数据链路层的帧带有差错检测的编码。"), (2, "4.1 网络层"), (0, "网络层用路由器转发分组，每个地址有路由。"),
             (2, "5.1 运输层"), (0, "运输层建立连接，用滑动窗口作可靠传输。"), (3, "5.2 拥塞控制"), (0, "拥塞控制按窗口限制传输，避免网络拥塞。"), (2, "6.1 应用层"), (0, "应用层的域名系统把域名变成地址。"), (0, "协议规定传输的编码和地址。"), (0, "量子密码只在这里提到。"))
ZH_QUERIES = ("什么是物理层", "拥塞控制", "数据链路层的差错检测", "滑动窗口怎么传输", "域名系统", "路由器 协议", "红烧肉", "什么是", "量子密码")


def zh_vocabulary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in ZH_TERMS], "term string")


def zh_corpus(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, t, lv > 0, lv or None) for k, (lv, t) in enumerate(ZH_CHUNKS)], "pos long, text string, is_title boolean, level int")


def zh_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ZH_QUERIES)), "qid long, query string")
