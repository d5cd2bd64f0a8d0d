"""Terms of text without spaces: the longest match from the left against a vocabulary.

Every position of a part (text between separators) meets the vocabulary in an equi-join on its substrings; a fold over the
positions then takes the longest match at each place that it reaches. Characters of the CJK block that nothing matches are
no terms, but runs of two or more of them are told as unknown.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Separators, the CJK block, and the characters of function words.
SEPARATORS = r"[\s，。！？；：、,.!?;:]+"
CJK = "[一-鿿]"
FUNCTION_CHARS = "的了是在和就都而及与着或之也这那什么怎怎样如何为哪些没有是否多少介绍讲解一下意思请问知道告诉"
# Words that say nothing of a topic.
STOPWORDS = tuple("""
的 了 是 在 和 就 都 而 及 与 着 或 之 也 有 这 那 上 下 里 中 到 说 要 会 能 可 以 等
为 从 对 被 把 让 使 给 但 却 因 所以 因此 如果 那么 这样 那样 时候
什么 怎么 怎样 如何 为什么 哪 哪些 谁 何时 何地 多少
可以 需要 应该 必须 可能 已经 正在 将要 通过 由于 关于 对于 根据 按照
以及 并且 或者 但是 然而 不过 就是 还是 也是 都是 只是 一些 一种 一样
这个 那个 这些 那些 这里 那里
""".split())


def content_terms(terms: Column, stopwords: tuple[str, ...] = STOPWORDS) -> Column:
    """Terms without stop words, single characters outside ASCII, and terms that are neither letters and digits nor hold CJK."""
    return F.filter(terms, lambda t: ~t.isin(*stopwords) & ((F.length(t) >= 2) | t.rlike(r"^[\x00-\x7f]$")) & (t.rlike(r"^[\p{L}\p{N}]+$") | t.rlike(CJK)))


def is_function_run(c: Column) -> Column:
    """Whether a run has nothing but characters of function words."""
    return c.rlike(f"^[{FUNCTION_CHARS}]+$")


def segment(texts: DataFrame, vocabulary: DataFrame, key: str = "qid", text: str = "query") -> DataFrame:
    """(key, terms, unknown): the terms of each text in order, and the runs that the vocabulary (term) does not know.

    key must be unique; null and empty texts have no terms. Terms of one character match nothing; other characters than
    CJK that no term covers are terms of their own.
    """
    words = vocabulary.select("term").where(F.length("term") >= 2).distinct()
    longest = max(2, words.agg(F.max(F.length("term"))).first()[0] or 2)
    clean = F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), SEPARATORS, " "))
    parts = texts.select(key, F.posexplode(F.filter(F.split(clean, " "), lambda p: p != "")).alias("part_no", "part"))
    places = parts.select(key, "part_no", "part", F.explode(F.sequence(F.lit(1), F.length("part"))).alias("at"))
    tried = places.withColumn("size", F.explode(F.sequence(F.lit(2), F.lit(longest)))).where("at + size - 1 <= length(part)")
    hits = tried.withColumn("term", F.substr("part", F.col("at"), F.col("size"))).join(words, "term", "left_semi")
    found = hits.groupBy(key, "part_no", "at").agg(F.max("size").alias("size")).groupBy(key, "part_no").agg(F.map_from_entries(F.collect_list(F.struct("at", "size"))).alias("hits"))
    walked = parts.join(found, [key, "part_no"], "left").withColumn("w", _walk(F.col("part"), F.col("hits")))
    ordered = lambda name: F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("part_no", F.col(f"w.{name}").alias("x")))), lambda r: r["x"]))
    told = walked.groupBy(key).agg(ordered("terms").alias("terms"), ordered("unknown").alias("unknown"))
    none = F.expr("array()").cast("array<string>")
    return texts.select(key).join(told, key, "left").select(key, F.coalesce("terms", none).alias("terms"), F.coalesce("unknown", none).alias("unknown"))


def _walk(part: Column, hits: Column) -> Column:
    """struct<terms, unknown> of a part, given the longest match at each place."""
    none = F.expr("array()").cast("array<string>")
    state = lambda at, terms, unknown, run: F.struct(at.cast("int").alias("at"), terms.alias("terms"), unknown.alias("unknown"), run.alias("run"))
    closed = lambda s: F.when(F.length(s["run"]) >= 2, F.concat(s["unknown"], F.array(s["run"]))).otherwise(s["unknown"])

    def step(s, at):
        size, char = F.try_element_at(hits, at), F.substr(part, at, F.lit(1))
        return (F.when(at < s["at"], s)
                .when(size.isNotNull(), state(at + size, F.concat(s["terms"], F.array(F.substr(part, at, size))), closed(s), F.lit("")))
                .when(char.rlike(CJK), state(at + 1, s["terms"], s["unknown"], F.concat(s["run"], char)))
                .otherwise(state(at + 1, F.concat(s["terms"], F.array(char)), closed(s), F.lit(""))))
    return F.aggregate(F.sequence(F.lit(1), F.length(part)), state(F.lit(1), none, none, F.lit("")), step, lambda s: F.struct(s["terms"].alias("terms"), closed(s).alias("unknown")))
