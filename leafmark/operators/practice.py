"""Question banks, grading, sessions, and the wrong-answer book as closed forms over attempts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import normal_answer, question_key
from leafmark.operators.markdown import lines_of

# Sections of a bank, and answers that count as right when a question is self-checked.
SECTIONS = {"一": "选择题", "二": "填空题", "三": "大题"}
SELF_RIGHT = ("对", "T", "TRUE", "1")
QUOTA = {"选择题": 10, "填空题": 10, "大题": 2}


def parse_bank(docs: DataFrame, doc: str = "course", text: str = "text") -> DataFrame:
    """(doc, pos, no, type, stem, options, answer, explanation): the questions of each bank, in order."""
    w = Window.partitionBy(doc).orderBy("pos")
    s = F.col("line")
    ln = lines_of(docs, doc, text)
    sec_re, q_re, opt_re = r"^##\s+([一二三])[、.]\s*(.*)$", r"^###\s+(\d+)[.、]\s*(.*)$", r"^-\s*([A-D])[.、]\s*(.*)$"
    kind = (F.when(s.rlike(sec_re), "section").when(s.rlike(q_re), "question").when(s.rlike(opt_re), "option")
            .when(s.startswith("**答案**"), "answer").when(s.startswith("**解析**"), "explanation").otherwise("text"))
    ln = ln.withColumn("kind", kind)
    names = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    ln = ln.withColumn("type", F.last(F.when(F.col("kind") == "section", F.try_element_at(names, F.regexp_extract(s, sec_re, 1))), True).over(w))
    # a section heading closes the question before it
    ln = ln.withColumn("q", F.sum(F.col("kind").isin("question", "section").cast("int")).over(w))
    ln = ln.withColumn("is_q", F.max(F.col("kind") == "question").over(Window.partitionBy(doc, "q"))).where("is_q")
    value = strip_marks(F.regexp_replace(s, r"\*\*(答案|解析)\*\*", ""))
    answered = F.max((F.col("kind") == "answer") & (value != "")).over(Window.partitionBy(doc, "q").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    more = (F.col("kind") == "text") & ~F.coalesce(answered, F.lit(False)) & (s != "") & ~s.startswith("<!--")
    ln = ln.withColumn("more", more)
    stem = F.when(F.col("kind") == "question", F.trim(F.regexp_extract(s, q_re, 2))).when(F.col("more"), s)
    option = F.when(F.col("kind") == "option", F.concat(F.regexp_extract(s, opt_re, 1), F.lit(". "), F.trim(F.regexp_extract(s, opt_re, 2))))
    keep = lambda c: F.transform(F.array_sort(F.collect_list(F.when(c.isNotNull(), F.struct(F.col("pos"), c.alias("x"))))), lambda r: r["x"])
    out = ln.groupBy(doc, "q").agg(
        F.min("pos").alias("pos"), F.max(F.when(F.col("kind") == "question", F.regexp_extract(s, q_re, 1).cast("int"))).alias("no"),
        F.coalesce(F.min_by("type", "pos"), F.lit("")).alias("type"), F.array_join(keep(stem), " ").alias("stem"), keep(option).alias("options"),
        F.coalesce(F.max_by(F.when(F.col("kind") == "answer", value), F.when(F.col("kind") == "answer", F.col("pos"))), F.lit("")).alias("answer"),
        F.coalesce(F.max_by(F.when(F.col("kind") == "explanation", value), F.when(F.col("kind") == "explanation", F.col("pos"))), F.lit("")).alias("explanation"))
    return out.where("stem <> ''").drop("q")


def strip_marks(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"^[：: ]+|[：: ]+$", "")


def grade(attempts: DataFrame) -> DataFrame:
    """attempts (type, options, answer, user_answer, ...) plus correct and auto: choices with options are graded, a question
    without an answer is wrong, the rest are the user's own judgement."""
    auto = (F.col("type") == "选择题") & (F.size("options") > 0)
    ua, ex = normal_answer(F.col("user_answer")), normal_answer(F.col("answer"))
    return attempts.withColumn("auto", auto).withColumn("correct", F.when(auto, (ex != "") & (ua == ex)).otherwise(ua.isin(*SELF_RIGHT)))


def wrong_book(attempts: DataFrame, key: list[str], order: list[str], counting: bool = False) -> DataFrame:
    """The wrong-answer book after a history of graded attempts (key, order, correct): a key is in it when its last attempt
    was wrong. wrong_count stays 1, or with counting is the number of wrong answers since the last right one."""
    at = F.struct(*order)
    last = attempts.groupBy(*key).agg(F.max(F.when(F.col("correct"), at)).alias("right"), F.max_by("correct", at).alias("ok"))
    wrong = attempts.where("not correct").join(last.where("not ok"), key).where(F.col("right").isNull() | (at > F.col("right")))
    out = wrong.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*key, (F.col("n") if counting else F.lit(1).cast("long")).alias("wrong_count"), F.lit(False).alias("mastered"))


def session_stats(attempts: DataFrame, key: str) -> DataFrame:
    """(key, total, answered, correct, wrong, accuracy): correct is null for a skipped question."""
    c = F.col("correct")
    out = attempts.groupBy(key).agg(F.count(F.lit(1)).alias("total"), F.count(c).alias("answered"), F.count_if(c).alias("correct"), F.count_if(~c).alias("wrong"))
    return out.withColumn("accuracy", F.when(F.col("answered") > 0, F.round(F.col("correct") / F.col("answered"), 3)).otherwise(0.0))


def sample_questions(questions: DataFrame, group: list[str], key: Column, quota: int | dict[str, int], seed: str = "0", kind: str = "type") -> DataFrame:
    """Stratified sample without replacement, the same for the same seed: questions in order of a hash of their key."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    w = Window.partitionBy(*group).orderBy("_h", key)
    q = questions.withColumn("_h", h).withColumn("pick", F.row_number().over(w))
    if isinstance(quota, dict):
        most = F.coalesce(*[F.when(F.col(kind) == k, n) for k, n in quota.items()], F.lit(0))
    else:
        most = F.lit(quota)
    return q.where(F.col("pick") <= most).drop("_h")


def chapter_questions(questions: DataFrame, keyword: str) -> DataFrame:
    """Questions whose stem holds the keyword; where none does, all."""
    hit = questions.where(F.col("stem").contains(keyword))
    none = hit.limit(1).agg(F.count(F.lit(1)).alias("n"))
    rest = questions.crossJoin(F.broadcast(none)).where("n = 0").drop("n")
    return hit.unionByName(rest)


def wrong_review(wrong: DataFrame, questions: DataFrame) -> DataFrame:
    """Questions of the wrong book (course, type, no); the first of each key, and none for keys without a question."""
    w = Window.partitionBy("course", "type", "no").orderBy("pos")
    first = questions.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
    return first.join(wrong.select("course", "type", "no", "wrong_count"), ["course", "type", "no"])


def with_key(q: DataFrame) -> DataFrame:
    return q.withColumn("key", question_key(F.col("course"), F.col("type"), F.col("no")))


def outcome_status(outcomes: DataFrame, key: str) -> DataFrame:
    """(key, n_ok, n_failed, status): ok, partial or failed imports."""
    o = outcomes.groupBy(key).agg(F.count_if(F.col("ok")).alias("n_ok"), F.count_if(~F.col("ok")).alias("n_failed"))
    return o.withColumn("status", F.when(F.col("n_failed") == 0, "ok").when(F.col("n_ok") > 0, "partial").otherwise("failed"))


def dashboard(chunks: DataFrame, questions: DataFrame, wrong: DataFrame) -> DataFrame:
    """Counts (course, n) of three sources side by side for every course of any of them."""
    out = chunks.select("course", F.col("n").alias("chunks"))
    for df, name in ((questions, "questions"), (wrong, "wrong")):
        out = out.join(df.select("course", F.col("n").alias(name)), "course", "full_outer")
    return out.select("course", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("chunks", "questions", "wrong")])


def shuffled(questions: DataFrame, key: Column, seed: str = "0") -> DataFrame:
    """Questions with their turn in a random order, the same for the same seed; turns are numbered by course."""
    h = F.md5(F.concat(F.lit(f"{seed}|"), key.cast("string")))
    return questions.withColumn("turn", F.row_number().over(Window.partitionBy("course").orderBy(h, key)))


def unmastered(wrong: DataFrame, course: str = "") -> DataFrame:
    """Wrong questions that are not mastered, of one course or all."""
    left = wrong.where(~F.coalesce("mastered", F.lit(False)))
    return left.where(F.col("course") == course) if course else left


def update_wrong_book(book: DataFrame, attempts: DataFrame, key: list[str], order: list[str], counting: bool = False) -> DataFrame:
    """book (key, wrong_count, mastered) after more graded attempts: a right answer takes a key out, wrong ones put it in;
    with counting those since the last right one add up, on top of the book's count where none was right."""
    at = F.struct(*order)
    last = attempts.groupBy(*key).agg(F.max(F.when(F.col("correct"), at)).alias("right"))
    new = attempts.join(last, key).groupBy(*key).agg(
        F.max(F.col("right").isNotNull()).alias("cleared"), F.count_if(~F.col("correct") & (F.col("right").isNull() | (at > F.col("right")))).alias("more"))
    both = book.select(*key, F.col("wrong_count").alias("had"), "mastered").join(new, key, "full_outer")
    had, more = F.coalesce("had", F.lit(0)), F.coalesce("more", F.lit(0))
    count = F.when(F.coalesce("cleared", F.lit(False)), more).otherwise(had + more if counting else F.greatest(had, more))
    out = both.withColumn("wrong_count", count if counting else F.when(F.coalesce("cleared", F.lit(False)), F.least(count, F.lit(1))).otherwise(F.when(had > 0, had).otherwise(F.least(more, F.lit(1)))))
    return out.where("wrong_count > 0").select(*key, F.col("wrong_count").cast("long").alias("wrong_count"), F.coalesce("mastered", F.lit(False)).alias("mastered"))


def session_progress(attempts: DataFrame, session: str, turn: str = "turn") -> DataFrame:
    """(session, total, done, skipped, next_turn, finished): attempts (session, turn, state) where state is 'answered', 'skipped' or
    null for turns to come; a skipped question is passed without a grade."""
    s = F.col("state")
    out = attempts.groupBy(session).agg(F.count(F.lit(1)).alias("total"), F.count(s).alias("done"), F.count_if(s == "skipped").alias("skipped"), F.min(F.when(s.isNull(), F.col(turn))).alias("next_turn"))
    return out.withColumn("finished", F.col("next_turn").isNull())


def kpis(board: DataFrame, documents: int = 0, archived: int = 0) -> DataFrame:
    """One row of totals over a dashboard (course, chunks, questions, wrong), with the numbers of exported and archived files."""
    return board.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "questions", "wrong")]).select("*", F.lit(documents).alias("documents"), F.lit(archived).alias("archived"))
