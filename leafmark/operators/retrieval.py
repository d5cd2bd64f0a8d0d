"""Search over an ordered corpus: postings, BM25, title matching, and batches of queries with refusal.

A corpus is a DataFrame (pos long, text string, is_title boolean, level int, ...): pos is the
order of the corpus and breaks ties; it is unique. The index is one row for each of them with its terms counted, document
frequencies, and one row of totals. The terms of a batch of queries go to every task, which keeps the best rows of each
query as the corpus streams by, so no row for each query and corpus row is ever made.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.segment import is_function_run
from leafmark.functions.text import TokenProfile, tokens
from leafmark.sources.tables import drop_stored, ship_package, stored

K1, B = 1.5, 0.75
#: Scores are compared at this many digits, so that the order of summation cannot swap ties.
DIGITS = 9


@dataclass(frozen=True)
class Ranking:
    """How answers are ranked and cut: most sections and passages, digits that scores are compared at, and whether sections
    alone are answer enough to keep passages to those with all known terms."""

    sections: int = 5
    passages: int = 5
    digits: int = DIGITS
    sections_suffice: bool = True


#: The offline reader's: coarser scores, and passages relax whatever the sections say.
READER = Ranking(6, 10, 3, False)
#: Query terms up to so many are sent to every task; with more of them postings of a term are dealt over SALTS.
BROADCAST_TERMS, SALTS = 500_000, 16
#: A task scores so many pairs of query and corpus row at once.
CELLS = 500_000


@dataclass
class Index:
    """docs (pos, is_title, level, dl, counts array<struct<term, tf>>), tf (pos, is_title, dl, term, tf), df (term, df, idf),
    dl (pos, dl), totals (n, avgdl), titles (pos, level, n_tokens, term)."""

    corpus: DataFrame
    docs: DataFrame
    tf: DataFrame
    df: DataFrame
    dl: DataFrame
    totals: DataFrame
    titles: DataFrame
    paths: tuple[str, ...] = ()

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """A table that a search reads several times: written once, where the index is."""
        if not self.paths:
            return df
        out, path = stored(df.sparkSession, df, name)
        self.paths += (path,)
        return out

    def drop(self) -> None:
        """Delete the index's tables."""
        if self.paths:
            drop_stored(self.corpus.sparkSession, *self.paths)
            self.paths = ()


def build_index(corpus: DataFrame, profile: TokenProfile = TokenProfile(), store: bool = False) -> Index:
    """Documents without terms stay in the count and in the average length. A column `terms`, where the corpus has one, is
    taken for the terms of its text. With store, terms, postings and document frequencies are written once to the shared
    folder, for all searches to read; drop() deletes them."""
    spark, paths = corpus.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        if not store:
            return df
        out, path = stored(spark, df, name)
        paths.append(path)
        return out

    docs = kept(corpus.select("pos", "is_title", "level", F.sort_array(_terms(corpus, "text", profile)).alias("s")).select(
        "pos", "is_title", F.coalesce("level", F.lit(9)).alias("level"), F.size("s").alias("dl"), _counted(F.col("s")).alias("counts")), "index-documents")
    dl = docs.select("pos", "dl")
    tf = docs.select("pos", "is_title", "dl", F.inline("counts"))
    totals = kept(dl.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl")), "index-totals")
    df = kept(docs.select(F.explode("counts.term").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(totals.select("n"))).select(
        "term", "df", F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0).alias("idf")), "index-df")
    titles = docs.where("is_title").select("pos", "level", F.size("counts").alias("n_tokens"), F.explode("counts.term").alias("term"))
    return Index(corpus, docs, tf, df, dl, totals, titles, tuple(paths))


def _counted(s):
    """array<struct<term, tf>> of sorted terms: where they change, and how far it is to the next change."""
    def count(s):
        starts = F.filter(F.transform(s, lambda x, k: F.when((k == 0) | (F.get(s, k - 1) != x), k)), lambda k: k.isNotNull())
        sizes = lambda at: F.transform(at, lambda k, j: F.struct(F.get(s, k).alias("term"), (F.coalesce(F.get(at, j + 1), F.size(s)) - k).cast("long").alias("tf")))
        return F.get(F.transform(F.array(starts), sizes), F.lit(0))
    return F.get(F.transform(F.array(s), count), F.lit(0))


def _terms(df: DataFrame, text: str, profile: TokenProfile):
    return F.coalesce("terms", F.expr("array()").cast("array<string>")) if "terms" in df.columns else tokens(F.col(text), profile)


def query_terms(queries: DataFrame, profile: TokenProfile = TokenProfile()) -> DataFrame:
    """(qid, term, times): distinct terms of each query and how often it says them."""
    return queries.select("qid", F.explode(_terms(queries, "query", profile)).alias("term")).groupBy("qid", "term").agg(F.count(F.lit(1)).alias("times"))


@dataclass
class Known:
    """Query terms that the corpus knows: (qid, term, idf), and the same as rows where they are few enough for every task."""

    frame: DataFrame
    rows: list | None


def known_terms(index: Index, terms: DataFrame | Known) -> Known:
    if isinstance(terms, Known):
        return terms
    frame = index.keep(terms.select("qid", "term").join(index.df.select("term", "idf"), "term").select("qid", "term", "idf"), "query-terms")
    rows = frame.take(BROADCAST_TERMS + 1)
    return Known(frame, rows if len(rows) <= BROADCAST_TERMS else None)


def _meet(postings: DataFrame, index: Index, terms: DataFrame | Known) -> DataFrame:
    """Postings joined with the idf of the query terms (qid, term) that the corpus knows. Neither side's common terms end up
    in one task: few query terms are broadcast, many are copied for each salt."""
    known = known_terms(index, terms)
    if known.rows is not None:
        return postings.join(F.broadcast(known.frame), "term")
    copies = known.frame.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return postings.withColumn("salt_", F.pmod(F.xxhash64("pos"), F.lit(SALTS)).cast("int")).join(copies, ["term", "salt_"]).drop("salt_")


class _Cells:
    """Query terms as arrays, and the cells (corpus row, query) that share terms with a batch of corpus rows."""

    def __init__(self, rows: list):
        self.qids = list(dict.fromkeys(r["qid"] for r in rows))
        q = {v: k for k, v in enumerate(self.qids)}
        by_term: dict = {}
        for r in rows:
            by_term.setdefault(r["term"], (r["idf"], []))[1].append(q[r["qid"]])
        self.terms = list(by_term)
        self.idf = np.array([v[0] for v in by_term.values()], float)
        self.n = np.array([len(v[1]) for v in by_term.values()], np.int64)
        self.first = np.cumsum(self.n) - self.n
        self.queries = np.array([k for v in by_term.values() for k in v[1]], np.int64)
        self.n_known = np.bincount(self.queries, minlength=len(self.qids))

    def of(self, batch, weight):
        """Slices of (corpus row of the batch, query, sum of weight(row, term, tf), matched terms)."""
        counts = batch.column("counts")
        flat = counts.flatten()
        names = flat.field("term")
        row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(counts), 0).to_numpy(zero_copy_only=False))
        term = pc.fill_null(pc.index_in(names, value_set=pa.array(self.terms, names.type)), -1).to_numpy(zero_copy_only=False)
        hit = term >= 0
        row, term, tf = row[hit], term[hit], flat.field("tf").to_numpy(zero_copy_only=False)[hit]
        w, nq = weight(row, term, tf), len(self.qids)
        step = max(1, CELLS // max(nq, 1))
        for at in range(0, batch.num_rows, step):
            a, b = np.searchsorted(row, [at, at + step])
            if a == b:
                continue
            n = self.n[term[a:b]]
            pairs = np.arange(n.sum()) + np.repeat(self.first[term[a:b]] - (np.cumsum(n) - n), n)
            cell = np.repeat((row[a:b] - at) * nq, n) + self.queries[pairs]
            matched = np.bincount(cell)
            some = np.flatnonzero(matched)
            yield at + some // nq, some % nq, np.bincount(cell, np.repeat(w[a:b], n))[some], matched[some]


def _rounded(x, digits: int):
    return np.floor(x * 10.0**digits + 0.5) / 10.0**digits


class _Best:
    """The k best cells of each query so far: least by the columns named, the first being the most important."""

    def __init__(self, nq: int, k: int, order: tuple[str, ...]):
        self.k, self.order, self.kept, self.worst = k, order, None, np.full(nq, np.inf)

    def add(self, cells: dict) -> None:
        near = cells[self.order[0]] <= self.worst[cells["q"]]
        new = {c: v[near] for c, v in cells.items()}
        if not len(new["q"]):
            return
        if self.kept is not None:
            new = {c: np.concatenate([self.kept[c], v]) for c, v in new.items()}
        by = np.lexsort([new[c] for c in reversed(self.order)] + [new["q"]])
        q = new["q"][by]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.kept = {c: v[by[rank < self.k]] for c, v in new.items()}
        full = by[rank == self.k - 1]
        self.worst[new["q"][full]] = new[self.order[0]][full]


def _best_cells(rows: DataFrame, known: Known, k: int, kinds: tuple[bool, ...], order: tuple[str, ...], weight, columns) -> DataFrame:
    """(qid, exact, pos, level, hits, score) of the k best cells of each query and task, where the cells exist; exact ones have
    all known terms. columns(batch, row, sum, matched) gives what they are ordered by."""
    spark, made = rows.sparkSession, _Cells(known.rows)
    out = "q int, exact boolean, pos long, level int, hits long, score double"
    ship_package(spark)

    def run(batches):
        best = {e: _Best(len(made.qids), k, order) for e in kinds}
        for batch in batches:
            for row, q, total, matched in made.of(batch, weight(made, batch)):
                cells = {"q": q, **columns(batch, row, total, matched)}
                for e, b in best.items():
                    fit = (cells["score"] > 1e-9) & ((matched == made.n_known[q]) | (not e))
                    b.add({c: v[fit] for c, v in cells.items()})
        for e, b in best.items():
            if b.kept is not None:
                x = b.kept
                yield pa.RecordBatch.from_pydict({"q": pa.array(x["q"], pa.int32()), "exact": [e] * len(x["q"]), "pos": pa.array(x["pos"], pa.int64()), "level": pa.array(x["level"], pa.int32()),
                                                  "hits": pa.array(x["hits"], pa.int64()), "score": pa.array(x["score"], pa.float64())})
    kind = known.frame.schema["qid"].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(made.qids)), f"q int, qid {kind}")
    return rows.mapInArrow(run, out).join(F.broadcast(names), "q").drop("q")


def _column(batch, name: str):
    return batch.column(name).to_numpy(zero_copy_only=False)


def bm25(index: Index, terms: DataFrame, digits: int = DIGITS, passages_only: bool = False) -> DataFrame:
    """(qid, pos, score, matched): BM25 of every corpus row that has a term of the query."""
    t = F.col("tf").cast("double")
    dl, avg = F.greatest(F.col("dl"), F.lit(1)).cast("double"), F.when(F.col("avgdl") > 0, F.col("avgdl")).otherwise(1.0)
    part = F.col("idf") * t * (K1 + 1.0) / (t + K1 * (1.0 - B + B * dl / avg))
    postings = index.tf.where("not is_title") if passages_only else index.tf
    return _meet(postings, index, terms).crossJoin(F.broadcast(index.totals)).groupBy("qid", "pos").agg(
        F.round(F.sum(part), digits).alias("score"), F.count(F.lit(1)).alias("matched"))


def title_hits(index: Index, terms: DataFrame | Known, k: int = 5, digits: int = DIGITS) -> DataFrame:
    """(qid, rank, pos, hits, score): titles by distinct terms hit, then level, then score, then order."""
    known = known_terms(index, terms)
    if known.rows is None:
        hit = _meet(index.titles, index, known).groupBy("qid", "pos", "level", "n_tokens").agg(F.count(F.lit(1)).alias("hits"), F.sum("idf").alias("s"))
        scored = hit.withColumn("score", F.round(F.col("s") * F.col("hits") / F.col("n_tokens"), digits))
    else:
        def columns(batch, row, total, matched):
            level, size = _column(batch, "level")[row], pc.list_value_length(batch.column("counts")).to_numpy(zero_copy_only=False)[row]
            score = _rounded(total * matched / size, digits)
            return {"least": np.clip(level, 0, 63) / 64.0 - matched, "fewer": -matched, "level": level, "lower": -score, "pos": _column(batch, "pos")[row], "hits": matched, "score": score}
        titles = index.docs.where("is_title").select(F.col("pos").cast("long").alias("pos"), F.col("level").cast("int").alias("level"), "counts")
        scored = _best_cells(titles, known, k, (False,), ("least", "fewer", "level", "lower", "pos"), lambda made, _: lambda row, term, tf: made.idf[term], columns)
    w = Window.partitionBy("qid").orderBy(F.desc("hits"), "level", F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "rank", "pos", "hits", "score")


def passage_hits(index: Index, terms: DataFrame | Known, k: int = 5, digits: int = DIGITS) -> DataFrame:
    """(qid, exact, rank, pos, score): the k best passages of each query by BM25, of all that share a term with it (exact false)
    and of those that have all its known terms (exact true)."""
    known = known_terms(index, terms)
    if known.rows is None:
        n = known.frame.groupBy("qid").agg(F.count(F.lit(1)).alias("n_known"))
        scored = bm25(index, known, digits, True).where("score > 1e-9").join(n, "qid")
        scored = scored.withColumn("exact", F.explode(F.when(F.col("matched") == F.col("n_known"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    else:
        avg = index.totals.first()["avgdl"] or 1.0

        def weight(made, batch):
            norm = K1 * (1.0 - B + B * np.maximum(_column(batch, "dl"), 1) / avg)
            return lambda row, term, tf: made.idf[term] * tf * (K1 + 1.0) / (tf + norm[row])

        def columns(batch, row, total, matched):
            score = _rounded(total, digits)
            return {"lower": -score, "pos": _column(batch, "pos")[row], "level": np.zeros(len(row), np.int32), "hits": matched, "score": score}
        rows = index.docs.where("not is_title").select(F.col("pos").cast("long").alias("pos"), "dl", "counts")
        scored = _best_cells(rows, known, k, (False, True), ("lower", "pos"), weight, columns)
    w = Window.partitionBy("qid", "exact").orderBy(F.desc("score"), "pos")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "exact", "rank", "pos", "score")


def plan_queries(index: Index, queries: DataFrame, profile: TokenProfile = TokenProfile(), rare_df: int = 2) -> DataFrame:
    """One row per query: n_tokens, n_known (distinct), used, missing, refused ('' or a status).

    Where queries have a column `unknown` (runs that no term covers), these are missing too, and a query of nothing else is
    'not_found' unless they are function words alone."""
    toks = queries.select("qid", _terms(queries, "query", profile).alias("toks"))
    each = toks.select("qid", F.posexplode("toks").alias("at", "term")).join(index.df.select("term", "df"), "term", "left")
    said = each.groupBy("qid").agg(
        F.count(F.lit(1)).alias("n_tokens"), F.countDistinct(F.when(F.col("df").isNotNull(), F.col("term"))).alias("n_known"), F.max("df").alias("most"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("df").isNotNull(), F.struct("at", "term")))), lambda x: x["term"]).alias("used"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("df").isNull(), F.struct("at", "term")))), lambda x: x["term"]).alias("missing"))
    none = F.expr("array()").cast("array<string>")
    runs = F.coalesce("unknown", none) if "unknown" in queries.columns else none
    return queries.select("qid", runs.alias("runs")).join(said, "qid", "left").select(
        "qid", F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"), F.coalesce("n_known", F.lit(0)).alias("n_known"),
        F.coalesce("used", none).alias("used"), F.concat(F.coalesce("missing", none), "runs").alias("missing"),
        F.when((F.coalesce("n_tokens", F.lit(0)) == 0) & F.exists("runs", lambda r: ~is_function_run(r)), "not_found")
        .when(F.coalesce("n_tokens", F.lit(0)) == 0, "empty_query").when(F.col("n_known") == 0, "not_found")
        .when((F.col("n_tokens") >= 2) & (F.col("most") <= rare_df), "not_found").otherwise("").alias("refused"))


def _passes(index: Index, queries: DataFrame, profile: TokenProfile, ranking: Ranking, rare_df: int):
    plan = index.keep(plan_queries(index, queries, profile, rare_df), "query-plan")
    known = known_terms(index, query_terms(queries, profile).join(plan.where("refused = ''").select("qid"), "qid"))
    sections = index.keep(title_hits(index, known, ranking.sections, ranking.digits), "query-sections")
    scored = index.keep(passage_hits(index, known, ranking.passages, ranking.digits), "query-passages")
    strict = scored.groupBy("qid").agg(F.max("exact").alias("has_all"))
    n_sections = sections.groupBy("qid").agg(F.count(F.lit(1)).alias("n_sections"))
    enough = (F.coalesce("n_sections", F.lit(0)) > 0) & F.lit(ranking.sections_suffice)
    mode = plan.join(n_sections, "qid", "left").join(strict, "qid", "left").withColumn("use_all", enough | F.coalesce("has_all", F.lit(False)))
    passages = scored.join(mode.select("qid", "use_all"), "qid").where("exact = use_all").select("qid", "rank", "pos", "score")
    return plan, mode, sections, passages


def search(index: Index, queries: DataFrame, profile: TokenProfile = TokenProfile(), k: int = 5, rare_df: int = 2, ranking: Ranking | None = None) -> DataFrame:
    """One row per query (qid, query): status, n_tokens, n_known, used_tokens, missing_tokens, relax_rounds, n_sections, n_passages, message.

    First all known terms must match; only where neither a title nor a passage answers are single terms
    enough, which counts as one relaxing round. Queries without terms are 'empty_query'; those whose terms
    are all unknown, or all rare while there are two or more, are 'not_found'. Queries may bring `terms` and `unknown` of
    their own (see functions.segment).
    """
    plan, mode, _, passages = _passes(index, queries, profile, ranking or Ranking(k, k), rare_df)
    n = passages.groupBy("qid").agg(F.count(F.lit(1)).alias("n_passages"))
    got = mode.join(n, "qid", "left").withColumn("n_sections", F.coalesce("n_sections", F.lit(0))).withColumn("n_passages", F.coalesce("n_passages", F.lit(0)))
    found = (F.col("refused") == "") & ((F.col("n_sections") > 0) | (F.col("n_passages") > 0))
    status = F.when(F.col("refused") != "", F.col("refused")).when(found, "ok").otherwise("not_found")
    return got.select(
        "qid", status.alias("status"), "n_tokens", "n_known", F.col("used").alias("used_tokens"), F.col("missing").alias("missing_tokens"),
        F.when(F.col("refused") != "", 0).when(F.col("use_all"), 0).otherwise(F.when(found, 1).otherwise(2)).alias("relax_rounds"),
        F.col("n_sections"), F.col("n_passages"),
        F.when(F.size("missing") > 0, F.array_join("missing", "、")).otherwise("").alias("message"))


def search_hits(index: Index, queries: DataFrame, profile: TokenProfile = TokenProfile(), k: int = 5, rare_df: int = 2, ranking: Ranking | None = None) -> DataFrame:
    """(qid, kind, rank, pos, score): the sections and passages that search() answers with; scores to four digits."""
    _, _, sections, passages = _passes(index, queries, profile, ranking or Ranking(k, k), rare_df)
    return sections.select("qid", F.lit("section").alias("kind"), "rank", "pos", F.round("score", 4).alias("score")).unionByName(
        passages.select("qid", F.lit("passage").alias("kind"), "rank", "pos", F.round("score", 4).alias("score")))


def term_ids(corpus: DataFrame, profile: TokenProfile = TokenProfile(), span: int = 1024) -> DataFrame:
    """(term, term_id): numbers in order of first sight.

    Terms are numbered inside spans of `span` corpus positions, spans inside groups of `span` spans, and groups by a running
    total of their sizes: the only ordering over everything has one row for each span * span positions.
    """
    first = corpus.select("pos", F.posexplode(tokens(F.col("text"), profile)).alias("at", "term")).groupBy("term").agg(F.min(F.struct("pos", "at")).alias("seen"))
    first = first.withColumn("_span", F.floor(F.col("seen.pos") / span)).withColumn("_group", F.floor(F.col("_span") / span))
    before = lambda w: F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = first.groupBy("_group", "_span").agg(F.count(F.lit(1)).alias("_n"))
    groups = sizes.groupBy("_group").agg(F.sum("_n").alias("_n")).select("_group", before(Window.orderBy("_group")).alias("_base"))
    spans = sizes.select("_group", "_span", before(Window.partitionBy("_group").orderBy("_span")).alias("_off"))
    k = F.row_number().over(Window.partitionBy("_span").orderBy("seen")) - 1
    return first.withColumn("_k", k).join(spans.join(groups, "_group").drop("_group"), "_span").select("term", (F.col("_k") + F.col("_off") + F.col("_base")).alias("term_id"))


def corpus_stats(index: Index) -> DataFrame:
    c = index.corpus
    page = F.col("page_no") if "page_no" in c.columns else F.lit(None).cast("int")
    base = c.agg(
        F.count(F.lit(1)).alias("chunks"), F.count_if(F.col("is_title")).alias("titles"), F.count_if(~F.col("is_title")).alias("passages"),
        F.min(page).alias("page_min"), F.max(page).alias("page_max"), F.round(F.avg(F.length("text"))).cast("long").alias("avg_len"))
    return base.crossJoin(index.df.agg(F.count(F.lit(1)).alias("vocab")))
