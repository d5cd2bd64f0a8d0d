"""Language-model scoring by deleted interpolation.

p(w | v) = a[b] * c(v, w) / c(v) + u[b] * c(w) / N + z[b] / (V + 1), where b is the bucket of
c(v), the context's frequency (powers of two). The mixture weights of each bucket are learned by
expectation-maximisation on a deleted block: a tenth of the training documents, whose own counts
are taken off the totals before their tokens are used.

Counts cover all training tokens (words and pairs are told apart by 64-bit hashes). They are exchanged between chunks of texts and
buckets of the key space as packed arrays (see chunks.py). The EM step sees the block's tokens as
a histogram of (bucket, bigram probability, unigram probability) on a fixed log grid: every token
counts, and what reaches the driver has a bounded number of cells.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import CHUNK_SCHEMA, by_bucket, chunker, dec, enc
from .common import MOST_PARTS, crc_mod5, ship_package, stored, stored_by, table

#: A space and a line break cannot be words, so they stand for the end and for the start.
END, START = b" ", b"\n"
BUCKETS, GRID, CELLS = 24, 20, 240  # context-frequency buckets; cells for each power of ten; most cells
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _tokens(text: str) -> list[bytes]:
    words = text.encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    words.append(END)
    return words


def _word_keys(words: list[bytes]) -> bytes:
    return enc(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * _A + (b ^ (b >> np.uint64(29))) * _B
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


class Chunk:
    """A chunk's tokens and bigrams by local number."""

    def __init__(self, row):
        self.keys = dec(row["vocab"]).astype(np.uint64)
        self.ids = dec(row["ids"]).astype(np.int64)
        self.lens = dec(row["lens"]).astype(np.int64)
        self.train = dec(row["marks"]).astype(bool)
        self.first = np.cumsum(self.lens) - self.lens
        self.n = n = len(self.keys)  # the number of START
        self.context = np.empty_like(self.ids)
        self.context[1:] = self.ids[:-1]
        self.context[self.first] = n
        self.pairs, self.pair_of = np.unique(self.context * n + self.ids, return_inverse=True)

    def pair_keys(self) -> np.ndarray:
        keys = np.append(self.keys, np.uint64(xxhash.xxh3_64_intdigest(START)))
        return _pair_keys(keys[self.pairs // self.n], keys[self.pairs % self.n])

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Of words and of pairs, in training documents."""
        in_train = np.repeat(self.train, self.lens)
        return np.bincount(self.ids[in_train], minlength=self.n), np.bincount(self.pair_of[in_train], minlength=len(self.pairs))


def _ask(n_buckets: tuple[int, int]):
    def run(batches):
        for pdf in batches:
            for _, row in pdf.iterrows():
                c = Chunk(row)
                for kind, keys, counts in zip((1, 2), (c.keys, c.pair_keys()), c.counts(), strict=True):
                    n = n_buckets[kind - 1]
                    order, bounds = by_bucket((keys % np.uint64(n)).astype(np.int64), n)
                    out = []
                    for b in range(n):
                        own = order[bounds[b]:bounds[b + 1]]
                        if len(own):
                            out.append((kind, b, row["chunk"], int(row["part"]), enc(keys[own]), enc(counts[own])))
                    if out:
                        yield pd.DataFrame(out, columns=["kind", "bucket", "chunk", "part", "keys", "counts"])
    return run


def _answer(pdf: pd.DataFrame) -> pd.DataFrame:
    """Totals, and for chunks of the block also the block's own counts, in the order asked; the row
    of chunk -1 has the bucket's distinct keys and mass."""
    keys = [dec(x).astype(np.uint64) for x in pdf["keys"]]
    counts = np.concatenate([dec(x).astype(np.int64) for x in pdf["counts"]])
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    of_block = np.repeat(pdf["part"].to_numpy() == 1, sizes)
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(where, weights=counts, minlength=len(distinct)).astype(np.int64)
    block = np.bincount(where[of_block], weights=counts[of_block], minlength=len(distinct)).astype(np.int64)
    ends = np.cumsum(sizes)
    kind, bucket = int(pdf["kind"].iloc[0]), int(pdf["bucket"].iloc[0])
    out = [(kind, bucket, chunk, part, enc(total[where[b - n:b]]), enc(block[where[b - n:b]]) if part == 1 else None, 0, 0)
           for chunk, part, n, b in zip(pdf["chunk"], pdf["part"], sizes.tolist(), ends.tolist(), strict=True)]
    out.append((kind, bucket, -1, -1, None, None, int((total > 0).sum()), int(total.sum())))
    return pd.DataFrame(out, columns=["kind", "bucket", "chunk", "part", "total", "block", "n_distinct", "mass"])


_ANSWER_SCHEMA = "kind int, bucket int, chunk long, part int, total binary, block binary, n_distinct long, mass long"


def _gathered(c: Chunk, right: pd.DataFrame, n_buckets: tuple[int, int], column: str) -> tuple[np.ndarray, np.ndarray]:
    """The answers for words and for pairs by local number."""
    out = []
    for kind, keys in ((1, c.keys), (2, c.pair_keys())):
        n = n_buckets[kind - 1]
        order, _ = by_bucket((keys % np.uint64(n)).astype(np.int64), n)
        values = np.zeros(len(keys), np.int64)
        got = right[right["kind"] == kind].sort_values("bucket")
        if len(got):
            values[order] = np.concatenate([dec(x).astype(np.int64) for x in got[column]])
        out.append(values)
    return out[0], out[1]


def _log_bucket(c: np.ndarray) -> np.ndarray:
    """0 for an unseen context, else 1 + floor(log2), at most BUCKETS - 1."""
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(np.int64), BUCKETS - 1), 0)


def _cell(p: np.ndarray) -> np.ndarray:
    """0 for nothing, else 1 + the cell of -log10 p."""
    return np.where(p > 0, 1 + np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * GRID), CELLS - 2).astype(np.int64), 0)


def learn_weights(hist: np.ndarray, floor: float, rounds: int = 200) -> np.ndarray:
    """hist: rows (bucket, bigram cell, unigram cell, n). EM for each bucket: rows of three weights."""
    back = lambda q: np.where(q > 0, 10.0 ** (-(q - 1) / GRID), 0.0)
    weights = np.tile([0.4, 0.5, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    for b in range(BUCKETS):
        h = hist[hist[:, 0] == b]
        if not len(h):
            continue
        p = np.stack([back(h[:, 1]), back(h[:, 2]), np.full(len(h), floor)], 1)
        w, n = weights[b], h[:, 3].astype(float)
        for _ in range(rounds):
            part = w * p
            part /= part.sum(1, keepdims=True)
            w = (part * n[:, None]).sum(0) / n.sum()
            w = np.maximum(w, [0, 1e-6, 1e-6])
            w /= w.sum()
        weights[b] = w
    return weights


def score(docs: DataFrame, held_out, chunk_chars: int = 8_000_000, bucket_keys: int = 2_000_000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    docs needs doc_id and text; other columns are ignored. held_out is a boolean column: its rows
    are scored and never learned from. Null and empty texts have the end token alone. Repeated rows
    each count and are each scored. An empty table gives no rows; with no training rows all words
    are unknown and the fallback weights hold.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    held = F.coalesce(held_out, F.lit(False))
    in_block = ~held & (F.pmod(F.xxhash64(F.col("doc_id"), F.lit("deleted block")), F.lit(10)) == 0)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", (~held).cast("int").alias("mark"), in_block.cast("int").alias("part"))
    chunks = stored_by(spark, rows.mapInPandas(chunker(_tokens, _word_keys, chunk_chars), CHUNK_SCHEMA), "lm-chunks", "chunk", rows.rdd.getNumPartitions())
    sums = chunks.agg(F.sum("n_keys"), F.sum("n_tokens")).first()
    n_buckets = (max(1, -(-(sums[0] or 0) // bucket_keys)), max(1, -(-(sums[1] or 0) // bucket_keys)))
    asked = chunks.select("chunk", "part", "lens", "marks", "ids", "vocab").mapInPandas(
        _ask(n_buckets), "kind int, bucket int, chunk long, part int, keys binary, counts binary")
    # as many partitions as buckets: what a task reads does not grow with the input
    dealt = asked.repartition(min(sum(n_buckets), MOST_PARTS), "kind", "bucket")
    answers, _ = stored(spark, dealt.groupBy("kind", "bucket").applyInPandas(_answer, _ANSWER_SCHEMA), "lm-answers", "uncompressed")
    facts = {r["kind"]: r for r in answers.where("chunk < 0").groupBy("kind").agg(F.sum("n_distinct").alias("v"), F.sum("mass").alias("n")).collect()}
    total, vocab = (int(facts[1]["n"]), int(facts[1]["v"])) if 1 in facts else (0, 0)
    own = _documents(chunks)
    n_docs, block_docs, block_tokens = own["train"], own["block"], own["block_tokens"]
    floor = 1.0 / (vocab + 1)

    def probabilities(c: Chunk, word, pair, n_tokens, docs_):
        context = np.append(word, docs_)[c.context]
        p2 = np.where(context > 0, pair[c.pair_of] / np.maximum(context, 1), 0.0)
        p1 = word[c.ids] / max(n_tokens, 1)
        return context, p2, p1

    def histogram(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        cols = ["bucket", "q2", "q1", "n"]
        if not len(left) or not len(right):
            return pd.DataFrame({x: [] for x in cols})
        c = Chunk(left.iloc[0])
        (w, p), (bw, bp) = _gathered(c, right, n_buckets, "total"), _gathered(c, right, n_buckets, "block")
        context, p2, p1 = probabilities(c, w - bw, p - bp, total - block_tokens, n_docs - block_docs)
        cells, n = np.unique((_log_bucket(context) * CELLS + _cell(p2)) * CELLS + _cell(p1), return_counts=True)
        return pd.DataFrame({"bucket": cells // (CELLS * CELLS), "q2": cells // CELLS % CELLS, "q1": cells % CELLS, "n": n})[cols]

    cols = ["chunk", "doc_ids", "lens", "marks", "ids", "vocab"]
    paired = lambda where, f, schema: chunks.where(where).select(*cols).groupBy("chunk").cogroup(
        answers.where("chunk >= 0").where(where).select("chunk", "kind", "bucket", "total", "block").groupBy("chunk")).applyInPandas(f, schema)
    cells = paired("part = 1", histogram, "bucket long, q2 long, q1 long, n long").groupBy("bucket", "q2", "q1").agg(F.sum("n").alias("n"))
    hist = np.array([tuple(r) for r in cells.collect()], np.int64).reshape(-1, 4)  # at most BUCKETS * CELLS * CELLS rows
    weights = learn_weights(hist, floor)
    base_floor = np.log10(total + 0.5 * (vocab + 1))

    def scored(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(left.iloc[0])
        w, p = _gathered(c, right, n_buckets, "total")
        context, p2, p1 = probabilities(c, w, p, total, n_docs)
        mix = weights[_log_bucket(context)]
        lp = np.log10(mix[:, 0] * p2 + mix[:, 1] * p1 + mix[:, 2] * floor)
        seen = w[c.ids]
        return pd.DataFrame({
            "doc_id": list(left["doc_ids"].iloc[0]), "held_out": ~c.train, "n_tokens": c.lens,
            "n_known": np.add.reduceat((seen > 0).astype(np.int64), c.first), "train_tokens": total,
            "base_score": np.add.reduceat(np.log10(seen + 0.5), c.first) - c.lens * base_floor,
            "score": np.add.reduceat(lp, c.first)})

    return paired("part >= 0", scored, "doc_id string, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double").withColumn(
        "doc_id", F.col("doc_id").cast("long"))


def _documents(chunks: DataFrame) -> dict[str, int]:
    def run(batches):
        for pdf in batches:
            train = [int(dec(m).astype(np.int64).sum()) for m in pdf["marks"]]
            yield pd.DataFrame({"train": train, "block": [t if p == 1 else 0 for t, p in zip(train, pdf["part"], strict=True)],
                                "block_tokens": [n if p == 1 else 0 for n, p in zip(pdf["n_tokens"], pdf["part"], strict=True)]})
    got = chunks.select("part", "marks", "n_tokens").mapInPandas(run, "train long, block long, block_tokens long").agg(
        F.sum("train").alias("train"), F.sum("block").alias("block"), F.sum("block_tokens").alias("block_tokens")).first()
    return {k: int(v or 0) for k, v in got.asDict().items()}


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, crc_mod5(F.col("doc_id")) == 1)
