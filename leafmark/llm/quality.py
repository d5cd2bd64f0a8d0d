"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text, with an estimated class prior, train a logistic model
that minimises the non-negative unbiased risk
    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)).
The prior is estimated first: a plain positive-against-unlabelled model is fitted on one half of
the rows, and on the other half the ratio of the two score tails, at the threshold where its upper
confidence bound is least, bounds the share of positives in the unlabelled text.

Features are read from whole texts: how character classes follow one another, and how much of the
text repeats itself. Only the fit works on a sample, of documented size, chosen by a hash; every
document is scored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_mod5, ship_package, table, with_key

FIT_ROWS = 6_000  # most rows of each kind (positives, unlabelled) that a model is fitted on
CLASSES = 12
# Character classes of bytes: 0 lower, 1 upper, 2 digit, 3 space, 4 line break, 5 full stop and comma, 6 other sentence
# marks, 7 quotes and brackets, 8 pipes, slashes and rules, 9 symbols, 10 bytes over 127, 11 the rest.
_CLASS = np.full(256, 11, np.uint8)
for _k, _chars in ((0, "abcdefghijklmnopqrstuvwxyz"), (1, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, "0123456789"), (3, " \t"), (4, "\n\r"), (5, ".,"), (6, "!?;:"), (7, "\"'()[]{}<>"), (8, "|/\\_-="), (9, "@#$%^&*+~`")):
    _CLASS[np.frombuffer(_chars.encode(), np.uint8)] = _k
_CLASS[128:] = 10
N_FEATURES = CLASSES * CLASSES + 10


def features(text: str | None) -> np.ndarray:
    raw = (text or "").encode("utf-8", "surrogatepass")
    out = np.zeros(N_FEATURES)
    k = _CLASS[np.frombuffer(raw, np.uint8)].astype(np.int64)
    if len(k) > 1:
        out[:CLASSES * CLASSES] = np.sqrt(np.bincount(k[:-1] * CLASSES + k[1:], minlength=CLASSES * CLASSES) / (len(k) - 1))
    words = raw.split()
    n = len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    x = out[CLASSES * CLASSES:]
    if n:
        numbers: dict[bytes, int] = {}
        w = np.fromiter((numbers.setdefault(a, len(numbers)) for a in words), np.int64, n)
        same = [float((w[j:] == w[:-j]).mean()) if n > j else 0.0 for j in (1, 2, 3)]
        x[0] = np.sqrt(same[0])
        x[1] = np.sqrt(max(same[1:]))
        x[2] = len(numbers) / n
        x[3] = np.bincount(w).max() / n
        x[4] = len(raw) / n / 10
        x[5] = np.log1p(n) / 10
        x[6] = len(numbers) / n * np.log1p(n) / 10
        marks = sum(a[-1] in b".!?" for a in words)
        x[7] = marks / n
    if lines:
        x[8] = 1 - len(set(lines)) / len(lines)
        x[9] = np.log1p(n / len(lines)) / 5
    return out


def _sigmoid(z):
    return 0.5 * (1 + np.tanh(0.5 * z))


class Scaled:
    """A logistic model over standardised features and their products with themselves."""

    def __init__(self, x: np.ndarray):
        self.mean, self.sd = x.mean(0), x.std(0) + 1e-3
        self.w, self.b = np.zeros(2 * x.shape[1]), 0.0

    def inputs(self, x):
        z = np.clip((x - self.mean) / self.sd, -6, 6)
        return np.concatenate([z, np.abs(z) - 0.8], 1)

    def raw(self, z):
        return z @ self.w + self.b

    def score(self, x):
        return _sigmoid(self.raw(self.inputs(x)))


def _adam(model: Scaled, grad, steps: int, rate: float = 0.02, decay: float = 1e-3):
    m = v = mb = vb = 0.0
    for t in range(1, steps + 1):
        gw, gb = grad()
        gw = gw + decay * model.w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        r = rate * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        model.w -= r * m / (np.sqrt(v) + 1e-8)
        model.b -= r * mb / (np.sqrt(vb) + 1e-8)


def fit_plain(xp: np.ndarray, xu: np.ndarray, steps: int = 300) -> Scaled:
    """Positives against unlabelled, by logistic loss with balanced classes."""
    model = Scaled(np.concatenate([xp, xu]))
    zp, zu = model.inputs(xp), model.inputs(xu)

    def grad():
        dp, du = _sigmoid(model.raw(zp)) - 1, _sigmoid(model.raw(zu))
        return (zp.T @ dp) / len(zp) + (zu.T @ du) / len(zu), dp.mean() + du.mean()
    _adam(model, grad, steps)
    return model


def estimate_prior(xp: np.ndarray, xu: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives in the unlabelled rows, by the best bin of held-out scores."""
    if min(len(xp), len(xu)) < 20:
        return 0.5
    model = fit_plain(xp[::2], xu[::2])
    p, u = np.sort(model.score(xp[1::2])), np.sort(model.score(xu[1::2]))
    cut = np.unique(np.concatenate([p, u]))
    qp, qu = 1 - np.searchsorted(p, cut) / len(p), 1 - np.searchsorted(u, cut) / len(u)
    slack = np.sqrt(np.log(4 / delta) / 2 / len(u)) + np.sqrt(np.log(4 / delta) / 2 / len(p))
    ok = qp > 0.05
    best = np.argmin((qu[ok] + slack) / qp[ok])
    return float(np.clip(qu[ok][best] / qp[ok][best], 0.05, 0.99))


def fit_pu(xp: np.ndarray, xu: np.ndarray, prior: float, steps: int = 800) -> Scaled:
    """Logistic model of least non-negative unbiased risk. Where the estimated risk of the negatives falls under
    zero, the step goes against it instead, as the method has it."""
    model = Scaled(np.concatenate([xp, xu]))
    zp, zu = model.inputs(xp), model.inputs(xu)
    model.b = float(np.log(prior / (1 - prior)))
    soft = lambda z: np.logaddexp(0, z)

    def grad():
        fp, fu = model.raw(zp), model.raw(zu)
        sp, su = _sigmoid(fp), _sigmoid(fu)
        negative = soft(fu).mean() - prior * soft(fp).mean()
        pull = prior * (sp - 1)
        gn_w, gn_b = (zu.T @ su) / len(zu) - prior * (zp.T @ sp) / len(zp), su.mean() - prior * sp.mean()
        if negative < 0:
            return -gn_w, -gn_b
        return (zp.T @ pull) / len(zp) + gn_w, pull.mean() + gn_b
    _adam(model, grad, steps)
    return model


def _hash_sample(df: DataFrame, rows: int) -> DataFrame:
    """At most `rows` rows, the first by a hash of doc_id; a threshold on the hash spares the rest the sort."""
    h = F.xxhash64(F.col("doc_id"), F.lit("fit"))
    n = df.count()
    df = df.withColumn("fit_hash", h)
    if n > rows:
        df = df.where(F.pmod(F.col("fit_hash"), F.lit(1_000_000)) < int(min(1.0, 1.3 * rows / n + 1e-5) * 1_000_000))
    return df.orderBy("fit_hash", "doc_id").limit(rows).drop("fit_hash")


def _fit_features(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents of ids, a sample of bounded size. Of rows that share a doc_id, the smallest text counts."""
    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "x": [features(t) for t in pdf["text"]]})
    got = with_key(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text")), "doc_id", run, "doc_id long, x array<double>").toPandas()
    got = got.sort_values("doc_id", kind="stable").sample(frac=1, random_state=0)  # one order, whatever the partitions
    return np.stack(list(got["x"])) if len(got) else np.empty((0, N_FEATURES))


def train(docs: DataFrame, positives: DataFrame, fit_rows: int = FIT_ROWS) -> Scaled:
    """docs: unlabelled (doc_id, text); positives (doc_id): trusted ones among them.

    Fitted on at most fit_rows positives and fit_rows unlabelled rows, chosen by a hash of their ids, so the
    samples that are broadcast and collected are bounded. With no positives or no documents the model gives
    one half to every text.
    """
    ship_package(docs.sparkSession)
    xp = _fit_features(docs, _hash_sample(positives.select("doc_id").distinct(), fit_rows))
    xu = _fit_features(docs, _hash_sample(docs.select("doc_id").distinct(), fit_rows))
    if not len(xp) or not len(xu):
        return Scaled(np.zeros((1, N_FEATURES)))
    return fit_pu(xp, xu, estimate_prior(xp, xu))


def score(docs: DataFrame, model: Scaled) -> DataFrame:
    """(doc_id, score double): one row per document; null and empty texts are scored as empty."""
    ship_package(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            x = np.stack([features(t) for t in pdf["text"]]) if len(pdf) else np.empty((0, N_FEATURES))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "score": model.score(x)})
    return with_key(docs.select("doc_id", "text"), "doc_id", run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Scaled, threshold: float = 0.3) -> DataFrame:
    """The documents whose score reaches threshold, with all of their columns as they are."""
    ship_package(docs.sparkSession)

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            if texts:
                yield batch.filter(pa.array(model.score(np.stack([features(t) for t in texts])) >= threshold))
    return docs.mapInArrow(run, docs.schema)


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of positives to learn from: those of quality 1 whose fold is not held out."""
    return labels.where((F.col("quality") == 1) & (crc_mod5(F.col("doc_id")) != 0)).select("doc_id").distinct()


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(crc_mod5(F.col("doc_id")) != 0), trusted(table(spark, sf_dir, "labels")))
    return score(docs, model).select(
        "doc_id", (crc_mod5(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
