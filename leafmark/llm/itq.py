"""Embedding near-dedup by iterative quantisation.

A rotation that makes sign bits of centred vectors keep most of their information is learned by
alternating between codes and an orthogonal fit (on a bounded, hash-chosen sample); thresholds at
the medians balance the bits. Every vector is indexed: its codes are cut into substrings, one
Hamming table for each, and vectors that share a substring in any table meet. Several rotations
give independent codes. Substrings grow with the number of vectors and meet less often, so rotations
are added until RECALL of the pairs at the threshold, measured on partners made for sampled vectors,
meet in some table. What meets is screened by Hamming distance on the codes and reranked by
cosine on the original vectors in double precision.

Equal vectors are one class with a count, so copies are never paired. Buckets of any size are
compared in blocks; only sums for each vector and a forest of links leave a block, never its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, ship_package, stored, table

THRESHOLD = 0.95
ROTATIONS = 4  # rotations at the least; their codes are screened by Hamming distance
RECALL = 0.999  # share of the pairs at the threshold that meet
STEPS = 64  # rotations at one width of the substrings; where they do not reach RECALL, substrings get shorter
FIT_ROWS = 20_000  # most vectors that the rotations are learned from
BLOCK = 512


def rotation(sample: np.ndarray, rounds: int = 30, seed: int = 7) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(projection d x bits, thresholds bits) of one rotation after another; as many bits as dimensions, up to 64."""
    d = sample.shape[1]
    bits = min(64, d)
    unit = sample / np.maximum(np.linalg.norm(sample, axis=1, keepdims=True), 1e-300)
    mean = unit.mean(0)
    _, _, vt = np.linalg.svd(unit - mean, full_matrices=False) if len(unit) > 1 else (0, 0, np.eye(d))
    basis = np.zeros((d, bits))
    basis[:, :min(bits, len(vt))] = vt[:bits].T
    v = (unit - mean) @ basis
    for r in count():
        q, _ = np.linalg.qr(np.random.default_rng(seed + r).normal(size=(bits, bits)))
        for _ in range(rounds):
            b = np.where(v @ q >= 0, 1.0, -1.0)
            u, _, wt = np.linalg.svd(v.T @ b)
            q = u @ wt
        p = basis @ q
        yield p, np.median(unit @ p, axis=0)


def partners(sample: np.ndarray, threshold: float, rows: int = 3000, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """Sampled vectors, and for each a vector at the threshold's cosine: off in any direction, or towards another sampled vector."""
    r = np.random.default_rng(seed)
    x = sample[r.integers(0, len(sample), rows)]
    x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    off = r.normal(size=x.shape)
    half = rows // 2
    other = sample[r.integers(0, len(sample), half)]
    off[:half] = other / np.maximum(np.linalg.norm(other, axis=1, keepdims=True), 1e-300) + 1e-6 * off[:half]
    off -= (off * x).sum(1, keepdims=True) * x
    off /= np.maximum(np.linalg.norm(off, axis=1, keepdims=True), 1e-300)
    return x, threshold * x + np.sqrt(max(0.0, 1 - threshold * threshold)) * off


def plan(sample: np.ndarray, n: int, threshold: float, rotations: int = ROTATIONS, recall: float = RECALL):
    """(model, tables, most, recall measured): rotations and tables for n vectors, and the bits that a near code may differ in."""
    bits = min(64, sample.shape[1])
    # codes are steadier on the vectors that they were fitted to, so a quarter is kept out of the fit
    held, fit = (sample[::4], np.delete(sample, np.s_[::4], 0)) if len(sample) >= 64 else (sample, sample)
    x, y = partners(held, threshold)
    half, source, model, cx, cy = len(x) // 2, rotation(fit), [], [], []
    width = min(bits, max(8, int(np.ceil(np.log2(max(n, 2)))) - 3))
    while True:
        for used in range(1, STEPS + 1):
            if used > len(model):
                model.append(next(source))
                cx.append(codes(x, model[-1:])[:, 0])
                cy.append(codes(y, model[-1:])[:, 0])
            if used < rotations:
                continue
            a, b = np.stack(cx[:used], 1), np.stack(cy[:used], 1)
            tables = substrings(width, bits, used)
            met = (table_keys(a, tables) == table_keys(b, tables)).any(1)
            got = min(met[:half].mean(), met[half:].mean())
            if got >= recall or width == 0:
                near = np.bitwise_count(a[:, :rotations] ^ b[:, :rotations]).min(1)
                # four standard errors over a pair at the threshold, or what the partners need
                return model[:used], tables, max(int(bits * 0.25) + 1, int(near.max())), float(got)
        width -= 1


def codes(x: np.ndarray, model) -> np.ndarray:
    """n x rotations unsigned 64-bit codes."""
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    out = []
    for p, t in model:
        bits = np.zeros((len(x), 64), np.uint8)
        got = unit @ p >= t
        bits[:, :got.shape[1]] = got
        out.append(np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel())
    return np.stack(out, 1)


def substrings(width: int, bits: int = 64, rotations: int = ROTATIONS) -> list[list[tuple[int, int, int]]]:
    """Tables of substrings of so many bits, taken from the codes on end: each the pieces (rotation, shift, width) of its substring."""
    if not width:
        return [[]]
    out = []
    for a in range(0, bits * rotations - width + 1, width):
        r, shift = divmod(a, bits)
        first = min(width, bits - shift)
        out.append([(r, shift, first)] + ([(r + 1, 0, width - first)] if first < width else []))
    return out


def table_keys(code: np.ndarray, tables) -> np.ndarray:
    """n x tables keys: which table, and the substring's value."""
    out = []
    for j, pieces in enumerate(tables):
        value = np.zeros(len(code), np.uint64)
        for r, shift, width in pieces:
            part = (code[:, r] >> np.uint64(shift)) & np.uint64((1 << width) - 1)
            value = (value << np.uint64(width)) | part if width < 64 else part
        x = value * np.uint64(0x9E3779B97F4A7C15) if sum(w for *_, w in pieces) > 48 else value
        out.append((x & np.uint64((1 << 48) - 1)) | np.uint64(j << 48))
    return np.stack(out, 1).astype(np.int64)


def near_dedup(vectors: DataFrame, threshold: float = THRESHOLD, rotations: int = ROTATIONS, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    vectors needs vec_id and embedding; other columns are ignored. Vectors that are null, empty, zero
    or hold null or non-finite numbers link with nothing. Vectors of each length have rotations and
    tables of their own, and link with those of their length alone. Equal vectors link with one another. Rows that share a vec_id are separate
    vectors with the same name. An empty table gives no rows.
    """
    spark: SparkSession = vectors.sparkSession
    ship_package(spark)
    e = F.col("embedding")
    usable = F.coalesce(e.isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(e, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e, usable.alias("ok"))
    fits = F.col("ok") & F.col("vec_id").isNotNull()
    lengths = rows.where(fits).groupBy(F.size("embedding").alias("d")).count().where("count > 1").orderBy("d").collect()
    # x + 0 turns a negative zero into zero, so that equal vectors group
    same = F.transform("embedding", lambda x: x + F.lit(0).cast("float")) if dict(vectors.dtypes)["embedding"] == "array<float>" else F.transform("embedding", lambda x: x + F.lit(0.0))
    named = [_one_length(spark, rows.where(fits & (F.size("embedding") == x["d"])).select("vec_id", same.alias("v")), x["d"], threshold, rotations, fit_rows) for x in lengths]
    if not named:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    marked = rows.select("vec_id", F.when(fits, same).alias("v"))
    return marked.join(reduce(DataFrame.unionByName, named), "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def _one_length(spark: SparkSession, good: DataFrame, d: int, threshold: float, rotations: int, fit_rows: int) -> DataFrame:
    """(v, n_links, component_id) of each distinct vector of d numbers; good has vec_id and v."""
    classes, _ = stored(spark, good.groupBy("v").agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("m")), "vector-classes")
    n = classes.count()
    sample = classes.orderBy(F.xxhash64("id")).limit(fit_rows).select("v").toPandas()["v"]
    model, tables, most, _ = plan(np.stack([np.asarray(x, np.float64) for x in sample]), n, threshold, rotations)

    def code_rows(batches):
        for pdf in batches:
            c = codes(np.stack([np.asarray(x, np.float64) for x in pdf["v"]]), model)
            yield pd.DataFrame({"id": pdf["id"], "codes": [x.tobytes() for x in c], "keys": list(table_keys(c, tables))})

    coded, _ = stored(spark, classes.select("id", "v").mapInPandas(code_rows, "id long, codes binary, keys array<bigint>"), "vector-codes")
    # the codes of the first rotations are enough for the screen
    probes = coded.select("id", F.substring("codes", 1, 8 * rotations).alias("codes"), F.explode("keys").alias("key"))
    sizes = probes.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    met, _ = stored(spark, probes.join(sizes, "key"), "vector-buckets")

    def screen(pdf: pd.DataFrame) -> pd.DataFrame:
        """Rows of whole buckets, sorted by key: those with a near code in their bucket."""
        key = pdf["key"].to_numpy()
        c = np.frombuffer(b"".join(pdf["codes"]), "<u8").reshape(len(pdf), -1)
        hit = np.zeros(len(key), bool)
        at = np.arange(len(key))
        for step in range(1, len(key)):
            at = at[at < len(key) - step]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            near = (np.bitwise_count(c[at] ^ c[at + step]) <= most).any(1)
            hit[at[near]] = True
            hit[at[near] + step] = True
        return pdf.loc[hit, ["key", "id", "n"]]

    # Hamming screen: members of small buckets with no near code in them go no further
    small = _grouped(met.where(f"n <= {BLOCK}"), screen, ["key", "id", "codes", "n"], "key long, id long, n long")
    going = small.unionByName(met.where(f"n > {BLOCK}").select("key", "id", "n"))
    going, _ = stored(spark, going.join(coded.select("id", "codes"), "id").join(classes.select("id", "v", "m"), "id"), "vector-going")
    g = F.ceil(F.col("n") / BLOCK).cast("int")
    blocks = going.withColumn("g", g).withColumn("b", F.pmod(F.xxhash64("id"), F.col("g")).cast("int"))
    cells = blocks.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("g") - 1))).select(
        "key", F.least("b", "o").alias("bi"), F.greatest("b", "o").alias("bj"), "b", "id", "codes", "v", "m")

    def rerank(pdf: pd.DataFrame) -> pd.DataFrame:
        return _rerank(pdf, tables, threshold, most, rotations)

    cell_key = F.xxhash64("key", "bi", "bj").alias("cell")
    found = _grouped(cells.select(cell_key, "key", "bi", "bj", "b", "id", "codes", "v", "m"), rerank, None, "id long, n long, to long", by="cell", each=True)
    found, _ = stored(spark, found, "vector-links")
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(spark, found.select(F.col("id").alias("u"), F.col("to").alias("v")), "vec")
    named = classes.join(counts, "id", "left").join(comp, "id", "left").select(
        "v", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return stored(spark, named, "vector-named")[0]


def _grouped(df: DataFrame, f, columns, schema: str, by: str = "key", each: bool = False) -> DataFrame:
    """f over whole groups of `by`, sorted, many groups at once (or each on its own)."""
    def run(batches):
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            key = pdf[by].to_numpy()
            last = int(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[-1]) if len(key) else 0
            ready, rest = pdf.iloc[:last].reset_index(drop=True), pdf.iloc[last:].reset_index(drop=True)
            yield from parts(ready)
        if rest is not None:
            yield from parts(rest)

    def parts(pdf):
        if not len(pdf):
            return
        if not each:
            yield f(pdf)
            return
        key = pdf[by].to_numpy()
        cut = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
        for a, b in zip(cut, cut[1:], strict=False):
            if b - a > 1:
                got = f(pdf.iloc[a:b])
                if len(got):
                    yield got
    src = df.select(*columns) if columns else df
    return src.repartition(by).sortWithinPartitions(by).mapInPandas(run, schema)


def _rerank(pdf: pd.DataFrame, tables, threshold: float, most: int, rotations: int) -> pd.DataFrame:
    """One cell of a bucket: for each vector with links that count here, the number of vectors it links with
    (n) and one vector it is joined with in the cell's forest (to)."""
    bi, bj, b = int(pdf["bi"].iloc[0]), int(pdf["bj"].iloc[0]), pdf["b"].to_numpy()
    code = np.frombuffer(b"".join(pdf["codes"]), "<u8").reshape(len(pdf), -1)
    x = np.stack([np.asarray(v, np.float64) for v in pdf["v"]])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids, m, mine = pdf["id"].to_numpy(), pdf["m"].to_numpy(), int(pdf["key"].iloc[0]) >> 48
    left = np.flatnonzero(b == bi)
    right = np.flatnonzero(b == bj)
    link = x[left] @ x[right].T >= threshold
    near = np.zeros_like(link)
    for r in range(rotations):
        near |= np.bitwise_count(code[left, r][:, None] ^ code[right, r][None, :]) <= most
    link &= near & (ids[left][:, None] != ids[right][None, :])
    # a pair counts in the first table alone in which it meets
    keys = table_keys(code, tables)
    for t in range(mine):
        if not link.any():
            break
        link &= keys[left, t][:, None] != keys[right, t][None, :]
    if not link.any():
        return pd.DataFrame({"id": [], "n": [], "to": []}).astype({"id": "int64", "n": "int64", "to": "int64"})
    n = np.zeros(len(ids), np.int64)
    np.add.at(n, left, link @ m[right])
    if bi != bj:
        np.add.at(n, right, link.T @ m[left])
    # labels: smallest id joined with, spread until nothing changes
    rank = np.argsort(ids)
    at = np.argsort(np.argsort(ids))
    lab = at.copy()
    while True:
        new = lab.copy()
        big = len(ids)
        a = np.where(link, lab[right][None, :], big).min(1)
        new[left] = np.minimum(new[left], a)
        c = np.where(link, lab[left][:, None], big).min(0)
        new[right] = np.minimum(new[right], c)
        new = np.minimum(new, new[rank[new]])
        if (new == lab).all():
            break
        lab = new
    got = np.flatnonzero(n > 0)
    to = ids[rank[lab[got]]]
    return pd.DataFrame({"id": ids[got], "n": n[got], "to": to})


def op10_itq_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "embeddings"))


# Links and components of a small table, by the cosine of all pairs.
SQL = r"""
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
ok AS (SELECT vec_id, x, sqrt(list_inner_product(x, x)) AS n FROM e WHERE x IS NOT NULL AND len(x) > 0 AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
l AS (SELECT a.vec_id AS u, b.vec_id AS v FROM ok a JOIN ok b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND a.n > 0 AND b.n > 0 AND list_inner_product(a.x, b.x) / (a.n * b.n) >= 0.95),
r AS (SELECT u, v FROM l UNION SELECT r.u, l.v FROM r JOIN l ON r.v = l.u),
c AS (SELECT u AS vec_id, least(u, min(v)) AS component_id FROM r GROUP BY u),
n AS (SELECT u AS vec_id, count(*) AS n_links FROM l GROUP BY u)
SELECT e.vec_id, coalesce(n.n_links, 0)::BIGINT AS n_links, coalesce(c.component_id, e.vec_id) AS component_id, coalesce(c.component_id, e.vec_id) = e.vec_id AS kept
FROM e LEFT JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""
