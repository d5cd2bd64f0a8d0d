"""Exact dedup: static binary-fuse filters per immutable snapshot screen incoming digests;
positives join exact buckets for byte checks, and duplicates inside the new batch are grouped
on their own.

Shapes and bounds
* A digest table (doc_id, digest, side) is the only thing shuffled for most rows; texts move
  only for screened positives, one text per distinct digest and side.
* A snapshot is a written table (bucket, digest, keep_id, n) and one filter per bucket. The
  number of buckets follows the number of digests, so a filter and the digests probed with it
  stay near ``bucket_keys`` each: no filter is broadcast, no bucket grows.
* Hot groups: all counts are partial aggregates, and rows meet their group in a join of two
  written tables, which adaptive execution can split.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, ship_package, stored, table

_M = np.uint64(0xFFFFFFFFFFFFFFFF)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser, vectorised."""
    with np.errstate(over="ignore"):
        x = x + np.uint64(seed)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xC4CEB9FE1A85EC53)
        x ^= x >> np.uint64(33)
    return x


class BinaryFuse8:
    """Static three-wise binary fuse filter with 8-bit fingerprints over distinct uint64 keys.

    No false negatives; about 1 false positive in 256. Built once and never changed.
    Layout: segments of a power-of-two length; a key's three slots lie in consecutive segments.
    """

    def __init__(self, seed: int, seg_len: int, seg_count: int, slots: np.ndarray):
        self.seed, self.seg_len, self.seg_count, self.slots = seed, seg_len, seg_count, slots

    @staticmethod
    def _places(h: np.ndarray, seg_len: int, seg_count: int):
        start = ((h >> np.uint64(32)) * np.uint64(seg_count) >> np.uint64(32)).astype(np.int64) * seg_len
        mask = np.uint64(seg_len - 1)
        a = start + (h & mask).astype(np.int64)
        b = start + seg_len + ((h >> np.uint64(11)) & mask).astype(np.int64)
        c = start + 2 * seg_len + ((h >> np.uint64(22)) & mask).astype(np.int64)
        return a, b, c

    @staticmethod
    def _print(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)

    @classmethod
    def build(cls, keys: np.ndarray) -> BinaryFuse8:
        keys = np.unique(keys.astype(np.uint64))
        n = len(keys)
        seg_len = 4 if n < 2 else 1 << min(18, max(2, int(np.floor(np.log(n) / np.log(3.33) + 2.25))))
        # room for small sets, 1.125 slots a key for large ones, and the slack that wins a retry
        room = max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2))) if n > 1 else 4
        for attempt in range(200):
            seg_count = max(1, int(np.ceil(n * room * (1 + 0.02 * (attempt // 10)) / seg_len)) - 2)
            seed = 0x9E3779B97F4A7C15 * (attempt + 1) & 0xFFFFFFFFFFFFFFFF
            h = _mix(keys.copy(), seed)
            got = cls._peel(h, seg_len, seg_count)
            if got is None:
                continue
            slots = np.zeros((seg_count + 2) * seg_len, np.uint8)
            prints, places = cls._print(h), np.stack(cls._places(h, seg_len, seg_count), 1)
            for who, where in reversed(got):  # keys of one round share no slot that they own
                p = places[who]
                slots[where] = 0
                slots[where] = prints[who] ^ slots[p[:, 0]] ^ slots[p[:, 1]] ^ slots[p[:, 2]]
            return cls(seed, seg_len, seg_count, slots)
        raise RuntimeError("filter did not build")

    @classmethod
    def _peel(cls, h, seg_len, seg_count):
        """Rounds of (keys, the slot that each of them owns), or None if keys are left over."""
        n, size = len(h), (seg_count + 2) * seg_len
        places = np.stack(cls._places(h, seg_len, seg_count), 1)
        count = np.bincount(places.ravel(), minlength=size)
        held = np.zeros(size, np.int64)  # xor of the keys in a slot
        idx = np.repeat(np.arange(n), 3)
        np.bitwise_xor.at(held, places.ravel(), idx)
        left, rounds = n, []
        while left:
            single = np.flatnonzero(count == 1)
            if not len(single):
                return None
            who, first = np.unique(held[single], return_index=True)
            where = single[first]
            rounds.append((who, where))
            out = places[who].ravel()
            np.subtract.at(count, out, 1)
            np.bitwise_xor.at(held, out, np.repeat(who, 3))
            left -= len(who)
        return rounds

    def contains(self, keys: np.ndarray) -> np.ndarray:
        h = _mix(keys.astype(np.uint64).copy(), self.seed)
        a, b, c = self._places(h, self.seg_len, self.seg_count)
        return self._print(h) == self.slots[a] ^ self.slots[b] ^ self.slots[c]

    def to_bytes(self) -> bytes:
        head = np.array([self.seed, self.seg_len, self.seg_count], np.uint64)
        return head.tobytes() + self.slots.tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> BinaryFuse8:
        seed, seg_len, seg_count = (int(x) for x in np.frombuffer(raw[:24], np.uint64))
        return cls(seed, seg_len, seg_count, np.frombuffer(raw[24:], np.uint8))


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), np.uint64) if len(digests) else np.empty(0, np.uint64)


def digests(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """(doc_id, digest binary(32), snap boolean), one row per document; null text counts as empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(ascii_lower(F.col("text")).cast("binary"), 256)).alias("digest"),
        F.coalesce(in_snapshot, F.lit(False)).alias("snap"))


def group(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Duplicates grouped: (bucket, digest, keep_id, n). A hot digest is summed before it moves."""
    bucket = F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int")
    return rows.groupBy("digest").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("n")).withColumn("bucket", bucket)


def build_filters(snapshot: DataFrame) -> DataFrame:
    """(bucket, filter): one static filter per bucket of an immutable snapshot."""
    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = BinaryFuse8.build(_keys(list(pdf["digest"]))).to_bytes()
        return pd.DataFrame({"bucket": [int(pdf["bucket"].iloc[0])], "filter": [raw]})
    return snapshot.select("bucket", "digest").groupBy("bucket").applyInPandas(build, "bucket int, filter binary")


def screen(batch: DataFrame, filters: DataFrame) -> DataFrame:
    """Digests of the batch that a filter lets through: (bucket, digest). The rest are certainly new."""
    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return left[["bucket", "digest"]].iloc[:0]
        hit = BinaryFuse8.from_bytes(right["filter"].iloc[0]).contains(_keys(list(left["digest"])))
        return left.loc[hit, ["bucket", "digest"]]
    return batch.select("bucket", "digest").groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "bucket int, digest binary")


def exact_dedup(docs: DataFrame, in_snapshot: Column | None = None, bucket_keys: int = 50_000) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, side.

    docs needs doc_id and text; other columns are ignored. Texts are equal when identical after
    lower-casing A-Z. in_snapshot marks the rows of the immutable snapshot, the rest are the
    incoming batch (default: a hash of the id puts three quarters in the snapshot). Null texts
    count as empty; an empty table gives no rows; rows that share a doc_id are one document and
    stand or fall together; rows without a doc_id group as any other, never win against an id,
    and where a group has no id at all keep_id is null and all stay.
    """
    spark: SparkSession = docs.sparkSession
    ship_package(spark)
    if in_snapshot is None:
        in_snapshot = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(4)) != 0
    rows, _ = stored(spark, digests(docs, in_snapshot), "digests")
    n_buckets = max(1, -(-rows.count() // bucket_keys))
    snap, _ = stored(spark, group(rows.where("snap"), n_buckets), "snapshot")
    filters, _ = stored(spark, build_filters(snap), "filters")
    batch, _ = stored(spark, group(rows.where("not snap"), n_buckets), "batch")
    positives = screen(batch, filters)
    exact = positives.join(snap.select("bucket", "digest", F.col("keep_id").alias("s_id")), ["bucket", "digest"]).join(
        batch.select("bucket", "digest", F.col("keep_id").alias("b_id")), ["bucket", "digest"])
    exact, _ = stored(spark, exact.select("digest", "s_id", "b_id"), "positives")
    # byte check: the texts of both representatives, fetched for positives alone
    wanted = exact.select(F.explode(F.array("s_id", "b_id")).alias("doc_id")).where("doc_id is not null").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(ascii_lower(F.col("text")), "UTF-8").alias("bytes")).join(wanted, "doc_id")
    texts = texts.withColumn("digest", F.unhex(F.sha2("bytes", 256))).join(
        exact.select("digest", "s_id", "b_id"), "digest").where("doc_id = s_id or doc_id = b_id")
    checked = texts.groupBy("digest").agg((F.min("bytes") == F.max("bytes")).alias("same"))
    same = exact.join(checked, "digest", "left").where("coalesce(same, true)").select("digest", F.lit(True).alias("same"))
    sides = snap.select("digest", "keep_id", "n", F.lit(True).alias("snap")).unionByName(
        batch.select("digest", "keep_id", "n", F.lit(False).alias("snap")))
    marked = sides.join(same, "digest", "left")
    over = F.when(F.col("same"), F.lit(0)).when(F.col("snap"), F.lit(1)).otherwise(F.lit(2))
    merged = marked.withColumn("g", over).groupBy("digest", "g").agg(
        F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"),
        F.max("snap").alias("has_s"), F.max(~F.col("snap")).alias("has_b"))
    groups = merged.select("digest", "keep_id", "group_size", F.explode(F.filter(F.array(
        F.when(F.col("has_s"), F.lit(True)), F.when(F.col("has_b"), F.lit(False))), lambda x: x.isNotNull())).alias("snap"))
    groups, _ = stored(spark, groups, "groups")
    return rows.join(groups, ["digest", "snap"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.when(F.col("snap"), F.lit("snapshot")).otherwise(F.lit("batch")).alias("side"))


def keep_first(docs: DataFrame, verdict: DataFrame) -> DataFrame:
    """The documents that exact_dedup() keeps, with their own columns; a row that is there twice stays once.

    Rows meet their verdict by id and digest; only rows whose id and digest repeat are dealt again to drop repeats.
    """
    told, _ = stored(docs.sparkSession, verdict.where("kept").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg(
        F.count(F.lit(1)).alias("kept_n")), "kept")
    sha = F.sha2(ascii_lower(docs["text"]).cast("binary"), 256)
    of = lambda ids: docs.join(ids, docs["doc_id"].eqNullSafe(ids["kept_id"]) & (sha == ids["kept_sha"]), "left_semi")
    once = of(told.where("kept_n = 1"))
    if not told.where("kept_n > 1").limit(1).count():
        return once
    again = of(told.where("kept_n > 1")).withColumn("text_sha256_", F.sha2(ascii_lower(F.col("text")).cast("binary"), 256))
    return once.unionByName(again.dropDuplicates(["doc_id", "text_sha256_"]).drop("text_sha256_"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("side")


SQL = r"""
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g USING (t)
"""
