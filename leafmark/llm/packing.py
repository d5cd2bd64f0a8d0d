"""Best-fit packing with several permitted sequence lengths (variable cost and size bins).

Items go in by decreasing length into the open bin that they fill best. When none has room, the
bin size of least cost that holds the item is opened; at the end each bin is downsized to the
cheapest permitted length that holds its contents. "Least cost" can mean least cost per token
or least cost outright; each group of items is packed once for every permitted largest size and
either meaning, and the cheapest of those plans stays, so the lengths are optimised jointly.

Only (row key, length) moves: rows are dealt into even groups of about ``group_items`` by a hash,
so a group is bounded whatever the input and however often a key repeats, and the loss is at most a partly filled bin or two
for each group. Texts stay where they are.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ship_package, stored, table

#: Permitted sequence lengths in tokens, and the fixed cost of a sequence besides its length.
SIZES = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 64


def costs(sizes=SIZES, overhead: float = OVERHEAD) -> dict[int, float]:
    return {s: s + overhead for s in sizes}


def best_fit(lengths: list[int], cost: dict[int, float]) -> tuple[list[int], list[int], list[int], float]:
    """Pack lengths (each within the largest size): (bin of each item, offset in it, size of each bin, total cost)."""
    best = None
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    sizes = sorted(cost)
    for largest in sizes:
        for unit in (True, False):
            pick = {}
            for s in sizes:  # the size to open for an item that needs at least s
                fit = [z for z in sizes if z >= s and z <= max(s, largest)]
                pick[s] = min(fit, key=lambda z: (cost[z] / z if unit else cost[z], z))
            plan = _pack(lengths, order, sizes, pick, cost)
            if best is None or plan[3] < best[3]:
                best = plan
    return best


def _pack(lengths, order, sizes, pick, cost):
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    used, opened = [], []
    room: list[tuple[int, int]] = []  # (room left, bin), sorted
    for i in order:
        n = lengths[i]
        k = bisect_left(room, (n, -1))
        if k < len(room):
            left, b = room.pop(k)
        else:
            left, b = pick[sizes[bisect_left(sizes, n)]], len(used)
            used.append(0)
            opened.append(left)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        if left > n:
            insort(room, (left - n, b))
    final = [min((z for z in sizes if z >= u), key=lambda z: (cost[z], z)) for u in used]
    return bins, offsets, final, sum(cost[z] for z in final)


def n_tokens(text):
    """Words (runs without ASCII white space) and one end token; null counts as empty."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    return (F.size(words) + 1).cast("int")


def pack(items: DataFrame, key: str, length: str, sizes=SIZES, overhead: float = OVERHEAD, group_items: int = 4096) -> DataFrame:
    """Pack rows (key, length >= 1) into sequences: key, piece, start, n_tokens, bin_id, bin_size, bin_offset.

    An item longer than the largest size is cut into pieces of that size and a rest; start is
    where a piece begins in its item. Items of null or less than one token count as one token.
    Repeated and null keys are separate items. An empty table gives no rows.
    """
    ship_package(items.sparkSession)
    cost, largest = costs(sizes, overhead), max(sizes)
    # numbered rows, written once: a group is a hash of the row's number, which null and repeated keys cannot make uneven;
    # keys go through Python as text, since pandas would make floating point of a batch that holds a null
    rows, _ = stored(items.sparkSession, items.select(F.col(key).cast("long").cast("string").alias("key"), F.monotonically_increasing_id().alias("row"), F.greatest(
        F.coalesce(F.col(length), F.lit(1)), F.lit(1)).cast("long").alias("len")), "pack-rows")
    n = rows.agg(F.sum(F.floor((F.col("len") - 1) / largest) + 1)).first()[0] or 0
    groups = max(1, -(-n // group_items))
    pieces = rows.withColumn("piece", F.explode(F.sequence(F.lit(0), ((F.col("len") - 1) / largest).cast("int")))).select(
        "key", "row", "piece", (F.col("piece").cast("long") * largest).alias("start"),
        F.least(F.col("len") - F.col("piece").cast("long") * largest, F.lit(largest)).cast("int").alias("n_tokens"))
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64("row", "piece"), F.lit(groups)).cast("long"))

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["n_tokens", "row", "piece"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        bins, offsets, final, _ = best_fit(pdf["n_tokens"].tolist(), cost)
        size = np.asarray(final, np.int32)
        grp = int(pdf["grp"].iloc[0])
        return pd.DataFrame({
            "key": pdf["key"], "piece": pdf["piece"].astype("int32"), "start": pdf["start"], "n_tokens": pdf["n_tokens"].astype("int32"),
            "bin_id": (grp << 32) + np.asarray(bins, np.int64), "bin_size": size[np.asarray(bins, np.int64)],
            "bin_offset": np.asarray(offsets, np.int32)})

    out = dealt.groupBy("grp").applyInPandas(
        place, "key string, piece int, start long, n_tokens int, bin_id long, bin_size int, bin_offset int")
    return out.withColumn("key", F.col("key").cast("long")).withColumnRenamed("key", key)


def pack_documents(docs: DataFrame, **how) -> DataFrame:
    """Pack documents (doc_id, text; other columns are ignored) by their number of tokens: words and an end.

    Null and empty texts are one token long; very long ones are cut into pieces, none is shortened.
    """
    return pack(docs.select("doc_id", n_tokens(F.col("text")).alias("length_")), "doc_id", "length_", **how)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
