"""Helpers shared by the training-data operators: tables, the shared scratch folder, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.sources.tables import _fs_path, drop_stored, shared_dir, ship_package, stored

__all__ = ["ascii_lower", "components", "crc_mod5", "drop_stored", "shared_dir", "ship_package", "stored", "stored_by", "table", "with_key"]


#: Most partitions that an exchange of packed rows is dealt over. Groups are worked on one after the other, so a partition may hold many.
MOST_PARTS = 50_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored_by(spark: SparkSession, df: DataFrame, name: str, key: str, parts: int) -> DataFrame:
    """Write df as an uncompressed Parquet table in the shared folder, bucketed by key, so that later stages which
    group by key read it in place without a shuffle."""
    parts = min(parts, MOST_PARTS)  # Spark's own limit is 100,000 buckets
    unique = f"leafmark_{uuid.uuid4().hex[:12]}_{name.replace('-', '_')}"
    path = f"{shared_dir(spark)}/{unique}"
    df.write.bucketBy(max(1, parts), key).option("compression", "uncompressed").option("path", path).saveAsTable(unique)
    fs, p = _fs_path(spark, path)
    fs.deleteOnExit(p)
    return spark.table(unique)


def ascii_lower(col):
    """Lower-case A-Z only. Texts of ASCII alone take the fast built-in; others translate()."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    col = F.coalesce(col, F.lit(""))
    return F.when(F.octet_length(col) == F.length(col), F.lower(col)).otherwise(F.translate(col, upper, upper.lower()))


def crc_mod5(col):
    """crc32 of the id as text, modulo 5; the folds of the contracts are built on it."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % 5


def with_key(df: DataFrame, key: str, run, schema: str) -> DataFrame:
    """df.mapInPandas(run, schema), with the long column `key` carried through Python as text: pandas would turn a batch that
    holds a null into floating point, which changes ids over 2**53. The result's key is a long again."""
    rows = df.withColumn(key, F.col(key).cast("long").cast("string"))
    typed = schema.replace(f"{key} long", f"{key} string", 1)
    return rows.mapInPandas(run, typed).withColumn(key, F.col(key).cast("long"))


def components(spark: SparkSession, edges: DataFrame, name: str = "cc") -> DataFrame:
    """Connected components of undirected edges (u long, v long): one row (id, component_id) per
    vertex that has an edge; component_id is the component's smallest id.

    Every round hooks each vertex to its smallest neighbour, follows the hooks to their roots by pointer jumping
    and contracts every tree of hooks to its root. A hook of depth d takes log2(d) jumps. Of two rounds in a row every
    root that is left gains a vertex: a root's neighbour hooks to it, or to a smaller root that this one meets and hooks to in
    the next round. So vertices at least halve in two rounds, and rounds are O(log n) whatever the graph and its ids; there is
    no cap. All state is in written tables; nothing is collected. Hubs are safe: the hook is a partial aggregate, and
    relabelling joins a written edge table with a written label table, which adaptive execution can split.
    """
    edges = edges.where("u is not null and v is not null and u <> v").select(
        F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    edges, at = stored(spark, edges, f"{name}-edges")
    whole = whole_at = None
    while edges.limit(1).count():
        both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hook = both.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("n")).select("id", F.least("id", "n").alias("to"))
        label, label_at = _roots(spark, hook, name)
        lu, lv = label.select(F.col("id").alias("u"), F.col("to").alias("nu")), label.select(F.col("id").alias("v"), F.col("to").alias("nv"))
        fresh = edges.join(lu, "u").join(lv, "v").where("nu <> nv").select(
            F.least("nu", "nv").alias("u"), F.greatest("nu", "nv").alias("v")).distinct()
        fresh, fresh_at = stored(spark, fresh, f"{name}-edges")
        if whole is None:
            whole, whole_at = label, label_at
        else:
            joined = whole.alias("w").join(label.alias("l"), F.col("w.to") == F.col("l.id"), "left").select(
                F.col("w.id").alias("id"), F.coalesce(F.col("l.to"), F.col("w.to")).alias("to"))
            new, new_at = stored(spark, joined, f"{name}-whole")
            drop_stored(spark, whole_at, label_at)
            whole, whole_at = new, new_at
        drop_stored(spark, at)
        edges, at = fresh, fresh_at
    if whole is None:
        return spark.createDataFrame([], "id long, component_id long")
    return whole.select("id", F.col("to").alias("component_id"))


def _roots(spark: SparkSession, hook: DataFrame, name: str) -> tuple[DataFrame, str]:
    """hook (id, to), which only ever points to smaller ids -> (id, to) with every `to` a root, by pointer jumping."""
    label, at = stored(spark, hook, f"{name}-hooks")
    while True:
        further = label.where("id <> to").select(F.col("id").alias("to"), F.col("to").alias("further"))
        jumped = label.join(further, "to", "left").select(
            "id", F.coalesce("further", "to").alias("to"), F.col("further").isNotNull().alias("moved"))
        new, new_at = stored(spark, jumped, f"{name}-jumps")
        drop_stored(spark, at)
        label, at = new.select("id", "to"), new_at
        if not new.where("moved").limit(1).count():
            return label, at
