"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

Pre-tokens are numbered by position in chunks (see chunks.py); the distinct pre-tokens of every
chunk go to buckets by hash; a bucket encodes each distinct word once and answers with ids; the
chunk joins the ids back and puts them in order of position. Decoding joins ids with the
token-byte table, which is as large as the vocabulary and no larger.
"""

from __future__ import annotations

import base64
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunks import CHUNK_SCHEMA, by_bucket, chunker, dec, dec_bytes, enc, enc_bytes, spread
from .common import MOST_PARTS, ship_package, stored_by, table

#: A vocabulary file may not be larger than this when it goes to every executor.
MOST_RANKS = 2_000_000
#: Bytes of ids that are decoded at once (a longer text on its own).
JOIN_BYTES = 2_000_000


def read_ranks(path: str) -> bytes:
    """The rank file's bytes, read on the driver; executors get them with the job."""
    with open(path, "rb") as f:
        raw = f.read()
    if raw.count(b"\n") > MOST_RANKS:
        raise ValueError("vocabulary too large to send to every executor")
    return raw


def parse_ranks(raw: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in raw.splitlines() if line)}


def _pack_words(words: list[str]) -> bytes:
    return enc_bytes([w.encode() for w in words])


def _bucket_of(words: list[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % n


def encode(docs: DataFrame, ranks_path: str, pattern: str, chunk_chars: int = 6_000_000, bucket_words: int = 300_000) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit ids).

    docs needs doc_id and text; other columns are ignored. Every match of pattern is encoded on its
    own by the ranks, special tokens being ordinary text. Null and empty texts have no ids. Repeated
    rows are encoded each. Texts are whole: lone surrogates cannot occur in Spark's UTF-8 strings.
    """
    spark = docs.sparkSession
    ship_package(spark)
    raw = spark.sparkContext.broadcast(read_ranks(ranks_path))
    split = chunker(lambda t: _finder(pattern)(t), _pack_words, chunk_chars)
    rows = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), "text", F.lit(0).alias("mark"), F.lit(0).alias("part"))
    chunks = stored_by(spark, rows.mapInPandas(split, CHUNK_SCHEMA), "bpe-chunks", "chunk", rows.rdd.getNumPartitions())
    total = chunks.agg(F.sum("n_keys")).first()[0] or 0
    n_buckets = max(1, -(-total // bucket_words))

    def ask(batches):
        for pdf in batches:
            for chunk, vocab in zip(pdf["chunk"], pdf["vocab"], strict=True):
                words = dec_bytes(vocab)
                order, bounds = by_bucket(_bucket_of(words, n_buckets), n_buckets)
                out = [(b, chunk, enc_bytes([words[i] for i in order[bounds[b]:bounds[b + 1]].tolist()])) for b in range(n_buckets) if bounds[b] < bounds[b + 1]]
                if out:
                    yield pd.DataFrame(out, columns=["bucket", "chunk", "words"])

    def answer(pdf: pd.DataFrame) -> pd.DataFrame:
        piece = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=parse_ranks(raw.value), special_tokens={})._encode_single_piece
        known: dict[bytes, list[int]] = {}
        out = []
        for words in pdf["words"]:
            got = []
            for w in dec_bytes(words):
                ids = known.get(w)
                if ids is None:
                    ids = known[w] = piece(w)
                got.append(ids)
            lens = np.fromiter(map(len, got), np.int64, len(got))
            out.append((enc(lens), enc(np.fromiter((i for ids in got for i in ids), np.int64, int(lens.sum())))))
        return pd.DataFrame({"chunk": pdf["chunk"], "bucket": pdf["bucket"], "lens": [o[0] for o in out], "flat": [o[1] for o in out]})

    def put(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            return pd.DataFrame({"doc_id": [], "n_tokens": [], "ids": []})
        row = left.iloc[0]
        words = dec_bytes(row["vocab"])
        order, _ = by_bucket(_bucket_of(words, n_buckets), n_buckets)
        right = right.sort_values("bucket")
        by_word = np.zeros(len(words), np.int32)
        starts = np.zeros(len(words), np.int64)
        flat = np.empty(0, np.uint32)
        if len(right):
            lens = np.concatenate([dec(x) for x in right["lens"]]).astype(np.int64)
            flat = np.concatenate([dec(x).astype(np.uint32) for x in right["flat"]])
            by_word[order], starts[order] = lens, np.cumsum(lens) - lens
        ids = dec(row["ids"])
        n = by_word[ids]
        tokens = flat[spread(starts[ids], n)].astype("<u4")
        ends = np.concatenate([[0], np.cumsum(n)])[np.concatenate([[0], np.cumsum(dec(row["lens"]).astype(np.int64))])]
        return pd.DataFrame({
            "doc_id": list(row["doc_ids"]), "n_tokens": np.diff(ends),
            "ids": [tokens[a:b].tobytes() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]})

    asked = chunks.select("chunk", "vocab").mapInPandas(ask, "bucket int, chunk long, words binary").repartition(min(n_buckets, MOST_PARTS), "bucket")
    replies = asked.groupBy("bucket").applyInPandas(
        answer, "chunk long, bucket int, lens binary, flat binary")
    return chunks.select("chunk", "doc_ids", "lens", "ids", "vocab").groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInPandas(
        put, "doc_id string, n_tokens long, ids binary").withColumn("doc_id", F.col("doc_id").cast("long"))


_FINDERS: dict = {}


def _finder(pattern: str):
    if pattern not in _FINDERS:
        _FINDERS[pattern] = regex.compile(pattern).findall
    return _FINDERS[pattern]


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """encoded (with ids as encode() gives them) plus bytes: the ids' bytes, joined. Null ids give null.

    The ids of a batch meet the token-byte table, which is as large as the vocabulary and goes to every executor, in one
    join by position; the bytes come back in order and are cut where documents end.
    """
    spark = encoded.sparkSession
    ship_package(spark)
    raw = spark.sparkContext.broadcast(read_ranks(ranks_path))

    def run(batches):
        ranks = parse_ranks(raw.value)
        by_id = [b""] * (max(ranks.values(), default=-1) + 1)
        for b, i in ranks.items():
            by_id[i] = b
        table_ = pa.array(by_id, pa.large_binary())
        size = np.fromiter(map(len, by_id), np.int64, len(by_id))

        def joined(held):
            ids = np.frombuffer(b"".join(x or b"" for x in held), "<u4").astype(np.int64)
            data = table_.take(pa.array(ids)).buffers()[2]
            ends = np.concatenate([[0], np.cumsum(size[ids])])[np.cumsum([0, *(len(x or b"") // 4 for x in held)])].tolist()
            view = memoryview(data if data is not None else b"")
            return [None if x is None else bytes(view[a:b]) for x, a, b in zip(held, ends, ends[1:], strict=False)]

        for batch in batches:
            names, column = [*batch.schema.names, "bytes"], batch.column("ids")
            weight = np.cumsum(np.diff(np.frombuffer(column.buffers()[1], np.int32)[column.offset:column.offset + len(column) + 1])) if len(column) else np.zeros(0)
            cut = sorted({0, *np.searchsorted(weight, np.arange(JOIN_BYTES, weight.max(initial=0) + 1, JOIN_BYTES), "right").tolist()})
            for a, b in zip(cut, [*cut[1:], len(column)], strict=True):
                if a < b:
                    part = batch.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(joined(part.column("ids").to_pylist()), pa.binary())], names=names)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(run, f"{schema}, bytes binary")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return decode(ids, path).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))
