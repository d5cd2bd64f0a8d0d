"""Texts as compact chunks, and a key exchange between chunks and buckets.

Exploding every token of a corpus into a row of its own costs tens of bytes a token in a shuffle.
Here a chunk is one row that holds some megabytes of texts as local token numbers plus the list of
its distinct tokens. Chunks send each bucket of the key space the distinct keys they use
(one blob for each chunk and bucket), a bucket answers with one value for each key in the same
order, and the chunk puts the answers back by position. What moves is the distinct tokens of each
chunk, packed. Chunks and buckets have bounded sizes, so their numbers grow with the input and no
task does; a token that half of all texts hold is one key in a chunk like any other.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import zstandard

CHUNK_SCHEMA = "chunk long, part int, n_tokens long, n_keys long, doc_ids array<string>, lens binary, marks binary, ids binary, vocab binary"


def enc(a: np.ndarray) -> bytes:
    """Non-negative integers, packed: the narrowest type, byte planes, zstd."""
    top = int(a.max()) if len(a) else 0
    kind = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    raw = np.ascontiguousarray(a.astype(f"<u{kind}"))
    planes = raw.view(np.uint8).reshape(-1, kind).T if kind > 1 else raw
    return bytes([kind]) + zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes).tobytes())


def dec(raw: bytes) -> np.ndarray:
    kind = raw[0]
    got = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), np.uint8)
    return got if kind == 1 else np.ascontiguousarray(got.reshape(kind, -1).T).view(f"<u{kind}").ravel()


def enc_bytes(items: list[bytes]) -> bytes:
    lens = enc(np.fromiter(map(len, items), np.int64, len(items)))
    return len(lens).to_bytes(4, "little") + lens + zstandard.ZstdCompressor(level=3).compress(b"".join(items))


def dec_bytes(raw: bytes) -> list[bytes]:
    n = int.from_bytes(raw[:4], "little")
    ends = np.cumsum(dec(raw[4:4 + n]).astype(np.int64)).tolist()
    whole = zstandard.ZstdDecompressor().decompress(raw[4 + n:])
    return [whole[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class Numbers(dict):
    """Token -> local number, given at first sight."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


class _Open:
    def __init__(self):
        self.vocab, self.ids, self.docs, self.marks, self.size = Numbers(), [], [], [], 0

    def row(self, part: int, pack_vocab: Callable[[list], bytes]) -> dict:
        lens = np.fromiter(map(len, self.ids), np.int64, len(self.ids))
        flat = np.concatenate(self.ids) if self.ids else np.empty(0, np.int32)
        order = np.argsort(-np.bincount(flat, minlength=len(self.vocab)), kind="stable")  # frequent tokens get small numbers
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        tokens = list(self.vocab)
        return {
            "chunk": int.from_bytes(os.urandom(8), "little") >> 1, "part": part, "n_tokens": len(flat), "n_keys": len(tokens),
            "doc_ids": self.docs, "lens": enc(lens), "marks": enc(np.asarray(self.marks, np.int64)), "ids": enc(rank[flat]),
            "vocab": pack_vocab([tokens[i] for i in order.tolist()])}


def chunker(tokens_of: Callable[[str], list], pack_vocab: Callable[[list], bytes], chunk_chars: int, ):
    """For mapInPandas over (doc_id as text, text, mark, part): rows of CHUNK_SCHEMA. Documents of different
    parts never share a chunk. A text longer than chunk_chars is a chunk of its own, whole."""
    def run(batches: Iterable[pd.DataFrame]):
        open_: dict[int, _Open] = {}
        for pdf in batches:
            for doc_id, text, mark, part in zip(pdf["doc_id"], pdf["text"], pdf["mark"], pdf["part"], strict=True):
                c = open_.setdefault(part, _Open())
                toks = tokens_of(text or "")
                c.ids.append(np.fromiter(map(c.vocab.__getitem__, toks), np.int32, len(toks)))
                c.docs.append(doc_id)
                c.marks.append(int(mark))
                c.size += len(text or "") + 16
                if c.size >= chunk_chars:
                    yield pd.DataFrame([open_.pop(part).row(part, pack_vocab)])
        for part, c in open_.items():
            yield pd.DataFrame([c.row(part, pack_vocab)])
    return run


def by_bucket(buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, bounds): order sorts keys by bucket, keeping their order inside; bucket b is order[bounds[b]:bounds[b + 1]]."""
    order = np.argsort(buckets, kind="stable")
    return order, np.searchsorted(buckets[order], np.arange(n + 1))


def spread(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    total = int(lens.sum())
    kind = np.int32 if total < 1 << 31 and int(starts.max(initial=0)) < 1 << 31 else np.int64
    out = np.repeat((starts - (np.cumsum(lens) - lens)).astype(kind), lens)
    out += np.arange(total, dtype=kind)
    return out
