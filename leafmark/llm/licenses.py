"""License scans: fuzzy search for short notices.

A notice of m characters matched with at most k edits keeps, by the pigeonhole principle, one of
its k + 1 pieces unchanged. The pieces of all notices go into one Aho-Corasick automaton; each
hit opens a small window, and the regex library's bounded-error matching verifies the window and
gives the span and the number of edits. The base phrases are counted exactly, by words.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import defaultdict
from functools import lru_cache

import ahocorasick
import pandas as pd
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ship_package, table, with_key

# Words and base phrases of the contract.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Short notices (words as normalised: lower case, single spaces) and their labels.
NOTICES = (
    ("licensed under the apache license", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("general public license", "gpl"),
    ("mozilla public license", "mpl"),
    ("licensed under cc by", "cc-by"),
    ("creative commons attribution", "cc-by"),
    ("attribution noncommercial", "cc-nc"),
    ("licensed under cc by nc", "cc-nc"),
    ("attribution sharealike", "cc-sa"),
    ("dedicated to the public domain", "public-domain"),
    ("all rights reserved", "reserved"),
)
#: Edits allowed for each character of a notice.
ERROR_RATE = 0.1


class NoticeSearch:
    """Pigeonhole-split seeds, candidate windows and bounded-error verification over normalised text."""

    def __init__(self, notices=NOTICES, error_rate: float = ERROR_RATE):
        self.notices = [(text, label, int(len(text) * error_rate)) for text, label in notices]
        self.checks = [regex.compile(f"(?b)(?:{regex.escape(text)}){{e<={k}}}") for text, _, k in self.notices]
        seeds = defaultdict(list)
        for i, (text, _, k) in enumerate(self.notices):
            cut = [round(len(text) * j / (k + 1)) for j in range(k + 2)]
            for a, b in zip(cut, cut[1:], strict=False):
                seeds[text[a:b]].append((i, a))
        self.auto = ahocorasick.Automaton()
        for seed, where in seeds.items():
            self.auto.add_word(seed, (len(seed), where))
        self.auto.make_automaton()

    def find(self, norm: str) -> list[tuple[int, int, str, float]]:
        """(start, end, label, similarity) of every notice found, leftmost first.

        Each seed's own window, which holds any match that the seed is part of, is verified; windows are as long as the notice
        and its edits, so time grows with the hits. Of matches of a notice that overlap, those of fewer edits stay.
        """
        windows = defaultdict(set)
        for end, (size, where) in self.auto.iter(norm):
            for i, at in where:
                windows[i].add(end + 1 - size - at)
        out = []
        for i, starts in windows.items():
            text, label, k = self.notices[i]
            hits = set()
            for start in starts:
                m = self.checks[i].search(norm, max(0, start - k), min(len(norm), start + len(text) + k))
                if m and m.end() > m.start():
                    hits.add((sum(m.fuzzy_counts), *m.span()))
            taken: list[tuple[int, int]] = []
            for edits, a, b in sorted(hits):
                at = bisect_left(taken, (a, b))
                if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                    taken.insert(at, (a, b))
                    out.append((a, b, label, 1.0 - edits / len(text)))
        return sorted(out)


@lru_cache(maxsize=4)
def searcher(notices=NOTICES, error_rate: float = ERROR_RATE) -> NoticeSearch:
    return NoticeSearch(notices, error_rate)


_UPPER = {c: c + 32 for c in range(65, 91)}


def lower_ascii(text: str) -> str:
    return text.lower() if text.isascii() else text.translate(_UPPER)


def normal(text: str | None) -> str:
    """Lower-cased A-Z, words joined by single spaces."""
    return GAP.sub(" ", lower_ascii(text or "")).strip(" ")


def base(norm: str) -> tuple[int, int, int | None, int | None, set[str]]:
    """(words, places of base phrases, first and last place, labels)."""
    words = norm.count(" ") + 1 if norm else 0
    n, first, last, labels, framed = 0, None, None, set(), None
    for phrase, label in PHRASES:
        if phrase not in norm:
            continue
        framed = framed or f" {norm} "
        at, k, told = framed.find(f" {phrase} "), 0, 0
        while at >= 0:
            k, told = k + framed.count(" ", told, at), at
            n += 1
            first = k if first is None else min(first, k)
            last = k if last is None else max(last, k)
            labels.add(label)
            at = framed.find(f" {phrase} ", at + 1)
    return words, n, first, last, labels


def scan_text(text: str | None, search: NoticeSearch | None = None):
    norm = normal(text)
    words, n, first, last, labels = base(norm)
    found = (search or searcher()).find(norm)
    score = max([1.0] * bool(n) + [s for *_, s in found], default=0.0)
    spans = []
    if found:  # back to the text's own code points
        ends = [m.span() for m in re.finditer(WORD, lower_ascii(text))]
        gaps = [m.start() for m in re.finditer(" ", norm)]
        for a, b, label, s in found:
            first_word = bisect_left(gaps, a) + (norm[a] == " ")
            last_word = bisect_left(gaps, b) - (norm[b - 1] == " ")
            spans.append((ends[min(first_word, len(ends) - 1)][0], ends[min(last_word, len(ends) - 1)][1], label, s))
    return words, n, first, last, labels, labels | {x[2] for x in found}, score, spans


def scan(docs: DataFrame, notices=NOTICES, error_rate: float = ERROR_RATE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    docs needs doc_id and text; other columns are ignored. Null and empty texts have no words, no
    labels (empty strings), null places and score 0. spans: array of (start, end, label, similarity)
    in code points of the text. Repeated rows are scanned each on its own.
    """
    ship_package(docs.sparkSession)

    def run(batches):
        search = searcher(notices, error_rate)
        for pdf in batches:
            rows = [scan_text(t, search) for t in pdf["text"]]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "n_words": [r[0] for r in rows], "n_base": [r[1] for r in rows],
                "first_word": pd.array([r[2] for r in rows], "Int64"), "last_word": pd.array([r[3] for r in rows], "Int64"),
                "base_labels": [",".join(sorted(r[4])) for r in rows], "labels": [",".join(sorted(r[5])) for r in rows],
                "score": [float(r[6]) for r in rows],
                "spans": [[{"start": a, "end": b, "label": x, "similarity": s} for a, b, x, s in r[7]] for r in rows]})

    return with_key(docs.select("doc_id", "text"), "doc_id", run, (
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
        "score double, spans array<struct<start:long,end:long,label:string,similarity:double>>"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
