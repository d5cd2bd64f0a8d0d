"""The wrong-answer book over a stream of graded attempts: keyed state, one upsert row for each change.

State is the time of the last right answer and the times of the wrong ones after it, so attempts may come in any order and in
any micro-batch: a late wrong answer counts only if no right one is after it, and a late right answer takes out the wrong ones
before it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from leafmark.sources.tables import ship_package

OUT = "key string, in_book boolean, wrong_count long"


def fold(count: int, outcomes: list[bool], counting: bool) -> int:
    """What a book's count becomes by outcomes in order."""
    for right in outcomes:
        count = 0 if right else count + 1 if counting or not count else count
    return count


def absorb(right: int | None, wrong: list[int], attempts: list[tuple[int, bool]]) -> tuple[int | None, list[int]]:
    """State after more attempts (time, correct), in whatever order; of one time, the right answer is the later."""
    for at, ok in attempts:
        if ok and (right is None or at > right):
            right = at
        elif not ok:
            wrong = [*wrong, at]
    return right, sorted(w for w in wrong if right is None or w > right)


def wrong_book_stream(attempts: DataFrame, counting: bool = False) -> DataFrame:
    """attempts (key, ts long, correct), a stream -> updates (key, in_book, wrong_count); run in update mode."""
    ship_package(attempts.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        right, wrong = state.get if state.exists else (None, [])
        rows = [(int(t), bool(c)) for pdf in batches for t, c in zip(pdf["ts"], pdf["correct"], strict=True) if c is not None and not pd.isna(c)]
        right, wrong = absorb(None if right is None or pd.isna(right) else int(right), [int(w) for w in wrong], rows)
        state.update((right, wrong))
        yield pd.DataFrame({"key": [key[0]], "in_book": [bool(wrong)], "wrong_count": [len(wrong) if counting else min(len(wrong), 1)]})
    return attempts.groupBy("key").applyInPandasWithState(step, OUT, "right long, wrong array<long>", "update", GroupStateTimeout.NoTimeout)
