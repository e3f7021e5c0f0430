"""Sides of a join that go to every executor, with their size checked."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

#: Most rows of a side that is broadcast, and rows of a block where a larger one is taken in blocks.
MOST, BLOCK = 100_000, 2_000


def bounded(df: DataFrame, most: int = MOST) -> DataFrame:
    """df as a broadcast side; refuses one of more rows than most."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} rows for a broadcast side; take it in blocks")
    return F.broadcast(df)


def blocks(df: DataFrame, rows: int = BLOCK) -> Iterator[list[Row]]:
    """Rows of df in blocks; the driver holds one at a time."""
    held: list[Row] = []
    for row in df.toLocalIterator():
        held.append(row)
        if len(held) == rows:
            yield held
            held = []
    if held:
        yield held
