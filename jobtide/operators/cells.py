"""Cells for comparing two large tables without forming their pairs as rows.

The left table is cut into chunks and the right one into blocks, both by a hash
of the row id, so a hot key spreads evenly. Every (chunk, block) of a key is one
cell of bounded size that a task compares as matrices; it emits only its own
top rows. Left rows travel once per block and right rows once per chunk.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, cell_rows: int, pieces: int | None = None, most_rows: int = 0):
    """Both tables with their cell columns, and the names to cogroup on. Without keys all rows meet.

    A side of a cell has about ``cell_rows`` rows; with ``pieces``, where a side would be cut into more than these, as many
    more as it takes, up to ``most_rows``.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    size = lambda n: F.greatest(F.lit(cell_rows), F.least(F.lit(most_rows), F.ceil(n / pieces))) if pieces else F.lit(cell_rows)
    cells_of = lambda n: F.ceil(F.col(n) / size(F.col(n))).cast("int")
    # Without keys the sizes are one row.
    meet = lambda df, other: df.join(other, list(keys)) if keys else df.crossJoin(F.broadcast(other))
    sizes = meet(count(left, "_nl"), count(right, "_nr")).select(
        *keys, cells_of("_nl").alias("_chunks"), cells_of("_nr").alias("_blocks")
    )

    def place(df: DataFrame, row_id: str, own: str, own_n: str, other: str, other_n: str) -> DataFrame:
        spread: Column = F.pmod(F.xxhash64(F.col(row_id)), F.col(own_n)).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.col(other_n) - 1))
        placed = meet(df, sizes).withColumn(own, spread).withColumn(other, copies).drop("_chunks", "_blocks")
        # Fresh columns, in case both sides stem from one table.
        return placed.toDF(*placed.columns)

    names = [*keys, "_chunk", "_block"]
    return (
        place(left, left_id, "_chunk", "_chunks", "_block", "_blocks"),
        place(right, right_id, "_block", "_blocks", "_chunk", "_chunks"),
        names,
    )


def smallest_per_row(cost, k: int):
    """(row, column) of the ``k`` smallest finite entries per row, in order; ties by column."""
    import numpy as np

    if cost.size == 0:
        return np.array([], dtype=int), np.array([], dtype=int)
    k = min(k, cost.shape[1])
    limit = np.partition(cost, k - 1, axis=1)[:, k - 1]
    rows, cols = np.nonzero((cost <= limit[:, None]) & np.isfinite(cost))
    order = np.lexsort((cols, cost[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    starts = np.searchsorted(rows, rows, side="left")
    keep = np.arange(len(rows)) - starts < k
    return rows[keep], cols[keep]
