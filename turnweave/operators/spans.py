"""Spans on time cells of several sizes, so that spans of any length meet by equi-joins.

Cells of one size are CELLS times as long as those of the size before.  A span belongs to the smallest size on which it takes
at most CELLS + 1 cells, and stands on its cells of that size and on its one to three cells of each greater size that the other side uses.
Two spans are compared on the greater of their sizes, in the cell where their common part begins, and so only once.  A span of
ten hours takes a few rows, not one for each cell of the least size, and where no span is long nothing is added to the least cells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CELLS, SIZES = 32, 5
#: What on_cells() adds besides the span's own size: the size and number of a cell, by which two sides are joined.
AT = ["_size", "_cell"]


def cell_of(at: Column, size: Column, seconds: float) -> Column:
    return F.floor(at / (F.lit(seconds) * F.pow(F.lit(CELLS), size)))


def size_of(start: Column, end: Column, seconds: float) -> Column:
    size = F.lit(SIZES - 1)
    for k in reversed(range(SIZES - 1)):
        size = F.when(cell_of(end, F.lit(k), seconds) - cell_of(start, F.lit(k), seconds) <= CELLS, F.lit(k)).otherwise(size)
    return size


def on_cells(spans: DataFrame, others: DataFrame, start: str, end: str, own: str, seconds: float, other_start: str = "start", other_end: str = "end") -> DataFrame:
    """spans with own (their size), _size and _cell, one row for each cell.  Spans without a start or an end leave."""
    greatest = others.agg(F.max(size_of(F.col(other_start), F.col(other_end), seconds)).alias("_most")).scalar()
    sized = spans.withColumn(own, size_of(F.col(start), F.col(end), seconds)).withColumn("_most", F.greatest(own, greatest))
    sized = sized.withColumn("_size", F.explode(F.sequence(own, "_most"))).drop("_most")
    cells = F.sequence(cell_of(F.col(start), F.col("_size"), seconds), cell_of(F.col(end), F.col("_size"), seconds))
    return sized.withColumn("_cell", F.explode(cells))


def met_first(own: str, other: str, at: Column, seconds: float) -> Column:
    """Whether two spans met in the one cell that counts; at is where their common part begins."""
    return (F.col("_size") == F.greatest(own, other)) & (F.col("_cell") == cell_of(at, F.col("_size"), seconds))
