"""Matrices as relations, with their shape beside them."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class ShapeError(ValueError):
    """Shapes that do not fit, or entries outside a shape."""


@dataclass(frozen=True)
class Matrix:
    """Entries (k, c, v) of a matrix of ``rows`` times ``cols``.

    The shape is given, never taken from the entries: empty rows and columns at
    the end would be lost.  Entries may repeat; kernels sum them.
    """

    df: DataFrame
    rows: int
    cols: int

    def __post_init__(self):
        if self.rows <= 0 or self.cols <= 0:
            raise ShapeError(f"a matrix of {self.rows} x {self.cols}")
        if missing := {"k", "c", "v"} - set(self.df.columns):
            raise ShapeError(f"entries lack {sorted(missing)}")

    @property
    def nnz(self) -> int:
        return self.df.count()

    def validated(self) -> Matrix:
        """Raise if an entry is null or outside the shape; one pass."""
        bad = self.df.where(f"k is null or c is null or v is null or k < 0 or k >= {self.rows} or c < 0 or c >= {self.cols}").agg(F.count(F.lit(1))).first()[0]
        if bad:
            raise ShapeError(f"{bad} entries are null or outside {self.rows} x {self.cols}")
        return self

    def transposed(self) -> Matrix:
        """Names are swapped; no data moves."""
        names = {"k": "c", "c": "k"}
        return Matrix(self.df.select(*[F.col(names.get(c, c)).alias(c) for c in self.df.columns]), self.cols, self.rows)

    def coalesced(self) -> Matrix:
        """Repeated entries summed."""
        return replace(self, df=self.df.groupBy("k", "c").agg(F.sum("v").alias("v")))

    def slice_rows(self, start: int, count: int) -> Matrix:
        """Rows start to start + count, numbered from 0; the last row may be included."""
        if start < 0 or count <= 0 or start + count > self.rows:
            raise ShapeError(f"rows {start} to {start + count} of {self.rows}")
        return Matrix(self.df.where(F.col("k").between(start, start + count - 1)).withColumn("k", F.col("k") - start), count, self.cols)
