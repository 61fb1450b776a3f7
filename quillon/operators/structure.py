"""Structure and values of a sparse matrix apart: new values need no new transpose.

``places`` has pos, k, c in row-major order, and ``back`` the same places in the order
of the transposed matrix with pos_t.  Both are made once and written.  Values are
a relation (pos, v); a product takes them through the place, in either order.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix
from ..plans.work import written
from .kernels import forward, update
from .layout import positioned
from .ranks import ranked


@dataclass(frozen=True)
class Structure:
    places: DataFrame
    back: DataFrame
    rows: int
    cols: int

    def matrix(self, values: DataFrame) -> Matrix:
        """The matrix that has these values, by place; a place without one has 0."""
        return Matrix(self.places.join(values, "pos", "left").select("k", "c", "v", "pos"), self.rows, self.cols)

    def transposed(self, values: DataFrame) -> Matrix:
        """The transposed matrix, from the places that are kept in its order."""
        return Matrix(self.back.join(values, "pos", "left").select(F.col("c").alias("k"), F.col("k").alias("c"), "v", "pos_t"), self.cols, self.rows)

    def forward(self, values: DataFrame, inputs: DataFrame, strategy: str | None = None) -> DataFrame:
        return forward(self.matrix(values), inputs, strategy)

    def backward(self, values: DataFrame, grads: DataFrame, strategy: str | None = None) -> DataFrame:
        """d[n, c] by the rows of the transposed structure, with values through the index map."""
        out = forward(self.transposed(values), grads, strategy)
        return out.select("n", F.col("k").alias("c"), F.col("o").alias("d"))

    def update(self, inputs: DataFrame, grads: DataFrame) -> DataFrame:
        """pos, v: the update of every stored entry, as values for a next step."""
        shape = Matrix(self.places.withColumn("v", F.lit(0)), self.rows, self.cols)
        sums = update(shape, inputs, grads).distinct()
        return self.places.join(sums, ["k", "c"]).select("pos", F.col("dv").alias("v"))


def taken_apart(m: Matrix) -> tuple[Structure, DataFrame]:
    """The structure of ``m`` and its values."""
    placed = written(positioned(m), "places")
    places = placed.select("pos", "k", "c")
    back = written(ranked(places, ["c", "k", "pos"], "pos_t"), "places-back")
    return Structure(places, back, m.rows, m.cols), placed.select("pos", "v")


def stepped(values: DataFrame, change: DataFrame, rate: float = 1) -> DataFrame:
    """values + rate * change, by place."""
    both = values.join(change.select("pos", F.col("v").alias("__d")), "pos", "left")
    return both.select("pos", (F.col("v") + F.lit(rate) * F.coalesce("__d", F.lit(0))).alias("v"))
