"""Which form a product takes, from timed runs on samples of the matrices themselves.

A form is run on two samples of the vectors, of one and of ``GROWTH`` times as many,
with the whole sparse side.  What a run costs at once and for each vector follows
from the two, and so does the time that all vectors would take.  What is sampled
is bounded, so tuning a product of any size takes about the same time.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..matrix import Matrix, ShapeError
from ..operators import kernels

#: Vectors of the smaller sample, and how many times as many the larger one has.
SAMPLE, GROWTH = 256, 8


@dataclass(frozen=True)
class Timed:
    name: str
    fixed: float
    each: float
    total: float


def forms(kind: str) -> dict[str, Callable[[Matrix, DataFrame], DataFrame]]:
    """The forms of a forward product, the grid with parts of several sizes."""
    plain = {name: partial(kernels.forward, strategy=name) for name in ("blocked", "vector", "coordinate")}
    grids = {f"tiled-{most}": partial(kernels.tiled, kind=kind, most=most) for most in (1 << 14, 1 << 18)}
    return plain | grids


def seconds(df: DataFrame) -> float:
    began = time.perf_counter()
    df.write.format("noop").mode("overwrite").save()
    return time.perf_counter() - began


def measured(w: Matrix, inputs: DataFrame, candidates: dict[str, Callable[[Matrix, DataFrame], DataFrame]] | None = None, sample: int = SAMPLE) -> list[Timed]:
    """The candidates by the time that they would take, the fastest first; those that refuse the shape are left out."""
    spark = inputs.sparkSession
    kind = kernels.number_kind(kernels.kinds(w.df)["v"], kernels.kinds(inputs)["x"])
    n = inputs.count()
    small, large = (spark.createDataFrame(rows, inputs.schema) for rows in (lambda r: (r[:sample], r))(inputs.limit(sample * GROWTH).collect()))
    counts = [min(n, sample), min(n, sample * GROWTH)]
    out = []
    for name, form in (candidates or forms(kind)).items():
        try:
            seconds(form(w, small))  # compiled, and files are read once
            took = [seconds(form(w, x)) for x in (small, large)]
        except ShapeError:
            continue
        each = max(0.0, (took[1] - took[0]) / max(1, counts[1] - counts[0]))
        out.append(Timed(name, took[0] - each * counts[0], each, took[0] + each * (n - counts[0])))
    return sorted(out, key=lambda t: t.total)


def tuned(w: Matrix, inputs: DataFrame, candidates: dict[str, Callable[[Matrix, DataFrame], DataFrame]] | None = None, sample: int = SAMPLE) -> DataFrame:
    """The forward product in the form that was the fastest of the samples."""
    kind = kernels.number_kind(kernels.kinds(w.df)["v"], kernels.kinds(inputs)["x"])
    candidates = candidates or forms(kind)
    return candidates[measured(w, inputs, candidates, sample)[0].name](w, inputs)


def report(w: Matrix, inputs: DataFrame, **options) -> DataFrame:
    """config, seconds at once, seconds a vector, and seconds of all vectors, for each form."""
    rows = [(t.name, t.fixed, t.each, t.total) for t in measured(w, inputs, **options)]
    return inputs.sparkSession.createDataFrame(rows, "config string, fixed double, each double, total double").orderBy(F.col("total"))
