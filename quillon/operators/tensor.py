"""Dense tensors as relations: index columns i0, i1, ... and a value v."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import PRIME, draw, floor_div
from ..matrix import ShapeError


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    dims: tuple[int, ...]
    #: Allocated dimensions, not less than ``dims``; none: no padding.
    allocated: tuple[int, ...] | None = None

    def __post_init__(self):
        if self.allocated and (len(self.allocated) != len(self.dims) or any(a < d for a, d in zip(self.allocated, self.dims, strict=True))):
            raise ShapeError(f"{self.allocated} does not hold {self.dims}")

    @property
    def leading(self) -> tuple[int, ...]:
        return self.allocated or self.dims

    @property
    def leading_size(self) -> int:
        return reduce(lambda a, b: a * b, self.leading, 1)

    @property
    def length(self) -> int:
        """The values of a vector."""
        return self.axis_size(0, 1)

    @property
    def rows(self) -> int:
        return self.axis_size(0, 2)

    @property
    def cols(self) -> int:
        return self.axis_size(1, 2)

    def axis_size(self, d: int, rank: int) -> int:
        if self.rank != rank:
            raise ShapeError(f"a tensor of rank {self.rank}, not {rank}")
        return self.dims[d]

    def padded(self, *pad: int) -> Tensor:
        """The same values in an allocation that is larger by ``pad`` along each axis."""
        if len(pad) != self.rank or min(pad) < 0:
            raise ShapeError(f"padding {pad} of {self.dims}")
        return Tensor(self.df, self.dims, tuple(d + p for d, p in zip(self.dims, pad, strict=True)))

    def printed(self) -> DataFrame:
        """Lines: a vector's values, a matrix's rows, or those of every matrix of a higher rank under its indices."""
        value = F.col("v").cast("string")
        if self.rank == 1:
            return self.df.orderBy("i0").select(value.alias("line"))
        held = [f"i{d}" for d in range(2, self.rank)]
        rows = self.df.groupBy(*held, "i0").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i1", value.alias("v"))))["v"], " ").alias("line"))
        if not held:
            return rows.orderBy("i0").select("line")
        heads = self.df.select(*held).distinct().select(*held, F.lit(-1).cast("long").alias("i0"), F.format_string("[%s]", F.concat_ws(", ", F.lit(":"), F.lit(":"), *[F.col(h).cast("string") for h in held])).alias("line"))
        return heads.unionByName(rows).orderBy(*reversed(held), "i0").select("line")

    @property
    def rank(self) -> int:
        return len(self.dims)

    @property
    def size(self) -> int:
        return reduce(lambda a, b: a * b, self.dims, 1)

    @property
    def strides(self) -> tuple[int, ...]:
        """Column-major over the allocation: the first index moves fastest."""
        out = [1]
        for d in self.leading[:-1]:
            out.append(out[-1] * d)
        return tuple(out)

    def offset(self) -> Column:
        return reduce(lambda a, b: a + b, [F.col(f"i{d}") * s for d, s in enumerate(self.strides)]).cast("long")

    def with_offset(self) -> DataFrame:
        return self.df.withColumn("offset", self.offset())

    def ordered(self, backwards: bool = False) -> DataFrame:
        rows = self.with_offset()
        return rows.orderBy(F.col("offset").desc() if backwards else F.col("offset"))

    def fiber(self, along: int, **fixed: int) -> DataFrame:
        """The values along one axis, the other indices fixed (i0=..., i2=...)."""
        if set(fixed) != {f"i{d}" for d in range(self.rank) if d != along}:
            raise ShapeError("every index but the one along the fiber is to be fixed")
        rows = reduce(lambda df, x: df.where(F.col(x[0]) == x[1]), fixed.items(), self.df)
        return rows.select(F.col(f"i{along}").alias("i"), "v")

    def at(self, *index: int) -> DataFrame:
        if len(index) != self.rank or any(not 0 <= i < d for i, d in zip(index, self.dims, strict=False)):
            raise ShapeError(f"{index} is not in {self.dims}")
        return reduce(lambda df, x: df.where(F.col(f"i{x[0]}") == x[1]), enumerate(index), self.df).select("v")


def filled(spark: SparkSession, dims: tuple[int, ...], value: Column) -> Tensor:
    """A tensor whose value is an expression over its index columns."""
    if not dims or min(dims) <= 0:
        raise ShapeError(f"dimensions {dims}")
    tensor = Tensor(spark.range(1).selectExpr("0L as v"), tuple(dims))
    rows = spark.range(tensor.size)
    rows = rows.select(*[(floor_div(F.col("id"), s) % d).cast("long").alias(f"i{k}") for k, (s, d) in enumerate(zip(tensor.strides, dims, strict=True))])
    return Tensor(rows.withColumn("v", value), tuple(dims))


def random(spark: SparkSession, dims: tuple[int, ...], seed: int = 0, low: float = -1.0, high: float = 1.0) -> Tensor:
    """Values in [low, high) from hashes of their places, for any rank."""
    return filled(spark, dims, F.lit(low) + draw(seed, *[F.col(f"i{d}") for d in range(len(dims))]) / float(PRIME) * (high - low))


def constant(spark: SparkSession, dims: tuple[int, ...], value) -> Tensor:
    return filled(spark, dims, F.lit(value))


def from_nested(spark: SparkSession, values: list) -> Tensor:
    """A tensor from nested lists of one shape."""

    def shape(x) -> tuple[int, ...]:
        if not isinstance(x, list):
            return ()
        inner = {shape(y) for y in x}
        if len(inner) != 1:
            raise ShapeError("the lists are ragged or empty")
        return (len(x), *inner.pop())

    def cells(x, at: tuple[int, ...]):
        if isinstance(x, list):
            for i, y in enumerate(x):
                yield from cells(y, (*at, i))
        else:
            yield (*at, x)

    dims = shape(values)
    return Tensor(spark.createDataFrame(list(cells(values, ())), [*[f"i{d}" for d in range(len(dims))], "v"]), dims)


def vector_norms(df: DataFrame, by: list[str], value: str = "x") -> DataFrame:
    """l1, l2 squared, and the greatest absolute value, of each vector."""
    x = F.col(value)
    return df.groupBy(*by).agg(F.sum(F.abs(x)).alias("l1"), F.sum(x * x).alias("l2_squared"), F.max(F.abs(x)).alias("linf"))


def matrix_norms(df: DataFrame) -> DataFrame:
    """Greatest column sum, greatest row sum, and the Frobenius norm squared, of (k, c, v).

    Both kinds of sums come from one pass over the entries.
    """
    sets = df.groupingSets([[F.col("k")], [F.col("c")]], F.col("k"), F.col("c")).agg(F.grouping("k").alias("by_c"), F.sum(F.abs("v")).alias("s"), F.sum(F.col("v") * F.col("v")).alias("q"))
    return sets.agg(F.max(F.when(F.col("by_c") == 1, F.col("s"))).alias("l1"), F.max(F.when(F.col("by_c") == 0, F.col("s"))).alias("linf"), F.sum(F.when(F.col("by_c") == 0, F.col("q"))).alias("frobenius_squared"))


def normalised(df: DataFrame, by: str, value: str = "x") -> DataFrame:
    """Each vector over its length; a zero vector stays as it is."""
    norms = vector_norms(df, [by], value).select(by, F.sqrt(F.col("l2_squared").cast("double")).alias("__l"))
    return df.join(norms, by).withColumn(value, F.when(F.col("__l") > 0, F.col(value) / F.col("__l")).otherwise(F.col(value).cast("double"))).drop("__l")


def array_norms(df: DataFrame, value: str = "x") -> DataFrame:
    """``df`` with the norms of each row's vector, in place: nothing is shuffled."""
    zero = F.element_at(value, 1) * 0
    total = lambda f: F.aggregate(F.transform(value, f), F.lit(0).cast("long") if integral(df, value) else F.lit(0.0), lambda a, b: a + b)
    return df.select("*", total(F.abs).alias("l1"), total(lambda x: x * x).alias("l2_squared"), F.array_max(F.transform(value, F.abs)).alias("linf")).withColumn("linf", F.coalesce("linf", zero))


def integral(df: DataFrame, value: str) -> bool:
    return dict(df.dtypes)[value] in ("array<tinyint>", "array<smallint>", "array<int>", "array<bigint>")


def array_normalised(df: DataFrame, value: str = "x") -> DataFrame:
    """Each row's vector over its length, in place; a zero vector stays as it is."""
    length = F.sqrt(F.aggregate(F.transform(value, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b))
    # Bound once for a row; as a column it would be made again for every value.
    over = F.transform(F.array(length), lambda l: F.transform(value, lambda x: F.when(l > 0, x / l).otherwise(x.cast("double"))))[0]
    return df.withColumn(value, over)
