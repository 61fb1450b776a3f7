"""Integer hashing and bit functions as expressions, and values made from them.

Values come from hashes of indices, never from a generator with state, so they
do not depend on how rows are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*keys: Column | str | int, low: float = 0.0, high: float = 1.0) -> Column:
    """A value in [low, high) from a 64-bit hash of the keys."""
    parts = [F.lit(k) if isinstance(k, int) else k for k in keys]
    unit = F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)
    return F.lit(low) + unit * (high - low)


def gaussian(*keys: Column | str | int, mean: float = 0.0, deviation: float = 1.0) -> Column:
    """A normal value from two hashes of the keys (Box and Muller)."""
    u, v = uniform(*keys, 1), uniform(*keys, 2)
    return F.lit(mean) + F.sqrt(-2 * F.log(1 - u)) * F.cos(v * (2 * math.pi)) * deviation


def uniform_int(*keys: Column | str | int, low: int = 0, high: int = 1 << 31) -> Column:
    return (F.floor(uniform(*keys) * (high - low)) + low).cast("long")


#: Fixed values of the repeatable draws: a prime modulus, factors of its field, and shifts.
PRIME, FACTORS, SHIFTS = 2_147_483_647, (48_271, 69_621, 40_692), (13, 17, 11)


def draw(*keys: Column | int) -> Column:
    """A whole number in [0, PRIME) from keys not below 0, by integer steps that SQL engines share.

    No product leaves 63 bits, so no engine rounds or wraps.
    """
    x = F.lit(12_345).cast("long")
    for k in keys:
        k = (F.lit(k) if isinstance(k, int) else k).cast("long")
        steps = F.array(*[F.struct(F.lit(f).cast("long").alias("f"), F.lit(s).alias("s")) for f, s in zip(FACTORS, SHIFTS, strict=True)])
        x = (x * 7_919 + k % PRIME + floor_div(k, PRIME) * 31) % PRIME
        x = F.aggregate(steps, x, lambda a, t: (a.bitwiseXOR(F.call_function("shiftright", a, t["s"])) * t["f"]) % F.lit(PRIME).cast("long"))
    return x


def draw_sql(*keys: str) -> str:
    """The same as SQL text (for DuckDB)."""
    x = "12345::BIGINT"
    for k in keys:
        x = f"(({x}) * 7919 + ({k}) % {PRIME} + (({k}) // {PRIME}) * 31) % {PRIME}"
        for factor, shift in zip(FACTORS, SHIFTS, strict=True):
            x = f"list_transform([{x}], lambda x: (xor(x, x >> {shift}) * {factor}) % {PRIME})[1]"
    return x


def floor_div(a: Column | str, n: int) -> Column:
    """Whole-number division towards minus infinity, exact for every long."""
    a = (F.col(a) if isinstance(a, str) else a).cast("long")
    return F.call_function("div", a - F.pmod(a, F.lit(n).cast("long")), F.lit(n).cast("long")).cast("long")


def bit_reversed(x: Column, bits: int = 64) -> Column:
    """The lowest ``bits`` of x in reverse order."""
    text = F.reverse(F.lpad(F.bin(x), 64, "0"))
    return F.conv(F.substring(text, 1, bits), 2, 10).cast("decimal(20,0)").cast("long") if bits < 64 else F.conv(text, 2, 10).cast("decimal(20,0)")


def ceil_div(a: Column | str, n: int) -> Column:
    a = (F.col(a) if isinstance(a, str) else a).cast("long")
    return floor_div(a, n) + (F.pmod(a, F.lit(n).cast("long")) > 0).cast("long")


def round_up(a: Column | str, n: int) -> Column:
    return ceil_div(a, n) * n


def base_name(path: Column | str) -> Column:
    return F.substring_index(path, "/", -1)


def joined(*parts: Column | str) -> Column:
    """The texts one after the other; null counts as empty."""
    return F.concat(*[F.coalesce((F.col(p) if isinstance(p, str) else p).cast("string"), F.lit("")) for p in parts])


def repeated(text: Column | str, times: int) -> Column:
    return F.repeat(text, times)


def suffix(path: Column | str) -> Column:
    """What follows the last dot of the base name, empty without one."""
    name = base_name(path)
    return F.when(F.instr(name, ".") > 0, F.substring_index(name, ".", -1)).otherwise(F.lit(""))
