"""Small helpers for array expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is computed once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Items of a block in sums_before.
BLOCK = 64


def sums_before(values: Column, zero: Column, levels: int = 2) -> Column:
    """The sum of all values before each value of an array, in blocks of blocks, as appending one by one copies what is there."""
    if not levels:
        add = lambda s, v: F.struct((s["sum"] + v).alias("sum"), F.concat(s["out"], F.array(s["sum"])).alias("out"))
        return F.aggregate(values, F.struct(zero.alias("sum"), F.filter(F.array(zero), lambda _: F.lit(False)).alias("out")), add, lambda s: s["out"])

    def in_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, v: s + v))
        return F.flatten(F.zip_with(blocks, sums_before(totals, zero, levels - 1), lambda b, first: F.transform(sums_before(b, zero, 0), lambda x: x + first)))

    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda k: F.slice(v, k * BLOCK + 1, BLOCK))
    return let(values, lambda v: F.when(F.size(v) <= BLOCK, sums_before(v, zero, 0)).otherwise(let(cut(v), in_blocks)))
