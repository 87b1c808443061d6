"""Column expressions over long arrays in a row: values bound once, and running totals without a copy a step."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of a block. A running total copies at most this many values a step, and one value a block.
BLOCK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value made once: an expression that a lambda holds is else made anew for each element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def before(values: Column, combine: Callable[[Column, Column], Column], zero: Column, kind: str) -> Column:
    """For each element what combine makes of all before it, from zero on; combine is associative.

    Blocks are combined first, then each is run through from where the blocks before it end."""

    def run(block: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.expr(f"cast(array() as array<{kind}>)").alias("out"))
        return F.aggregate(block, begin, lambda acc, x: F.struct(combine(acc["at"], x).alias("at"), F.array_append(acc["out"], acc["at"]).alias("out")), lambda acc: acc["out"])

    def over(blocks: Column) -> Column:
        starts = run(F.transform(blocks, lambda b: F.aggregate(b, zero, combine)), zero)
        return F.flatten(F.zip_with(blocks, starts, run))

    def cut(held: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / BLOCK).cast("int"))
        blocks = F.transform(numbers, lambda b: F.slice(held, b * BLOCK + 1, F.lit(BLOCK)))
        return F.when(F.size(held) > 0, bound(blocks, over)).otherwise(F.expr(f"cast(array() as array<{kind}>)"))

    return bound(values, cut)
