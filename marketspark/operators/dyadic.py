"""Aligned pieces of ranges of whole numbers, for joins of ranges with points and for search trees.

A range is cut into pieces of 1, base, base**2... numbers that begin at multiples of their
length, few of each length, however wide the range is. A point lies in one piece of each
length, so in exactly one piece of a range that holds it: an equality of (level, piece).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIECE = "struct<level:int,piece:bigint>"


def pieces(low: Column, high: Column, bits: int = 1, levels: int = 62) -> Column:
    """The aligned pieces, array of struct(level, piece), of the numbers from low to high; none if high is less, null for nulls.

    A piece of level k holds 2**(bits * k) numbers, the first of which is piece * 2**(bits * k).
    There are 2 * (2**bits - 1) pieces of a level at most, any number of the highest.
    """
    base = 1 << bits
    none = F.array().cast(f"array<{PIECE}>")

    def listed(a: Column, b: Column, level: Column) -> Column:
        some = F.transform(F.sequence(a, F.greatest(a, b)), lambda k: F.struct(level.cast("int").alias("level"), k.cast("long").alias("piece")))
        return F.when(a <= b, some).otherwise(none)

    def step(acc: Column, level: Column) -> Column:
        a, b = acc["a"], acc["b"]
        up = F.shiftleft(F.shiftright(a + (base - 1), bits), bits)  # the first and the last boundary inside
        down = F.shiftleft(F.shiftright(b + 1, bits), bits)
        done = (up >= down) | (level == levels - 1)
        found = F.when(done, listed(a, b, level)).otherwise(F.concat(listed(a, up - 1, level), listed(down, b, level)))
        return F.struct(
            F.when(done, F.lit(1)).otherwise(F.shiftright(up, bits)).cast("long").alias("a"),
            F.when(done, F.lit(0)).otherwise(F.shiftright(down, bits) - 1).cast("long").alias("b"),
            F.concat(acc["out"], found).alias("out"),
        )

    # As many levels as the range can have pieces of.
    deep = F.least(F.lit(levels - 1), F.floor(F.log2((high - low + 1).cast("double")) / bits).cast("int") + 1)
    start = F.struct(low.cast("long").alias("a"), high.cast("long").alias("b"), none.alias("out"))
    cut = F.aggregate(F.sequence(F.lit(0), deep), start, step, lambda acc: acc["out"])
    return F.when(low <= high, cut).when(low > high, none)


def piece_of(point: Column, level: Column | int, bits: int = 1) -> Column:
    """The piece of this level that holds the point."""
    return F.call_function("shiftright", point.cast("long"), (level * bits if isinstance(level, Column) else F.lit(level * bits)).cast("int"))


def pieces_of(point: Column, levels: list[int], bits: int = 1) -> Column:
    """The pieces of these levels that hold the point, array of struct(level, piece)."""
    return F.array(*(F.struct(F.lit(k).alias("level"), piece_of(point, k, bits).alias("piece")) for k in levels)).cast(f"array<{PIECE}>")
