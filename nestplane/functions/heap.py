"""Integer arithmetic on binary-heap node ids: root 0, children ``2j+1`` and ``2j+2``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def child(node: Column, side: Column | int) -> Column:
    side = side if isinstance(side, Column) else F.lit(side)
    return (node * F.lit(2) + F.lit(1) + side).cast("bigint")


def parent(node: Column) -> Column:
    """NULL at the root."""
    return F.when(node > 0, F.shiftright(node - F.lit(1), 1).cast("bigint"))


def side(node: Column) -> Column:
    """0 for a left child, 1 for a right child, NULL at the root."""
    return F.when(node > 0, ((node + F.lit(1)) % F.lit(2)).cast("int"))


def depth(node: Column) -> Column:
    return (F.length(F.bin(node + F.lit(1))) - F.lit(1)).cast("int")


def level_offset(level: Column) -> Column:
    """Id of the first node of a level."""
    return (F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int")) - 1).cast("bigint")


def path(node: Column) -> Column:
    """Ids from the root down to ``node``."""
    level = depth(node)
    return F.transform(
        F.sequence(F.lit(0), level),
        lambda k: F.call_function("shiftright", node + F.lit(1), level - k) - F.lit(1),
    )
