"""Joins with one row of facts per key, safe from keys that hold many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Facts that may be broadcast (some tens of bytes each).
BROADCAST_FACTS = 1_000_000
SALTS = 32
CROWD = 10_000  # rows of a key in each part, where their number is known


def beside(rows: DataFrame, facts: DataFrame, keys: list[str], spread: list[str], how: str = "inner", number: int | None = None, most: int | None = None, most_bytes: int | None = None, sizes: str | None = None) -> DataFrame:
    """``rows`` with the ``facts`` of their key.

    Facts, ``number`` of them (counted, if not given), are broadcast up to ``most`` (``BROADCAST_FACTS``; less for wide ones) and up to ``most_bytes`` of strings, if given, so no
    row moves for its key. Beyond that every key's rows are dealt over ``SALTS`` parts by a hash of the columns ``spread``, and its facts go to each part; with ``sizes``, a column
    of the facts with the number of rows of their key (or more), only keys of over ``CROWD`` rows are, in parts of so many. The hint keeps Spark, which takes the copies
    for no more than the file they are made from, from broadcasting those.
    """
    plain = facts.drop(sizes) if sizes else facts
    size = 0
    if most_bytes is not None:
        number, size = counted(plain)
    elif number is None:
        number = facts.count()
    if number <= (BROADCAST_FACTS if most is None else most) and size <= (most_bytes or 0):
        return rows.join(F.broadcast(plain), keys, how)
    salt, parts = F.pmod(F.xxhash64(*spread), F.lit(SALTS)), F.lit(SALTS)
    if sizes:
        parts = F.greatest(F.ceil(F.col(sizes) / CROWD), F.lit(1)).cast("int")
        crowded = facts.where(F.col(sizes) > CROWD).select(*keys, parts.alias("_salt_parts"))
        rows, salt = rows.join(F.broadcast(crowded), keys, "left"), F.coalesce(F.pmod(F.xxhash64(*spread), F.col("_salt_parts")), F.lit(0))
    dealt = rows.withColumn("_salt", salt.cast("int")).drop("_salt_parts")
    copies = facts.withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop(*[sizes] if sizes else [])
    return dealt.join(copies.hint("merge"), [*keys, "_salt"], how).drop("_salt")


def counted(facts: DataFrame) -> tuple[int, int]:
    """Their number, and the bytes of their strings."""
    sizes = [F.coalesce(F.octet_length(c), F.lit(0)).cast("bigint") for c, kind in facts.dtypes if kind == "string"]
    return tuple(facts.agg(F.count("*"), F.coalesce(F.sum(sum(sizes, F.lit(0))), F.lit(0))).first())
