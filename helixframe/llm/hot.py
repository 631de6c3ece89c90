"""Equality joins whose hot keys are dealt to many tasks, without leaning on run-time splits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that are dealt out at most (the broadcast list has a row of two numbers for each), and rows
#: of a key below which it never is.
MOST, LEAST = 100_000, 1000


def join_hot(rows: DataFrame, side: DataFrame, key: str | list[str], copies: str, total: int, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined (``how``: inner or left) with ``side``, which has one row for each key and, as
    ``copies``, how many of the ``total`` rows have that key. A key with more than total / MOST rows
    goes to several tasks, by a hash of column ``by``; there are fewer than MOST such keys, so their
    list is broadcast. Rows with equal ``by`` and key go together."""
    keys, least = [key] if isinstance(key, str) else key, max(LEAST, total // MOST)
    hot = side.filter(F.col(copies) > least).select(*keys, (1 + F.floor(F.col(copies) / least)).alias("_shares"))
    dealt = rows.join(F.broadcast(hot), keys, "left").withColumn("_share", F.coalesce(F.pmod(F.xxhash64(by), "_shares"), F.lit(0))).drop("_shares")
    shares = F.when(F.col(copies) > least, F.floor(F.col(copies) / least)).otherwise(0)
    return dealt.join(side.withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), shares.cast("long")))), [*keys, "_share"], how).drop("_share")
