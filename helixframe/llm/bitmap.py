"""Fixed-size bit maps of 64-bit hashes: rows that surely find no partner stay out of a shuffle.

A map has 2 ** BITS bits (16 MB) whatever the input; a fuller one only lets more rows through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS = 27


def bitmap(df: DataFrame, value: Column) -> bytes:
    """The map of a long column that is spread evenly, such as a hash."""
    at = F.shiftrightunsigned(value, 64 - BITS)
    rows = df.select(at.alias("at")).select(F.shiftright("at", 6).alias("word"), F.expr("shiftleft(1L, cast(at & 63 as int))").alias("bit"))
    words = rows.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # 2 ** (BITS - 6) rows at most
    out = np.zeros(1 << (BITS - 6), np.int64)
    out[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return out.tobytes()


def may_hold(raw: bytes, values: np.ndarray) -> np.ndarray:
    """Which values (int64) the map may hold."""
    bits = np.frombuffer(raw, np.uint64)
    at = values.view(np.uint64) >> np.uint64(64 - BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def maybe(spark: SparkSession, raw: bytes, value: Column) -> Column:
    """Whether the map may hold a value (a hash): only that column goes through Python."""
    sent = spark.sparkContext.broadcast(raw)

    @F.pandas_udf("boolean")
    def held(v: pd.Series) -> pd.Series:
        return pd.Series(may_hold(sent.value, v.to_numpy()))

    return held(value)
