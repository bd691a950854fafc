"""Joins that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_KEYS = 8192


def hot_join(big: DataFrame, side: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of big with side, which has one row per key and in `count` the key's rows in big (`total` in all).

    Keys holding at least total/HOT_KEYS rows are at most HOT_KEYS by counting, so their rows of `side` are
    broadcast and the hot rows of `big` stay where they are; the others are joined by a shuffle in which no
    key holds more than 1/HOT_KEYS of the rows. `big` is read twice and should be a stored table or cheap.
    Null keys match nothing.
    """
    limit = max(total / HOT_KEYS, 1000)
    hot = F.broadcast(side.filter(F.col(count) >= limit))
    cold = side.filter(F.col(count) < limit)
    rest = big.join(hot.select(key), key, "left_anti")
    return big.join(hot, key).unionByName(rest.join(cold, key))
