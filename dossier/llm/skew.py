"""Joins on keys that may hold a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: keys with over one part in ``PARTS`` of all rows are hot: fewer than ``PARTS`` can be
PARTS = 1000


def join_counted(rows: DataFrame, counted: DataFrame, key: str, count: str = "n") -> DataFrame:
    """Inner join of ``rows`` with ``counted``, which has one row for each
    non-null ``key`` and in ``count`` the number of ``rows`` with it. The hot
    keys, fewer than ``PARTS`` by their share, are broadcast, so their rows stay
    where they are; no other key brings a task over one part in ``PARTS``.
    ``counted`` is read several times: give a written table."""
    total = counted.agg(F.sum(count)).first()[0] or 0
    is_hot = F.col(count) * PARTS > total
    hot = F.broadcast(counted.where(is_hot))
    cold = rows.join(hot.select(key), key, "left_anti").join(counted.where(~is_hot), key)
    return cold.unionByName(rows.join(hot, key))
