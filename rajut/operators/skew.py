"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot when it holds more than this share of the rows. At most
#: 1 / HOT_SHARE keys can be hot, which bounds what is broadcast.
HOT_SHARE = 0.001
HOT_ROWS = 100_000


def split_hot(keyed: DataFrame, weight: str, share: float = HOT_SHARE, least: int = HOT_ROWS, total: int | None = None) -> tuple[DataFrame, DataFrame, int]:
    """Split a table with one row per key into hot and ordinary keys.

    ``weight`` is the number of rows the key holds on the other side of a later
    join, ``total`` their sum if it is known. Returns (hot, rest, number of hot keys at
    most). One number comes to the driver.
    """
    if total is None:
        total = keyed.agg(F.coalesce(F.sum(weight), F.lit(0)).alias("t")).first()["t"]
    floor = max(least, int(total * share))
    if total <= floor:
        return keyed.limit(0), keyed, 0
    return keyed.where(F.col(weight) > floor), keyed.where(F.coalesce(F.col(weight), F.lit(0)) <= floor), int(total // floor)


def lookup(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner", **hot) -> DataFrame:
    """Join ``left`` to ``right``, which has one row per key and knows each key's weight.

    Hot keys are joined by broadcast (at most 1 / HOT_SHARE rows, a proven
    bound), so none of their rows is shuffled; the others by an ordinary join.
    The result holds the same rows as a plain join. ``how``: inner or left.
    """
    hot_rows, rest, n = split_hot(right, weight, **hot)
    if n == 0:
        return left.join(right, keys, how)
    hot_keys = hot_rows.select(*keys, F.lit(True).alias("_hot"))
    marked = left.join(F.broadcast(hot_keys), keys, "left")
    a = marked.where(F.col("_hot")).drop("_hot").join(F.broadcast(hot_rows), keys, "inner")
    b = marked.where(F.col("_hot").isNull()).drop("_hot").join(rest, keys, how)
    return a.unionByName(b)
