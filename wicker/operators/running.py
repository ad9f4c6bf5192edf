"""Running sums and positions over an order, without a task that holds a whole group.

Rows are cut into runs by the first bytes of their sort key, as many bytes as it takes for runs of a bounded size, and only
where a run would be too large. A run's start comes from the totals of the runs before it, and only the rows of one run are
sorted together.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows that one run holds at most, unless more have keys that agree in all bytes looked at.
RUN_ROWS = 1 << 18
#: Bytes by which prefixes of keys grow, and how long they get.
STEP, LONGEST_KEY = 8, 512


def _inside(rows: DataFrame, large: DataFrame, within: list[str], size: int, how: str) -> DataFrame:
    """rows (within, _key) joined with the groups of keys with one prefix of that size that large (within, _start) names."""
    named = large.select(*[F.col(c).alias(f"_l_{c}") for c in within], F.col("_start").alias(f"_start_{size}"))
    same = [F.substring("_key", 1, size) == F.col(f"_start_{size}"), *[F.col(c).eqNullSafe(F.col(f"_l_{c}")) for c in within]]
    return rows.join(F.broadcast(named), reduce(Column.__and__, same), how).drop(*[f"_l_{c}" for c in within])


def key_cuts(rows: DataFrame, within: list[str], key: Column, most: int = RUN_ROWS) -> list[tuple[int, DataFrame]]:
    """Sizes of prefixes of the key from 0 on, each with the groups (within, _start) of rows with one such prefix that hold more than `most` rows: these are cut by the next size, all others are runs. The driver sees these groups, one for each `most` rows at most."""
    every, cuts = rows.select(*within, key.alias("_key")), []
    while (size := STEP * len(cuts)) < LONGEST_KEY:
        left = _inside(every, cuts[-1][1], within, cuts[-1][0], "left_semi") if cuts else every
        large = left.groupBy(*within, F.substring("_key", 1, size).alias("_start")).count().where(F.col("count") > most).drop("count")
        found = large.collect()
        if not found:
            break
        cuts.append((size, rows.sparkSession.createDataFrame(found, large.schema)))
    return cuts


def key_bytes(rows: DataFrame, within: list[str], key: Column, most: int = RUN_ROWS) -> int:
    """Bytes of the key that cut every group into runs of at most `most` rows."""
    return STEP * len(key_cuts(rows, within, key, most))


def running(rows: DataFrame, within: list[str], key: Column, values: dict[str, Column], then: list[Column] | None = None, most: int = RUN_ROWS) -> DataFrame:
    """rows with a running sum under each name of values, the row itself included, in order of key (binary), then of `then`, in each group of `within`.

    Rows that are equal in all of these should be interchangeable. Groups may be null.
    """
    cuts = key_cuts(rows, within, key, most)
    keyed = rows.withColumns({"_key": key} | {f"_v_{n}": c for n, c in values.items()})
    for size, large in cuts:
        keyed = _inside(keyed, large, within, size, "left")
    # A group that is too large lies in such groups of all smaller sizes.
    size = sum((F.col(f"_start_{size}").isNotNull().cast("int") for size, _ in cuts), F.lit(0)) * STEP
    keyed = keyed.withColumn("_run", F.substring(F.col("_key"), F.lit(1), size)).drop(*[f"_start_{size}" for size, _ in cuts])
    sums = keyed.groupBy(*within, "_run").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in values])
    before = Window.partitionBy(*within).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*[F.col(c).alias(f"_w_{c}") for c in within], F.col("_run").alias("_of"), *[F.coalesce(F.sum(f"_s_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    # The window runs over sums before the select renames them.
    inside = Window.partitionBy(*within, "_run").orderBy("_key", *(then or [])).rowsBetween(Window.unboundedPreceding, 0)
    same = F.col("_run").eqNullSafe(F.col("_of"))
    for c in within:
        same = same & F.col(c).eqNullSafe(F.col(f"_w_{c}"))
    joined = keyed.join(starts, same)
    return joined.select(*rows.columns, *[(F.col(f"_b_{n}") + F.sum(f"_v_{n}").over(inside)).alias(n) for n in values])


def running_distinct(rows: DataFrame, within: list[str], key: Column, item: str, name: str, most: int = RUN_ROWS) -> DataFrame:
    """rows with the number of different values of item up to and with each row, in order of key; null items count as none.

    An item counts where it comes first, so the running sum is over marks of first rows.
    """
    firsts = rows.where(F.col(item).isNotNull()).groupBy(*within, item).agg(F.min(key).alias("_key"))
    marks = firsts.groupBy(*within, "_key").agg(F.count(F.lit(1)).alias("_new")).withColumn("_row", F.lit(False))
    both = rows.withColumns({"_key": key, "_new": F.lit(0).cast("long"), "_row": F.lit(True)}).unionByName(marks, allowMissingColumns=True)
    # Marks go before the rows of their place.
    return running(both, within, F.col("_key"), {name: F.col("_new")}, [F.col("_row")], most).where("_row").select(*rows.columns, name)
