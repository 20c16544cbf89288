"""Running sums and places over a whole table, without a task that orders all of it.

Rows are dealt to ranges of the order, each range is summed, and the sums of
the ranges before it (a row a range) are added to what a range counts itself. Ranged rows are written, so that which
rows fall into which range doesn't change between the jobs that read them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillspan.staging import written


def _ranges(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _free(df: DataFrame, name: str) -> str:
    """name, longer if df has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def running_before(df: DataFrame, order: str, sums: dict[str, str], keys: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """df with a column for each of sums (new name: column): its sum over the rows of the same keys that come earlier in order.

    `order` is distinct within keys (tables of distinct values with their counts). Null keys are a key of their own, null order
    values come first (last if descending); null amounts count as 0. An empty table stays empty. Keys may hold any share of the rows.
    """
    by, of_range = F.col(order).desc() if descending else F.col(order).asc(), _free(df, "range_")
    ranged = written(df.repartitionByRange(_ranges(df), *keys, by).withColumn(of_range, F.spark_partition_id()), "ranges")
    zero = lambda c: F.coalesce(c, F.lit(0))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.select("*", *(zero(F.sum(c).over(earlier(Window.partitionBy(*keys, of_range).orderBy(by)))).alias(out) for out, c in sums.items()))
    totals = ranged.groupBy(*keys, of_range).agg(*(F.sum(c).alias(out) for out, c in sums.items()))
    # One row for each range of a key: as many as ranges and keys together at most.
    ahead = earlier((Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(of_range))
    ahead = totals.select(*keys, of_range, *(zero(F.sum(out).over(ahead)).alias(out) for out in sums)).alias("ahead")
    here = here.alias("here")
    same = F.col(f"here.{of_range}") == F.col(f"ahead.{of_range}")
    for k in keys:
        same &= F.col(f"here.{k}").eqNullSafe(F.col(f"ahead.{k}"))
    shown = [F.col(f"here.{c}") for c in df.columns]
    return here.join(ahead, same).select(*shown, *((F.col(f"here.{out}") + F.col(f"ahead.{out}")).alias(out) for out in sums))


def numbered(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """df with its rows numbered from 1 in order; rows that order can't tell apart are numbered as they come. An empty table stays empty."""
    id_, of_range, n = (_free(df, c) for c in ("place_", "range_", "rows_"))
    ranged = df.repartitionByRange(_ranges(df), *order).sortWithinPartitions(*order)
    # Spark's ids are the partition, shifted, and the place of the row in it.
    placed = written(ranged.withColumn(id_, F.monotonically_increasing_id()), "places").withColumn(of_range, F.shiftright(id_, 33))
    sizes = placed.groupBy(of_range).agg(F.count("*").alias(n))
    ahead = Window.partitionBy(F.lit(0)).orderBy(of_range).rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = sizes.select(of_range, F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(n))
    place = F.col(n) + F.col(id_).bitwiseAND((1 << 33) - 1) + 1
    return placed.join(sizes, of_range).select(*(placed[f"`{c}`"] for c in df.columns), place.alias(out))


def quantiles(df: DataFrame, value: str, levels: list[float], out: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """keys and out, an array of the exact quantiles at levels, between neighbours by straight lines. Nulls don't count; keys without a value have no row.

    The places of the neighbours are looked up among running counts of distinct
    values, so no task holds the values of a key.
    """
    groups = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("rows_"))
    placed = running_before(groups, value, {"before_": "rows_"}, keys)
    total = placed.groupBy(*keys).agg(F.sum("rows_").alias("total_"))
    if keys:
        total = total.alias("whole")
        same = [F.col(f"each.{k}").eqNullSafe(F.col(f"whole.{k}")) for k in keys]
        with_total = placed.alias("each").join(total, same).select("each.*", "total_")
    else:
        with_total = placed.crossJoin(F.broadcast(total))  # one row
    first, last = F.col("before_"), F.col("before_") + F.col("rows_")
    place = lambda q: F.lit(float(q)) * (F.col("total_") - 1)
    at = lambda p: F.max(F.when((first <= p) & (p < last), F.col(value).cast("double")))
    found = with_total.groupBy(*keys).agg(F.max("total_").alias("total_"), *(at(f(place(q))).alias(f"{n}{i}_") for i, q in enumerate(levels) for n, f in (("low", F.floor), ("high", F.ceil))))
    between = lambda i, q: F.col(f"low{i}_") + (F.col(f"high{i}_") - F.col(f"low{i}_")) * (place(q) - F.floor(place(q)))
    return found.select(*keys, F.array(*(between(i, q) for i, q in enumerate(levels))).alias(out))
