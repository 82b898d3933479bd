"""Carrying values forward through very long ordered inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from gridspark.functions.scalars import _col


def previous(df: DataFrame, value, keys: list[str], chunk: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: a struct with the ``value`` of the row before each row within ``keys``, NULL on the first.

    As below, no window spans a key: the first row of a chunk gets the last value of the chunk before.
    """
    marked = df.withColumn("_here", F.struct(_col(value).alias("value")))
    inside = Window.partitionBy(*keys, chunk).orderBy(order)
    local = marked.withColumn(name, F.lag("_here").over(inside))
    ends = marked.groupBy(*keys, chunk).agg(F.max_by("_here", F.col(order)).alias("_end"))
    carried = ends.select(*keys, chunk, F.lag("_end").over(Window.partitionBy(*keys).orderBy(chunk)).alias("_carry"))
    same = [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in (*keys, chunk)]
    joined = local.alias("l").join(carried.alias("r"), same, "left")
    return joined.select(*[F.col(f"l.{c}") for c in df.columns], F.coalesce(f"l.{name}", "r._carry").alias(name))


def carry_forward(df: DataFrame, value, keys: list[str], chunk: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: the latest non-missing ``value`` at or before each row within ``keys``.

    One key may hold most of the rows, so no window spans a key.  Rows are windowed
    inside ``(keys, chunk)``; each chunk's last value (one row per chunk) is carried
    over chunks separately and joined back on the same partitioning.
    """
    marked = df.withColumn(name, _col(value))
    inside = Window.partitionBy(*keys, chunk).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn(name, F.last(name, ignorenulls=True).over(inside))
    latest = F.max_by(name, F.when(F.col(name).isNotNull(), F.col(order)))
    chunks = marked.groupBy(*keys, chunk).agg(latest.alias("_end"))
    earlier = Window.partitionBy(*keys).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.select(*keys, chunk, F.last("_end", ignorenulls=True).over(earlier).alias("_carry"))
    return (
        local.join(carried, [*keys, chunk], "left")
        .withColumn(name, F.coalesce(name, "_carry")).drop("_carry")
    )
