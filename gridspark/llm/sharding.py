"""Sharding: longest-processing-time scheduling of groups that stay together.

Rows of equal text form a group.  Groups, largest first, go to the least loaded shard through
a heap.  So that the schedule stays small at any size, groups that hold less than one part in
``BUNDLES`` of the rows and bytes are first bundled by a hash of their key; the heap sees the
larger groups one by one and the bundles as wholes - at most ``3 * BUNDLES`` items, whatever
the input.  Slots count through each shard without a window over a shard: an item is cut into
cells of about one part in ``BUNDLES`` of the rows, whose sizes give every cell its first slot.

Defined results: a null text counts as empty (size 1) and shares its group with empty texts.
Repeated rows each get a slot of their own; null ids come first in their cell.  Further
columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridspark.llm.common import query, settle, table

SHARDS, BUNDLES = 16, 4096


def schedule(items: list[tuple[int, str]], shards: int) -> dict[str, int]:
    """Shard of each (size, name): largest first (ties by name), to the least loaded (ties by number)."""
    load = [(0, s) for s in range(shards)]
    out = {}
    for size, name in sorted(items, key=lambda x: (-x[0], x[1])):
        least, s = load[0]
        heapq.heapreplace(load, (least + size, s))
        out[name] = s
    return out


def assign(docs: DataFrame, shards: int = SHARDS, bundles: int = BUNDLES, id_col="doc_id", text_col="text", with_columns: bool = False) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``with_columns`` keeps the rows' own columns before these; own columns of these names give way, but for the id.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    measured = [F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.md5(text).alias("key")]
    rows = settle(docs.select(*measured), "shard-rows")
    whole_rows = docs.select(*measured, F.struct(*docs.columns).alias("row")) if with_columns else rows
    whole = rows.agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).first()
    n, size = whole["n"], whole["bytes"] or 0
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    large = settle(
        groups.where((F.col("n") * bundles > n) | (F.col("bytes") * bundles > size)).select("key", F.ceil(F.col("n") * bundles / F.lit(max(n, 1))).cast("int").alias("subs")),
        "shard-large",
    )

    def in_cells(given):
        own = ["row"] if "row" in given.columns else []
        return given.join(large, "key", "left").select(
            "doc_id", "size", "text_crc32", "key", *own,
            F.when(F.col("subs").isNull(), F.concat(F.lit("b"), F.pmod(F.xxhash64("key"), F.lit(bundles)).cast("string"))).otherwise(F.col("key")).alias("item"),
            F.when(F.col("subs").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id"), F.col("subs").cast("long"))).cast("int").alias("sub"),
        )

    cells = in_cells(rows).groupBy("item", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")).collect()  # bounded by `bundles`
    weight: dict[str, int] = {}
    for c in cells:
        weight[c["item"]] = weight.get(c["item"], 0) + c["bytes"]
    shard = schedule([(w, item) for item, w in weight.items()], shards)
    filled, where = [0] * shards, []
    for c in sorted(cells, key=lambda c: (c["item"], c["sub"])):
        s = shard[c["item"]]
        where.append((c["item"], c["sub"], s, filled[s]))
        filled[s] += c["n"]
    where = settle(spark.createDataFrame(where, "item string, sub int, shard int, base long"), "shard-cells")
    place = Window.partitionBy("item", "sub").orderBy("doc_id", "key")
    found = in_cells(whole_rows).withColumn("nth", F.row_number().over(place)).join(where, ["item", "sub"])
    told = {"doc_id": F.col("doc_id"), "size": F.col("size"), "text_crc32": F.col("text_crc32"), "law": F.lit("bytes"), "shard": F.col("shard"), "slot": F.col("base") + F.col("nth") - 1, "grown_shard": F.lit(None).cast("int")}
    own = [c for c in docs.columns if c not in told] if with_columns else []
    return found.select(*[F.col("row")[c].alias(c) for c in own], *[c.alias(n) for n, c in told.items()])


@query("op5_lpt_sharding")
def sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
