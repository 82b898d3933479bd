r"""Pattern matches with code-point positions, in DataFrame expressions only.

``split`` gives the text between the matches that ``regexp_extract_all`` gives, so running sums
of their lengths are the positions, and the text between serves as context.  Sums run over
blocks of matches, so texts with very many matches cost no quadratic time.  Patterns must not
match empty strings and should be possessive, so that long runs need neither stack nor retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

BLOCK = 256
LEFT, RIGHT = 40, 12  #: code points of context kept on either side, up to the next match of the kind


def matches(text: Column, pattern: str, needs: str | None = None) -> Column:
    """All matches; ``needs`` is a literal without which there are none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return found if needs is None else F.when(F.contains(text, F.lit(needs)), found).otherwise(F.array().cast("array<string>"))


def pieces(text: Column, pattern: str, found: Column) -> Column:
    """Per match ``gap, len, value, left, right``; ``found`` are the matches of ``pattern``."""
    gaps = F.split(text, pattern, -1)
    joined = F.zip_with(
        F.zip_with(F.slice(gaps, F.lit(1), F.size(found)), F.slice(gaps, F.lit(2), F.size(found)), lambda a, b: F.struct(F.char_length(a).alias("gap"), F.right(a, F.lit(LEFT)).alias("left"), F.left(b, F.lit(RIGHT)).alias("right"))),
        found,
        lambda g, m: F.struct(g["gap"].alias("gap"), F.char_length(m).alias("len"), m.alias("value"), g["left"].alias("left"), g["right"].alias("right")),
    )
    return F.when(F.size(found) > 0, joined).otherwise(F.array().cast("array<struct<gap:int,len:int,value:string,left:string,right:string>>"))


def _block(own: Column, b: Column) -> Column:
    return F.slice(own, b * BLOCK + 1, F.lit(BLOCK))


def offsets(own: Column) -> Column:
    """Position at which each block of pieces begins."""
    totals = F.transform(F.sequence(F.lit(0), F.floor(F.size(own) / BLOCK).cast("int")), lambda b: F.aggregate(_block(own, b), F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
    return F.aggregate(totals, F.array(F.lit(0)), lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x)))


def placed(own: Column, starts: Column) -> Column:
    """Per match ``start, end, value, left, right``; ``own`` and ``starts`` are columns of pieces and offsets."""

    def block(x: Column, b: Column) -> Column:
        empty = F.array().cast("array<struct<start:int,end:int,value:string,left:string,right:string>>")

        def step(acc, m):
            start = acc["pos"] + m["gap"]
            one = F.struct(start.alias("start"), (start + m["len"]).alias("end"), m["value"].alias("value"), m["left"].alias("left"), m["right"].alias("right"))
            return F.struct((start + m["len"]).alias("pos"), F.concat(acc["out"], F.array(one)).alias("out"))

        return F.aggregate(_block(own, b), F.struct(x.alias("pos"), empty.alias("out")), step, lambda acc: acc["out"])

    return F.flatten(F.transform(starts, block))


def joined(spans: Column, kinds: list[str]) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined; spans are ``start, kind, end, …``."""
    names = F.array(*[F.lit(k) for k in kinds])
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.concat_ws(",", F.transform(order, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def apart(found: DataFrame) -> DataFrame:
    """``row, added``: the spans in ``more`` that overlap neither a base span nor an earlier one in ``more``.

    ``found`` has ``row, base, more``.  Spans are compared with running extremes in order of place,
    so texts with very many spans cost no quadratic time; rows without ``more`` are not shuffled.
    """
    one = lambda is_base: lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"), F.lit(is_base).alias("is_base"))
    each = found.where(F.size("more") > 0).select("row", F.explode(F.concat(F.transform("base", one(True)), F.transform("more", one(False)))).alias("s")).select("row", "s.*")
    order = ["start", "end", "kind"]
    onward = Window.partitionBy("row").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    backward = Window.partitionBy("row").orderBy(*[F.desc(c) for c in order]).rowsBetween(Window.unboundedPreceding, -1)
    before, after = F.max(F.when(F.col("is_base"), F.col("end"))).over(onward), F.min(F.when(F.col("is_base"), F.col("start"))).over(backward)
    free = each.withColumns({"before": before, "after": after}).where("not is_base and coalesce(before <= start, true) and coalesce(after >= end, true)")
    first = free.withColumn("before", F.max("end").over(onward)).where("coalesce(before <= start, true)")
    return first.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def count_of(spans: str, kind: int) -> Column:
    return F.size(F.filter(spans, lambda c: c["kind"] == kind)).cast("long")


def sha256(text: Column) -> Column:
    return F.sha2(text, 256)
