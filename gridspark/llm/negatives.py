"""Hard-negative mining: exact top inner products by length buckets and sorted coordinate lists.

Vectors are written longest first and cut into stripes (``common.ordered``); within a stripe,
runs of ``BUCKET_ROWS`` rows of similar length are the buckets.  A bucket keeps, for each
coordinate, its directions' values in sorted order.  An anchor that asks for scores of at least
``t`` needs a cosine of ``t / (|anchor| * longest)`` in a bucket: above 1 the bucket is passed
over, else each of the anchor's largest coordinates leaves only a range of values, found by
bisection in its list, and rows that lie in all ranges are verified by their integer products.
The wanted score rises as a bucket's best rows are known, and goes along to the next bucket.

Anchors are a stated set of queries against all rows: blocks of ``BLOCK_ANCHORS`` anchors meet
stripes of ``STRIPE_ROWS`` rows, one task's memory holds one of each.  First each anchor gets its
best rows of the same label; then, per anchor and positive, the best rows of other labels whose
scores lie in the window.  Blocks that no row of a stripe can satisfy, by length, do not meet it.

Defined results: rows with a null label, a null vector or a component that is null or not
finite take no part.  Vectors of fewer components count as padded with zeros, an empty one
scores 0.  Rows are told apart also where ids repeat: a second row of the same id and label is
a positive like others.  Null ids are no anchors and come first among ties; ties beyond equal
ids go by the written order.  Components saturate at 32 bits; scores are exact up to 64 bits
and saturate there.  Further columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from gridspark.llm.common import ordered, query, settle, table

STRIPE_ROWS, BUCKET_ROWS, BLOCK_ANCHORS = 1 << 15, 1 << 12, 1 << 10
FOCUS = 4  #: coordinates of an anchor whose lists are cut
PROBES = 32  #: rows nearest in the first focus coordinate whose scores start the wanted score
EVERY, POSITIVES, NEGATIVES = 100, 5, 10
LOW_PERCENT, HIGH_PERCENT = 30, 90
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def usable(rows: DataFrame, id_col="vec_id", label_col="label", vector_col="embedding", scale: int = 256) -> DataFrame:
    """``vec_id, label, q``: integer vectors of the rows that take part."""
    x = F.col(vector_col)
    finite = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) != float("inf"))
    fits = lambda v: F.greatest(F.least(F.floor(v.cast("double") * scale), F.lit((1 << 31) - 1)), F.lit(-(1 << 31))).cast("int")
    given = rows.where(F.col(label_col).isNotNull() & x.isNotNull()).where(F.forall(x, finite))
    return given.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.transform(x, fits).alias("q"))


class Rows(NamedTuple):
    """Part of the written vectors in numpy."""

    ord: np.ndarray
    vec_id: np.ndarray  #: null ids as the least integer
    label: np.ndarray
    q: np.ndarray


def _both(*parts: pa.Table) -> list[Rows]:
    """Tables in their written order, their vectors of one width."""
    parts = [part.sort_by("ord").combine_chunks() for part in parts]
    lists = [pa.concat_arrays(part["q"].chunks) if part["q"].num_chunks else pa.array([], pa.list_(pa.int32())) for part in parts]
    sizes = [np.asarray(x.value_lengths()) for x in lists]
    width = max(int(size.max(initial=0)) for size in sizes)
    out = []
    for part, x, size in zip(parts, lists, sizes):
        flat = np.asarray(x.flatten())
        q = np.zeros((len(size), width), dtype=np.int64)
        q[np.repeat(np.arange(len(size)), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        out.append(Rows(np.asarray(part["ord"]), part["vec_id"].fill_null(_LEAST).to_numpy(), np.asarray(part["label"]), q))
    return out


class Bucket:
    """Rows of similar length with a sorted list per coordinate of their directions."""

    def __init__(self, rows: Rows, kind):
        self.rows, self.vectors = rows, rows.q.astype(kind)
        length = np.sqrt((rows.q.astype(np.float64) ** 2).sum(axis=1))
        self.longest = length.max(initial=0.0)
        direction = (rows.q / np.where(length > 0, length, 1)[:, None]).astype(np.float32)
        order = np.argsort(direction, axis=0, kind="stable")
        self.order = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(direction, order, axis=0).T)

    def scores(self, at, anchor: np.ndarray) -> np.ndarray:
        return self.vectors[at] @ anchor

    def feasible(self, direction: np.ndarray, length: float, focus: np.ndarray, wanted: float) -> np.ndarray | slice:
        """Rows that may score ``wanted``, by their values in the focus coordinates."""
        if wanted <= 0:
            return slice(None)  # rows of any direction may
        reach = length * self.longest
        if wanted > reach * (1 + 1e-9):
            return np.zeros(0, dtype=np.int64)
        cosine = min(wanted / reach, 1.0)
        spread = np.sqrt((1 - cosine**2) * (1 - np.minimum(direction[focus] ** 2, 1)))
        low = np.where(-direction[focus] >= cosine, -1, direction[focus] * cosine - spread) - 1e-4  # beyond any rounding of the directions
        high = np.where(direction[focus] >= cosine, 1, direction[focus] * cosine + spread) + 1e-4
        ranges = [(np.searchsorted(self.values[f], a), np.searchsorted(self.values[f], b, side="right"), f) for f, a, b in zip(focus, low.astype(np.float32), high.astype(np.float32))]
        n = len(self.rows.ord)
        ranges = sorted((b - a, a, b, f) for a, b, f in ranges if b - a < n)  # a list that is whole leaves all
        if not ranges:
            return slice(None)
        hits = np.zeros(n, dtype=np.int8)
        for _, a, b, f in ranges:
            hits[self.order[f][a:b]] += 1
        return np.flatnonzero(hits == len(ranges))

    def near(self, direction: np.ndarray, focus: np.ndarray) -> np.ndarray:
        """A few rows that are likely to score high."""
        f = focus[0]
        at = np.searchsorted(self.values[f], direction[f])
        low = max(0, min(at - PROBES // 2, len(self.rows.ord) - PROBES))
        return self.order[f][low : low + PROBES]


def _exact_kind(*vectors: np.ndarray):
    """The cheapest number type in which every inner product is exact."""
    bound = max((int(np.abs(v).max(initial=0)) for v in vectors), default=0) ** 2 * max((v.shape[1] for v in vectors), default=1)
    return np.float32 if bound < 1 << 24 else np.float64 if bound < 1 << 53 else np.int64 if bound <= _MOST else object


def _long(scores: np.ndarray) -> np.ndarray:
    if scores.dtype == object:
        scores = np.array([min(max(int(s), _LEAST), _MOST) for s in scores], dtype=np.int64)
    return scores.astype(np.int64)


class Best:
    """The ``k`` best rows so far of one question: score in [low, high]; ties by id, then by order."""

    def __init__(self, k: int, low: int, high: int):
        self.k, self.low, self.high = k, low, high
        self.score, self.vec_id, self.ord = (np.zeros(0, np.int64) for _ in range(3))

    def wanted(self) -> int:
        return self.low if len(self.score) < self.k else max(self.low, int(self.score[-1]))

    def add(self, score, vec_id, ord_) -> None:
        at = np.flatnonzero((score >= self.wanted()) & (score <= self.high))
        if len(at) > 4 * self.k:
            least = np.partition(score[at], len(at) - self.k)[len(at) - self.k]
            at = at[score[at] >= least]
        if len(at):
            score, vec_id, ord_ = (np.concatenate(x) for x in ((self.score, score[at]), (self.vec_id, vec_id[at]), (self.ord, ord_[at])))
            first = np.lexsort((ord_, vec_id, -score))[: self.k]
            self.score, self.vec_id, self.ord = score[first], vec_id[first], ord_[first]


def answered(anchor: np.ndarray, buckets: list[Bucket], asked: list[Best], allowed) -> None:
    """Fills each question of ``asked`` from the buckets, longest first; ``allowed(bucket)`` masks rows."""
    exact = anchor.astype(np.float64)
    length = float(np.sqrt((exact**2).sum()))
    direction = exact / (length or 1)
    focus = np.argsort(-np.abs(direction), kind="stable")[:FOCUS]
    for bucket in buckets:
        own = anchor.astype(bucket.vectors.dtype)
        mask = allowed(bucket)
        if len(focus) and any(len(b.score) < b.k for b in asked):
            near = bucket.near(direction, focus)
            near = near[mask[near]]
            known = _long(bucket.scores(near, own))
            floor = []
            for b in asked:  # a score that k rows reach needs no worse row
                fit = np.sort(known[(known >= b.low) & (known <= b.high)])
                floor.append(max(b.wanted(), int(fit[-b.k])) if len(fit) >= b.k else b.wanted())
        else:
            floor = [b.wanted() for b in asked]
        at = bucket.feasible(direction, length, focus, float(min(floor)))
        score = _long(bucket.scores(at, own))
        keep = mask[at]
        score, vec_id, ord_ = score[keep], bucket.rows.vec_id[at][keep], bucket.rows.ord[at][keep]
        for b, low in zip(asked, floor):
            fit = score >= low
            b.add(score[fit], vec_id[fit], ord_[fit])


def _buckets(rows: Rows, kind, size: int) -> list[Bucket]:
    return [Bucket(Rows(*(x[a : a + size] for x in rows)), kind) for a in range(0, len(rows.ord), size)]


_FOUND = "anchor long, positive long, ord long, vec_id long, score long"


def _found(rows: list[tuple]) -> pa.Table:
    columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in zip(*rows)] or [np.zeros(0, np.int64)] * 5
    columns = [pa.array(c) for c in columns]
    columns[3] = pa.array(np.asarray(columns[3]), mask=np.asarray(columns[3]) == _LEAST)
    return pa.table(columns, names=["anchor", "positive", "ord", "vec_id", "score"])


def _positives(bucket_rows: int, k: int):
    def run(part: pa.Table, anchors: pa.Table) -> pa.Table:
        (asked, rows), out = _both(anchors, part), []
        kind = _exact_kind(asked.q, rows.q)
        for label in np.unique(asked.label):
            buckets = _buckets(Rows(*(x[rows.label == label] for x in rows)), kind, bucket_rows)
            for i in np.flatnonzero(asked.label == label):
                best = Best(k, _LEAST, _MOST)
                answered(asked.q[i], buckets, [best], lambda b, i=i: b.rows.ord != asked.ord[i])
                n = len(best.ord)
                out.append((np.full(n, asked.ord[i]), np.full(n, -1), best.ord, best.vec_id, best.score))
        return _found(out)

    return run


def _negatives(bucket_rows: int, k: int, low: int, high: int):
    def run(part: pa.Table, anchors: pa.Table) -> pa.Table:
        (asked, rows), out = _both(anchors, part), []
        buckets = _buckets(rows, _exact_kind(asked.q, rows.q), bucket_rows)
        for i, positives in enumerate(anchors.sort_by("ord")["positives"].to_pylist()):
            windows = [(p["ord"], -(-low * p["score"] // 100), high * p["score"] // 100) for p in positives]
            windows = [(p, Best(k, a, b)) for p, a, b in windows if a <= b]
            if windows:
                answered(asked.q[i], buckets, [b for _, b in windows], lambda b, i=i: b.rows.label != asked.label[i])
            for p, best in windows:
                n = len(best.ord)
                out.append((np.full(n, asked.ord[i]), np.full(n, p), best.ord, best.vec_id, best.score))
        return _found(out)

    return run


def mine(
    rows: DataFrame,
    anchor: Column,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    low_percent: int = LOW_PERCENT,
    high_percent: int = HIGH_PERCENT,
    stripe_rows: int = STRIPE_ROWS,
    bucket_rows: int = BUCKET_ROWS,
    block_anchors: int = BLOCK_ANCHORS,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` for the rows of ``usable`` where ``anchor`` holds."""
    square = F.aggregate("q", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    rows = ordered(rows.withColumn("square", square), [F.desc("square"), F.col("vec_id")], stripe_rows, "vectors")
    chosen = rows.where(anchor)
    blocks = max(1, -(-chosen.count() // block_anchors))
    block = F.pmod(F.xxhash64("ord"), F.lit(blocks)).cast("int")
    chosen = settle(chosen.select("ord", "vec_id", "label", "q", "square", block.alias("block")), "anchors")
    stripes = settle(rows.groupBy("chunk").agg(F.max("square").alias("longest")), "stripes")

    every = stripes.select("chunk", "longest", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    columns = ["ord", "vec_id", "label", "q"]

    def met(asked: DataFrame, pairs: DataFrame, answer) -> DataFrame:
        """Every stripe with every block that it is paired with; blocks and stripes are bounded."""
        left = rows.select("chunk", *columns).join(pairs, "chunk").groupBy("chunk", "block")
        right = asked.join(pairs, "block").groupBy("chunk", "block")
        return left.cogroup(right).applyInArrow(answer, _FOUND)

    order = [F.desc("score"), F.col("vec_id").asc_nulls_first(), F.col("ord")]
    first = met(chosen.select("block", *columns), every.select("chunk", "block"), _positives(bucket_rows, positives))
    best = Window.partitionBy("anchor").orderBy(*order)
    first = first.withColumn("n", F.row_number().over(best)).where(F.col("n") <= positives)
    first = settle(first.select("anchor", "ord", "vec_id", "score"), "positives")

    by_anchor = first.groupBy("anchor").agg(F.collect_list(F.struct("ord", "score")).alias("positives"), F.min("score").alias("least"))  # `positives` at most
    asked = settle(chosen.join(by_anchor, chosen["ord"] == by_anchor["anchor"]).drop("anchor"), "asked")
    # a stripe whose longest row times the block's longest anchor stays below every window has nothing for the block
    need = F.when(F.col("least") <= 0, 0.0).otherwise(F.col("least") * (low_percent / 100) / F.sqrt("square"))  # a score above 0 has a length
    needs = asked.groupBy("block").agg(F.min(need).alias("need"))
    pairs = every.join(needs, "block").where(F.sqrt("longest") * (1 + 1e-9) >= F.col("need")).select("chunk", "block")
    found = met(asked.select("block", *columns, "positives"), settle(pairs, "stripe-pairs"), _negatives(bucket_rows, negatives, low_percent, high_percent))
    best = Window.partitionBy("anchor", "positive").orderBy(*order)
    found = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)

    named = chosen.select(F.col("ord").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    told = first.select("anchor", F.col("ord").alias("positive"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = found.select("anchor", "positive", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(told, ["anchor", "positive"]).join(named, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


_SQL = """
WITH given AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [floor(256 * CAST(x AS DOUBLE)) for x in embedding] AS q
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM given a JOIN given b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
positives AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
negatives AS (
  SELECT p.anchor_id, p.positive_id, s.other AS negative_id, p.positive_score, s.score AS negative_score,
         CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) AS INTEGER) AS rank
  FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
   AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 10
"""


def relabelled(rows: DataFrame) -> DataFrame:
    """The given test's wrong labels: rows of every seventh id move to the next label."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


@query("op12_lemp_hard_negatives", _SQL)
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(relabelled(usable(table(spark, sf_dir, "embeddings"))), F.col("vec_id") % EVERY == 0)
