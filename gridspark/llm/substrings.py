r"""Substring dedup: passages that already stand in a document with a smaller id are removed.

A window is ``WINDOW`` consecutive words.  Sketches choose what is worth an index, and where it goes:

1. Each window has an anchor, its least gram hash.  Equal windows have equal anchors, so only
   windows whose anchor occurs in two different texts can repeat (one short row per anchor).
2. Of those, windows whose hash occurs in two documents are candidates; hashes of few bits only
   give more of them.  A piece is the words under neighbouring candidates with one anchor.

An index then decides.  Pieces are dealt to shards by their anchor, so all that can match a piece
lies in its shard.  A shard builds a compressed FM-index of its distinct pieces, each owned by the
least document that holds it, and streams them through it by backward search: the matching
statistics, kept as long as an owner below the query's document is among the matches, give the
stretches of ``WINDOW`` words or more that occur in a smaller document.  Only these are removed.
Equal pieces are searched once for their least holder and once for all others.  A large shard is
searched by several tasks, and one whose index would be too large is indexed in parts, each
asked by all of its queries.

Copies of a whole text are one text, kept where its id is least.  Keys that hold more than a part
in ``HOT`` of the rows of a join - there are no more than ``HOT`` - are joined apart, without a shuffle.

Defined results: a null text has no words.  A document whose id is null neither loses nor takes
words from others; rows with the same id do not take from each other.  Texts shorter than a window stay whole;
very long ones are cut into segments and pieces, and only one text is held at a time.
Further columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from gridspark.llm import fmindex, words as W
from gridspark.llm.common import query, settle, small_batches, table

WINDOW = 50
GRAM = 8  #: words of the grams that anchor windows
SHARD_WORDS, QUERY_WORDS = 1 << 19, 1 << 22  #: aims for the words indexed by a shard, and searched by a task
PIECE = 256  #: a longer run of windows is cut into pieces that share a window less a word
HOT = 1024

_ANCHORS = "anchor long, node binary, low int, high int"
_WINDOWS = "h long, anchor long, doc_id long, node binary, start int"
_PARTS = "anchor long, doc_id long, node binary, low int, text binary, n long"


def _least_grams(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """The least gram hash of each window of words."""
    width = window - gram + 1
    least, reach = W.window_hashes(hashes, gram), 1
    while reach * 2 <= width:
        least, reach = np.minimum(least[:-reach], least[reach:]), reach * 2
    if reach < width and len(least) > width - reach:
        least = np.minimum(least[: reach - width], least[width - reach :])
    return least


def _anchors(window: int, gram: int):
    """Stretches of window starts with the same anchor: one row each."""

    def run(batches):
        for batch in batches:
            for w in W.blocks(batch.column(1)):
                least = _least_grams(W.word_hashes(w), window, gram)
                n = max(len(w.start) - window + 1, 0)
                at = np.flatnonzero(W.inside(w.first, window, n))
                if not len(at):
                    continue
                doc, value = w.doc()[at], least[at]
                head = np.flatnonzero(np.concatenate([[True], (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])]))
                own, from_ = doc[head], at[head] - w.first[doc[head]]
                to = np.append(at[head[1:] - 1], at[-1]) - w.first[own]
                yield pa.record_batch([pa.array(value[head].view(np.int64)), batch.column(0).take(pa.array(own + w.low)), pa.array(from_.astype(np.int32)), pa.array(to.astype(np.int32))], names=["anchor", "node", "low", "high"])

    return run


def _merged(ranges: list, reach: int) -> list[tuple[int, int]]:
    """Ranges ``(low, high)``, both included, joined where the next begins at ``reach`` or less above."""
    out: list[list[int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1] + reach:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [tuple(x) for x in out]


def _text(w: W.Words, low: int, high: int) -> bytes:
    return bytes(w.data[w.start[low] : w.end[high - 1]])


def _segments(window: int):
    """The words under ranges of window starts, as segments of text."""

    def run(batches):
        for batch in batches:
            ranges = batch.column(3).to_pylist()
            for w in W.blocks(batch.column(2)):
                rows = []
                for d in range(w.low, w.high):
                    base = int(w.first[d - w.low])
                    for low, high in _merged([(r["low"], r["high"]) for r in ranges[d]], 1):
                        rows.append((d, low, _text(w, base + low, base + high + window), high))
                at = pa.array([r[0] for r in rows], pa.int64())
                yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary()).cast(pa.string()), pa.array([r[3] for r in rows], pa.int32())], names=["node", "doc_id", "low", "text", "last"])

    return run


def _windows(window: int, gram: int, bits: int):
    def run(batches):
        for batch in batches:
            low = batch.column(2).to_numpy(zero_copy_only=False)
            for w in W.blocks(batch.column(3)):
                h = W.word_hashes(w)
                one, least = W.window_hashes(h, window) >> np.uint64(64 - bits), _least_grams(h, window, gram)
                at = np.flatnonzero(W.inside(w.first, window, len(one)))
                own = w.doc()[at]
                start = at - w.first[own] + low[own + w.low]
                rows = pa.array(own + w.low)
                yield pa.record_batch([pa.array(one[at].view(np.int64)), pa.array(least[at].view(np.int64)), batch.column(1).take(rows), batch.column(0).take(rows), pa.array(start.astype(np.int32))], names=["h", "anchor", "doc_id", "node", "start"])

    return run


def _pieces(window: int):
    """The text of each run of candidate windows, long runs in pieces."""
    names = ["anchor", "doc_id", "node", "low", "text", "n"]

    def run(batches):
        for batch in batches:
            node, doc_id, base, runs = (batch.column(k).to_pylist() for k in (0, 1, 2, 4))
            for w in W.blocks(batch.column(3)):
                out = []
                for d in range(w.low, w.high):
                    first = int(w.first[d - w.low]) - base[d]
                    for r in runs[d]:
                        stop, step = r["high"] + window, PIECE - window + 1
                        for low in range(r["low"], stop - window + 1, step):
                            high = min(low + step + window - 1, stop)
                            out.append((r["anchor"], doc_id[d], node[d], low, _text(w, first + low, first + high), high - low))
                yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in enumerate([pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64()])], names=names)

    return run


def _matched(window: int):
    """Search a shard's queries in the index of its sources, each for owners below its limit."""

    def run(queries: pa.Table, sources: pa.Table) -> pa.Table:
        if not queries.num_rows or not sources.num_rows:
            return pa.table({"key": pa.array([], pa.binary()), "later": pa.array([], pa.bool_()), "low": pa.array([], pa.int32()), "high": pa.array([], pa.int32())})
        texts = lambda t: t.column("text").combine_chunks().cast(pa.string())
        index, vocabulary = fmindex.index_of(texts(sources), sources.column("owner").to_numpy())
        q, low, high = fmindex.search(index, vocabulary, texts(queries), window, queries.column("limit").to_numpy())
        at = pa.array(q)
        return pa.table({"key": queries.column("key").combine_chunks().take(at), "later": queries.column("later").combine_chunks().take(at), "low": pa.array(low.astype(np.int32)), "high": pa.array(high.astype(np.int32))})

    return run


def _kept(window: int):
    """Words removed, and the hash of those kept."""
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept"]

    def run(batches):
        for batch in batches:
            copy, ranges = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for w in W.blocks(batch.column(1)):
                n = w.count()
                removed, digest, kept = [], [], []
                for d in range(w.low, w.high):
                    own, first = int(n[d - w.low]), int(w.first[d - w.low])
                    if copy[d]:
                        gone = [(0, own)] if own >= window else []
                    else:
                        gone = _merged([(r["low"], r["high"]) for r in ranges[d] or []], 0)
                    stay, at = [], 0
                    for low, high in [*gone, (own, own)]:
                        if low > at:
                            stay.append(_text(w, first + at, first + low))
                        at = high
                    text = b" ".join(b" ".join(x.split()) for x in stay)  # bytes split at the same six blanks
                    removed.append(sum(high - low for low, high in gone))
                    digest.append(hashlib.sha256(text).hexdigest())
                    kept.append(text)
                yield pa.record_batch([batch.column(0).slice(w.low, w.high - w.low), pa.array(n), pa.array(removed, pa.int64()), pa.array(digest), pa.array(kept, pa.binary()).cast(pa.string())], names=names)

    return run


def _shards(distinct: DataFrame, window: int) -> DataFrame:
    """``key, later, low, high``: matching stretches of each distinct piece, for its least holder and for later ones."""
    words = distinct.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-words // SHARD_WORDS))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("anchor"), F.lit(shards)).cast("int"))
    ways = dealt.groupBy("shard").agg(F.ceil(F.sum("n") / (2 * SHARD_WORDS)).cast("int").alias("parts"), F.ceil(F.sum("n") * 2 / QUERY_WORDS).cast("int").alias("copies"))
    ways = settle(ways, "substring-shards")
    limits = F.array(F.struct(F.lit(False).alias("later"), F.col("least").alias("limit")), F.when(F.col("most") > F.col("least"), F.struct(F.lit(True).alias("later"), (F.col("least") + 1).alias("limit"))))
    asked = dealt.join(ways, "shard").withColumn("ask", F.explode(F.filter(limits, lambda x: x.isNotNull())))
    part, copy = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), F.explode(F.sequence(F.lit(0), F.col("copies") - 1))
    left = asked.select("shard", part.alias("part"), F.pmod(F.xxhash64("key"), F.col("copies").cast("long")).cast("int").alias("copy"), "key", "text", "ask.later", "ask.limit")
    own = F.pmod(F.xxhash64("key", F.lit(1)), F.col("parts").cast("long")).cast("int")
    right = dealt.join(ways, "shard").select((F.col("shard") + 0).alias("shard"), own.alias("part"), copy.alias("copy"), F.concat("text").alias("text"), F.col("least").alias("owner"))
    both = left.groupBy("shard", "part", "copy").cogroup(right.groupBy("shard", "part", "copy"))
    return both.applyInArrow(_matched(window), "key binary, later boolean, low int, high int")


def _joined(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """``left`` with the one row of ``right`` (``key, n, ...``) for its key; ``n`` rows of ``left`` have it.

    Keys of more than a part in ``HOT`` of all rows are written apart: at most ``HOT`` rows, which join without a shuffle.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    large = F.col("n") * HOT > total
    hot = settle(right.where(large).drop("n"), "substring-hot")
    if hot.limit(1).count() == 0:
        return left.join(right.drop("n"), key)
    rest = left.join(hot.select(key), key, "left_anti").join(right.where(~large).drop("n"), key)
    return left.join(hot, key).unionByName(rest)


def repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bits: int = 64, id_col="doc_id", text_col="text") -> DataFrame:
    """Per row ``doc_id, n_words, n_removed, kept_sha256, kept``.

    ``bits`` of a window's hash make it a candidate; the index decides whatever their number.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    nodes = settle(rows.where("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "substring-nodes")
    anchors = settle(rows.where("doc_id is not null").select("node", "text").mapInArrow(_anchors(window, gram), _ANCHORS), "substring-anchors")
    short = F.xxhash64("node")
    shared = settle(anchors.groupBy("anchor").agg(F.min(short).alias("a"), F.max(short).alias("b")).where("a <> b").select("anchor"), "substring-shared")
    ranges = anchors.join(shared, "anchor", "left_semi").groupBy("node").agg(F.collect_set(F.struct("low", "high")).alias("ranges"))
    ranges = settle(ranges.join(nodes, "node").select("node", "least", "ranges"), "substring-ranges")
    least = rows.join(ranges, (rows["node"] == ranges["node"]) & (rows["doc_id"] == ranges["least"])).select(rows["node"], "doc_id", "text", "ranges")
    segments = settle(least.mapInArrow(_segments(window), "node binary, doc_id long, low int, text string, last int").dropDuplicates(["node", "low"]), "substring-segments")
    windows = settle(segments.mapInArrow(_windows(window, gram, bits), _WINDOWS), "substring-windows")
    twice = windows.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("h", "n")
    found = _joined(windows, settle(twice, "substring-twice"), "h").select("node", "anchor", "start")
    along = Window.partitionBy("node", "anchor").orderBy("start")
    steps = found.withColumn("step", F.when(F.col("start") - F.lag("start").over(along) == 1, 0).otherwise(1))
    runs = steps.withColumn("run", F.sum("step").over(along.rowsBetween(Window.unboundedPreceding, 0))).groupBy("node", "anchor", "run").agg(F.min("start").alias("low"), F.max("start").alias("high"))
    runs = settle(runs.groupBy("node").agg(F.collect_list(F.struct("anchor", "low", "high")).alias("all")), "substring-runs")
    own = F.filter("all", lambda r: (r["low"] >= F.col("low")) & (r["low"] <= F.col("last")))
    held = segments.join(runs, "node").select("node", "doc_id", "low", "text", own.alias("runs")).where(F.size("runs") > 0)
    parts = settle(held.mapInArrow(_pieces(window), _PARTS).withColumn("key", F.unhex(F.md5("text"))), "substring-parts")
    distinct = parts.groupBy("key").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("n_rows"), F.first("anchor").alias("anchor"), F.first("text").alias("text"), F.first("n").alias("n"))
    distinct = settle(distinct, "substring-distinct")
    matched = settle(_shards(distinct, window), "substring-matched")
    span = F.struct("low", "high")
    told = matched.groupBy("key").agg(F.collect_list(F.when(~F.col("later"), span)).alias("first"), F.collect_list(F.when(F.col("later"), span)).alias("later"))  # few: a piece is short
    told = settle(distinct.select("key", F.col("least").alias("holder"), F.col("n_rows").alias("n")).join(told, "key"), "substring-told")
    asked = _joined(parts.select("key", "doc_id", "node", F.col("low").alias("base")), told, "key")
    gone = asked.select("node", "base", F.explode(F.when(F.col("doc_id") == F.col("holder"), F.col("first")).otherwise(F.col("later"))).alias("r"))
    gone = gone.select("node", F.struct((F.col("base") + F.col("r.low")).alias("low"), (F.col("base") + F.col("r.high")).alias("high")).alias("range"))
    gone = gone.groupBy("node").agg(F.collect_set("range").alias("gone"))
    marked = settle(nodes.join(gone, "node", "left").where("n > 1 or gone is not null").select("node", "least", "gone"), "substring-marked")
    ready = rows.join(marked, "node", "left").select("doc_id", "text", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False)).alias("copy"), F.when(F.col("doc_id") == F.col("least"), F.col("gone")).alias("gone"))
    return ready.mapInArrow(_kept(window), "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string")


@query(
    "op4_fm_substring_dedup",
    """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
    w AS (SELECT doc_id, s, sha256(array_to_string(ws[s : s + 49], ' ')) AS h FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS s FROM d)),
    gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(generate_series(s, s + 49)) AS p FROM (SELECT doc_id, s, min(doc_id) OVER (PARTITION BY h) AS low FROM w) WHERE low < doc_id) GROUP BY doc_id),
    k AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id)),
    kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS kept FROM (SELECT doc_id, unnest(ws) AS word, unnest(generate_series(1, len(ws))) AS i FROM k) x WHERE NOT EXISTS (SELECT 1 FROM (SELECT doc_id, unnest(ps) AS i FROM k) y WHERE y.doc_id = x.doc_id AND y.i = x.i) GROUP BY doc_id)
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ps) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM k LEFT JOIN kept USING (doc_id)""",
)
def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents")).drop("kept")
