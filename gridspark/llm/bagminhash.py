r"""Near duplicates by BagMinHash over multisets of word shingles.

Weights (here: how often a document has a shingle, in units of ``unit``) are discretised to whole
units and the weight axis is laid out in dyadic layers 0-1, 1-2, 2-4, 4-8, ….  Each (shingle, layer) has its own
Poisson process, the same in every document: points come in order of time, each with a
component of the signature and a place in the layer.  A document takes the points below its
weight, and each component keeps its earliest time, so two documents agree in a component with a
probability of exactly their weighted Jaccard similarity.  Heavy weights cost a process per
layer, not per unit, and a time limit per document ends the processes early (it is doubled where
a component is still empty).

Signatures are cut into bands.  Equal texts are collapsed first.  In each bucket every
text is verified by exact multiset overlap against the bucket's most central one (the one that meets most texts over
all bands, as an original among its copies does); verified links give components.  A text can
only be linked to another component if its share of shingles that occur in other components
reaches the threshold, so texts that merely have a passage in common leave here, each on its own.  The
others are verified in a few rounds, each against one text of the largest other component of
each of their buckets, which joins most of them at a linear cost.  At last, the buckets that still hold
several components are checked whole across components - never within them - where lengths, supports,
the triangle inequality of the Jaccard distance over the central text and a long signature of one bit per
component allow a link (a link fails the last with a probability of 3e-6, as it fails to share a bucket).  So no
bucket emits all its pairs, and no link between components is lost beyond what signatures lose.

Defined results: a null text counts as empty.  Texts without words have no shingles and are
duplicates only of texts that are equal to them; texts of fewer than five words are one shingle.  Repeated rows are copies.
The class is the least id among its rows, null if all are null.  Further columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm import words as W
from gridspark.llm.common import query, settle, table

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 24, 4
ROUNDS = 2  #: against one text of the largest component, before what is left is checked whole
SKETCH = 1024  #: bits of the long signatures; a pair is verified up to SKETCH_SIGMA deviations from a link's mean
SKETCH_SIGMA = 4.5
_U = np.uint64
_PAIR_BYTES = 4 << 20


def _uniform(h: np.ndarray) -> np.ndarray:
    """In (0, 1]."""
    return ((h >> _U(11)).astype(np.float64) + 1) * 2.0**-53


def signatures(doc: np.ndarray, key: np.ndarray, weight: np.ndarray, n_docs: int, m: int = BANDS * ROWS) -> np.ndarray:
    """``n_docs`` x ``m`` earliest times; rows of documents without elements are infinite.

    ``weight`` holds whole units, from 1 on.
    """
    out = np.full(n_docs * m, np.inf)
    total = np.bincount(doc, weight, n_docs)
    limit = (np.log(m) + 3) / np.maximum(total, 1)
    layers = [(np.arange(len(doc)), 0, 1)]
    low = 1
    while (at := np.flatnonzero(weight > low)).size:
        layers.append((at, low, low))  # the layer from `low` on, as wide as that
        low *= 2
    todo = np.flatnonzero(total > 0)
    while todo.size:
        chosen = np.zeros(n_docs, bool)
        chosen[todo] = True
        for at, low, width in layers:
            at = at[chosen[doc[at]]]
            own, state = doc[at], W.mixed(key[at] + _U(0x632BE59BD9B4E019 * (low + 1) & 0xFFFFFFFFFFFFFFFF))
            room = weight[at] - low
            time = np.zeros(len(at))
            step = 0
            while at.size:
                step += 1
                state = W.mixed(state + _U(0x9E3779B97F4A7C15))
                time = time - np.log(_uniform(state)) / (m * width)
                live = time < limit[own]
                at, own, state, time, room = at[live], own[live], state[live], time[live], room[live]
                label = W.mixed(state ^ _U(0xD1B54A32D192ED03))
                component = ((label >> _U(32)) * _U(m) >> _U(32)).astype(np.int64)
                place = (label & _U(0xFFFFFFFF)).astype(np.float64) * (width / 2.0**32)
                in_ = place < room
                np.minimum.at(out, own[in_] * m + component[in_], time[in_])
        empty = np.isinf(out.reshape(n_docs, m)).any(axis=1)
        todo = np.flatnonzero(empty & (total > 0))
        limit[todo] *= 2
    return out.reshape(n_docs, m)


def _bands(sig: np.ndarray, bands: int) -> np.ndarray:
    """A key per band; infinite rows stay and are dropped by the caller."""
    bits = sig.view(np.uint64).reshape(len(sig), bands, -1)
    key = np.broadcast_to(np.arange(bands, dtype=np.uint64) + _U(1), (len(sig), bands))
    for r in range(bits.shape[2]):
        key = W.mixed(key * _U(0xA24BAED4963EE407) ^ W.mixed(bits[:, :, r]))
    return key.view(np.int64)


def _signed(size: int, bands: int, rows: int, unit: int):
    def run(batches):
        for batch in batches:
            at = 0
            for w in W.blocks(batch.column(1)):
                n = len(w.first) - 1
                doc, key, count = W.bags(*W.shingles(w, size))
                weight = -(-count // unit)
                total = np.bincount(doc, count, n).astype(np.int64)
                keys = _bands(signatures(doc, key, weight, n, bands * rows), bands)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.where(total > 0, bands, 0))]).astype(np.int32)), pa.array(keys[total > 0].ravel()))
                yield pa.record_batch([batch.column(0).slice(at, n), pa.array(total), lists], names=["node", "size", "bands"])
                at += n

    return run


def _sketched(size: int, unit: int):
    names = ["node", *(f"s{k}" for k in range(SKETCH // 64))]

    def run(batches):
        for batch in batches:
            for w in W.blocks(batch.column(1)):
                n = len(w.first) - 1
                doc, key, count = W.bags(*W.shingles(w, size))
                sig = signatures(doc, key, -(-count // unit), n, SKETCH)
                bits = np.packbits((W.mixed(sig.view(np.uint64)) & _U(1)).astype(bool), axis=1).view(np.int64)
                yield pa.record_batch([batch.column(0).slice(w.low, n), *(pa.array(np.ascontiguousarray(c)) for c in bits.T)], names=names)

    return run


def _alike(similarity: float):
    """Whether the sketches of ``x`` and ``y`` differ in no more bits than those of a link may."""
    differ = (1 - similarity) / 2
    most = SKETCH * differ + SKETCH_SIGMA * (SKETCH * differ * (1 - differ)) ** 0.5
    return sum(F.bit_count(F.col(f"x.s{k}").bitwiseXOR(F.col(f"y.s{k}"))) for k in range(SKETCH // 64)) <= most


def _bag(texts: pa.Array, size: int):
    parts = []
    for w in W.blocks(texts):
        doc, key, n = W.bags(*W.shingles(w, size))
        parts.append((doc + w.low, key, n))
    return [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)]


def similarities(a: pa.Array, b: pa.Array, size: int = SHINGLE) -> np.ndarray:
    """Multiset Jaccard similarity of the shingles of each pair of texts; 0 where neither has any."""
    (da, ka, na), (db, kb, nb) = _bag(a, size), _bag(b, size)
    joint = lambda d, k: k ^ W.mixed(d.astype(np.uint64) + _U(1))
    _, i, j = np.intersect1d(joint(da, ka), joint(db, kb), assume_unique=True, return_indices=True)
    both = np.bincount(da[i], np.minimum(na[i], nb[j]), len(a))
    either = np.bincount(da, na, len(a)) + np.bincount(db, nb, len(a)) - both
    return np.where(either > 0, both / np.maximum(either, 1), 0.0)


def _verified(size: int):
    def run(batches):
        for batch in batches:
            text_bytes = np.asarray(pa.compute.add(pa.compute.binary_length(batch.column(2)), pa.compute.binary_length(batch.column(3))), dtype=np.int64)
            cut = np.concatenate([[0], np.cumsum(text_bytes)])
            at = 0
            while at < batch.num_rows:
                end = max(at + 1, int(np.searchsorted(cut, cut[at] + _PAIR_BYTES)) - 1)
                part = batch.slice(at, end - at)
                yield pa.record_batch([part.column(0), part.column(1), pa.array(similarities(part.column(2), part.column(3), size))], names=["a", "b", "sim"])
                at = end

    return run


def verify(pairs: DataFrame, texts: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``a, b, sim`` of pairs of nodes; ``texts`` has ``node, text``."""
    a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    return pairs.join(a, "a").join(b, "b").select("a", "b", "text_a", "text_b").mapInArrow(_verified(size), "a binary, b binary, sim double")


def _supported(texts: DataFrame, labels: DataFrame, similarity: float, size: int) -> DataFrame:
    """``node, support`` of the texts whose overlap with other components can reach ``similarity``.

    The support counts the shingles that occur in another component; a link's overlap is at most
    that, and at least ``similarity`` times the text's own size.
    """

    def run(batches):
        for batch in batches:
            for w in W.blocks(batch.column(2)):
                doc, key, n = W.bags(*W.shingles(w, size))
                rows = pa.array(doc + w.low)
                yield pa.record_batch([batch.column(0).take(rows), batch.column(1).take(rows), pa.array(key.view(np.int64)), pa.array(n)], names=["id", "label", "h", "n"])

    short = labels.select("node", F.xxhash64("node").alias("id"), F.xxhash64("label").alias("own"))
    each = settle(texts.join(short, "node").select("id", "own", "text").mapInArrow(run, "id long, label long, h long, n long"), "near-shingles")
    elsewhere = each.groupBy("h").agg(F.min("label").alias("x"), F.max("label").alias("y")).where("x <> y").select("h")
    support = each.join(elsewhere, "h", "left_semi").groupBy("id").agg(F.sum("n").alias("support"))
    whole = each.groupBy("id").agg(F.sum("n").alias("size"))
    enough = support.join(whole, "id").where(F.col("support") >= similarity * F.col("size"))
    return short.join(enough, "id").select("node", "support")


def components(edges: DataFrame) -> DataFrame:
    """``node, label`` of every node of ``a, b``; the label is the component's least node.

    Least labels spread over edges and labels are looked up in each other, so the rounds grow
    with the logarithm of the longest path; each round is written, so lost executors repeat one.
    """
    both = settle(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = settle(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        spread = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = settle(spread.join(jump, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _reaches(size_a: str, size_b: str, support_a: str, support_b: str, similarity: float):
    """Whether the overlap that a link of these sizes needs is within both supports."""
    return F.least(support_a, support_b) >= similarity / (1 + similarity) * (F.col(size_a) + F.col(size_b)) - 1e-9


def _relabelled(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``node, label`` after the links ``a, b`` join components."""
    ends = links.select("a", "b").join(labels.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(labels.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    joined = components(ends.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("new"))
    return settle(labels.join(joined, "label", "left").select("node", F.coalesce("new", "label").alias("label")), "near-labels")


def _mixed(own: DataFrame) -> DataFrame:
    """``band`` of the buckets that hold several components."""
    return own.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band")


def _pair(a, b):
    """Columns ``a, b`` of two nodes in order."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def classes(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, unit: int = 1, id_col="doc_id", text_col="text", with_label: bool = False) -> tuple[DataFrame, DataFrame]:
    """``doc_id, node, class_id`` of every row, and the verified links ``a, b, sim`` between nodes.

    A node is a distinct text, named by its MD5; ``with_label`` gives the class's least node in place of its least id.  ``unit`` coarsens the weights of the signatures only.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    plain = docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.md5(text)).alias("node"), text.alias("text"))
    members = settle(plain.select("doc_id", "node"), "near-members")
    signed = settle(plain.select("node", "text").mapInArrow(_signed(shingle, bands, rows, unit), "node binary, size long, bands array<long>"), "near-signatures")
    nodes = signed.groupBy("node").agg(F.first("size").alias("size"), F.first("bands").alias("bands"))
    bucketed = settle(nodes.select("node", "size", F.explode("bands").alias("band")), "near-buckets")
    several = bucketed.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    within = settle(bucketed.join(several, "band"), "near-crowded")  # only buckets of two texts and more
    central = within.groupBy("node").agg(F.sum("n").alias("met"))  # originals meet more texts than their copies do
    pivots = within.join(central, "node").groupBy("band").agg(F.max_by("node", F.struct("met", "node")).alias("pivot"))
    pivots = pivots.join(within.select("band", F.col("node").alias("pivot"), F.col("size").alias("pivot_size")), ["band", "pivot"])
    within = settle(within.join(pivots, "band").select("band", "node", "size", "pivot", "pivot_size"), "near-within")
    needed = within.select("node").distinct()
    texts = settle(plain.select("node", "text").join(needed, "node", "left_semi").groupBy("node").agg(F.first("text").alias("text")), "near-texts")

    def allowed(star):
        """Distinct pairs of texts and their pivots whose sizes allow a link."""
        near = star.where((F.col("node") != F.col("pivot")) & (F.least("size", "pivot_size") >= similarity * F.greatest("size", "pivot_size")))
        return near.select(*_pair(F.col("node"), F.col("pivot"))).distinct()

    tried = settle(verify(settle(allowed(within), "near-star"), texts, shingle), "near-tried")
    links = tried.where(F.col("sim") >= similarity)
    labels = _relabelled(needed.select("node", F.col("node").alias("label")), links)
    known = tried.select("a", "b", (1 - F.col("sim")).alias("far"))
    # Texts that a link can still join to another component, with their distance to the central text.
    mixed = _mixed(within.join(labels, "node"))
    able = settle(_supported(texts, within.join(mixed, "band", "left_semi").select("node").distinct().join(labels, "node"), similarity, shingle), "near-able")
    left = within.join(able, "node").withColumns({"a": F.least("node", "pivot"), "b": F.greatest("node", "pivot")}).join(known, ["a", "b"], "left")
    left = settle(left.select("band", "node", "size", "support", F.when(F.col("node") == F.col("pivot"), 0.0).otherwise(F.col("far")).alias("far")), "near-left")
    for r in range(ROUNDS):
        own = left.join(labels, "node")
        groups = own.groupBy("band", "label").agg(F.count("*").alias("n"), F.max_by(F.struct("node", "size", "support"), F.xxhash64("band", "node", F.lit(r))).alias("one"))
        most = groups.groupBy("band").agg(F.max_by(F.struct("label", "one"), F.struct("n", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
        most = most.select("band", F.col("most.label").alias("pivot_label"), F.col("most.one.node").alias("pivot"), F.col("most.one.size").alias("pivot_size"), F.col("most.one.support").alias("pivot_support"))
        asked = allowed(own.join(most, "band").where((F.col("label") != F.col("pivot_label")) & _reaches("size", "pivot_size", "support", "pivot_support", similarity)))
        asked = settle(asked.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "near-asked")
        told = settle(verify(asked, texts, shingle), "near-told")
        tried, links = tried.unionByName(told), links.unionByName(told.where(F.col("sim") >= similarity))
        if not told.where(F.col("sim") >= similarity).limit(1).count():
            break
        labels = _relabelled(labels, told.where(F.col("sim") >= similarity))
    own = left.join(labels, "node")
    sketches = settle(texts.join(able, "node", "left_semi").mapInArrow(_sketched(shingle, unit), ", ".join(["node binary", *(f"s{k} long" for k in range(SKETCH // 64))])), "near-sketches")
    apart = own.join(_mixed(own), "band", "left_semi")
    shared = apart.groupBy("node").agg(F.collect_list("band").alias("bands"))  # a text has a row per band
    apart = apart.join(shared, "node").withColumn("earlier", F.filter("bands", lambda b: b < F.col("band"))).drop("bands")
    apart = settle(apart.join(sketches, "node"), "near-apart")
    x, y = apart.alias("x"), apart.alias("y")
    near = (F.least("x.size", "y.size") >= similarity * F.greatest("x.size", "y.size")) & _reaches("x.size", "y.size", "x.support", "y.support", similarity) & ~(F.coalesce(F.abs(F.col("x.far") - F.col("y.far")), F.lit(0.0)) > 1 - similarity + 1e-9) & _alike(similarity)
    near = near & ~F.arrays_overlap("x.earlier", "y.earlier")  # a pair is judged in the first bucket that it shares
    cross = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.label") < F.col("y.label")) & near).select(*_pair(F.col("x.node"), F.col("y.node")))
    cross = settle(cross.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "near-cross")
    more = settle(verify(cross, texts, shingle).where(F.col("sim") >= similarity), "near-more")
    every = links.unionByName(more)
    labels = _relabelled(labels, more)
    labelled = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    if with_label:
        return settle(labelled.select("doc_id", "node", "label"), "near-labelled"), every
    least = labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return labelled.join(least, "label").select("doc_id", "node", "class_id"), every


def with_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """``members`` with ``n_links``: verified links of the row's text to other texts.

    Links are those that join the class: each text of it has one or more, and copies of a text share them.
    """
    ends = links.select("a", "b").distinct().select(F.explode(F.array("a", "b")).alias("node"))
    counts = ends.groupBy("node").agg(F.count("*").alias("n_links"))
    return members.join(counts, "node", "left").withColumn("n_links", F.coalesce("n_links", F.lit(0).cast("long")))


def representatives(docs: DataFrame, id_col="doc_id", text_col="text", **parameters) -> DataFrame:
    """One row of ``docs`` per class, with its own columns: the one with the least id (then text hash)."""
    members, _ = classes(docs, id_col=id_col, text_col=text_col, with_label=True, **parameters)
    first = members.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "node")).alias("first")).select("first.doc_id", "first.node")
    first = settle(members.join(first.select(F.col("doc_id").alias("id"), F.col("node").alias("n")), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("node") == F.col("n"))).groupBy("doc_id", "node").agg(F.count("*").alias("rows")), "near-first")
    node = F.unhex(F.md5(F.coalesce(docs[text_col], F.lit(""))))
    kept = docs.join(first, docs[id_col].eqNullSafe(first["doc_id"]) & (node == first["node"]), "left_semi")
    repeated = first.where("rows > 1").limit(1).count()
    return kept.dropDuplicates([id_col, text_col]) if repeated else kept


@query("op6_bagminhash_near_duplicates")
def near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    members, links = classes(table(spark, sf_dir, "documents"))
    return with_links(members, links).select("doc_id", "class_id", "n_links")
