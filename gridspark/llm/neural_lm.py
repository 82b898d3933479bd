r"""Language-model scores: a log-bilinear model trained by noise-contrastive estimation.

Words are counted over all training documents.  The model's symbols are the end of a text, the commonest
``VOCABULARY`` words and about ``CLASSES`` classes of the others: those in order of count, cut so that each class has
about the same share of the tokens, and words too rare for the ``COMMON`` table by hash.  So classes are narrow
where words are common, and follow the counts at any size.  A word of a class has the class's probability times
its own share within it, so rare and unseen words are scored too.

The model predicts a symbol from the two before it: their vectors, each through a matrix of its own, sum to a
prediction that is compared with every symbol's output vector.  Every position of every training document
is dealt by hash to one of ``ROUNDS`` rounds, so the rounds together pass once over all of them.  Tasks train on
their own positions in numpy, with noise drawn per minibatch, and
their parameters are averaged by position count after each round; the parameters are of fixed size.
The normalisers of all pairs of symbols are then one matrix product (the exponentials of both words' parts), so scoring
looks them up and the probabilities are exactly normalised.

Counts of the commonest ``COMMON`` words travel to the tasks (a bounded table); all other words are
joined with the counts, one row per document and word.

Defined results: a null text counts as empty, its only token is the end.  A null id counts as the empty
string in the split of the documents.  Rows are scored one by one, so repeated rows get equal results; further
columns are ignored.  An empty table gives an empty result; without training documents every
score is that of an even choice among symbols.
"""

from __future__ import annotations

from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from gridspark.llm import words as W
from gridspark.llm.common import query, settle, table

VOCABULARY, CLASSES, WIDTH = 1022, 1022, 32
COMMON = 1 << 18  #: words whose counts travel to the tasks, at most
ROUNDS, BATCH, NOISE, RATE = 4, 512, 64, 0.08
FOLDS, HELD_OUT = 7, 2

END = 0  #: symbol; words, classes of common words and classes of rare words follow
_END_WORD = np.uint64(0x5851F42D4C957F2D)  #: stands for the end among word hashes
FLUSH_WORDS = 1 << 20


def _folded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    fold = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % FOLDS
    return docs.select(F.col(id_col).alias("doc_id"), (fold == HELD_OUT).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def _count(batches):
    held, size, docs = [], 0, 0

    def flush():
        word, back = np.unique(np.concatenate([x for x, _ in held]), return_inverse=True)
        n = np.bincount(back, np.concatenate([n for _, n in held])).astype(np.int64)
        return pa.record_batch([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])

    for batch in batches:
        docs += batch.num_rows
        for w in W.blocks(batch.column(0), lower=True):
            held.append(np.unique(W.word_hashes(w), return_counts=True))
            size += len(held[-1][0])
            if size > FLUSH_WORDS:
                yield flush()
                held, size = [], 0
    if docs:
        held.append((np.array([_END_WORD]), np.array([docs])))
        yield flush()


class Lexicon(NamedTuple):
    """Counts that the tasks need; bounded by the parameters."""

    words: np.ndarray  #: sorted hashes of the commonest words
    counts: np.ndarray
    symbols: np.ndarray  #: symbol of each: its own or its class's
    tokens: int
    types: int
    ends: int
    unigram: np.ndarray  #: count of each symbol
    spare: np.ndarray  #: per class of rare words, its types and one for all unseen words; 0 for other symbols
    rare: int  #: the first class of rare words; all after it are such classes

    def base(self, c):
        return np.log10((c + 1) / (self.tokens + self.types + 1))

    def rare_symbol(self, h: np.ndarray) -> np.ndarray:
        return self.rare + h.view(np.int64) % (len(self.unigram) - self.rare)

    def within(self, symbol, c):
        """Share of a word in its class (1 if the symbol is the word)."""
        return np.log10((c + (symbol >= self.rare)) / (self.unigram[symbol] + self.spare[symbol]))


def lexicon(counts: DataFrame, common: int = COMMON, vocabulary: int = VOCABULARY, classes: int = CLASSES) -> Lexicon:
    """``counts``: ``word, n`` over all training tokens."""
    whole = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    grade = F.floor(F.log2(F.col("n").cast("double")) * 8).cast("int")
    left, least = common, 1 << 62
    for r in sorted(counts.select(grade.alias("grade")).groupBy("grade").agg(F.count("*").alias("v")).collect(), key=lambda r: -r["grade"]):
        if r["v"] > left:
            break
        left, least = left - r["v"], r["grade"]
    top = counts.withColumn("grade", grade).where(F.col("grade") >= least).select("word", "n").toArrow()
    word, n = top.column(0).to_numpy().view(np.uint64), top.column(1).to_numpy()
    order = np.argsort(word)
    word, n = word[order], n[order]
    ends = int(counts.where(F.col("word") == int(_END_WORD.view(np.int64))).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    ranked = np.lexsort((word, -n))
    ranked = ranked[word[ranked] != _END_WORD]
    first, others = ranked[:vocabulary], ranked[vocabulary:]
    rare_tokens = int(whole["n"]) - ends - int(n[ranked].sum())
    step = max(1.0, (int(n[others].sum()) + rare_tokens) / max(classes, 1))  # tokens of a class
    _, class_ = np.unique(((np.cumsum(n[others]) - n[others]) / step).astype(np.int64), return_inverse=True)
    symbols = np.full(len(word), END)
    symbols[first] = np.arange(len(first)) + 1
    symbols[others] = len(first) + 1 + class_
    rare, n_rare = int(symbols.max(initial=END)) + 1, max(1, round(rare_tokens / step))
    unigram, spare = np.zeros(rare + n_rare), np.zeros(rare + n_rare)
    unigram[:rare] = np.bincount(symbols[ranked], n[ranked], rare)
    unigram[END], spare[rare:] = ends, 1
    if rare_tokens:
        left_out = counts.where((grade < least) & (F.col("word") != int(_END_WORD.view(np.int64))))
        for r in left_out.groupBy(F.pmod("word", F.lit(n_rare)).alias("k")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect():
            unigram[rare + r["k"]], spare[rare + r["k"]] = r["n"], r["v"] + 1
    return Lexicon(word, n, symbols, int(whole["n"]), int(whole["v"]), ends, unigram, spare, rare)


def _looked_up(lex: Lexicon, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbol and count of each word; -1 where the count is not at hand."""
    if not len(lex.words):
        return lex.rare_symbol(h), np.full(len(h), -1)
    at = np.minimum(np.searchsorted(lex.words, h), len(lex.words) - 1)
    same = (lex.words[at] == h) & (h != _END_WORD)
    return np.where(same, lex.symbols[at], lex.rare_symbol(h)), np.where(same, lex.counts[at], -1)


def _with_ends(w: W.Words, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Symbols of the block with an end after each document; the two before each; document; place of the words."""
    counts = w.count()
    place = np.arange(len(symbols)) + w.doc()
    line = np.full(len(symbols) + len(counts), END)
    line[place] = symbols
    first = np.cumsum(counts + 1) - (counts + 1)
    before = np.concatenate([[END], line[:-1]])
    further = np.concatenate([[END, END], line[:-2]])
    further[first] = END
    later = first[counts > 0] + 1
    further[later] = END  # before a document's first word there are ends
    before[first] = END
    return line, before, further, np.repeat(np.arange(len(counts)), counts + 1), place


def _positions(lex: Lexicon, rounds: int):
    """All positions, as packed (further, before, symbol): a column for each round."""

    def run(batches):
        for batch in batches:
            for w in W.blocks(batch.column(0), lower=True):
                h = W.word_hashes(w)
                line, before, further, doc, _ = _with_ends(w, _looked_up(lex, h)[0])
                key = W.mixed(np.arange(len(line), dtype=np.uint64) + W.mixed(np.uint64(len(h)) + np.bitwise_xor.reduce(h, initial=np.uint64(0))))
                packed = np.stack([further, before, line], axis=1).astype("<u2")
                dealt = [packed[key % np.uint64(rounds) == r] for r in range(rounds)]
                yield pa.record_batch([pa.array([x.tobytes()], pa.binary()) for x in dealt], names=[f"packed{r}" for r in range(rounds)])

    return run


def positions_of(training: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> DataFrame:
    """``packed0`` to the last round's: each position of the texts in one of them."""
    return training.mapInArrow(_positions(lex, rounds), ", ".join(f"packed{r} binary" for r in range(rounds)))


class Model(NamedTuple):
    inputs: np.ndarray  #: symbols x width
    outputs: np.ndarray
    near: np.ndarray  #: width x width, for the symbol before
    far: np.ndarray
    bias: np.ndarray

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self]).astype(np.float32)

    def like(self, flat: np.ndarray) -> Model:
        cuts = np.cumsum([x.size for x in self])[:-1]
        return Model(*(p.reshape(x.shape).astype(np.float32) for p, x in zip(np.split(flat, cuts), self)))


def initial(unigram: np.ndarray, width: int = WIDTH) -> Model:
    rng = np.random.default_rng(7)
    v = len(unigram)
    share = np.maximum(unigram, 0.5) / np.maximum(unigram, 0.5).sum()
    some = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    eye = np.eye(width, dtype=np.float32)
    return Model(some(v, width), some(v, width), eye, 0.5 * eye, np.log(share).astype(np.float32))


def _scattered(index: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by index."""
    order = np.argsort(index.astype(np.uint16), kind="stable")  # symbols fit, and short keys sort by radix
    sorted_ = index[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    return sorted_[head], np.add.reduceat(rows.take(order, axis=0), head, axis=0)


def trained(model: Model, positions: np.ndarray, noise: np.ndarray, seed: int, rate: float = RATE) -> Model:
    """One pass of noise-contrastive estimation with adaptive steps; ``noise``: share of each symbol."""
    rng = np.random.default_rng(seed)
    inputs, outputs, near, far, bias = (x.copy() for x in model)
    squares = [np.full(x.shape, 1e-2, np.float32) for x in model]
    log_noise = (np.log(noise) + np.log(NOISE)).astype(np.float32)
    cumulative = np.cumsum(noise)
    positions = positions[rng.permutation(len(positions))]

    def step(value, square, gradient, at=slice(None)):
        square[at] += gradient * gradient
        value[at] += rate * gradient / np.sqrt(square[at])

    for low in range(0, len(positions), BATCH):
        f, b, s = positions[low : low + BATCH].T.astype(np.int64)
        drawn = np.minimum(np.searchsorted(cumulative, rng.random(NOISE) * cumulative[-1]), len(noise) - 1)
        rf, rb = inputs[f], inputs[b]
        h = rf @ far + rb @ near
        real = (h * outputs[s]).sum(axis=1) + bias[s] - log_noise[s]
        false = h @ outputs[drawn].T + bias[drawn] - log_noise[drawn]
        up = 1 / (1 + np.exp(np.clip(real, -30, 30)))  # how far each truth is from certain
        down = -1 / (1 + np.exp(np.clip(-false, -30, 30)))
        dh = up[:, None] * outputs[s] + down @ outputs[drawn]
        which = np.concatenate([s, drawn])
        at, g = _scattered(which, np.concatenate([np.concatenate([up[:, None] * h, down.T @ h]), np.concatenate([up, down.sum(axis=0)])[:, None]], axis=1))
        scale = np.float32(1 / len(s))
        at_in, g_in = _scattered(np.concatenate([f, b]), np.concatenate([dh @ far.T, dh @ near.T]))
        g_far, g_near = rf.T @ dh, rb.T @ dh
        step(outputs, squares[1], g[:, :-1] * scale, at)
        step(bias, squares[4], g[:, -1] * scale, at)
        step(inputs, squares[0], g_in * scale, at_in)
        step(far, squares[3], g_far * scale)
        step(near, squares[2], g_near * scale)
    return Model(inputs, outputs, near, far, bias)


def _train_task(model: Model, noise: np.ndarray, round_: int):
    def run(batches):
        own, group, size, total = model, [], 0, 0
        for x in chain((x for batch in batches for x in batch.column(0).to_pylist()), [None]):
            if x is not None:
                group.append(np.frombuffer(x, dtype="<u2").reshape(-1, 3))
                size += len(group[-1])
            if size >= 1 << 20 or x is None and size:  # about a million positions at a time
                own = trained(own, np.concatenate(group), noise, seed=round_ * 7919 + total % 7907)
                group, size, total = [], 0, total + size
        if total:
            out = own.flat().astype(np.float64) * total
            yield pa.record_batch([pa.array(np.arange(out.size, dtype=np.int32)), pa.array(out), pa.array(np.full(out.size, total, np.int64))], names=["place", "value", "n"])

    return run


def fit(positions: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """``positions``: those of ``positions_of``, by round; parameters averaged over tasks after each."""
    model = initial(lex.unigram)
    noise = np.maximum(lex.unigram, 0.5) / np.maximum(lex.unigram, 0.5).sum()
    for r in range(rounds):
        sums = positions.select(f"packed{r}").mapInArrow(_train_task(model, noise, r), "place int, value double, n long").groupBy("place").agg((F.sum("value") / F.sum("n")).alias("value")).toArrow()
        if sums.num_rows == 0:
            return model
        flat = np.zeros(sums.num_rows)
        flat[sums.column("place").to_numpy()] = sums.column("value").to_numpy()
        model = model.like(flat)
    return model


def _exponentials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = x.max(axis=1, keepdims=True)
    return np.exp(x - top), top


def _normalisers(model: Model):
    """For each symbol before, the log normaliser after every further symbol."""

    def run(batches):
        outputs = model.outputs.T.astype(np.float64)
        far, far_top = _exponentials(model.inputs @ model.far @ outputs + model.bias)
        for batch in batches:
            befores = batch.column(0).to_numpy()
            near, near_top = _exponentials(model.inputs[befores] @ model.near @ outputs)
            logs = np.log(near @ far.T) + near_top + far_top.T
            for b, z in zip(befores.tolist(), logs):
                yield pa.record_batch([pa.array([b], pa.int64()), pa.array([z.astype("<f4").tobytes()], pa.binary())], names=["b", "z"])

    return run


def normalisers(spark: SparkSession, model: Model) -> np.ndarray:
    """Log normaliser by (before, further): symbols squared, a fixed size."""
    v = len(model.bias)
    got = spark.range(0, v, 1, min(v, 2 * spark.sparkContext.defaultParallelism)).mapInArrow(_normalisers(model), "b long, z binary").toArrow()
    out = np.zeros((v, v), np.float32)
    out[got.column("b").to_numpy()] = [np.frombuffer(z, "<f4") for z in got.column("z").to_pylist()]
    return out


def log_probabilities(model: Model, z: np.ndarray, further: np.ndarray, before: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """log10 of the probability of each symbol after the two before it."""
    h = (model.inputs @ model.far)[further] + (model.inputs @ model.near)[before]
    return ((h * model.outputs[symbol]).sum(axis=1) + model.bias[symbol] - z[before, further]).astype(np.float64) / np.log(10)


_PARTS = "row long, doc_id {id}, held_out boolean, word long, n long, known long, base double, score double"


def _scored(lex: Lexicon, model: Model, z: np.ndarray):
    """Per document a row of what is known here, and a row per word whose count is not."""
    names = ["row", "doc_id", "held_out", "word", "n", "known", "base", "score"]

    def run(batches):
        for batch in batches:
            for w in W.blocks(batch.column(3), lower=True):
                n, h, own = len(w.first) - 1, W.word_hashes(w), w.doc()
                symbol, count = _looked_up(lex, h)
                line, before, further, doc, _ = _with_ends(w, symbol)
                score = np.bincount(doc, log_probabilities(model, z, further, before, line), n)
                here = count >= 0
                score += np.bincount(own[here], lex.within(symbol[here], count[here]), n)
                base = np.bincount(own[here], lex.base(count[here]), n) + lex.base(lex.ends)
                known = np.bincount(own[here], minlength=n) + (lex.ends > 0)
                rows = [c.slice(w.low, n) for c in batch.columns[:3]]
                yield pa.record_batch([*rows, pa.nulls(n, pa.int64()), pa.array(w.count() + 1), pa.array(known), pa.array(base), pa.array(score)], names=names)
                doc_, word, times = W.bags(own[~here], h[~here])
                at = pa.array(doc_)
                none = pa.nulls(len(doc_), pa.float64())
                yield pa.record_batch([rows[0].take(at), rows[1].take(at), rows[2].take(at), pa.array(word.view(np.int64)), pa.array(times), pa.nulls(len(doc_), pa.int64()), none, none], names=names)

    return run


def scores(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` of every row."""
    spark = docs.sparkSession
    folded = _folded(docs, id_col, text_col)
    training = folded.where("not held_out").select("text")
    counts = settle(training.mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "lm-counts")
    lex = lexicon(counts)
    positions = settle(positions_of(training, lex), "lm-positions")
    model = fit(positions, lex)
    z = normalisers(spark, model)
    rows = folded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    kind = folded.schema["doc_id"].dataType.simpleString()
    parts = settle(rows.mapInArrow(_scored(lex, model, z), _PARTS.format(id=kind)), "lm-parts")
    c = F.coalesce(F.col("c"), F.lit(0))
    class_size = F.get(F.array(*[F.lit(float(x)) for x in (lex.unigram + lex.spare)[lex.rare :]]), F.pmod("word", F.lit(len(lex.unigram) - lex.rare)).cast("int"))
    rare = (
        parts.where("word is not null").select("row", "word", F.col("n").alias("times")).join(counts.select("word", F.col("n").alias("c")), "word", "left")
        .groupBy("row").agg(
            F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("more_known"),
            F.sum(F.col("times") * F.log10((c + 1) / F.lit(float(lex.tokens + lex.types + 1)))).alias("more_base"),
            F.sum(F.col("times") * F.log10((c + 1) / class_size)).alias("more_score"),
        )
    )
    zero = F.lit(0.0)
    return parts.where("word is null").join(rare, "row", "left").select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more_base", zero)).alias("base_score"), (F.col("score") + F.coalesce("more_score", zero)).alias("score"),
    )


@query("op8_log_bilinear_lm")
def language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
