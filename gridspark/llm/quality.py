"""Quality rules: repetition and length rules, and divergence from language references.

Languages are those of the data that hold enough documents.  Each gives two references: the
histogram of character classes and that of its commonest words.  A document's own histograms are
compared with its language's by Jensen-Shannon distance (base 2, 0 to 1); a minimum length guards
each comparison, since histograms of short texts are far from any reference by chance alone.

What is far follows from the data too: by language and length, the median distance of the
documents that pass the base rules, plus a number of deviations (median absolute deviation).
Distances shrink with length and differ by language, so no constant would do.  Documents that
share a sampled word window count once there, so that a group of copies does not decide what
is usual.  A document beyond its language's limit is still kept if another language's
references take it: a wrong label is not poor text.

Defined results: a null text counts as empty (0 words, fails the base rule).  Rows are judged
one by one, so repeated rows, repeated or null ids and further columns change nothing.  Texts of
any length are measured whole.  A document whose language is null or has no reference is judged
by the base rules alone; its distances are null.  An empty table gives an empty result and a
model that rejects nothing.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from gridspark.llm import words as W
from gridspark.llm.common import query, settle, small_batches, table

LEAST_DOCUMENTS, LEAST_SHARE = 10, 1e-4  #: a language with fewer documents, or a smaller share of all, gets no reference
COMMON_WORDS = 256  #: words in a language's reference
MIN_CHARS, MIN_WORDS = 200, 50  #: lengths from which the two distances are judged
CHAR_DEVIATIONS, WORD_DEVIATIONS = 24, 5  #: beyond the median of a language and length
CHAR_SPREAD, WORD_SPREAD = 0.004, 0.02  #: least deviation
LEAST_GROUP = 20  #: documents from which a language and length has a limit of its own, else all languages together, else the next shorter length's
BANDS = 64  #: lengths by half powers of two
BINS = 1024  #: distances are counted in so many steps
MIN_BASE_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 20, 30, 8
FLUSH_WORDS = 1 << 19

SYMBOLS = "#*$%&|<>"
CLASSES = 8  #: lower, upper, other scripts, digits, blanks, line ends, punctuation, symbols


def _class_table() -> np.ndarray:
    out = np.full(256, 7, dtype=np.int64)
    out[0x61:0x7B], out[0x41:0x5B], out[0x30:0x3A] = 0, 1, 3
    out[0xC0:] = 2
    out[0x80:0xC0] = CLASSES  # continuation bytes are no characters
    out[[0x20, 0x09]], out[[0x0A, 0x0D]] = 4, 5
    out[[ord(c) for c in ".,;:!?'\"()-"]] = 6
    return out


_CLASS = _class_table()
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
_LINE_END = np.arange(256) == 0x0A


class References(NamedTuple):
    """``chars``: languages x classes; ``words``: languages x (vocabulary + 1), the last for all other words.

    ``char_limit`` and ``word_limit``: languages x length bands, infinite where nothing is known.
    """

    languages: list[str]
    chars: np.ndarray
    vocabulary: np.ndarray  #: sorted hashes of the common words of all languages
    words: np.ndarray
    char_limit: np.ndarray
    word_limit: np.ndarray


def _band(length: np.ndarray) -> np.ndarray:
    return (2 * np.log2(np.maximum(length, 1))).astype(np.int64)


def _class_counts(w: W.Words) -> np.ndarray:
    n = len(w.first) - 1
    doc = np.repeat(np.arange(n), np.diff(w.byte_first))
    return np.bincount(doc * (CLASSES + 1) + _CLASS[w.data], minlength=n * (CLASSES + 1)).reshape(n, -1)[:, :CLASSES]


_COUNTS = T.StructType([T.StructField("lang", T.IntegerType()), T.StructField("word", T.LongType()), T.StructField("n", T.LongType())])


def _count_words(languages):
    """Partial counts of (language, word), and of (language, class) under words 0 to 7 of language -1 - l."""
    names = pa.array(languages, pa.string())

    def run(batches):
        held, size = {}, 0

        def flush():
            for lang, parts in held.items():
                hashes, counts = map(np.concatenate, zip(*parts))
                if lang >= 0:
                    hashes, back = np.unique(hashes, return_inverse=True)
                    counts = np.bincount(back, counts).astype(np.int64)
                yield pa.record_batch([pa.array(np.full(len(hashes), lang, np.int32)), pa.array(hashes.view(np.int64)), pa.array(counts)], names=_COUNTS.names)
            held.clear()

        for batch in batches:
            lang = pc.fill_null(pc.index_in(batch.column(1).cast(pa.string()), names), -1).to_numpy(zero_copy_only=False)
            for w in W.blocks(batch.column(0)):
                hashes, own, classes = W.word_hashes(w), np.repeat(lang[w.low : w.high], w.count()), _class_counts(w)
                for k in set(lang[w.low : w.high].tolist()) - {-1}:
                    found, n = np.unique(hashes[own == k], return_counts=True)
                    held.setdefault(k, []).append((found, n))
                    held.setdefault(-1 - k, []).append((np.arange(CLASSES, dtype=np.uint64), classes[lang[w.low : w.high] == k].sum(axis=0)))
                    size += len(found)
                if size > FLUSH_WORDS:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def languages_of(docs: DataFrame, lang_col="lang") -> list[str]:
    """Languages with enough documents for a reference, at most ``1 / LEAST_SHARE`` of them."""
    counts = docs.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n"))
    total = docs.count()
    return sorted(r.lang for r in counts.where(F.col("lang").isNotNull() & (F.col("n") >= max(LEAST_DOCUMENTS, LEAST_SHARE * total))).collect())


def histograms(docs: DataFrame, languages: list[str] | None = None, common=COMMON_WORDS, text_col="text", lang_col="lang") -> References:
    """Histograms of all documents of each language; no limits yet.

    What reaches the driver is bounded by the number of languages: for each the classes, the
    ``common`` first words (ties by hash) and their total.
    """
    small_batches(docs.sparkSession)
    languages = languages_of(docs, lang_col) if languages is None else languages
    counts = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(_count_words(languages), _COUNTS)
    counts = settle(counts.groupBy("lang", "word").agg(F.sum("n").alias("n")), "word-counts")
    chars = np.zeros((len(languages), CLASSES))
    total = np.zeros(len(languages))
    for r in counts.where("lang < 0").collect():
        chars[-1 - r.lang, r.word] = r.n
    for r in counts.where("lang >= 0").groupBy("lang").agg(F.sum("n").alias("n")).collect():
        total[r.lang] = r.n
    first = Window.partitionBy("lang").orderBy(F.desc("n"), "word")
    top = counts.where("lang >= 0").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= common).collect()
    vocabulary = np.unique(np.array([r.word for r in top], dtype=np.int64).view(np.uint64))
    words = np.zeros((len(languages), len(vocabulary) + 1))
    for r in top:
        words[r.lang, np.searchsorted(vocabulary, np.int64(r.word).view(np.uint64))] = r.n
    words[:, -1] = total - words.sum(axis=1)
    share = lambda x: x / np.maximum(x.sum(axis=1, keepdims=True), 1)
    open_ = np.full((len(languages), BANDS), np.inf)
    return References(languages, share(chars), vocabulary, share(words), open_, open_)


_SEEN = "lang int, sample long, char_band int, char_bin int, word_band int, word_bin int"


def _limits(counts: np.ndarray, deviations: float, spread: float) -> np.ndarray:
    """Limits of languages x bands from counts of languages x bands x bins."""
    out = np.full(counts.shape[:2], np.inf)
    centre = (np.arange(BINS) + 0.5) / BINS
    for band in range(counts.shape[1]):
        for k in range(len(counts)):
            own = counts[k, band]
            if own.sum() < LEAST_GROUP:
                own = counts[:, band].sum(axis=0)
            if own.sum() < LEAST_GROUP:
                out[k, band] = out[k, band - 1] if band else np.inf
                continue
            middle = centre[np.searchsorted(np.cumsum(own), own.sum() / 2)]
            off = np.abs(centre - middle)
            order = np.argsort(off, kind="stable")
            mad = off[order][np.searchsorted(np.cumsum(own[order]), own.sum() / 2)]
            out[k, band] = middle + deviations * max(1.4826 * mad, spread)
    return out


def references(docs: DataFrame, languages: list[str] | None = None, common=COMMON_WORDS, text_col="text", lang_col="lang") -> References:
    """Histograms and limits, from all documents."""
    refs = histograms(docs, languages, common, text_col, lang_col)

    def run(batches):
        for batch in batches:
            for w, own in _blocks(batch.column(0), batch.column(1), refs):
                m = _measured(w, own, refs)
                at = np.flatnonzero((own >= 0) & ~m["base_failed"])
                step = lambda x: np.minimum(m[x][at] * BINS, BINS - 1).astype(np.int32)
                columns = [own[at].astype(np.int32), m["sample"][at].view(np.int64), _band(m["n_chars"][at]).astype(np.int32), step("char_js"), _band(m["n_words"][at]).astype(np.int32), step("word_js")]
                yield pa.record_batch([pa.array(c) for c in columns], names=["lang", "sample", "char_band", "char_bin", "word_band", "word_bin"])

    seen = docs.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).mapInArrow(run, _SEEN)
    one = seen.groupBy("lang", "sample").agg(F.min(F.struct("char_band", "char_bin", "word_band", "word_bin")).alias("one"))
    one = settle(one.select("lang", "one.*"), "distances")
    found = []
    for name, deviations, spread in (("char", CHAR_DEVIATIONS, CHAR_SPREAD), ("word", WORD_DEVIATIONS, WORD_SPREAD)):
        counts = np.zeros((len(refs.languages), BANDS, BINS))
        for r in one.groupBy("lang", f"{name}_band", f"{name}_bin").agg(F.count("*").alias("n")).collect():  # languages x bands x bins at most
            counts[r[0], r[1], r[2]] = r.n
        found.append(_limits(counts, deviations, spread))
    return refs._replace(char_limit=found[0], word_limit=found[1])


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Row by row distance of two histograms that each sum to 1 (or are all 0)."""
    m = (p + q) / 2
    part = lambda x: np.where(x > 0, x * np.log2(np.where(x > 0, x, 1) / np.where(m > 0, m, 1)), 0).sum(axis=-1)
    return np.sqrt(np.clip((part(p) + part(q)) / 2, 0, 1))


def _sparse_distance(doc, index, n, reference, words, n_words):
    """Distance of each document's word histogram to its reference, over the words that it has.

    ``doc, index, n``: distinct words of documents, ordered; ``reference``: a row of ``words`` for each document.
    """
    p, q = n / n_words[doc], words[reference[doc], index]
    m = (p + q) / 2
    part = p * np.log2(p / m) + np.where(q > 0, q * np.log2(np.where(q > 0, q, 1) / m), 0)
    sums = np.bincount(doc, part, len(n_words)) + 1 - np.bincount(doc, q, len(n_words))  # q / 2 log 2 on each bin that it lacks
    return np.sqrt(np.clip(sums / 2, 0, 1))


def _repeats(w: W.Words, hashes: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Per document, the words in windows that it has twice or more."""
    windows = W.window_hashes(hashes, REPEAT_WINDOW)
    at = np.flatnonzero(W.inside(w.first, REPEAT_WINDOW, len(windows)))
    key = windows[at] ^ W.mixed(doc[at].astype(np.uint64) + np.uint64(1))
    order = np.argsort(key)
    same = np.zeros(len(order) + 1, dtype=bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    again = at[order[same[1:] | same[:-1]]]
    hit = W.covered(again, REPEAT_WINDOW, len(hashes))
    return np.bincount(doc[hit], minlength=len(w.first) - 1)


def _dup_lines(w: W.Words, texts_words: np.ndarray) -> np.ndarray:
    n = len(w.first) - 1
    lines = W._words(w.data, w.byte_first, np.diff(w.byte_first), w.low, w.high, _LINE_END)
    full = np.searchsorted(texts_words, lines.start) < np.searchsorted(texts_words, lines.end)
    doc = lines.doc()[full]
    key = W.word_hashes(lines)[full] ^ W.mixed(doc.astype(np.uint64) + np.uint64(1))
    _, at = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[at], minlength=n)


def _blocks(texts: pa.Array, lang: pa.Array, refs: References):
    """Blocks of words with each document's language number, -1 without a reference."""
    number = pc.index_in(lang.cast(pa.string()), pa.array(refs.languages, pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
    for w in W.blocks(texts):
        yield w, number[w.low : w.high]


def _measured(w: W.Words, own: np.ndarray, refs: References) -> dict[str, np.ndarray]:
    n, doc, hashes = len(w.first) - 1, w.doc(), W.word_hashes(w)
    n_words, classes = w.count(), _class_counts(w)
    n_chars = classes.sum(axis=1)
    repeat = _repeats(w, hashes, doc)
    failed = (n_words < MIN_BASE_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words)
    out = {
        "n_words": n_words,
        "word_chars": W.per_document((w.data & 0xC0 != 0x80) & ~W._IS_SPACE[w.data], w.byte_first),
        "n_symbols": W.per_document(_SYMBOL[w.data], w.byte_first),
        "n_dup_lines": _dup_lines(w, w.start),
        "n_repeat_words": repeat,
        "base_failed": failed,
        "n_chars": n_chars,
    }
    windows = W.window_hashes(hashes, REPEAT_WINDOW)
    at = np.flatnonzero(W.inside(w.first, REPEAT_WINDOW, len(windows)))
    out["sample"] = np.full(n, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(out["sample"], doc[at], windows[at])
    char_js, word_js, far = np.zeros(n), np.zeros(n), np.zeros(n, dtype=bool)
    if (own >= 0).any():
        size = len(refs.vocabulary)
        at = np.minimum(np.searchsorted(refs.vocabulary, hashes), max(size - 1, 0))
        index = np.where(refs.vocabulary[at] == hashes, at, size) if size else np.zeros_like(doc)
        pair, count = np.unique(doc * (size + 1) + index, return_counts=True)
        held, index = np.divmod(pair, size + 1)
        share = classes / np.maximum(n_chars, 1)[:, None]

        def compared(which: np.ndarray, reference: np.ndarray):
            """Distances of some documents to a reference each, and whether they are beyond its limits."""
            place = np.full(n, -1)
            place[which] = np.arange(len(which))
            some = place[held] >= 0
            chars = js_distance(share[which], refs.chars[reference])
            words = _sparse_distance(place[held[some]], index[some], count[some], reference, refs.words, np.maximum(n_words[which], 1))
            beyond = (n_chars[which] >= MIN_CHARS) & (chars > refs.char_limit[reference, _band(n_chars[which])])
            return chars, words, beyond | (n_words[which] >= MIN_WORDS) & (words > refs.word_limit[reference, _band(n_words[which])])

        known = np.flatnonzero((own >= 0) & (n_words > 0))
        char_js[known], word_js[known], far[known] = compared(known, own[known])
        for other in range(len(refs.languages)):
            which = np.flatnonzero(far & ~failed & (own != other))
            if len(which):
                far[which] = compared(which, np.full(len(which), other))[2]
    return out | {"kept": ~failed & ~far, "char_js": char_js, "word_js": word_js}


def measured(texts: pa.Array, lang: pa.Array, refs: References) -> dict[str, np.ndarray]:
    """The rules' figures for each text of an Arrow array."""
    found = [_measured(w, own, refs) for w, own in _blocks(texts, lang, refs)]
    return {k: np.concatenate([f[k] for f in found]) for k in (found[0] if found else ())}


_FIGURES = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, char_js double, word_js double"


def judge(docs: DataFrame, refs: References, id_col="doc_id", text_col="text", lang_col="lang") -> DataFrame:
    """One row of figures and the verdict per row of ``docs``."""
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    shape = T._parse_datatype_string(_FIGURES)

    def run(batches):
        for batch in batches:
            at = 0
            for w, own in _blocks(batch.column(1), batch.column(2), refs):
                m = _measured(w, own, refs)
                columns = [pa.array(m[f], mask=own < 0 if f.endswith("_js") else None) for f in shape.names]
                yield pa.record_batch([batch.column(0).slice(at, len(own)), *columns], names=["doc_id", *shape.names])
                at += len(own)

    return narrow.mapInArrow(run, T.StructType([narrow.schema["doc_id"], *shape.fields]))


def kept_rows(docs: DataFrame, refs: References, text_col="text", lang_col="lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns.

    Only text and language go through Python; the verdict comes back beside the row.
    """
    small_batches(docs.sparkSession)

    @F.arrow_udf("boolean")
    def kept(texts: pa.Array, lang: pa.Array) -> pa.Array:
        found = [_measured(w, own, refs)["kept"] for w, own in _blocks(texts, lang, refs)]
        return pa.array(np.concatenate(found)) if found else pa.array([], pa.bool_())

    return docs.where(kept(F.col(text_col).cast("string"), F.col(lang_col).cast("string")))


@query("op7_quality_divergence")
def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return judge(docs, references(docs))
