"""Packing by powers of two: documents are cut into pieces of binary lengths, equal lengths share a bucket.

A document of ``n`` tokens becomes ``n // capacity`` pieces of ``capacity`` tokens and one piece
for each binary digit of the rest, longest first.  Every piece is a sequence of its own, so no
sequence holds tokens of two documents and none needs padding.  The written table has a folder
per length; training reads one bucket at a time and takes a batch size to match the length.

Words between ASCII blanks are encoded once per batch and kept in a bounded store of the worker:
the tokenizer drops white space and joins nothing across it, so the ids of a text are those of
its words in order (``tests/llm`` compares whole texts).  New words go to the tokenizer in lines
of many; ids that end a word tell them apart again.

Defined results: a null text counts as empty and gives one piece, the closing id alone.  Texts of
any length are encoded whole.  Repeated rows and repeated or null ids each get pieces of their
own; further columns are ignored; an empty table gives an empty result.  A special token's name
in a text is read as that token unless ``special_as_text``.
"""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gridspark.llm.common import fresh_path, query, small_batches, table

CAPACITY, END = 4096, 2
AT_ONCE = 4096  #: words in one call of the tokenizer
LINE, SHORT = 256, 64  #: words in one line of it, and the bytes of the longest of them
SLICE_BYTES = 8 << 20  #: text encoded at a time, a longer document alone
OUT_BYTES = 32 << 20  #: ids in one Arrow batch put out, a longer piece alone
STORE_WORDS, STORE_BYTES = 1 << 20, 32 << 20  #: words whose ids a worker keeps, and their bytes; a full store starts afresh

_STORES: dict = {}


class Store:
    """Words met so far and their ids, both as Arrow arrays."""

    def __init__(self, path: str, special_as_text: bool, end: int = END):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads would each hold memory
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.tokenizer.encode_special_tokens = special_as_text
        vocab, suffix = self.tokenizer.get_vocab(), getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.closing = np.zeros(max(vocab.values()) + 1, dtype=bool)  #: ids that end a part of a word
        if suffix:
            self.closing[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.clear()

    def clear(self) -> None:
        """Word 0 stands for a document's end."""
        self.words = pa.array([None], pa.large_string())
        self.edge, self.ids = np.array([0, 1]), np.array([self.end], dtype=np.uint32)

    def _ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the number of ids of each."""
        gc.disable()  # thousands of short lists, none in a cycle, would set off one collection after the other
        try:
            got = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes
        finally:
            gc.enable()

    def _of_lines(self, lines: pa.Array, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of the words in lines, the number of ids of each, and whether its line is told apart: others have none.

        ``parts`` of a word are exact or, where they are 1, the fewest: a line with as many closing ids as parts has no more of them.
        """
        ids, sizes = self._ids(lines)
        closes = self.closing[ids]
        closed = np.diff(np.concatenate([[0], np.cumsum(closes)])[np.concatenate([[0], np.cumsum(sizes)])])
        apart = np.add.reduceat(parts, np.arange(0, len(parts), LINE)) == closed
        known = np.repeat(apart, LINE)[: len(parts)]
        kept = np.repeat(apart, sizes)
        last = np.flatnonzero(closes[kept])[np.cumsum(parts[known]) - 1]
        return ids[kept], np.diff(last, prepend=-1), known

    def encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all words, the number of ids of each, and the words' places in this order."""
        parts = _parts(words) if self.closing.any() else np.zeros(len(words), dtype=np.int64)
        short, alone = np.flatnonzero(parts), [np.flatnonzero(parts == 0)]
        ids, sizes, places = [], [], []
        for a in range(0, len(short), AT_ONCE):
            at = short[a : a + AT_ONCE]
            edge = np.append(np.arange(0, len(at), LINE), len(at)).astype(np.int32)
            lines = pc.binary_join(pa.ListArray.from_arrays(pa.array(edge), words.take(pa.array(at)).cast(pa.string())), " ")
            got, n, known = self._of_lines(lines, parts[at])
            ids.append(got)
            sizes.append(n)
            places.append(at[known])
            alone.append(at[~known])
        alone = np.concatenate(alone)
        for a in range(0, len(alone), AT_ONCE):
            got, n = self._ids(words.take(pa.array(alone[a : a + AT_ONCE])))
            ids.append(got)
            sizes.append(n)
        return np.concatenate(ids), np.concatenate(sizes), np.concatenate([*places, alone])

    def numbers(self, words: pa.Array) -> np.ndarray:
        """The number of each distinct word, new ones encoded."""
        if len(self.words) > STORE_WORDS or self.words.nbytes > STORE_BYTES:
            self.clear()
        number = pc.index_in(words, value_set=self.words)
        missing = number.is_null()
        found = number.fill_null(0).to_numpy().astype(np.int64)
        new = np.flatnonzero(missing.to_numpy(zero_copy_only=False))
        if len(new):
            ids, sizes, places = self.encode(words.take(pa.array(new)))
            found[new[places]] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new[places]))])
            self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, ids])
        return found


def _parts(words: pa.Array) -> np.ndarray:
    """The parts into which the tokenizer splits each word before its merges; 0 for words that it has to take alone.

    Of ASCII words the count is exact.  Letters of other scripts are one part, or more where the
    tokenizer takes a letter apart.  Long words, special tokens' names and all others are taken alone.
    """
    short = np.flatnonzero(pc.less_equal(pc.binary_length(words), SHORT))
    some = words.take(pa.array(short))
    plain = pc.and_not(pc.match_substring_regex(some, r"^(?:[!-~]+|\p{L}+)$"), pc.match_substring(some, "<|"))
    parts = np.zeros(len(words), dtype=np.int64)
    parts[short[plain.to_numpy(zero_copy_only=False)]] = pc.count_substring_regex(some.filter(plain), r"'(?:s|t|re|ve|m|ll|d)|\p{L}+|[0-9]|[^\p{L}0-9]+", ignore_case=True)
    return parts


def _plain(texts: pa.Array) -> pa.Array:
    """The same ids from fewer distinct words: small letters, and closing marks apart from the word.

    The tokenizer does both itself.  Only accents that combine with the letter before, and names of
    special tokens, tell capitals apart; texts that may hold one are left as they are.
    """
    data = texts.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    if len(texts) and ((data == 0xCC) | (data == 0xCD)).any() or pc.any(pc.match_substring(texts, "<|")).as_py():
        return texts
    return pc.replace_substring_regex(pc.ascii_lower(texts), r"([a-z0-9])([.,;:!?]+)([ \t\n\v\f\r]|$)", r"\1 \2\3")


def encoded(texts: pa.Array, store: Store) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts one after the other, each with its end, and the number of ids of each."""
    texts = pa.concat_arrays([pc.fill_null(texts.cast(pa.large_string()), "")])  # buffers of these texts alone
    split = pc.ascii_split_whitespace(_plain(texts))
    coded = split.flatten().dictionary_encode()
    ends = np.asarray(split.offsets)[1:].astype(np.int64) - split.offsets[0].as_py() + np.arange(len(texts))
    number = np.zeros(len(coded) + len(texts), dtype=np.int64)  # words, and an end for each text
    at = np.ones(len(number), dtype=bool)
    at[ends] = False
    if len(coded):
        number[at] = store.numbers(coded.dictionary)[np.asarray(coded.indices)]
    taken = pa.LargeListArray.from_arrays(pa.array(store.edge), pa.array(store.ids)).take(pa.array(number))
    out = np.asarray(taken.flatten())
    return out, np.diff(np.asarray(taken.offsets)[np.concatenate([[0], ends + 1])])


def cut(n_ids: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length) of every piece, in order."""
    whole = n_ids // capacity
    doc = [np.repeat(np.arange(len(n_ids)), whole)]
    start = [(np.arange(whole.sum()) - np.repeat(np.cumsum(whole) - whole, whole)) * capacity]
    length = [np.full(whole.sum(), capacity)]
    for bit in reversed(range(capacity.bit_length() - 1)):
        has = np.flatnonzero(n_ids >> bit & 1)
        doc.append(has)
        start.append(n_ids[has] >> bit + 1 << bit + 1)
        length.append(np.full(len(has), 1 << bit))
    doc, start, length = map(np.concatenate, (doc, start, length))
    order = np.lexsort((start, doc))
    return doc[order], start[order], length[order]


def _gathered(batches) -> Iterator[pa.RecordBatch]:
    """Small batches put together to about ``SLICE_BYTES``: words are told apart once for all of them."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= SLICE_BYTES:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    size = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy().astype(np.int64))
    low = 0
    while low < len(texts):
        before = size[low - 1] if low else 0
        high = max(int(np.searchsorted(size, before + SLICE_BYTES, side="right")), low + 1)
        yield low, high
        low = high


_PIECE = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, special_as_text: bool = False, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per piece: ``doc_id``, its place in the document, ``ids`` (little-endian, 4 bytes each) and its sequence.

    ``tokenizer`` is the path of a vocabulary file that every executor has.  A sequence's number
    holds its bucket, then the task and the place there: equal lengths are neighbours in their
    order, and no task needs to know how many pieces others have.
    """
    if capacity & (capacity - 1) or capacity < 1:
        raise ValueError("the capacity has to be a power of two")
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([narrow.schema["doc_id"], *T._parse_datatype_string(_PIECE).fields])

    def run(batches):
        key = tokenizer, special_as_text, end
        store = _STORES.get(key) or _STORES.setdefault(key, Store(*key))
        task, done = TaskContext.get().partitionId(), np.zeros(64, dtype=np.int64)
        for batch in _gathered(batches):
            for low, high in _slices(batch.column(1)):
                ids, n_ids = encoded(batch.column(1)[low:high], store)
                doc, start, length = cut(n_ids, capacity)
                bucket = np.log2(length).astype(np.int64)
                nth = np.empty(len(doc), dtype=np.int64)
                for b in np.unique(bucket):
                    at = np.flatnonzero(bucket == b)
                    nth[at] = done[b] + np.arange(len(at))
                    done[b] += len(at)
                sequence = (bucket << 58) + (np.int64(task) << 32) + nth
                edge = np.concatenate([[0], np.cumsum(length)]) * 4
                a = 0
                while a < len(doc):
                    b = max(int(np.searchsorted(edge, edge[a] + OUT_BYTES, side="right")) - 1, a + 1)
                    data = ids[edge[a] // 4 : edge[b] // 4].astype("<u4").tobytes()
                    packed = pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((edge[a : b + 1] - edge[a]).astype(np.int32)), pa.py_buffer(data)])
                    own = doc[a:b]
                    yield pa.record_batch(
                        [batch.column(0).take(pa.array(own + low)), pa.array(start[a:b]), pa.array(length[a:b]), packed, pa.array(n_ids[own]), pa.array(sequence[a:b]), pa.array(np.zeros(b - a, np.int64))],
                        names=schema.names,
                    )
                    a = b

    return narrow.mapInArrow(run, schema)


def write_buckets(found: DataFrame, path: str) -> DataFrame:
    """Writes pieces with a folder per length and returns the written table."""
    found.write.option("parquet.enable.dictionary#ids", "false").partitionBy("length").parquet(path)
    return found.sparkSession.read.schema(found.schema).parquet(path).select(*found.columns)


@query("op13_power_of_two_packing")
def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = pieces(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    found = write_buckets(found, fresh_path(spark, "packed"))
    return found.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
