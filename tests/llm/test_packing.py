"""Packing beside the tokenizer run on whole texts."""

import zlib
from collections import defaultdict
from itertools import cycle, product

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gridspark.llm import packing
from gridspark.llm.common import fresh_path, table
from gridspark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")


def test_given_table(spark, tokenizer):
    found = defaultdict(list)
    rows = QUERIES["op13_power_of_two_packing"](spark, SF).collect()
    for r in rows:
        found[r.doc_id].append(r)
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    assert set(found) == set(docs) and len({r.sequence_id for r in rows}) == len(rows)
    for doc, text in docs.items():
        ids, at = ids_of(tokenizer, text), 0
        for r in sorted(found[doc], key=lambda r: r.start):
            assert r.start == at and r.offset == 0 and r.doc_tokens == len(ids) and r.length <= 4096 and r.length & (r.length - 1) == 0
            at += r.length
            assert r.ids_crc32 == zlib.crc32(ids[r.start : at].tobytes())
        assert at == len(ids)
        assert len(found[doc]) == len(ids) // 4096 + (len(ids) % 4096).bit_count()


ODD = ["", None, "  \t\n ", "one", "it's they'LL don't", "́x é é́̂ Å", "a b c　d", "\x1c\x1d\x85 x\x0by\x0cz", "😀😀 日本語テキスト", "123 45.6 a1b2", "ΑΣ ΑΣΑ İstanbul ǅ", "<|endoftext|> x<|startoftext|>y", "w" * 9000, "many words " * 30000, "\x00 \x01a", "J̌ J̌. H̱x", "Ends. HERE,. a.b c.; é.! x€. 9.\x1c .,: (a.) <|ENDOFTEXT|>."]


def test_words_give_the_ids_of_whole_texts(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "STORE_WORDS", 3)  # a full store starts afresh
    store = packing.Store(PATH, False)
    plain = [t for t in ODD if t and not any("\u0300" <= c < "\u0370" for c in t) and "<|" not in t]
    assert len(plain) > 10
    for given in (ODD, ODD[::-1], plain, ["Ends. HERE,. a.b c.; é.! x€. 9.\x1c .,: (a.)\n.b, İ. K."], [], [None], ["x"]):
        ids, sizes = packing.encoded(pa.array(given, pa.string()), store)
        want = [ids_of(tokenizer, t) for t in given]
        assert sizes.tolist() == [len(w) for w in want]
        assert ids.tolist() == [i for w in want for i in w]


class Counting:
    """A tokenizer that counts the texts given to it."""

    def __init__(self, inner):
        self.inner, self.texts = inner, 0

    def encode_batch_fast(self, texts, **kw):
        self.texts += len(texts)
        return self.inner.encode_batch_fast(texts, **kw)


LETTERS = ["".join(w) for w in product("stlmérdя", repeat=4)]
MARKED = [f"{a}{m}{b}" for a in ("x", "don", "7", "") for m in ("'s", "'S", "''ll", "'", "_-", "12", "<", "</w>", "#\x7f", "'re've") for b in ("", "s", "t9", ".a")]
#: Letters that the tokenizer takes apart or that are none, spaces of other kinds, marks, long words.
HARD = ["İ", "aİb", "\u0958\u0958", "\ufb1d", "\u212a\u017f", "'\u017f", "\u3000", "a\u3000b", "\x85", "\xa0", "\x1c", "\x00x", "\u1100\u1161", "\u1161", "ª²", "é'S", "e\u0301", "\u0301", "漢字", "😀", "<|x", "l" * 65, "я" * 33]


def test_new_words_go_to_the_tokenizer_in_lines(tokenizer):
    store = packing.Store(PATH, False)
    store.tokenizer = counting = Counting(store.tokenizer)
    words = LETTERS + [w for w in MARKED if "\x7f" not in w]
    ids, _ = packing.encoded(pa.array([" ".join(words)]), store)
    assert ids.tolist() == ids_of(tokenizer, " ".join(words)).tolist()
    assert len(words) > 4000 and counting.texts < 50


@pytest.mark.parametrize("line", [1, 2, 5, 256])
@pytest.mark.parametrize("special_as_text", [False, True])
def test_every_new_word_gets_its_own_ids(tokenizer, monkeypatch, line, special_as_text):
    monkeypatch.setattr(packing, "LINE", line)
    words = list(dict.fromkeys(x for few in zip(LETTERS, cycle(HARD), cycle(MARKED)) for x in few)) + ["<|endoftext|>", "a<|endoftext|>"]
    store = packing.Store(PATH, special_as_text)
    for given in (words, words[::-1], HARD, HARD[:1], ["x"]):
        ids, sizes, places = store.encode(pa.array(given, pa.large_string()))
        assert sorted(places.tolist()) == list(range(len(given))) and sizes.sum() == len(ids)
        edge = np.cumsum(sizes)
        for place, low, high in zip(places.tolist(), (edge - sizes).tolist(), edge.tolist()):
            assert ids[low:high].tolist() == store.tokenizer.encode(given[place], add_special_tokens=False).ids, given[place]
    monkeypatch.setattr(store, "closing", np.zeros_like(store.closing))  # a vocabulary that marks no ends
    ids, sizes, places = store.encode(pa.array(words[:99], pa.large_string()))
    assert places.tolist() == list(range(99)) and ids.tolist() == [i for w in words[:99] for i in store.tokenizer.encode(w, add_special_tokens=False).ids]


def test_special_names_as_text():
    ids, _ = packing.encoded(pa.array(["<|endoftext|>"]), packing.Store(PATH, True))
    assert 49407 not in ids.tolist() and len(ids) > 3


def test_cut():
    n = np.array([1, 2, 3, 7, 8, 9, 4095, 4096, 4097, 12293])
    doc, start, length = packing.cut(n)
    for d, size in enumerate(n.tolist()):
        own = doc == d
        assert length[own].sum() == size and start[own].tolist() == (np.cumsum(length[own]) - length[own]).tolist()
        assert length[own].tolist() == sorted(length[own].tolist(), reverse=True)
    assert length[doc == 9].tolist() == [4096, 4096, 4096, 4, 1]
    assert packing.cut(np.array([5]), 2)[2].tolist() == [2, 2, 1]


def test_edges_and_buckets(spark, tokenizer):
    rows = [(1, t, "x", 5) for t in ODD] + [(None, "same words", "x", 1), (None, "same words", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, length string, ids int").repartition(3)
    found = packing.pieces(docs, PATH)
    path = fresh_path(spark, "packed-test")
    back = packing.write_buckets(found, path)
    assert back.columns == found.columns == ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
    got = back.collect()
    want = [ids_of(tokenizer, r[1]).tobytes() for r in rows]
    for r in sorted(got, key=lambda r: r.start):
        assert len(r.ids) == 4 * r.length
    assert len({r.sequence_id for r in got}) == len(got)
    assert sum(len(r.ids) for r in got) == sum(map(len, want))
    by_length = defaultdict(list)
    for r in got:
        by_length[r.length].append(r.sequence_id)
    spans = sorted((min(v), max(v), k) for k, v in by_length.items())
    assert [k for *_, k in spans] == sorted(by_length) and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert packing.pieces(docs.where("false"), PATH).count() == 0
    with pytest.raises(ValueError):
        packing.pieces(docs, PATH, capacity=3000)


def test_small_batches_out(spark, tokenizer):
    text = "alpha beta gamma " * 4000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = sorted(packing.pieces(docs, PATH, capacity=64).collect(), key=lambda r: r.start)
    assert b"".join(bytes(r.ids) for r in got) == ids_of(tokenizer, text).tobytes()
