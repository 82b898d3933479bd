"""That the operators do the whole job: nothing sampled, capped or let through."""

from collections import Counter

import numpy as np
import pyarrow as pa

from gridspark.llm import neural_lm, quality, words


def packed(positions, rounds):
    for r in positions.collect():
        yield [np.frombuffer(r[f"packed{k}"], "<u2").reshape(-1, 3) for k in range(rounds)]


def test_model_is_trained_on_every_position(spark):
    """Each position of each document, also of the shortest, falls in one round; all rounds have some."""
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 30, n)) for n in [1, 2, 3, 0, 400, 1, 2500]]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    counts = docs.mapInArrow(neural_lm._count, "word long, n long").groupBy("word").agg({"n": "sum"}).toDF("word", "n")
    lex = neural_lm.lexicon(counts)
    rounds = neural_lm.ROUNDS
    got = [np.concatenate(x) for x in zip(*packed(neural_lm.positions_of(docs, lex), rounds))]
    assert min(map(len, got)) > 0.8 * sum(map(len, got)) / rounds
    want = sum(len(t.split()) + 1 for t in texts)
    assert sum(map(len, got)) == want == lex.tokens
    targets = Counter(np.concatenate(got)[:, 2].tolist())
    assert [targets[k] for k in range(len(lex.unigram))] == lex.unigram.tolist()


def test_words_beyond_the_vocabulary_fall_in_narrow_classes(spark):
    """Classes follow the counts, none holds most of the tokens, and shares within them sum to 1."""
    rng = np.random.default_rng(9)
    draws = Counter(rng.zipf(1.3, 60000).tolist())
    counts = spark.createDataFrame([*((int(words.mixed(np.uint64(k)).view(np.int64)), n) for k, n in draws.items()), (int(neural_lm._END_WORD.view(np.int64)), 100)], "word long, n long")
    lex = neural_lm.lexicon(counts, common=2000, vocabulary=50, classes=100)
    other = lex.unigram[51:]
    assert lex.tokens == 60100 == lex.unigram.sum() and len(draws) > 2000 and 80 < len(other) <= 103 and 1 < len(lex.unigram) - lex.rare
    assert other.max() < 0.05 * other.sum()
    h = words.mixed(np.array(list(draws), dtype=np.uint64))
    symbol, known = neural_lm._looked_up(lex, h)
    n = np.array(list(draws.values()))
    assert set(known[known >= 0].tolist()) <= set(n[known >= 0].tolist()) and (known < 0).any()
    assert np.bincount(symbol, n, len(lex.unigram))[1:].tolist() == lex.unigram[1:].tolist()
    share = np.bincount(symbol, 10 ** lex.within(symbol, n), len(lex.unigram))[1:]
    unseen = np.where(np.arange(1, len(lex.unigram)) >= lex.rare, 1 / (lex.unigram + lex.spare)[1:], 0)
    assert np.allclose(share + unseen, 1)


def test_each_distance_rejects_junk_and_keeps_good(spark):
    """Planted junk that passes the base rules: odd characters among plain words, and odd words in plain characters."""
    rng = np.random.default_rng(11)
    common = [a + b for a in "bcdfglmnprst" for b in ("a", "en", "ir", "os", "un")]
    odd = lambda: "".join(rng.choice(list("aeinorstl"), 9))
    weight = 1 / np.arange(1, len(common) + 1)
    prose = lambda n: " ".join(rng.choice(common, p=weight / weight.sum()) if rng.random() < 0.6 else odd() for _ in range(n))
    rows = [(i, prose(int(np.exp(rng.uniform(np.log(60), np.log(1100))))), "en") for i in range(600)]
    refs = quality.references(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    good = [prose(n) for n in (60, 120, 300, 900) for _ in range(5)]
    unknown = [" | ".join(odd() for _ in range(n)) for n in (100, 200, 600)]
    strange = [" ".join(x if rng.random() < 0.55 else "%#7$2&" + str(rng.integers(10**9, 10**10)) for x in prose(n).split()) for n in (80, 200, 600)]
    got = quality.measured(pa.array(good + unknown + strange), pa.array(["en"] * 26), refs)
    limit = lambda limits, n: limits[0][quality._band(got[n])]
    by_char, by_word = got["char_js"] > limit(refs.char_limit, "n_chars"), got["word_js"] > limit(refs.word_limit, "n_words")
    assert not got["base_failed"].any()
    assert got["kept"].tolist() == [True] * len(good) + [False] * 6
    assert by_word[20:23].all() and by_char[23:].all() and not by_char[:20].any() and not by_word[:20].any()
    assert quality.measured(pa.array(unknown + strange), pa.array([None, "xx", "de", None, "xx", "de"]), refs)["kept"].all()  # no reference, no verdict


def _prose(rng, letters, weight):
    words_ = ["".join(rng.choice(list(letters), 3)) for _ in range(80)]
    return lambda n: " ".join(rng.choice(words_, p=weight / weight.sum()) if rng.random() < 0.6 else "".join(rng.choice(list(letters), 7)) for _ in range(n))


def test_languages_come_from_the_data(spark):
    """A fifth language in another script has its own reference; wrong labels, rare languages and none are kept."""
    rng = np.random.default_rng(12)
    weight = 1 / np.arange(1, 81)
    latin, greek, thai = (_prose(rng, x, weight) for x in ("abcdefgh", "αβγδεζηθ", "กขคงจฉชซ"))
    length = lambda: int(rng.integers(80, 400))
    rows = [(i, latin(length()), "en") for i in range(300)] + [(1000 + i, greek(length()), "el") for i in range(150)] + [(2000 + i, thai(length()), "th") for i in range(5)]
    rows += [(3000, greek(200), "en"), (3001, greek(200), None), (3002, "", "el"), (3003, " ".join("x%d" % rng.integers(10**9) for _ in range(300)), "el")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    refs = quality.references(docs)
    assert refs.languages == ["el", "en"]
    got = {r.doc_id: r for r in quality.judge(docs, refs).collect()}
    assert [i for i, r in got.items() if not r.kept] == [3002, 3003]
    assert got[2000].char_js is None and got[3001].word_js is None and got[3000].char_js > got[1000].char_js
    assert {r.doc_id for r in quality.kept_rows(docs, refs).collect()} == set(got) - {3002, 3003}


def test_copies_do_not_decide_what_is_usual(spark):
    """A third of all rows are near copies of one text: other texts of that length stay."""
    rng = np.random.default_rng(13)
    prose = _prose(rng, "abcdefgh", 1 / np.arange(1, 81))
    copy = prose(200).split()
    rows = [(i, prose(int(rng.integers(150, 260))), "en") for i in range(400)]
    for i in range(200):
        own = list(copy)
        own[int(rng.integers(200))] = f"x{i}"
        rows.append((1000 + i, " ".join(own), "en"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert quality.kept_rows(docs, quality.references(docs)).count() == len(rows)


def test_model_beats_its_own_counts_on_held_out_text(spark):
    """On documents that were not trained on, the model's score per token exceeds that of its symbols' shares alone."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [r for r in neural_lm.scores(docs).collect() if r.held_out]
    folded = neural_lm._folded(docs, "doc_id", "text")
    counts = folded.where("not held_out").select("text").mapInArrow(neural_lm._count, "word long, n long").groupBy("word").agg({"n": "sum"}).toDF("word", "n")
    lex = neural_lm.lexicon(counts)
    share, total, tokens = np.log10(np.maximum(lex.unigram, 0.5) / np.maximum(lex.unigram, 0.5).sum()), 0.0, 0
    for r in folded.where("held_out").collect():
        for w in words.blocks(pa.array([r.text]), lower=True):
            symbol, count = neural_lm._looked_up(lex, words.word_hashes(w))
            total += share[symbol].sum() + share[neural_lm.END] + lex.within(symbol, np.maximum(count, 0)).sum()
            tokens += len(symbol) + 1
    gain = (sum(r.score for r in rows) - total) / tokens
    print(f"held-out gain: {gain:.4f} log10 a token over {tokens} tokens")
    assert tokens == sum(r.n_tokens for r in rows) and gain > MARGIN


MARGIN = 0.02  #: log10 a token on sf0.01
