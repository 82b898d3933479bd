"""Nulls, empty and very long texts, ties, repeated rows, empty tables and clashing column names."""

import gzip
import io
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from gridspark.llm import bagminhash, decontaminate, mixing, neural_lm, pii, quality, secrets, sharding, substrings, warc
from gridspark.llm.common import fresh_path, settle

CLASHING = ["node", "text_key", "label", "words", "h", "pos", "n", "size", "row", "word", "key", "kept", "found", "least", "shard", "item", "n_words", "first", "anchor"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)
_R = random.Random(1)
LONG = " ".join(_R.choice(["alpha", "beta", "gamma", "delta", "me@mail.example.org", "+1 555 555 5555"]) + str(_R.randrange(9)) for _ in range(20000))
PROSE = " ".join(_R.choice(["the", "and", "of", "house", "river", "stone", "light"]) + _R.choice(["", "s", "ly", "ing"]) for _ in range(200))
ROWS = [
    (1, PROSE, "en", "src0"), (1, PROSE, "en", "src0"), (2, PROSE, None, None), (None, PROSE, "en", "src1"), (3, None, "de", "src0"), (4, "", "xx", ""),
    (5, " \n\t ", None, None), (6, LONG, "en", "src0"), (7, "one", "en", "src2"), (7, "two words", "en", "src2"), (None, None, None, None), (8, "ÉÀ ß 😀 " * 30, "fr", "src3"),
]


def make(spark, rows):
    return spark.createDataFrame([(*r, None, *["x"] * len(CLASHING)) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return make(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return make(spark, ROWS).where("false")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(1, " ".join(PROSE.split()[20:40])), (1, " ".join(PROSE.split()[20:40])), (None, "one"), (2, None), (3, ""), (4, "two words")], "item_id long, text string")


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def test_personal_data(docs, nothing):
    found = settle(pii.candidates(docs), "edge")
    got = pii.spans(found, pii.train(found))
    assert got.count() == len(ROWS)
    sizes = {r.doc_id: len(r.base) for r in got.collect()}
    assert sizes[6] > 5000 and sizes[3] == 0
    none = settle(pii.candidates(nothing), "edge")
    assert pii.spans(none, pii.train(none)).count() == 0


def test_secrets(spark, docs, nothing):
    found = settle(secrets.candidates(docs), "edge")
    assert secrets.spans(found, secrets.train(docs, found)).count() == len(ROWS)
    none = settle(secrets.candidates(nothing), "edge")
    assert secrets.spans(none, secrets.train(nothing, none)).count() == 0


def test_substrings(spark, docs, nothing):
    got = rows(substrings.repeats(docs), "doc_id", "n_words", "n_removed")
    n = len(PROSE.split())
    assert (1, n, 0) in got and got.count((1, n, 0)) == 2 and (2, n, n) in got and (None, n, 0) in got and (3, 0, 0) in got and (7, 1, 0) in got and len(got) == len(ROWS)
    assert substrings.repeats(nothing).count() == 0
    words = PROSE.split()
    two = make(spark, [(9, PROSE, "en", "s"), (10, " ".join(["new"] * 5 + words[30:95] + ["end"] * 60), "en", "s"), (11, " ".join(words[:49]), "en", "s")])
    assert rows(substrings.repeats(two), "doc_id", "n_removed") == [(10, 65), (11, 0), (9, 0)]


def test_hot_passage_in_many_documents(spark):
    passage = PROSE.split()[:70]
    many = make(spark, [(i, " ".join([*(f"a{i}x{k}" for k in range(i % 7)), *passage, *(f"b{i}x{k}" for k in range(60))]), "en", "s") for i in range(300)])
    got = rows(substrings.repeats(many), "doc_id", "n_removed")
    assert [r for r in got if r[1] != (70 if r[0] else 0)] == []


def test_shards(docs, nothing):
    got = sharding.assign(docs).collect()
    assert len(got) == len(ROWS) and {r.size for r in got if r.doc_id in (3, 4)} == {1}
    assert len({r.shard for r in got if r.size == len(PROSE) + 1}) == 1 and len({r.shard for r in got if r.size == 1}) == 1
    for s in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    assert sharding.assign(nothing).count() == 0


def test_near_duplicates(docs, nothing):
    got = rows(bagminhash.classes(docs)[0], "doc_id", "class_id")
    assert got == sorted([(1, 1), (1, 1), (2, 1), (None, 1), (3, 3), (4, 3), (None, 3), (5, 5), (6, 6), (7, 7), (7, 7), (8, 8)], key=str)
    assert bagminhash.classes(nothing)[0].count() == 0
    one = bagminhash.representatives(docs)
    assert one.columns == docs.columns and one.count() == 7 and one.where(F.col("text") == PROSE).count() == 1
    assert bagminhash.representatives(nothing).count() == 0


def test_quality(docs, nothing):
    refs = quality.references(docs)
    assert rows(quality.judge(docs, refs).where("doc_id = 3 or doc_id = 4"), "n_words", "base_failed", "kept") == [(0, True, False)] * 2
    assert quality.kept_rows(docs, refs).columns == docs.columns
    none = quality.references(nothing)
    assert quality.judge(nothing, none).count() == 0
    assert none.languages == [] and quality.judge(docs.where("doc_id = 2"), none).first().kept
    assert quality.judge(nothing, refs).count() == 0 and quality.kept_rows(nothing, refs).count() == 0


def test_language_model(docs, nothing):
    got = rows(neural_lm.scores(docs), "doc_id", "n_tokens")
    assert got.count((None, 1)) == 1 and (3, 1) in got and (6, len(LONG.split()) + 1) in got and len(got) == len(ROWS)
    assert neural_lm.scores(nothing).count() == 0
    held = neural_lm.scores(docs.where("crc32(cast(doc_id as string)) % 7 = 2"))  # no training documents
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.base_score == 0 for r in held.collect())


def test_decontamination(spark, docs, nothing, items):
    got = rows(decontaminate.contamination(docs, items), "doc_id", "n_hit", "n_items", "contaminated")
    assert got.count((1, 20, 1, True)) == 2 and (None, 20, 1, True) in got and (7, 2, 1, True) in got and (7, 1, 0, True) in got and (3, 0, 0, False) in got and len(got) == len(ROWS)
    assert decontaminate.contamination(nothing, items).count() == 0
    assert not any(r.contaminated for r in decontaminate.contamination(docs, items.where("false")).collect())
    left = decontaminate.clean(docs, items)
    assert left.columns == docs.columns and left.count() == 6


def test_other_capitals_are_left_alone(spark):
    docs = spark.createDataFrame([(1, "É One TWO three"), (2, "é ONE two THREE"), (3, "x" + "Σ" * 3 + "-a")], "doc_id long, text string")
    item = spark.createDataFrame([(1, "É one two three")], "item_id long, text string")
    assert rows(decontaminate.contamination(docs, item), "doc_id", "n_hit", "n_words") == [(1, 4, 4), (2, 0, 4), (3, 0, 2)]


def test_mixing(docs, nothing):
    given = mixing.rows_of(docs)
    got = mixing.weighted(given, mixing.Mix(given))
    assert got.count() == len(ROWS) and got.where("probability < 0 or probability > 1 or weight is null").count() == 0
    drawn = mixing.draw(docs, mixing.Mix(given))
    assert drawn.columns == docs.columns
    assert mixing.weighted(mixing.rows_of(nothing), mixing.Mix(mixing.rows_of(nothing))).count() == 0


def test_warc(spark):
    big = "x" * (17 << 20)  # its member would not end in a zero byte
    pages = spark.createDataFrame([(1, "http://a/ b\n", "same", 1), (2, None, "same", 2), (2, "u", "same", 2), (None, "u", "same", 3), (3, "u", None, 4), (4, "u", "", 5), (5, "é", "é\r\n\r\nWARC/1.1\0", 6), (6, "u", big, 7)], "page_id long, url string, html string, sha1 int")
    path = fresh_path(spark, "warc-test")
    warc.write_archives(pages.repartition(2), path)
    small = rows(warc.read_archives(spark, path, range_bytes=100), "record_id", "record_type", "refers_to", "payload_bytes")
    assert small == rows(warc.read_archives(spark, path), "record_id", "record_type", "refers_to", "payload_bytes")
    assert small == sorted([("1", "revisit", "2", 4), ("2", "response", None, 4), ("2", "response", None, 4), (None, "revisit", "2", 4), ("3", "revisit", "4", 0), ("4", "response", None, 0), ("5", "response", None, 15), ("6", "response", None, 17 << 20)], key=str)
    got = {r.record_id: bytes(r.payload) for r in warc.read_archives(spark, path).where("record_type = 'response'").collect()}
    assert got["5"] == "é\r\n\r\nWARC/1.1\0".encode() and got["6"] == big.encode()
    none = fresh_path(spark, "warc-none")
    warc.write_archives(pages.where("false"), none)
    assert warc.read_archives(spark, none).count() == 0


def test_reading_tasks_grow_with_the_bytes(spark):
    path = fresh_path(spark, "warc-tasks")
    warc.write_archives(spark.createDataFrame([(i, "u", f"{i} " * 400) for i in range(300)], "page_id long, url string, html string").repartition(2), path)
    found = warc.read_archives(spark, path, range_bytes=40)
    assert found.rdd.getNumPartitions() > 8 * spark.sparkContext.defaultParallelism and found.count() == 300
    assert warc.read_archives(spark, path).rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism


def test_archives_are_plain_gzip(spark):
    path = fresh_path(spark, "warc-gzip")
    warc.write_archives(spark.createDataFrame([(i, "u", f"text {i}") for i in range(20)], "page_id long, url string, html string").coalesce(1), path)
    data = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    assert gzip.decompress(data).count(b"WARC-Type: response") == 20


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())

    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


def test_false_magic_and_range_edges():
    """Magic inside a stored member and between members starts no record; each record is owned once."""
    import zlib

    def member(body, level):
        pack = zlib.compressobj(level, zlib.DEFLATED, 31)
        return pack.compress(body) + pack.flush()

    inner = member(b"WARC/1.0\r\nWARC-Type: response\r\n\r\nx", 6)
    plain = [b"WARC/1.0\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n" % len(b) + b for b in (b"one", inner + b"tail", b"\x1f\x8b\x08\x00junk", b"last")]
    data = b"".join(member(p, 0) for p in plain)
    for step in (1, 7, 64, 1000):
        got = [c for low in range(0, len(data), step) for _, c in warc.records_in(_File(data), low, min(low + step, len(data)))]
        assert got == plain, step


def test_every_stage(spark, docs, nothing, tmp_path):
    items = spark.createDataFrame([(1, "alpha beta gamma delta " * 5)], "item_id long, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for given in (docs, nothing):
            out = settle(stage(spark, given, str(tmp_path)), "edge")
            assert out.count() <= given.count()
            if name != "shards":
                assert out.columns == given.columns
