r"""Secrets by patterns and by character Markov models, in DataFrame expressions only.

Two first-order character models are trained from labelled samples: random strings (the values
that the base patterns mark) and ordinary identifiers (words of a sample of documents outside
those spans).  Long tokens are scored by the log-likelihood ratio of the two models; those
beyond a threshold are added to the base spans.  The models are tables of the alphabet squared;
only these counts reach the driver.

The identifiers come from a bounded sample: about ``SAMPLE_DOCS`` documents, chosen by a hash of
their text.  All documents are scored, and all base spans train the random model.

Defined results: a null text counts as empty and has no spans.  Rows are judged one by one, so
repeated rows get equal results, and ids may be null; further columns are ignored.  An added
span that overlaps a base span is dropped.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm import spans as S
from gridspark.llm.common import query, settle, table

KINDS = ["assign", "access", "hex", "random"]
MIN_LENGTH = 20  #: of a token that the models judge
SAMPLE_DOCS = 5000
THRESHOLD = 12.0  #: log-likelihood ratio from which a token counts as random
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_START = len(ALPHABET)  #: the state before the first character
PRIOR = 0.5  #: pseudo-count of every transition

PATTERNS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*+[:=]\x20*+["']?[A-Za-z0-9+/_.=-]++""",
    "access": r"AKIA[A-Z0-9]{16,}+",
    "hex": r"[0-9a-f]{24,}+",
    "random": rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_LENGTH},}}+",
}
_VALUE = r"""^[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""
_IDENTIFIER = r"[A-Za-z_][A-Za-z0-9_-]{7,}+"


def candidates(docs: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """``row, doc_id, found``: per row (by a number of its own) base spans and long tokens, ``kind, start, end, value``."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("row", "doc_id", "text", *[S.matches(F.col("text"), p, "AKIA" if k == "access" else None).alias(f"m_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("row", "doc_id", *[S.pieces(F.col("text"), p, F.col(f"m_{k}")).alias(f"p_{k}") for k, p in PATTERNS.items()])
    rows = rows.select("row", "doc_id", *[f"p_{k}" for k in KINDS], *[S.offsets(F.col(f"p_{k}")).alias(f"o_{k}") for k in KINDS])

    def one(kind):
        return lambda m: F.struct(F.lit(KINDS.index(kind)).alias("kind"), m["start"].alias("start"), m["end"].alias("end"), (F.regexp_replace(m["value"], _VALUE, "") if kind == "assign" else m["value"]).alias("value"))

    own = {k: F.transform(S.placed(F.col(f"p_{k}"), F.col(f"o_{k}")), one(k)) for k in KINDS}
    own["assign"] = F.filter(own["assign"], lambda m: F.char_length(m["value"]) >= 6)
    return rows.select("row", "doc_id", F.concat(*own.values()).alias("found"))


def _transitions(tokens: DataFrame) -> dict[tuple[int, int], int]:
    """Counts of (state, next) over a column ``value``: at most the alphabet squared."""
    pair = F.explode(F.transform(F.sequence(F.lit(1), F.char_length("value")), lambda i: F.substring(F.concat(F.lit(" "), F.col("value")), i, F.lit(2)))).alias("pair")
    counts = tokens.where(F.char_length("value") > 0).select(pair).groupBy("pair").agg(F.count("*").alias("n")).collect()
    place = {c: i for i, c in enumerate(ALPHABET)} | {" ": _START}
    return {(place[r["pair"][0]], place[r["pair"][1]]): r["n"] for r in counts if all(c in place for c in r["pair"])}


def log_model(counts: dict[tuple[int, int], int]) -> list[list[float]]:
    """Log probability of each next character after each state, smoothed."""
    out = []
    for a in range(len(ALPHABET) + 1):
        row = [counts.get((a, b), 0) + PRIOR for b in range(len(ALPHABET))]
        out.append([math.log(x / sum(row)) for x in row])
    return out


def train(docs: DataFrame, found: DataFrame, sample: int = SAMPLE_DOCS, text_col="text") -> list[float]:
    """The log-likelihood ratio of every transition, by state and next character."""
    n = docs.count()
    marked = found.select(F.explode("found").alias("f")).where(f"f.kind < {KINDS.index('random')}").select("f.value").where(F.char_length("value") >= 16)
    share = min(1.0, sample / max(n, 1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    some = docs.select(text.alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    bare = F.col("text")
    for kind in KINDS[:-1]:
        bare = F.regexp_replace(bare, PATTERNS[kind], " ")
    words = some.select(F.explode(F.regexp_extract_all(bare, F.lit(_IDENTIFIER), F.lit(0))).alias("value"))
    chance, ordinary = log_model(_transitions(marked)), log_model(_transitions(words))
    return [c - o for a, b in zip(chance, ordinary) for c, o in zip(a, b)]


def ratio(value: Column, table_: list[float]) -> Column:
    """Log-likelihood ratio of a token: above 0 it is more like a random string."""
    weights = F.split(F.lit(",".join(f"{x:.6f}" for x in table_)), ",").cast("array<double>")
    state = lambda i: F.instr(F.lit(ALPHABET), F.substring(value, i, F.lit(1))) - 1
    return F.aggregate(
        F.sequence(F.lit(1), F.char_length(value)), F.struct(F.lit(_START).alias("at"), F.lit(0.0).alias("sum")),
        lambda acc, i: F.struct(state(i).alias("at"), (acc["sum"] + F.get(weights, acc["at"] * len(ALPHABET) + state(i))).alias("sum")), lambda acc: acc["sum"],
    )


def spans(found: DataFrame, table_: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, base, added``; ``found`` is a written table."""
    last = KINDS.index("random")
    plain = lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))
    chosen = F.filter(F.filter("found", lambda c: c["kind"] == last), lambda c: ratio(c["value"], table_) > threshold)
    split = found.select("row", "doc_id", F.transform(F.filter("found", lambda c: c["kind"] < last), plain).alias("base"), F.transform(chosen, plain).alias("more"))
    return split.join(S.apart(split), "row", "left").select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("added"))


@query("op3_markov_secrets")
def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = settle(candidates(docs), "secret-candidates")
    out = spans(found, train(docs, found))
    n = [S.count_of("base", k).alias(f"n_{KINDS[k]}") for k in range(3)]
    return out.select("doc_id", *n, S.sha256(S.joined(F.col("base"), KINDS)).alias("base_sha256"), S.joined(F.concat("base", "added"), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"))
