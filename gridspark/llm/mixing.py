r"""Mixing sources to target weights by iterative proportional fitting (raking).

Token masses by source, language and form of the text are scaled to the target share of each
margin in turn, a fixed number of rounds.  A cell's weight - fitted over given mass - is at most
``1 / keep``, and ``keep`` times the weight is the probability with which each of its documents
is drawn, so an expected share ``keep`` of all tokens stays, mixed as asked as far as the caps allow;
``Mix.report`` tells for every category what share was asked for and what is reached.

Targets are given as tables, or follow from the data: every category that holds ``LEAST_SHARE`` of the
tokens or more gets a share in proportion to its own to the power of ``TEMPER``, which lifts rare ones.
Other categories, and nulls, form one class per margin that keeps its own share.  A margin thus
has at most ``1 / LEAST_SHARE`` classes besides, or those of its table, and only sums by occurring
cell reach the driver.  The form of a text is table, symbols, lines or prose.

Defined results: a null text counts as empty (no tokens, form prose).  A document is drawn by a
hash of its id (nulls by one of their own), so repeated rows stay or go together and any run draws the same.  Further
columns are kept by ``draw`` and ignored by ``weighted``.  Very long texts are only counted.  An empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from gridspark.llm.common import query, settle, table

MARGINS = ("source", "lang", "form")
TEMPER, LEAST_SHARE = 0.9, 1e-3
KEEP, ROUNDS = 0.6, 20
_WORD = r"[^\x20\x09-\x0D]+"
_CLASSES = [f"{m}_class" for m in MARGINS]


def form(text: Column) -> Column:
    return (
        F.when(F.contains(text, F.lit(" | ")), "table")
        .when(F.regexp_count(text, F.lit("[#*$%&<>]")) * 50 > F.char_length(text), "symbols")
        .when(F.regexp_count(text, F.lit("\n")) * 60 > F.char_length(text), "lines").otherwise("prose")
    )


def tempered(mass: dict[str, float], temper: float = TEMPER) -> dict[str, float]:
    """Target shares in proportion to a power of the categories' own."""
    total = sum(mass.values())
    raised = {c: (m / total) ** temper for c, m in mass.items()}
    return {c: r / sum(raised.values()) for c, r in raised.items()}


def wanted(mass: dict[tuple, float], targets: list[dict[str, float]]) -> list[dict]:
    """Share of each class of each margin: None keeps its own, the rest is dealt by the targets of those that occur."""
    total, out = sum(mass.values()), []
    for axis, asked in enumerate(targets):
        own: dict = {}
        for cell, m in mass.items():
            own[cell[axis]] = own.get(cell[axis], 0.0) + m / total
        free, known = 1 - own.get(None, 0.0), sum(asked[c] for c in own if c is not None) or 1.0
        out.append({c: s if c is None else asked[c] / known * free for c, s in own.items()})
    return out


def rake(mass: dict[tuple, float], targets: list[dict[str, float]], keep: float = KEEP, rounds: int = ROUNDS) -> dict[tuple, float]:
    """Weight of each cell; ``mass`` has positive tokens by (class per margin), None for those without a target."""
    total, shares = sum(mass.values()), wanted(mass, targets)
    fitted = dict(mass)
    for _ in range(rounds):
        for axis, share in enumerate(shares):
            sums: dict = {}
            for cell, m in fitted.items():
                sums[cell[axis]] = sums.get(cell[axis], 0.0) + m
            fitted = {cell: m * share[cell[axis]] * total / sums[cell[axis]] if sums[cell[axis]] else 0.0 for cell, m in fitted.items()}
        fitted = {cell: min(m, mass[cell] / keep) for cell, m in fitted.items()}
    return {cell: fitted[cell] / mass[cell] for cell in mass}


class Share(NamedTuple):
    margin: str
    category: str | None  #: None for all categories without a target
    target: float
    reached: float  #: share of the expected tokens drawn


class Mix:
    """Raked weights, and their application to a table with the same columns."""

    def __init__(self, rows: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, rounds: int = ROUNDS):
        """``rows``: ``source, lang, form, n_tokens`` of every document; ``targets`` by margin, of those that have a table."""
        self.spark, self.keep, targets = rows.sparkSession, keep, targets or {}
        total = rows.agg(F.sum("n_tokens")).first()[0] or 0
        self.targets = []
        for m in MARGINS:
            if m in targets:
                self.targets.append(dict(targets[m]))
                continue
            sums = rows.where(F.col(m).isNotNull()).groupBy(m).agg(F.sum("n_tokens").alias("n"))
            named = sums.where((F.col("n") > 0) & (F.col("n") >= LEAST_SHARE * total)).collect()
            mass = {r[0]: float(r[1]) for r in sorted(named, key=lambda r: r[0])}
            self.targets.append(tempered(mass) if mass else {})
        cells = rows.groupBy(*self.classes({m: F.col(m) for m in MARGINS})).agg(F.sum("n_tokens").alias("n")).where("n > 0").collect()
        self.mass = {tuple(c)[:3]: float(c["n"]) for c in sorted(cells, key=lambda c: str(tuple(c)[:3]))}
        self.weights = rake(self.mass, self.targets, keep, rounds) if self.mass else {}

    def classes(self, values: dict[str, Column]) -> list[Column]:
        """The categories that have a target; NULL for others."""
        return [F.when(values[m].isin(list(t)), values[m]).alias(c) if t else F.lit(None).cast("string").alias(c) for m, t, c in zip(MARGINS, self.targets, _CLASSES)]

    def report(self) -> list[Share]:
        """Target and reached share of every category."""
        if not self.mass:
            return []
        drawn, out = sum(m * self.weights[c] for c, m in self.mass.items()), []
        for axis, (margin, share) in enumerate(zip(MARGINS, wanted(self.mass, self.targets))):
            for category, target in share.items():
                reached = sum(m * self.weights[c] for c, m in self.mass.items() if c[axis] == category) / drawn
                out.append(Share(margin, category, target, reached))
        return out

    def table(self) -> DataFrame:
        """Weight of every cell, and by how much each margin's reached share exceeds its target there."""
        missed = {(s.margin, s.category): s.reached - s.target for s in self.report()}
        cells = [(*c, w, *(missed[m, x] for m, x in zip(MARGINS, c))) for c, w in self.weights.items()]
        schema = ", ".join([*(f"_{c} string" for c in _CLASSES), "weight double", *(f"{m}_miss double" for m in MARGINS)])
        return settle(self.spark.createDataFrame(cells, schema), "mixing-weights")

    def applied(self, rows: DataFrame, values: dict[str, Column]) -> DataFrame:
        """``rows`` with ``weight`` (1 for cells without tokens), ``probability`` and the misses of its classes."""
        given = rows.withColumns(dict(zip((f"__{c}" for c in _CLASSES), self.classes(values))))
        weights = self.table()
        same = [F.col(f"__{c}").eqNullSafe(weights[f"_{c}"]) for c in _CLASSES]
        out = given.join(weights, same, "left").drop(*[weights[f"_{c}"] for c in _CLASSES])
        out = out.withColumn("weight", F.coalesce("weight", F.lit(1.0)))
        return out.withColumn("probability", F.least(F.lit(1.0), F.col("weight") * self.keep))


def _drawn(id_: Column, probability: Column) -> Column:
    draw = F.conv(F.substring(F.md5(F.coalesce(id_.cast("string"), F.lit("null"))), 1, 8), 16, 10).cast("double") / F.lit(2.0**32)
    return draw < probability


def _values(source: Column, lang: Column, text: Column) -> dict[str, Column]:
    return {"source": source.cast("string"), "lang": lang.cast("string"), "form": form(F.coalesce(text, F.lit("")))}


def rows_of(docs: DataFrame, id_col="doc_id", source_col="source", lang_col="lang", text_col="text") -> DataFrame:
    """``doc_id, source, lang, form, n_tokens`` of every row."""
    values = _values(docs[source_col], docs[lang_col], docs[text_col])
    return docs.select(docs[id_col].alias("doc_id"), *[c.alias(m) for m, c in values.items()], F.regexp_count(F.coalesce(docs[text_col], F.lit("")), F.lit(_WORD)).cast("long").alias("n_tokens"))


def weighted(rows: DataFrame, mix: Mix) -> DataFrame:
    """Classes, weight, probability, draw and misses of every row of ``rows_of``."""
    out = mix.applied(rows, {m: F.col(m) for m in MARGINS}).withColumn("drawn", _drawn(F.col("doc_id"), F.col("probability")))
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in _CLASSES], "n_tokens", "weight", "probability", "drawn", *[f"{m}_miss" for m in MARGINS])


def draw(docs: DataFrame, mix: Mix, id_col="doc_id", source_col="source", lang_col="lang", text_col="text") -> DataFrame:
    """The drawn rows of ``docs`` with their own columns."""
    packed = docs.select(F.struct(*docs.columns).alias("row"))
    row = lambda c: F.col("row")[c]
    out = mix.applied(packed, _values(row(source_col), row(lang_col), row(text_col)))
    return out.where(_drawn(row(id_col), F.col("probability"))).select("row.*")


def _sql() -> str:
    axes = dict(zip("slt", MARGINS))
    ctes = [
        """d AS (SELECT doc_id, source, lang, CASE WHEN contains(text, ' | ') THEN 'table'
          WHEN len(regexp_extract_all(text, '[#*$%&<>]')) * 50 > length(text) THEN 'symbols'
          WHEN len(regexp_extract_all(text, '\\n')) * 60 > length(text) THEN 'lines' ELSE 'prose' END AS form,
          CAST(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n FROM (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents))""",
        "whole AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM d)",
    ]
    for a, m in axes.items():
        ctes.append(f"k{a} AS (SELECT {m} AS {a} FROM d, whole WHERE {m} IS NOT NULL GROUP BY {m} HAVING sum(n) > 0 AND sum(n) >= {LEAST_SHARE} * max(total))")
    ctes += [
        "c AS MATERIALIZED (SELECT doc_id, n, ks.s, kl.l, kt.t FROM d LEFT JOIN ks ON source = ks.s LEFT JOIN kl ON lang = kl.l LEFT JOIN kt ON form = kt.t)",
        "f0 AS (SELECT s, l, t, CAST(sum(n) AS DOUBLE) AS m, CAST(sum(n) AS DOUBLE) AS x FROM c GROUP BY ALL HAVING sum(n) > 0)",
    ]
    for a in axes:
        ctes.append(
            f"""w{a} AS (SELECT {a}, CASE WHEN {a} IS NULL THEN m ELSE pow(m / total, {TEMPER}) / sum(CASE WHEN {a} IS NOT NULL THEN pow(m / total, {TEMPER}) END) OVER ()
            * (total - coalesce(max(CASE WHEN {a} IS NULL THEN m END) OVER (), 0)) END AS want FROM (SELECT {a}, sum(m) AS m FROM f0 GROUP BY 1), whole)"""
        )
    last = "f0"
    for r in range(ROUNDS):
        for a in axes:
            ctes.append(f"f{r}{a} AS MATERIALIZED (SELECT f.s, f.l, f.t, m, x * want / sum(x) OVER (PARTITION BY f.{a}) AS x FROM {last} f JOIN w{a} ON f.{a} IS NOT DISTINCT FROM w{a}.{a})")
            last = f"f{r}{a}"
        ctes.append(f"f{r}cap AS MATERIALIZED (SELECT s, l, t, m, least(x, m / {KEEP}) AS x FROM {last})")
        last = f"f{r}cap"
    for a in axes:
        ctes.append(f"r{a} AS (SELECT w{a}.{a}, reached - want / total AS miss FROM (SELECT {a}, sum(x) / (SELECT sum(x) FROM {last}) AS reached FROM {last} GROUP BY 1) q JOIN w{a} ON q.{a} IS NOT DISTINCT FROM w{a}.{a}, whole)")
    same = " AND ".join(f"c.{a} IS NOT DISTINCT FROM f.{a}" for a in axes)
    misses = ", ".join(f"CASE WHEN f.m IS NOT NULL THEN round(r{a}.miss, 6) END AS {m}_miss" for a, m in axes.items())
    joins = " ".join(f"LEFT JOIN r{a} ON c.{a} IS NOT DISTINCT FROM r{a}.{a}" for a in axes)
    named = ", ".join(f"c.{a} AS {m}_class" for a, m in axes.items())
    return f"""WITH {', '.join(ctes)}, g AS (SELECT doc_id, {named}, n AS n_tokens, coalesce(x / m, 1) AS weight, {misses} FROM c LEFT JOIN {last} f ON {same} {joins})
    SELECT doc_id, source_class, lang_class, form_class, n_tokens, round(weight, 6) AS weight, round(least(1, weight * {KEEP}), 6) AS probability,
      CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0 < least(1, weight * {KEEP}) AS drawn, source_miss, lang_miss, form_miss FROM g"""


@query("op1_raked_mixture", _sql())
def raked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = settle(rows_of(table(spark, sf_dir, "documents")), "mixing-rows")
    out = weighted(rows, Mix(rows))
    return out.withColumns({c: F.round(c, 6) for c in ("weight", "probability", *(f"{m}_miss" for m in MARGINS))})
