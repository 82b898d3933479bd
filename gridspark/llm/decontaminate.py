r"""Benchmark decontamination: prefix-filtered set join, in DataFrame expressions only.

A window is ``WINDOW`` consecutive words of a benchmark item (a shorter item is one window).  Its
tokens are its word shingles, ordered by rarity in the corpus.  Containment asks for every token,
so a prefix of one - the rarest - is necessary: documents are joined on that token alone.  The
token's place gives the place where the window must start; it has to fit in the document (length
and position bounds), and the words there are compared exactly.

The join side built from the benchmark is written first, so Spark broadcasts it only where its
true size is below the threshold and shuffles beyond it.

Defined results: a null or wordless text has no words and no hits; items without words have no
window.  A null item id is not listed.  Repeated items and documents count as one item and get
equal results.  Windows may be one or two words long, then their only shingle is as long.  An empty benchmark leaves
every document clean; empty documents give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from gridspark.llm.common import keyed, query, same_row, settle, table

WINDOW, SHINGLE = 10, 3
_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Texts with other capitals than A-Z: lower() would change those too.
_OTHER_CAPITALS = r"[\p{javaUpperCase}\p{javaTitleCase}&&[^A-Z]]"


def words_of(text: Column) -> Column:
    lowered = F.when(text.rlike(_OTHER_CAPITALS), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.regexp_extract_all(lowered, F.lit(_WORD), F.lit(0))


def _shingle(size: int) -> Column:
    """Hash of ``size`` words of ``words`` from ``pos`` on."""
    return F.xxhash64(F.lit(size), F.col("word"), *[F.get("words", F.col("pos") + k) for k in range(1, size)])


def _shingled(rows: DataFrame, size: int) -> DataFrame:
    """A row per word; one with null ``pos`` for rows without words."""
    return rows.select("*", F.posexplode_outer("words").alias("pos", "word")).withColumn("h", _shingle(size)).drop("word")


def windows_of(items: DataFrame, window: int, id_col="item_id", text_col="text") -> DataFrame:
    """Distinct windows and the items that have them: ``w, words, size, items``."""
    own = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.coalesce(F.col(text_col), F.lit(""))).alias("all")).withColumn("n", F.size("all")).where("n > 0")
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.col("n") - window + 1, F.lit(1)))).alias("start")
    cut = own.select("item", "all", start).select("item", F.slice("all", F.col("start"), window).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items")).select(F.monotonically_increasing_id().alias("w"), "words", F.size("words").alias("size"), "items")


def _hits(docs: DataFrame, windows: DataFrame, size: int, window: int) -> tuple[DataFrame, DataFrame]:
    """Verified occurrences ``doc_id, text_key, start, size, items`` of windows whose shingles have
    ``size`` words, and ``doc_id, text_key, n_words`` of all documents, which the same pass gives."""
    tokens = settle(_shingled(windows.where(F.col("size") >= size), size).where(F.col("pos") <= F.col("size") - size).select("w", "pos", "h"), "bench-tokens")
    token = settle(tokens.select("h").distinct(), "bench-token-set")
    seen = _shingled(docs.select(words_of(F.col("text")).alias("words")), size).select("h").join(token, "h", "left_semi").groupBy("h").agg(F.count("*").alias("n"))
    order = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "pos")
    prefix = tokens.join(seen, "h", "left").groupBy("w").agg(F.min(order).alias("first")).select("w", F.col("first.h").alias("h"), F.col("first.pos").alias("at"))
    anchored = settle(prefix.join(windows, "w").select("h", "at", F.col("words").alias("needed"), F.col("size"), "items"), "bench-windows")
    anchors = settle(anchored.select("h", F.lit(True).alias("anchor")).distinct(), "bench-anchors")
    low = F.greatest(F.col("pos") - window + 1, F.lit(0))
    near = (
        _shingled(docs.select("doc_id", "text_key", words_of(F.col("text")).alias("words")), size).join(anchors, "h", "left")
        .where("anchor or pos is null or pos = 0")  # the first word's row stays for the count of words
        .select("doc_id", "text_key", "h", "anchor", "pos", F.size("words").alias("n"), low.alias("low"), F.when(F.col("anchor"), F.slice("words", low + 1, 2 * window - 1)).alias("near"))
    )
    near = settle(near, "bench-near")
    start = F.col("pos") - F.col("at")
    fits = (start >= 0) & (start + F.col("size") <= F.col("n"))
    hits = near.where("anchor").join(anchored, "h").where(fits).where(F.slice("near", F.greatest(start - F.col("low"), F.lit(0)) + 1, F.col("size")) == F.col("needed")).select("doc_id", "text_key", start.alias("start"), "size", "items")
    return hits, near.where("pos is null or pos = 0").select("doc_id", "text_key", F.col("n").cast("long").alias("n_words"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """Per row ``doc_id, text_key, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows = keyed(docs)
    windows = settle(windows_of(items, window), "bench-all-windows")
    shortest = windows.agg(F.min("size")).first()[0] or shingle
    hits = None
    for size in range(min(shortest, shingle), shingle + 1):  # one turn, unless items are shorter than a shingle
        part, counted = _hits(rows, windows if size == shingle else windows.where(F.col("size") == size), size, window)
        hits = part if hits is None else hits.unionByName(part)
    hits = settle(hits, "bench-hits")
    by_doc = Window.partitionBy("doc_id", "text_key").orderBy("start", "size")
    reach = F.max(F.col("start") + F.col("size")).over(by_doc.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.col("start") + F.col("size") - F.greatest(F.coalesce(reach, F.lit(0)), F.col("start")), F.lit(0))
    length = hits.select("doc_id", "text_key", "start", "size").withColumn("new", new).groupBy("doc_id", "text_key").agg(F.sum("new").cast("long").alias("n_hit"))
    listed = hits.select("doc_id", "text_key", F.explode("items").alias("item")).distinct().groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = settle(length.alias("a").join(listed.alias("b"), same_row(length, listed), "left").select("a.doc_id", "a.text_key", "n_hit", "items"), "bench-found")
    some = F.coalesce("items", F.array().cast("array<string>"))
    return counted.join(found, same_row(counted, found), "left").select(
        counted["doc_id"], counted["text_key"], "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.size(some).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", some), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, id_col="doc_id", text_col="text") -> DataFrame:
    """The rows of ``docs`` that hold no window, with their own columns."""
    found = contamination(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), items, window, shingle)
    found = settle(found.where("contaminated").select("doc_id", "text_key"), "bench-contaminated")
    text_key = F.xxhash64(F.coalesce(docs[text_col], F.lit("")))
    return docs.join(found, docs[id_col].eqNullSafe(found["doc_id"]) & (text_key == found["text_key"]), "left_anti")


@query(
    "op9_prefix_decontamination",
    """WITH low AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM documents),
    item AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS ws FROM benchmark),
    win AS (SELECT DISTINCT item, least(len(ws), 10) AS size, array_to_string(ws[s : s + 9], ' ') AS w
      FROM (SELECT item, ws, unnest(generate_series(1, greatest(len(ws) - 9, 1))) AS s FROM item WHERE len(ws) > 0)),
    sizes AS (SELECT DISTINCT size FROM win),
    occ AS (SELECT doc_id, size, s, array_to_string(ws[s : s + size - 1], ' ') AS w
      FROM (SELECT doc_id, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS s FROM low, sizes WHERE len(ws) >= size)),
    hit AS (SELECT doc_id, s, occ.size, item FROM occ JOIN win USING (w)),
    spot AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(s, s + size - 1)) AS p FROM hit) GROUP BY doc_id),
    listed AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(len(ws), 0) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
      sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
    FROM low LEFT JOIN spot USING (doc_id) LEFT JOIN listed USING (doc_id)""",
)
def decontaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")
