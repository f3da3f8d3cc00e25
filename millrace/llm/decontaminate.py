"""Benchmark decontamination as a prefix-filtered set join, in DataFrame operations only.

A window is WINDOW consecutive words of a benchmark item (or a shorter item as a whole). Its
shingles (three words, or fewer in shorter windows) are ordered by how often they occur in the
documents. Whole containment makes a prefix of one shingle necessary, so only the rarest shingle
of each window is joined, against every position of every document. A candidate must then start
inside the document and end inside it (position and length bounds), and the words of the
document under the window are compared with the window's own.

The joined side is the windows of the benchmark, counted first: beyond BLOCK_ROWS they are
joined in blocks of that many rows, so that a broadcast never exceeds its bound.

Defined cases: a null or empty text has no words and is hit nowhere; an item without words, or
without an id, is in no one's list of items; repeated rows get a row of the result each; an empty
benchmark leaves every document clean; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import LOWER, UPPER, Scratch, apart, table

WINDOW = 8
SHINGLE = 3
MIN_ITEMS = 2
BLOCK_ROWS = 100_000
#: What is between words; upper case A-Z belongs to words, which are lower-cased one by one.
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def fold(word: Column) -> Column:
    """Lower-cases A-Z only."""
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, UPPER, LOWER))


def _split(df: DataFrame, text_col: str) -> DataFrame:
    """Adds `_w` (folded words with an empty string at either end, perhaps), `_lo` (its first word) and `_n` (words)."""
    body = F.coalesce(F.col(text_col), F.lit(""))
    plain = F.length(body) == F.octet_length(body)
    words = F.when(plain, F.split(F.lower(body), GAP, -1)).otherwise(F.transform(F.split(body, GAP, -1), fold))
    df = df.withColumn("_w", words)
    df = df.withColumn("_lo", (F.get("_w", F.lit(0)) == "").cast("int"))
    empty_end = ((F.size("_w") > 1) & (F.get("_w", F.size("_w") - 1) == "")).cast("int")
    return df.withColumn("_n", F.size("_w") - F.col("_lo") - empty_end)


def _key(words: list[Column]) -> Column:
    """Hash of a shingle; null where a word is missing."""
    return F.when(words[-1].isNotNull(), F.xxhash64(*words, F.lit(len(words))))


def _positions(docs: DataFrame, sizes: list[int], keep: list[str]) -> DataFrame:
    """A row for every word position and shingle size (one at least per document): `keep`, `_w`, `_lo`, `_n`, `_pos`, `_h`.

    What follows must stay in generated code up to the join: rows that were copied here would
    each hold all words of their document.
    """
    at = docs.select(*keep, "_w", "_lo", "_n", F.explode(F.sequence(F.lit(0), F.greatest(F.col("_n") - 1, F.lit(0)))).alias("_pos"))
    word = lambda i: F.when(F.col("_pos") + i < F.col("_n"), F.get("_w", F.col("_lo") + F.col("_pos") + i))
    keys = [_key([word(i) for i in range(k)]) for k in sizes]
    return at.withColumn("_h", keys[0] if len(keys) == 1 else F.explode(F.array(*keys)))


def _windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows: `_win` (words), `_items` (ids of the items that have it)."""
    words = F.slice("_w", F.col("_lo") + 1, F.col("_n"))
    it = _split(items, text_col).filter("_n > 0").select(F.col(item_col).alias("_item"), words.alias("_words"))
    length = F.least(F.size("_words"), F.lit(window))
    cut = F.transform(F.sequence(F.lit(1), F.size("_words") - length + 1), lambda i: F.slice("_words", i, length))
    return it.select("_item", F.explode(cut).alias("_win")).groupBy("_win").agg(F.collect_set("_item").alias("_items"))


def _shingles(k: int) -> Column:
    """Offsets and hashes of a window's shingles of k words."""

    def one(o: Column) -> Column:
        return F.struct(o.alias("_off"), F.xxhash64(*(F.get("_win", o + i) for i in range(k)), F.lit(k)).alias("_h"))

    return F.transform(F.sequence(F.lit(0), F.size("_win") - k), one)


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    window: int = WINDOW,
    min_items: int = MIN_ITEMS,
) -> DataFrame:
    """One row per document: `id_col`, text_hash, n_words, n_hit, items (sorted as strings), contaminated."""
    scratch = Scratch(docs.sparkSession)
    wins = scratch.put(_windows(benchmark, item_col, "text", window).withColumn("_wid", F.monotonically_increasing_id()), "windows")
    size = F.least(F.size("_win"), F.lit(SHINGLE))
    sizes = sorted((r[0] for r in wins.select(size).distinct().collect()), reverse=True) or [SHINGLE]
    by_size = [F.when(size == k, _shingles(k)) for k in sizes]
    grams = wins.select("_wid", F.inline(F.coalesce(*by_size)))

    blocks = max(1, math.ceil(wins.count() / BLOCK_ROWS))
    base = docs.select(F.col(id_col).alias("_id"), F.monotonically_increasing_id().alias("_row"), F.col(text_col).cast("string").alias("_text"))
    if blocks > 1:
        # rows are numbered once, as every block reads them
        base = scratch.put(base, "rows")
    split = _split(base, "_text")
    every = scratch.put(grams.select("_h").distinct(), "shingles")
    known = max(1, math.ceil(every.count() / BLOCK_ROWS))
    counts = None
    for b in range(known):
        some = every.filter(F.pmod(F.hash("_h"), F.lit(known)) == b)
        found = _positions(split, sizes, []).select("_h").join(F.broadcast(some), "_h").groupBy("_h").agg(F.count("*").alias("_df"))
        counts = found if counts is None else counts.unionAll(found)
    order = F.struct(F.coalesce("_df", F.lit(0)).alias("_df"), "_off")
    rare = grams.join(scratch.put(counts, "rarity"), "_h", "left").groupBy("_wid").agg(F.min_by(F.struct("_off", "_h"), order).alias("_p"))
    prefix = scratch.put(rare.select("_wid", "_p.*").join(wins, "_wid"), "prefixes")

    rows = None
    start, length = F.col("_pos") - F.col("_off"), F.size("_win")
    under = F.slice("_w", F.greatest(F.col("_lo") + start + 1, F.lit(1)), length)
    fits = (start >= 0) & (start + length <= F.col("_n"))
    for b in range(blocks):
        some = F.broadcast(prefix.filter(F.pmod("_wid", F.lit(blocks)) == b))
        at = _positions(split, sizes, ["_row", "_id", F.xxhash64("_text").alias("_th")])
        hit = at.join(some.withColumnRenamed("_h", "_ph"), (F.col("_h") == F.col("_ph")) & fits & (under == F.col("_win")), "left")
        span = F.when(F.col("_wid").isNotNull(), F.struct(start.alias("s"), (start + length).alias("e")))
        first = F.col("_pos") == 0
        hit = hit.filter(F.col("_wid").isNotNull() | first).select("_row", "_id", "_th", "_n", span.alias("_span"), "_items")
        rows = hit if rows is None else rows.unionAll(hit)
    whole = rows.groupBy("_row").agg(
        F.first("_id").alias("_id"),
        F.first("_th").alias("_th"),
        F.first("_n").alias("_n"),
        F.array_sort(F.collect_set("_span")).alias("_spans"),
        F.flatten(F.collect_set("_items")).alias("_items"),
    )
    covered = F.aggregate(
        "_spans",
        F.struct(F.lit(0).alias("hit"), F.lit(0).alias("end")),
        lambda a, s: F.struct((a.hit + F.greatest(s.e - F.greatest(s.s, a.end), F.lit(0))).alias("hit"), F.greatest(s.e, a.end).alias("end")),
        lambda a: a.hit,
    )
    items = F.array_sort(F.transform(F.array_distinct("_items"), lambda i: i.cast("string")))
    return whole.select(
        F.col("_id").alias(id_col),
        F.col("_th").alias("text_hash"),
        F.col("_n").cast("long").alias("n_words"),
        covered.cast("long").alias("n_hit"),
        items.alias("items"),
        (F.size(items) >= min_items).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    bad = contamination(docs, benchmark, id_col, text_col).filter("contaminated")
    bad = Scratch(docs.sparkSession).put(bad.select(F.col(id_col).alias("id"), F.col("text_hash").alias("hash")).distinct(), "contaminated")
    return apart(docs, bad, {"id": F.col(f"`{id_col}`"), "hash": F.xxhash64(F.col(f"`{text_col}`").cast("string"))})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


_WORDS = (
    r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
)
SQL = rf"""
WITH it AS (SELECT item_id, w, least(len(w), 8) AS l FROM (SELECT item_id, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
iw AS (SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS win FROM (SELECT *, unnest(range(1, len(w) - l + 2)) AS i FROM it)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, l, unnest(range(1, len(w) - l + 2)) AS i,
        unnest(list_transform(range(1, len(w) - l + 2), lambda i: array_to_string(w[i:i + l - 1], ' '))) AS win
      FROM d, (SELECT DISTINCT l FROM iw) WHERE len(w) >= l),
m AS (SELECT p.doc_id, p.i, iw.l, iw.item_id FROM p JOIN iw ON iw.win = p.win AND iw.l = p.l),
h AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + l)) AS x FROM m) GROUP BY 1),
g AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(g.n_items, 0) AS n_items,
       sha256(coalesce(g.ids, '')) AS items_sha256, coalesce(g.n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN g ON g.doc_id = d.doc_id
"""
