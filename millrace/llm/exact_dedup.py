"""Exact deduplication by progressive refinement, in DataFrame operations only.

Rows are grouped by length, then by the hash of a prefix, and only rows whose length and prefix
both occur elsewhere have their whole content hashed. The first two levels run on one small
table of (length, prefix hash, rows); the third learns who survived from a bitmap of at most
32 MiB, so no text is shuffled.

Defined cases: a null text counts as empty; empty texts are equal to one another; repeated rows
are copies of one another, and of rows that tie on the largest id exactly one stays; an empty
table gives an empty result; other columns are ignored or, if named in `carry`, passed through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import Scratch, mark, narrowed, table

PREFIX_CHARS = 256


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: dict[str, Column] | None = None
) -> DataFrame:
    """One row per row of `docs`: `id_col`, keep_id, group_size, kept, and the `carry` expressions.

    Of equal texts the row with the largest id is kept. `carry` maps new names to expressions over
    the columns of `docs`; they are evaluated where the content is read.
    """
    carry = carry or {}
    scratch = Scratch(docs.sparkSession)
    full = F.when(F.col("_again"), F.sha2(F.col("_body"), 256))
    rows = scratch.put(_marked(docs, scratch, id_col, text_col, carry).select("_id", "_row", "_len", full.alias("_full"), *carry), "rows")
    copies = rows.filter(F.col("_full").isNotNull())
    groups = scratch.put(
        copies.groupBy("_len", "_full").agg(F.max(F.struct("_id", "_row")).alias("_top"), F.count("*").alias("_size")), "groups"
    )
    out = lambda df, keep, size, kept: df.select(
        F.col("_id").alias(id_col), keep.alias("keep_id"), size.alias("group_size"), kept.alias("kept"), *carry
    )
    alone = out(rows.filter(F.col("_full").isNull()), F.col("_id"), F.lit(1).cast("long"), F.lit(True))
    grouped = out(
        copies.join(groups, ["_len", "_full"]),
        F.col("_top._id"),
        F.col("_size"),
        F.struct("_id", "_row").eqNullSafe(F.col("_top")),
    )
    return alone.unionAll(grouped)


def _marked(docs: DataFrame, scratch: Scratch, id_col: str, text_col: str, carry: dict[str, Column]) -> DataFrame:
    """`_id`, `_row`, `_body`, `_len`, `_head`, the `carry` expressions and `_again`: whether length and prefix may occur elsewhere.

    `_again` follows from the content alone, so it is the same whenever the rows are read.
    """
    body = F.coalesce(F.col(text_col), F.lit(""))
    keys = {"_len": F.octet_length(body), "_head": F.xxhash64(F.substring(body, 1, PREFIX_CHARS))}

    sized = docs.select(*(c.alias(n) for n, c in keys.items()))
    level = scratch.put(sized.groupBy("_len", "_head").agg(F.count("*").alias("_n")), "sizes")
    same_length = level.groupBy("_len").agg(F.sum("_n").alias("_of_length")).filter("_of_length > 1")
    same_head = level.filter("_n > 1").join(same_length, "_len", "left_semi")
    survivors = scratch.put(same_head.select("_len", "_head"), "survivors")

    read = docs.select(
        F.col(id_col).alias("_id"),
        F.monotonically_increasing_id().alias("_row"),
        body.alias("_body"),
        *(c.alias(n) for n, c in keys.items()),
        *(c.alias(n) for n, c in carry.items()),
    )
    return mark(read, survivors, "_again", "_len", "_head")


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns.

    Only rows whose length and prefix occur elsewhere are written out, and of these only the ones that stay are
    shuffled; the others come from `docs` itself, which is read again with the result and must give the same rows.
    """
    names = {f"_keep_{i}": c for i, c in enumerate(docs.columns)}
    scratch = Scratch(docs.sparkSession)
    marked = _marked(docs, scratch, id_col, text_col, {n: F.col(f"`{c}`") for n, c in names.items()})
    full = F.sha2(F.col("_body"), 256).alias("_full")
    copies = scratch.put(marked.filter("_again").select("_id", "_row", "_len", full, *names), "copies")
    top = copies.groupBy("_len", "_full").agg(F.max(F.struct("_id", "_row")).alias("_top"))
    stays = scratch.put(top.select(F.col("_top._row").alias("_row")), "stays")
    kept = narrowed(copies, stays, "_row").join(stays, "_row", "left_semi")
    found = marked.filter("not _again").select(*names).unionAll(kept.select(*names))
    return found.select(*(F.col(n).alias(c) for n, c in names.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.sha2(F.coalesce(F.col("text"), F.lit("")), 256)
    return exact_dedup(table(spark, sf_dir, "documents"), carry={"text_sha256": digest})


SQL = """
SELECT doc_id,
       max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id,
       count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents
"""
