"""Bounded samples of labelled rows for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of each label, and code points of a row, that a classifier learns from at most.
ROWS, CHARS = 4000, 50_000
_STEPS = 1 << 20


def sample_ids(labelled: DataFrame, id_col: str, label_col: str, rows: int = ROWS) -> tuple[DataFrame, dict]:
    """About `rows` rows of each label (`id_col`, `label_col`), chosen by a hash of the id, and rows per label.

    The result holds at most twice `rows` for each label, so that it can be broadcast.
    """
    counts = {r[0]: r[1] for r in labelled.groupBy(label_col).count().collect()}
    share = F.lit(0)
    for label, n in counts.items():
        share = F.when(F.col(label_col) == F.lit(label), F.lit(min(_STEPS, int(_STEPS * rows / n) + 1))).otherwise(share)
    chosen = labelled.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(7)), F.lit(_STEPS)) < share)
    return chosen.limit(2 * rows * max(1, len(counts))), counts


def crc_fold(ids: list, mod: int) -> list[bool]:
    """Whether crc32 of each id as text leaves the remainder 2."""
    import zlib

    return [zlib.crc32(("" if i is None else str(i)).encode()) % mod == 2 for i in ids]


def labelled_texts(docs: DataFrame, labels: DataFrame, label_col: str, rows: int, id_col: str = "doc_id", text_col: str = "text"):
    """Texts and labels of the sample, distinct texts only, and rows per label; ordered by id and text.

    The chosen ids are broadcast: their number is bounded by `rows`.
    """
    chosen, counts = sample_ids(labels.select(id_col, label_col).filter(F.col(label_col).isNotNull()), id_col, label_col, rows)
    body = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    got = docs.select(F.col(id_col), body.alias("_text")).join(F.broadcast(chosen.distinct()), id_col).filter(F.length("_text") <= CHARS)
    table = got.select(id_col, "_text", label_col).limit(3 * rows * max(1, len(counts))).toPandas().sort_values([id_col, "_text", label_col])
    table = table.drop_duplicates("_text")
    return table["_text"].tolist(), table[label_col].to_numpy(), counts
