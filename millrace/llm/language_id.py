"""Language identification, word first with backoff to character n-grams.

Words (lower-cased runs of letters) that the model knows score by their log frequency in each
language. An unseen word scores by the longest known n-gram that begins at each of its
characters, from LONGEST down to single characters; a word with no known character says nothing.
A document's score is the share of its best language after the mean over its words.

The model is fitted on about ROWS documents of each language, of at most CHARS code points
(documented bounds of a classifier's labelled rows); of them it keeps the WORDS commonest words
and the GRAMS commonest n-grams of each length that occur LEAST times. Every text is scored whole.

Defined cases: null, empty and letterless texts are `und` with score 0; with no labelled row at
all every text is `und`; an empty table gives an empty result; languages that tie go to the first in alphabetical order; every row of
the input gives one row; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._common import crc_mod, importable, table
from millrace.llm._train import crc_fold, sample_ids

ROWS = 1500
CHARS = 20_000
WORDS, GRAMS, LONGEST, LEAST = 60_000, 40_000, 4, 3
#: Unseen words whose scores a worker remembers.
UNSEEN = 60_000
#: Words that count as independent evidence for the score.
EVIDENCE = 8
UNKNOWN = "und"
REJECT_BELOW = 0.3


def _words(texts: list[str]):
    """Folded code points of the joined texts, starts and ends of words, and the text of each word."""
    _, codes, bounds = _text.points(texts)
    low = _text.lower_codes()[codes]
    start, end = _text.runs_of(_text.classes()[codes], bounds, _text.LETTER)
    return low, start, end, np.searchsorted(bounds, start, side="right") - 1


def _spaced(low: np.ndarray, start: np.ndarray, end: np.ndarray):
    """The words with a space before and after each: code points, and where each padded word begins and ends."""
    size = end - start
    flat, ends = _text.gather(low, start, size)
    padded = np.full(len(flat) + 2 * len(size), 32, np.uint32)
    which = np.repeat(np.arange(len(size)), size)
    padded[np.arange(len(flat)) + 2 * which + 1] = flat
    begin = ends[:-1] + 2 * np.arange(len(size))
    return padded, begin, begin + size + 2


class Model:
    """Log frequencies by hash of word and of n-gram; one column for each language, centred by row."""

    def __init__(self, langs: list[str], words, grams):
        self.langs, self.words, self.grams = langs, words, grams
        self.cache: _text.Rows | None = None

    @classmethod
    def fit(cls, texts: list[str], labels: list[str]) -> Model:
        langs = sorted(set(labels))
        of = np.array([langs.index(x) for x in labels], np.int64)
        counts: list = [None] * (LONGEST + 1)
        for at, parts in _text.chunks(texts):
            low, start, end, doc = _words(parts)
            if not len(start):
                continue
            lang = of[np.array(at, np.int64)[doc]]
            back, found, first = _text.distinct(_text.Spans(low).of(start, end))
            table = np.zeros((len(found), len(langs)), np.int64)
            np.add.at(table, (back, lang), 1)
            frames = [pd.DataFrame(table, index=found)]
            padded, begin, stop = _spaced(low, start[first], end[first])
            spans = _text.Spans(padded)
            word = np.repeat(np.arange(len(first)), stop - begin)
            for n in range(1, LONGEST + 1):
                i = np.flatnonzero(np.arange(len(padded)) + n <= stop[word])
                g_back, g_found, _ = _text.distinct(spans.of(i, i + n))
                g = np.zeros((len(g_found), len(langs)), np.int64)
                for c in range(len(langs)):
                    g[:, c] = np.bincount(g_back, weights=table[word[i], c], minlength=len(g_found))
                frames.append(pd.DataFrame(g, index=g_found))
            counts = [f if c is None else c.add(f, fill_value=0) for c, f in zip(counts, frames, strict=True)]
        if counts[0] is None:
            return cls([], None, [])
        return cls(langs, cls._logs(counts[0], WORDS), [cls._logs(c, GRAMS) for c in counts[1:]])

    @staticmethod
    def _logs(counts: pd.DataFrame, most: int):
        total = counts.sum(axis=1)
        total = total[total >= LEAST].sort_index().sort_values(ascending=False, kind="stable").head(most)
        kept = counts.loc[total.index].sort_index()
        n = counts.sum(axis=0).to_numpy(float)
        logs = np.log((kept.to_numpy(float) + 0.5) / (n + 0.5 * len(counts)))
        return kept.index.to_numpy(np.uint64), (logs - logs.mean(axis=1, keepdims=True)).astype(np.float32)

    def _unseen(self, low: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        padded, begin, stop = _spaced(low, start, end)
        spans = _text.Spans(padded)
        word = np.repeat(np.arange(len(start)), stop - begin)
        open_ = np.ones(len(padded), bool)
        total = np.zeros((len(start), len(self.langs)), np.float64)
        seen = np.zeros(len(start), np.int64)
        for n in range(LONGEST, 0, -1):
            keys, values = self.grams[n - 1]
            i = np.flatnonzero(open_ & (np.arange(len(padded)) + n <= stop[word]))
            if not len(i) or not len(keys):
                continue
            h = spans.of(i, i + n)
            at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[at] == h
            i, at = i[hit], at[hit]
            open_[i] = False
            for c in range(len(self.langs)):
                total[:, c] += np.bincount(word[i], weights=values[at, c], minlength=len(start))
            seen += np.bincount(word[i], minlength=len(start))
        return (total / np.maximum(seen, 1)[:, None]).astype(np.float32)

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        k = len(self.langs)
        total, words = np.zeros((len(texts), max(1, k))), np.zeros(len(texts), np.int64)
        if k and self.cache is None:
            self.cache = _text.Rows(*self.words, UNSEEN)
        for at, parts in _text.chunks(texts):
            low, start, end, doc = _words(parts)
            if not k or not len(start):
                continue
            back, found, first = _text.distinct(_text.Spans(low).of(start, end))
            rows = self.cache.of(found, lambda new, low=low, s=start[first], e=end[first]: self._unseen(low, s[new], e[new]))[back]
            where = np.array(at, np.int64)
            for c in range(k):
                np.add.at(total[:, c], where, np.bincount(doc, weights=self.cache.values[rows, c], minlength=len(parts)))
            np.add.at(words, where, np.bincount(doc, minlength=len(parts)))
        mean = total / np.maximum(words, 1)[:, None] * np.minimum(words, EVIDENCE)[:, None]
        share = np.exp(mean - mean.max(axis=1, keepdims=True))
        share /= share.sum(axis=1, keepdims=True)
        best = share.argmax(axis=1)
        known = words > 0
        return (
            [self.langs[b] if x else UNKNOWN for b, x in zip(best, known, strict=True)],
            [float(share[i, b]) if x else 0.0 for i, (b, x) in enumerate(zip(best, known, strict=True))],
        )


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Model:
    """A model of the labelled rows outside the held-out fold (crc32 of the id, modulo 4, is 2)."""
    body = F.col(text_col).cast("string")
    rows_ = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (crc_mod(id_col, 4) != 2) & (F.length(body) <= CHARS))
    chosen, _ = sample_ids(rows_.select(id_col, lang_col, body.alias("_text")), id_col, lang_col, rows)
    got = chosen.toPandas().sort_values([id_col, "_text"]).drop_duplicates(["_text", lang_col])
    return Model.fit(got["_text"].tolist(), got[lang_col].tolist())


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """`id_col`, held_out, lang_pred, score; or with `carry` a struct `row` of those columns (c0, c1, ...), `lang` and `certainty`."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [f"_c{i}" for i in range(len(carry))]

    def run(batches):
        for batch in batches:
            lang, score = shared.value.predict([x or "" for x in batch.column(1).to_pylist()])
            held = crc_fold(batch.column(0).to_pylist(), 4)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], batch.column(0), pa.array(held), pa.array(lang, pa.string()), pa.array(score, pa.float64())],
                [*names, "_id", "held_out", "lang_pred", "score"],
            )

    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(carry, names, strict=True)))
    kinds = [f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in zip(carry, names, strict=True)]
    schema = ", ".join([*kinds, f"_id {docs.schema[id_col].dataType.simpleString()}", "held_out boolean", "lang_pred string", "score double"])
    made = source.mapInArrow(_text.frugal(run), schema)
    if carry:
        return made.select(F.struct(*(F.col(n).alias(f"c{i}") for i, n in enumerate(names))).alias("row"), F.col("lang_pred").alias("lang"), F.col("score").alias("certainty"))
    return made.withColumnRenamed("_id", id_col)


def drop_unidentified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The documents whose language is known with a score of REJECT_BELOW at least, with all their columns."""
    found = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col, tuple(docs.columns))
    known = found.filter((F.col("lang") != UNKNOWN) & (F.col("certainty") >= REJECT_BELOW))
    return known.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit(docs))
