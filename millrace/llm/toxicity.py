"""Toxicity by a weighted lexicon, matched with Aho-Corasick after folding look-alikes.

Folding: lower case, accents off, homoglyphs to Latin, digits and signs that stand for letters
replaced inside words, everything else a space. Lexicon entries are word beginnings, learned
from labels: the shortest beginnings (of SHORTEST letters or more, or whole words) that are much
commoner in toxic documents, weighted by log odds. Exception phrases are pairs of words around
an entry that the labels show to be harmless; an entry inside a matched phrase does not count.
A document's weight and its weight per hundred words go through a logistic curve fitted to the
labels, so the score is the probability of label 1.

The model is fitted on about ROWS labelled documents of each label (documented bound); every
text is scored whole.

Defined cases: a null text counts as empty; a text without matches gets the low score of its
kind; with no labelled row, or only one label, every score is 0; repeated rows get a row each;
other columns are ignored.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._common import crc_mod, importable, table
from millrace.llm._train import crc_fold, labelled_texts

ROWS = 4000
SHORTEST, LONGEST = 4, 12
#: An entry is that many standard deviations commoner in toxic documents, and in so large a share of its documents.
SIGMAS, PURITY = 6.0, 0.8
#: A longer beginning replaces one if it keeps that share of its toxic documents and has fewer others.
KEEPS = 0.9
#: Toxic documents that an entry needs, and harmless ones that a phrase needs.
FEWEST, HARMLESS = 3, 3
THRESHOLD = 0.3
#: Letters of other scripts that look like Latin ones, and the signs and digits that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "в": "b", "к": "k", "м": "m", "н": "h", "т": "t", "г": "r", "п": "n",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "s", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ѵ": "v", "ո": "n", "ս": "u",
}
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
SPACE = 32

_tables: dict[str, np.ndarray] = {}


def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """Letter of every code point (a space where there is none), and the letter of a sign inside a word."""
    if not _tables:
        letters = np.full(0x110000, SPACE, np.uint32)
        for c in np.flatnonzero(_text.classes() == _text.LETTER).tolist():
            x = chr(c).lower()
            x = HOMOGLYPHS.get(x, x)
            x = unicodedata.normalize("NFKD", x)[0].lower()
            letters[c] = ord(HOMOGLYPHS.get(x, x))
        signs = np.full(0x110000, SPACE, np.uint32)
        for a, b in SIGNS.items():
            signs[ord(a)] = ord(b)
        _tables.update(letters=letters, signs=signs)
    return _tables["letters"], _tables["signs"]


def fold(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The folded texts, each between single spaces, joined; where each begins; words of each."""
    letters, signs = _fold_tables()
    _, codes, bounds = _text.points([f" {x} " for x in texts])
    out = letters[codes]
    sign = signs[codes]
    edge = out != SPACE
    # a sign counts between letters only, or letters and other such signs, so that prices and dates stay apart
    left = np.concatenate(([False], edge[:-1]))
    right = np.concatenate((edge[1:], [False]))
    signed = (sign != SPACE) & ~edge
    near = signed & (left | right)
    for _ in range(2):
        grown = near | edge
        near |= signed & (np.concatenate(([False], grown[:-1])) | np.concatenate((grown[1:], [False])))
    bang = near & (codes == ord("!")) & ~np.concatenate((edge[1:], [False]))
    near &= ~bang
    out = np.where(near, sign, out)
    gap = out == SPACE
    keep = ~gap
    keep[1:] |= ~gap[:-1]
    keep[bounds[:-1]] = True
    kept = np.cumsum(keep)
    begin = np.concatenate(([0], kept))[bounds]
    out = out[keep]
    starts = np.flatnonzero((out[1:] != SPACE) & (out[:-1] == SPACE)) + 1
    words = np.diff(np.searchsorted(starts, begin))
    return out.astype("<u4").tobytes().decode("utf-32-le"), begin, words


class Model:
    """`terms`: folded patterns that begin with a space, to weights; `phrases`: folded harmless phrases; `curve`: the logistic's parameters."""

    def __init__(self, terms: dict[str, float], phrases: list[str], curve: list[float] | None):
        self.terms, self.phrases, self.curve = terms, phrases, curve
        self.automaton = None

    def __getstate__(self):
        return {"terms": self.terms, "phrases": self.phrases, "curve": self.curve, "automaton": None}

    def _matcher(self):
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            found = {t: (len(t), w) for t, w in self.terms.items()} | {p: (len(p), 0.0) for p in self.phrases}
            for pattern, value in found.items():
                self.automaton.add_word(pattern, value)
            if found:
                self.automaton.make_automaton()
        return self.automaton

    def weigh(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Weight of the matches in each text, and its words."""
        weight, words = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        matcher = self._matcher()
        for at, parts in _text.chunks(texts):
            joined, begin, n = fold(parts)
            where = np.array(at, np.int64)
            np.add.at(words, where, n)
            if not len(matcher):
                continue
            hits: dict[int, float] = {}
            quiet: list[tuple[int, int]] = []
            for end, (size, w) in matcher.iter(joined):
                if w:
                    hits[end - size + 1] = max(w, hits.get(end - size + 1, 0.0))
                else:
                    quiet.append((end - size + 1, end))
            for a, b in quiet:
                for k in [k for k in range(a, b) if k in hits]:
                    del hits[k]
            if hits:
                doc = np.searchsorted(begin, np.array(list(hits)), side="right") - 1
                np.add.at(weight, where[doc], np.array(list(hits.values())))
        return weight, words

    def score(self, texts: list[str]) -> np.ndarray:
        if self.curve is None:
            return np.zeros(len(texts))
        return 1 / (1 + np.exp(-(_features(*self.weigh(texts)) @ np.array(self.curve))))


def _features(weight: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.stack([np.ones(len(weight)), np.log1p(weight), np.log1p(100 * weight / np.maximum(words, 1))], axis=1)


def _learn_terms(docs: list[list[str]], toxic: np.ndarray) -> dict[str, float]:
    def beginnings(words: list[str]) -> set[str]:
        found = set()
        for w in words:
            if len(w) >= SHORTEST:
                found.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
            found.add(f" {w} ")
        return found

    counts = (Counter(), Counter())
    for words, label in zip(docs, toxic, strict=True):
        if label:
            counts[1].update(beginnings(words))
    for p in [p for p, n in counts[1].items() if n < FEWEST]:
        del counts[1][p]
    for words, label in zip(docs, toxic, strict=True):
        if not label:
            counts[0].update(p for p in beginnings(words) if p in counts[1])
    n = (max(1, len(toxic) - int(toxic.sum())), max(1, int(toxic.sum())))
    share = n[1] / (n[0] + n[1])
    longer: dict[str, list[str]] = {}
    for p in counts[1]:
        if len(p) > SHORTEST + 1:
            longer.setdefault(p[:-1], []).append(p)
    terms: dict[str, float] = {}
    for p in sorted(counts[1], key=lambda p: (len(p.rstrip()), p)):
        a, b = counts[1][p], counts[0][p]
        expected = (a + b) * share
        purity = (a / n[1]) / (a / n[1] + b / n[0])
        if purity < PURITY or a - expected < SIGMAS * math.sqrt(expected * (1 - share)) or any(p[:k] in terms for k in range(SHORTEST + 1, len(p))):
            continue
        while better := [q for q in longer.get(p, ()) if counts[1][q] >= KEEPS * counts[1][p] and counts[0][q] < counts[0][p]]:
            p = max(better, key=lambda q: (counts[1][q], q))
        terms[p] = math.log((counts[1][p] + 0.5) / (n[1] + 1)) - math.log((counts[0][p] + 0.5) / (n[0] + 1))
    return terms


def _learn_phrases(docs: list[list[str]], toxic: np.ndarray, terms: dict[str, float]) -> list[str]:
    pairs = (Counter(), Counter())
    for words, label in zip(docs, toxic, strict=True):
        found = set()
        for i, w in enumerate(words):
            if any(f" {w} "[:k] in terms for k in range(min(SHORTEST, len(w) + 1) + 1, len(w) + 3)):
                found.update(f" {' '.join(words[j : j + 2])} " for j in (i - 1, i) if j >= 0 and j + 2 <= len(words))
        pairs[int(label)].update(found)
    return sorted(p for p, n in pairs[0].items() if n >= HARMLESS and n > 2 * pairs[1][p])


def fit(texts: list[str], labels: np.ndarray, counts: dict) -> Model:
    """`counts`: rows of each label before sampling; they set the prior."""
    toxic = np.asarray(labels).astype(bool)
    if toxic.all() or not toxic.any():
        return Model({}, [], None)
    docs = []
    for at, parts in _text.chunks(texts):
        joined, begin, _ = fold(parts)
        docs.extend(joined[a:b].split() for a, b in zip(begin[:-1], begin[1:], strict=True))
    terms = _learn_terms(docs, toxic)
    model = Model(terms, _learn_phrases(docs, toxic, terms), None)
    x = _features(*model.weigh(texts))
    prior = np.where(toxic, counts.get(1, 1) / toxic.sum(), counts.get(0, 1) / (~toxic).sum())
    prior = prior / prior.mean()
    b = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ b))
        slope = x.T @ (prior * (p - toxic)) + 1.0 * b * np.array([0, 1, 1])
        curve = (x * (prior * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1.0, 1.0])
        step = np.linalg.solve(curve, slope)
        b -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    model.curve = b.tolist()
    return model


def score_documents(docs: DataFrame, model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`id_col`, held_out, score, predicted; for any model with score(texts)."""
    spark = docs.sparkSession
    importable(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            score = shared.value.score([x or "" for x in batch.column(1).to_pylist()])
            held = crc_fold(batch.column(0).to_pylist(), 4)
            parts = [batch.column(0), pa.array(held), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(parts, [id_col, "held_out", "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text"))
    return source.mapInArrow(_text.frugal(run), f"`{id_col}` {kind}, held_out boolean, score double, predicted int")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return score_documents(docs, fit(*labelled_texts(docs, labels, "toxic", ROWS)))
