"""Quality by random-indexing word vectors, pooled per document, and a two-layer network.

Every token (a piece of the public byte-level pattern, folded to lower case for letters only in
its vector's place) has a sparse random index vector drawn from its hash. The context vector of
a frequent token is the sum of the index vectors around it in the training texts. A document is
the mean of its tokens' index and context vectors, with the squared length of the mean index
vector (which measures repetition), how often a vector returns after one or two tokens, and its
size. A two-layer network gives a logit; a temperature
fitted on rows kept back turns it into a calibrated probability.

The model is fitted on about ROWS labelled documents of each label (documented bound); every
text is scored whole.

Defined cases: a null text counts as empty; an empty text is scored from its zero vector; with
no labelled row every score is 0, with one label only every score is that label; repeated rows
get a row each; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from millrace.llm import _text
from millrace.llm._common import crc_mod, table
from millrace.llm._train import labelled_texts
from millrace.llm.toxicity import score_documents

ROWS = 4000
INDEX, NONZERO, CONTEXT_TOKENS, AROUND = 48, 4, 8_000, 2
HIDDEN, EPOCHS, BATCH, RATE, SEED = 32, 60, 128, 3e-3, 5
KEPT_BACK, DECAY = 5, 3e-3
#: Tokens, code points and vectors held at a time.
SLICE, CHUNK, VECTORS = 100_000, 200_000, 60_000
THRESHOLD = 0.7


def index_vectors(hashes: np.ndarray) -> np.ndarray:
    """A few entries of 1 or -1 for each hash."""
    out = np.zeros((len(hashes), INDEX), np.float32)
    rows = np.arange(len(hashes))
    h = hashes.astype(np.uint64)
    for k in range(NONZERO):
        h = _text.mix(h + np.uint64(0x9E3779B97F4A7C15))
        np.add.at(out, (rows, (h % np.uint64(INDEX)).astype(np.int64)), np.where((h >> np.uint64(40)) & np.uint64(1), 1.0, -1.0).astype(np.float32))
    return out


def _tokens(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every token, a space before it left out, and where each text's begin."""
    _, codes, bounds = _text.points(texts)
    start = _text.piece_starts(codes, bounds)
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    end = np.append(start[1:], len(codes))
    first = np.searchsorted(start, bounds)
    begin = start + ((codes[start] == 32) & (end - start > 1))
    return _text.Spans(codes).of(begin, end), first


class Model:
    def __init__(self, tokens=None, context=None, layers=None, center=None, spread=None, temperature=1.0, constant=0.0):
        self.tokens, self.context, self.layers = tokens, context, layers
        self.center, self.spread, self.temperature, self.constant = center, spread, temperature, constant
        self.rows: _text.Rows | None = None

    def _vectors(self, hashes: np.ndarray) -> np.ndarray:
        return np.concatenate((index_vectors(hashes), np.zeros((len(hashes), INDEX), np.float32)), axis=1)

    def pool(self, texts: list[str]) -> np.ndarray:
        if self.rows is None:
            self.rows = _text.Rows(self.tokens, np.concatenate((index_vectors(self.tokens), self.context), axis=1), VECTORS)
        total, size = np.zeros((len(texts), 2 * INDEX)), np.zeros(len(texts), np.int64)
        again = np.zeros((len(texts), 2))
        for at, parts in _text.chunks(texts, CHUNK):
            hashes, first = _tokens(parts)
            n = np.diff(first)
            where = np.array(at, np.int64)
            np.add.at(size, where, n)
            if not len(hashes):
                continue
            doc = np.repeat(np.arange(len(parts)), n)
            for k in (1, 2):
                same = (hashes[k:] == hashes[:-k]) & (doc[k:] == doc[:-k])
                np.add.at(again[:, k - 1], where, np.bincount(doc[k:][same], minlength=len(parts)))
            back, found, _ = _text.distinct(hashes)
            rows = self.rows.of(found, lambda new, found=found: self._vectors(found[new]))[back]
            some = np.flatnonzero(n)
            sums = np.add.reduceat(self.rows.values[rows], first[:-1][some], axis=0, dtype=np.float64)
            np.add.at(total, where[some], sums)
        mean = total / np.maximum(size, 1)[:, None]
        repeat = (mean[:, :INDEX] ** 2).sum(axis=1)
        again /= np.maximum(size, 1)[:, None]
        return np.concatenate((mean, again, repeat[:, None], np.log(repeat + 1e-4)[:, None], np.log1p(size)[:, None]), axis=1)

    def logit(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh(((x - self.center) / self.spread) @ w1 + b1) @ w2 + b2

    def score(self, texts: list[str]) -> np.ndarray:
        if self.layers is None:
            return np.full(len(texts), self.constant)
        return 1 / (1 + np.exp(-self.logit(self.pool(texts)) / self.temperature))


def _contexts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The commonest tokens of the texts, and their context vectors scaled to length 1."""
    parts = [_tokens(p) for _, p in _text.chunks(texts)]
    hashes = np.concatenate([h for h, _ in parts]) if parts else np.zeros(0, np.uint64)
    if not len(hashes):
        return hashes, np.zeros((0, INDEX), np.float32)
    back, found, _ = _text.distinct(hashes)
    order = np.lexsort((found, -np.bincount(back)))[:CONTEXT_TOKENS]
    place = np.full(len(found), -1)
    place[order] = np.arange(len(order))
    total = np.zeros((len(order), INDEX), np.float64)
    for shift in range(1, AROUND + 1):
        for a, b in ((back[:-shift], back[shift:]), (back[shift:], back[:-shift])):
            for k in range(0, len(a), SLICE):
                row, other = place[a[k : k + SLICE]], b[k : k + SLICE]
                keep = row >= 0
                around = index_vectors(found[other[keep]])
                for d in range(INDEX):
                    total[:, d] += np.bincount(row[keep], weights=around[:, d], minlength=len(order))
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return found[order], (total / np.maximum(length, 1e-9)).astype(np.float32)


def _train(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> list:
    draw = np.random.default_rng(SEED)
    layers = [draw.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), draw.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    first, second, t = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    for epoch in range(EPOCHS):
        order = draw.permutation(len(x))
        for k in range(0, len(order), BATCH):
            i = order[k : k + BATCH]
            h = np.tanh(x[i] @ layers[0] + layers[1])
            p = 1 / (1 + np.exp(-(h @ layers[2] + layers[3])))
            d = weight[i] * (p - y[i]) / len(i)
            back = np.outer(d, layers[2]) * (1 - h * h)
            slopes = [x[i].T @ back + DECAY * layers[0], back.sum(0), h.T @ d + DECAY * layers[2], np.array([d.sum()])]
            t += 1
            rate = RATE * (1 - epoch / EPOCHS) * np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            for j, g in enumerate(slopes):
                first[j] += 0.1 * (g - first[j])
                second[j] += 0.001 * (g * g - second[j])
                layers[j] = layers[j] - rate * first[j] / (np.sqrt(second[j]) + 1e-8)
    return layers


def fit(texts: list[str], labels: np.ndarray, counts: dict) -> Model:
    """`counts`: rows of each label before sampling; they set the prior."""
    y = np.asarray(labels).astype(float)
    if not len(y) or y.min() == y.max():
        return Model(constant=float(y[0]) if len(y) else 0.0)
    model = Model(*_contexts(texts))
    x = model.pool(texts)
    model.center, model.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    weight = np.where(y == 1, counts.get(1, 1) / (y == 1).sum(), counts.get(0, 1) / (y == 0).sum())
    weight = weight / weight.mean()
    back = np.arange(len(y)) % KEPT_BACK == 0
    z = (x - model.center) / model.spread
    model.layers = _train(z[~back], y[~back], weight[~back])
    held, truth, w = model.logit(x[back]), y[back], weight[back]
    loss = lambda t: float((w * np.logaddexp(0, np.where(truth == 1, -held, held) / t)).sum())
    model.temperature = min(np.geomspace(0.5, 8, 60).tolist(), key=loss)
    return model


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(crc_mod("doc_id", 4) != 2)
    return score_documents(docs, fit(*labelled_texts(docs, labels, "quality", ROWS)), threshold=THRESHOLD)
