"""Language-model scoring: causal self-attention over subword ids, trained in numpy.

A text is its words (A-Z lower-cased) and an end; a word is the public byte-level ids of a space
and the word. A token's probability is that of its class given the ids before it, times its
share of the class in the whole training corpus. The class comes from one head of masked
attention with learned distances over the last CONTEXT to 2 * CONTEXT - 1 ids and the id just
before: texts are cut into blocks of CONTEXT ids, every block is scored once, and its window
overlaps the block before. So a word's own ids spell it with some probability. A word that the
corpus has is also known as a whole: its class is that of its first id, and its probability that
class's, given the ids before it, times the word's share of all training words of the class (and
MIX times its share of all words). The two are interpolated with a fitted weight.

Everything is learned from every training text (crc32 of the id modulo 7 is not 2) and grows
with the corpus. Counts of words and of ids, and the sums of the ids around each id that make
the classes and the first embeddings, are added up over all of them. The weights start from
TOKENS ids drawn evenly by a hash of the document's id; from there each task goes once through
all ids of its training rows, and the changes are averaged by the ids they come from. The
weight of the corpus shares is fitted to a histogram over all training words, each scored
before the network learned from it. Changes are added up as integers, so the order of tasks
does not matter; which rows share a task does, a little.

Texts are encoded once, to places among the distinct words of some texts and the ids of those,
which a scratch table holds for training and scoring; a word is known by a hash of its ids.

Words with a count in the top TOP are shared with all tasks; the network's log probabilities of
all other words are joined to their counts and interpolated there, so that every count and share
is exact whatever TOP is.

Defined cases: a null text counts as empty and scores its end alone; without training texts
counts are 0 and the network keeps its random weights; every row of the input gives one row;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass
from functools import cached_property, lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text, byte_bpe
from millrace.llm._common import Scratch, crc_mod, importable, table

FOLDS = 7
ROWS, CHARS = 2500, 20_000
TOP = 1 << 18
CONTEXT, WIDTH, SINGLE, CLUSTERS = 16, 16, 96, 64
EPOCHS, BATCH, RATE, SEED, TOKENS = 2, 128, 1e-2, 11, 500_000
END, BOS, PAD = 0, 1, 2
_OTHERS = 3
#: Blocks of a step and the rate of the pass over all training texts, which falls with the root of the steps in HALF.
PASS_BATCH, PASS_RATE, HALF = 128, 6e-3, 1000
#: Changes are added up in units of 1 / UNIT; log odds in steps of STEP up to FAR, beyond which they are certain.
UNIT, STEP, FAR = 1 << 20, 0.01, 40.0
#: Weight of a known word's share of all words, beside its share of its class.
MIX = 0.02
#: Logits up to here stay finite in float32 sums of exponentials.
SAFE = 60.0
#: The libraries' pattern without its alternatives for white space, the last of which looks ahead and is slow.
PLAIN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+"
#: Rows of a table in one value of a scratch table.
BLOCK = 256
#: Code points of a word up to which the library encodes it; longer ones go through merges in linear time.
LONG = 1000


class Words(_text.PieceTable):
    """Ids of words met so far; `library` has the ranks shifted past END, BOS and PAD, `plain` also, but a pattern for text without white space
    other than single spaces; `whole` encodes a long word in linear time."""

    def __init__(self, library, plain, whole, size_of: np.ndarray, limit: int = 400_000):
        self.library, self.plain, self.whole, self.size_of = library, plain, whole, size_of
        super().__init__(self.apart, limit)

    def apart(self, words: list[str]) -> list[list[int]]:
        return [self.library.encode_ordinary(" " + w) if len(w) <= LONG else self.whole(" " + w) for w in words]

    def encoded(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words without white space of the pattern's are encoded in one call: each piece of theirs begins where a word does or within it."""
        joined = " " + " ".join(words)
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        length = np.array([len(w) + 1 for w in words], np.int64)
        if length.max() > LONG or int((_text.classes()[codes] == _text.SPACE).sum()) != len(words):
            return super().encoded(words)
        ids = self.plain.encode_to_numpy(joined)
        size = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000))
        last = np.searchsorted(np.cumsum(self.size_of[ids]), size[np.cumsum(length) - 1])
        return ids, np.diff(last, prepend=-1)


@lru_cache(2)
def _words_table(path: str):
    """Ids of words by the word's hash; ids are shifted past END, BOS and PAD."""
    import public_tokenizers
    import regex
    import tiktoken

    ranks = byte_bpe.read_ranks(path)
    shifted = {t: i + _OTHERS for t, i in ranks.items()}
    library, plain = (tiktoken.Encoding("words", pat_str=x, mergeable_ranks=shifted, special_tokens={}) for x in (public_tokenizers.PATTERN, PLAIN))
    merges = lru_cache(1)(lambda: byte_bpe.Merges(ranks))
    pattern = regex.compile(public_tokenizers.PATTERN)
    size = max(shifted.values()) + 1
    size_of = np.zeros(size, np.int64)
    size_of[list(shifted.values())] = [len(t) for t in shifted]

    def whole(word: str) -> list[int]:
        return [i + _OTHERS for x in pattern.findall(word) for i in merges().encode(x.encode())]

    return Words(library, plain, whole, size_of), size


def _spans(parts: list[str]):
    """Joined text with A-Z lower-cased, word starts and ends, word hashes, and the place of each text's first word."""
    joined, codes, bounds = _text.points(parts)
    low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
    white = (codes == 32) | ((codes >= 9) & (codes <= 13))
    start, end = _text.runs_of(white.astype(np.uint8), bounds, 0)
    hashes = _text.Spans(low).of(start, end) if len(start) else np.zeros(0, np.uint64)
    return joined.encode().lower().decode(), start, end, hashes, np.searchsorted(start, bounds)


#: A row of a table, which is set faster as a whole than number by number.
_ROW = np.dtype((np.void, 4 * WIDTH))


def _cells(rows: np.ndarray) -> np.ndarray:
    """Places of the cells of these rows in a flat table of WIDTH columns."""
    return (rows[:, None] * WIDTH + np.arange(WIDTH)).ravel()


def _attend(s: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Makes logits (with the mask) their exponentials in place; their sums. The maximum of a row is only taken off where they could overflow or vanish."""
    s[x[:, 0] == PAD, :, : CONTEXT - 1] = -1e9  # before a text; what fills up its end is only seen from there
    if s.max() > SAFE or s.diagonal(CONTEXT - 1, 1, 2).min() < -SAFE:
        s -= s.max(axis=2, keepdims=True)
    np.exp(s, out=s)
    return (s.reshape(-1, s.shape[2]) @ np.ones(s.shape[2], np.float32)).reshape(*s.shape[:2], 1)


class Network:
    """Weights of the attention model and the tables made from them."""

    def __init__(self, size: int):
        draw = np.random.default_rng(SEED)
        self.size, n = size, SINGLE + CLUSTERS
        scale = 1 / np.sqrt(WIDTH)
        self.embed = draw.normal(0, 1, (size, WIDTH)).astype(np.float32)
        self.w = {k: draw.normal(0, scale, (WIDTH, WIDTH)).astype(np.float32) for k in "qkvu"}
        self.w["c"], self.w["b"] = np.zeros((WIDTH, n), np.float32), np.zeros(n, np.float32)
        self.w["r"] = np.zeros(2 * CONTEXT, np.float32)
        self.kind = np.arange(size) % n
        self.share = np.zeros(size, np.float32)
        i, j = np.arange(CONTEXT)[:, None] + CONTEXT - 1, np.arange(2 * CONTEXT - 1)[None, :]
        self.far = np.clip(i - j, 0, 2 * CONTEXT - 1)
        self.mask = np.where(j > i, np.float32(-1e9), np.float32(0))

    def __setstate__(self, state: dict) -> None:
        """Unpickled arrays have types of their own, for which `np.add.at` and others take slow ways; a copy has numpy's."""
        plain = lambda x: x.astype(x.dtype.type) if isinstance(x, np.ndarray) else x
        self.__dict__ = {k: plain(x) for k, x in state.items()} | {"w": {k: plain(x) for k, x in state["w"].items()}}

    def classes(self, counts: np.ndarray, texts: list[np.ndarray]) -> None:
        """The commonest ids have a class each; the others are grouped by the ids around them."""
        self.group(counts, self.around(texts))

    def index(self) -> np.ndarray:
        """A random vector for each id, in whole 1024ths so that sums do not depend on their order."""
        made = np.rint(np.random.default_rng(SEED).normal(0, 1024, (self.size, WIDTH))).astype(np.float32)
        made[PAD] = 0
        return made

    def around(self, texts: list[np.ndarray], out: np.ndarray | None = None) -> np.ndarray:
        """Sums of the vectors of the three ids before and after each id, added to `out`."""
        flat = np.full(sum(len(x) + 3 for x in texts) + 3, PAD, np.int64)
        at = 3
        for ids in texts:
            flat[at : at + len(ids)] = ids
            at += len(ids) + 3
        out = np.zeros((self.size, WIDTH)) if out is None else out
        vectors = self.index() if self.vectors is None else self.vectors
        cells = _cells(np.arange(self.size)).reshape(-1, WIDTH) if self.cells is None else self.cells
        for a in range(0, len(flat) - 6, 4096):
            # the three before and after each of some ids; cells of a table in one row, as numpy adds those up fast
            part = flat[a : a + 4096 + 6]
            own = vectors.take(part, axis=0)
            total = own[:-6] + own[6:]
            for shift in (1, 2, 4, 5):
                total += own[shift : shift - 6]
            np.add.at(out.ravel(), cells.take(part[3:-3], axis=0).ravel(), total.ravel().astype(float))
        out[PAD] = 0
        return out

    def group(self, counts: np.ndarray, around: np.ndarray) -> None:
        """Classes and first embeddings from the sums around each id."""
        index = self.index() / 1024
        around = around / (np.linalg.norm(around, axis=1, keepdims=True) + 1e-6)
        self.embed = (around + 0.05 * index).astype(np.float32)
        order = np.argsort(-counts, kind="stable")
        rest = order[SINGLE:]
        self.kind = np.empty(self.size, np.int64)
        self.kind[order[:SINGLE]] = np.arange(min(SINGLE, self.size))
        if not len(rest):
            return
        centre = around[rest[:CLUSTERS]]
        for _ in range(12):
            near = (around[rest] @ centre.T).argmax(axis=1)
            total = np.zeros_like(centre)
            np.add.at(total, near, around[rest] * np.log1p(counts[rest])[:, None])
            centre = np.where(np.abs(total).sum(1, keepdims=True) > 0, total / (np.linalg.norm(total, axis=1, keepdims=True) + 1e-9), centre)
        self.kind[rest] = SINGLE + near

    def shares(self, counts: np.ndarray) -> None:
        total = np.bincount(self.kind, weights=counts + 1.0, minlength=SINGLE + CLUSTERS)
        self.share = np.log((counts + 1.0) / total[self.kind]).astype(np.float32)

    def blocks(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Inputs and targets of every block, and the text of each; BOS comes before a text, PAD fills up."""
        grid, own, rows = self.grid(texts)
        seen = np.concatenate((grid[own - 1], grid[own, :-1]), axis=1)
        return seen, grid[own], np.repeat(np.arange(len(texts)), rows)

    def grid(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows of CONTEXT ids, of which one that ends in BOS comes before each text; places of the others, and how many each text has."""
        rows = np.array([-(-len(x) // CONTEXT) for x in texts], np.int64)
        flat = np.full((int(rows.sum()) + len(texts)) * CONTEXT, PAD, np.int64)
        at = 0
        for ids, k in zip(texts, rows.tolist(), strict=True):
            at += CONTEXT
            flat[at - 1] = BOS
            flat[at : at + len(ids)] = ids
            at += k * CONTEXT
        grid = flat.reshape(-1, CONTEXT)
        head = np.zeros(len(grid), bool)
        head[np.cumsum(rows + 1) - rows - 1] = True
        return grid, np.flatnonzero(~head), rows

    def train(self, texts: list[np.ndarray]) -> None:
        seen, target, _ = self.blocks(texts)
        draw = np.random.default_rng(SEED)
        steps = max(1, EPOCHS * -(-len(seen) // BATCH))
        steady = Steps(self)
        for _ in range(EPOCHS):
            order = draw.permutation(len(seen))
            for a in range(0, len(order), BATCH):
                steady.step(seen[order[a : a + BATCH]], target[order[a : a + BATCH]], RATE * (1 - (steady.done + 1) / (steps + 1)))

    vectors, cells = None, None
    tables, weight = None, 0.5
    #: Log of the training words whose first id has a class, and of all training words.
    begun, total = np.zeros(SINGLE + CLUSTERS), 0.0

    def beginnings(self, counts: np.ndarray) -> None:
        """`counts`: how many words and ends begin with each id."""
        own = np.bincount(self.kind, weights=counts, minlength=SINGLE + CLUSTERS)
        self.begun, self.total = np.log(np.maximum(own, 1)), float(np.log(max(1, counts.sum())))

    def lift(self, logs: np.ndarray, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Log of how much likelier a known word is here than by its share of the corpus. `logs`: log probabilities of the ids, `starts`: first ids of words."""
        first = ids[starts]
        given = logs[starts] - self.share[first]
        return np.logaddexp(np.log(MIX), np.log1p(-MIX) + given - self.begun[self.kind[first]] + self.total)

    def highest(self) -> float:
        """What no class's logit exceeds, as tanh is within 1; below SAFE no maximum is needed by row."""
        return float((np.abs(self.w["c"]).sum(axis=0) + np.abs(self.w["b"])).max())

    def logs(self, texts: list[np.ndarray], step: int = 128) -> np.ndarray:
        """Log probability of every id of the texts, one after another."""
        if self.tables is None:
            self.tables = (self.w["q"] @ self.w["k"].T / np.float32(np.sqrt(WIDTH))).astype(np.float32)
            self.high = self.highest()
            self.odds = np.exp(self.w["b"]) if self.high <= SAFE else np.ones(SINGLE + CLUSTERS, np.float32)
            self.shift = (self.w["r"][self.far] + self.mask).astype(np.float32)
        grid, own, _ = self.grid(texts)
        out = np.zeros(grid.shape)
        n = CONTEXT - 1
        first = np.arange(step * CONTEXT) * (SINGLE + CLUSTERS)
        for a in range(1, len(grid), step):
            # every block with the row before it: windows overlap in memory
            some = grid[a - 1 : a + step]
            rows, y = len(some) - 1, some[1:].ravel()
            e = self.embed.take(some.ravel(), axis=0)
            window = np.lib.stride_tricks.as_strided(e, (rows, CONTEXT + n, WIDTH), (CONTEXT * e.strides[0], *e.strides), writeable=False)
            own_e = e[n : n + rows * CONTEXT]
            s = (own_e @ self.tables).reshape(rows, CONTEXT, WIDTH) @ np.ascontiguousarray(window.transpose(0, 2, 1))
            s += self.shift
            total = _attend(s, some[:-1])
            z = s @ window
            z /= total
            z = z.reshape(-1, WIDTH) @ self.w["v"]
            z += own_e @ self.w["u"]
            np.tanh(z, out=z)
            z = z @ self.w["c"]
            kind = self.kind.take(y)
            at = first[: len(z)] + kind
            if self.high > SAFE:
                z += self.w["b"]
                z -= z.max(axis=1, keepdims=True)
                hit = z.ravel().take(at)
            else:
                hit = z.ravel().take(at) + self.w["b"].take(kind)
            np.exp(z, out=z)
            out[a : a + rows] = (hit - np.log(z @ self.odds) + self.share.take(y)).reshape(rows, CONTEXT)
        return out[own][grid[own] != PAD]

    def score(self, ids: list[np.ndarray], size: np.ndarray, share: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each text; and of every word and end, one after another, how much more its ids give it than its share would without the share itself.

        `size`: ids of each word; `share`: log share of each word in the corpus, -inf if it is unknown or joined on later; `count`: words and end of each text.
        """
        starts = np.cumsum(size) - size
        logs = self.logs(ids)
        word, lift = np.add.reduceat(logs, starts), self.lift(logs, np.concatenate(ids), starts)
        both = np.logaddexp(np.log(self.weight) + share + lift, np.log1p(-self.weight) + word)
        return np.add.reduceat(both, np.cumsum(count) - count), word - lift

    def gain(self, total: int) -> str:
        """SQL for what a word's corpus share adds to a text's log probability: `n` is its count, `x` what `score` gives for it."""
        odds = f"({float(np.log(self.weight) - np.log1p(-self.weight) - np.log(total))!r}D + ln(n) - x)"
        return f"greatest({odds}, 0D) + log1p(exp(-abs({odds})))"

    def weigh(self, odds: np.ndarray, times: np.ndarray) -> None:
        """Fits the weight of the corpus shares by a few steps of expectation and maximisation. `odds`: log of share over probability."""
        for _ in range(20):
            own = 1 / (1 + np.exp(-(np.log(self.weight) - np.log1p(-self.weight) + odds)))
            self.weight = float(np.clip((own * times).sum() / times.sum(), 0.02, 0.9))

    def dense(self) -> np.ndarray:
        """All weights but the embeddings as rows of WIDTH."""
        flat = np.concatenate([self.w[k].ravel() for k in sorted(self.w)]).astype(float)
        return np.append(flat, np.zeros(-len(flat) % WIDTH)).reshape(-1, WIDTH)

    def move(self, change: np.ndarray) -> None:
        """Adds a change of the embeddings, and after them of the rows of `dense`."""
        self.embed = (self.embed + change[: self.size]).astype(np.float32)
        flat, at = (self.dense() + change[self.size :]).ravel(), 0
        for k in sorted(self.w):
            n = self.w[k].size
            self.w[k] = flat[at : at + n].reshape(self.w[k].shape).astype(np.float32)
            at += n
        self.tables = None


class Steps:
    """Adam on a network; the embeddings of the ids of a step only."""

    def __init__(self, net: Network):
        self.net, self.done = net, 0
        net.tables = None
        self.moments, self.place = np.zeros((2, net.size, WIDTH), np.float32), np.zeros(net.size, np.int64)
        self.cells = np.zeros((0, WIDTH), np.int64)
        self.mean, self.square = (np.zeros(sum(p.size for p in net.w.values()), np.float32) for _ in range(2))

    def step(self, x: np.ndarray, y: np.ndarray, rate: float) -> np.ndarray:
        """One step on blocks; the log probabilities of the targets before it."""
        net, w, n = self.net, self.net.w, CONTEXT - 1
        scale = np.float32(1 / np.sqrt(WIDTH))
        e = net.embed.take(x, axis=0)
        eq = np.ascontiguousarray(e[:, n:])
        flat = lambda t: t.reshape(-1, t.shape[-1])
        by = lambda t, m: (flat(t) @ m).reshape(*t.shape[:-1], m.shape[1])
        # logits as products with the embeddings themselves, so that no keys and values are made of every id of a window
        wq, turned = w["q"] @ w["k"].T * scale, np.ascontiguousarray(e.transpose(0, 2, 1))
        q = by(eq, wq)
        s = q @ turned
        s += (w["r"][net.far] + net.mask).astype(np.float32)
        total = _attend(s, x)
        # shares of attention are left without their sums, which go on products with fewer columns
        mean = s @ e
        mean /= total
        over = 1 / total
        z = by(mean, w["v"])
        z += by(eq, w["u"])
        np.tanh(z, out=z)
        kind = net.kind.take(y.ravel())
        d = flat(z) @ w["c"]
        at, cells = np.arange(0, d.size, d.shape[1]) + kind, d.ravel()
        if net.highest() > SAFE:
            d += w["b"]
            d -= d.max(axis=1, keepdims=True)
            odds, hit = np.ones_like(w["b"]), cells.take(at)
        else:
            odds, hit = np.exp(w["b"]), cells.take(at) + w["b"].take(kind)
        np.exp(d, out=d)
        total = d @ odds
        real = (y != PAD).ravel()
        # the gradient of the logits but for factors by row and by class, which are cheaper to put on their products
        cells[at] = cells.take(at) - total / odds.take(kind)
        by_row = (real / (total * max(1, real.sum()))).astype(np.float32)[:, None]
        slope = np.square(z)
        np.subtract(1, slope, out=slope)
        slope *= by_row.reshape(*z.shape[:2], 1)
        dz = (d @ (w["c"] * odds).T).reshape(z.shape)
        dz *= slope
        dmean = by(dz, w["v"].T)
        dmean *= over
        ds = dmean @ turned
        ds -= (flat(dmean * mean) @ np.ones(WIDTH, np.float32)).reshape(*dz.shape[:2], 1)
        ds *= s
        de = ds.transpose(0, 2, 1) @ q
        de += s.transpose(0, 2, 1) @ dmean
        dq = ds @ e
        own = by(dq, wq.T)
        own += by(dz, w["u"].T)
        de[:, n:] += own
        # many products of some blocks each are faster than one of tall matrices
        some = 4 if len(x) % 4 == 0 else 1
        sums = lambda a, b: (np.swapaxes(a.reshape(len(x) // some, -1, a.shape[-1]), 1, 2) @ b.reshape(len(x) // some, -1, b.shape[-1])).sum(axis=0)
        last = sums(eq, dq)
        grads = {
            "q": last @ w["k"] * scale, "k": last.T @ w["q"] * scale, "v": sums(mean, dz), "u": sums(eq, dz),
            "c": sums(flat(z) * by_row, d) * odds, "b": by_row[:, 0] @ d * odds, "r": np.bincount(net.far.ravel(), weights=ds.sum(0).ravel(), minlength=2 * CONTEXT),
        }
        ids = x.ravel()
        places = np.arange(len(ids))
        self.place[ids] = places
        found = ids[self.place.take(ids) == places]
        self.place[found] = places[: len(found)]
        back = self.place.take(ids)
        rows = np.zeros((len(found), WIDTH), np.float32)
        if len(self.cells) < len(found):
            self.cells = _cells(np.arange(2 * len(found))).reshape(-1, WIDTH)
        np.add.at(rows.ravel(), self.cells.take(back, axis=0).ravel(), de.ravel())
        self.done += 1
        rate *= np.sqrt(1 - 0.99**self.done) / (1 - 0.9**self.done)
        g = np.concatenate([grads[name].ravel() for name in w]).astype(np.float32)
        self.mean += np.float32(0.1) * (g - self.mean)
        self.square += np.float32(0.01) * (g * g - self.square)
        change = np.float32(rate) * self.mean / (np.sqrt(self.square) + np.float32(1e-8))
        at = 0
        for p in w.values():
            p -= change[at : at + p.size].reshape(p.shape)
            at += p.size
        m1, m2 = (m.take(found, axis=0) for m in self.moments)
        m1 *= np.float32(0.9)
        m2 *= np.float32(0.99)
        m1 += np.float32(0.1) * rows
        rows *= rows
        rows *= np.float32(0.01)
        m2 += rows
        for held, made in zip(self.moments, (m1, m2), strict=True):
            held.view(_ROW)[found] = made.view(_ROW)
        np.sqrt(m2, out=m2)
        m2 += np.float32(1e-8)
        m1 *= np.float32(rate)
        m1 /= m2
        net.embed.view(_ROW)[found] = (net.embed.take(found, axis=0) - m1).view(_ROW)
        return hit - np.log(total) + net.share.take(y.ravel())


def _texts(batch, column: int = 1) -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def _groups(texts: list[str], limit: int = 400_000):
    """Places of texts that follow one another, of about `limit` code points together."""
    some, size = [], 0
    for i, x in enumerate(texts):
        some.append(i)
        size += len(x)
        if size >= limit:
            yield some
            some, size = [], 0
    if some:
        yield some


@dataclass
class Encoded:
    """Some texts as places of their words among distinct ones; the last of those is the end, which closes every text."""

    count: np.ndarray  #: words and end of each text
    word: np.ndarray  #: place of each
    size: np.ndarray  #: ids of each distinct word, and of the end
    pool: np.ndarray  #: those ids

    @staticmethod
    def of(texts: list[str], path: str) -> Encoded:
        """A long text is put together from its parts."""
        known, size = _words_table(path)
        none = np.zeros(0, np.int64)
        owner, word, hashes, sizes, pools = [none], [none], [np.zeros(0, np.uint64)], [none], [np.zeros(0, np.uint32)]
        for at, parts in _text.chunks(texts):
            joined, start, end, every, cut = _spans(parts)
            if not len(start):
                continue
            back, found, first = _text.distinct(every)
            slot = known.slots(found, joined, start[first], end[first])
            owner.append(np.repeat(np.array(at, np.int64), np.diff(cut)))
            word.append(back + sum(map(len, hashes)))
            hashes.append(found)
            sizes.append(known.length[slot])
            pools.append(_text.gather(known.pool, known.offset[slot], sizes[-1])[0])
        owner, word, hashes, sizes, pool = map(np.concatenate, (owner, word, hashes, sizes, pools))
        if len(pools) > 2:
            back, hashes, first = _text.distinct(hashes)
            pool, word = _text.gather(pool, (np.cumsum(sizes) - sizes)[first], sizes[first])[0], back[word]
            sizes = sizes[first]
        owner, word = np.append(owner, np.arange(len(texts))), np.append(word, np.full(len(texts), len(hashes)))
        # parts of long texts may come before the texts before them
        order = np.argsort(owner, kind="stable")
        places, ids = np.uint16 if len(hashes) < 1 << 16 else np.uint32, np.uint16 if size <= 1 << 16 else np.uint32
        return Encoded(np.bincount(owner, minlength=len(texts)), word[order].astype(places), np.append(sizes, 1), np.append(pool, END).astype(ids))

    def blobs(self) -> list[bytes]:
        sizes = np.uint8 if self.size.max() < 1 << 8 else np.uint32
        return [x.tobytes() for x in (np.append(len(self.size), self.count), self.word, self.size.astype(sizes), self.pool)]

    @staticmethod
    def read(blobs: list) -> Encoded:
        whole = lambda blob, n: np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64)
        n, *count = np.frombuffer(blobs[0], np.int64)
        size = whole(blobs[2], n)
        return Encoded(np.array(count), whole(blobs[1], int(sum(count))), size, whole(blobs[3], int(size.sum())))

    def hashes(self) -> np.ndarray:
        """Of the ids of each distinct word, which tell it from all others, without the end."""
        ends = np.cumsum(self.size)
        return _text.Spans(self.pool).of((ends - self.size)[:-1], ends[:-1])

    def texts(self) -> tuple[list[np.ndarray], np.ndarray]:
        """Ids of each text, and of each word and end how many ids it has."""
        each = self.size[self.word]
        flat, at = _text.gather(self.pool.astype(np.int64), (np.cumsum(self.size) - self.size)[self.word], each)
        return np.split(flat, at[np.cumsum(self.count)[:-1]]), each


#: kind 0: word hash and count; 1: rows of a table of whole numbers, BLOCK of them from key * BLOCK on.
PARTS = "kind int, key long, n long, blob binary"
#: kind 2: training texts, 3: others; `of`: their ids, and what `Encoded.blobs` gives.
BLOBS = ["count", "word", "size", "pool"]


def _part(kind: int, key: np.ndarray, n: np.ndarray):
    """Arrow batches of PARTS without blobs."""
    for a in range(0, len(key), 200_000):
        k = key[a : a + 200_000].astype(np.int64)
        yield [pa.array(np.full(len(k), kind, np.int32)), pa.array(k), pa.array(n[a : a + 200_000].astype(np.int64)), pa.nulls(len(k), pa.binary())]


def _table(sums: np.ndarray):
    """Arrow batches of PARTS with the rows of a table of whole numbers, without blocks of zeros."""
    for key in range(-(-len(sums) // BLOCK)):
        some = sums[key * BLOCK : (key + 1) * BLOCK]
        if some.any():
            yield [pa.array([1], pa.int32()), pa.array([key], pa.int64()), pa.nulls(1, pa.int64()), pa.array([some.astype(np.int64).tobytes()])]


def _added(parts: DataFrame, rows: int, columns: int) -> np.ndarray:
    """Sum of the tables of all tasks."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = np.frombuffer(blob.as_buffer(), np.int64)
                sums[key] = sums[key] + own if key in sums else own.copy()
        for key, own in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([own.tobytes()])], ["key", "blob"])

    out = np.zeros((rows, columns), np.int64)
    for key, blob in parts.filter("kind = 1").select("key", "blob").repartition("key").mapInArrow(run, "key long, blob binary").collect():
        out[key * BLOCK : (key + 1) * BLOCK] = np.frombuffer(blob, np.int64).reshape(-1, columns)
    return out


def _encoded(docs: DataFrame, path: str) -> DataFrame:
    """All texts encoded (kinds 2 and 3); of the training texts, for each task, counts of words (kind 0) and a table of ids (kind 1): their times, how many words begin with them, the sums around them."""
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        _, size = _words_table(path)
        net = Network(size)
        net.vectors, net.cells = net.index(), _cells(np.arange(size)).reshape(-1, WIDTH)
        sums, around = np.zeros((2, size)), np.zeros((size, WIDTH))
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size_held, type_of = 0, None
        names = ["kind", "key", "n", "blob", "of", *BLOBS]

        def full():
            back, found, _ = _text.distinct(np.concatenate([h for h, _ in held]))
            return found, np.bincount(back, weights=np.concatenate([n for _, n in held]))

        def counted(made):
            for part in made:
                more = [pa.nulls(len(part[0]), pa.list_(type_of)), *(pa.nulls(len(part[0]), pa.binary()) for _ in BLOBS)]
                yield pa.RecordBatch.from_arrays([*part, *more], names)

        for batch in batches:
            texts, apart, type_of = _texts(batch), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), batch.column(0).type
            for out in (False, True):
                places = np.flatnonzero(apart == out)
                for some in _groups([texts[i] for i in places]):
                    at = places[some]
                    made = Encoded.of([texts[i] for i in at], path)
                    own = pa.ListArray.from_arrays(pa.array([0, len(at)], pa.int32()), batch.column(0).take(pa.array(at)))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([3 if out else 2], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), own, *(pa.array([x]) for x in made.blobs())], names
                    )
                    if out:
                        continue
                    times = np.bincount(made.word, minlength=len(made.size))
                    sums[0] += np.bincount(made.pool, weights=np.repeat(times, made.size), minlength=size)
                    sums[1] += np.bincount(made.pool[np.cumsum(made.size) - made.size], weights=times, minlength=size)
                    net.around(made.texts()[0], around)
                    held.append((made.hashes(), times[:-1]))
                    size_held += len(times)
                    if size_held > 3_000_000:
                        yield from counted(_part(0, *full()))
                        held, size_held = [], 0
        if held:
            yield from counted(_part(0, *full()))
        if type_of is not None:
            yield from counted(_table(np.concatenate((sums.T, around), axis=1)))
        del held, net, sums, around
        _text.release()

    return docs.mapInArrow(run, f"{PARTS}, of array<{kind}>, {', '.join(f'{c} binary' for c in BLOBS)}")


def _read(batch, first: int = 0):
    """The rows of an Arrow batch with the columns BLOBS from the place `first` on."""
    for k in range(batch.num_rows):
        yield Encoded.read([batch.column(first + c)[k].as_buffer() for c in range(len(BLOBS))])


class Shares:
    """Counts of the commonest words by hash, and of ends."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, ends: int, total: int):
        self.keys, self.ends, self.total = keys, ends, max(1, total)
        self.counts = np.append(counts, 0).astype(float)

    @cached_property
    def index(self) -> _text.Index:
        made = _text.Index()
        made.add(self.keys)
        return made

    def of(self, words: np.ndarray) -> np.ndarray:
        """Count of each word, 0 if it is not among them, and after them that of ends."""
        return np.append(self.counts[self.index.find(words)], self.ends)

    def logs(self, counts: np.ndarray) -> np.ndarray:
        """Log shares of words with these counts."""
        with np.errstate(divide="ignore"):
            return np.log(counts / self.total)


def _ids_of(texts: list[str], path: str):
    """Of each text: ids with the end, word hashes, ids of each word and of the end."""
    made = Encoded.of(texts, path)
    ids, each = made.texts()
    cuts = np.cumsum(made.count)[:-1]
    hashes = made.hashes()
    return ids, [hashes[w[:-1]] for w in np.split(made.word, cuts)], np.split(each, cuts)


def _start(docs: DataFrame, total: int, id_col: str) -> list[str]:
    """About ROWS of `total` texts, drawn and ordered by hashes of their ids; of a long text a window at a place drawn by hash."""
    near = docs.filter(F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 20)) < int(min(1.0, ROWS / max(1, total)) * (1 << 20)) + 1)
    window = F.expr(f"substring(text, 1 + cast(pmod(xxhash64({id_col}, 5), greatest(length(text) - {CHARS}, 0) + 1) as int), {CHARS})")
    got = near.select(F.xxhash64(F.col(id_col), F.lit(4)).alias("at"), F.col(id_col), F.coalesce(window, F.lit("")).alias("text"))
    return got.orderBy("at", id_col, "text").limit(2 * ROWS).toPandas().drop_duplicates("text")["text"].tolist()


def _pass(encoded: DataFrame, net, common) -> DataFrame:
    """One pass of each task over all its training texts from the given network. kind 1: a table of ids (then of the rows of `dense`), their times and their change times these;
    3: log odds of corpus share over the network's probability in steps, and how many words; 4: hash of a word that is not shared, and its log probability in steps."""

    def run(batches):
        _words_table.cache_clear()  # a worker that has encoded texts needs its words no more
        _text.release()
        own, shares, start = None, common.value, net.value
        odds = np.zeros(2 * int(FAR / STEP) + 1, np.int64)
        trained = 0

        def made(parts):
            for part in parts:
                yield pa.RecordBatch.from_arrays(part, ["kind", "key", "n", "blob"])

        for batch in batches:
            if own is None:
                own = copy.deepcopy(start)
                steady, draw, times = Steps(own), np.random.default_rng(SEED), np.zeros(own.size, np.int64)
            for group in _read(batch):
                ids, size = group.texts()
                seen, target, _ = own.blocks(ids)
                times += np.bincount(seen.ravel(), minlength=own.size)
                logs = np.empty(target.shape)
                order = draw.permutation(len(seen))
                for a in range(0, len(order), PASS_BATCH):
                    at = order[a : a + PASS_BATCH]
                    logs[at] = steady.step(seen[at], target[at], PASS_RATE / (1 + steady.done / HALF) ** 0.5).reshape(len(at), CONTEXT)
                trained += int(size.sum())
                flat, starts = logs[target != PAD], np.cumsum(size) - size
                # what lifts a share by the class before the network learned from it counts against the ids' own probability
                word = np.add.reduceat(flat, starts) - own.lift(flat, np.concatenate(ids), starts)
                hashes = group.hashes()
                share = shares.logs(shares.of(hashes))[group.word]
                known = np.isfinite(share)
                odds += np.bincount(_steps(share[known] - word[known]) + len(odds) // 2, minlength=len(odds))
                if not known.all():
                    yield from made(_part(4, hashes[group.word[~known]].view(np.int64), np.rint(word[~known] / STEP)))
        if own is None:
            return
        some = np.flatnonzero(times)
        change = np.zeros((own.size, WIDTH))
        change[some] = np.rint((own.embed[some] - start.embed[some]).astype(float) * times[some, None] * UNIT)
        dense = np.rint((own.dense() - start.dense()) * trained * UNIT)
        times = np.append(times, np.full(len(dense), trained))
        yield from made(_table(np.column_stack((times, np.concatenate((change, dense))))))
        some = np.flatnonzero(odds)
        yield from made(_part(3, some - len(odds) // 2, odds[some]))
        _text.release()

    return encoded.filter("kind = 2").select(*BLOBS).mapInArrow(run, PARTS)


def _steps(odds: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(odds, -FAR, FAR) / STEP).astype(np.int64)


def fit(docs: DataFrame, encoded: DataFrame, counts: DataFrame, ids: np.ndarray, shares: Shares, common, scratch: Scratch, path: str) -> Network:
    """The network of all training texts, with the shares of the whole corpus. `ids`: the table of `_encoded`."""
    every = ids[:, 0]
    size = len(every)
    net = Network(size)
    if not every[END]:
        net.shares(every)
        return net
    net.group(every, ids[:, 2:].astype(float))
    net.shares(every)
    net.beginnings(ids[:, 1])
    start = _ids_of(_start(docs, int(every[END]), "id"), path)[0]
    some = int(np.searchsorted(np.cumsum([len(x) for x in start]), TOKENS))
    net.train(start[: max(1, some)])
    parts = scratch.put(_pass(encoded, docs.sparkSession.sparkContext.broadcast(net), common), "pass")
    sums = _added(parts, size + len(net.dense()), 1 + WIDTH)
    net.move(sums[:, 1:] / UNIT / np.maximum(1, sums[:, :1]))
    rare = parts.filter("kind = 4").select("key", F.col("n").alias("_p")).join(counts, "key")
    odds = F.ln(F.col("n") / shares.total) - F.col("_p") * STEP
    rare = rare.select(F.rint(F.greatest(F.least(odds, F.lit(FAR)), F.lit(-FAR)) / STEP).cast("long").alias("key"), F.lit(1).cast("long").alias("n"))
    seen = parts.filter("kind = 3").select("key", "n").unionByName(rare).groupBy("key").agg(F.sum("n").alias("n")).orderBy("key").toPandas()
    net.weigh(seen["key"].to_numpy(float) * STEP, seen["n"].to_numpy(float))
    scratch.drop(parts)
    return net


def score_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`id_col`, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark)
    kind = docs.schema[id_col].dataType.simpleString()
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), (crc_mod(id_col, FOLDS) == 2).alias("held"))
    encoded = scratch.put(_encoded(docs, path), "encoded")
    counts = scratch.put(encoded.filter("kind = 0").select("key", "n").repartition("key").groupBy("key").agg(F.sum("n").alias("n")), "counts")
    ids_table = _added(encoded, _words_table(path)[1], 2 + WIDTH)
    ends = int(ids_table[END, 0])
    steps = sorted(counts.groupBy(F.least("n", F.lit(20_000)).alias("c")).agg(F.count("*"), F.sum("n")).collect(), reverse=True)
    total, kinds = ends + sum(x[2] for x in steps), (1 if ends else 0) + sum(x[1] for x in steps)
    least, n = 20_001, 0
    for c, k, _ in steps:
        if n + k > TOP:
            break
        least, n = c, n + k
    top = counts.filter(f"n >= {least}").toPandas()
    shares = Shares(top["key"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(), ends, total)
    common = spark.sparkContext.broadcast(shares)
    fitted = fit(docs.filter("not held").drop("held"), encoded, counts, ids_table, shares, common, scratch, path)
    net = spark.sparkContext.broadcast(fitted)

    def run(batches):
        shares = common.value
        task, row = TaskContext.get().partitionId() << 36, 0
        names = ["row", "id", "held_out", "tokens", "known", "logs", "score", "word", "x"]
        rest = [pa.int64(), None, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        for batch in batches:
            rest[1] = batch.column(1).type.value_type
            for k, group in enumerate(_read(batch, 2)):
                ids, size = group.texts()
                hashes = group.hashes()
                counted = shares.of(hashes)
                score, logs = net.value.score(ids, size, shares.logs(counted)[group.word], group.count)
                at, n = np.cumsum(group.count) - group.count, len(group.count)
                seen = np.add.reduceat((counted > 0).astype(np.int64)[group.word], at)
                sums = np.add.reduceat(np.log10(counted + 1)[group.word], at)
                own = task + row + np.arange(n)
                none = [pa.nulls(n, t) for t in rest[-2:]]
                held = pa.array(np.full(n, batch.column(0)[k].as_py() == 3))
                yield pa.RecordBatch.from_arrays([pa.array(own), batch.column(1)[k].values, held, *(pa.array(x) for x in (group.count, seen, sums, score)), *none], names)
                rare = counted == 0
                rare[-1] = False
                miss = np.flatnonzero(rare[group.word])
                if len(miss):
                    owner, word = np.repeat(own, group.count)[miss], hashes[group.word[miss]].view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(owner), *(pa.nulls(len(miss), t) for t in rest[1:-2]), pa.array(word), pa.array(logs[miss])], names)
                row += n

    schema = f"row long, id {kind}, held_out boolean, tokens long, known long, logs double, score double, word long, x double"
    made = scratch.put(encoded.filter("kind >= 2").select("kind", "of", *BLOBS).mapInArrow(run, schema), "scores")
    scratch.drop(encoded)
    rare = made.filter("word is not null").select("row", "word", "x")
    other = counts.filter(f"n < {least}").select(F.col("key").alias("word"), "n")
    more = rare.join(other, "word").groupBy("row").agg(F.count("*").alias("_k"), F.sum(F.log10(F.col("n") + 1)).alias("_l"), F.sum(F.expr(fitted.gain(max(1, total)))).alias("_s"))
    more = scratch.put(more, "rare")
    rows = made.filter("word is null").drop("word", "x").join(more, "row", "left")
    floor = float(np.log10(total + kinds + 1))
    return rows.select(
        F.col("id").alias(id_col),
        "held_out",
        F.col("tokens").alias("n_tokens"),
        (F.col("known") + F.coalesce("_k", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.coalesce("_l", F.lit(0.0)) - F.col("tokens") * floor).alias("base_score"),
        ((F.col("score") + F.coalesce("_s", F.lit(0.0))) / float(np.log(10))).alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return score_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(byte_bpe.RANKS))


