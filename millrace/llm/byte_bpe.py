"""Byte-level BPE encoding and decoding with a rank file, exact merges in linear time.

Bytes are mapped to Latin-1 so that pyahocorasick finds the longest token that begins at a
byte of a piece. Encoding takes longest tokens and backtracks to shorter prefixes: a token may follow another only if merging in rank order would leave a boundary
between them. That test undoes both tokens' merges along the boundary and is memoised by pair,
and every dead position is visited once, so the time is linear in the piece.

Texts are split by the public pattern, each match encoded separately, without special tokens.

Defined cases: a null text counts as empty and has no ids; every row of the input, repeated or
not, gives one row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import importable, table
from millrace.llm._text import PieceTable, encode_texts, frugal

RANKS = "byte_bpe_multi_50k.tiktoken"
MEMO = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Merges:
    """The merge rules of a rank file."""

    def __init__(self, ranks: dict[bytes, int]):
        import ahocorasick

        self.ranks = ranks
        self.tokens: dict[int, bytes] = {i: t for t, i in ranks.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.shorter: dict[int, int] = {}
        self.memo: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for token, i in ranks.items():
            halves = self._halves(token, i)
            if halves:
                self.split[i] = halves
                self.automaton.add_word(token.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.known = {self.tokens[i].decode("latin-1"): i for i in self.split}
        self.size = {i: len(t) for i, t in self.tokens.items()}
        self.widest = max(map(len, self.known))
        for i in self.split:
            token = self.tokens[i]
            for k in range(len(token) - 1, 0, -1):
                j = ranks.get(token[:k])
                if j in self.split:
                    self.shorter[i] = j
                    break

    def _halves(self, token: bytes, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; a single byte is its own halves; None if merging never makes it."""
        if len(token) == 1:
            return rank, rank
        parts = [token[k : k + 1] for k in range(len(token))]
        while len(parts) > 2:
            best, at = rank, -1
            for k in range(len(parts) - 1):
                r = self.ranks.get(parts[k] + parts[k + 1], rank)
                if r < best:
                    best, at = r, k
            if at < 0:
                return None
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def together(self, left: int, right: int) -> bool:
        """Whether merging in rank order keeps a boundary between these two."""
        key = left << 20 | right
        found = self.memo.get(key)
        if found is None:
            if len(self.memo) >= MEMO:
                self.memo.clear()
            found = self.memo[key] = self._together(left, right)
        return found

    def _together(self, left: int, right: int) -> bool:
        ranks, tokens, split = self.ranks, self.tokens, self.split
        below = len(ranks) + 1
        while True:
            joint = ranks.get(tokens[left] + tokens[right])
            if joint is not None and joint < below:
                return False
            # the later of the two merges is undone first; of equals, the one on the left happened first
            undo_left = left > right
            for _ in range(2):
                if undo_left:
                    if split[left][0] != left:
                        below, left = left, split[left][1]
                        break
                elif split[right][0] != right:
                    below, right = right + 1, split[right][0]
                    break
                undo_left = not undo_left
            else:
                return True

    def _longest(self, text: str) -> int:
        """The longest token that is a prefix of `text`."""
        known = self.known
        k = self.automaton.longest_prefix(text)
        while (token := known.get(text[:k])) is None:
            k -= 1
        return token

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        size, shorter, memo, widest = self.size, self.shorter, self.memo, self.widest
        text = piece.decode("latin-1")
        n = len(text)
        dead = set()
        out: list[int] = []
        at, token = 0, self._longest(text[:widest])
        while True:
            end = at + size[token]
            if end not in dead:
                if out:
                    fits = memo.get(out[-1] << 20 | token)
                    if fits is None:
                        fits = self.together(out[-1], token)
                else:
                    fits = True
                if fits:
                    out.append(token)
                    if end == n:
                        return out
                    at, token = end, self._longest(text[end : end + widest])
                    continue
            while token not in shorter:
                dead.add(at)
                token = out.pop()
                at -= size[token]
            token = shorter[token]


@lru_cache(2)
def _engine(path: str):
    import public_tokenizers
    import regex

    merges = Merges(read_ranks(path))
    pattern = regex.compile(public_tokenizers.PATTERN)
    pieces = PieceTable(lambda xs: [merges.encode(x.encode()) for x in xs])

    def whole(text: str) -> list[int]:
        return [i for x in pattern.findall(text) for i in merges.encode(x.encode())]

    size = max(merges.tokens) + 1
    length = np.zeros(size, np.int64)
    for i, t in merges.tokens.items():
        length[i] = len(t)
    offset = np.cumsum(length) - length
    flat = np.frombuffer(b"".join(merges.tokens.get(i, b"") for i in range(size)), np.uint8)
    return pieces, whole, flat, offset, length


def encode(texts: list[str], path: str) -> Iterator[np.ndarray]:
    """Ids of each text in turn."""
    pieces, whole, *_ = _engine(path)
    return encode_texts(pieces, whole, texts)


def decode(ids: np.ndarray, path: str, step: int = 1 << 18) -> bytes:
    """The bytes that the ids stand for."""
    *_, flat, offset, length = _engine(path)
    parts = []
    for k in range(0, len(ids), step):
        some = ids[k : k + step]
        size = length[some]
        ends = np.cumsum(size)
        at = np.repeat(offset[some] - (ends - size), size)
        at += np.arange(len(at))
        parts.append(flat[at].tobytes())
    return b"".join(parts)


def encode_documents(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> DataFrame:
    """`id_col`, n_tokens, and ids (little-endian unsigned 32-bit integers) with the bytes decoded from them.

    With `digests`, ids_sha256 and decoded_sha256 of these two instead, taken where they are made.
    """
    importable(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    types = "string" if digests else "binary"

    def run(batches):
        for batch in batches:
            counts, left, right = [], [], []
            for ids in encode([x or "" for x in batch.column(1).to_pylist()], path):
                raw, back = ids.astype("<u4").tobytes(), decode(ids, path)
                counts.append(len(ids))
                left.append(hashlib.sha256(raw).hexdigest() if digests else raw)
                right.append(hashlib.sha256(back).hexdigest() if digests else back)
            made = pa.string() if digests else pa.binary()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(left, made), pa.array(right, made)], [id_col, "n_tokens", *names]
            )

    schema = f"`{id_col}` {kind}, n_tokens long, {names[0]} {types}, {names[1]} {types}"
    return docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_text")).mapInArrow(frugal(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), digests=True)
