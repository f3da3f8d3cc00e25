"""Text as numpy arrays: code points, their classes, runs, hashes of spans, and a table of encoded pieces.

Everything works on chunks of about CHUNK code points, cut between pieces, so that memory does
not follow the length of a text or the size of an Arrow batch.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

CHUNK = 300_000
OTHER, LETTER, NUMBER, SPACE, ODD = 0, 1, 2, 3, 4
#: The code points that \s stands for in the libraries' patterns.
WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: The endings that the pattern takes together with an apostrophe.
ENDINGS_1, ENDINGS_2 = "stmd", ("re", "ve", "ll")

_cache: dict[str, np.ndarray] = {}


def classes() -> np.ndarray:
    """Class of every code point; ODD for those that Unicode versions may class differently."""
    if "classes" not in _cache:
        t = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))
            t[c] = LETTER if k[0] == "L" else NUMBER if k[0] == "N" else ODD if k == "Cn" else OTHER
        t[WHITE] = SPACE
        _cache["classes"] = t
    return _cache["classes"]


def lower_codes() -> np.ndarray:
    """Code point of the lower-case form, where that is one code point."""
    if "lower" not in _cache:
        t = np.arange(0x110000, dtype=np.uint32)
        for c in range(0x110000):
            x = chr(c).lower()
            if len(x) == 1:
                t[c] = ord(x)
        _cache["lower"] = t
    return _cache["lower"]


def chunks(texts: list[str], limit: int = CHUNK) -> Iterator[tuple[list[int], list[str]]]:
    """Indices and texts of about `limit` code points; a longer text comes in several pieces.

    A text is cut only before a space that stands alone between other characters, where a
    word and a piece of the pattern end.
    """
    at: list[int] = []
    got: list[str] = []
    size = 0
    for i, x in enumerate(texts):
        while len(x) > limit:
            cut = limit
            while True:
                cut = x.find(" ", cut)
                if cut < 0 or cut + 1 >= len(x) or not (x[cut - 1].isspace() or x[cut + 1].isspace()):
                    break
                cut += 1
            if cut < 0 or cut + 1 >= len(x):
                break
            yield [i], [x[:cut]]
            x = x[cut:]
        at.append(i)
        got.append(x)
        size += len(x)
        if size >= limit:
            yield at, got
            at, got, size = [], [], 0
    if at:
        yield at, got


def sliced(batches, rows: int = 1000):
    """Arrow batches of fewer rows, so that what a worker holds does not follow the size of a batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def release() -> None:
    """Gives freed memory back to the system: a worker that is used again would keep all that it ever held."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def frugal(run: Callable) -> Callable:
    """`run` over Arrow batches, which gives freed memory back after every batch that it makes and at its end."""

    def own(batches):
        for made in run(batches):
            yield made
            release()
        release()

    return own


def points(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """The joined text, its code points, and the offsets of the texts (one more than texts)."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    bounds = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(x) for x in texts], out=bounds[1:])
    return joined, codes, bounds


def piece_starts(codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Offsets at which the pieces of the byte-level pattern begin.

    Runs of letters, numbers or other characters take one space before them; of white space
    before a run the last character stays apart; an apostrophe that begins a run takes a
    following ending.
    """
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[codes]
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    run = np.empty(n, bool)
    run[0] = True
    np.not_equal(kind[1:], kind[:-1], out=run[1:])
    run |= first[:n]
    space = kind == SPACE
    start = run & space
    begin = np.flatnonzero(run & ~space)
    inner = begin[~first[begin]]
    after = inner[space[inner - 1]]
    start[after - 1] = True
    start[begin] = True
    start[after[codes[after - 1] == 32]] = False
    quotes = np.flatnonzero(start & (codes == 39))
    quotes = quotes[quotes + 1 < n]
    quotes = quotes[(kind[quotes + 1] == LETTER) & ~first[quotes + 1]]
    if len(quotes):
        one = np.isin(codes[quotes + 1], [ord(c) for c in ENDINGS_1])
        two = np.zeros(len(quotes), bool)
        more = np.flatnonzero(quotes + 2 < n)
        q = quotes[more]
        same = ~first[q + 2]
        for a, b in ENDINGS_2:
            two[more] |= same & (codes[q + 1] == ord(a)) & (codes[q + 2] == ord(b))
        for found, size in ((quotes[one], 2), (quotes[two & ~one], 3)):
            start[found + 1] = False
            end = found + size
            end = end[end < n]
            start[end] = True
    return np.flatnonzero(start)


_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_RI = np.uint64(pow(int(_R), -1, 1 << 64))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_cache.get("pow", ())) <= n:
        for name, r in (("pow", _R), ("inv", _RI)):
            x = np.full(max(n + 1, 2 * CHUNK), r, np.uint64)
            x[0] = 1
            _cache[name] = np.cumprod(x)
    return _cache["pow"], _cache["inv"]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Spans:
    """Hashes of spans of one chunk: 64-bit polynomial, so that equal spans hash alike anywhere."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.sums = np.zeros(n + 1, np.uint64)
        power, self.inverse = _powers(n)
        np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[:n], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        h = (self.sums[end] - self.sums[start]) * self.inverse[start]
        return mix(h + (end - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407))


def gather(pool: np.ndarray, offset: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slices of `pool` one after another, and where each begins (one more than slices)."""
    ends = np.zeros(len(length) + 1, np.int64)
    np.cumsum(length, out=ends[1:])
    at = np.repeat(offset - ends[:-1], length)
    at += np.arange(ends[-1])
    return pool[at], ends


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each value its place among the distinct ones, the distinct ones, and where each comes first."""
    back, found = pd.factorize(values)
    first = np.empty(len(found), np.int64)
    first[back[::-1]] = np.arange(len(values) - 1, -1, -1)
    return back, found, first


class Index:
    """Numbers of distinct 64-bit hashes: open addressing in arrays, looked up many at a time."""

    def __init__(self, bits: int = 14):
        self.n = 0
        self._room(bits)

    def _room(self, bits: int) -> None:
        self.mask = np.uint64((1 << bits) - 1)
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)

    def __len__(self) -> int:
        return self.n

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is not there."""
        at = hashes & self.mask
        out = self.values[at]
        open_ = np.flatnonzero((self.keys[at] != hashes) & (out >= 0))
        while len(open_):
            at = (at[open_] if len(at) > len(open_) else at) + np.uint64(1) & self.mask
            got = self.values[at]
            out[open_] = got
            more = (self.keys[at] != hashes[open_]) & (got >= 0)
            at, open_ = at[more], open_[more]
        return out

    def add(self, hashes: np.ndarray) -> None:
        """Gives the next numbers to hashes that are distinct and not there yet."""
        base, self.n = self.n, self.n + len(hashes)
        if 2 * self.n > len(self.keys):
            kept = np.flatnonzero(self.values >= 0)
            keys, values = self.keys[kept], self.values[kept]
            self._room(int(2 * self.n).bit_length())
            self._put(keys, values)
        self._put(hashes, np.arange(base, self.n, dtype=np.int32))

    def _put(self, hashes: np.ndarray, values: np.ndarray) -> None:
        at = hashes & self.mask
        while len(hashes):
            free = self.values[at] < 0
            self.values[at[free]] = values[free]
            mine = free & (self.values[at] == values)
            self.keys[at[mine]] = hashes[mine]
            at, hashes, values = at[~mine] + np.uint64(1) & self.mask, hashes[~mine], values[~mine]


class PieceTable:
    """Ids of pieces met so far, by the piece's hash. Beyond `limit` pieces a new table is begun, into which those of the last one move as they are met again."""

    def __init__(self, encode: Callable[[list[str]], list], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.last: PieceTable | None = None
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.used = 0
        self.pool = np.zeros(1 << 16, np.uint32)
        self.offset = np.zeros(1 << 14, np.int64)
        self.length = np.zeros(1 << 14, np.int64)

    def _renew(self) -> None:
        self.last = PieceTable(self.encode, self.limit)
        for name in ("index", "used", "pool", "offset", "length"):
            setattr(self.last, name, getattr(self, name))
        self.clear()

    def _add(self, hashes: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        base, need, total = len(self.index), len(self.index) + len(hashes), len(ids)
        if need > len(self.offset):
            for name in ("offset", "length"):
                old = getattr(self, name)
                new = np.zeros(max(need, 2 * len(old)), np.int64)
                new[: len(old)] = old
                setattr(self, name, new)
        if self.used + total > len(self.pool):
            new = np.zeros(max(self.used + total, 2 * len(self.pool)), np.uint32)
            new[: self.used] = self.pool[: self.used]
            self.pool = new
        self.pool[self.used : self.used + total] = ids
        self.length[base:need] = lengths
        self.offset[base:need] = self.used + np.cumsum(lengths) - lengths
        self.used += total
        self.index.add(hashes)

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces one after another, and how many each has."""
        made = self.encode(pieces)
        lengths = np.array([len(x) for x in made], np.int64)
        return np.fromiter((i for x in made for i in x), np.uint32, int(lengths.sum())), lengths

    def slots(self, hashes: np.ndarray, joined: str, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Places in `offset` and `length` of distinct pieces, which are spans of `joined`."""
        if len(self.index) + len(hashes) > self.limit and len(self.index):
            self._renew()
        found = self.index.find(hashes)
        for known in (True, False):
            new = np.flatnonzero(found < 0)
            if not len(new):
                break
            if known:
                at = np.zeros(0, np.int64) if self.last is None else self.last.index.find(hashes[new])
                new, at = new[: len(at)][at >= 0], at[at >= 0]
                if len(new):
                    lengths = self.last.length[at]
                    self._add(hashes[new], gather(self.last.pool, self.last.offset[at], lengths)[0], lengths)
            else:
                self._add(hashes[new], *self.encoded([joined[a:b] for a, b in zip(start[new].tolist(), end[new].tolist(), strict=True)]))
            found = self.index.find(hashes)
        return found

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts one after another, and where each text's begin (one more than texts)."""
        joined, codes, bounds = points(texts)
        starts = piece_starts(codes, bounds)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts) + 1, np.int64)
        ends = np.append(starts[1:], len(codes))
        back, hashes, first = distinct(Spans(codes).of(starts, ends))
        slots = self.slots(hashes, joined, starts[first], ends[first])[back]
        ids, at = gather(self.pool, self.offset[slots], self.length[slots])
        return ids, at[np.searchsorted(starts, bounds)]


def encode_texts(table: PieceTable, whole: Callable[[str], list[int]], texts: list[str], apart: tuple[str, ...] = ()) -> Iterator[np.ndarray]:
    """Ids of each text in turn. `whole` encodes the texts that hold code points of class ODD or a string of `apart`."""
    odd = classes() == ODD
    held: list[np.ndarray] = []
    last = -1
    for at, parts in chunks(texts):
        strange = [any(a in x for a in apart) or not x.isascii() and bool(odd[np.frombuffer(x.encode("utf-32-le"), np.uint32)].any()) for x in parts]
        ids, bounds = table.ids([("" if s else x) for s, x in zip(strange, parts, strict=True)])
        for k, i in enumerate(at):
            got = np.array(whole(parts[k]), np.uint32) if strange[k] else ids[bounds[k] : bounds[k + 1]]
            if i != last and last >= 0:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            held.append(got)
            last = i
    if held:
        yield held[0] if len(held) == 1 else np.concatenate(held)


def runs_of(kind: np.ndarray, bounds: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of one class begin and end; texts part them."""
    is_it = kind == wanted
    edge = np.zeros(len(kind) + 1, bool)
    edge[bounds] = True
    before = np.concatenate(([False], is_it[:-1]))
    after = np.concatenate((is_it[1:], [False]))
    return np.flatnonzero(is_it & (~before | edge[:-1])), np.flatnonzero(is_it & (~after | edge[1:])) + 1


class Rows:
    """Vectors of things met so far, by hash; forgotten as a whole beyond `limit`, except those known at first."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, limit: int = 400_000):
        self.known, self.base, self.limit = hashes.astype(np.uint64), values, limit
        self.clear()

    def clear(self) -> None:
        self.index = Index()
        self.index.add(self.known)
        self.values = np.zeros((max(1 << 14, 2 * len(self.base)), self.base.shape[1]), np.float32)
        self.values[: len(self.base)] = self.base

    def of(self, hashes: np.ndarray, make) -> np.ndarray:
        """Row numbers in `values` of distinct hashes; make(places among `hashes`) gives the rows of those not met before."""
        if len(self.index) > len(self.known) + self.limit:
            self.clear()
        got = self.index.find(hashes)
        new = np.flatnonzero(got < 0)
        if len(new):
            base = len(self.index)
            if base + len(new) > len(self.values):
                wider = np.zeros((2 * (base + len(new)), self.values.shape[1]), np.float32)
                wider[: len(self.values)] = self.values
                self.values = wider
            self.values[base : base + len(new)] = make(new)
            self.index.add(hashes[new])
            got[new] = np.arange(base, base + len(new))
        return got
