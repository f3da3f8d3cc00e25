"""N-gram Jaccard join with adaptive multi-match prefixes; classes of linked documents.

A document is the set of its distinct shingles; two link at NUM/DEN similarity or more.

1. Documents with equal sets become one class; the rest works on one document of each class.
2. A fixed-size sketch of shingle counts gives all documents the same order, rarest first. A
   document keeps the shortest prefix that a link must hit `l` times, where `l` grows with the
   estimated candidates of its prefix: two documents that link share at least min(l, l')
   shingles of their prefixes (and none more is dropped).
3. Families. The centre of a shingle is the document of its posting with the commonest
   shingles; a document joins the centre that spares it most candidates, if these are many or a
   good part of its prefix points there (but leaves it again if it proves too far from the centre
   to link with what links to it, and has few candidates). Documents that link to their centre
   are done. Let D = x ^ centre. As |x ^ y| = |D_x ^ D_y|, a document that does not link to its
   centre needs shingles outside the centre in common with any partner of its family: at least
   `least_shared`. So only a prefix of those outside is looked up, as in 2. Documents that find
   too few are alone in their family; the others are compared with it in blocks of bounded size.
   So a family costs a comparison per member, and not one per pair.
4. Documents of different families that share enough prefix shingles are verified one by one; of
   a shingle's postings those of its commonest family are not paired with one another.
5. Components of the verified links.

Shingles are 64-bit hashes. Defined cases: null, empty and wordless texts have an empty set and
link with nothing; a shorter text than a shingle is one shingle; copies have one class; rows
that share an id are the same document; a null id has a null component; empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import _text
from millrace.llm._common import Scratch, apart, importable, narrowed, table
from millrace.llm._components import components

WORDS, NUM, DEN = 4, 85, 100
#: Cells of the sketch (8 MB), and the rows in which each task hands over its own.
SKETCH, PIECES = 1 << 20, 64
#: Share of its prefix by which a document joins a centre, or candidates that it would have outside.
NEAR, COSTLY = 0.15, 64
#: Code points that a worker hashes at a time.
CHUNK = 250_000
#: Documents on either side of a comparison.
BLOCK = 128
_STEP = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(texts: list[str]) -> Iterator[np.ndarray]:
    """Hash of every word of each text: runs of anything but ASCII white space, A-Z lower-cased."""
    held: list[np.ndarray] = []
    last = -1
    for at, parts in _text.chunks(texts, CHUNK):
        _, codes, bounds = _text.points(parts)
        low = np.where((codes >= 65) & (codes <= 90), codes + 32, codes)
        white = (codes == 32) | ((codes >= 9) & (codes <= 13))
        start, end = _text.runs_of(white.astype(np.uint8), bounds, 0)
        hashes = _text.Spans(low).of(start, end) if len(start) else np.zeros(0, np.uint64)
        cut = np.searchsorted(start, bounds)
        for k, i in enumerate(at):
            if i != last and last >= 0:
                yield held[0] if len(held) == 1 else np.concatenate(held)
                held = []
            held.append(hashes[cut[k] : cut[k + 1]])
            last = i
    if held:
        yield held[0] if len(held) == 1 else np.concatenate(held)


def shingles(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """The distinct shingles of a text, sorted."""
    size = min(size, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = words[:n] + np.uint64(size)
    for k in range(1, size):
        out = _text.mix(out * _STEP + words[k : k + n])
    return np.unique(out)


def _need(n: int, num: int, den: int) -> int:
    """Shingles that any partner must share with a set of n."""
    return -(-num * n // den)


class Order:
    """All shingles in the order of their counts in the sketch, rarest first; of equal counts by hash."""

    def __init__(self, cells: np.ndarray):
        self.cells, self.usual = cells, float(cells.mean())

    def first(self, own: np.ndarray, need: int, several: list[int]) -> tuple[np.ndarray, int]:
        """The rarest shingles of a sorted set that hold `l` of any `need` of its shingles, and `l`: of `several` the one that costs least."""
        count = self.cells[(own & np.uint64(SKETCH - 1)).astype(np.int64)]
        order = np.argsort(count, kind="stable")
        excess = np.cumsum(np.maximum(count[order] - self.usual - 4 * np.sqrt(self.usual) - 1, 0))
        best, cost = 1, np.inf
        for l in sorted({min(need, x) for x in several}):
            size = len(own) - need + l
            now = size + excess[size - 1] / l
            if now < cost:
                best, cost = l, now
        return own[order[: len(own) - need + best]], best


def prefix(own: np.ndarray, order: Order, num: int, den: int) -> tuple[np.ndarray, int]:
    """Rarest shingles of a set and how many of them a partner must have."""
    n = len(own)
    if n * (den - num) < num:
        return own[:0], 0
    return order.first(own, _need(n, num, den), [2 + n // 25, 3 + n // 12])


def least_shared(n: int, centre: int, both: int, num: int, den: int) -> int:
    """Shingles outside the centre that a set of n must share with any partner that was compared with the same centre.

    |x ^ y| = |D_x ^ D_y| may be (den-num)/(den+num) of the sizes at most. Without common
    shingles outside the centre it is at least |D_x| - |centre| + |y|, which grows with |y|
    faster than what is allowed; so the smallest possible partner sets the bound.
    """
    least = _need(n, num, den)
    gap = (den + num) * (n - 2 * both + least) - (den - num) * (n + least)
    return -(-gap // (2 * (den + num)))


def outside(x: np.ndarray, centre: np.ndarray, order: Order, num: int, den: int) -> tuple[int, np.ndarray, int | None]:
    """Shingles in common, the prefix of those of x that the centre lacks, and how many of it a partner must have (None: perhaps none)."""
    at = np.searchsorted(centre, x)
    at[at == len(centre)] = 0
    inside = centre[at] == x if len(centre) else np.zeros(len(x), bool)
    both, own = int(inside.sum()), x[~inside]
    need = least_shared(len(x), len(centre), both, num, den)
    if need <= 0:
        return both, own, None
    if need > len(own):
        return both, own[:0], len(x)
    return both, *order.first(own, need, [4 + len(own) // 6])


def _linked(inter: Column, n: Column, m: Column, num: int, den: int) -> Column:
    return F.lit(den) * inter >= F.lit(num) * (n + m - inter)


def _sizes(n: str, m: str, num: int, den: int) -> Column:
    """Sets of these sizes could link."""
    return (F.col(n) * den >= F.col(m) * num) & (F.col(m) * den >= F.col(n) * num)


def _texts(batch) -> list[str]:
    return [x or "" for x in batch.column(1).to_pylist()]


def _profile(docs: DataFrame, size: int) -> DataFrame:
    """kind 0: `id`, `n`, two hashes of the set; kind 1: counts of shingles by cell, each task's in PIECES rows."""

    def run(batches):
        cells = np.zeros(SKETCH, np.uint32)
        names = ["kind", "id", "n", "h1", "h2", "cells"]
        for batch in _text.sliced(batches):
            n, h1, h2, seen = [], [], [], []
            for words in word_hashes(_texts(batch)):
                own = shingles(words, size)
                seen.append((own & np.uint64(SKETCH - 1)).astype(np.int64))
                n.append(len(own))
                h1.append(int(_text.mix(own + np.uint64(1)).sum(dtype=np.uint64).astype(np.int64)))
                h2.append(int(_text.mix(own ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
            if seen:
                cells += np.bincount(np.concatenate(seen), minlength=SKETCH).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(len(n), np.int32)), batch.column(0), *(pa.array(x, pa.int64()) for x in (n, h1, h2)), pa.nulls(len(n), pa.binary())], names
            )
        if cells.any():
            for k, part in enumerate(cells.reshape(PIECES, -1)):
                zero = pa.array([0], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([k], pa.int64()), zero, zero, zero, pa.array([part.astype("<u4").tobytes()], pa.binary())], names)

    return docs.mapInArrow(_text.frugal(run), "kind int, id long, n long, h1 long, h2 long, cells binary")


def _order(profile: DataFrame) -> Order:
    """The sum of all tasks' sketches; only their fixed number of cells comes to the driver."""

    def added(kind):
        def run(batches):
            total: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    part = np.frombuffer(raw.as_py(), kind)
                    total[k] = total[k] + part if k in total else part.astype("<i8")
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["id", "cells"])

        return run

    kinds = "id long, cells binary"
    parts = profile.filter("kind = 1").select("id", "cells").mapInArrow(added("<u4"), kinds)
    cells = np.zeros((PIECES, SKETCH // PIECES), np.int64)
    for k, raw in parts.repartition("id").mapInArrow(added("<i8"), kinds).collect():
        cells[k] = np.frombuffer(raw, "<i8")
    return Order(cells.ravel())


def _prefixes(docs: DataFrame, order, size: int, num: int, den: int) -> DataFrame:
    def run(batches):
        for batch in _text.sliced(batches):
            ids, parts, n, least = batch.column(0).to_numpy(zero_copy_only=False), [], [], []
            for words in word_hashes(_texts(batch)):
                own = shingles(words, size)
                some, l = prefix(own, order.value, num, den)
                parts.append(some)
                n.append(len(own))
                least.append(l)
            if not parts:
                continue
            k = np.array([len(x) for x in parts], np.int64)
            rows = [np.concatenate(parts).astype(np.int64), np.repeat(ids, k), *(np.repeat(np.array(x, np.int64), k) for x in (n, k, least))]
            for a in range(0, len(rows[0]), 200_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 200_000], pa.int64()) for x in rows], ["tok", "id", "n", "k", "l"])

    return docs.mapInArrow(_text.frugal(run), "tok long, id long, n long, k long, l long")


def _sets_of(texts: list, size: int) -> list[np.ndarray]:
    """The set of every text; equal ones, such as a centre's, are hashed once."""
    at: dict[str, int] = {}
    back = [at.setdefault(x or "", len(at)) for x in texts]
    made = [shingles(words, size) for words in word_hashes(list(at))]
    return [made[k] for k in back]


def _kept(docs: DataFrame, wanted: DataFrame, scratch: Scratch) -> DataFrame:
    """(id, text) of the wanted ids, and perhaps of some others.

    Texts are what joins shuffle, as they compress and 64-bit shingles do not; tasks make the sets of what they get.
    """
    return scratch.put(narrowed(docs, wanted, "id"), "texts")


def _only(texts: DataFrame, wanted: DataFrame, name: str) -> DataFrame:
    """The texts of the ids in a column of `wanted`, and a few others: what is not needed is not shuffled."""
    return narrowed(texts, wanted.select(F.col(name).alias("id")), "id").select("id", "text")


def _with_texts(pairs: DataFrame, texts: DataFrame, x: str, y: str) -> DataFrame:
    left = _only(texts, pairs, x).select(F.col("id").alias(x), F.col("text").alias("_tx"))
    right = _only(texts, pairs, y).select(F.col("id").alias(y), F.col("text").alias("_ty"))
    return pairs.join(left, x).join(right, y)


def _with_set(rows: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(fam, id, set) of the rows (fam, id)."""

    def run(batches):
        for batch in _text.sliced(batches):
            made = [x.astype("<u8").tobytes() for x in _sets_of(batch.column(2).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(made, pa.binary())], ["fam", "id", "set"])

    found = rows.join(_only(texts, rows, "id"), "id").select("fam", "id", "text")
    return found.mapInArrow(_text.frugal(run), "fam long, id long, set binary")


def _common(pairs: DataFrame, kinds: str, order, size: int, num: int, den: int) -> DataFrame:
    """Adds `both` (shingles in common) to pairs with texts, the prefix `own` of those of x that y lacks, and `lo`, how many of it are needed."""

    def run(batches):
        for batch in _text.sliced(batches):
            tx, ty = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("_tx", "_ty"))
            made = _sets_of(tx + ty, size)
            both, own, least = [], [], []
            for a, b in zip(made[: len(tx)], made[len(tx) :], strict=True):
                n, some, l = outside(a, b, order.value, num, den)
                both.append(n)
                own.append(some.astype(np.int64))
                least.append(l)
            keep = [c for c in batch.schema.names if c not in ("_tx", "_ty")]
            cols = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            made = [pa.array(both, pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(least, pa.int64())]
            yield pa.RecordBatch.from_arrays([*cols, *made], [*keep, "both", "own", "lo"])

    return pairs.mapInArrow(_text.frugal(run), kinds + ", both long, own array<long>, lo long")


def _compare_blocks(few: DataFrame, all_: DataFrame, num: int, den: int) -> DataFrame:
    """Links between `few` and `all_` of each family; both have (fam, id, set). A few links that connect, not all pairs."""
    sized = all_.groupBy("fam").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_nb"))
    sized = few.groupBy("fam").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("_nr")).join(sized, "fam")
    spread = lambda c: F.pmod(F.xxhash64("id"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = few.join(sized, "fam").select("fam", "id", "set", spread("_nr").alias("_r"), every("_nb").alias("_b"))
    right = all_.join(sized, "fam").select("fam", "id", "set", spread("_nb").alias("_b"), every("_nr").alias("_r"))

    def run(key, a, b):
        import pandas as pd

        ids = np.concatenate((a["id"].to_numpy(), b["id"].to_numpy()))
        sets = [np.frombuffer(x, "<u8") for x in [*a["set"], *b["set"]]]
        size = np.array([len(x) for x in sets])
        back, found = pd.factorize(np.concatenate(sets))
        doc = np.repeat(np.arange(len(sets)), size)
        order = np.argsort(back, kind="stable")
        begin = np.searchsorted(back[order], np.arange(len(found) + 1))
        ends = np.cumsum(size)
        top = np.arange(len(ids))

        def root(i):
            while top[i] != i:
                top[i] = top[top[i]]
                i = top[i]
            return i

        out = []
        for i in range(len(a)):
            own = back[ends[i] - size[i] : ends[i]]
            at, _ = _text.gather(order, begin[own], begin[own + 1] - begin[own])
            both = np.bincount(doc[at], minlength=len(sets))
            for j in np.flatnonzero(den * both >= num * (size + size[i] - both)).tolist():
                p, q = root(i), root(j)
                if p != q:
                    top[p] = q
                    out.append((ids[i], ids[j]))
        return pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    keys = ["fam", "_r", "_b"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(run, "a long, b long")


def _links(docs: DataFrame, order, reps: DataFrame, scratch: Scratch, size: int, num: int, den: int) -> DataFrame:
    """Links (a, b) between documents of different sets that connect what is to be connected."""
    chosen = narrowed(docs, reps.select(F.col("rep").alias("id")), "id")
    post = scratch.put(_prefixes(chosen, order, size, num, den), "prefixes")
    several = scratch.put(post.groupBy("tok").agg(F.count("*").alias("df")).filter("df > 1"), "tokens")
    live = scratch.put(narrowed(post, several, "tok").join(several, "tok"), "postings")
    scratch.drop(post, several)

    weight = scratch.put(live.groupBy("id").agg(F.sum("df").alias("w")), "weights")
    top = live.join(weight, "id").groupBy("tok").agg(F.max(F.struct("w", (-F.col("id")).alias("_i"), F.col("n").alias("np"))).alias("_t"))
    centres = scratch.put(top.select("tok", (-F.col("_t._i")).alias("fam"), "_t.np"), "centres")
    points = live.join(centres, "tok").groupBy("id", "n", "k", "fam", "np").agg(F.count("*").alias("_c"), F.sum("df").alias("_cost"))
    best = points.filter("fam <> id").groupBy("id", "n", "k").agg(F.max(F.struct("_cost", "_c", (-F.col("fam")).alias("_f"), "np")).alias("_b"))
    costly = F.col("_b._cost") >= F.greatest(F.lit(COSTLY), "k")
    near = costly | (F.col("_b._c") >= F.greatest(F.lit(2), F.ceil(F.col("k") * NEAR))) | ((F.col("k") <= 2) & (F.col("_b._c") >= 1))
    family = scratch.put(best.filter(near).select("id", "n", (-F.col("_b._f")).alias("fam"), "_b.np", costly.cast("long").alias("costly")), "families")
    scratch.drop(weight, centres)

    wanted = scratch.put(family.select("id").unionAll(family.select(F.col("fam").alias("id")).distinct()), "wanted")
    texts = _kept(docs, wanted, scratch)
    names = ("fam", "id", "n", "np", "costly")
    pairs = _with_texts(family, texts, "id", "fam").select(*names, "_tx", "_ty")
    delta = _common(pairs, ", ".join(f"{c} long" for c in names), order, size, num, den)
    linked = _linked(F.col("both"), F.col("n"), F.col("np"), num, den)
    far = ~_linked(F.col("both"), F.col("n"), F.col("np"), 2 * num - den, den)
    delta = delta.filter(~far | (F.col("costly") == 1)).select("fam", "id", "n", linked.alias("linked"), "own", "lo")
    delta = scratch.put(delta, "differences")
    scratch.drop(family, wanted)
    stars = delta.filter("linked").select(F.col("id").alias("a"), F.col("fam").alias("b"))

    wide = delta.select("fam", "id", F.explode("own").alias("tok"))
    twice = scratch.put(wide.groupBy("fam", "tok").agg(F.min("id").alias("_a"), F.max("id").alias("_z")).filter("_a < _z").select("fam", "tok"), "twice")
    shared = narrowed(wide, twice, "fam", "tok").groupBy("id").agg(F.count("*").alias("_s"))
    least = delta.groupBy("fam").agg(F.min("lo").alias("_least"))
    loose = delta.filter("not linked").select("fam", "id", "lo").join(shared, "id", "left").join(least, "fam")
    enough = F.col("lo").isNull() | (F.coalesce("_s", F.lit(0)) >= F.least("lo", "_least"))
    loose = scratch.put(loose.filter(enough).select("fam", "id"), "loose")
    members = delta.select("fam", "id", "linked").join(loose.select(F.col("id").alias("_l")), F.col("id") == F.col("_l"), "left")
    members = members.filter("linked or _l is not null").select("fam", "id").join(loose.select("fam").distinct(), "fam", "left_semi")
    members = scratch.put(members, "members")
    with_set = lambda df, name: scratch.put(_with_set(df, texts, size), name)
    inside = scratch.put(_compare_blocks(with_set(loose, "loose-sets"), with_set(members, "member-sets"), num, den), "inside")
    scratch.drop(texts, twice)

    group = scratch.put(delta.select("id", "fam", F.when(F.col("linked"), F.col("fam")).otherwise(F.col("id")).alias("grp")), "groups")
    named = live.join(group, "id", "left").select(
        "tok", "id", "n", "l", F.coalesce("fam", "id").alias("fam"), F.coalesce("grp", "id").alias("grp")
    )
    each = named.groupBy("tok", "fam").agg(F.count("*").alias("_n")).groupBy("tok").agg(F.count("*").alias("_f"), F.max(F.struct("_n", "fam")).alias("_m"))
    mixed = scratch.put(each.filter("_f > 1").select("tok", F.col("_m.fam").alias("main")), "mixed")
    named = scratch.put(named.join(mixed, "tok"), "crossing")
    right = named.select("tok", *(F.col(c).alias(f"{c}2") for c in ("id", "n", "l", "fam", "grp")))
    once = (F.col("fam2") == F.col("main")) | (F.col("id") < F.col("id2"))
    apart = once & (F.col("fam") != F.col("fam2")) & (F.col("grp") != F.col("grp2")) & _sizes("n", "n2", num, den)
    apart = apart & (F.col("fam") != F.col("id2")) & (F.col("fam2") != F.col("id"))
    across = named.filter("fam <> main").join(right, (named["tok"] == right["tok"]) & apart)
    ends = [F.least("id", "id2").alias("a"), F.greatest("id", "id2").alias("b"), F.least("l", "l2").alias("l")]
    across = across.groupBy(*ends).agg(F.count("*").alias("_c")).filter("_c >= l")
    across = scratch.put(across.select("a", "b"), "across")
    wanted = scratch.put(across.select(F.col("a").alias("id")).unionAll(across.select(F.col("b").alias("id"))).distinct(), "ends")
    pairs = _with_texts(across, _kept(docs, wanted, scratch), "a", "b").select("a", "b", "_tx", "_ty")
    return scratch.put(stars.unionAll(inside).unionAll(_verified(pairs, size, num, den)), "verified")


def _verified(pairs: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sets link."""

    def run(batches):
        for batch in _text.sliced(batches):
            good, tx = [], batch.column(2).to_pylist()
            made = _sets_of(tx + batch.column(3).to_pylist(), size)
            for x, y in zip(made[: len(tx)], made[len(tx) :], strict=True):
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    return pairs.mapInArrow(_text.frugal(run), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, num: int = NUM, den: int = DEN
) -> DataFrame:
    """One row per row of `docs`: `id_col`, n_shingles, component_id (the least id reachable by links)."""
    spark = docs.sparkSession
    importable(spark)
    scratch = Scratch(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    profile = scratch.put(_profile(docs, words), "profile")
    order = spark.sparkContext.broadcast(_order(profile))
    rows = profile.filter("kind = 0").select("id", "n", "h1", "h2")
    classes = scratch.put(rows.filter("n > 0 and id is not null").groupBy("h1", "h2", "n").agg(F.min("id").alias("rep")), "classes")
    links = _links(docs.filter("id is not null"), order, classes, scratch, words, num, den)
    same = rows.join(classes, ["h1", "h2", "n"]).filter("id <> rep").select(F.col("id").alias("a"), F.col("rep").alias("b"))
    found = scratch.put(components(links.unionAll(same), scratch), "components")
    return rows.join(found, rows["id"] == found["node"], "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The document with the least id of each class, with all columns; rows that share that id all stay."""
    found = near_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("id"), "component_id")
    gone = Scratch(docs.sparkSession).put(found.filter("component_id <> id").select("id").distinct(), "near-copies")
    return apart(docs, gone, {"id": F.col(f"`{id_col}`").cast("long")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_WORDS = (
    r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),"
    r" '[\x20\x09-\x0D]+'), lambda x: x <> '')"
)
SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))
        WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE CAST([] AS VARCHAR[]) END) AS g FROM d),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
l AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.t = b.t AND a.doc_id < b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
u AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT doc_id AS node, doc_id AS reach FROM s UNION SELECT r.node, u.y FROM r JOIN u ON u.x = r.reach)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, min(r.reach) AS component_id FROM s JOIN r ON r.node = s.doc_id GROUP BY s.doc_id, len(s.g)
"""
