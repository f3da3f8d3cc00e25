"""Token ids in binary blocks with keyed access through a minimal perfect hash.

Documents are dealt by ranges of their key, sorted, tokenised and written as blocks. A block is
one row of a Parquet table (which any store that Spark can write will hold) and stands alone:
raw little-endian ids of consecutive documents, and an index that maps a key to a slot by a
minimal perfect hash, with a fingerprint per slot against foreign keys and the slot's offset
and length in the payload. A block ends at BLOCK_IDS ids or at BLOCK_KEYS documents, but never
within a document, and says how many ids its shard holds before it. Rows with the same key follow
one another, ordered by a hash of the text; within a block they share a slot, and a key with very
many rows goes on in the next block or shard.

Looking up a key reads the block whose key range holds it (Parquet statistics skip the others),
hashes once, compares one fingerprint and slices the payload: constant time in the block. To
read everything, the shards' totals (a row for each task that wrote) are added up on the driver;
no block is shuffled or joined.

Defined cases: a null text counts as empty and has the end id alone; a null key sorts first;
repeated keys are read back in the order written, text by text; an empty table writes no block;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm._common import Scratch, importable, table
from millrace.llm._text import PieceTable, encode_texts, frugal, mix

VOCABULARY = "byte_bpe_50k.json"
BLOCK_IDS = 1_000_000
BLOCK_KEYS = 20_000
#: Keys per bucket of the perfect hash.
BUCKET = 4
BLOCK = (
    "shard int, block int, key_min long, key_max long, n_docs long, n_ids long, before long, width int, keys binary, seeds binary, prints binary, "
    "first_id binary, first_doc binary, docs_of binary, sizes binary, payload binary"
)


def _hash(keys: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    return mix(mix(keys.astype(np.uint64) + np.uint64(0x632BE59BD9B4E019)) + np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class PerfectHash:
    """Minimal perfect hash by displacement: a seed for each bucket puts its keys into free slots of their own."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        """`keys`: distinct integers."""
        n = len(keys)
        seeds = np.zeros(max(1, -(-n // BUCKET)), np.uint32)
        bucket = (_hash(keys, 0) % np.uint64(len(seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=len(seeds))
        ends = np.cumsum(sizes)
        taken = np.zeros(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            k = int(sizes[b])
            if not k:
                break
            own = keys[order[ends[b] - k : ends[b]]]
            base, step = 1, 64
            while True:
                tries = np.arange(base, base + step, dtype=np.uint64)
                at = (_hash(own[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~taken[at].any(axis=1)
                if k > 1:
                    s = np.sort(at, axis=1)
                    good &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                hit = np.flatnonzero(good)
                if len(hit):
                    seeds[b] = tries[hit[0]]
                    taken[at[hit[0]]] = True
                    break
                base, step = base + step, min(step * 4, 1 << 14)
        return cls(seeds, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bucket = (_hash(keys, 0) % np.uint64(len(self.seeds))).astype(np.int64)
        return (_hash(keys, self.seeds[bucket]) % np.uint64(self.n)).astype(np.int64)


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 0xFFFFFFFF) >> np.uint64(32)).astype("<u4")


NULL_KEY = -(1 << 63)


def _block(shard: int, number: int, before: int, keys: list, ids: list[np.ndarray]) -> dict:
    own = np.array([NULL_KEY if k is None else k for k in keys], np.int64)
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
    distinct = own[first]
    hashed = PerfectHash.build(distinct)
    slot = hashed.slots(distinct)
    sizes = np.array([len(x) for x in ids], "<u4")
    starts = np.cumsum(sizes, dtype=np.int64) - sizes
    put = lambda values, kind: (lambda out: (out.__setitem__(slot, values), out.tobytes())[1])(np.zeros(len(distinct), kind))
    flat = np.concatenate(ids)
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    return {
        "shard": shard, "block": number, "key_min": int(own[0]), "key_max": int(own[-1]), "n_docs": len(keys), "n_ids": len(flat), "before": before, "width": width,
        "keys": distinct.astype("<i8").tobytes(), "seeds": hashed.seeds.astype("<u4").tobytes(), "prints": put(fingerprints(distinct), "<u4"), "first_id": put(starts[first], "<u8"),
        "first_doc": put(first, "<u4"), "docs_of": put(np.diff(np.append(first, len(own))), "<u4"),
        "sizes": sizes.tobytes(), "payload": flat.astype("<u2" if width == 2 else "<u4").tobytes(),
    }


class Block:
    """A block as read back."""

    def __init__(self, row: dict):
        self.row = row
        part = lambda name, kind: np.frombuffer(row[name], kind)
        self.prints, self.first_id, self.first_doc = part("prints", "<u4"), part("first_id", "<u8"), part("first_doc", "<u4")
        self.docs_of, self.sizes = part("docs_of", "<u4"), part("sizes", "<u4")
        self.ids = part("payload", "<u2" if row["width"] == 2 else "<u4")
        self.hash = PerfectHash(part("seeds", "<u4"), len(self.prints))

    def get(self, key: int | None) -> list[np.ndarray]:
        """The ids of every document with this key, in the order written; none for a foreign key."""
        return [ids for _, ids in self.find(np.array([NULL_KEY if key is None else key], np.int64))]

    def find(self, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Key and ids of every document with one of the keys, key by key; nothing for foreign ones."""
        if not self.hash.n:
            return
        slot = self.hash.slots(keys)
        good = self.prints[slot] == fingerprints(keys)
        keys, slot = keys[good], slot[good]
        for key, at, first, n in zip(*(x.tolist() for x in (keys, self.first_id[slot], self.first_doc[slot], self.docs_of[slot])), strict=True):
            for size in self.sizes[first : first + n].tolist():
                yield key, self.ids[at : at + size]
                at += size


@lru_cache(2)
def _engine(path: str, added: bool):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = not added
    apart = tuple(a.content for a in t.get_added_tokens_decoder().values()) if added else ()
    many = lambda xs: [e.ids for e in t.encode_batch_fast(xs, add_special_tokens=False)]
    return PieceTable(many), lambda x: t.encode(x, add_special_tokens=False).ids, apart


def encode(texts: list[str], path: str, added: bool = False) -> Iterator[np.ndarray]:
    """Ids of each text; the library encodes every distinct piece of the vocabulary's own split once.

    `added`: an added token's content within a text is that token, as the library does when loaded; else it is text like any other.
    """
    table, whole, apart = _engine(path, added)
    return encode_texts(table, whole, texts, apart)


def write_tokens(
    docs: DataFrame, vocabulary: str, out: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 0, added: bool = False
) -> None:
    """Writes the documents' ids as blocks under `out`, in ascending order of `id_col` by (shard, block). `added`: see `encode`."""
    importable(docs.sparkSession)

    def run(batches):
        shard, number = TaskContext.get().partitionId(), 0
        keys: list = []
        held: list[np.ndarray] = []
        before = size = 0
        tail = np.array([] if end_id is None else [end_id], np.uint32)

        def full():
            return pa.RecordBatch.from_pylist([_block(shard, number, before, keys, held)], schema=schema)

        for batch in batches:
            own = batch.column(0).to_pylist()
            for key, ids in zip(own, encode([x or "" for x in batch.column(1).to_pylist()], vocabulary, added), strict=True):
                if size >= BLOCK_IDS or len(keys) >= BLOCK_KEYS:
                    yield full()
                    number, before = number + 1, before + size
                    keys, held, size = [], [], 0
                keys.append(key)
                held.append(np.concatenate((ids, tail)))
                size += len(held[-1])
        if keys:
            yield full()

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[k]) for n, k in (c.split(" ") for c in BLOCK.split(", "))])
    rows = docs.select(F.col(id_col).cast("long").alias("_key"), F.col(text_col).cast("string").alias("_text"))
    order = [F.col("_key").asc_nulls_first(), F.xxhash64("_text")]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(frugal(run), BLOCK).write.parquet(out)


def get(spark: SparkSession, path: str, key: int | None) -> list[np.ndarray]:
    """The ids of every document with this key."""
    want = NULL_KEY if key is None else key
    near = spark.read.schema(BLOCK).parquet(path).filter((F.col("key_min") <= want) & (F.col("key_max") >= want))
    return [x for r in near.orderBy("shard", "block").collect() for x in Block(r.asDict()).get(key)]


def starts(spark: SparkSession, path: str) -> np.ndarray:
    """The ids of all shards before each shard: one number for each task that wrote."""
    totals = spark.read.schema(BLOCK).parquet(path).groupBy("shard").agg(F.max(F.col("before") + F.col("n_ids"))).collect()
    out = np.zeros(max((r[0] for r in totals), default=-1) + 2, np.int64)
    for shard, n in totals:
        out[shard + 1] = n
    return np.cumsum(out)[:-1]


def read_documents(spark: SparkSession, path: str, id_name: str = "doc_id") -> DataFrame:
    """One row per document, looked up by its key: `id_name`, start, n_tokens, ids_crc32."""
    importable(spark)
    names = [id_name, "start", "n_tokens", "ids_crc32"]
    first = spark.sparkContext.broadcast(starts(spark, path))

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: c[i].as_py() for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                keys, size, crc = [], [], []
                for key, ids in Block(row).find(np.frombuffer(row["keys"], "<i8")):
                    keys.append(None if key == NULL_KEY else key)
                    size.append(len(ids))
                    crc.append(zlib.crc32(ids.astype("<u4").tobytes()))
                at = first.value[row["shard"]] + row["before"] + np.cumsum(size, dtype=np.int64) - size
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (keys, at, size, crc)], names)

    blocks = spark.read.schema(BLOCK).parquet(path)
    return blocks.mapInArrow(run, f"`{id_name}` long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = Scratch(spark).path("token-blocks")
    write_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), out, added=True)
    return read_documents(spark, out)
