"""Helpers shared by the corpus operators: shared scratch tables, bounded key filters, crc folds."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read through Spark only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_mod(id_col: str, mod: int) -> Column:
    """crc32 of the id written as text, modulo `mod`; the split key of the training folds."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % mod


#: What an Arrow batch holds at most, unless the session says otherwise: it exists in the JVM and in the worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "1000"), "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "16m")}


def importable(spark: SparkSession) -> None:
    """Lets Python workers that this driver starts import the package from its own folder; keeps their batches small."""
    for name, (usual, small) in BATCH.items():
        if spark.conf.get(name) == usual:
            spark.conf.set(name, small)
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, paths) if x)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; where it is unset, one of our own, on a single machine only."""
    sc = spark.sparkContext
    given = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not given and not re.match(r"local(\[|$)", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not given:
        given = f"file://{tempfile.mkdtemp(prefix='millrace-')}"
        sc.setCheckpointDir(given)
        given = sc.getCheckpointDir() or given
    return given.rstrip("/")


class Scratch:
    """Tables written to the shared folder: they cut lineage and outlive a lost executor.

    A later plan reads them with their sizes known, so that adaptive execution can choose a
    broadcast or split a skewed join by measured bytes.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.base = f"{shared_dir(spark)}/millrace-{uuid.uuid4().hex}"
        self.made = 0

    def path(self, name: str) -> str:
        self.made += 1
        return f"{self.base}/{self.made:03d}-{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = self.path(name)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *frames: DataFrame) -> None:
        """Deletes tables that no later plan reads."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            files = df.inputFiles()
            if files:
                path = jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
                path.getFileSystem(conf).delete(path, True)


#: Bits of a key filter for each key, and at most (32 MiB); the least is one row of 4 KiB.
KEY_BITS, MOST_BITS, LEAST_BITS = 16, 1 << 28, 1 << 15


def mark(df: DataFrame, keys: DataFrame, name: str, *cols: str) -> DataFrame:
    """Adds boolean `name`: true for every row whose `cols` are among `keys`, and for a few others.

    `keys` is read twice, so write it first. A bitmap of the keys' hashes is broadcast; its size
    follows the counted keys up to MOST_BITS, and with more keys than that every row is marked.
    """
    n = keys.count()
    if n > MOST_BITS:
        return df.withColumn(name, F.lit(True))
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (KEY_BITS * n).bit_length()))
    at = F.pmod(F.xxhash64(*cols), F.lit(bits))
    bitmap = keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    byte = lambda i: F.conv(F.hex(F.substr("_bits", i, F.lit(1))), 16, 10).cast("short")
    bitmap = bitmap.select("_bucket", F.transform(F.sequence(F.lit(1), F.octet_length("_bits")), byte).alias("_bits"))
    bit = F.bitmap_bit_position(at)
    test = F.getbit(F.get("_bits", F.shiftright(bit, 3).cast("int")), bit.bitwiseAND(F.lit(7)).cast("int")) == 1
    joined = df.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(bitmap), "_bucket", "left")
    return joined.withColumn(name, F.coalesce(test, F.lit(False))).drop("_bucket", "_bits")


def narrowed(df: DataFrame, keys: DataFrame, *cols: str) -> DataFrame:
    """The rows of `df` whose `cols` are among `keys`, and perhaps a few others; beyond MOST_BITS keys by a semi join."""
    if keys.count() > MOST_BITS:
        return df.join(keys.select(*cols), list(cols), "left_semi")
    return mark(df, keys, "_in", *cols).filter("_in").select(*df.columns)


def apart(docs: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of `docs` whose `keys` (expressions by column of `gone`) are not in `gone`; null equals null. No name of `docs` can clash."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    rows = docs.select(F.struct(*(F.col(f"`{c}`").alias(n) for c, n in names.items())).alias("row"), *(e.alias(f"own_{k}") for k, e in keys.items()))
    same = None
    for k in keys:
        one = rows[f"own_{k}"].eqNullSafe(gone[k])
        same = one if same is None else same & one
    return rows.join(gone, same, "left_anti").select(*(F.col(f"row.{n}").alias(c) for c, n in names.items()))
