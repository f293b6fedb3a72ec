"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the word separators of every word-based operator here.
SPACE = r"[\x20\x09-\x0D]+"
MASK64 = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is set, a local session takes one of its own; a cluster has none to take."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("touchline.scratch.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="touchline-")
        spark.conf.set("touchline.scratch.dir", folder)
    return folder.rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut and lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/touchline-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_at = path
    return back


def unstage(*tables: DataFrame) -> None:
    """Remove staged tables that no later plan reads."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores before it, such that df has no column of that name in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def crc_mod(col, n: int):
    """crc32 of a number's decimal text, modulo n; null stays null."""
    return F.pmod(F.crc32(F.encode(col.cast("string"), "UTF-8")), F.lit(n))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser on unsigned arrays."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Memo of 64-bit word hashes; emptied when it grows past its limit."""

    LIMIT = 400_000

    def __init__(self, seed: int = 0):
        import xxhash

        self._hash, self._seed = xxhash.xxh3_64_intdigest, seed

    def __missing__(self, word):
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self._hash(word, self._seed)
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def word_chunks(data: bytes, size: int = 1 << 20):
    """Lists of the words of data, cut at white space into pieces of about size bytes."""
    if len(data) <= size:
        yield data.split()
        return
    start, end = 0, len(data)
    while start < end:
        stop = min(start + size, end)
        while stop < end and data[stop] not in b" \t\n\r\x0b\x0c":
            stop += 1
        yield data[start:stop].split()
        start = stop


def text_blocks(texts: list, limit: int = 1_000_000):
    """(first, last) index ranges of consecutive texts of about limit characters each."""
    first, held = 0, 0
    for i, text in enumerate(texts):
        held += len(text) if text else 0
        if held >= limit:
            yield first, i + 1
            first, held = i + 1, 0
    if first < len(texts):
        yield first, len(texts)
