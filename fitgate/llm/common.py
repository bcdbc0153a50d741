"""What the text operators share: word rules, hashing of words in numpy, staged tables."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fitgate.session import shared_folder

#: A word is a run of anything but these six ASCII blanks; ``bytes.split()`` cuts at just these.
BLANKS = " \t\n\x0b\x0c\r"
NEAR_SIMILARITY = 0.8
SHINGLE_WORDS = 5


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The documents table, only the named columns (doc_id and text if none are named)."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*(columns or ("doc_id", "text")))


def sql_words(text: Column) -> Column:
    """The words of a text as an array, in order; no words for NULL or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Stages:
    """Written tables that cut lineage, in the folder which the cluster shares.

    The folder is ``spark.checkpoint.dir``; only where that is unset on one machine, as in tests,
    a temporary folder is made, one per application. A lost executor costs the running tasks only:
    everything before the last stage is read again from the table.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.names: list[str] = []
        self.root = shared_folder(spark, name)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        """Write a table and read it. Once it is written nothing needs its shuffle files, so Spark may delete them."""
        conf = self.spark.conf
        before = conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            df.write.options(**{"compression": "zstd"} | options).parquet(path := f"{self.root}/{name}")
        finally:
            conf.set(_CLEANUP, before)
        self.names.append(name)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        """Delete a stage that nothing reads any more."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.names.remove(name)

    def keep(self, *names: str) -> None:
        """Delete all stages but these; a name that ends in - stands for the latest stage that begins so."""
        latest = {next((n for n in reversed(self.names) if n.startswith(k)), k) if k.endswith("-") else k for k in names}
        for name in [n for n in self.names if n not in latest]:
            self.drop(name)


def give_back() -> None:
    """Memory that this process has freed goes back to the system, at the end of a task whose Python worker stays alive beside later stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words, the same in every process."""
    if not words:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    at = np.arange(len(data)) - np.repeat(starts, lengths)
    # each byte is scrambled together with its place, so the sum depends on order
    sums = np.add.reduceat(mix((at.astype(np.uint64) << np.uint64(8)) + data + _MULTIPLIER), starts)
    return mix(sums + lengths.astype(np.uint64) * _MULTIPLIER)


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of ``width`` consecutive items (empty if there are fewer)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(width):
        out = out * np.uint64(0xD1342543DE82EF95) + hashes[i : i + n]
    return mix(out)
