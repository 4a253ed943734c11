"""Shared pieces of the training-data operators: shared tables, word splitting and hashing."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that a Python worker turns into objects at once; bounds memory with long texts.
SLICE = 256

_own: list[str] = []
_written: list[tuple[SparkSession, str]] = []


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). A local session may lack it; a cluster may not."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        if not _own:
            _own.append(f"file://{tempfile.mkdtemp(prefix='loomline-')}")
        root = _own[0]
    return root.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _clean() -> None:
    for spark, path in _written:
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended
            return


class Shared:
    """Tables written in the shared folder. They cut lineage and outlive lost executors.

    drop() removes those that no lazy result reads any more; the rest go when the process ends.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{shared_dir(self.spark)}/loomline-{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        self.paths[name] = path
        _written.append((self.spark, path))
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            if path := self.paths.pop(name, None):
                delete(self.spark, path)


#: A key is hot if it has more than this share of all rows; fewer than one over it can.
HOT = 1 / 4096


def join_counted(rows: DataFrame, table: DataFrame, on: list[str], n: str, total: int) -> DataFrame:
    """rows with their row of table, inner. table: unique in `on`, small rows; n: its column that holds how many of the
    `total` rows have the key. Hot keys, of which there are fewer than 1 / HOT at any size, are broadcast, so their
    rows stay where they are; all others are merged, and none of them fills a task."""
    hot = F.broadcast(table.where(F.col(n) > total * HOT))
    cold = rows.join(hot.select(*on), on, "left_anti").join(table.where(F.col(n) <= total * HOT).hint("merge"), on)
    return cold.unionByName(rows.join(hot, on))


def tables_written() -> int:
    """How many tables this process has written; a mark for drop_since()."""
    return len(_written)


def drop_since(mark: int, *keep: str) -> None:
    """Deletes the tables written since a mark, but for those paths: what a step needed once its result is a table itself."""
    for spark, path in _written[mark:]:
        if path not in keep:
            delete(spark, path)
    _written[mark:] = [x for x in _written[mark:] if x[1] in keep]


def hash_sample(df: DataFrame, key: Column, n: int) -> DataFrame:
    """The n rows with the least hashes of a key. A bound on the hash, known from the number of rows, keeps what tasks
    send to the driver near n rows in all, however many tasks there are."""
    total, h = df.count(), F.xxhash64(F.lit(11), key)
    if total > 2 * n:
        df = df.where(h <= int(-(2**63) + 2**64 * min(1.0, (n + 8 * n**0.5 + 50) / total)))
    return df.orderBy(h, key).limit(n)


def words_of(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of a text with A-Z lower-cased, as UTF-8. bytes.split() parts at exactly these six characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


_caches: list[dict] = []


def for_a_task(cache: dict) -> dict:
    """A cache of this process that arrow_map's tasks empty at their end: a worker goes on to other stages, which don't need it."""
    _caches.append(cache)
    return cache


def forget() -> None:
    for cache in _caches:
        cache.clear()


class WordHashes(dict):
    """Word -> 63-bit hash. It forgets all when full, so memory stays bounded."""

    FULL = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.FULL:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word) >> 1
        return h


_hashes = for_a_task(WordHashes())


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_hashes.__getitem__, words), dtype=np.uint64, count=len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, size: int = 5) -> np.ndarray:
    """Sorted distinct 63-bit hashes of the word shingles; the whole sequence if there are fewer words; empty without words."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    h = word_hashes(words)
    n = min(size, len(h))
    with np.errstate(over="ignore"):
        out = np.full(len(h) - n + 1, n, np.uint64)
        for i in range(n):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return np.unique(out >> np.uint64(1))


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for at in range(0, b.num_rows, SLICE):
            yield b.slice(at, SLICE)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow over small slices of each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in slices(batches):
                yield fn(b)
        finally:
            forget()

    return df.mapInArrow(run, schema)
