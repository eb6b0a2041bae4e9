"""Helpers shared by the operators of this subpackage.

Every operator reads its columns by name into internal names first, so that further
columns of any name may be present. Texts travel to Python as UTF-8 bytes: ``bytes.split``
and ``bytes.lower`` know ASCII only, which is what the word rule ``[^\\x20\\x09-\\x0D]+`` asks for.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from hydroseries.session import shared_folder

@contextmanager
def bucketed(df: DataFrame, n: int, key: str) -> Iterator[DataFrame]:
    """The rows as a table of ``n`` buckets by ``key`` in the shared folder, for joins that leave them where they are.

    Whatever is made of the table must be written before the block ends: then it is dropped and its files are removed.
    """
    spark = df.sparkSession
    name = f"bucketed_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark)}/{name}"
    try:
        df.write.bucketBy(n, key).option("path", path).option("compression", "uncompressed").saveAsTable(name)
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


SPACES = b" \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more: str) -> DataFrame:
    """doc_id, text (UTF-8 bytes; null stays null) and the columns of ``more`` under their internal names."""
    extra = [F.col(f"`{c}`").alias(name) for name, c in more.items()]
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), *extra
    )


def packed(df: DataFrame, **keys: Column) -> DataFrame:
    """All columns of ``df`` as one, ``_row``, beside the named keys: no name of ``df`` can clash with a name in use."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), *[k.alias(n) for n, k in keys.items()])


def map_batches(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterable[dict]], schema: str) -> DataFrame:
    """``mapInArrow`` for a function that yields dicts of columns."""
    kind: StructType = _parse_datatype_string(schema)
    arrow = to_arrow_schema(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in fn(batches):
            yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, kind)


def rows_of(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """The named columns of a stream of batches, row by row."""
    for b in batches:
        yield from zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in names))


class Buffer:
    """Collects output rows and hands them on in batches of bounded rows and bytes."""

    def __init__(self, *names: str, rows: int = 20_000, size: int = 8 << 20):
        self.names, self.rows, self.size = names, rows, size
        self.clear()

    def clear(self) -> None:
        self.columns: list[list] = [[] for _ in self.names]
        self.held = 0

    def add(self, *row, size: int = 0) -> None:
        for c, x in zip(self.columns, row):
            c.append(x)
        self.held += size

    def full(self) -> bool:
        return len(self.columns[0]) >= self.rows or self.held >= self.size

    def take(self) -> dict:
        out = dict(zip(self.names, self.columns))
        self.clear()
        return out


def hash64(word: bytes) -> int:
    """A 64-bit hash that is the same in every process."""
    return xxhash.xxh3_64_intdigest(word)


class WordIds(dict):
    """word -> number by ``fn``; forgets everything once it holds ``most`` words, so memory stays bounded."""

    def __init__(self, fn: Callable[[bytes], int], most: int = 300_000):
        super().__init__()
        self.fn, self.most = fn, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        x = self[word] = self.fn(word)
        return x


def mix(x: np.ndarray) -> np.ndarray:
    """Finalising mixer over unsigned 64-bit numbers (wraps around)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def _power_table(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64 for i < n; tables grow to the longest text seen."""
    if len(_powers.get("up", ())) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            table = np.full(size, base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def gram_hashes(ids: np.ndarray, k: int) -> np.ndarray:
    """Mixed rolling hashes of every k consecutive numbers of ``ids`` (unsigned 64 bits)."""
    n = len(ids)
    if n < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _power_table(n)
    total = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(ids * up, out=total[1:])
    return mix((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def sliding(x: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over every ``width`` consecutive values."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = pick(out[:-step], out[step:])
        done += step
    return out


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def is_held_out(mod: int, rest: int = 2) -> Column:
    """crc32 of doc_id as text, modulo ``mod``, is ``rest``; a null doc_id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod == rest
