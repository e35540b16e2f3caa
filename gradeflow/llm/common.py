"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeflow.session import ensure_checkpoint_dir, scratch_path

#: ASCII white space that separates words in every contract of this subpackage.
WORD_GAP = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER_TABLE = bytes.maketrans(_UPPER.encode(), _UPPER.lower().encode())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(col):
    """A-Z to a-z, every other character as it is."""
    return F.translate(col, _UPPER, _UPPER.lower())


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text as UTF-8 bytes; null has none.

    ``bytes.split()`` splits on exactly the six ASCII white-space bytes."""
    return text.encode().translate(LOWER_TABLE).split() if text else []


def write_scratch(df: DataFrame, name: str) -> DataFrame:
    """Write a table below the shared checkpoint folder and read it back:
    cuts lineage with files that outlive any executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared location, as seen by any task."""
    if "://" in uri or uri.startswith("file:"):
        if uri.startswith("file:"):
            return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def rows(batches: Iterator[pa.RecordBatch], *cols: str) -> Iterator[tuple[list, ...]]:
    """Column lists of each non-empty Arrow batch."""
    for b in batches:
        if b.num_rows:
            yield tuple(b.column(c).to_pylist() for c in cols)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit multiplicative hash (wraps on purpose)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def is_held_out(doc_id, modulus: int, remainder: int):
    """crc32 of the id written as text, mod ``modulus``, equals ``remainder``.
    A null id counts as the empty text (crc32 zero)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % modulus == remainder


def spread(df: DataFrame, bytes_col: str | None = None) -> int:
    """Partitions for a shuffle of this frame: the session's setting."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
