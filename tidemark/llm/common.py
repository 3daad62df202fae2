"""What several operators share: reading tables, cutting lineage, byte views of Arrow columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.sources.stage import written

__all__ = ["by_bytes", "partitions", "read", "refuse", "texts", "utf8", "written"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column, nulls as empty texts, and the offsets (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    if data is None or not len(column):
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def texts(column: pa.Array) -> list[str]:
    """Python texts, nulls as empty."""
    return column.fill_null("").to_pylist()


def refuse(names: list[str] | tuple[str, ...], reserved: tuple[str, ...]) -> None:
    """An error, on the driver, for kept columns that have the name of a result or of a column that is needed on the way."""
    clash = sorted({n.lower() for n in names} & {r.lower() for r in reserved})
    if clash:
        raise ValueError(f"rename these columns first: {', '.join(clash)}")


def by_bytes(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about ``most`` bytes together, one text at least."""
    _, at = utf8(batch.column(column))
    a = 0
    while a < len(batch):
        b = max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b
