"""Texts dealt into buckets of bounded size, and what buckets tell each other in packed rows.

A text goes to one bucket by a hash of its id and itself. Buckets send (64-bit key, ...) entries to
key partitions, one packed row of byte arrays a bucket and partition, each key once a bucket however
often it occurs there, so a key of a third of all rows costs one entry a bucket. Answers go back to
the buckets the same way and meet the texts in a cogroup.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_partitions
from .textbytes import U64

#: Buckets to each shuffle partition: the more, the more even, and the less memory each takes.
BUCKETS_PER_PARTITION = 4


def bucketed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(bucket, id, text, more...) with null text as empty."""
    count = BUCKETS_PER_PARTITION * shuffle_partitions(docs.sparkSession)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.pmod(F.xxhash64(F.col(id_col), text), F.lit(count)).cast("int").alias("bucket"), F.col(id_col).alias("id"), text.alias("text"), *more)


def partition_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> U64(40)) % U64(parts)).astype(np.int32)


def partition_slices(keys: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order of the keys by partition, then by key, and (partition, from, to) within it."""
    part = partition_of(keys, parts)
    order = np.lexsort((keys, part))
    part = part[order]
    if not len(part):
        return order, []
    start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    return order, list(zip(part[start].tolist(), start.tolist(), np.append(start[1:], len(part)).tolist()))


def packed(array: np.ndarray) -> bytes:
    return np.ascontiguousarray(array).tobytes()


def unpacked(column: pa.ChunkedArray | pa.Array, dtype) -> np.ndarray:
    """All byte arrays of a column one after the other."""
    values = [np.frombuffer(x, dtype) for x in column.to_pylist()]
    return np.concatenate(values) if values else np.empty(0, dtype)


def spread(values: list, column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    """values[i] as often as byte array i of the column has entries of that width."""
    return np.repeat(np.array(values), [len(x) // width for x in column.to_pylist()]) if values else np.empty(0, np.int64)


def answers(bucket: np.ndarray, keys: np.ndarray) -> pa.Table:
    """(bucket, keys) with one packed row a bucket."""
    order = np.lexsort((keys, bucket))
    bucket, keys = bucket[order], keys[order]
    start = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.empty(0, np.int64)
    end = np.append(start[1:], len(bucket))
    return pa.table({"bucket": pa.array(bucket[start], pa.int32()), "keys": pa.array([packed(keys[a:b]) for a, b in zip(start, end)], pa.binary())})


def member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each value occurs in the sorted array `known`."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values
