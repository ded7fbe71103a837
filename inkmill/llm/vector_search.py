"""Exact top-k inner-product search: tiled matrix products of query groups and shards.

Vectors become whole numbers, floor(scale * x). Rows are dealt into shards and queries into groups
of bounded size, each packed once as one row with its matrix; a group meets every shard in a cell of
its own, so what travels are blocks and neither side is broadcast. A cell multiplies tile by tile and
keeps each query's k best of a tile before it looks at the next. The cells' short lists then meet in
a tree, a few shards at a time, until each group has one list a query.

Products are exact. By Cauchy and Schwarz no partial sum passes the product of the two lengths, so
float32 gives whole numbers while that stays below 2^24 and float64 while it stays below 2^53;
beyond, Python's own integers are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

GROUP = 16384
#: A block's matrix stays under so many bytes, so long vectors make smaller groups.
BLOCK_BYTES = 1 << 26
LEAST_SHARDS = 12
TILE = 512
FAN_IN = 8
LARGEST = (1 << 63) - 1

_BLOCK = "part int, dim int, key binary, id binary, named binary, matrix binary"
_LIST = "part int, shard int, query binary, named binary, key binary, id binary, known binary, score binary"


def _packed(scale: float):
    """Rows of one part as one block a length, in rising order of id, nulls last."""

    def run(rows: pa.Table) -> pa.Table:
        ids = rows.column("id").combine_chunks()
        named = np.asarray(ids.is_valid())
        id_, key = np.asarray(ids.fill_null(0)), rows.column("key").to_numpy()
        vec = rows.column("vec").combine_chunks()
        length = np.asarray(vec.value_lengths())
        start = np.append(0, np.cumsum(length))
        with np.errstate(over="ignore"):
            flat = np.floor(scale * vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
        flat = np.clip(flat, -np.finfo(np.float64).max, np.finfo(np.float64).max)
        out = []
        for dim in np.unique(length):
            at = np.flatnonzero(length == dim)
            at = at[np.lexsort((key[at], id_[at], ~named[at]))]
            matrix = flat[(start[at][:, None] + np.arange(dim)).ravel()]
            out.append((int(rows.column("part")[0].as_py()), int(dim), key[at].tobytes(), id_[at].tobytes(), named[at].tobytes(), matrix.tobytes()))
        names = ["part", "dim", "key", "id", "named", "matrix"]
        return pa.table(dict(zip(names, [pa.array(x, t) for x, t in zip(zip(*out), [pa.int32(), pa.int32(), *[pa.binary()] * 4])])))

    return run


class _Block:
    def __init__(self, row: dict):
        self.dim = row["dim"]
        self.key, self.id = np.frombuffer(row["key"], np.int64), np.frombuffer(row["id"], np.int64)
        self.named = np.frombuffer(row["named"], bool)
        self.matrix = np.frombuffer(row["matrix"], np.float64).reshape(len(self.key), self.dim)


def inner_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of whole-number rows, as int64; sums beyond 64 bits saturate."""
    with np.errstate(over="ignore"):
        bound = (np.sqrt((a * a).sum(axis=1).max(initial=0)) * np.sqrt((b * b).sum(axis=1).max(initial=0))) * (1 + 1e-6)
    if bound < 1 << 24:
        return (a.astype(np.float32) @ b.astype(np.float32).T).astype(np.int64)
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    exact = whole(a) @ whole(b).T if a.shape[1] else np.zeros((len(a), len(b)), object)
    return np.clip(exact, -LARGEST - 1, LARGEST).astype(np.int64)


def best(query: np.ndarray, score: np.ndarray, order: tuple[np.ndarray, ...], k: int) -> np.ndarray:
    """Places of each query's first k entries by falling score, then by the keys of `order`."""
    at = np.lexsort((*order, -1 - score, query))  # -1 - score falls as the score rises and can't overflow
    q = query[at]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.empty(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    return at[rank < k]


def _cell(k: int):
    def run(_key, groups: pa.Table, shards: pa.Table) -> pa.Table:
        out = []
        for g in map(_Block, groups.to_pylist()):
            query, at, score = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
            block = next((b for b in map(_Block, shards.to_pylist()) if b.dim == g.dim), None)
            for lo in range(0, len(g.key) if block is not None else 0, TILE):
                held = (np.empty(0, np.int64),) * 3
                for x in range(0, len(block.key), 8 * TILE):
                    product = inner_products(g.matrix[lo : lo + TILE], block.matrix[x : x + 8 * TILE])
                    own = g.key[lo : lo + TILE, None] == block.key[None, x : x + 8 * TILE]
                    if product.shape[1] > k + 1:
                        # the k + 1 best, as the query's own row may be one of them, and what ties with the last
                        least = np.partition(product, product.shape[1] - k - 1, axis=1)[:, -k - 1]
                        q, i = np.nonzero((product >= least[:, None]) & ~own)
                    else:
                        q, i = np.nonzero(~own)
                    some = tuple(np.concatenate(p) for p in zip(held, (q, i + x, product[q, i])))
                    keep = best(some[0], some[2], (some[1],), k)
                    held = tuple(p[keep] for p in some)
                query, at, score = (np.concatenate(p) for p in zip((query, at, score), (held[0] + lo, held[1], held[2])))
            if len(query):
                out.append((groups.column("part")[0].as_py(), shards.column("shard")[0].as_py(), g.key[query].tobytes(), g.id[query].tobytes(),
                            block.key[at].tobytes(), block.id[at].tobytes(), block.named[at].tobytes(), score.tobytes()))
        return _lists(out)

    return run


def _lists(rows: list[tuple]) -> pa.Table:
    columns = list(zip(*rows)) or [[]] * 8
    names = ["part", "shard", "query", "named", "key", "id", "known", "score"]
    return pa.table(dict(zip(names, [pa.array(x, t) for x, t in zip(columns, [pa.int32(), pa.int32(), *[pa.binary()] * 6])])))


def _joined(rows: pa.Table) -> list[np.ndarray]:
    return [np.frombuffer(b"".join(rows.column(c).to_pylist()), bool if c == "known" else np.int64) for c in ("query", "named", "key", "id", "known", "score")]


def _merged(k: int):
    def run(rows: pa.Table) -> pa.Table:
        query, named, key, id_, known, score = _joined(rows)
        at = best(query, score, (key, id_, ~known), k)
        return _lists([(rows.column("part")[0].as_py(), rows.column("shard")[0].as_py(), *(x[at].tobytes() for x in (query, named, key, id_, known, score)))])

    return run


def _unpacked(batches):
    for batch in batches:
        for row in range(batch.num_rows):
            query, named, key, id_, known, score = _joined(pa.Table.from_batches([batch.slice(row, 1)]))
            at = np.lexsort((key, id_, ~known, -1 - score, query))
            q = query[at]
            first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
            rank = np.arange(1, len(q) + 1) - np.repeat(first, np.diff(np.append(first, len(q))))
            yield pa.RecordBatch.from_pydict({
                "query_id": named[at], "rank": rank.astype(np.int32), "id": pa.array(id_[at], pa.int64(), mask=~known[at]), "score": score[at],
            })


def top_k_products(
    vectors: DataFrame, is_query: Column, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding",
    group: int = GROUP, fan_in: int = FAN_IN,
) -> DataFrame:
    """(query_id, rank, id_col, score): each query's k highest products, ties to the smaller id.

    Queries are the rows for which is_query holds (null: does not); candidates are all other rows.
    Vectors that are null or hold null or non-finite components take no part; vectors of another
    length than the query's aren't compared with it, empty ones have product 0 with each other. Rows
    come one for one: equal ids or rows are candidates of their own, only the query's own row is left
    out. Among equal scores a null id comes last; a row without id is never a query. Scores beyond 64
    bits are given as the nearest long. A query without candidates gives no row. Other columns are
    ignored.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark, v = vectors.sparkSession, F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), F.coalesce(is_query & F.col(id_col).isNotNull(), F.lit(False)).alias("asks"), bad.alias("bad"))
    rows = rows.where(F.col("vec").isNotNull() & ~F.coalesce("bad", F.lit(False))).select("id", "vec", "asks")
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()))  # written once, so keys stand
    counts = rows.agg(F.count("*").alias("n"), F.count_if("asks").alias("q"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("dim")).first()
    group = max(1, min(group, BLOCK_BYTES // (8 * max(1, counts["dim"]))))
    shards, groups = max(LEAST_SHARDS, -(-counts["n"] // group)), max(1, -(-counts["q"] // group))
    parted = lambda df, n: df.withColumn("part", F.pmod(F.xxhash64("key"), F.lit(n)).cast("int")).groupBy("part")
    one = materialize(parted(rows, shards).applyInArrow(_packed(scale), _BLOCK))
    other = parted(rows.where("asks").select("id", "vec", "key"), groups).applyInArrow(_packed(scale), _BLOCK)
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    right = one.withColumnRenamed("part", "shard").withColumn("part", numbers(groups))
    left = other.withColumn("shard", numbers(shards))
    lists = materialize(left.groupBy("part", "shard").cogroup(right.groupBy("part", "shard")).applyInArrow(_cell(k), _LIST))
    release(one), release(rows)
    while shards > 1:
        shards = -(-shards // fan_in)
        lists = lists.withColumn("shard", F.floor(F.col("shard") / fan_in).cast("int")).groupBy("part", "shard").applyInArrow(_merged(k), _LIST)
    out = lists.mapInArrow(_unpacked, "query_id long, rank int, id long, score long")
    return out.withColumnRenamed("id", id_col)
