"""Near-duplicate embeddings by int8 tile products with rigorous error bounds.

Unit vectors are quantised as s * q with whole q in -127..127 and error e = u - s q, whose length is
known for each vector. For two vectors |u.v - s t q.r| <= |s q| |e_v| + |e_u|, so a pair whose int8
product plus that bound is under the threshold can't link; only the others are computed again in
double precision. Products of int8 values are exact in float32 up to 1,040 dimensions a slice.

Equal vectors are one class, with a number of its own. Classes are dealt into groups by hash, and each pair of groups is one
cell, computed tile by tile in one task. A cell returns link counts and a spanning forest of its
links, never the pairs themselves. The work is quadratic in distinct vectors, as any exact method's
on vectors without structure; memory in a task stays that of two groups.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, release
from .components import components, join

GROUP = 8192
LEAST_GROUPS = 8
TILE = 1024
SLICE = 1040


class Quantised:
    """Rows of a matrix as unit vectors, int8 codes, scales, lengths of the codes and of the errors."""

    def __init__(self, rows: np.ndarray):
        rows = rows / np.abs(rows).max(axis=1, keepdims=True)
        self.unit = rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))
        self.scale = np.abs(self.unit).max(axis=1) / 127
        self.code = np.rint(self.unit / self.scale[:, None]).astype(np.int8)
        near = self.code * self.scale[:, None]
        #: a little more than the true lengths, for the rounding of this very computation
        self.error = np.sqrt(((self.unit - near) ** 2).sum(axis=1)) * (1 + 1e-9) + 1e-12
        self.length = np.sqrt((near * near).sum(axis=1)) * (1 + 1e-9)

    def product(self, other: Quantised, a: slice, b: slice) -> np.ndarray:
        dims = self.code.shape[1]
        out = None
        for lo in range(0, dims, SLICE):
            part = self.code[a, lo : lo + SLICE].astype(np.float32) @ other.code[b, lo : lo + SLICE].astype(np.float32).T
            out = part if out is None else out.astype(np.float64) + part
        return out

    def links(self, other: Quantised, a: slice, b: slice, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (i, j), counted within the slices, with cosine of at least `least`."""
        bound = least - self.error[a] - self.length[a] * other.error[b].max() - 1e-6
        product = self.product(other, a, b)
        product *= other.scale[b].astype(product.dtype)
        i, j = np.nonzero(product >= (bound / self.scale[a]).astype(product.dtype)[:, None])
        keep = [np.empty(0, bool)]
        for lo in range(0, len(i), 65536):
            x, y = self.unit[a][i[lo : lo + 65536]], other.unit[b][j[lo : lo + 65536]]
            keep.append(np.einsum("nd,nd->n", x, y) >= least)
        keep = np.concatenate(keep)
        return i[keep], j[keep]


def _cell(least: float):
    def run(rows: pa.Table) -> pa.Table:
        side = rows.column("own").to_numpy()
        order = np.argsort(side, kind="stable")
        side = side[order]
        key = rows.column("key").to_numpy()[order]
        copies = rows.column("copies").to_numpy()[order]
        flat = rows.column("vec").combine_chunks()
        matrix = flat.flatten().to_numpy().astype(np.float64).reshape(len(key), -1)[order]
        low, high = rows.column("low")[0].as_py(), rows.column("high")[0].as_py()
        cut = int(np.searchsorted(side, low, "right"))
        vectors = Quantised(matrix)
        n = len(key)
        links, parent = np.zeros(n, np.int64), np.arange(n)
        mine = range(0, cut, TILE)
        theirs = (0, cut) if low == high else (cut, n)
        for x in mine:
            for y in range(theirs[0], theirs[1], TILE):
                if low == high and y < x:
                    continue
                a, b = slice(x, min(x + TILE, cut)), slice(y, min(y + TILE, theirs[1]))
                i, j = vectors.links(vectors, a, b, least)
                i, j = i + x, j + y
                if low == high and x == y:
                    i, j = i[i < j], j[i < j]
                np.add.at(links, i, copies[j])
                np.add.at(links, j, copies[i])
                join(parent, i, j)
        at = np.flatnonzero(links > 0)
        root = parent[at]
        return pa.table({"key": key[at], "links": links[at], "other": key[root]})

    return run


def embedding_components(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, group: int = GROUP
) -> DataFrame:
    """One row per vector: id, n_links, component_id (least id reachable), kept (id = component_id).

    Vectors that are null, zero, empty or hold null or non-finite components link with nothing, as
    do vectors of different lengths with each other. Equal vectors link. Rows come out one for one;
    rows of one id are vectors like any others, kept or not by their own component. A null id comes
    after all others, so it names a component of null ids only. Other columns are ignored.
    """
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    sound = F.coalesce(~bad & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("vec"), sound.alias("sound"))
    classes = rows.where("sound").groupBy("vec").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.withColumn("key", F.monotonically_increasing_id()))  # written once, so it stands
    groups = max(LEAST_GROUPS, -(-classes.count() // group))
    own = F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int")
    dealt = classes.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    dealt = dealt.select("key", "copies", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "vec")
    cells = dealt.groupBy("low", "high", F.size("vec"))
    found = materialize(cells.applyInArrow(_cell(least), "key long, links long, other long"))
    counts = found.groupBy("key").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("key").alias("a"), F.col("other").alias("b")))
    known = classes.join(counts, "key", "left").join(roots, F.col("key") == roots["node"], "left")
    known = materialize(known.select("vec", "first", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "key").alias("root")))
    least_id = materialize(known.groupBy("root").agg(F.min("first").alias("component")))
    known = materialize(known.join(least_id, "root").select(F.col("vec").alias("k_vec"), "n_links", "component"))
    release(least_id)
    release(classes), release(found)
    out = rows.where("sound").join(known, rows["vec"] == known["k_vec"]).select("id", "n_links", "component")
    out = out.unionByName(rows.where("not sound").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component")))
    return out.select(F.col("id").alias(id_col), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))
