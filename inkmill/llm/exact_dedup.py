"""Exact duplicates by deterministic block naming, in DataFrame operations only.

The folded text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and
numbered; then adjacent pairs of names are sorted and numbered in turn, level by level, until each
document has one integer. Documents with as many blocks and the same integer have the same text.

The sort key of a block is its 64-bit hash, then the block itself where different blocks share a
hash, so the names stay free of collisions while a block's text crosses the network once, after a
map-side reduction to one row a block. Every join sits between two plain exchanges, so that
adaptive execution can split the partition of a frequent block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, materialize, release

BLOCK_CHARS = 2048


def _numbered(keys: DataFrame, by: list[str]) -> DataFrame:
    """Integer names in sorted order: partitions are ranges, so the ids rise with the key."""
    return materialize(keys.orderBy(*by).withColumn("name", F.monotonically_increasing_id()))


def document_identities(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per (id, folded text): id, text_sha256, n_blocks, name, copies (equal input rows).

    (n_blocks, name) is the identity: equal exactly for equal folded texts. Null text counts as
    empty; a null id is an id like any other. Rows repeated whole are counted in `copies`.
    """
    whole = docs.select(F.col(id_col).alias("id"), fold(F.coalesce(F.col(text_col), F.lit(""))).alias("norm"))
    cut = F.when(F.length("norm") == 0, F.array(F.lit(""))).otherwise(
        F.regexp_extract_all("norm", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    )
    slim = materialize(
        whole.select("id", F.sha2("norm", 256).alias("sha"), cut.alias("cut")).select(
            "id", "sha", F.size("cut").alias("n"), F.posexplode(F.transform("cut", lambda b: F.xxhash64(b))).alias("pos", "h")
        )
    )
    blocks = whole.select(F.explode(cut).alias("block")).select(F.xxhash64("block").alias("h"), "block")
    seen = blocks.groupBy("h").agg(F.min("block").alias("lo"), F.max("block").alias("hi"))
    seen = materialize(seen.select("h", (F.col("lo") != F.col("hi")).alias("clash")))
    clashes = seen.where("clash").select("h")
    rows, keys, tied = slim.withColumn("tie", F.lit(0)), seen.where("not clash").select("h", F.lit(0).alias("tie")), None
    if not clashes.isEmpty():
        rows, keys, tied = _told_apart(whole, cut, blocks, slim, clashes, keys)
    names = _numbered(keys, ["h", "tie"])
    named = rows.join(names, ["h", "tie"]).select("id", "sha", "n", "pos", "name")

    most = slim.agg(F.max("n")).first()[0] or 1
    kept = ["id", "sha", "n", "name", "copies"]
    done = [materialize(named.where("n = 1").groupBy("id", "sha", "n").agg(F.max("name").alias("name"), F.count("*").alias("copies")).select(kept))]
    level, span = None, 1
    if most > 1:
        level = materialize(named.where("n > 1").groupBy("id", "sha", "n", "pos").agg(F.max("name").alias("name"), F.count("*").alias("copies")))
    for x in (slim, seen, names, tied):
        if x is not None:
            release(x)
    while span < most:
        span *= 2
        even = F.col("pos") % 2 == 0
        pairs = materialize(
            level.groupBy("id", "sha", "n", F.shiftright("pos", 1).alias("pos")).agg(
                F.max(F.when(even, F.col("name"))).alias("a"),
                F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(-1)).alias("b"),
                F.max("copies").alias("copies"),
            )
        )
        names = _numbered(pairs.select("a", "b").distinct(), ["a", "b"])
        joined = materialize(pairs.join(names, ["a", "b"]).select("id", "sha", "n", "pos", "name", "copies"))
        for x in (level, pairs, names):
            release(x)
        done.append(joined.where(F.col("n") <= span).select(kept))
        level = joined.where(F.col("n") > span)
        level._inkmill_path = None
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("id").alias(id_col), F.col("sha").alias("text_sha256"), F.col("n").alias("n_blocks"), "name", "copies")


def _told_apart(whole, cut, blocks, slim, clashes, keys):
    """The rare case of different blocks with one hash: number them by their text."""
    tied = blocks.join(clashes, "h", "left_semi").distinct()
    tied = materialize(tied.withColumn("tie", F.row_number().over(Window.partitionBy("h").orderBy("block"))))
    at = whole.select(F.col("id").alias("i"), F.sha2("norm", 256).alias("s"), F.posexplode(cut).alias("p", "block"))
    at = at.withColumn("h", F.xxhash64("block")).join(tied, ["h", "block"]).select("i", "s", "p", F.col("tie").alias("t")).distinct()
    same = F.col("id").eqNullSafe(F.col("i")) & (F.col("sha") == F.col("s")) & (F.col("pos") == F.col("p"))
    rows = slim.join(at, same, "left").select("id", "sha", "n", "pos", "h", F.coalesce("t", F.lit(0)).alias("tie"))
    return rows, keys.unionByName(tied.select("h", "tie")), tied


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = BLOCK_CHARS
) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256, copies.

    Of equal texts the largest id stays. Null texts equal empty ones; nulls sort below every id.
    Input rows with equal id and text come out as one row, each counted in group_size and `copies`.
    An empty table gives an empty result; other columns of docs are ignored.
    """
    ids = document_identities(docs, id_col, text_col, block_chars)
    groups = ids.groupBy("n_blocks", "name").agg(F.max(id_col).alias("keep_id"), F.sum("copies").alias("group_size"))
    groups = groups.select(F.col("n_blocks").alias("g_n"), F.col("name").alias("g_name"), "keep_id", "group_size")
    # A materialised table on either side of the join leaves both exchanges open to splitting.
    out = ids.join(materialize(groups), (F.col("n_blocks") == F.col("g_n")) & (F.col("name") == F.col("g_name")))
    kept = F.col(id_col).eqNullSafe(F.col("keep_id"))
    return out.select(id_col, "keep_id", "group_size", kept.alias("kept"), "text_sha256", "copies")


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_duplicates keeps, one of each, with all their columns."""
    keep = exact_duplicates(docs, id_col, text_col).where("kept")
    keep = keep.select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), F.col("copies").alias("__n"))
    sha = F.sha2(fold(F.coalesce(F.col(text_col), F.lit(""))), 256)
    out = docs.withColumn("__own", sha)
    out = out.join(keep, out[id_col].eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__sha")))
    once, more = out.where("__n = 1"), out.where("__n > 1").dropDuplicates([id_col, "__own"])
    return once.unionByName(more).select(*docs.columns)
