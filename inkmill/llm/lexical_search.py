"""Ranked lexical search over documents reordered by recursive graph bisection.

Documents and terms are the two sides of a graph. Bisection halves a set of documents again and
again, swapping documents between the halves while that lowers the terms' log-gap cost, so similar
documents end up side by side. The upper levels are fitted on a bounded sample (SAMPLE documents of
least hash): each node keeps its terms' degrees in both halves, and every document walks down the
tree to the half where it costs less. Leaves become shards, a leaf with too many documents several,
by hash of a row number, so a group of copies of any size spreads. Within a shard bisection runs in
full, down to clusters of at most CLUSTER documents.

A shard is one row of packed arrays: its largest impact of each term, each cluster's largest impact
of each term, and postings by cluster. An item's bound on a shard or cluster is the sum of its terms'
weights times those impacts. Search first visits, for each item, the one shard of highest bound; its
k-th score is a threshold for all others. In each shard an item's clusters are visited by falling
bound until the bound is under the threshold or under the k-th score found there; a bound equal to it
is still visited, as ties go to the smaller id. What is skipped can't enter the list, so it is exact.

Only terms of the items are indexed. Items come in batches of bounded text (QUERY_BYTES), so their
vocabulary, what is sent to the workers, is bounded too; more items take more passes.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, release

SAMPLE = 4096
LEAST_LEAF = 32
SHARD = 8192
CLUSTER = 128
ROUNDS = 12
QUERY_BYTES = 1 << 20
STRETCH = 1 << 22

_TERM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def term_counts(data: bytes) -> tuple[int, Counter]:
    """(number of terms, occurrences of each) of one UTF-8 text, however long, in stretches."""
    n, counts, lo = 0, Counter(), 0
    while lo < len(data):
        hi = lo + STRETCH
        while hi < len(data) and _TERM[data[hi]] != 32:
            hi += 1
        terms = data[lo:hi].translate(_TERM).split()
        n += len(terms)
        counts.update(terms)
        lo = hi
    return n, counts


def _term_rows(vocabulary):
    """(id, n, terms, tf) of each document with terms; terms and tf are those of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            out = [[], [], [], []]
            for id_, text in zip(batch.column(0), batch.column(1).cast(pa.large_binary())):
                n, counts = term_counts(text.as_py() or b"")
                if n:
                    found = sorted((known[t], counts[t]) for t in (known.keys() & counts.keys()))
                    out[0].append(id_.as_py()), out[1].append(n)
                    out[2].append(np.array([t for t, _ in found], np.int32).tobytes())
                    out[3].append(np.array([c for _, c in found], np.int64).tobytes())
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds)], ["id", "n", "terms", "tf"])

    return run


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size, np.int64)
        for batch in batches:
            df += np.bincount(_flat(batch.column(0))[1], minlength=size)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(df[at])], ["term", "df"])

    return run


def _flat(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(document, term) of every posting of a column of packed terms."""
    values = [np.frombuffer(x, np.int32) for x in column.to_pylist()]
    doc = np.repeat(np.arange(len(values)), [len(x) for x in values])
    return doc, np.concatenate(values) if values else np.empty(0, np.int32)


def _rank_in(group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For a sorted array: each entry's place in its group, and the group's start."""
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1])) if len(group) else np.empty(0, np.int64)
    start = np.repeat(first, np.diff(np.append(first, len(group))))
    return np.arange(len(group)) - start, start


def _cost(degree: np.ndarray, size: np.ndarray) -> np.ndarray:
    return degree * np.log2(np.maximum(size, 1) / (np.maximum(degree, 0) + 1))


def bisect(doc: np.ndarray, term: np.ndarray, n: int, depth: int, terms: int, tree: list | None = None) -> np.ndarray:
    """The leaf, 0 to 2**depth - 1, of each of n documents; doc and term give the graph's edges.

    All nodes of a level are refined at once. In a round each document's gain is what the cost falls
    by if it changes sides; the i-th best of one half and of the other swap while their gains sum to
    more than nothing. Halves differ by one document at most. With `tree`, each level's (nodes x
    terms) preference of terms for the first half is appended to it.
    """
    node = np.zeros(n, np.int64)
    for level in range(depth):
        order = np.argsort(node, kind="stable")
        rank, start = _rank_in(node[order])
        size = np.bincount(node, minlength=1 << level)
        side = np.zeros(n, bool)
        side[order] = rank >= (size[node[order]] + 1) // 2
        pair, at = np.unique(node[doc] * terms + term, return_inverse=True)
        of = pair // terms
        degree = np.bincount(at, minlength=len(pair))
        one = np.bincount(node, weights=side, minlength=1 << level)
        for _ in range(ROUNDS):
            d1 = np.bincount(at, weights=side[doc], minlength=len(pair))
            d0, n1, n0 = degree - d1, one[of], (size - one)[of]
            now = _cost(d0, n0) + _cost(d1, n1)
            leave, enter = now - _cost(d0 - 1, n0) - _cost(d1 + 1, n1), now - _cost(d0 + 1, n0) - _cost(d1 - 1, n1)
            gain = np.bincount(doc, weights=np.where(side[doc], enter[at], leave[at]), minlength=n)
            order = np.lexsort((-gain, side, node))
            rank, start = _rank_in(node[order] * 2 + side[order])
            mine = np.flatnonzero(side[order])
            other = start[mine] - (size - one).astype(np.int64)[node[order[mine]]] + rank[mine]
            a, b = order[mine], order[other]
            swap = gain[a] + gain[b] > 1e-9
            if not swap.any():
                break
            side[a[swap]], side[b[swap]] = False, True
        if tree is not None:
            d1 = np.bincount(at, weights=side[doc], minlength=len(pair))
            held = np.zeros((1 << level, terms), np.float32)
            n1, n0 = np.maximum(one[of], 1), np.maximum((size - one)[of], 1)
            held[of, pair % terms] = np.log2(n1 / (d1 + 1)) - np.log2(n0 / (degree - d1 + 1))
            tree.append(held)
        node = node * 2 + side
    return node


def route(doc: np.ndarray, term: np.ndarray, n: int, tree: list[np.ndarray]) -> np.ndarray:
    """The leaf of each document that walks down a fitted tree."""
    node = np.zeros(n, np.int64)
    for prefer in tree:
        node = node * 2 + (np.bincount(doc, weights=prefer[node[doc], term], minlength=n) < 0)
    return node


def _routed(tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, term = _flat(batch.column("terms"))
            yield batch.append_column("leaf", pa.array(route(doc, term, batch.num_rows, tree.value), pa.int32()))

    return run


_ARRAYS = {
    "ids": np.int64, "named": bool, "terms": np.int32, "top": np.int32, "docs_at": np.int32, "entries_at": np.int64,
    "entry_term": np.int32, "entry_top": np.int32, "postings_at": np.int64, "place": np.int16, "impact": np.int32,
}
_SHARD = "shard int, " + ", ".join(f"{c} binary" for c in _ARRAYS)


def _built(total: int, length: int, largest: int):
    """A shard's rows as one row: documents in the order of bisection, postings by cluster and term."""

    def run(rows: pa.Table) -> pa.Table:
        n = rows.num_rows
        order = np.argsort(rows.column("key").to_numpy(), kind="stable")  # the order of arrival doesn't matter
        rows = rows.take(pa.array(order))
        doc, term = _flat(rows.column("terms"))
        tf = np.concatenate([np.frombuffer(x, np.int64) for x in rows.column("tf").to_pylist()])
        m = np.array([10 + 90 * int(x) * total // length for x in rows.column("n").to_pylist()], np.int64)
        impact = (1_000_000_000 * tf) // (1000 * tf + 8 * m[doc])
        local, inner = np.unique(term, return_inverse=True)
        depth = max(0, math.ceil(math.log2(n / largest)))
        leaf = bisect(doc, inner, n, depth, len(local))
        order = np.argsort(leaf, kind="stable")
        place = np.empty(n, np.int64)
        place[order] = np.arange(n)
        cut = np.flatnonzero(np.append(True, np.diff(leaf[order]) > 0))
        cluster = np.searchsorted(cut, place, "right") - 1
        by = np.lexsort((place[doc], term, cluster[doc]))
        doc, term, impact = doc[by], term[by], impact[by]
        entry = np.flatnonzero(np.append(True, (np.diff(term) != 0) | (np.diff(cluster[doc]) != 0)))
        top = np.zeros(len(local), np.int64)
        np.maximum.at(top, np.searchsorted(local, term), impact)
        ids = rows.column("id").combine_chunks()
        out = {
            "ids": np.asarray(ids.fill_null(0))[order], "named": np.asarray(ids.is_valid())[order], "terms": local, "top": top,
            "docs_at": np.append(cut, n), "entries_at": np.searchsorted(cluster[doc[entry]], np.arange(len(cut) + 1)),
            "entry_term": term[entry], "entry_top": np.maximum.reduceat(impact, entry), "postings_at": np.append(entry, len(doc)),
            "place": place[doc] - cut[cluster[doc]], "impact": impact,
        }
        packed = {c: pa.array([np.ascontiguousarray(out[c].astype(t)).tobytes()], pa.binary()) for c, t in _ARRAYS.items()}
        return pa.table({"shard": pa.array([rows.column("shard")[0].as_py()], pa.int32()), **packed})

    return run


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.column("shard")[i].as_py(), {c: np.frombuffer(batch.column(c)[i].as_py(), t) for c, t in _ARRAYS.items() if c in batch.schema.names}


def _bound(shard: dict[str, np.ndarray], terms: np.ndarray, weights: np.ndarray) -> int:
    at = np.searchsorted(shard["terms"], terms)
    found = at < len(shard["terms"])
    found[found] = shard["terms"][at[found]] == terms[found]
    return int((shard["top"][at[found]].astype(np.int64) * weights[found]).sum())


def _seeds(query):
    """Each item's shard of highest bound among those of one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, best = query.value["items"], {}
        for number, shard in _opened(batches):
            for i, (terms, weights) in enumerate(items):
                if (b := _bound(shard, terms, weights)) > best.get(i, (0, 0))[0]:
                    best[i] = (b, number)
        columns = [pa.array(list(best), pa.int32()), pa.array([b for b, _ in best.values()], pa.int64()), pa.array([s for _, s in best.values()], pa.int32())]
        yield pa.RecordBatch.from_arrays(columns, ["item", "bound", "shard"])

    return run


def search_shard(shard: dict[str, np.ndarray], terms: np.ndarray, weights: np.ndarray, size: int, least: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(ids, named, scores, clusters visited): the k best documents of a shard with scores of `least` or more."""
    dense = np.zeros(size, np.int64)
    dense[terms] = weights
    bounds = np.add.reduceat(dense[shard["entry_term"]] * shard["entry_top"], shard["entries_at"][:-1])
    ids, named, scores = np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64)
    visited, limit = 0, max(least, 1)
    for c in np.argsort(-bounds, kind="stable"):
        if bounds[c] < limit:
            break
        visited += 1
        lo, hi = shard["entries_at"][c], shard["entries_at"][c + 1]
        entry = lo + np.flatnonzero(dense[shard["entry_term"][lo:hi]])
        first, count = shard["postings_at"][entry], shard["postings_at"][entry + 1] - shard["postings_at"][entry]
        at = np.repeat(first - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
        part = np.zeros(shard["docs_at"][c + 1] - shard["docs_at"][c], np.int64)
        np.add.at(part, shard["place"][at], shard["impact"][at] * np.repeat(dense[shard["entry_term"][entry]], count))
        near = np.flatnonzero(part >= limit)
        if len(near):
            at = shard["docs_at"][c] + near
            ids, named, scores = np.append(ids, shard["ids"][at]), np.append(named, shard["named"][at]), np.append(scores, part[near])
            keep = np.lexsort((ids, ~named, -scores))[:k]
            ids, named, scores = ids[keep], named[keep], scores[keep]
            if len(scores) == k:
                limit = max(limit, int(scores[-1]))
    return ids, named, scores, visited


def _searched(query, k: int, chosen: dict[int, list[int]] | None, least: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, size = query.value["items"], query.value["size"]
        for number, shard in _opened(batches):
            out = [[], [], []]
            for i in range(len(items)) if chosen is None else chosen[number]:
                terms, weights = items[i]
                if (bound := _bound(shard, terms, weights)) and bound >= least.get(i, 0):
                    ids, named, scores, _ = search_shard(shard, terms, weights, size, least.get(i, 0), k)
                    out[0] += [i] * len(ids)
                    out[1] += [x if y else None for x, y in zip(ids.tolist(), named.tolist())]
                    out[2] += scores.tolist()
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int32(), pa.int64(), pa.int64()))], ["item", "id", "score"])

    return run


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _batch(docs: DataFrame, items: list[tuple[object, list[bytes]]], id_col: str, text_col: str, k: int) -> DataFrame:
    """(item, id, score, rank) of one batch of items, (name, terms) each."""
    spark = docs.sparkSession
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, terms in items for t in terms}))}
    size = len(vocabulary)
    known = spark.sparkContext.broadcast(vocabulary)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_term_rows(known), "id long, n long, terms binary, tf binary")
    rows = materialize(rows.withColumn("key", F.monotonically_increasing_id()))  # written once, so keys stand
    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("length"), F.count_if(F.length("terms") > 0).alias("indexed")).first()
    df = rows.select("terms").mapInArrow(_frequencies(size), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    weight = np.zeros(size, np.int64)
    for r in df:
        weight[r["term"]] = math.floor(1000 * math.log((2 * total["n"] + 2) / (2 * r["df"] + 1)))
    arrays = [np.array(sorted(vocabulary[t] for t in terms), np.int32) for _, terms in items]
    query = spark.sparkContext.broadcast({"size": size, "items": [(t, weight[t]) for t in arrays]})
    rows = rows.where(F.length("terms") > 0)

    depth = max(0, min(math.ceil(math.log2(max(1, total["indexed"]) / SHARD)), int(math.log2(SAMPLE / LEAST_LEAF))))
    tree: list[np.ndarray] = []
    if depth:
        sample = rows.orderBy(F.xxhash64("key"), "key").limit(SAMPLE).select("terms").toArrow()
        bisect(*_flat(sample.column("terms")), sample.num_rows, depth, size, tree)
    routed = rows.mapInArrow(_routed(spark.sparkContext.broadcast(tree)), "id long, n long, terms binary, tf binary, key long, leaf int")
    pieces = [1] * (1 << depth)
    for r in routed.groupBy("leaf").count().collect():
        pieces[r["leaf"]] = -(-r["count"] // SHARD)
    before = np.append(0, np.cumsum(pieces)[:-1]).tolist()
    listed = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("leaf") + 1)
    shard = (listed(before) + F.pmod(F.xxhash64("key"), listed(pieces))).cast("int")
    index = materialize(routed.withColumn("shard", shard).groupBy("shard").applyInArrow(_built(total["n"], max(1, total["length"]), CLUSTER), _SHARD))
    release(rows)

    seeds = index.select("shard", "terms", "top").mapInArrow(_seeds(query), "item int, bound long, shard int")
    chosen: dict[int, list[int]] = {}
    for r in seeds.groupBy("item").agg(F.max_by("shard", F.struct("bound", "shard")).alias("shard")).collect():
        chosen.setdefault(r["shard"], []).append(r["item"])
    found = index.where(F.col("shard").isin(list(chosen))).mapInArrow(_searched(query, k, chosen, {}), "item int, id long, score long")
    least = {r["item"]: r["score"] for r in _first(found, k).where(F.col("rank") == k).collect()}
    return _first(index.mapInArrow(_searched(query, k, None, least), "item int, id long, score long"), k)


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    query_bytes: int = QUERY_BYTES,
) -> DataFrame:
    """(item_col, rank, id_col, score): the k documents of highest score above 0 for each item.

    Terms are maximal runs of ASCII letters and digits and of all characters beyond ASCII, A-Z
    lower-cased. Null and empty texts have none: such documents are not counted, such items give no
    row. Each row of either table counts for itself, equal ids and texts included, so a repeated item
    has its list twice; a null id comes after all others among equal scores. Other columns are
    ignored.
    """
    if k < 1:
        raise ValueError("k must be 1 or more")
    spark, kind = docs.sparkSession, items.schema[item_col].dataType
    asked = items.select(F.col(item_col).alias("name"), F.col(item_text_col).cast("string").alias("text")).where(F.length("text") > 0)
    octets = asked.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    batches, out = max(1, -(-octets // query_bytes)), None
    for b in range(batches):
        part = asked.where(F.pmod(F.xxhash64("name", "text"), F.lit(batches)) == b).orderBy("name", "text").collect()
        named = [(r["name"], list(term_counts(r["text"].encode())[1])) for r in part]
        named = [(name, terms) for name, terms in named if terms]
        if not named:
            continue
        names = spark.createDataFrame([(i, name) for i, (name, _) in enumerate(named)], f"item int, name {kind.simpleString()}")
        found = _batch(docs, named, id_col, text_col, k).join(F.broadcast(names), "item")  # names of one batch of bounded text
        found = found.select(F.col("name").alias(item_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
        out = found if out is None else out.unionByName(found)
    if out is None:
        out = spark.createDataFrame([], f"{item_col} {kind.simpleString()}, rank int, {id_col} long, score long")
    return out
