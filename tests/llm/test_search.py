import collections
import math
import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from inkmill.llm import lexical_search
from inkmill.llm.lexical_search import bisect, rank_documents, term_counts
from inkmill.llm.vector_search import inner_products, top_k_products

VECTORS = "vec_id long, embedding array<double>, score string, part string"


def brute_products(rows, k, step):
    sound = [(j, i, [math.floor(256 * x) for x in v]) for j, (i, v, *_) in enumerate(rows) if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for j, i, v in sound:
        if i is not None and i % step == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), o is None, o) for m, o, w in sound if m != j and len(w) == len(v)]
            out += [(i, n + 1, o, -s) for n, (s, _, o) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("group", [7, 1000])
def test_top_k_of_awkward_vectors(spark, group):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(1).tolist()) for i in range(90)]
    rows += [(100 + i, [0.5, 0.5, 0.0, -0.25]) for i in range(30)] + [(200, None), (201, [1.0, None, 0.0, 0.0]), (202, [float("nan")] * 4)]
    rows += [(203, [float("inf"), 0.0, 0.0, 0.0]), (204, []), (210, []), (206, [1.0]), (None, [2.0, 2.0, 2.0, 2.0]), (None, [2.0, 2.0, 2.0, 2.0])]
    rows += [(110, [0.5, 0.5, 0.0, -0.25])] * 2 + [(220, [1e9, -1e9, 1e9, 1e9]), (221, [1e200, 1.0, 0.0, 0.0]), (230, [1.0, 2.0])]
    rows = [(i, v, "x", "y") for i, v in rows]
    got = top_k_products(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, group=group, fan_in=2).collect()
    want = [(q, r, i, max(min(s, 2**63 - 1), -(2**63))) for q, r, i, s in brute_products(rows, 5, 10)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_top_k_of_no_rows_and_no_queries(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert top_k_products(empty, F.col("vec_id") % 10 == 0).count() == 0
    some = spark.createDataFrame([(1, [1.0], "", ""), (2, [2.0], "", "")], VECTORS)
    assert top_k_products(some, F.col("vec_id") % 10 == 0).count() == 0
    assert [tuple(r) for r in top_k_products(some, F.col("vec_id") == 1).collect()] == [(1, 1, 2, 256 * 512)]


def test_products_are_exact():
    rng = np.random.default_rng(1)
    for size in (200, 1 << 20, 1 << 40):
        a, b = (rng.integers(-size, size, (5, 33)).astype(float) for _ in range(2))
        want = [[max(-(2**63), min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q)))) for q in b] for p in a]
        assert inner_products(a, b).tolist() == want


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_ranks(docs, items, k=10):
    terms = [(i, TERM.findall(brute.fold(t))) for i, t in docs]
    terms = [(i, t) for i, t in terms if t]
    n, length = len(terms), sum(len(t) for _, t in terms)
    df = collections.Counter(x for _, t in terms for x in set(t))
    out = []
    for item, text in items:
        found = []
        for i, t in terms:
            tf, m = collections.Counter(t), 10 + 90 * len(t) * n // length
            weight = lambda x: math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1)))
            score = sum(weight(x) * (10**9 * tf[x] // (1000 * tf[x] + 8 * m)) for x in set(TERM.findall(brute.fold(text))) if tf[x])
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("query_bytes", [1 << 20, 60])
def test_ranks_are_exact(spark, monkeypatch, query_bytes):
    for name, value in (("SAMPLE", 64), ("LEAST_LEAF", 4), ("SHARD", 40), ("CLUSTER", 4)):
        monkeypatch.setattr(lexical_search, name, value)
    rng = random.Random(7)
    topics = [[f"t{t}w{w}" for w in range(12)] for t in range(5)]
    docs = [(i, " ".join(rng.choice(topics[rng.randrange(5)] if rng.random() < 0.2 else topics[i % 5]) for _ in range(rng.randint(1, 30)))) for i in range(220)]
    docs += [(300 + i, "T0w1 copy, copy; É9 copy") for i in range(90)] + [(500, None), (501, ""), (502, " .,;"), (None, "t0w1 é9"), (None, "t0w1 É9"), (7, "t1w1"), (7, "t1w1")]
    items = [(1, "t0w1 t0w2 t0w3"), (2, "copy É9"), (3, None), (4, "..."), (5, "absent"), (6, "t1w1 T1W1 t3w5 t4w2"), (6, "t1w1 T1W1 t3w5 t4w2"), (8, "é9"), (None, "t2w2")]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, score string, item int")
    asked = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, rank string")
    got = sorted(map(tuple, rank_documents(df, asked, query_bytes=query_bytes).collect()), key=str)
    assert got == brute_ranks(docs, [(i, t or "") for i, t in items])


def test_ranks_of_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert rank_documents(docs.limit(0), items).count() == 0
    assert rank_documents(docs, items.limit(0)).count() == 0
    assert rank_documents(docs, items).count() == 1


def test_bisection_puts_topics_apart():
    rng = np.random.default_rng(3)
    topic = rng.permutation(np.repeat(np.arange(4), 64))
    doc = np.repeat(np.arange(256), 10)
    term = topic[doc] * 40 + rng.integers(0, 40, len(doc))
    leaf = bisect(doc, term, 256, 2, 160)
    assert np.bincount(leaf).tolist() == [64] * 4
    assert sum(np.bincount(topic[leaf == x]).max() for x in range(4)) > 0.9 * 256


def test_clusters_are_skipped():
    visited = []
    search = lexical_search.search_shard
    rng = np.random.default_rng(3)
    docs = [(i, int(t), [f"t{t}w{w}" for w in rng.integers(0, 30, 12)]) for i, t in enumerate(rng.integers(0, 8, 1024))]
    known = {t: i for i, t in enumerate(sorted({x for _, _, w in docs for x in w}))}
    tf = [collections.Counter(known[x] for x in w) for _, _, w in docs]
    import pyarrow as pa

    rows = pa.table({
        "shard": pa.array([0] * 1024, pa.int32()), "key": list(range(1024)), "id": list(range(1024)), "n": [12] * 1024,
        "terms": [np.array(sorted(c), np.int32).tobytes() for c in tf], "tf": [np.array([c[t] for t in sorted(c)], np.int64).tobytes() for c in tf],
    })
    (_, shard), = lexical_search._opened(lexical_search._built(1024, 1024 * 12, 16)(rows).to_batches())
    for t in range(8):
        terms = np.array(sorted(known[f"t{t}w{w}"] for w in range(4)), np.int32)
        visited.append(search(shard, terms, np.full(4, 5000), len(known), 0, 10)[3])
    assert np.mean(visited) < 0.3 * (len(shard["docs_at"]) - 1)


def test_terms_of_long_texts_in_stretches(monkeypatch):
    text = "Ab é-c1 " * 500 + "x" * 300
    whole = term_counts(text.encode())
    monkeypatch.setattr(lexical_search, "STRETCH", 64)
    assert term_counts(text.encode()) == whole == (1501, {b"ab": 500, "é".encode(): 500, b"c1": 500, b"x" * 300: 1})
