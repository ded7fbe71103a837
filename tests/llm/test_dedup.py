import random

import brute
import numpy as np
import pytest

from inkmill.llm import exact_dedup, partenum
from inkmill.llm.components import components
from inkmill.llm.embed_dedup import embedding_components
from inkmill.llm.exact_dedup import drop_exact_duplicates, exact_duplicates
from inkmill.llm.partenum import _class_keys, _coarse, _in_cells, _signatures, _sketches, jaccard_components, keep_one_of_each
from inkmill.llm.substring_dedup import remove_repeats, suffix_order
from inkmill.llm.textbytes import all_words, shingle_sets

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]


def awkward():
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 14)))) for i in range(150)]
    for _ in range(12):
        base = [f"w{rng.randint(0, 999)}" for _ in range(rng.randint(10, 120))]
        for _ in range(rng.randint(2, 25)):
            words = list(base)
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = f"z{rng.randint(0, 99999)}"
            rows.append((len(rows), " ".join(words)))
    n = len(rows)
    return [*rows, (n, None), (n + 1, ""), (n + 2, " \n\t"), (n + 3, "One two"), (n + 4, "one TWO"), (n + 5, "é É")]


def test_exact_duplicates(spark, documents):
    long = "x" * 5000
    rows = [*documents, *((10**6 + i, t) for i, t in awkward()), (7 * 10**6, long + "A"), (7 * 10**6 + 1, long + "a"), (7 * 10**6 + 2, long + "b")]
    got = {r[0]: tuple(r[1:5]) for r in exact_duplicates(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == brute.exact(rows)


def test_exact_duplicates_when_blocks_share_a_hash(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: exact_dedup.F.lit(1).cast("long"))
    rows = [(1, "aaaa" * 3), (2, "AAAA" * 3), (3, "bbbb" * 3), (4, None)]
    got = {r[0]: tuple(r[1:5]) for r in exact_duplicates(spark.createDataFrame(rows, DOCS), block_chars=4).collect()}
    assert got == brute.exact(rows)


def test_exact_duplicates_repeated_rows_nulls_and_clashing_names(spark):
    rows = [(1, "a", "n"), (1, "a", "n"), (2, "A", "n"), (None, "b", "n"), (None, "b", "m")]
    df = spark.createDataFrame(rows, "doc_id long, text string, name string")
    got = sorted((r.doc_id is None, r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_duplicates(df).collect())
    assert got == [(False, 1, 2, 3, False), (False, 2, 2, 3, True), (True, None, None, 2, True)]
    assert {r.doc_id for r in drop_exact_duplicates(df).collect()} == {2, None}
    assert exact_duplicates(df.limit(0)).count() == 0


def test_jaccard_links_are_exact(spark, documents):
    for rows in (awkward(), documents):
        got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
        assert got == brute.jaccard(rows)


def test_similar_sets_share_enough_signatures():
    rng = random.Random(9)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randint(0, 10**6)}" for _ in range(rng.randint(8, 300))]
        other = list(base)
        for k in range(max(1, len(base) // 40)):
            other[k * 5 % len(other)] = f"v{k}"
        texts += [" ".join(base), " ".join(other)]
    import pyarrow as pa

    hashes, bounds = shingle_sets(all_words(pa.array(texts), lower=True))
    sig, owner, _, need = _signatures(hashes, bounds)
    sets = [set(hashes[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]
    of = [set(sig[owner == i].tolist()) for i in range(len(texts))]
    for i in range(0, len(texts), 2):
        a, b = sets[i], sets[i + 1]
        if 100 * len(a & b) >= 75 * len(a | b):
            assert len(of[i] & of[i + 1]) >= max(1, need[i, 0] if need[i, 0] == need[i + 1, 0] else 1)


def test_jaccard_without_rows_and_with_extra_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g", "x"), (2, "A b c d e f g", "y"), (None, "q", "z")], "doc_id long, text string, id string")
    assert jaccard_components(df.limit(0)).count() == 0
    assert {r.doc_id for r in keep_one_of_each(df).collect()} == {1, None}


def test_components_both_ways(spark):
    rng = random.Random(6)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000, 1000 + i) for i in range(60)] + [(2000 + i, 2001 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(links, "a long, b long")
    root = brute.roots([x for x in links if x[0] != x[1]], {n for x in links for n in x})
    want = {n: r for n, r in root.items() if n != r}
    for small in (10**6, 0):
        assert {r.node: r.root for r in components(df, small=small).collect()} == want
    assert components(df.limit(0)).count() == 0


def test_repeats(spark, documents):
    rng = random.Random(5)
    passages = [" ".join(f"p{j}_{i}" for i in range(50)) for j in range(3)]
    rows = [(i, f"é{i}  x {rng.choice(passages)}\t\n tail " + " ".join(f"q{rng.randint(0, 10**6)}" for _ in range(rng.randint(0, 40)))) for i in range(80)]
    rows += [(100 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))) for i in range(80)] + [(300, None), (301, ""), (302, " \n")]
    for part in (rows, documents):
        got = {r[0]: tuple(r[1:]) for r in remove_repeats(spark.createDataFrame(part, DOCS).repartition(3)).collect()}
        assert got == brute.repeats(part)
        small = remove_repeats(spark.createDataFrame(part, DOCS).repartition(3), group=5, chunk=100)  # lengthened prefixes, many chunks
        assert {r[0]: tuple(r[1:4]) for r in small.collect()} == {k: tuple(v[:3]) for k, v in got.items()}
    assert remove_repeats(spark.createDataFrame([], DOCS)).count() == 0


def test_repeats_of_null_and_repeated_ids(spark):
    text = " ".join(f"w{i}" for i in range(25))
    rows = [(5, text, "x"), (5, text, "x"), (None, text + " end", "y"), (2, "short", "z"), (9, None, "z")]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_words, r.n_removed) for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, bucket string")).collect())
    assert got == [(False, 2, 1, 0), (False, 5, 25, 25), (False, 5, 25, 25), (False, 9, 0, 0), (True, 0, 26, 0)]


def test_suffix_order():
    rng = random.Random(8)
    runs = [[rng.randint(1, 2) for _ in range(rng.randint(20, 45))] for _ in range(60)] + [[1] * 40, [1] * 30]
    words = np.array([w for r in runs for w in r], np.uint64)
    left = np.concatenate([np.arange(len(r), 0, -1) for r in runs])
    at = np.flatnonzero(left >= 20)
    order, common = suffix_order(words, left, at)
    suffix = [words[i : i + min(int(left[i]), 32)].tolist() for i in at[order]]
    assert suffix == sorted(suffix)
    for a, b, n in zip(suffix, suffix[1:], common[1:]):
        true = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert n == min(true, 31)


def test_embeddings(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(40, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 5] + 0.05 * rng.normal(size=16)).tolist()) for i in range(60)] + [(200 + i, base[0].tolist()) for i in range(5)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, [None] + [1.0] * 15), (304, []), (305, [1.0, 2.0]), (306, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    sound = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, count = [], dict.fromkeys((i for i, _ in rows), 0)
    for i, a in sound:
        for j, b in sound:
            if i != j and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.95:
                links.append((i, j))
                count[i] += 1
    root = brute.roots(links, count)
    got = {r[0]: tuple(r[1:]) for r in embedding_components(df, group=20).collect()}
    assert got == {i: (count[i], root[i], root[i] == i) for i in count}


def test_embeddings_of_repeated_and_null_ids(spark):
    rows = [(1, [1.0, 0.0], "a"), (1, [0.0, 1.0], "b"), (2, [1.0, 0.001], "c"), (None, [1.0, -0.001], "d"), (None, [-1.0, 0.0], "e"), (3, [0.0, 1.0], "f"), (3, [0.0, 1.0], "f")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, key string")
    got = sorted((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embedding_components(df).collect())
    assert got == [(False, 1, 2, 1, True), (False, 1, 2, 1, True), (False, 2, 2, 1, False), (False, 3, 2, 1, False), (False, 3, 2, 1, False), (True, 0, 0, None, True), (True, 0, 2, 1, False)]
    assert embedding_components(df.limit(0)).count() == 0


def test_embeddings_at_the_threshold(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.95, float(np.sqrt(1 - 0.95**2))]), (3, [3.0, 4.0]), (4, [4.0, 3.0])]
    got = {r.vec_id: r.n_links for r in embedding_components(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), least=0.96).collect()}
    assert got == {1: 0, 2: 0, 3: 1, 4: 1}


def test_word_hashes_of_like_arrangements_differ():
    a = "a"
    for _ in range(10):
        a += a.translate({97: 98, 98: 97})
    b = a.translate({97: 98, 98: 97})
    import pyarrow as pa

    words = all_words(pa.array([f"{a} {b} {a}"]), lower=True).hashes
    assert words[0] != words[1] and words[0] == words[2]


def test_jaccard_of_repeated_rows_one_large_group_and_a_common_line(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 9999)}" for _ in range(80)]
    line = [f"c{i}" for i in range(40)]
    rows = [(i, " ".join(base[:k] + [f"x{i}"] + base[k + 1 :])) for i, k in ((i, rng.randrange(80)) for i in range(120))]
    rows += [(200 + i, " ".join(line + [f"y{i}_{k}" for k in range(rng.randint(5, 60))])) for i in range(120)]
    rows += [(400, " ".join(f"v{k % 977}" for k in range(60000)))]
    want = brute.jaccard(rows)
    got = {r[0]: (r[1], r[2]) for r in jaccard_components(spark.createDataFrame(rows + rows[:5], DOCS).repartition(3)).collect()}
    assert got == want


def test_cells_need_only_short_sketches(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    sets = [np.unique(np.append(base[: 300 - i], rng.integers(0, 1 << 63, i, dtype=np.uint64))) for i in (0, 5, 12)] + [np.unique(rng.integers(0, 1 << 63, 300, dtype=np.uint64))]
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    keys = _class_keys(np.concatenate(sets), bounds).tolist()
    short = [bytearray(_coarse(x, len(s))) for x, s in zip(_sketches(np.concatenate(sets), bounds), sets)]
    classes = spark.createDataFrame([(k, len(s), c) for k, s, c in zip(keys, sets, short)], "set_key long, n long, coarse binary")
    large = spark.createDataFrame([(7, k) for k in keys], "group long, set_key long")
    roots = spark.createDataFrame([], "node long, root long")
    got = {(r.a, r.b) for r in _in_cells(large, roots, classes, 2, False).collect()}
    assert got == {tuple(sorted(p)) for p in ((keys[0], keys[1]), (keys[0], keys[2]), (keys[1], keys[2]))}


def test_cells_of_near_copies_give_sets_and_a_forest_not_pairs(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(0, 1 << 63, 100, dtype=np.uint64)
    sets = [np.unique(np.append(base[10:], rng.integers(0, 1 << 63, 3, dtype=np.uint64))) for _ in range(150)]
    sets += [np.unique(np.append(base[:40], rng.integers(0, 1 << 63, 60, dtype=np.uint64))) for _ in range(20)]
    bounds = np.append(0, np.cumsum([len(x) for x in sets]))
    keys = _class_keys(np.concatenate(sets), bounds).tolist()
    rows = [(k, len(s), bytearray(_coarse(x, len(s))), bytearray(s.tobytes())) for k, x, s in zip(keys, _sketches(np.concatenate(sets), bounds), sets)]
    classes = spark.createDataFrame(rows, "set_key long, n long, coarse binary, whole binary")
    large = spark.createDataFrame([(7, k) for k in keys], "group long, set_key long")
    roots = spark.createDataFrame([(k, keys[0]) for k in keys[1:30]], "node long, root long")
    near = [r.set_key for r in _in_cells(large, roots, classes, 2, True).collect()]
    assert len(near) == len(set(near)) and set(keys[:150]) <= set(near)  # one row a set, where pairs were 7,000
    for block in (1 << 20, 20_000):
        links = _in_cells(large, roots, classes, 2, True, "whole", block, partenum._cell_links)
        blocks = -(-sum(8 * len(s) for s in sets) // block)
        assert links.count() < 170 * blocks
        joined = {r.node: r.root for r in components(links.union(roots.selectExpr("root", "node"))).collect()}
        least = min(keys[:150])
        assert joined == {k: least for k in keys[:150] if k != least}


def test_packed_signatures_take_five_bytes_and_nine_a_set():
    import pyarrow as pa

    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randint(0, 10**9)}" for _ in range(n)) for n in (3, 5, 400, 400, 2000)] * 2 + [None, ""]
    rows = [r for b in partenum._packed(2)(iter([pa.RecordBatch.from_arrays([pa.array(texts)], names=["text"])])) for r in b.to_pylist()]
    signatures, keys = (sum(len(r[c]) for r in rows) // w for c, w in (("sig", 4), ("keys", 8)))
    assert sum(len(v) for r in rows for c, v in r.items() if c != "part") <= 5 * signatures + 10 * keys
    found = set()
    for r in rows:
        low, top, at, own = partenum._unpacked(*(pa.py_buffer(r[c]) for c in ("sig", "high", "keys", "counts")))
        assert (np.diff((top & 127).astype(int)) >= 0).all()
        found |= {(r["part"], int(h & 127) << 32 | int(x), int(k)) for x, h, k in zip(low, top, own[at])}
    words = all_words(pa.array(texts[:5]), lower=True)
    hashes, bounds = partenum.shingle_sets(words)
    sig, owner, _, _ = _signatures(hashes, bounds)
    assert found == {((s >> 39) % 2, s & (1 << 39) - 1, k) for s, k in zip(sig.tolist(), _class_keys(hashes, bounds)[owner].tolist())}


def test_groups_that_share_sets_deal_each_set_once(spark):
    near = [(g, k) for g in range(100, 140) for k in range(20) if k != g % 20]  # 40 signatures of 20 near copies
    far = [(500 + i, k) for i in range(6) for k in (1000 + i, 1001 + i)]  # a chain, longer than its links are wide
    alone = [(900, 50), (900, 51)]  # of one component
    large = spark.createDataFrame(near + far + alone, "group long, set_key long")
    roots = spark.createDataFrame([(51, 50), (19, 18)], "node long, root long")
    sizes = spark.createDataFrame([(k, 100) for k in {k for _, k in near + far + alone}], "set_key long, bytes long")
    got = {(r.group, r.set_key) for r in partenum._merged(large, roots, sizes, 2000).collect()}
    assert {k for g, k in got if g == 0} == set(range(20)) and sum(k < 20 for _, k in got) == 20
    assert not {50, 51} & {k for _, k in got}
    got = [(r.group, r.set_key) for r in partenum._merged(large, roots, sizes, 200).collect()]
    assert len(got) == len(set(got)) and {x for x in got if x[1] >= 1000} == set(far)  # merged cells would ship more
