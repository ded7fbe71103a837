import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.llm import bpe, langid, lm_scoring, mixing
from inkmill.llm.pii import find_pii
from inkmill.llm.quality import quality_scores, train_quality_model
from inkmill.llm.queries import WORD_BPE, op1_language_id, op3_quality

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def test_gradients_match_differences():
    model = langid.ByteGRU(["a", "b"], hidden=3)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}
    x, y = np.array([[97, 98, 99], [99, 97, 97]], np.uint8), np.array([0, 1])
    grads, _ = model.gradients(x, y)
    for name, at in (("uf", (1, 2)), ("cb", (0, 1)), ("xf", (97, 4)), ("o", (2, 1)), ("xb", (99, 8))):
        held = model.p[name][at]
        losses = []
        for d in (1e-3, -1e-3):
            model.p[name][at] = held + d
            losses.append(model.gradients(x, y)[1])
        model.p[name][at] = held
        assert grads[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-4)


def test_languages_held_out(spark):
    rows = op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert np.mean([r.lang_pred == r.lang for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_languages_of_awkward_texts(spark):
    model = langid.ByteGRU(["a", "b"])
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "123 ²!"), (4, "word " * 5000), (None, "é")], DOCS)
    got = {r.doc_id: r for r in langid.identify_languages(rows, model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and got[4].n_positions == 20000 and got[None].n_positions == 2
    assert {r.lang_pred for r in langid.identify_languages(rows, None).collect()} == {"und"}


def test_bpe_matches_the_library():
    from tokenizers import Tokenizer

    library, mine = Tokenizer.from_file(WORD_BPE), bpe.Encoder(bpe.WordBPE(WORD_BPE))
    rng = random.Random(1)
    texts = ["", "Hello WORLD's don't!!'s 123 ²½", "a<|endoftext|>b <|startoftext|>É", "ΑΣ ΟΔΥΣΣΕΥΣ İstanbul ǅ", "x" * 3000, "日本語 😀😀👩‍👩‍👧", "\x00\x01 \x1f a", " \t\n"]
    texts += ["".join(rng.choice("abcdeLST'sé́ßΣσ \n!?.-12²🎉中<|>\x1c\x85\xa0　İ") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    for text, ids in zip(texts, mine.encode(texts)):
        want = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert mine.model.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_of_null_and_empty(spark):
    got = bpe.encode_documents(spark.createDataFrame([(1, None), (2, ""), (None, "a")], DOCS), WORD_BPE)
    assert {r.doc_id: r.n_tokens for r in got.collect()} == {1: 0, 2: 0, None: 1}


def test_quality_held_out(spark):
    rows = op3_quality(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_without_labels(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a" * 10000)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality_scores(docs, train_quality_model(docs, labels)).collect()] == [0.5] * 3


def test_pii(spark):
    rng = random.Random(2)
    rows = [(i, "".join(rng.choice("ab.@-_%+01234 56789é😀 \n()") for _ in range(rng.randint(0, 80)))) for i in range(150)]
    rows += [(1000 + i, "".join(rng.choice("0123.4 5-6+()78@a") for _ in range(rng.randint(0, 120)))) for i in range(150)]
    rows += [(3000, None), (3001, ""), (3002, "1" * 20000), (3003, "10.0.0.0 007.1.2.3 256.1.1.1")]
    rows += [(4000 + i, f"zz mail-me: user{i}@ex{i}.com end") for i in range(12)] + [(5000 + i, f"qq mail-me: other{i}(at)host.com tail") for i in range(3)]
    for r in find_pii(spark.createDataFrame(rows, DOCS).repartition(3)).collect():
        counts, listed = brute.pii(dict(rows)[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.spans == (listed if r.doc_id < 5000 else "email:12:30")
        import hashlib

        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()


def test_pii_contexts_found_through_discovered_instances(spark):
    chain = ["first:", "second:", "third:", "fourth:", "fifth:", "sixth:", "seventh:"]
    texts = [f"zz first: user{i}@ex{i}.com end" for i in range(60)]
    for k, (a, b) in enumerate(zip(chain, chain[1:])):  # six new values of one context are most of what the next one has
        texts += [f"zz {x} p{k}v{i}(at)host.com end" for i in range(6) for x in (a, *[b] * 10)]
    texts += ["zz seventh: alone1(at)host.com end", "zz never: alone2(at)host.com end"]
    got = {r.doc_id: r.n_added for r in find_pii(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect()}
    assert all(got[i] == (1 if "(at)" in t and "never" not in t else 0) for i, t in enumerate(texts))


def test_lm_scores(spark):
    rows = [(r[0], r[1]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, " ")]
    df, held = spark.createDataFrame(rows, DOCS), F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    want = brute.base_scores(rows, lambda i: brute.crc(i) % 7 == 2)
    cast = {r[0]: tuple(r[1:]) for r in lm_scoring.lm_scores(df, ~held).collect()}
    for i, (n, known, total, base) in want.items():
        assert cast[i][:3] == (n, known, total) and cast[i][3] == pytest.approx(base, rel=1e-9)
    routed = {r[0]: r[5] for r in lm_scoring.lm_scores(df, ~held, max_broadcast=0).collect()}
    assert all(routed[i] == pytest.approx(cast[i][4], rel=1e-9) for i in want)
    out = [i for i in want if brute.crc(i) % 7 == 2]
    assert sum(cast[i][4] for i in out) > sum(cast[i][3] for i in out)


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(4)
    keys, counts = rng.integers(1, 1 << 63, 3000, dtype=np.uint64), rng.geometric(0.1, 3000)
    level = lm_scoring.levels(counts)
    found = lm_scoring.Segment.filled(keys, level).level(keys)
    assert (found >= level).all() and (found == level).mean() > 0.8


def test_filter_errs_on_one_key_in_a_hundred():
    rng = np.random.default_rng(5)
    keys, counts = rng.integers(1, 1 << 63, 60000, dtype=np.uint64), rng.geometric(0.1, 60000)
    level = lm_scoring.levels(counts[:30000])
    segment = lm_scoring.Segment.filled(keys[:30000], level)
    assert (segment.level(keys[30000:]) > 0).mean() < 0.012
    assert (segment.level(keys[:30000]) > level).mean() < 0.012


def test_mixture_meets_targets_and_table_form_agrees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    few = {r.doc_id: (r.weight, r.sampled) for r in mixing.mixture(docs).collect()}
    assert few == {r.doc_id: (r.weight, r.sampled) for r in mixing.mixture(docs, max_cells=0, sweeps=12).collect()}
    rows = mixing.mixture(docs).toPandas()
    got = rows.assign(t=rows.n_tokens * rows.weight).groupby("lang").t.sum()
    want = mixing.tempered(rows.groupby("lang").n_tokens.sum().to_dict())
    assert all(got[k] / got.sum() == pytest.approx(v, rel=1e-3) for k, v in want.items())


def test_sampled_tokens_meet_targets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = mixing.mixture(docs, whole=True).toPandas()
    rows["expected"] = rows.n_tokens * rows.probability
    for m in mixing.MARGINS:
        got, want = rows.groupby(m).expected.sum() / rows.expected.sum(), mixing.tempered(rows.groupby(m).n_tokens.sum().to_dict())
        assert all(got[k] == pytest.approx(v, rel=1e-3) for k, v in want.items())
    assert {r.doc_id for r in mixing.sample_mixture(docs).collect()} == set(rows[rows.sampled].doc_id)


def test_mixture_of_awkward_rows(spark):
    rows = spark.createDataFrame([(1, None, None, None, "x"), (1, None, None, None, "x"), (2, "a b", "s", "en", "y")], "doc_id long, text string, source string, lang string, topic string")
    assert mixing.mixture(rows).count() == 3 and mixing.mixture(rows.limit(0)).count() == 0
    assert mixing.sample_mixture(rows, rate=10**9).columns == rows.columns


def test_lm_buckets_are_read_in_stretches():
    rng = np.random.default_rng(6)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 20_000, 16_000)) for _ in range(80)]
    table = pa.table({"bucket": pa.array([3] * len(texts), pa.int32()), "id": list(range(len(texts))), "text": texts, "train": [True] * len(texts)})
    tracemalloc.start()
    told = lm_scoring._own_counts(4)(table)
    first = tracemalloc.get_traced_memory()[1]
    told = told.select(["keys", "counts"]).append_column("kind", pa.array([0] * told.num_rows, pa.int32()))
    schema = T.StructType([T.StructField("id", T.LongType()), *(T.StructField(n, T.LongType()) for n in ("n_tokens", "n_known", "train_tokens")), *(T.StructField(n, T.DoubleType()) for n in ("base_score", "score"))])
    tracemalloc.reset_peak()
    got = lm_scoring._scores(4, None, 80 * 16_001, 20_001, schema)(table, told)
    second = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.column("n_known").to_pylist() == [16_001] * 80
    assert max(first, second) < 80 << 20  # some eight megabytes of text; at once, scoring took 185 MB
