"""Repeated rows, nulls, empty tables and clashing names, operator by operator."""

import collections

import brute
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from inkmill.llm import bpe, langid, lm_scoring
from inkmill.llm.pii import find_pii
from inkmill.llm.quality import quality_scores, train_quality_model
from inkmill.llm.queries import WORD_BPE

TEXTS = [(1, "One two three, four five"), (1, "One two three, four five"), (2, None), (3, ""), (None, "a@b.org und 10.0.0.1"), (None, "a@b.org und 10.0.0.1"), (4, "é" * 5000), (5, "123 !?")]
#: Names that the operators use themselves.
MORE = "score string, id string, bucket int, part int, spans string, n_tokens int, held_out string, mark string, kept string, base string"


@pytest.fixture
def docs(spark):
    rows = [(i, t, "en", "s", len(t or ""), *["x", "x", 1, 2, "y", 3, "z", "m", "k", "b"]) for i, t in TEXTS]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + MORE)


def several(rows):
    return collections.Counter(map(tuple, rows))


def test_languages(docs):
    model = langid.ByteGRU(["en", "fr"])
    plain = docs.select("doc_id", "text")
    got = several(langid.identify_languages(docs, model).collect())
    assert got == several(langid.identify_languages(plain, model).collect()) and sum(got.values()) == len(TEXTS)
    assert {r[1] for r in got if r[0] in (2, 3, 5)} == {"und"}
    assert langid.identify_languages(docs.limit(0), model).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(docs, None).collect()} == {"und"}
    assert langid.train_language_model(docs.limit(0)) is None


def test_bpe(docs):
    got = several(bpe.encode_documents(docs, WORD_BPE, with_ids=False).collect())
    assert got == several(bpe.encode_documents(docs.select("doc_id", "text"), WORD_BPE, with_ids=False).collect()) and sum(got.values()) == len(TEXTS)
    assert bpe.encode_documents(docs.limit(0), WORD_BPE).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, "x"), (3, 0, "x"), (5, 0, "x"), (1, 1, "x")], "doc_id long, quality int, text string")
    model = train_quality_model(docs, labels)
    got = several(quality_scores(docs, model).collect())
    assert sum(got.values()) == len(TEXTS) and all(0 <= r[1] <= 1 for r in got) and max(n for r, n in got.items() if r[0] == 1) == 2
    assert quality_scores(docs.limit(0), model).count() == 0
    assert train_quality_model(docs.limit(0), labels) is None
    assert {r.score for r in quality_scores(docs, train_quality_model(docs, labels.limit(0))).collect()} == {0.5}


def test_personal_data(docs):
    got = several(r[:6] for r in find_pii(docs).collect())
    assert got == several(r[:6] for r in find_pii(docs.select("doc_id", "text")).collect()) and sum(got.values()) == len(TEXTS)
    assert {r[1:5] for r in got if r[0] is None} == {(1, 1, 0, 0)}
    assert find_pii(docs.limit(0)).count() == 0


def test_language_model(docs):
    rows = [(i, t) for i, t in TEXTS if i is not None]
    got = lm_scoring.lm_scores(docs.where("doc_id IS NOT NULL"), F.col("doc_id") != 1).collect()
    tokens = [[*brute.WORD.findall(brute.fold(t)), None] for _, t in rows]
    counts = collections.Counter(x for (i, _), w in zip(rows, tokens) if i != 1 for x in w)
    assert several((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got) == several((i, len(w), sum(counts[x] > 0 for x in w), sum(counts.values())) for (i, _), w in zip(rows, tokens))
    assert all(r.score <= 0 for r in got)
    none = lm_scoring.lm_scores(docs, F.lit(False)).collect()
    assert len(none) == len(TEXTS) and {(r.n_known, r.train_tokens) for r in none} == {(0, 0)}
    assert lm_scoring.lm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_stages_keep_columns_and_take_empty_tables(spark, docs):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    stages = dict(corpus_pipeline.STAGES)
    for name in ("language_id", "exact_dedup", "near_dedup", "mixing"):
        assert stages[name](spark, docs.select(*columns), "").columns == columns
        assert stages[name](spark, docs.select(*columns).limit(0), "").count() == 0
    assert sorted(r.doc_id or 0 for r in stages["language_id"](spark, docs.select(*columns), "").collect()) == [0, 0, 1, 1, 4]
    assert stages["bpe_encoding"](spark, docs, "").count() == len(TEXTS)
    assert stages["bpe_encoding"](spark, docs.limit(0), "").count() == 0
