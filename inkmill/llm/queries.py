"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_documents
from .collocations import collocations
from .common import id_fold, table
from .embed_dedup import embedding_components
from .exact_dedup import exact_duplicates
from .langid import identify_languages, train_language_model
from .lexical_search import rank_documents
from .lm_scoring import lm_scores
from .mixing import mixture, mixture_sql
from .partenum import jaccard_components
from .pii import find_pii
from .quality import quality_scores, train_quality_model
from .substring_dedup import remove_repeats
from .vector_search import top_k_products

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = id_fold("doc_id", 3) == 1
    model = train_language_model(docs.where(~held_out))
    return identify_languages(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "n_positions")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), WORD_BPE, with_ids=False)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), id_fold("doc_id", 5) == 0
    labels = table(spark, sf_dir, "labels")
    model = train_quality_model(docs, labels.where(~held_out))
    out = quality_scores(docs, model)
    return out.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_components(table(spark, sf_dir, "embeddings"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = id_fold("doc_id", 7) == 2
    scores = lm_scores(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(table(spark, sf_dir, "documents"), whole=True)


def op11_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP4_SQL = f"""
WITH d AS (SELECT doc_id, {_FOLDED} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""

OP11_SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS k, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, q.k, c.vec_id,
         list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.k <> q.k AND len(c.e) = len(q.e)
), r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, vec_id NULLS LAST) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""

_TERMS = f"regexp_extract_all({_FOLDED}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, {_TERMS} AS terms FROM documents),
size AS (SELECT k, doc_id, len(terms) AS n FROM d WHERE len(terms) > 0),
total AS (SELECT count(*) AS docs, sum(n)::BIGINT AS length FROM size),
tf AS (SELECT k, t, count(*) AS tf FROM (SELECT k, unnest(terms) AS t FROM d) GROUP BY k, t),
weight AS (SELECT t, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, total GROUP BY t, docs),
item AS (SELECT row_number() OVER () AS i, item_id, unnest(list_distinct({_TERMS})) AS t FROM benchmark),
score AS (
  SELECT i, item_id, k, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // length))))::BIGINT AS score
  FROM item JOIN weight USING (t) JOIN tf USING (t) JOIN size USING (k), total GROUP BY i, item_id, k, doc_id
), r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13_SQL = f"""
WITH piece AS (
  SELECT row_number() OVER () AS p, lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w
  FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_FOLDED}, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)
), total AS (SELECT lang, sum(len(w))::HUGEINT AS n FROM piece GROUP BY lang),
start AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM piece WHERE len(w) > 0),
phrase AS (SELECT lang, list_slice(w, i, i + k - 1) AS words FROM start, range(1, 6) AS t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, words, count(*)::HUGEINT AS a FROM phrase GROUP BY lang, words HAVING count(*) >= 100),
longer AS (
  SELECT DISTINCT s.lang, s.words, s.a
  FROM (SELECT lang, list_slice(words, i, i + k - 1) AS words, a
        FROM f, range(1, 5) AS x(i), range(2, 5) AS t(k) WHERE k < len(words) AND i + k - 1 <= len(words)) AS s
), gone AS (SELECT DISTINCT f.lang, f.words FROM f JOIN longer AS s ON f.lang = s.lang AND f.words = s.words AND 100 * s.a >= 100 * f.a),
cut AS (
  SELECT c.lang, c.words, c.a, n, k, x.a AS l, y.a AS r, (1000 * c.a * n) // (x.a * y.a) AS score
  FROM (SELECT lang, words, a, unnest(range(1, len(words))) AS k FROM f WHERE len(words) > 1) AS c JOIN total USING (lang)
  JOIN f AS x ON x.lang = c.lang AND x.words = list_slice(c.words, 1, k) JOIN f AS y ON y.lang = c.lang AND y.words = list_slice(c.words, k + 1, len(c.words))
  ANTI JOIN gone AS g ON g.lang = c.lang AND g.words = c.words
), worst AS (SELECT *, row_number() OVER (PARTITION BY lang, words ORDER BY score, k) AS place FROM cut),
ranked AS (
  SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(words, ' ')) AS rank, array_to_string(words, ' ') AS phrase, a, l, r, n, score
  FROM worst WHERE place = 1
)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM ranked WHERE rank <= 2000
"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_pii": op5_pii,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_embedding_dedup": op8_embedding_dedup,
    "op9_lm_scoring": op9_lm_scoring,
    "op10_mixing": op10_mixing,
    "op11_vector_search": op11_vector_search,
    "op12_lexical_search": op12_lexical_search,
    "op13_collocations": op13_collocations,
}

ORACLE_SQL: dict[str, str] = {
    "op4_exact_dedup": OP4_SQL,
    "op10_mixing": mixture_sql(),
    "op11_vector_search": OP11_SQL,
    "op12_lexical_search": OP12_SQL,
    "op13_collocations": OP13_SQL,
}
