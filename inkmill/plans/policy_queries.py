"""Queries of the rule bundle and of venue profiles. Profiles are taken from `nation`, which take over
from those of `region`, which take over from one for all; papers are typed by their language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import bundle as U
from inkmill.operators import policy as Y
from inkmill.operators import regions as G
from inkmill.plans.base import Registry, select_from, table
from inkmill.plans.paper_queries import ORACLE_SQL as PAPER_SQL
from inkmill.plans.paper_queries import _quoted, paper
from inkmill.plans.prose_queries import _SPLIT
from inkmill.plans.text_queries import _LINES, lines

R = Registry()

_RULE = "SELECT doc_id, line, {artifact} AS artifact, {name} AS rule, {tier} AS tier, regexp_extract_all(raw, {p}) AS said, regexp_split_to_array(raw, {p}) AS kept FROM lines WHERE regexp_matches(raw, {p})"
_BUNDLE = _LINES + ", found AS (" + " UNION ALL ".join(_RULE.format(artifact=_quoted(r.artifact), name=_quoted(r.name), tier=_quoted(r.tier), p=_quoted(r.pattern)) for r in U.TEXT_RULES) + "), findings AS (SELECT doc_id, line, artifact, rule, tier, (list_sum(list_transform(kept[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(said[1:i - 1], lambda x: length(x))), 0))::INT AS start, said[i] AS match FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM found))"
R.add("rule_bundle", lambda s, d: U.bundle(lines(s, d)), _BUNDLE + " SELECT * FROM findings")
R.add(
    "rule_bundle_summary", lambda s, d: U.bundle_summary(U.bundle(lines(s, d))),
    _BUNDLE + " SELECT artifact, rule, tier, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, first(line ORDER BY doc_id, line) AS first_line FROM findings GROUP BY 1, 2, 3",
)

_PROFILES = """SELECT 'n' || CAST(n_nationkey AS STRING) AS profile, 'r' || CAST(n_regionkey AS STRING) AS parent FROM nation
 UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), 'all' FROM region UNION ALL SELECT 'all', CAST(NULL AS STRING) FROM region WHERE r_regionkey = 0"""
_SETTINGS = """SELECT 'n' || CAST(n_nationkey AS STRING) AS profile, CASE CAST(n_nationkey % 3 AS INT) WHEN 0 THEN 'en' WHEN 1 THEN NULL ELSE 'de' END AS article_type,
 CASE CAST(n_nationkey % 4 AS INT) WHEN 0 THEN 'body' WHEN 1 THEN 'abstract' WHEN 2 THEN 'methods' ELSE 'front' END AS section, CASE WHEN n_nationkey % 2 = 0 THEN 'sentence' ELSE 'paragraph' END AS unit,
 CASE WHEN n_nationkey % 5 > 0 THEN CAST(10 + n_nationkey AS DOUBLE) END AS cap, CAST(n_nationkey % 3 AS DOUBLE) / 8 AS tolerance FROM nation
 UNION ALL SELECT 'r' || CAST(r_regionkey AS STRING), CASE WHEN r_regionkey % 2 = 0 THEN 'fr' END, 'front', 'sentence', CAST(15 + r_regionkey AS DOUBLE), CAST(0 AS DOUBLE) FROM region
 UNION ALL SELECT 'all', NULL, 'front', 'sentence', CAST(30 AS DOUBLE), CAST(0.25 AS DOUBLE) FROM region WHERE r_regionkey = 0
 UNION ALL SELECT 'all', NULL, 'body', 'paragraph', CAST(60 AS DOUBLE), CAST(0 AS DOUBLE) FROM region WHERE r_regionkey = 0"""


def policy(s: SparkSession, d: str) -> DataFrame:
    return Y.resolved(select_from(s, d, _PROFILES, "nation", "region"), select_from(s, d, _SETTINGS, "nation", "region"))


def venue_lines(s: SparkSession, d: str) -> DataFrame:
    types = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("article_type"))
    rows = G.section_kinds(paper(s, d)).join(types, F.col("doc_id") == F.col("id"))
    return rows.select("doc_id", "line", "raw", "kind", F.concat(F.lit("n"), F.col("doc_id") % 25).alias("profile"), "article_type")


_POLICY = f"""WITH RECURSIVE profiles AS ({_PROFILES}), settings AS ({_SETTINGS}), lineage AS (SELECT profile, profile AS source, parent, 0 AS distance FROM profiles
   UNION ALL SELECT l.profile, p.profile, p.parent, distance + 1 FROM lineage AS l JOIN profiles AS p ON p.profile = l.parent),
 said AS (SELECT l.profile, l.distance, s.* EXCLUDE (profile), s.profile AS source FROM lineage AS l JOIN settings AS s ON s.profile = l.source),
 types AS (SELECT DISTINCT profile, article_type AS wanted FROM said UNION SELECT profile, NULL FROM profiles),
 policy AS (SELECT profile, wanted AS article_type, section, unit, cap, tolerance, source FROM said JOIN types USING (profile) WHERE article_type IS NULL OR article_type = wanted
   QUALIFY row_number() OVER (PARTITION BY profile, wanted, section, unit ORDER BY distance, article_type IS NULL, cap NULLS LAST) = 1)"""
R.add("venue_policy", policy, _POLICY + " SELECT * FROM policy")
_BARS = "CASE WHEN unit = 'paragraph' THEN 250 ELSE CASE kind " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in Y.SENTENCE_BARS.items()) + " END END"
R.add(
    "long_text", lambda s, d: Y.long_text(venue_lines(s, d), policy(s, d)),
    _POLICY + ", " + PAPER_SQL["section_kinds"].removeprefix("WITH ").replace("\n    SELECT doc_id, line, raw, CASE WHEN legend", ", kinds AS (\n    SELECT doc_id, line, raw, CASE WHEN legend") + f"""),
    v AS (SELECT doc_id, line, raw, kind, 'n' || (doc_id % 25) AS profile, lang AS article_type FROM kinds JOIN documents USING (doc_id)),
    sents AS (SELECT * EXCLUDE (p), unnest(range(1, len(p) + 1)) AS nth, unnest(p) AS sentence FROM (SELECT *, {_SPLIT} AS p FROM v)),
    units AS (SELECT doc_id, line, kind, profile, article_type, 'paragraph' AS unit, 0 AS nth, len(regexp_extract_all(raw, '[^\\s\\x0B]+')) AS n_words FROM v
      UNION ALL SELECT doc_id, line, kind, profile, article_type, 'sentence', nth, len(regexp_extract_all(sentence, '[^\\s\\x0B]+')) FROM sents),
    w AS (SELECT *, CASE WHEN (profile, article_type) IN (SELECT (profile, article_type) FROM policy WHERE article_type IS NOT NULL) THEN article_type END AS wanted FROM units),
    j AS (SELECT w.doc_id, w.line, w.kind, w.unit, w.nth, w.n_words, floor(cap * (1 + tolerance) + 1e-9)::BIGINT AS cap, {_BARS.replace('unit', 'w.unit')} AS bar FROM w LEFT JOIN policy AS p ON p.profile = w.profile AND p.section = w.kind AND p.unit = w.unit AND p.article_type IS NOT DISTINCT FROM w.wanted)
    SELECT doc_id, line, kind, unit, nth::INT AS nth, n_words::INT AS n_words, cap, CASE WHEN n_words > cap THEN 'finding' ELSE 'advisory' END AS tier FROM j WHERE n_words > cap OR (cap IS NULL AND n_words > bar)""",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
