"""Queries of the dictionary scan: lines of `documents` that mention goods of `part` and segments of
`customer`, written in several ways; the dictionary is taken from those two tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import dictionary as D
from inkmill.plans.base import Registry, table
from inkmill.plans.text_queries import _LINES, lines

R = Registry()

_MENTION = """CASE CAST((doc_id + line * 5) % 8 AS INT)
 WHEN 0 THEN raw || ', ' || upper(p_name) || ' of ' || c_mktsegment
 WHEN 1 THEN p_name || ' (' || token || '); ' || raw || ' ' || p_name || 's'
 WHEN 2 THEN raw || ' "the ' || p_name || '" ' || p_name || lower(c_mktsegment) || ' x' || p_name
 WHEN 3 THEN 'The ' || replace(p_name, ' ', '-') || ' ' || p_name || ' ' || raw || ' ' || split_part(p_name, ' ', 2) || '.'
 WHEN 4 THEN p_name || ' (ZZ) ' || raw || ' ' || replace(p_name, ' ', ' - ') || 'es, ' || lower(c_mktsegment)
 ELSE raw END"""


def mentions(s: SparkSession, d: str) -> DataFrame:
    part = table(s, d, "part").select("p_partkey", "p_name", F.upper(F.regexp_replace("p_name", r"(\w)\w* (\w)\w*", "$1$2")).alias("token"))
    customer = table(s, d, "customer").select("c_custkey", "c_mktsegment")
    key = F.col("doc_id") * 31 + F.col("line") * 7
    rows = lines(s, d).withColumn("p_partkey", F.pmod(key, F.lit(part.count()))).withColumn("c_custkey", F.pmod(key, F.lit(customer.count())))
    return rows.join(part, "p_partkey").join(customer, "c_custkey").selectExpr("doc_id", "CAST(line AS BIGINT) AS line", "CAST(floor(line / 4) AS BIGINT) AS section", f"{_MENTION} AS raw")


def families(s: SparkSession, d: str) -> DataFrame:
    noun = F.split_part("p_name", F.lit(" "), F.lit(2))
    part, segment = table(s, d, "part"), table(s, d, "customer").select(F.lit("segment").alias("family"), F.col("c_mktsegment").alias("variant"))
    return part.select(noun.alias("family"), F.col("p_name").alias("variant")).unionByName(part.select(noun.alias("family"), noun.alias("variant"))).unionByName(segment).distinct()


def forms(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "part").select(F.upper(F.regexp_replace("p_name", r"(\w)\w* (\w)\w*", "$1$2")).alias("token"), F.col("p_name").alias("variant")).distinct()


_TOKEN = r"upper(regexp_replace(p_name, '(\w)\w* (\w)\w*', '\1\2'))"
_M = _LINES + f""", paired AS (SELECT doc_id, line::BIGINT AS line, raw, p_name, {_TOKEN} AS token, c_mktsegment FROM lines
  JOIN part ON p_partkey = (doc_id * 31 + line * 7) % (SELECT count(*) FROM part) JOIN customer ON c_custkey = (doc_id * 31 + line * 7) % (SELECT count(*) FROM customer)),
 mentions AS (SELECT doc_id, line, floor(line / 4)::BIGINT AS section, {_MENTION} AS raw FROM paired),
 families AS (SELECT split_part(p_name, ' ', 2) AS family, p_name AS variant FROM part UNION SELECT split_part(p_name, ' ', 2), split_part(p_name, ' ', 2) FROM part UNION SELECT 'segment', c_mktsegment FROM customer),
 cut AS (SELECT *, string_split(lower(raw), lower(variant)) AS p FROM mentions JOIN families ON contains(lower(raw), lower(variant))),
 each AS (SELECT *, unnest(range(1, len(p))) AS k FROM cut),
 hits AS (SELECT doc_id, line, raw, family, variant, list_sum(list_transform(p[1:k], lambda x: length(x)))::INT + (k - 1)::INT * length(variant)::INT + 1 AS start FROM each
   WHERE NOT regexp_matches(CASE WHEN p[k] = '' AND k > 1 THEN variant ELSE p[k] END, '[A-Za-z0-9]$') AND NOT regexp_matches(CASE WHEN p[k + 1] = '' AND k + 1 < len(p) THEN variant ELSE p[k + 1] END, '^[A-Za-z0-9]')) """

R.add(
    "family_occurrences", lambda s, d: D.family_rows(mentions(s, d), families(s, d)),
    "WITH" + _M.removeprefix("WITH") + "SELECT family, substr(raw, start, length(variant)) AS variant, variant AS pattern, doc_id, line, start, left(trim(raw), 140) AS excerpt FROM hits",
)
R.add(
    "family_longest", lambda s, d: D.longest_hits(D.dictionary_hits(mentions(s, d), families(s, d))).select("doc_id", "line", "start", "family", "variant"),
    "WITH RECURSIVE" + _M.removeprefix("WITH") + """, taken AS (
      SELECT doc_id, line, start, family, variant, start + length(variant) AS stop FROM hits QUALIFY row_number() OVER (PARTITION BY doc_id, line ORDER BY start, length(variant) DESC, variant) = 1
      UNION ALL SELECT h.doc_id, h.line, h.start, h.family, h.variant, h.start + length(h.variant) FROM taken AS t JOIN hits AS h ON h.doc_id = t.doc_id AND h.line = t.line AND h.start >= t.stop
      QUALIFY row_number() OVER (PARTITION BY h.doc_id, h.line ORDER BY h.start, length(h.variant) DESC, h.variant) = 1)
    SELECT doc_id, line, start, family, variant FROM taken""",
)
_FIRST = r"array_join(slice(split(trim(regexp_replace(raw, '\\s+', ' ')), ' '), 1, 7), ' ')"
R.add(
    "long_form_candidates", lambda s, d: mentions(s, d).select("doc_id", "line", F.explode(D.long_form_candidates(F.expr(_FIRST))).alias("words")).select("doc_id", "line", F.array_join("words", " ").alias("form")),
    _M + f""", w AS (SELECT doc_id, line, list_filter(list_transform(string_split(trim(regexp_replace(raw, '\\s+', ' ', 'g')), ' ')[1:7], lambda x: trim(x, ',;:.()[]')), lambda x: x <> '') AS w FROM mentions),
    t AS (SELECT doc_id, line, i, w[i:] AS t FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM w)),
    f AS (SELECT doc_id, line, i, array_to_string(t, ' ') AS form FROM t WHERE lower(t[1]) NOT IN ({', '.join(f"'{x}'" for x in D.FILLERS)}) AND (len(t) >= 2 OR contains(t[1], '-'))
      AND lower(t[1]) NOT IN ({', '.join(f"'{x}'" for x in D.GENERIC_HEADS)}) AND NOT regexp_matches(array_to_string(t, ' '), '[\\\\{{}}(]'))
    SELECT doc_id, line, form FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, line, lower(form) ORDER BY i) = 1""",
)
R.add(
    "long_form_residues", lambda s, d: D.long_form_residues(mentions(s, d), forms(s, d)).groupBy("doc_id", "section", "token", "line").agg(F.count("*").alias("n")),
    _M + rf""", forms AS (SELECT DISTINCT {_TOKEN} AS token, p_name AS variant FROM part), plain AS (SELECT doc_id, section, line, regexp_replace(lower(raw), '[\s\-‐‑‒–—]+', ' ', 'g') AS raw FROM mentions),
    c AS (SELECT *, string_split(raw, variant) AS p FROM plain JOIN forms ON contains(raw, variant)), e AS (SELECT *, unnest(range(1, len(p))) AS k FROM c),
    s AS (SELECT *, (list_sum(list_transform(p[1:k], lambda x: length(x))) + (k - 1) * length(variant))::BIGINT AS start FROM e),
    h AS (SELECT doc_id, section, token, line, start, left(raw, start) AS before, substr(raw, start + length(variant) + 1) AS after FROM s),
    b AS (SELECT *, regexp_replace(after, '^(es|s)', '') AS rest FROM h WHERE NOT regexp_matches(before, '[a-z0-9]$') AND regexp_matches(after, '^(s|es)?($|[^a-z0-9])')),
    q AS (SELECT *, CASE WHEN regexp_matches(after, '^(es|s)($|[^a-z0-9])') THEN rest ELSE after END AS then_ FROM b WHERE NOT ((length(before) - length(replace(before, '"', ''))) % 2 = 1 AND contains(after, '"'))),
    d AS (SELECT *, upper(regexp_extract(then_, '^ ?\( ?([a-z0-9]+) ?[),;]', 1)) AS defined FROM q),
    u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section, token ORDER BY line, start) AS use FROM d WHERE defined = token OR defined NOT IN (SELECT token FROM forms))
    SELECT doc_id, section, token, line, count(*) AS n FROM u WHERE use > 1 AND defined <> token GROUP BY 1, 2, 3, 4""",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
