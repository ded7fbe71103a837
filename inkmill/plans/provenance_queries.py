"""Queries of provenance: `part` and `customer` as the tables a text comes with, and sentences written
from every order about them, some true, some about another row, some only near a number."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import provenance as V
from inkmill.plans.base import Registry, table

R = Registry()

_PAIR = "(SELECT o.*, a.p_name AS a_name, a.p_size AS a_size, a.p_retailprice AS a_price, b.p_name AS b_name, b.p_type AS b_type FROM orders o JOIN part a ON a.p_partkey = o.o_orderkey % {n} JOIN part b ON b.p_partkey = o.o_custkey % {n}) x"
_NUMBER = """CASE CAST(o_orderkey % 6 AS INT) WHEN 0 THEN CAST(a_size AS STRING) WHEN 1 THEN CAST(a_size + 40 AS STRING) WHEN 2 THEN CAST(o_custkey % 60 AS STRING) || '.'
 WHEN 3 THEN CAST(CAST(floor(a_price) AS BIGINT) AS STRING) WHEN 4 THEN CAST(a_size AS STRING) ELSE '1' END"""
_SENTENCE = """CASE CAST((o_orderkey + o_custkey) % 8 AS INT)
 WHEN 0 THEN 'The size of the ' || a_name || ' was ' || number || '.'
 WHEN 1 THEN 'The size of one ' || b_name || ' reached ' || number || ' units.'
 WHEN 2 THEN 'The mean part sizes were ' || number
 WHEN 3 THEN 'As shown before [' || number || '] the size of parts differs.'
 WHEN 4 THEN 'Retail prices of ' || split_part(a_name, ' ', 2) || ' went to ' || number
 WHEN 5 THEN '' WHEN 6 THEN 'Nothing ties ' || number || ' down.' ELSE 'Part sizes go up to ' || number END"""
_LEDGER = f"SELECT CAST(o_orderkey AS BIGINT) AS id, number, CASE CAST(o_orderkey % 11 AS INT) WHEN 0 THEN 'heading' WHEN 1 THEN ' Refs' ELSE 'body' END AS kind, {_SENTENCE} AS sentence FROM (SELECT *, {_NUMBER} AS number FROM {_PAIR}) y"
_CLAIM = """CASE CAST(o_orderkey % 7 AS INT)
 WHEN 0 THEN 'For ' || a_name || ' goods the ' || b_type || ' method could not be run. Later the ' || lower(b_type) || ' run was excluded.'
 WHEN 1 THEN 'Samples of ' || a_name || ' were excluded before ' || b_type || ' was applied.'
 WHEN 2 THEN 'ECONOMY, PROMO and ' || b_type || ' produced   no output for the ' || b_name || ', large, small and STANDARD.'
 WHEN 3 THEN b_type || 's were not run' WHEN 4 THEN 'Everything was run on ' || a_name
 WHEN 5 THEN 'The ' || b_name || ' was not evaluated; ' || repeat('so it goes on ', 20) || ' ' || a_name || ' did not produce output, and small is not included' ELSE '' END"""
_CLAIMS = f"SELECT CAST(o_custkey % 40 AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS line, {_CLAIM} AS raw FROM {_PAIR}"
_GOODS = """SELECT 'part_sizes.csv' AS file, CAST(p_partkey AS BIGINT) AS row, p_name AS label, 'Size' AS column, 1 AS place, CAST(p_size AS STRING) AS cell FROM part
 UNION ALL SELECT 'part_sizes.csv', p_partkey, p_name, 'RetailPrice', 2, CAST(CAST(floor(p_retailprice) AS BIGINT) AS STRING) || CASE WHEN p_partkey = 7 THEN '%' ELSE '' END FROM part
 UNION ALL SELECT 'bolts.csv', p_partkey, '', 'units', 1, CAST(p_size AS STRING) FROM part WHERE p_name LIKE '% bolt'"""
_RUNS = """SELECT 'runs.csv' AS file, CAST(p_partkey AS BIGINT) AS row, '' AS label, 'Method' AS column, 1 AS place, p_type AS cell FROM part
 UNION ALL SELECT 'runs.csv', p_partkey, '', 'hue', 2, split_part(p_name, ' ', 1) FROM part UNION ALL SELECT 'runs.csv', p_partkey, '', 'form', 3, split_part(p_name, ' ', 2) FROM part
 UNION ALL SELECT 'late.csv', p_partkey, '', 'tool', 1, p_type FROM part WHERE p_type IN ('PROMO', 'SMALL') UNION ALL SELECT 'late.csv', p_partkey, '', 'id', 2, CAST(p_partkey AS STRING) FROM part"""


def _sql(s: SparkSession, d: str, text: str) -> DataFrame:
    part, orders = table(s, d, "part"), table(s, d, "orders")
    return s.sql(text.replace("FROM part", "FROM {part}").replace("JOIN part", "JOIN {part}").replace("FROM orders", "FROM {orders}").replace("{n}", str(part.count())), part=part, orders=orders) if "orders" in text else s.sql(text.replace("FROM part", "FROM {part}"), part=part)


def _tokens(text: str) -> str:
    """DuckDB SQL of context_tokens, as a list."""
    low = f"regexp_replace(regexp_replace({text}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')"
    stem = (
        "CASE WHEN length(t) > 4 AND t LIKE '%ies' THEN left(t, length(t) - 3) || 'y' WHEN length(t) > 4 AND t LIKE '%es' AND NOT regexp_matches(t, '(ses|ches|shes|xes)$') THEN left(t, length(t) - 2) "
        "WHEN length(t) > 3 AND t LIKE '%s' AND t NOT LIKE '%ss' THEN left(t, length(t) - 1) ELSE t END"
    )
    stop = ", ".join(f"'{w}'" for w in V.CONTEXT_STOPWORDS)
    return f"list_distinct(list_filter(list_transform(string_split(lower({low}), ' '), lambda t: {stem}), lambda t: length(t) >= 3 AND t NOT IN ({stop}) AND NOT regexp_full_match(t, '[0-9]+')))"


_D = lambda text: text.replace("{n}", "(SELECT count(*) FROM part)")
R.add(
    "number_provenance", lambda s, d: V.provenance(_sql(s, d, _LEDGER), _sql(s, d, _GOODS)),
    f"""WITH ledger AS ({_D(_LEDGER)}), cells AS ({_GOODS}), n AS (SELECT *, TRY_CAST(cell AS DOUBLE) AS v FROM cells),
    hits AS (SELECT v AS key, file, "column", 'cell' AS kind, label, place, 0 AS rank, row FROM n WHERE v IS NOT NULL
      UNION ALL SELECT unnest([sum(v), min(v), max(v)]), file, "column", unnest(['sum', 'min', 'max']), '', place, unnest([1, 2, 3]), 0 FROM n GROUP BY file, "column", place HAVING count(v) >= 3 AND count(*) = count(v)),
    l AS (SELECT id, number, sentence, CAST(rtrim(number, '.') AS DOUBLE) AS key, {_tokens('sentence')} AS tokens FROM ledger WHERE kind = 'body'),
    labels AS (SELECT file, label, {_tokens('label')} AS words FROM (SELECT DISTINCT file, label FROM cells WHERE label <> '')),
    sets AS (SELECT DISTINCT tokens FROM l), overlap AS (SELECT tokens, file, label, len(list_intersect(tokens, words)) AS n FROM sets, labels),
    best AS (SELECT tokens, file, max(n) AS most FROM overlap GROUP BY 1, 2),
    pairs AS (SELECT l.id, l.number, h.*, o.n, b.most FROM l JOIN hits AS h ON h.key = l.key LEFT JOIN best AS b ON b.tokens = l.tokens AND b.file = h.file LEFT JOIN overlap AS o ON o.tokens = l.tokens AND o.file = h.file AND o.label = h.label
      WHERE (sentence = '' AND h.kind <> 'cell') OR (sentence <> '' AND NOT contains(sentence, '[' || number || ']') AND len(list_intersect(l.tokens, list_concat({_tokens('h."column"')}, {_tokens('h.file')}))) > 0
        AND CASE WHEN h.kind <> 'cell' THEN NOT regexp_matches(sentence, '(?i)\\b({'|'.join(V.ESTIMATORS)})\\b') ELSE h.label = '' OR coalesce(b.most, 0) = 0 OR o.n = b.most END)),
    first AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY id ORDER BY file, place, rank, row) = 1)
    SELECT ledger.id, ledger.number, file, "column", first.kind AS proof, label FROM ledger LEFT JOIN first USING (id)""",
)
R.add(
    "negative_claims", lambda s, d: V.negative_claims(_sql(s, d, _CLAIMS), _sql(s, d, _RUNS)),
    f"""WITH texts AS ({_D(_CLAIMS)}), cells AS ({_RUNS}), s AS (SELECT doc_id, line, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS s FROM texts),
    d AS (SELECT *, regexp_extract_all(s, '{V.DENIAL}') AS said, regexp_split_to_array(s, '{V.DENIAL}') AS kept FROM s WHERE regexp_matches(s, '{V.DENIAL}')),
    e AS (SELECT doc_id, line, s, i - 1 AS nth, said[i] AS phrase, (list_sum(list_transform(kept[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(said[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM (SELECT *, unnest(range(1, len(said) + 1)) AS i FROM d)),
    claims AS (SELECT doc_id, line, nth, phrase, substr(s, greatest(start - 200, 0) + 1, start + length(phrase) + 200 - greatest(start - 200, 0)) AS claim, start - greatest(start - 200, 0) AS begins FROM e),
    vals AS (SELECT file, "column", cell, count(*) AS n FROM cells GROUP BY 1, 2, 3),
    cols AS (SELECT file, "column", count(*) <= 40 AND count(*) < sum(n) AND max(length(cell)) <= 24 AS cat, regexp_matches("column", '{V.TOOL_HEADER}') AS tool FROM vals GROUP BY 1, 2),
    tok AS (SELECT lower(cell) AS token, tool, 'value ''' || cell || ''' of column ''' || "column" || ''' in ' || file AS source,
      coalesce((SELECT list(lower(w.cell)) FROM vals AS w JOIN cols AS k USING (file, "column") WHERE w.file = v.file AND k."column" <> v."column" AND k.cat AND length(w.cell) >= 2), []) AS context
      FROM vals AS v JOIN cols USING (file, "column") WHERE (cat OR tool) AND regexp_matches(cell, '{V.TABLE_TOKEN}')),
    m AS (SELECT c.*, t.*, len(list_filter(context, lambda x: regexp_matches(lower(claim), '(^|[^a-z0-9])' || x || '($|[^a-z0-9])'))) = 0 AS off_context FROM claims AS c JOIN tok AS t
      ON regexp_matches(lower(left(claim, begins)), '(^|[^a-z0-9])' || token || '($|[^a-z0-9])') WHERE tool OR NOT regexp_matches(phrase, '{V.METHOD_DENIAL}')),
    u AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY doc_id, token, source, left(claim, 80) ORDER BY line, nth) = 1),
    t AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY doc_id, line, nth, token ORDER BY off_context, NOT tool, token, source) <= 2),
    p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, line, nth ORDER BY off_context, NOT tool, token, source)::INT AS place FROM t)
    SELECT doc_id, line, nth::INT AS nth, token, source, place FROM p WHERE place <= 4""",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
