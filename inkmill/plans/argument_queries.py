"""Queries over arguments and counts in words: lines of `documents` with sentences put between them by
rule, whose words come from the lines themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmill.operators import counts as N
from inkmill.operators import logic as A
from inkmill.plans.base import Registry
from inkmill.plans.paper_queries import like
from inkmill.plans.prose_queries import _SPLIT
from inkmill.plans.text_queries import _LINES, lines

R = Registry()

_WORD = "split_part(raw, ' ', {n})"
_ARGUED = f"""CASE CAST((doc_id * 3 + line * line * 5 + line) % 17 AS INT)
 WHEN 0 THEN 'We test whether ' || {_WORD.format(n=2)} || ' holds because it does. ' || raw
 WHEN 1 THEN 'It is not so that ' || {_WORD.format(n=1)} || ' will be flagged as one; they will be flagged as two. ' || raw
 WHEN 2 THEN raw || ' They will be flagged as ' || {_WORD.format(n=1)} || '.'
 WHEN 3 THEN 'We therefore go on. ' || raw
 WHEN 4 THEN raw || ' and the ' || lower({_WORD.format(n=2)}) || ' described above'
 WHEN 5 THEN 'See the gizmo described above, and the gizmo  described above-mentioned'
 WHEN 6 THEN 'We expected ' || {_WORD.format(n=1)} || ', which implies ' || {_WORD.format(n=2)}
 WHEN 7 THEN 'This study has the following limitations. First, ' || raw
 WHEN 8 THEN 'Approximately any purity floor is metric-dependent. No metric-dependent one, though.'
 WHEN 9 THEN 'Short' || CASE WHEN doc_id % 2 = 0 THEN ' because.' ELSE '.' END
 WHEN 10 THEN '' WHEN 11 THEN 'A Gizmo-like ' || {_WORD.format(n=3)} WHEN 12 THEN 'We did not expect it, which implies nothing'
 ELSE raw END"""


def argued(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).selectExpr("doc_id", "CAST(line AS BIGINT) AS line", f"{_ARGUED} AS raw")


def _affirmed(text: str, pattern: str) -> str:
    said = pattern.replace("'", "''")
    return f"({like(pattern, text)} AND NOT {like(A.NEGATION, f'''regexp_split_to_array(regexp_split_to_array({text}, '{said}')[1], '[.;:!?]')[-1]''')})"


_ABOVE = r"(?i)\bthe\s+([a-z][a-z-]{3,})\s+described\s+above\b"
_SHAPES = " UNION ALL ".join(
    f"SELECT doc_id, line, '{rule}' AS rule, {i} AS place, first(left(trim(sentence), 220) ORDER BY nth) AS evidence FROM sents WHERE {_affirmed('trim(sentence)', p)} GROUP BY doc_id, line" for i, (rule, p) in enumerate(A.SHAPES, 1)
)
R.add(
    "logic_rows", lambda s, d: A.logic_rows(argued(s, d)),
    _LINES + f""", argued AS (SELECT doc_id, line::BIGINT AS line, {_ARGUED} AS raw FROM lines), t AS (SELECT *, lag(raw) OVER (PARTITION BY doc_id ORDER BY line) AS before FROM argued),
    sents AS (SELECT doc_id, line, unnest(range(1, len(p) + 1)) AS nth, unnest(p) AS sentence FROM (SELECT doc_id, line, {_SPLIT} AS p FROM argued)),
    m AS (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM (SELECT doc_id, line, raw, regexp_extract_all(raw, '{_ABOVE}', 1) AS terms, regexp_extract_all(raw, '{_ABOVE}') AS said, regexp_split_to_array(raw, '{_ABOVE}') AS kept FROM argued)),
    n AS (SELECT doc_id, line, lower(terms[i]) AS term, left(raw, (list_sum(list_transform(kept[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(said[1:i - 1], lambda x: length(x))), 0))::BIGINT) AS prefix FROM m)
    {_SHAPES}
    UNION ALL SELECT doc_id, line, 'T9L', 9, left(trim(raw), 220) FROM argued WHERE {_affirmed('raw', A.EXPECTATION)}
    UNION ALL SELECT doc_id, line, 'T9L', 10, left(trim(raw), 220) FROM argued WHERE {like(A.LIMITATIONS, 'raw')}
    UNION ALL SELECT doc_id, line, 'T9L', 11, left(trim(raw), 220) FROM t WHERE {like(A.THEREFORE, 'raw')} AND before IS NOT NULL AND len(regexp_extract_all(before, '[^\\s\\x0B]+')) <= 10 AND NOT {like(A.CAUSAL, 'before')}
    UNION ALL SELECT doc_id, line, 'T9A', 12, term FROM n WHERE NOT regexp_matches(prefix, '(?i)\\b' || term || '\\b')
      AND NOT EXISTS (SELECT 1 FROM argued AS e WHERE e.doc_id = n.doc_id AND e.line < n.line AND regexp_matches(e.raw, '(?i)\\b' || n.term || '\\b'))""",
)
_COUNTED = f"""CASE CAST((doc_id + line * 7) % 11 AS INT)
 WHEN 0 THEN 'We saw twenty-one ' || {_WORD.format(n=1)} || ' patients and one of the ' || {_WORD.format(n=2)}
 WHEN 1 THEN 'Run two had one hundred and five cells; three and five donors ' || raw
 WHEN 2 THEN 'Four of the five ' || {_WORD.format(n=1)} || ', one of them, and two million  reads'
 WHEN 3 THEN raw || ' one row per sample, threefold, six percent' WHEN 4 THEN 'the one caller, a hundred analyses, at one point'
 WHEN 5 THEN {_WORD.format(n=1)} || ' seven newly ' || lower({_WORD.format(n=2)}) || 's' ELSE raw END"""
R.add("spelled_counts", lambda s, d: N.spelled_counts(lines(s, d).selectExpr("doc_id", "CAST(line AS BIGINT) AS line", f"{_COUNTED} AS raw")))
QUERIES, ORACLE_SQL = R.queries, R.sql
