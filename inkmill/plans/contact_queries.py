"""Queries of contact facts and printed statistics: the addresses in `documents` before and after a
revision made by rule, those of `pages` as evidence; tables of p-values written from every order."""

from __future__ import annotations

from inkmill.operators import contacts as K
from inkmill.plans.base import Registry, select_from
from inkmill.plans.paper_queries import _quoted, like
from inkmill.sources.tables import AFTER_QUOTE, CLOSED_ROW, CLOSES_QUOTE, MARKER, PROMPT, dump_blocks

R = Registry()

_MAIL = "'user' || CAST(doc_id % 97 AS STRING) || '@' || CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN 'lab.org' WHEN 1 THEN 'Example.com' ELSE 'uni.edu' END"
_BEFORE = f"SELECT source AS package, text || ' ' || {_MAIL} AS text FROM documents WHERE doc_id % 4 > 0"
_AFTER = f"SELECT source AS package, replace(text, '.com', '.net') || ' ' || replace({_MAIL}, '@u', '@new.u') || CASE WHEN doc_id % 50 = 7 THEN ' fixed' || CAST(doc_id AS STRING) || '@lab.org' ELSE '' END AS text FROM documents WHERE doc_id % 4 < 3"
_EVIDENCE = "SELECT 'write to user' || CAST(page_id % 200 AS STRING) || '@new.uni.edu or ' || url AS text FROM pages"
_VERIFIED = "SELECT source AS package, CASE WHEN doc_id % 2 = 0 THEN 'User' || CAST(doc_id % 97 AS STRING) || '@lab.org' END AS old, 'fixed' || CAST(doc_id AS STRING) || '@lab.org' AS new FROM documents WHERE doc_id % 100 = 57 OR doc_id % 100 = 8"


def _found(name: str, text: str) -> str:
    return f"{name} AS (SELECT DISTINCT package, unnest(regexp_extract_all(lower(text), {_quoted(K.ADDRESS)})) AS address FROM ({text}))"


R.add(
    "address_changes", lambda s, d: K.address_changes(select_from(s, d, _BEFORE, "documents"), select_from(s, d, _AFTER, "documents"), select_from(s, d, _EVIDENCE, "pages"), select_from(s, d, _VERIFIED, "documents")),
    f"""WITH {_found('old', _BEFORE)}, {_found('new', _AFTER)}, {_found('known', _EVIDENCE.replace("SELECT ", "SELECT '' AS package, ", 1))}, v AS (SELECT package, lower(trim(old)) AS old, lower(trim(new)) AS new FROM ({_VERIFIED}))
    SELECT package, address, 'added' AS change, 'error' AS level FROM new AS a WHERE NOT EXISTS (SELECT 1 FROM old AS o WHERE o.package = a.package AND o.address = a.address) AND address NOT IN (SELECT address FROM known)
      AND NOT EXISTS (SELECT 1 FROM v WHERE v.package = a.package AND v.new = a.address)
    UNION ALL SELECT package, address, 'removed', 'warning' FROM old AS a WHERE NOT EXISTS (SELECT 1 FROM new AS n WHERE n.package = a.package AND n.address = a.address) AND NOT {like(K.PLACEHOLDER_ADDRESS, 'address')}
      AND NOT EXISTS (SELECT 1 FROM v JOIN new AS n ON n.package = v.package AND n.address = v.new WHERE v.package = a.package AND v.old = a.address)
    UNION ALL SELECT package, address, 'superseded', 'warning' FROM new AS a WHERE EXISTS (SELECT 1 FROM v WHERE v.package = a.package AND v.old = a.address AND v.old <> v.new)""",
)
_ROW = """CASE WHEN o_orderkey % 10 = 0 THEN 'Holm over a ' || CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'single pooled family.' WHEN 1 THEN 'single  pooled family, one ' || CAST(o_custkey % 30 AS STRING) || '-test family' ELSE 'family of 12' END
 WHEN o_orderkey % 3 = 0 THEN 'Method & 10 & ' || CAST(o_custkey % 24 AS STRING) || ' & ' || chr(92) || 'textbf{' || CAST(o_orderkey % 9 + 1 AS STRING) || '.5 ' || chr(92) || 'times 10^{-' || CAST(o_custkey % 7 AS STRING) || '}'
 WHEN o_orderkey % 3 = 1 THEN 'Method A none ' || CAST(o_orderkey % 25 AS STRING) || ' 0.0' || CAST(o_custkey % 90 AS STRING) || ' 1.00'
 ELSE 'Method B 10 ' || CAST(o_custkey % 20 AS STRING) || ' 1.8x10-' || CAST(o_orderkey % 6 AS STRING) || ' end' END"""
_TABLES = f"SELECT CAST(o_custkey % 400 AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS line, {_ROW} AS raw FROM orders"
_P = r"TRY_CAST(regexp_replace(regexp_replace(replace(replace(replace({0}, '\times', 'x'), '−', '-'), '×', 'x'), '[{{}}\s]', '', 'g'), 'x10\^?', 'e') AS DOUBLE)"
R.add(
    "floor_violations", lambda s, d: K.floor_violations(select_from(s, d, _TABLES, "orders")),
    f"""WITH lines AS ({_TABLES}), says AS (SELECT doc_id FROM lines GROUP BY 1 HAVING bool_or({like(K.POOLED, 'raw')}) AND bool_or({like(K.ADJUSTED, 'raw')})),
    l AS (SELECT * FROM lines WHERE doc_id IN (SELECT doc_id FROM says)),
    stated AS (SELECT doc_id, coalesce(first(TRY_CAST(regexp_extract(raw, {_quoted(K.FAMILY_OF_TESTS)}, 1) AS INT) ORDER BY line) FILTER ({like(K.FAMILY_OF_TESTS, 'raw')}), first(TRY_CAST(regexp_extract(raw, {_quoted(K.FAMILY_OF)}, 1) AS INT) ORDER BY line) FILTER ({like(K.FAMILY_OF, 'raw')})) AS stated FROM l GROUP BY 1),
    m AS (SELECT doc_id, line, CASE WHEN {like(K.PRINTED_ROW, 'raw')} THEN regexp_extract(raw, {_quoted(K.PRINTED_ROW)}, ['n', 'p']) WHEN {like(K.LATEX_ROW, 'raw')} THEN regexp_extract(raw, {_quoted(K.LATEX_ROW)}, ['n', 'p']) END AS m FROM l),
    r AS (SELECT doc_id, line, TRY_CAST(m.n AS INT) AS n, {_P.format('m.p')} AS p FROM m WHERE m IS NOT NULL),
    k AS (SELECT * FROM r WHERE p IS NOT NULL AND n >= 5), f AS (SELECT doc_id, coalesce(stated, count(*))::BIGINT AS family FROM k JOIN stated USING (doc_id) GROUP BY doc_id, stated HAVING count(*) >= 5)
    SELECT doc_id, line, n, p, family FROM k JOIN f USING (doc_id) WHERE p < family * 2 / pow(2.0, n) - greatest(1e-12, family * 2 / pow(2.0, n) * 0.02)""",
)
_LISTING = """SELECT CAST(o_custkey % 500 AS BIGINT) AS doc_id, CAST(o_orderkey AS BIGINT) AS line, CASE CAST((o_orderkey + o_custkey % 5) % 9 AS INT) WHEN 0 THEN ' ==> round' || CAST(o_custkey % 4 AS STRING) || '.csv <==' WHEN 1 THEN 'member,opponent_id,reason'
 WHEN 2 THEN 'v1, "open ' || o_orderpriority WHEN 3 THEN o_orderpriority || '",v2' WHEN 4 THEN '' WHEN 5 THEN 'prompt$' WHEN 6 THEN '"q""q", 5,a"b' WHEN 7 THEN '"a"",' ELSE 'v3,"x",' || CAST(o_orderkey AS STRING) END AS raw FROM orders"""
R.add(
    "dump_blocks", lambda s, d: dump_blocks(select_from(s, d, _LISTING, "orders")).select("doc_id", "path", "block", "nth", "raw"),
    f"""WITH RECURSIVE l AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY line) AS n, {like(MARKER, 'raw')} AS marker, CASE WHEN {like(CLOSED_ROW, 'raw')} THEN 0 ELSE 1 END AS outside, regexp_extract(raw, {_quoted(AFTER_QUOTE)}, 1) AS rest FROM ({_LISTING})),
    e AS (SELECT *, CASE WHEN NOT {like(CLOSES_QUOTE, 'raw')} THEN 1 WHEN NOT contains(rest, ',') THEN 0 WHEN {like(CLOSED_ROW, "regexp_extract(rest, '^[^,]*,(.*)$', 1)")} THEN 0 ELSE 1 END AS inside FROM l),
    w AS (SELECT DISTINCT doc_id, 0::BIGINT AS n, 2 AS before, 2 AS after FROM l UNION ALL SELECT e.doc_id, e.n, w.after, CASE WHEN w.after = 1 THEN inside WHEN marker THEN 0 WHEN w.after = 0 THEN outside ELSE 2 END FROM w JOIN e ON e.doc_id = w.doc_id AND e.n = w.n + 1),
    h AS (SELECT e.doc_id, e.line, raw, before, CASE WHEN before <> 1 AND marker THEN regexp_extract(raw, {_quoted(MARKER)}, 1) END AS head FROM e JOIN w USING (doc_id, n)),
    p AS (SELECT *, last_value(head IGNORE NULLS) OVER o AS path, count(head) OVER o AS block FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY line))
    SELECT doc_id, path, block, row_number() OVER (PARTITION BY doc_id, block ORDER BY line)::INT AS nth, raw FROM p WHERE path IS NOT NULL AND head IS NULL AND (before = 1 OR (trim(raw) <> '' AND NOT (NOT contains(raw, ',') AND {like(PROMPT, 'raw')})))""",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
