"""Queries of free slots and unique names: the findings of each customer are its orders."""

from __future__ import annotations

from inkmill.operators import slots as L
from inkmill.plans.base import Registry, select_from

R = Registry()

_ID = "CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'F-' || CAST(o_orderkey % 7 AS STRING) WHEN 1 THEN NULL WHEN 2 THEN 'X-' || CAST(899 + o_orderkey % 13 AS STRING) WHEN 3 THEN 'X-' || CAST(900 + o_orderkey % 9 AS STRING) ELSE ' X-9001' END"
_ROWS = f"SELECT CAST(o_custkey AS BIGINT) AS grp, CAST(o_orderkey AS BIGINT) AS ord, {_ID} AS id FROM orders"
_HELD = "SELECT CAST(c_custkey AS BIGINT) AS grp, 'X-' || CAST(901 + c_custkey % 6 AS STRING) AS id FROM customer UNION ALL SELECT CAST(c_custkey AS BIGINT), 'X-903' FROM customer WHERE c_nationkey % 2 = 0"
_RUNS = """SELECT CAST(o_custkey AS BIGINT) AS book, CAST(o_orderkey AS BIGINT) AS ord, CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN o_orderpriority WHEN 1 THEN lower(o_orderpriority)
 WHEN 2 THEN 'a [long] name of the sheet: ' || o_orderpriority ELSE NULL END AS stem, CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN 'all' WHEN 1 THEN '0' || CAST(o_orderkey % 2 AS STRING) ELSE 'r/' || o_orderstatus END AS round FROM orders"""


R.add(
    "remapped_ids", lambda s, d: L.remapped_ids(select_from(s, d, _ROWS, "orders"), select_from(s, d, _HELD, "customer")),
    f"""WITH RECURSIVE rows AS (SELECT *, trim(coalesce(id, '')) AS own, row_number() OVER (PARTITION BY grp ORDER BY ord) AS n FROM ({_ROWS})), held AS (SELECT grp, list(id) AS used FROM ({_HELD}) GROUP BY grp),
    slots AS (SELECT list_transform(range(901, 1000), lambda k: 'X-' || k) || list_transform(range(9001, 10000), lambda k: 'X-' || k) AS all_slots),
    walk AS (SELECT grp, 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::VARCHAR AS id, NULL::VARCHAR AS new_id, coalesce(used, []) AS used FROM (SELECT DISTINCT grp FROM rows) LEFT JOIN held USING (grp)
      UNION ALL SELECT grp, n, ord, id, new_id, list_append(used, new_id) FROM (SELECT r.grp, r.n, r.ord, r.id, w.used,
        CASE WHEN regexp_full_match(r.own, 'X-9[0-9]{{2,3}}') AND NOT list_contains(w.used, r.own) THEN r.own ELSE list_filter(all_slots, lambda x: NOT list_contains(w.used, x))[1] END AS new_id
        FROM walk AS w JOIN rows AS r ON r.grp = w.grp AND r.n = w.n + 1, slots))
    SELECT grp, ord, id, new_id FROM walk WHERE n > 0""",
)
_CLEAN = r"trim(regexp_replace(coalesce({}, ''), '[\[\]:*?/\\]', '_', 'g'))"
R.add(
    "sheet_tabs", lambda s, d: L.sheet_tabs(select_from(s, d, _RUNS, "orders")),
    f"""WITH RECURSIVE runs AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY ord) AS n, CASE WHEN {_CLEAN.format('stem')} = '' THEN 'run' ELSE {_CLEAN.format('stem')} END AS base,
      left(CASE WHEN regexp_full_match(round, '[0-9]+') THEN '_r' || round::INT ELSE '_' || {_CLEAN.format('round')} END, 31) AS suffix FROM ({_RUNS})),
    walk AS (SELECT DISTINCT book, 0::BIGINT AS n, NULL::BIGINT AS ord, NULL::VARCHAR AS stem, NULL::VARCHAR AS round, NULL::VARCHAR AS tab, []::VARCHAR[] AS used FROM runs
      UNION ALL SELECT book, n, ord, stem, round, tab, list_append(used, lower(tab)) FROM (SELECT r.book, r.n, r.ord, r.stem, r.round, w.used,
        list_filter(list_prepend(left(left(r.base, 31 - length(r.suffix)) || r.suffix, 31), list_transform(range(2, len(w.used) + 3), lambda i: left(left(r.base, greatest(31 - length(r.suffix) - length('~' || i), 1)) || '~' || i || r.suffix, 31))),
          lambda t: NOT list_contains(w.used, lower(t)))[1] AS tab FROM walk AS w JOIN runs AS r ON r.book = w.book AND r.n = w.n + 1))
    SELECT book, ord, stem, round, tab FROM walk WHERE n > 0""",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
