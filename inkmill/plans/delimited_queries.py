"""Queries over the tables that stand in the texts of `documents` (rows of bars, and any text whose first
line has commas). No field there starts with a quote; quotes are tested against a library's reader."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkmill.operators import delimited as D
from inkmill.plans.base import Registry, table

R = Registry()


def texts(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text")


_T = r"""WITH l AS (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(13)) <> '') AS l FROM documents),
 d AS (SELECT doc_id, l, trim(l[1]) AS head, CASE WHEN contains(l[1], chr(9)) THEN chr(9) WHEN length(l[1]) - length(replace(l[1], '|', '')) >= 2 THEN '|' WHEN contains(l[1], ',') THEN ',' END AS delimiter FROM l WHERE len(l) >= 3),
 f AS (SELECT *, list_transform(l, lambda x: list_transform(string_split(x, delimiter), lambda c: regexp_replace(c, '^\s+|\s+$', '', 'g'))) AS f FROM d WHERE delimiter IS NOT NULL),
 e AS (SELECT *, list_transform(f, lambda r: CASE WHEN delimiter = '|' AND starts_with(head, '|') AND r[1] = '' THEN r[2:] ELSE r END) AS g FROM f),
 r AS (SELECT *, list_transform(g, lambda r: CASE WHEN delimiter = '|' AND ends_with(head, '|') AND r[-1] = '' THEN r[:-2] ELSE r END) AS records FROM e),
 b AS (SELECT doc_id, delimiter, records[1] AS header, CASE WHEN delimiter = '|' AND len(list_filter(records[2], lambda c: NOT regexp_full_match(c, ':?-{2,}:?'))) = 0 THEN records[3:] ELSE records[2:] END AS body FROM r),
 tables AS (SELECT * FROM b WHERE len(header) >= 2 AND len(body) > 0) """

R.add(
    "delimited_tables", lambda s, d: D.tables_of(texts(s, d)).selectExpr("doc_id", "delimiter", "CAST(size(header) AS BIGINT) AS n_columns", "CAST(size(body) AS BIGINT) AS n_rows", "round(agreement, 9) AS agreement"),
    _T + "SELECT doc_id, delimiter, len(header) AS n_columns, len(body) AS n_rows, round(len(list_filter(body, lambda r: len(r) = len(header))) / len(body), 9) AS agreement FROM tables",
)
R.add(
    "delimited_cells", lambda s, d: D.table_cells(D.tables_of(texts(s, d))),
    _T + """, rows AS (SELECT doc_id, header, unnest(range(1, len(body) + 1)) AS row, unnest(body) AS fields FROM tables),
    cells AS (SELECT doc_id, header, row, fields, unnest(range(1, least(len(fields), len(header)) + 1)) AS place FROM rows)
    SELECT doc_id, row::INT AS row, fields[1] AS label, place::INT AS place, header[place] AS "column", fields[place] AS cell FROM cells""",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
