"""Queries over stated quantities, identifiers and locations. The tables' prose states none, so lines
are written from the columns of `orders`, every row of it; both engines read the same expression."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import claims as C
from inkmill.operators import fixed
from inkmill.operators import reported as V
from inkmill.operators import scores as S
from inkmill.operators import text as T
from inkmill.operators.census import census
from inkmill.plans.base import Registry, table
from inkmill.plans.census_queries import DEFECTS, defect_rows
from inkmill.plans.score_queries import ROWS, score_rows

R = Registry()

#: One line an order, in SQL that both engines read.
_CLAIM = """'In ' || o_orderstatus || ' we saw p ' || CASE CAST(o_orderkey % 3 AS INT) WHEN 0 THEN '=' WHEN 1 THEN '<' ELSE '>' END
 || ' 0.0' || CAST(o_orderkey % 7 + 1 AS STRING) || CASE WHEN o_custkey % 2 = 0 THEN '0' ELSE '' END || ', n = '
 || CASE WHEN o_custkey % 3 = 0 THEN '12,' || lpad(CAST(o_orderkey % 1000 AS STRING), 3, '0') ELSE CAST(12000 + o_orderkey % 1000 AS STRING) END
 || '; ' || CAST(o_orderkey % 5 AS STRING) || '.50 % and ' || CAST(o_orderkey % 4 + 1 AS STRING) || '-fold, AUC = .8' || CAST(o_orderkey % 3 AS STRING)
 || ' [Author to complete: ' || CASE CAST(o_orderkey % 8 AS INT) WHEN 0 THEN 'the DOI' WHEN 1 THEN 'zenodo doi' WHEN 2 THEN 'GEO accession' WHEN 3 THEN 'ORCID' WHEN 4 THEN 'github url'
 WHEN 5 THEN 'preprint ' WHEN 6 THEN 'consent' ELSE 'persistent identifier; archived' END || '] see '
 || CASE WHEN o_orderkey % 4 = 0 THEN 'Notes/Draft' || CAST(o_custkey % 5 AS STRING) || '.MD ' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'lines ' ELSE 'L. ' END || CAST(o_orderkey % 40 AS STRING)"""


def claims(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    return rows.selectExpr("CAST(o_custkey % 200 AS BIGINT) AS doc_id", "CAST(o_orderkey AS BIGINT) AS line", f"{_CLAIM} AS raw")


_CLAIMS = f"WITH lines AS (SELECT (o_custkey % 200)::BIGINT AS doc_id, o_orderkey::BIGINT AS line, {_CLAIM} AS raw FROM orders) "
_METRICS = (
    _CLAIMS
    + ", raw_metrics AS ("
    + " UNION ALL ".join(
        f"SELECT doc_id, line, '{name}' AS label, unnest(regexp_extract_all(raw, '{pattern}', 1)) AS value FROM lines"
        for name, pattern in [
            ("p-value", r"\bp\s*([<>=]\s*[0-9.]+)"), ("n", r"\bn\s*=\s*([0-9]+,[0-9]{3}|[0-9]+)"), ("percentage", r"([0-9.]+)\s*%"),
            ("fold", r"([0-9.]+)-fold"), ("AUC", r"AUC\s*=\s*([0-9.]+)"),
        ]
    )
    + r"), found AS (SELECT doc_id, line, label, regexp_extract(value, '^[<>]') AS operator, regexp_replace(value, '[<>=,\s]', '', 'g')::DOUBLE AS number FROM raw_metrics) "
)


def _metrics(s, d):
    return C.metrics(claims(s, d))


R.add(
    "metric_inventory", lambda s, d: C.metric_inventory(_metrics(s, d)),
    _METRICS + """, r AS (SELECT *, dense_rank() OVER (PARTITION BY label, operator, number ORDER BY doc_id, line) AS nth FROM found)
    SELECT label, operator, number, count(*) AS n, count(DISTINCT doc_id) AS n_docs, string_agg(doc_id || ':' || line, ' ' ORDER BY doc_id, line) FILTER (nth <= 12) AS places FROM r GROUP BY 1, 2, 3""",
)
R.add(
    "metric_divergence", lambda s, d: C.metric_divergence(_metrics(s, d)),
    _METRICS + "SELECT doc_id, label, count(DISTINCT (operator, number)) AS n_values, min(number) AS least, max(number) AS most FROM found GROUP BY 1, 2 HAVING count(DISTINCT (operator, number)) > 1",
)
R.add(
    "metrics_across_contexts", lambda s, d: C.metric_divergence(_metrics(s, d).withColumn("context", F.lit("all")), "context").drop("context"),
    _METRICS + "SELECT label, count(DISTINCT (operator, number)) AS n_values, min(number) AS least, max(number) AS most FROM found GROUP BY 1 HAVING count(DISTINCT (operator, number)) > 1",
)
R.add(
    "metrics_of_documents", lambda s, d: C.metrics(T.lines_of(table(s, d, "documents"))).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs")),
    "WITH t AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), m AS (SELECT 'percentage' AS label, doc_id, unnest(regexp_extract_all(raw, '([0-9]+(?:\\.[0-9]+)?)[ \\t\\r\\f\\x0B]*%', 1)) AS v FROM t UNION ALL SELECT 'n', doc_id, unnest(regexp_extract_all(raw, '\\bn\\s*=\\s*([0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)', 1)) FROM t UNION ALL SELECT 'fold', doc_id, unnest(regexp_extract_all(raw, '([0-9]+(?:\\.[0-9]+)?)\\s*-?\\s*fold\\b', 1)) FROM t UNION ALL SELECT 'AUC', doc_id, unnest(regexp_extract_all(raw, '\\bAUC\\s*=\\s*([0-9]*\\.?[0-9]+)', 1)) FROM t UNION ALL SELECT 'p-value', doc_id, unnest(regexp_extract_all(raw, '(?i)\\bp\\s*((?:<=|>=|[<>=])\\s*[0-9]*\\.?[0-9]+)', 1)) FROM t) SELECT label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM m GROUP BY 1",
)
R.add(
    "number_format_mix", lambda s, d: C.number_format_mix(claims(s, d)),
    _CLAIMS + r""", t AS (SELECT doc_id, unnest(regexp_extract_all(raw, '[0-9][0-9,]*(?:\.[0-9]+)?')) AS t FROM lines), q AS (SELECT doc_id, rtrim(t, ',') AS t FROM t),
    k AS (SELECT doc_id, contains(t, ',') AS sep FROM q WHERE CASE WHEN contains(t, ',') THEN regexp_full_match(t, '[0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?') AND NOT regexp_full_match(t, '(1,9|2,0)[0-9]{2}') ELSE length(t) > 4 END)
    SELECT doc_id, count(*) FILTER (sep) AS n_separated, count(*) FILTER (NOT sep) AS n_plain FROM k GROUP BY 1 HAVING bool_or(sep) AND NOT bool_and(sep)""",
)
R.add(
    "placeholders", lambda s, d: C.placeholders(claims(s, d)),
    _CLAIMS + f""", p AS (SELECT doc_id, line, trim(unnest(regexp_extract_all(raw, '{fixed.PLACEHOLDER}', 1)), ' :;-') AS payload FROM lines)
    SELECT doc_id, line, left(payload, 200) AS payload, CASE WHEN regexp_matches(lower(payload), '{fixed.FINDABLE}') THEN 'searchable' ELSE 'author-only' END AS class,
    CASE {' '.join('WHEN ' + ' AND '.join(f"regexp_matches(lower(payload), '{p}')" for p in patterns) + f" THEN '{name}'" for name, patterns in fixed.PLACEHOLDER_KINDS)} ELSE '' END AS kind FROM p""",
)


def evidence_locations(s: SparkSession, d: str) -> DataFrame:
    line, words, doc = C.location_of(F.col("raw"))
    return claims(s, d).select(F.col("line").alias("row_id"), line.alias("at_line"), F.size(words).cast("long").alias("n_words"), doc.alias("document"))


R.add(
    "evidence_locations", evidence_locations,
    _CLAIMS + r"""SELECT line AS row_id, regexp_extract(raw, '(?:lines |L\. )([0-9]+)', 1)::BIGINT AS at_line, len(regexp_extract_all(raw, '[0-9A-Za-z]+')) AS n_words,
    nullif(lower(regexp_extract(raw, '[A-Za-z0-9/]+\.MD')), '') AS document FROM lines""",
)
R.add(
    "number_formats", lambda s, d: table(s, d, "orders").select("o_orderkey", C.formatted_number(F.floor("o_totalprice") / 8).alias("shown"), C.formatted_number(F.col("o_orderkey") % 9 * F.lit(1.5e-8)).alias("tiny")),
    r"""SELECT o_orderkey, regexp_replace(format('{:,.6f}', floor(o_totalprice) / 8), '\.?0+$', '') AS shown,
    CASE WHEN o_orderkey % 9 = 0 THEN '0' ELSE regexp_replace(format('{:.5e}', (o_orderkey % 9) * 1.5e-8::DOUBLE), '\.?0+e', 'e') END AS tiny FROM orders""",
)
_DOI = "'10.1111/gb-' || CAST(CASE WHEN o_orderkey % 3 = 0 THEN 2119 WHEN o_orderkey % 3 = 1 THEN 2019 ELSE 1919 + o_orderkey % 7 END AS STRING) || '-' || lpad(CAST(o_orderkey % 10000 AS STRING), 5, '0')"
R.add(
    "doi_year_signals", lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", f"{_DOI} AS doi").select("o_orderkey", C.doi_year_signal(F.col("doi"), F.lit("2019")).alias("token")).where("token IS NOT NULL"),
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '2119' ELSE '1919' END AS token FROM orders WHERE o_orderkey % 3 = 0 OR (o_orderkey % 3 = 2 AND o_orderkey % 7 = 0)",
)
_CHECK = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN ' fmt-T9 ' || CAST(o_orderkey % 5 AS STRING) WHEN 1 THEN 'q' || CAST(o_orderkey % 15 AS STRING) WHEN 2 THEN 'm 0' || CAST(o_orderkey % 6 AS STRING) ELSE ' J2' END"
R.add(
    "check_ids", lambda s, d: table(s, d, "orders").selectExpr(f"{_CHECK} AS raw").groupBy(C.check_id(F.col("raw")).alias("check_id")).agg(F.count("*").alias("n")),
    f"WITH k AS (SELECT upper(replace({_CHECK}, ' ', '')) AS k FROM orders) SELECT CASE WHEN k LIKE 'FMT-%' THEN 'M20' WHEN regexp_full_match(k, 'Q([1-9]|1[0-2])') THEN 'J3' ELSE k END AS check_id, count(*) AS n FROM k GROUP BY 1",
)
R.add(
    "abstentions", lambda s, d: table(s, d, "events").select("event_id", C.abstained(F.expr("slice(array(IF(event_id % 2 = 0, ' Unable', 'unable'), IF(event_id % 3 = 0, 'met', 'unable')), 1, CAST(event_id % 5 % 3 AS INT))")).alias("abstained")),
    "SELECT event_id, (event_id % 5 % 3 = 1 OR (event_id % 5 % 3 = 2 AND event_id % 3 <> 0)) AS abstained FROM events",
)
R.add(
    "selected_sessions", lambda s, d: table(s, d, "events").select("event_id", F.concat(F.lit("r"), F.col("user_id") % 4).alias("round"), "event_type", F.concat(F.lit("s"), F.col("event_id") % 50).alias("session")).where(C.selected(["r1:click", "s7", "error"], "round", "event_type", "session")),
    "SELECT event_id, 'r' || (user_id % 4) AS round, event_type, 's' || (event_id % 50) AS session FROM events WHERE (user_id % 4 = 1 AND event_type = 'click') OR event_id % 50 = 7 OR event_type = 'error'",
)


def label_resolution(s: SparkSession, d: str) -> DataFrame:
    votes = table(s, d, "events").selectExpr("event_id", "event_id % 20 AS sheet", "IF(event_id % 2 = 0, '  Option   ', 'OPTION ') || CAST(user_id % 6 AS STRING) AS opponent_label")
    labels = table(s, d, "events").selectExpr("event_id % 20 AS sheet", "'option ' || CAST(user_id % 5 AS STRING) AS label", "'v' || CAST((user_id + event_id % 20) % 5 AS STRING) AS id").distinct()
    return C.resolved_labels(votes, labels).groupBy("sheet", "id").agg(F.count("*").alias("n"))


R.add(
    "label_resolution", label_resolution,
    """WITH m AS (SELECT event_id % 20 AS sheet, user_id % 5 AS k, min('v' || ((user_id + event_id % 20) % 5)) AS id FROM events GROUP BY 1, 2)
    SELECT e.event_id % 20 AS sheet, m.id, count(*) AS n FROM events e LEFT JOIN m ON m.sheet = e.event_id % 20 AND m.k = e.user_id % 6 GROUP BY 1, 2""",
)
_NAME = "'run_' || CASE WHEN s_nationkey % 3 = 0 THEN 'a-' WHEN s_nationkey % 3 = 1 THEN 'b-' || CAST(s_suppkey % 2 AS STRING) ELSE 'c-d_1' || CAST(s_suppkey % 3 AS STRING) END || '-' || s_name"
R.add(
    "shared_prefixes", lambda s, d: C.shared_prefix(table(s, d, "supplier").selectExpr("s_nationkey", f"{_NAME} AS name"), "s_nationkey", "name"),
    f"""WITH n AS (SELECT s_nationkey, {_NAME} AS name FROM supplier), k AS (SELECT unnest(range(1, 60)) AS k),
    c AS (SELECT s_nationkey, k FROM n, k WHERE k <= length(name) GROUP BY 1, 2 HAVING count(DISTINCT left(name, k)) = 1 AND count(*) = (SELECT count(*) FROM n m WHERE m.s_nationkey = n.s_nationkey) AND regexp_matches(min(left(name, k)), '[-_]$'))
    SELECT s_nationkey, CASE WHEN count(*) > 1 THEN coalesce(left(min(name), (SELECT max(k) FROM c WHERE c.s_nationkey = n.s_nationkey)), '') ELSE '' END AS prefix FROM n GROUP BY 1""",
)
R.add(
    "package_tokens", lambda s, d: C.package_tokens(table(s, d, "conversations"), "conv_id", "text"),
    "SELECT conv_id, left(sha256(coalesce(string_agg(sha256(text), chr(10) ORDER BY sha256(text)), '')), 7) AS token FROM conversations GROUP BY 1",
)
_IDS = "CASE WHEN o_orderkey % 2 = 0 THEN 'doi' ELSE 'accession' END AS kind", "'10.1/ab' || CAST(o_orderkey % 50 + 100 AS STRING) AS a", "'10.1/ab' || CAST(o_custkey % 50 + 100 AS STRING) || CASE WHEN o_custkey % 5 = 0 THEN 'x' ELSE '' END AS b"
R.add(
    "identifier_corrections", lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", *_IDS).where(C.identifier_near(F.col("kind"), F.col("a"), F.col("b"))),
    f"WITH i AS (SELECT o_orderkey, {', '.join(_IDS)} FROM orders) SELECT * FROM i WHERE a <> b AND ((kind = 'doi' AND length(a) = length(b) AND hamming(a, b) <= 2) OR (kind <> 'doi' AND least(length(a), length(b)) >= 7 AND (starts_with(a, b) OR starts_with(b, a))))",
)
for _name, _floor, _least in (("champion", 20, 0.0), ("champion_any", 0, -9.0), ("champion_deep", 10**6, -9.0)):
    R.add(
        _name, lambda s, d, f=_floor, x=_least: C.champion(S.candidates(score_rows(s, d), "v1"), census(defect_rows(s, d)), "v0", 5, 1, f, x),
        ROWS + ", " + DEFECTS.strip().removeprefix("WITH ") + f""", m AS (SELECT member, count(*) AS n, median(s) AS median, avg(s) AS mean, CASE WHEN count(*) < 2 THEN 0 ELSE quantile_cont(s, 0.75) - quantile_cont(s, 0.25) END::DOUBLE AS iqr,
      count(*) FILTER (opponent = 'v1') AS original_n, median(s) FILTER (opponent = 'v1') AS original_median, md5(member) AS digest FROM votes WHERE kept GROUP BY 1),
    e AS (SELECT * FROM m WHERE n >= 5 AND (member = 'v0' OR (original_n >= 1 AND original_median >= {_least}))),
    k AS (SELECT CASE WHEN {_floor} <= 0 THEN 0 ELSE coalesce(min(cell + 1) FILTER (least >= {_floor}), 48) END::INT AS used FROM (SELECT cell, min(running) AS least FROM p WHERE version IN (SELECT member FROM e) GROUP BY cell)),
    lead AS (SELECT version, list(n ORDER BY cell) AS l FROM c, k WHERE cell < used GROUP BY version),
    best AS (SELECT e.* FROM e LEFT JOIN lead ON member = version ORDER BY coalesce(l, []), median DESC, mean DESC, iqr, digest LIMIT 1),
    o AS (SELECT (SELECT used FROM k) AS cells_used, (SELECT member FROM best) AS member, coalesce((SELECT b.median = x.median AND b.mean = x.mean AND b.iqr = x.iqr FROM best b, e x WHERE x.member = 'v0'), false) AS same)
    SELECT CASE WHEN member IS NULL OR same THEN 'v0' ELSE member END AS champion, member IS NULL OR member = 'v0' OR same AS base_kept, cells_used FROM o""",
    )
R.add(
    "statistics_floor", lambda s, d: table(s, d, "orders").selectExpr("o_orderkey", "CAST(o_orderkey % 20 + 3 AS INT) AS n", "CAST(o_custkey % 19 + 1 AS INT) AS family", "CAST(o_custkey % 97 AS DOUBLE) / 50000 AS p").where(C.below_floor(F.col("p"), F.col("n"), F.col("family"))),
    "WITH r AS (SELECT o_orderkey, (o_orderkey % 20 + 3)::INT AS n, (o_custkey % 19 + 1)::INT AS family, (o_custkey % 97)::DOUBLE / 50000 AS p FROM orders) SELECT * FROM r WHERE n >= 5 AND p < family * 2 / pow(2.0, n) - greatest(1e-12, 0.02 * family * 2 / pow(2.0, n))",
)
#: Lines of claims with intervals, explained variance, accessions and versions after them.
_REPORTED = """raw || ' 95% CI [0.' || CAST(line % 7 AS STRING) || '0, ' || CAST(line % 5 AS STRING) || '.5]; R² = -0.' || CAST(line % 9 AS STRING) || '; AUC was 0.' || CAST(line % 4 + 5 AS STRING)
 || ', GSE' || CAST(line % 11 AS STRING) || ' by v1.' || CAST(line % 6 AS STRING) || '.0, p = ' || CAST(line % 8 + 1 AS STRING) || ' × 10⁻' || CASE WHEN line % 2 = 0 THEN '³' ELSE '⁸' END"""


def reported_lines(s: SparkSession, d: str) -> DataFrame:
    return claims(s, d).selectExpr("doc_id", "line", f"{_REPORTED} AS raw")


def reported(s: SparkSession, d: str) -> DataFrame:
    return V.reported_values(reported_lines(s, d))


R.add("reported_values", lambda s, d: V.line_inventory(reported_lines(s, d)))
R.add("reported_divergence", lambda s, d: V.value_divergence(reported(s, d)))
QUERIES, ORACLE_SQL = R.queries, R.sql
