"""Queries over the lines and tokens of documents. Where invented prose has none of a kind (spelling
variants, citations, numbers), some of the lines are replaced by ones that do (SAMPLE)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.functions import scalars as X
from inkmill.operators import profile as P
from inkmill.operators import text as T
from inkmill.plans.base import Registry, select_from, table
from inkmill.streaming import windows as W

R = Registry()

#: Lines for rules that find nothing in invented prose.
SAMPLE = [
    "# Introduction", "The colour of the analysed sample was analyzed by color; we organise and organize.", "", "",
    "Results may suggest a clearly proven effect of 1,250 cells and 3.5 mg.", "We re-analyzed and reanalyzed the reanalyzed, re-analyzed set.",
    "# Methods", "Contact:someone@example.org for data,code and 12 samples.", "The affect had an effect, and the effect may affect us.", "See TODO: fill in later.",
    "one two three one two three one two three", "", "", "", "Principal and principle differ. 100% of lines \\% kept % gone", "[3], [1,2-4] and [2019-2020] then [5]",
]


#: Lines of documents, some of them replaced by those of SAMPLE, in SQL that both engines read.
_SAMPLED = "CASE CAST((doc_id * 5 + line * line * 3 + line) % 41 AS INT) " + " ".join(f"WHEN {i} THEN '" + t.replace("'", "''").replace("\\", "' || chr(92) || '") + "'" for i, t in enumerate(SAMPLE)) + " ELSE raw || CASE WHEN line % 3 = 0 THEN ',' || lower(split_part(raw, ' ', 1)) ELSE '' END END"


def sample(s: SparkSession, d: str) -> DataFrame:
    return lines(s, d).selectExpr("doc_id", "line", f"{_SAMPLED} AS raw")


def docs(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "documents").select("doc_id", "text", "source")


def lines(s: SparkSession, d: str) -> DataFrame:
    return T.lines_of(docs(s, d))


_LINES = "WITH parts AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), lines AS (SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS raw FROM parts) "


_SAMPLE = _LINES + f", sample AS (SELECT doc_id, line, {_SAMPLED} AS raw FROM lines) "


def _tokens(pattern: str, group: int = 0) -> str:
    return f"SELECT doc_id, line, unnest(regexp_extract_all(raw, '{pattern}', {group})) AS match"


R.add("doc_word_counts", lambda s, d: docs(s, d).select("doc_id", X.word_count(F.col("text")).cast("long").alias("n_words")), "SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\s\\x{0B}\\x{1C}-\\x{1F}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+')) AS n_words FROM documents")
R.add("line_counts", lambda s, d: lines(s, d).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.count_if(F.trim("raw") == "").alias("n_blank"), F.max(F.length("raw")).cast("long").alias("longest")), _LINES + "SELECT doc_id, count(*) AS n_lines, count(*) FILTER (trim(raw) = '') AS n_blank, max(length(raw)) AS longest FROM lines GROUP BY 1")
def _placed(pattern: str, source: str) -> str:
    return f"SELECT struct_pack(doc_id := doc_id, line := line, nth := nth) AS used, match FROM (SELECT doc_id, line, unnest(range(1, len(m) + 1)) AS nth, unnest(m) AS match FROM (SELECT doc_id, line, regexp_extract_all(raw, '{pattern}') AS m FROM {source}))"


R.add(
    "term_occurrences", lambda s, d: T.occurrences(lines(s, d), "apache license", "Apache License").select("doc_id", "line", "match", "exact"),
    _LINES + "SELECT doc_id, line, match, match = 'Apache License' AS exact FROM (" + _tokens(r"(?i)\bapache[\s-]*license(?:es|s)?\b") + " FROM lines)",
)
R.add(
    "acronym_inventory", lambda s, d: T.acronyms(lines(s, d)),
    _LINES + ", t AS (" + _tokens(T.WORDS) + " FROM lines) SELECT match AS token, count(*) AS n, count(DISTINCT doc_id) AS n_docs, min(doc_id) AS first_doc, first(line ORDER BY doc_id, line) AS first_line FROM t WHERE regexp_full_match(match, '[A-Z]{2,}') GROUP BY 1",
)
_FAMILY = ", c AS (SELECT k AS key, f, count(*) AS n, min(used) AS used FROM t GROUP BY 1, 2) SELECT key, count(*) AS n_forms, sum(n)::BIGINT AS n, string_agg(f, '|' ORDER BY f) AS forms, first(f ORDER BY n DESC, used, f) AS majority FROM c GROUP BY 1 HAVING count(*) >= 2"
R.add("case_families", lambda s, d: T.case_families(lines(s, d)), _LINES + ", m AS (" + _placed("[A-Za-z]{2,}", "lines") + "), t AS (SELECT lower(match) AS k, match AS f, used FROM m)" + _FAMILY)
_KEY = "lower(match)"
for _p, _to in X.SPELLING_REWRITES:
    _KEY = f"regexp_replace({_KEY}, '{_p}', '{_to.replace('$1', chr(92) + '1')}', 'g')"
R.add("spelling_families", lambda s, d: T.spelling_families(sample(s, d)), _SAMPLE + ", m AS (" + _placed("[A-Za-z]{5,}", "sample") + f"), t AS (SELECT {_KEY} AS k, lower(match) AS f, used FROM m WHERE length({_KEY}) >= 5)" + _FAMILY)
R.add("spelling_families_documents", lambda s, d: T.spelling_families(lines(s, d)), _LINES + ", m AS (" + _placed("[A-Za-z]{5,}", "lines") + f"), t AS (SELECT {_KEY} AS k, lower(match) AS f, used FROM m WHERE length({_KEY}) >= 5)" + _FAMILY)
R.add(
    "hyphen_families", lambda s, d: T.hyphen_families(sample(s, d)),
    _SAMPLE + ", m AS (" + _placed("[A-Za-z][A-Za-z-]{4,}", "sample") + "), h AS (SELECT lower(trim(match, '-')) AS f, used FROM m), t AS (SELECT replace(f, '-', '') AS k, f, used FROM h WHERE length(replace(f, '-', '')) >= 5)" + _FAMILY + " AND min(n) >= 2 AND bool_or(contains(f, '-'))",
)
R.add(
    "repeated_lines", lambda s, d: T.repeated_lines(lines(s, d)),
    _LINES + "SELECT doc_id, trim(regexp_replace(raw, '\\s+', ' ', 'g')) AS norm, count(*) AS n FROM lines WHERE trim(regexp_replace(raw, '\\s+', ' ', 'g')) <> '' GROUP BY 1, 2 HAVING count(*) >= 2",
)
_HOST = "^[a-z]+://([^/]+)"
R.add(
    "page_furniture", lambda s, d: T.page_furniture(table(s, d, "pages").select(F.regexp_extract("url", _HOST, 1).alias("doc_id"), F.col("page_id").alias("page"), F.col("html").alias("text"))),
    f"""WITH p AS (SELECT regexp_extract(url, '{_HOST}', 1) AS doc_id, page_id, html FROM pages), l AS (SELECT doc_id, unnest(string_split(html, chr(10))) AS raw FROM p), t AS (SELECT doc_id, count(DISTINCT page_id) AS n_pages FROM p GROUP BY 1)
    SELECT doc_id, raw, n, n_pages FROM (SELECT doc_id, trim(raw, ' ') AS raw, count(*) AS n FROM l WHERE trim(raw, ' ') <> '' GROUP BY 1, 2) JOIN t USING (doc_id) WHERE n >= greatest(2, floor(n_pages * 0.6))""",
)
R.add("vocabulary", lambda s, d: T.vocabulary(lines(s, d)), _LINES + ", t AS (" + _tokens(T.WORDS) + " FROM lines) SELECT match AS term, count(*) AS n FROM t WHERE regexp_full_match(match, '[A-Z][a-z]{3,}') GROUP BY 1 HAVING count(*) >= 2")
_KINDS = {"email": r"[A-Za-z0-9._-]+@[A-Za-z0-9-]+\.[A-Za-z0-9.-]+[A-Za-z0-9]", "hex": r"\b[0-9a-f]{40}\b", "ipv4": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b"}
R.add(
    "identifiers", lambda s, d: T.identifiers(lines(s, d), _KINDS),
    _LINES + ", t AS (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, lower(match) AS value, doc_id, line FROM ({_tokens(p)} FROM lines)" for k, p in _KINDS.items()) + ") SELECT kind, value, count(*) AS n, min(doc_id) AS first_doc, first(line ORDER BY doc_id, line) AS first_line FROM t GROUP BY 1, 2",
)
R.add(
    "section_context", lambda s, d: T.carried(sample(s, d), F.col("raw").startswith("#"), F.col("raw")).select("doc_id", "line", "section", "part"),
    _SAMPLE + "SELECT doc_id, line, coalesce(last_value(CASE WHEN starts_with(raw, '#') THEN raw END IGNORE NULLS) OVER w, 'front') AS section, count(*) FILTER (starts_with(raw, '#')) OVER w AS part FROM sample WINDOW w AS (PARTITION BY doc_id ORDER BY line)",
)
R.add(
    "turn_context", lambda s, d: T.carried(table(s, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("line"), F.col("role").alias("raw")), F.col("raw") == "user", F.concat(F.lit("q"), F.col("line").cast("string"))).select("doc_id", "line", "section", "part"),
    "SELECT conv_id AS doc_id, turn AS line, coalesce(last_value(CASE WHEN role = 'user' THEN 'q' || turn END IGNORE NULLS) OVER w, 'front') AS section, count(*) FILTER (role = 'user') OVER w AS part FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
)
_HEDGES, _ABSOLUTES = ["may", "might", "suggest", "could"], ["clearly", "proven", "always", "never"]
R.add(
    "claim_strength", lambda s, d: T.claim_strength(sample(s, d), _HEDGES, _ABSOLUTES).select("doc_id", "line", F.col("n_hedge").cast("long").alias("n_hedge"), F.col("n_absolute").cast("long").alias("n_absolute")),
    _SAMPLE + f"SELECT * FROM (SELECT doc_id, line, len(regexp_extract_all(lower(raw), '\\b({'|'.join(_HEDGES)})\\b')) AS n_hedge, len(regexp_extract_all(lower(raw), '\\b({'|'.join(_ABSOLUTES)})\\b')) AS n_absolute FROM sample) WHERE n_hedge > 0 OR n_absolute > 0",
)
_PAIRS = [("affect", "effect"), ("principal", "principle")]
R.add(
    "confusable_pairs", lambda s, d: T.confusable_pairs(sample(s, d), _PAIRS),
    _SAMPLE + ", p AS (SELECT unnest(['affect', 'principal']) AS a, unnest(['effect', 'principle']) AS b), r AS (SELECT doc_id, a, b, regexp_matches(lower(raw), '\\b' || a || '\\b') AS ia, regexp_matches(lower(raw), '\\b' || b || '\\b') AS ib FROM sample, p) SELECT doc_id, a, b, count(*) FILTER (ia) AS n_a, count(*) FILTER (ib) AS n_b, count(*) FILTER (ia AND ib) AS n_both FROM r GROUP BY 1, 2, 3 HAVING count(*) FILTER (ia) > 0 AND count(*) FILTER (ib) > 0",
)
R.add(
    "key_terms", lambda s, d: T.key_terms(lines(s, d), ["License", "thing", "queue"]),
    _LINES + ", t AS (SELECT unnest(['License', 'thing', 'queue']) AS term) SELECT term, count(*) AS n, min(doc_id) AS first_doc, first(line ORDER BY doc_id, line) AS first_line, first(left(raw, 120) ORDER BY doc_id, line) AS context FROM lines, t WHERE contains(lower(raw), lower(term)) GROUP BY 1",
)
R.add(
    "term_repetition", lambda s, d: T.term_repetition(sample(s, d)).select("doc_id", "line", "gram", "n", "place"),
    _SAMPLE + ", w AS (SELECT doc_id, line, regexp_extract_all(lower(raw), '[a-z]+') AS w FROM sample), g AS (SELECT doc_id, line, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3), c AS (SELECT doc_id, line, gram, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT doc_id, line, gram, n, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n DESC, length(gram) DESC, gram)::INT AS place FROM c) WHERE place <= 3",
)
R.add(
    "length_caps", lambda s, d: T.length_caps(docs(s, d), 100, 1.15).select("doc_id", "line", F.col("n_words").cast("long").alias("n_words"), F.col("cap").cast("long").alias("cap")),
    _LINES + "SELECT * FROM (SELECT doc_id, line, len(regexp_extract_all(raw, '[^\\s\\x{0B}]+')) AS n_words, floor(100 * 1.15 + 1e-9)::BIGINT AS cap FROM lines) WHERE n_words > cap",
)
R.add(
    "number_ledger", lambda s, d: T.number_ledger(sample(s, d)).select("doc_id", "line", "number", "unit", "grouped"),
    _SAMPLE + ", m AS (" + _tokens("[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?(?: [A-Za-z]+)?") + " FROM sample) SELECT doc_id, line, regexp_extract(match, '^([0-9.,]+)', 1) AS number, regexp_extract(match, ' ([A-Za-z]+)$', 1) AS unit, contains(regexp_extract(match, '^([0-9.,]+)', 1), ',') AS grouped FROM m",
)
R.add("comma_glue", lambda s, d: T.comma_glue(sample(s, d)).select("doc_id", "line", "match"), _SAMPLE + ", g AS (SELECT doc_id, line, unnest(range(1, len(m) + 1)) AS nth, unnest(m) AS match FROM (SELECT doc_id, line, regexp_extract_all(raw, '[A-Za-z]+,[A-Za-z]+') AS m FROM sample)) SELECT doc_id, line, match FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY line, nth) <= 24")
R.add(
    "empty_runs", lambda s, d: T.empty_runs(sample(s, d)).select("doc_id", "first_line", "n"),
    _SAMPLE + "SELECT doc_id, min(line) AS first_line, count(*) AS n FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM sample WHERE trim(raw) = '') GROUP BY doc_id, g HAVING count(*) > 1",
)
R.add("leftover_phrases", lambda s, d: T.leftovers(lines(s, d), ["Licensed under", "All rights reserved", "todo"]), _LINES + "SELECT doc_id, line, CASE WHEN contains(lower(raw), 'licensed under') THEN 'Licensed under' WHEN contains(lower(raw), 'all rights reserved') THEN 'All rights reserved' ELSE 'todo' END AS phrase FROM lines WHERE contains(lower(raw), 'licensed under') OR contains(lower(raw), 'all rights reserved') OR contains(lower(raw), 'todo')")
R.add("correspondence_glue", lambda s, d: T.glued_mail(sample(s, d)).select("doc_id", "line"), _SAMPLE + "SELECT doc_id, line FROM sample WHERE regexp_matches(raw, '[:;)][A-Za-z0-9._-]+@|[A-Za-z]:[A-Za-z0-9._-]+@')")


def rule_summary(s: SparkSession, d: str) -> DataFrame:
    rows = lines(s, d)
    found = T.leftovers(rows, ["Licensed under"]).select(F.lit("leftover").alias("rule"), "doc_id")
    found = found.unionByName(rows.where("raw <> '' AND trim(raw) = ''").select(F.lit("blank").alias("rule"), "doc_id"))
    return T.by_rule(found.unionByName(rows.where(F.col("raw").rlike("[A-Za-z]  +[A-Za-z]")).select(F.lit("spaces").alias("rule"), "doc_id")))


R.add(
    "rule_summary", rule_summary,
    _LINES + ", f AS (SELECT 'leftover' AS rule, doc_id FROM lines WHERE contains(lower(raw), 'licensed under') UNION ALL SELECT 'blank', doc_id FROM lines WHERE raw <> '' AND trim(raw) = '' UNION ALL SELECT 'spaces', doc_id FROM lines WHERE regexp_matches(raw, '[A-Za-z]  +[A-Za-z]')) SELECT rule, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM f GROUP BY 1",
)
R.add(
    "masked_length", lambda s, d: docs(s, d).select("doc_id", F.length(T.masked(F.col("text"))).cast("long").alias("n")),
    r"SELECT doc_id, length(regexp_replace(text, 'https?://[^\s]+|10\.[0-9]{4,9}/[^\s]+|[A-Za-z0-9._-]+@[A-Za-z0-9.-]+|/[A-Za-z0-9_.-]+/[^\s]+', ' ', 'g')) AS n FROM documents",
)
R.add("tex_comments", lambda s, d: sample(s, d).select("doc_id", "line", T.without_comment(F.col("raw")).alias("raw")), _SAMPLE + r"SELECT doc_id, line, regexp_extract(raw, '^((?:\\.|[^%\\])*)', 1) AS raw FROM sample")
R.add(
    "citation_numbers", lambda s, d: T.matches_of(sample(s, d), r"\[([0-9, –-]+)\]", 1).select("line", "nth", F.explode(X.citation_numbers(F.col("match"))).alias("number")).select("line", "number"),
    _SAMPLE + ", m AS (" + _tokens(r"\[([0-9, –-]+)\]", 1) + " FROM sample), p AS (SELECT line, trim(unnest(regexp_split_to_array(match, '[,;]'))) AS p FROM m), r AS (SELECT line, regexp_extract(p, '^([0-9]+)', 1)::INT AS a, coalesce(try_cast(regexp_extract(p, '-\\s*([0-9]+)$', 1) AS INT), regexp_extract(p, '^([0-9]+)', 1)::INT) AS b, contains(p, '-') AS ranged FROM p) SELECT line, unnest(CASE WHEN b - a <= 80 THEN range(a, b + 1) ELSE [a, b] END)::INT AS number FROM r WHERE NOT (ranged AND a BETWEEN 1900 AND 2099 AND b BETWEEN 1900 AND 2099)",
)


_CELL = """CASE CAST(l_orderkey % 11 AS INT) WHEN 0 THEN '1,' || CAST(100 + l_partkey % 900 AS STRING) WHEN 1 THEN '$' || CAST(l_quantity AS STRING) WHEN 2 THEN '0,' || CAST(l_linenumber AS STRING)
 WHEN 3 THEN CAST(l_partkey AS STRING) || '%' WHEN 4 THEN l_returnflag WHEN 5 THEN '' WHEN 6 THEN CAST(l_linenumber AS STRING) || 'e3' WHEN 7 THEN ' .' || CAST(l_suppkey AS STRING) WHEN 8 THEN '-' || CAST(l_partkey AS STRING) || '.' WHEN 9 THEN '12,' || CAST(l_partkey AS STRING) || '.5' ELSE 'inf' END"""
_CELLS = f"SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, {_CELL} AS cell FROM lineitem"
R.add(
    "cell_numbers", lambda s, d: select_from(s, d, _CELLS, "lineitem").select("l_orderkey", "l_linenumber", "cell", X.cell_number(F.col("cell")).alias("value")),
    rf"""WITH c AS (SELECT *, regexp_replace(trim(cell), '[$€£%]', '', 'g') AS t FROM ({_CELLS})) SELECT l_orderkey, l_linenumber, cell,
    CASE WHEN regexp_full_match(t, '[+-]?[0-9]{{1,3}}(,[0-9]{{3}})+(\.[0-9]+)?') THEN replace(t, ',', '')::DOUBLE WHEN regexp_full_match(t, '[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?') THEN t::DOUBLE END AS value FROM c""",
)
_HEADER = "SELECT DISTINCT CASE CAST(p_partkey % 4 AS INT) WHEN 0 THEN lower(p_type) || 'Total_' || split_part(p_name, ' ', 2) || 's' WHEN 1 THEN 'l_' || replace(p_name, ' ', '') || 'Counties' WHEN 2 THEN p_brand || ' ' || p_name ELSE 'XML' || p_type || 'Name ' || p_name END AS name FROM part"


def headers(s: SparkSession, d: str) -> DataFrame:
    token = F.explode(X.header_tokens(F.col("name"))).alias("token")
    return select_from(s, d, _HEADER, "part").select("name", X.slug(F.col("name")).alias("slug"), token).withColumn("stem", X.plural_stem(F.col("token")))


R.add(
    "header_tokens", headers,
    "WITH n AS (" + _HEADER + "), t AS (SELECT name, left(regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_|_$', '', 'g'), 40) AS slug, unnest(list_distinct(list_filter(string_split(lower(regexp_replace(regexp_replace(name, '([a-z0-9])([A-Z])', '\\1 \\2', 'g'), '[^A-Za-z0-9]+', ' ', 'g')), ' '), lambda x: x <> ''))) AS token FROM n) SELECT *, CASE WHEN regexp_matches(token, 'ies$') AND length(token) > 4 THEN regexp_replace(token, 'ies$', 'y') WHEN regexp_matches(token, '[^s]s$') AND length(token) > 3 THEN regexp_replace(token, 's$', '') ELSE token END AS stem FROM t",
)
_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
R.add(
    "column_profile", lambda s, d: P.column_profile(table(s, d, "lineitem"), _NUMBERS).select("column", "n", "n_numeric", "min", "max", F.round("mean", 6).alias("mean"), F.round("sum", 2).alias("sum")),
    " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n, count({c}) AS n_numeric, min({c}) AS min, max({c}) AS max, round(avg({c}), 6) AS mean, round(sum({c}), 2) AS sum FROM lineitem" for c in _NUMBERS),
)
_CATEGORIES = ["l_returnflag", "l_linestatus", "l_orderkey"]
R.add(
    "categorical_profile", lambda s, d: P.categorical(table(s, d, "lineitem"), _CATEGORIES),
    "SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, string_agg(DISTINCT {c}::VARCHAR, '|' ORDER BY {c}::VARCHAR) AS \"values\" FROM lineitem" for c in _CATEGORIES) + ") WHERE n_distinct <= 40",
)
R.add(
    "dominant_value", lambda s, d: P.dominant(table(s, d, "documents"), "source", "lang", 10, 0.5),
    "WITH c AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY 1, 2), g AS (SELECT source, sum(n)::BIGINT AS total, max(n) AS n, first(lang ORDER BY n DESC, lang) AS value FROM c GROUP BY 1) SELECT * FROM g WHERE total >= 10 AND n >= 0.5 * total",
)
R.add(
    "largest_texts", lambda s, d: docs(s, d).select("doc_id", F.length("text").cast("long").alias("n")).orderBy(F.col("n").desc(), "doc_id").limit(10),
    "SELECT doc_id, length(text) AS n FROM documents ORDER BY n DESC, doc_id LIMIT 10",
)
R.add(
    "tumbling_windows", lambda s, d: W.tumbling_counts(table(s, d, "events")).select("window_start", "event_type", "n", F.round("total", 4).alias("total")),
    "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
)
R.add(
    "user_sessions", lambda s, d: W.sessions(table(s, d, "events")),
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 30 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM n GROUP BY user_id, k""",
)


def _whole(name: str, query, sql: str) -> None:
    """A rule over every line of every document, as `<name>_documents`."""
    R.add(f"{name}_documents", lambda s, d: query(lines(s, d)), _LINES + sql)


_whole("hyphen_families", T.hyphen_families, ", m AS (" + _placed("[A-Za-z][A-Za-z-]{4,}", "lines") + "), h AS (SELECT lower(trim(match, '-')) AS f, used FROM m), t AS (SELECT replace(f, '-', '') AS k, f, used FROM h WHERE length(replace(f, '-', '')) >= 5)" + _FAMILY + " AND min(n) >= 2 AND bool_or(contains(f, '-'))")
_whole(
    "claim_strength", lambda x: T.claim_strength(x, _HEDGES, _ABSOLUTES).select("doc_id", "line", F.col("n_hedge").cast("long").alias("n_hedge"), F.col("n_absolute").cast("long").alias("n_absolute")),
    f"SELECT * FROM (SELECT doc_id, line, len(regexp_extract_all(lower(raw), '\\b({'|'.join(_HEDGES)})\\b')) AS n_hedge, len(regexp_extract_all(lower(raw), '\\b({'|'.join(_ABSOLUTES)})\\b')) AS n_absolute FROM lines) WHERE n_hedge > 0 OR n_absolute > 0",
)
_whole(
    "term_repetition", lambda x: T.term_repetition(x).select("doc_id", "line", "gram", "n", "place"),
    ", w AS (SELECT doc_id, line, regexp_extract_all(lower(raw), '[a-z]+') AS w FROM lines), g AS (SELECT doc_id, line, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS gram FROM w WHERE len(w) >= 3), c AS (SELECT doc_id, line, gram, count(*) AS n FROM g GROUP BY 1, 2, 3 HAVING count(*) > 1) SELECT doc_id, line, gram, n, place FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, line ORDER BY n DESC, length(gram) DESC, gram)::INT AS place FROM c) WHERE place <= 3",
)
_whole(
    "number_ledger", lambda x: T.number_ledger(x).select("doc_id", "line", "number", "unit", "grouped"),
    ", m AS (" + _tokens("[0-9]+(?:,[0-9]{3})*(?:\\.[0-9]+)?(?: [A-Za-z]+)?") + " FROM lines) SELECT doc_id, line, regexp_extract(match, '^([0-9.,]+)', 1) AS number, regexp_extract(match, ' ([A-Za-z]+)$', 1) AS unit, contains(regexp_extract(match, '^([0-9.,]+)', 1), ',') AS grouped FROM m",
)
_whole("tex_comments", lambda x: x.where(F.contains("raw", F.lit("%"))).select("doc_id", "line", T.without_comment(F.col("raw")).alias("raw")), r"SELECT doc_id, line, regexp_extract(raw, '^((?:\\.|[^%\\])*)', 1) AS raw FROM lines WHERE contains(raw, '%')")
_whole("empty_runs", lambda x: T.empty_runs(x).select("doc_id", "first_line", "n"), "SELECT doc_id, min(line) AS first_line, count(*) AS n FROM (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS g FROM lines WHERE trim(raw) = '') GROUP BY doc_id, g HAVING count(*) > 1")
_whole("correspondence_glue", lambda x: T.glued_mail(x).select("doc_id", "line"), "SELECT doc_id, line FROM lines WHERE regexp_matches(raw, '[:;)][A-Za-z0-9._-]+@|[A-Za-z]:[A-Za-z0-9._-]+@')")
QUERIES, ORACLE_SQL = R.queries, R.sql
