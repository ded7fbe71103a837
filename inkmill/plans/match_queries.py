"""Queries over joins, pairings and differences. Where the tables have no such data (citations,
reviews, manifests) the rows are derived from their columns, the same in the SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from inkmill.functions import scalars as X
from inkmill.operators import matching as M
from inkmill.operators import text as T
from inkmill.operators.dictionary import phrases_in
from inkmill.plans.base import Registry, select_from, table

R = Registry()


_CITED = "SELECT CAST(o_custkey % 50 AS BIGINT) AS doc_id, 'k' || CAST(o_orderkey % 40 AS STRING) AS key FROM orders"
_LISTED = "SELECT CAST(p_partkey % 45 AS BIGINT) AS doc_id, 'k' || CAST(p_partkey * 7 % 55 AS STRING) AS key FROM part"
_LISTS = f"WITH cited AS ({_CITED}), listed AS ({_LISTED}) "


def _cited(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return select_from(s, d, _CITED, "orders"), select_from(s, d, _LISTED, "part")


R.add(
    "orphan_citations", lambda s, d: M.orphans(*_cited(s, d)),
    _LISTS + "SELECT DISTINCT doc_id::BIGINT AS doc_id, key FROM cited c WHERE CASE WHEN doc_id IN (SELECT doc_id FROM listed) THEN NOT EXISTS (SELECT 1 FROM listed l WHERE l.doc_id = c.doc_id AND l.key = c.key) ELSE key NOT IN (SELECT key FROM listed) END",
)
R.add("uncited_entries", lambda s, d: M.uncited(*_cited(s, d)), _LISTS + "SELECT DISTINCT doc_id::BIGINT AS doc_id, key FROM listed l WHERE NOT EXISTS (SELECT 1 FROM cited c WHERE l.doc_id = c.doc_id AND l.key = c.key)")
#: Each file includes the one of half its number; two more edges close a circle and join the nations.
_EDGES = """SELECT 'f' || CAST(c_custkey AS STRING) AS src, 'f' || CAST(CAST(floor(c_custkey / 2) AS BIGINT) AS STRING) AS dst FROM customer WHERE c_custkey > 1
 UNION ALL SELECT 'f1', 'f3' FROM nation WHERE n_nationkey = 0 UNION ALL SELECT 'f' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING) FROM nation"""
R.add(
    "include_closure", lambda s, d: M.closure(select_from(s, d, _EDGES, "customer", "nation")),
    f"WITH RECURSIVE e AS ({_EDGES}), r(root, node) AS (SELECT DISTINCT src, src FROM e UNION SELECT r.root, e.dst FROM r JOIN e ON r.node = e.src) SELECT DISTINCT root, node FROM r",
)
R.add("duplicate_texts", lambda s, d: M.duplicates(table(s, d, "documents").select(F.sha2("text", 256).alias("digest")), ["digest"]), "SELECT sha256(text) AS digest, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
R.add(
    "exact_dups", lambda s, d: M.first_of_each(table(s, d, "documents").select("doc_id", F.sha2(F.lower(F.trim(F.regexp_replace("text", "[ \\n\\t]+", " "))), 256).alias("digest")), ["digest"], ["doc_id"]).select("doc_id"),
    "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(trim(regexp_replace(text, '[ \\n\\t]+', ' ', 'g'), ' '))",
)


def parity(s: SparkSession, d: str) -> DataFrame:
    lines = T.lines_of(table(s, d, "documents").select("doc_id", "text", "lang")).where("raw <> ''")
    left = lines.where("doc_id % 2 = 0").select(F.md5("raw").alias("key"))
    return M.multiset_difference(left, lines.where("doc_id % 2 = 1").select(F.md5("raw").alias("key")), "key")


R.add(
    "multiset_parity", parity,
    "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS raw FROM documents), c AS (SELECT md5(raw) AS key, count(*) FILTER (doc_id % 2 = 0) AS n_left, count(*) FILTER (doc_id % 2 = 1) AS n_right FROM l WHERE raw <> '' GROUP BY 1) SELECT * FROM c WHERE n_left <> n_right",
)
_BEFORE = "SELECT event_type AS kind, 'id' || CAST(event_id % 97 AS STRING) AS value FROM events"
_AFTER = "SELECT event_type AS kind, 'id' || CAST(event_id % 101 AS STRING) AS value FROM events WHERE user_id % 3 > 0"
R.add(
    "changed_ids", lambda s, d: M.changed_ids(select_from(s, d, _BEFORE, "events"), select_from(s, d, _AFTER, "events")),
    f"WITH b AS ({_BEFORE}), a AS ({_AFTER}) SELECT *, 'removed' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'added' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)",
)


def pairing(s: SparkSession, d: str) -> DataFrame:
    """Documents of even id against those of odd id: name is source and language, digest the text's."""
    rows = table(s, d, "documents").select(F.col("doc_id").alias("id"), F.concat_ws("-", "source", "lang").alias("name"), F.md5("text").alias("digest"))
    return M.three_tier_pairs(rows.where("id % 2 = 0"), rows.where("id % 2 = 1"))


_TIERS = "WITH l0 AS (SELECT doc_id AS id, source || '-' || lang AS name, md5(text) AS digest FROM documents WHERE doc_id % 2 = 0), r0 AS (SELECT doc_id AS id, source || '-' || lang AS name, md5(text) AS digest FROM documents WHERE doc_id % 2 = 1)"
for _i, _k in enumerate(("name, digest", "name", "digest")):
    _TIERS += f", p{_i} AS MATERIALIZED (SELECT a.id AS left_id, b.id AS right_id, {_i + 1} AS tier FROM (SELECT *, row_number() OVER (PARTITION BY {_k} ORDER BY id) AS rn FROM l{_i}) a JOIN (SELECT *, row_number() OVER (PARTITION BY {_k} ORDER BY id) AS rn FROM r{_i}) b USING ({_k}, rn))"
    _TIERS += f", l{_i + 1} AS (SELECT * FROM l{_i} WHERE id NOT IN (SELECT left_id FROM p{_i})), r{_i + 1} AS (SELECT * FROM r{_i} WHERE id NOT IN (SELECT right_id FROM p{_i}))"
R.add("document_pairing", pairing, _TIERS + " SELECT * FROM p0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT id, NULL, 0 FROM l3 UNION ALL SELECT NULL, id, 0 FROM r3")
_WANT = "SELECT 'c/' || CAST(c_custkey AS STRING) || '.csv' AS path, c_mktsegment || CAST(c_custkey % 90 AS STRING) AS key FROM customer"
_GOT = "SELECT 'c/' || CAST(c_custkey * 3 AS STRING) || '.csv' AS path, c_mktsegment || CAST(c_custkey * 3 % 90 AS STRING) AS key FROM customer WHERE c_nationkey % 5 = 0"
R.add(
    "raw_data_pairs", lambda s, d: M.unique_fallback_pairs(select_from(s, d, _WANT, "customer"), select_from(s, d, _GOT, "customer")),
    f"WITH w AS ({_WANT}), g AS ({_GOT}) SELECT w.path, coalesce(e.path, k.path) AS match, CASE WHEN e.path IS NULL THEN 'key' ELSE 'exact' END AS how FROM w LEFT JOIN g e ON w.path = e.path LEFT JOIN (SELECT key, any_value(path) AS path FROM g GROUP BY key HAVING count(*) = 1) k ON w.key = k.key WHERE coalesce(e.path, k.path) IS NOT NULL",
)


def value_provenance(s: SparkSession, d: str) -> DataFrame:
    """Order totals rounded as prose would write them, against the column statistics of `orders`."""
    orders = table(s, d, "orders")
    stats = orders.agg(F.min("o_totalprice").alias("a"), F.max("o_totalprice").alias("b"), F.count("*").cast("double").alias("c"))
    values = stats.select(F.explode(F.array(
        F.struct(F.lit("orders.min").alias("source"), F.lit("min").alias("kind"), F.lit(1).alias("ord"), F.col("a").alias("value")),
        F.struct(F.lit("orders.max").alias("source"), F.lit("max").alias("kind"), F.lit(2).alias("ord"), F.col("b").alias("value")),
        F.struct(F.lit("orders.rows").alias("source"), F.lit("rowcount").alias("kind"), F.lit(3).alias("ord"), F.col("c").alias("value")),
    )).alias("v")).select("v.*")
    number = F.format_string("%.2f", "o_totalprice")
    return M.provenance(orders.select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("nth"), number.alias("number")), values)


R.add(
    "value_provenance", value_provenance,
    "WITH s AS (SELECT min(o_totalprice) AS a, max(o_totalprice) AS b FROM orders), v AS (SELECT 'orders.min' AS source, 1 AS ord, a AS value FROM s UNION ALL SELECT 'orders.max', 2, b FROM s), k AS (SELECT number, first(source ORDER BY ord) AS source FROM (SELECT source, ord, unnest([printf('%.0f', value), printf('%.1f', value), printf('%.2f', value)]) AS number FROM v) GROUP BY 1), n AS (SELECT o_custkey AS doc_id, o_orderkey AS nth, printf('%.2f', o_totalprice) AS number FROM orders) SELECT doc_id, nth, number, coalesce(source, '') AS source FROM n LEFT JOIN k USING (number)",
)


def hierarchy(s: SparkSession, d: str) -> DataFrame:
    sentences = table(s, d, "orders").select(F.col("o_orderkey").alias("sid"), F.array(F.lower("o_orderstatus"), F.lower(F.substring("o_orderpriority", 3, 20)), F.lit("orders")).alias("tokens"))
    columns = M.table_of(s, [("t1", "highTotal", ["high", "total"]), ("t1", "orders_f", ["orders", "f"]), ("t2", "orders_o", ["orders", "o"]), ("t2", "orders", ["orders"]), ("t3", "orders_all", ["orders", "all"])], "file string, column string, tokens array<string>")
    return M.top_producers(sentences, columns)


R.add(
    "hierarchy_candidates", hierarchy,
    "WITH s AS (SELECT o_orderkey AS sid, list_distinct([lower(o_orderstatus), lower(substr(o_orderpriority, 3, 20)), 'orders']) AS tokens FROM orders), c(file, \"column\", tokens) AS (VALUES ('t1', 'highTotal', ['high', 'total']), ('t1', 'orders_f', ['orders', 'f']), ('t2', 'orders_o', ['orders', 'o']), ('t2', 'orders', ['orders']), ('t3', 'orders_all', ['orders', 'all'])), h AS (SELECT sid, file, \"column\", len(list_intersect(s.tokens, c.tokens)) AS score FROM s, c WHERE len(list_intersect(s.tokens, c.tokens)) > 0) SELECT sid, file, \"column\", score, place FROM (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY score DESC, file, \"column\")::INT AS place FROM h) WHERE place <= 3",
)
R.add(
    "capped_rows", lambda s, d: M.capped_with_gap(table(s, d, "nation").select("n_nationkey", "n_name"), ["n_nationkey"], 20, "note"),
    "SELECT n_nationkey, n_name, '' AS note FROM nation WHERE n_nationkey < 20 UNION ALL SELECT NULL, NULL, 'INCOMPLETE: ' || (count(*) - 20) || ' more' FROM nation HAVING count(*) > 20",
)
R.add(
    "claim_contradiction", lambda s, d: M.contradictions(T.lines_of(table(s, d, "documents").select("doc_id", "text")), r"licensed under cc", r"all rights reserved|general public"),
    "WITH l AS (SELECT doc_id, unnest(range(1, len(p) + 1))::INT AS line, lower(unnest(p)) AS raw FROM (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents)), a AS (SELECT doc_id AS claim_doc, line AS claim_line FROM l WHERE contains(raw, 'licensed under cc') ORDER BY 1, 2 LIMIT 1), b AS (SELECT doc_id AS denial_doc, line AS denial_line FROM l WHERE regexp_matches(raw, 'all rights reserved|general public') ORDER BY 1, 2 LIMIT 1) SELECT * FROM a, b",
)


def near_defects(s: SparkSession, d: str) -> DataFrame:
    """Words of every document line as excerpts, blocked by language and line."""
    docs = table(s, d, "documents")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("pos", "raw"))
    words = F.array_distinct(F.regexp_extract_all(F.lower("raw"), F.lit("[a-z]+"), F.lit(0)))
    rows = lines.select(F.col("doc_id").alias("id"), F.col("lang").alias("class"), F.lit("minor").alias("severity"), (F.col("pos") + 1).alias("line"), F.explode(F.array(words)).alias("words"))  # explode: so that a filter does not compute them again
    return M.near_defects(rows).select("id_a", "id_b", "line", F.round("similarity", 9).alias("similarity"))


R.add(
    "near_defects", near_defects,
    "WITH l AS (SELECT doc_id AS id, lang, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS raw FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS p FROM documents)), r AS MATERIALIZED (SELECT id, lang, line, list_distinct(regexp_extract_all(lower(raw), '[a-z]+')) AS w FROM l WHERE len(list_distinct(regexp_extract_all(lower(raw), '[a-z]+'))) >= 7), c AS (SELECT a.id AS id_a, b.id AS id_b, a.line, len(a.w) AS n, len(b.w) AS m, len(list_intersect(a.w, b.w)) AS k FROM r a JOIN r b ON a.lang = b.lang AND a.line = b.line AND a.id < b.id AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w))) SELECT id_a, id_b, line, round(k / (n + m - k), 9) AS similarity FROM c WHERE k >= 0.8 * (n + m - k)",
)
_REVIEW = "SELECT 'M' || CAST(o_orderkey % 9 AS STRING) AS class, 'p' || CAST(o_custkey % 20 AS STRING) AS location, o_orderpriority || repeat('x', CAST(o_custkey % 3 AS INT) * 40) || CAST(o_custkey % 7 AS STRING) AS evidence FROM orders WHERE o_orderkey % 5 {of}"
_REVIEWS = [_REVIEW.format(of="< 2"), _REVIEW.format(of="> 2")]
R.add(
    "review_merge", lambda s, d: M.merge_reviews(*(select_from(s, d, t, "orders").withColumnRenamed("class", "check") for t in _REVIEWS)),
    f"WITH a AS ({_REVIEWS[0]}), b AS ({_REVIEWS[1]}) SELECT class AS \"check\", location, evidence, 'a' AS part FROM a UNION ALL SELECT *, 'b' FROM b WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.class = b.class AND a.location = b.location AND left(a.evidence, 80) = left(b.evidence, 80))",
)
_COVER = "SELECT 'M' || CAST(c_custkey AS STRING) AS class, CASE CAST(c_nationkey % 3 AS INT) WHEN 0 THEN 'out-of-scope' WHEN 1 THEN 'done' ELSE '{other}' END AS status FROM customer WHERE c_custkey % 3 {of}"
_COVERS = [_COVER.format(other="partial", of="< 2"), _COVER.format(other="unable", of="> 0")]
R.add(
    "coverage_union", lambda s, d: M.coverage_union(*(select_from(s, d, t, "customer").withColumnRenamed("class", "check") for t in _COVERS)),
    f"SELECT class AS \"check\", status FROM (SELECT *, CASE WHEN status = 'out-of-scope' THEN 2 ELSE 0 END AS r FROM ({_COVERS[0]}) UNION ALL SELECT *, 1 FROM ({_COVERS[1]})) QUALIFY row_number() OVER (PARTITION BY class ORDER BY r) = 1",
)


def recorded(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Recorded digests of documents, every seventh of them outdated, and the present ones."""
    docs = table(s, d, "documents").select(F.col("doc_id").cast("string").alias("path"), "doc_id", F.sha2("text", 256).alias("digest"), "source")
    old = docs.select(F.col("source").alias("run"), "path", F.when(F.col("doc_id") % 7 == 0, "old").otherwise(F.col("digest")).alias("digest"), (F.col("doc_id") % 2 == 0).alias("round_done"))
    return old.where("path <> '3'"), docs.where("doc_id <> 5").select("path", "digest")


_OLD = "WITH c AS (SELECT doc_id::VARCHAR AS path, sha256(text) AS digest FROM documents WHERE doc_id <> 5), o AS (SELECT source AS run, doc_id::VARCHAR AS path, CASE WHEN doc_id % 7 = 0 THEN 'old' ELSE sha256(text) END AS digest, doc_id % 2 = 0 AS round_done FROM documents WHERE doc_id <> 3) "
R.add("stale_inputs", lambda s, d: M.staleness(*recorded(s, d)), _OLD + "SELECT run, round_done, count(*) AS n_changed, CASE WHEN round_done THEN 'blocking' ELSE 'stale' END AS state FROM o LEFT JOIN c USING (path) WHERE o.digest IS DISTINCT FROM c.digest GROUP BY 1, 2")
R.add("evidence_integrity", lambda s, d: M.integrity(*recorded(s, d)), _OLD + "SELECT path, CASE WHEN o.digest IS NULL THEN 'added' WHEN c.digest IS NULL THEN 'missing' WHEN o.digest <> c.digest THEN 'changed' ELSE 'same' END AS state FROM o FULL JOIN c USING (path)")
R.add(
    "manifest_digest", lambda s, d: M.manifest_digest(recorded(s, d)[0], ["run"]),
    _OLD + "SELECT run, sha256(string_agg(path || ':' || digest, chr(10) ORDER BY path || ':' || digest)) AS digest, count(*) AS n FROM o GROUP BY 1",
)
R.add(
    "order_violations", lambda s, d: T.order_violations(table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("pos"), F.col("l_partkey").alias("n")), ["l_orderkey"]),
    "WITH f AS (SELECT l_orderkey, l_partkey AS n, min(l_linenumber) AS pos FROM lineitem GROUP BY 1, 2), m AS (SELECT *, max(n) OVER (PARTITION BY l_orderkey ORDER BY pos, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS most FROM f) SELECT l_orderkey, n, pos, most FROM m WHERE n < most",
)


def sentences(rows: DataFrame, key: str) -> DataFrame:
    """key, unit, text: sentences of at least 8 characters and two tokens."""
    each = rows.select(F.col(key).alias("key"), F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("unit", "text"))
    return each.where((F.length("text") >= 8) & (F.regexp_count("text", F.lit(r"[\p{L}\p{N}]+")) >= 2)).withColumn("unit", F.col("unit").cast("long"))


def content_units(s: SparkSession, d: str) -> DataFrame:
    """Sentences of each benchmark passage against those of every document that holds it."""
    docs, items = table(s, d, "documents"), table(s, d, "benchmark")
    pairs = contained(docs, items).withColumn("key", F.concat_ws(":", "doc_id", "item_id"))
    base = pairs.join(items.select("item_id", "text"), "item_id").select("key", "text")
    return M.match_units(sentences(base, "key"), sentences(pairs.join(docs.select("doc_id", "text"), "doc_id").select("key", "text"), "key"))


R.add("content_unit_match", content_units)


def located(s: SparkSession, d: str) -> DataFrame:
    """Lines of documents as defects of their source, merged by location; some name their document."""
    rows = T.lines_of(table(s, d, "documents").select("doc_id", "text")).join(table(s, d, "documents").select("doc_id", "lang", "source"), "doc_id")
    words = F.regexp_extract_all(F.lower("raw"), F.lit("[a-z]+"), F.lit(0))
    named = F.when(F.col("doc_id") % 3 > 0, (F.col("doc_id") % 2).cast("string"))
    return M.merge_by_location(rows.select(
        (F.col("doc_id") * 1_000_000 + F.col("line")).alias("id"), F.col("source").alias("version"), F.lit("own").alias("source"), F.col("lang").alias("class"),
        F.lit("minor").alias("severity"), "line", words.alias("words"), named.alias("document"),
    ))


R.add(
    "location_dedup", located,
    """WITH RECURSIVE l AS (SELECT doc_id, lang, source, unnest(range(1, len(p) + 1))::INT AS line, unnest(p) AS raw FROM (SELECT doc_id, lang, source, string_split(text, chr(10)) AS p FROM documents)),
    r AS MATERIALIZED (SELECT doc_id * 1000000 + line AS id, source AS version, lang AS class, line, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 2)::VARCHAR END AS document, regexp_extract_all(lower(raw), '[a-z]+') AS words FROM l),
    s AS MATERIALIZED (SELECT *, list_distinct(words) AS w FROM r WHERE len(words) >= 7),
    e AS MATERIALIZED (SELECT a.id AS a, b.id AS b FROM s AS a JOIN s AS b ON a.version = b.version AND a.class = b.class AND a.line = b.line AND a.id < b.id AND coalesce(a.document = b.document, true)
      AND least(len(a.w), len(b.w)) >= 0.8 * greatest(len(a.w), len(b.w)) AND len(list_intersect(a.w, b.w)) >= 0.8 * (len(a.w) + len(b.w) - len(list_intersect(a.w, b.w)))),
    walk AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS kept, []::BIGINT[] AS gone UNION ALL
      SELECT n + 1, list_concat(kept, (SELECT coalesce(list(DISTINCT e.b), []) FROM e WHERE NOT list_contains(gone, e.b) AND NOT list_contains(kept, e.b) AND NOT EXISTS (SELECT 1 FROM e AS f WHERE f.b = e.b AND NOT list_contains(gone, f.a)))),
        list_concat(gone, (SELECT coalesce(list(DISTINCT e.b), []) FROM e WHERE NOT list_contains(gone, e.b) AND (list_contains(kept, e.a) OR e.a NOT IN (SELECT g.b FROM e AS g)))) FROM walk WHERE n < 12),
    last AS (SELECT * FROM walk WHERE n = 12), t AS (SELECT b, min(a) AS target FROM e, last WHERE NOT list_contains(gone, a) GROUP BY b)
    SELECT id, version, 'own' AS source, target IS NULL AS counted, target AS merged_into FROM r LEFT JOIN t ON b = id""",
)


_CHECK = "SELECT CAST(event_id AS BIGINT) AS event_id, CASE CAST(event_id % 7 AS INT) WHEN 0 THEN 'M0' || CAST(user_id % 10 AS STRING) WHEN 1 THEN 'm' || CAST(user_id * 7 AS STRING) WHEN 2 THEN ' M12 ' WHEN 3 THEN 'fmt-T' || CAST(user_id % 9 AS STRING) WHEN 4 THEN 'Q' || CAST(user_id AS STRING) WHEN 5 THEN 'J' || CAST(user_id % 5 AS STRING) ELSE ' ' || event_type END AS name FROM events"
R.add(
    "defect_classes", lambda s, d: select_from(s, d, _CHECK, "events").select("event_id", F.col("name").alias("check"), X.defect_class(F.col("name")).alias("class")),
    f"""SELECT event_id, name AS "check", CASE WHEN starts_with(n, 'FMT-') THEN 'M20' WHEN regexp_full_match(n, 'Q[0-9]+') THEN 'J3' WHEN regexp_full_match(n, 'M[0-9]+') THEN 'M' || lpad((substr(n, 2)::INT)::VARCHAR, greatest(2, length((substr(n, 2)::INT)::VARCHAR))::INT, '0') ELSE n END AS class
    FROM (SELECT *, upper(trim(name)) AS n FROM ({_CHECK}))""",
)
_LETTERS = "SELECT CAST(o_orderkey AS BIGINT) AS o_orderkey, CASE WHEN o_custkey % 3 > 0 THEN chr(CAST(65 + o_custkey % 26 AS INT)) ELSE '' END || CASE WHEN o_custkey % 2 = 0 THEN chr(CAST(97 + o_custkey % 26 AS INT)) ELSE '' END || chr(CAST(65 + o_orderkey % 26 AS INT)) AS letters FROM orders"
R.add(
    "column_letters", lambda s, d: select_from(s, d, _LETTERS, "orders").select("o_orderkey", "letters", X.column_index(F.col("letters")).alias("n")),
    f"SELECT o_orderkey, letters, list_reduce(list_transform(string_split(upper(letters), ''), lambda c: ascii(c) - 64), lambda a, b: a * 26 + b)::INT AS n FROM ({_LETTERS})",
)
R.add(
    "benchmark_containment", lambda s, d: containment(s, d),
    "SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
)


def containment(s: SparkSession, d: str) -> DataFrame:
    """Documents that hold a benchmark passage: an extension."""
    return contained(table(s, d, "documents"), table(s, d, "benchmark"))


def contained(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id: one scan of the texts with an automaton over the passages."""
    hits = phrases_in(docs, benchmark.select(F.col("item_id").alias("key"), F.col("text").alias("phrase")))
    return hits.withColumnRenamed("key", "item_id").distinct()


_SPAN = "SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey, l_linenumber, CAST(l_linenumber AS STRING) || CASE WHEN l_partkey % 3 > 0 THEN '-' || CAST(l_partkey % 9 AS STRING) ELSE '' END AS span FROM lineitem"


def display_ranges(s: SparkSession, d: str) -> DataFrame:
    """Display numbers filled from ranges: the least and greatest, each number between."""
    a = F.regexp_extract("span", "^([0-9]+)", 1).cast("int")
    b = F.coalesce(F.nullif(F.regexp_extract("span", "-([0-9]+)$", 1), F.lit("")).cast("int"), a)
    return select_from(s, d, _SPAN, "lineitem").select("l_orderkey", "l_linenumber", "span", F.explode(F.sequence(F.least(a, b), F.greatest(a, b))).alias("number"))


R.add(
    "display_ranges", display_ranges,
    f"WITH e AS (SELECT *, list_transform(string_split(span, '-'), lambda x: x::INT) AS ends FROM ({_SPAN})) SELECT l_orderkey, l_linenumber, span, unnest(range(list_min(ends), list_max(ends) + 1))::INT AS number FROM e",
)
R.add(
    "running_rank", lambda s, d: table(s, d, "customer").select("c_custkey", "c_mktsegment", F.row_number().over(Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")).alias("place")).where("place <= 3"),
    "SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INT AS place FROM customer QUALIFY place <= 3",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
