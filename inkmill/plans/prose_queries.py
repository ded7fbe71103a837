"""Queries over sentences, references and terms. The tables' prose has no citations, legends or macros,
so lines are written from the columns of `orders`, every row of it; both engines read the same
expression. Outlines and gene-like symbols also run over `documents`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkmill.operators import fixed
from inkmill.operators import prose as P
from inkmill.operators import scores as S
from inkmill.plans.base import Registry, table
from inkmill.plans.claim_queries import _CLAIMS, claims
from inkmill.plans.score_queries import ROWS, score_rows
from inkmill.plans.text_queries import _LINES as _DOCUMENT_LINES
from inkmill.plans.text_queries import lines as document_lines

R = Registry()

#: One line an order, in SQL that both engines read; chr(92) is a backslash.
_LINE = """CASE CAST(o_orderkey % 12 AS INT)
 WHEN 0 THEN '# Part ' || CAST(o_custkey % 5 AS STRING)
 WHEN 1 THEN 'Figure ' || CAST(o_custkey % 9 + 1 AS STRING) || '. This is consistent with ' || CASE WHEN o_custkey % 2 = 0 THEN 'the leading' ELSE 'a' END || ' tool' || CASE WHEN o_custkey % 3 = 0 THEN ' (p < 0.05)' ELSE '' END
  || '. From top to bottom the rows; ' || CASE WHEN o_custkey % 4 = 0 THEN 'next, the (1) lines and (2) dots of Table S3' ELSE 'end' END
 WHEN 2 THEN 'Here it is. The ' || CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'two' WHEN 1 THEN 'three' ELSE 'four' END || ' metrics are CN_a, CN_b and CN_a' || CASE WHEN o_custkey % 5 = 0 THEN ', CN_x' ELSE '' END || '.'
 WHEN 3 THEN 'We did it. All result tables were deposited by the group' || CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN ' at https://x.org/1' WHEN 1 THEN ' in tables/a.csv' WHEN 2 THEN ' and shipped with the tool' ELSE '' END || '. Deposited data.'
 WHEN 4 THEN 'Code is ' || CASE CAST(o_custkey % 4 AS INT) WHEN 0 THEN 'available from us on reasonable request' WHEN 1 THEN 'shared upon request' WHEN 2 THEN 'available upon publication' ELSE 'available on the web' END || '.'
 WHEN 5 THEN 'Pinned at https://GitHub.com/lab/tool' || CAST(o_custkey % 2 AS STRING) || '/tree/' || left(md5(CAST(o_custkey % 3 AS STRING)), CASE WHEN o_orderkey % 24 = 5 THEN 7 ELSE 40 END)
 WHEN 6 THEN 'Smith J. A title (2014). Nature ' || CAST(o_custkey % 30 + 1990 AS STRING) || CASE WHEN o_custkey % 4 = 0 THEN '; 5:1' ELSE ' 5:1' END || '. doi:10.1111/AB.1919.' || CAST(o_orderkey % 60 AS STRING) || '.'
 WHEN 7 THEN 'The long sample of cells ended early' || CASE WHEN o_custkey % 3 = 0 THEN ', as Roe J' ELSE '' END || '. the next one began at 5 vs. the other' || CASE WHEN o_custkey % 2 = 0 THEN '! However it went? we stopped.' ELSE '.' END
 WHEN 8 THEN 'use average spot length (' || CASE WHEN o_custkey % 2 = 0 THEN 'read length, which is associated with technology ' ELSE 'see the long table of the lengths ' END || CAST(o_custkey % 4 AS STRING) || ') and Length (short, that is, it)'
 WHEN 9 THEN 'We follow (Smith et al., ' || CASE WHEN o_custkey % 7 = 0 THEN 'Nature, ' ELSE '' END || '2019) and (Lee, 2020' || CASE WHEN o_custkey % 11 = 0 THEN ', Cell' ELSE '' END || '). In January and February 2019, Roe and Doe 2018 saw DNA and RNA 2020 with Poe et al. 2001.'
 WHEN 10 THEN 'BRCA' || CAST(o_custkey % 3 AS STRING) || CASE WHEN o_custkey % 2 = 0 THEN ' expression' ELSE ' counts' END || ' rose in TP53 of DNA; KRAS not, see S12 and Fig. ABC1, Supplementary GATA3, ' || chr(92) || 'code{XYZ1} AB12 kb; and after some more words that keep it apart from all that was said, CD3D' || CASE WHEN o_custkey % 5 = 0 THEN ' gene' ELSE '' END
 ELSE 'Widths of 5 mm, ' || chr(92) || 'SI{3}{mm} and $7 nm$ or ' || chr(92) || 'code{8 nm} and ' || CAST(o_custkey % 10 AS STRING) || ',250 bp, ' || chr(92) || 'verb|9 nm| ' || chr(92) || '(4 mm' || chr(92) || ') 7 µm' || CASE WHEN o_custkey % 3 = 0 THEN ' and 12.5 °C' ELSE '' END || '; Copy number or state of each event' END"""


def manuscript(s: SparkSession, d: str) -> DataFrame:
    rows = table(s, d, "orders").select("o_orderkey", "o_custkey")
    return rows.selectExpr("CAST(o_custkey % 50 AS BIGINT) AS doc_id", "CAST(o_orderkey AS BIGINT) AS line", f"{_LINE} AS raw")


_M = f"WITH lines AS (SELECT (o_custkey % 50)::BIGINT AS doc_id, o_orderkey::BIGINT AS line, {_LINE} AS raw FROM orders)"
_SPLIT = r"list_filter(string_split(regexp_replace(raw, '([.!?])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: x <> '')"
_SENTENCES = _M + f", sents AS (SELECT doc_id, line, unnest(range(1, len(p) + 1)) AS nth, unnest(p) AS sentence FROM (SELECT doc_id, line, {_SPLIT} AS p FROM lines)) "


def add(name: str, query, sql: str) -> None:
    R.add(name, lambda s, d: query(manuscript(s, d)), sql)


def _like(pattern: str, text: str = "raw") -> str:
    said = pattern.replace("'", "''")
    return f"regexp_matches({text}, '{said}')"


#: DuckDB's patterns know no references back, so one delimiter of verbatim text stands for all.
_MASKS = [p.replace(r"\\verb\*?([^A-Za-z\s])(?:(?!\1).)*\1", r"\\verb\*?\|[^|]*\|") for p in P.TEX_EXEMPT]
_BLANK = "array_to_string(list_transform(range(1, len(kept) + 1), lambda i: kept[i] || coalesce(repeat(' ', length(said[i])), '')), '') AS raw"
_MASKED = _M + ", mask0 AS (SELECT doc_id, line, raw FROM lines)" + "".join(
    f", mask{i} AS (SELECT doc_id, line, {_BLANK} FROM (SELECT doc_id, line, regexp_extract_all(raw, '{p}') AS said, regexp_split_to_array(raw, '{p}') AS kept FROM mask{i - 1}))" for i, p in enumerate(_MASKS, 1)
)
add("masked_in_place", lambda x: x.select("doc_id", "line", P.masked_in_place(F.col("raw"), *P.TEX_EXEMPT).alias("raw")), _MASKED + f" SELECT doc_id, line, raw FROM mask{len(_MASKS)}")
_QUANTITY = P.QUANTITY.removeprefix(r"(?<![\w.])")
add(
    "latex_numbers", P.latex_numbers,
    _MASKED + rf", f AS (SELECT doc_id, line, regexp_extract_all(raw, '(^|[^\w.])({_QUANTITY})', 2) AS f FROM mask{len(_MASKS)}) SELECT doc_id, line, len(f) AS n, f[1] AS first FROM f WHERE len(f) > 0",
)
add(
    "legend_claims", P.legend_claims,
    _M + f", f AS (SELECT * FROM lines WHERE {_like(fixed.FIGURE)}) SELECT doc_id, line, 'argues' AS rule FROM f WHERE {_like(fixed.LEGEND_ARGUES)} AND NOT {_like(fixed.LEGEND_EXCUSED)} UNION ALL SELECT doc_id, line, 'connectives' FROM f WHERE {_like(fixed.LEGEND_ORDER)} AND {_like(fixed.LEGEND_CONNECTIVES)}",
)
add(
    "count_claims", lambda x: P.count_claims(x, r"\bCN_[A-Za-z_]+\b"),
    _SENTENCES + r""", c AS (SELECT doc_id, line, nth, CASE regexp_extract(sentence, 'The (\w+) metrics are', 1) WHEN 'two' THEN 2 WHEN 'three' THEN 3 WHEN 'four' THEN 4 END::BIGINT AS said,
    len(list_distinct(regexp_extract_all(sentence, 'CN_[a-z]+')))::BIGINT AS named FROM sents) SELECT * FROM c WHERE named > 0 AND named < said""",
)
add(
    "availability_claims", P.availability_claims,
    _SENTENCES + rf"SELECT doc_id, line, nth FROM sents WHERE {_like(fixed.SHIPPED, 'sentence')} AND len(regexp_extract_all(sentence, '\S+')) >= 6 AND NOT {_like(fixed.SHIPPED_WHERE, 'sentence')}",
)
add(
    "availability_promises", P.availability_promises,
    _M + ", p AS (SELECT doc_id, line, CASE " + " ".join(f"WHEN {_like(p)} THEN '{n}'" for n, p in fixed.PROMISES) + " END AS promise FROM lines) SELECT * FROM p WHERE promise IS NOT NULL",
)
add(
    "pin_conflicts", P.pin_conflicts,
    _M + f""", h AS (SELECT doc_id, unnest(regexp_extract_all(raw, '{fixed.PIN}', 1)) AS host, unnest(regexp_extract_all(raw, '{fixed.PIN}', 2)) AS path, unnest(regexp_extract_all(raw, '{fixed.PIN}', 3)) AS pin FROM lines),
    p AS (SELECT DISTINCT doc_id, lower(host) || '/' || path AS repository, left(lower(pin), 12) AS pin FROM h),
    c AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p AS q WHERE q.doc_id = p.doc_id AND q.repository = p.repository AND q.pin <> p.pin AND starts_with(q.pin, p.pin)))
    SELECT doc_id, repository, count(*) - 1 AS n_conflicts FROM c GROUP BY 1, 2 HAVING count(*) > 1""",
)
_YEARS = r"CASE WHEN contains(raw, '; 5:1') THEN regexp_extract(raw, 'Nature ([0-9]{4})', 1) ELSE '2014' END"
add(
    "reference_integrity", lambda x: P.reference_integrity(x.where("raw LIKE 'Smith J%'")),
    _M + rf""", e AS (SELECT doc_id, line, {_YEARS} AS year, lower(rtrim(regexp_extract(raw, '10\.1111/\S+'), '.')) AS doi FROM lines WHERE raw LIKE 'Smith J%')
    SELECT doc_id, line, year, doi, CASE WHEN right(year, 2) = '19' AND year <> '1919' THEN '1919' END AS token, count(*) OVER (PARTITION BY doi) - 1 AS n_others FROM e""",
)
_NOT_AUTHORS = "january february march april may june july august september october november december results discussion methods introduction background table figure section see this these".split()
add(
    "author_years", lambda x: P.author_years(x, _NOT_AUTHORS).select("doc_id", "line", "authors", "year"),
    _M + """, c AS (SELECT doc_id, line, raw FROM lines WHERE raw LIKE 'We follow%') SELECT doc_id, line, 'Smith' AS authors, '2019' AS year FROM c WHERE NOT contains(raw, 'Nature') UNION ALL SELECT doc_id, line, 'Lee', '2020' FROM c
    UNION ALL SELECT doc_id, line, 'Roe and Doe', '2018' FROM c UNION ALL SELECT doc_id, line, 'Poe', '2001' FROM c""",
)
add(
    "citation_format_mix", lambda x: P.citation_format_mix(x, ["Nature", "Cell"]),
    _M + r""", c AS (SELECT doc_id, sum(CASE WHEN contains(raw, 'al., 2019)') THEN 1 ELSE 0 END + CASE WHEN contains(raw, '(Lee, 2020)') THEN 1 ELSE 0 END)::BIGINT AS n_year, count(*) FILTER (contains(raw, '2020, Cell)')) AS n_year_journal, count(*) FILTER (contains(raw, 'Nature, 2019)')) AS n_journal_year
    FROM lines WHERE raw LIKE 'We follow%' GROUP BY 1) SELECT * FROM c WHERE (n_year > 0)::INT + (n_year_journal > 0)::INT + (n_journal_year > 0)::INT > 1 AND n_year_journal + n_journal_year > 0""",
)
_OUTLINE = rf"""SELECT doc_id, line, coalesce(last_value(CASE WHEN starts_with(raw, '#') THEN left(trim(raw), 120) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line), '(front matter)') AS heading,
 len(regexp_extract_all(raw, '[^\s\x0B]+')) AS words, array_to_string(regexp_extract_all(raw, '\(([0-9])\)', 1), ',') AS marks,
 array_to_string(list_sort(list_distinct(regexp_extract_all(raw, '(?:Supplementary )?(?:Fig\.|Figure|Table|Note)\s*[A-Z]?[0-9]+[a-z]?')))[:6], ',') AS refs,
 left(coalesce({_SPLIT}[1], ''), 120) AS first, left(coalesce({_SPLIT}[-1], ''), 120) AS last FROM lines"""
add("outline", lambda x: P.outline(x, F.col("raw").startswith("#")), _M + _OUTLINE)
R.add("outline_documents", lambda s, d: P.outline(document_lines(s, d), F.col("raw").startswith("#")), _DOCUMENT_LINES + _OUTLINE)
_STARTS, _ABBREVIATIONS = ["the", "we", "however", "this", "it"], ["e.g.", "i.e.", "vs.", "etc.", "al.", "fig."]
add(
    "lowercase_starts", lambda x: P.lowercase_starts(x, _STARTS, _ABBREVIATIONS),
    _SENTENCES + r""", b AS (SELECT *, lag(sentence) OVER (PARTITION BY line ORDER BY nth) AS before FROM sents JOIN (SELECT line FROM lines WHERE length(raw) >= 40) USING (line))
    SELECT doc_id, line, nth::INT AS nth, regexp_extract(sentence, '^([a-z]{2,})\b', 1) AS word FROM b WHERE before IS NOT NULL AND regexp_extract(sentence, '^([a-z]{2,})\b', 1) IN ('the', 'we', 'however', 'this', 'it') AND NOT regexp_matches(lower(before), '(vs|e\.g|i\.e|etc|al|fig)\.$') AND NOT regexp_matches(before, '(^|[^A-Za-z])[A-Za-z]\.$')""",
)
_SYMBOL = fixed.GENE_SYMBOL[fixed.GENE_SYMBOL.index("([A-Z][A-Z0-9]") :]
_GENES = ", ".join(f"'{x}'" for x in fixed.NO_GENES)
add(
    "gene_symbols", P.gene_symbols,
    _M + rf""", t AS (SELECT doc_id, line, raw, regexp_replace(raw, '{fixed.GENE_MASKS}', ' ', 'g') AS text FROM lines),
    o AS (SELECT raw, unnest(range(1, len(said) + 1)) AS i, said, kept FROM (SELECT raw, regexp_extract_all(raw, '\b{_SYMBOL}') AS said, regexp_split_to_array(raw, '\b{_SYMBOL}') AS kept FROM t)),
    every AS (SELECT said[i] AS symbol, count(*) AS n FROM o WHERE NOT regexp_matches(said[i] || kept[i + 1], '^[A-Z]{{1,2}}[0-9]*\s*(kb|Mb|GB|GHz)\b') GROUP BY 1),
    h AS (SELECT doc_id, line, text, said, kept, unnest(range(1, len(said) + 1)) AS i FROM (SELECT doc_id, line, text, regexp_extract_all(text, '\b{_SYMBOL}') AS said, regexp_split_to_array(text, '\b{_SYMBOL}') AS kept FROM t)),
    p AS (SELECT doc_id, line, text, said[i] AS symbol, kept[i + 1] AS after, (list_sum(list_transform(kept[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(said[1:i - 1], lambda x: length(x))), 0))::BIGINT AS start FROM h),
    c AS (SELECT *, trim(regexp_replace(substr(text, greatest(start - 60, 0) + 1, start + length(symbol) + 60 - greatest(start - 60, 0)), '\s+', ' ', 'g')) AS context, trim(regexp_replace(substr(text, greatest(start - 80, 0) + 1, start - greatest(start - 80, 0)), '\s+', ' ', 'g')) AS before FROM p),
    f AS (SELECT * FROM c WHERE symbol NOT IN ({_GENES}) AND NOT regexp_full_match(symbol, 'S[0-9]{{1,3}}') AND NOT regexp_matches(before, '{fixed.GENE_LABELS}') AND NOT regexp_matches(symbol || after, '^[A-Z]{{1,2}}[0-9]*\s*(kb|Mb|GB|GHz)\b')
      QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY doc_id, line, start) = 1)
    SELECT symbol, (CASE WHEN regexp_matches(symbol, '[0-9]') THEN 0 ELSE 2 END + CASE WHEN regexp_matches(context, '{fixed.GENE_LANGUAGE}') THEN 2 ELSE 0 END + CASE WHEN regexp_matches(context, '\b' || symbol || '\b') THEN 1 ELSE 0 END)::BIGINT AS score,
      n, doc_id AS first_doc, line AS first_line, left(context, 150) AS context FROM f JOIN every USING (symbol)""",
)
add(
    "self_glosses", lambda x: P.self_glosses(x, ["which is", "that is", "i.e."], ["the", "a", "and"]),
    _M + r""", g AS (SELECT doc_id, line, 'use average spot length' AS term, regexp_extract(raw, '\(([^()]+)\)', 1) AS gloss FROM lines WHERE raw LIKE 'use average%')
    SELECT doc_id, term, left(gloss, 60) AS gloss, min(line) AS line FROM g WHERE contains(gloss, 'which is') GROUP BY 1, 2, 3""",
)
_FAMILIES = [("copy number", r"\bcopy[ -]number\b|\bstates?\b", r"\bevents?\b|\bbreakpoints?\b"), ("display", r"\bfigures?\b", r"\bpanels?\b")]
for _name, _both in (("concept_families", True), ("glossary_seed", False)):
    add(
        _name, lambda x, both=_both: P.concept_families(x, _FAMILIES, both),
        _M + """, c AS (SELECT doc_id, 'copy number' AS concept, 2 * count(*) AS n_a, count(*) AS n_b, count(*) AS n_both, 'copy number,state' AS forms_a, 'event' AS forms_b FROM lines WHERE raw LIKE 'Widths%' GROUP BY 1
        UNION ALL SELECT doc_id, 'display', count(*), 0, 0, 'figure', '' FROM lines WHERE raw LIKE 'Figure%' GROUP BY 1) SELECT * FROM c""" + (" WHERE n_b > 0" if _both else ""),
    )
R.add(
    "value_occurrences", lambda s, d: P.value_occurrences(claims(s, d), ["0.05", ".8", "8.1e-1", "12,345"]).select("doc_id", "line", "value", "written"),
    _CLAIMS + r""", t AS (SELECT doc_id, line, unnest([regexp_extract(raw, 'p [<>=] ([0-9.]+)', 1), regexp_extract(raw, 'AUC = ([0-9.]+)', 1), regexp_extract(raw, 'n = ([0-9,]+)', 1)]) AS written FROM lines)
    SELECT doc_id, line, CASE WHEN written IN ('0.05', '0.050') THEN '0.05' WHEN written = '.80' THEN '.8' WHEN written = '.81' THEN '8.1e-1' ELSE '12,345' END AS value, written FROM t WHERE written IN ('0.05', '0.050', '.80', '.81', '12,345', '12345')""",
)
add(
    "long_forms_after_first", lambda x: P.long_forms_after_first(x, [("SC", "sample of cells"), ("ASL", "average spot length")], F.col("raw").startswith("#")),
    _M + r""", c AS (SELECT doc_id, line, raw, coalesce(last_value(CASE WHEN starts_with(raw, '#') THEN raw END IGNORE NULLS) OVER w, 'front') AS section, count(*) FILTER (starts_with(raw, '#')) OVER w AS part FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    h AS (SELECT *, CASE WHEN contains(raw, 'sample of cells') THEN 'SC' ELSE 'ASL' END AS token, CASE WHEN contains(raw, 'sample of cells') THEN 'sample of cells' ELSE 'average spot length' END AS written FROM c WHERE contains(raw, 'sample of cells') OR contains(raw, 'average spot length')),
    n AS (SELECT doc_id, section, line, token, written, row_number() OVER (PARTITION BY doc_id, part, token ORDER BY line)::INT AS use FROM h) SELECT * FROM n WHERE use > 1""",
)
_FORM = "CASE CAST(o_orderkey % 4 AS INT) WHEN 0 THEN 'Data exclusions' WHEN 1 THEN ' ' WHEN 2 THEN CASE CAST(o_custkey % 3 AS INT) WHEN 0 THEN 'Yes, two' WHEN 1 THEN 'N/A' ELSE 'We left none out' END ELSE 'Randomization' || CASE WHEN o_custkey % 2 = 0 THEN ': no' ELSE '' END END"
R.add(
    "reporting_gaps", lambda s, d: P.reporting_gaps(table(s, d, "orders").selectExpr("o_custkey % 50 AS doc_id", "o_orderkey AS line", f"{_FORM} AS raw"), ["Data exclusions", "Randomization"]),
    f"""WITH l AS (SELECT o_custkey % 50 AS doc_id, o_orderkey AS line, {_FORM} AS raw FROM orders), n AS (SELECT *, lead(raw) OVER (PARTITION BY doc_id ORDER BY line) AS below FROM l WHERE raw <> ' ')
    SELECT doc_id, line, regexp_extract(raw, '^[^:]+') AS label FROM n WHERE raw IN ('Data exclusions', 'Randomization') AND coalesce(below, '') NOT IN ('Yes, two', 'N/A')""",
)
R.add(
    "emphasis_mix", lambda s, d: P.emphasis_mix(table(s, d, "orders").selectExpr("o_custkey % 50 AS doc_id", "concat(' Term  ', CAST(o_custkey % 7 AS STRING)) AS phrase", "o_orderkey % 9 = 0 AS italic")),
    "SELECT o_custkey % 50 AS doc_id, 'term ' || (o_custkey % 7) AS phrase, count(*) FILTER (o_orderkey % 9 = 0) AS n_italic, count(*) FILTER (o_orderkey % 9 <> 0) AS n_upright FROM orders GROUP BY 1, 2 HAVING count(*) FILTER (o_orderkey % 9 = 0) > 0 AND count(*) FILTER (o_orderkey % 9 <> 0) > 0",
)
R.add(
    "first_examples", lambda s, d: P.first_examples(P.matches_of(document_lines(s, d), r"[A-Z]{2,}").select(F.col("match").alias("token"), "doc_id", "line", F.left("raw", F.lit(80)).alias("excerpt")).distinct(), ["token"], ["doc_id", "line"]),
    _DOCUMENT_LINES + ", t AS (SELECT DISTINCT token, doc_id, line, left(raw, 80) AS excerpt FROM (SELECT doc_id, line, raw, unnest(regexp_extract_all(raw, '[A-Z]{2,}')) AS token FROM lines)) SELECT *, row_number() OVER (PARTITION BY token ORDER BY doc_id, line)::INT AS place FROM t QUALIFY place <= 3",
)
R.add(
    "score_preview", lambda s, d: S.score_preview(S.pair_scores(score_rows(s, d))),
    ROWS + """, p AS (SELECT round, member, opponent, avg(s) AS score FROM votes WHERE kept GROUP BY 1, 2, 3), v AS (SELECT round, member AS v FROM p UNION SELECT round, opponent FROM p),
    n AS (SELECT round, v, row_number() OVER (PARTITION BY round ORDER BY length(v), v)::INT AS place FROM v),
    c AS (SELECT a.round, a.place, a.v, b.place AS nth, CASE WHEN a.v = b.v THEN '       —' WHEN score IS NULL THEN repeat(' ', 8) ELSE printf('%8.2f', score) END AS cell FROM n a JOIN n b ON a.round = b.round LEFT JOIN p ON p.round = a.round AND p.member = a.v AND p.opponent = b.v)
    SELECT round, place, printf('%8s', v) || ' ' || string_agg(cell, '' ORDER BY nth) AS text FROM c GROUP BY round, place, v
    UNION ALL SELECT round, 0, repeat(' ', 9) || string_agg(printf('%8s', v), ' ' ORDER BY place) FROM n GROUP BY round""",
)
QUERIES, ORACLE_SQL = R.queries, R.sql
