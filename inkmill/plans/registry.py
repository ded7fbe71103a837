"""Registry of the queries of the reference's own operators and their DuckDB SQL."""

from __future__ import annotations

from inkmill.plans import argument_queries, census_queries, claim_queries, contact_queries, delimited_queries, dictionary_queries, match_queries, paper_queries, policy_queries, prose_queries, provenance_queries, score_queries, slot_queries, text_queries

FLAGSHIP = "pair_score_mean"
_MODULES = (score_queries, census_queries, text_queries, match_queries, claim_queries, prose_queries, paper_queries, dictionary_queries, provenance_queries, slot_queries, argument_queries, delimited_queries, policy_queries, contact_queries)
QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
