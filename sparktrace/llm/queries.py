"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from sparktrace.llm import decontaminate, embedding_dedup, language_id, mixing, near_dedup, pii, quality_classifier, quality_rules, ranked_search, sharding, token_counts, vector_codes, warc

MODULES = (sharding, warc, token_counts, quality_rules, decontaminate, mixing, quality_classifier, near_dedup, pii, language_id, vector_codes, ranked_search, embedding_dedup)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
SQL = {k: s for m in MODULES for k, s in m.SQL.items()}
