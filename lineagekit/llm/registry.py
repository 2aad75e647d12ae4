"""The queries of this subpackage."""

from . import bpe, byte_bpe, embedding_dedup, exact_dedup, jaccard_join, lexical_search, lm_scoring, packing, prefix_trie, quality, toxicity, url_filter, warc

MODULES = (url_filter, exact_dedup, toxicity, embedding_dedup, lm_scoring, jaccard_join, packing, bpe, quality, warc, byte_bpe, lexical_search, prefix_trie)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
