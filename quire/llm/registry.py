"""The queries of this package and their SQL."""

from . import html_text, importance, lz_fingerprint, merkle, ngram_join, packing, piece_sampling, pii, quality_rules, sharding, token_counts, token_files, url_filter

MODULES = (sharding, ngram_join, pii, token_files, quality_rules, piece_sampling, lz_fingerprint, html_text, packing, token_counts, url_filter, importance, merkle)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
