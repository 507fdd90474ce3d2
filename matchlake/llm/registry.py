"""All queries of this subpackage, with their SQL where SQL expresses them."""

from __future__ import annotations

from matchlake.llm import digest, divergence, extraction, language_model, neighbours, packing, pieces, quality, secrets, simhash, substring_dedup, url_filter, whitening

MODULES = (neighbours, url_filter, quality, secrets, substring_dedup, pieces, packing, language_model, digest, simhash, whitening, divergence, extraction)
QUERIES = {name: f for m in MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
