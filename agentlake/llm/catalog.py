"""The queries of this package by name, and DuckDB SQL for those that SQL can express."""

from . import op01_token_counts, op02_substrings, op03_embeddings, op04_mixing, op05_packing, op06_pii, op07_audio, op08_simhash, op09_quality, op10_chat, op11_phrases, op12_lexical, op13_manifest

_MODULES = (op01_token_counts, op02_substrings, op03_embeddings, op04_mixing, op05_packing, op06_pii, op07_audio, op08_simhash, op09_quality, op10_chat, op11_phrases, op12_lexical, op13_manifest)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in _MODULES for name, sql in module.SQL.items()}
