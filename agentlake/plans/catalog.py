"""Every registered query by name, and the DuckDB SQL that must give the same rows."""

from agentlake.plans import corpus, evaluation, governance, retrieval, runs, stores, streams

_PLANS = (retrieval, evaluation, governance, corpus, runs, stores, streams)

QUERIES = {name: query for plan in _PLANS for name, query in plan.QUERIES.items()}
SQL = {name: sql for plan in _PLANS for name, sql in plan.SQL.items()}
