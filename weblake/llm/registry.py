"""All registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from weblake.llm import queries_columns, queries_models, queries_pairs, queries_trees

QUERIES = {**queries_columns.QUERIES, **queries_models.QUERIES, **queries_pairs.QUERIES, **queries_trees.QUERIES}
ORACLES = {**queries_columns.ORACLES, **queries_models.ORACLES, **queries_pairs.ORACLES, **queries_trees.ORACLES}
