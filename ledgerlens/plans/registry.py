"""All queries of the library's own operators and their SQL."""

from __future__ import annotations

from . import box_queries, composed_queries, fixture_queries, index_queries, label_queries, more_queries, parsing_queries, recipe_queries, survey_queries, table_queries  # noqa: F401  each module registers its queries

QUERIES, SQL = table_queries.QUERIES, table_queries.SQL
