"""All registered queries over the given tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from spreadloom.plans import assessment_queries, cluster_queries, feature_queries, job_queries, moment_queries, pair_queries, parts_queries, pipeline_queries, registry, series_queries, spectral_queries, stream_queries, table_queries, universe_queries, window_queries  # noqa: F401  registration happens on import

FLAGSHIP = "j02_pair_ranking"


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
