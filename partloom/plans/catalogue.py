"""All registered queries of the core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from partloom.operators import timestamps, units
from partloom.plans import family_queries, index_queries, source_queries, split_queries, vector_queries

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p4_found": timestamps.p4_found,
    "p4_status": timestamps.p4_status,
    "p7_found": units.p7_found,
    "p7_decoded": units.p7_decoded,
    "p7_holdout": units.p7_holdout,
    **index_queries.QUERIES,
    **split_queries.QUERIES,
    **vector_queries.QUERIES,
    **family_queries.QUERIES,
    **source_queries.QUERIES,
}
SQL: dict[str, str] = {**index_queries.SQL, **split_queries.SQL, **vector_queries.SQL, **family_queries.SQL, **source_queries.SQL}
