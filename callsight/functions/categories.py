"""Endpoint categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.urls import bare_host
from callsight.functions.vendors import is_tracking_host


def categorize(
    host: Column, path: Column, method: Column, mime: Column, seed_host: Column, is_graphql: Column
) -> Column:
    """``struct(category, heuristic)``; the first rule that holds decides.

    ``host`` and ``path`` are null when the URL is invalid.
    """
    lower_path = F.lower(path)
    home = F.coalesce(bare_host(host) == bare_host(seed_host), F.lit(False))

    def verdict(category: str, heuristic: str) -> Column:
        return F.struct(F.lit(category).alias("category"), F.lit(heuristic).alias("heuristic"))

    return (
        F.when(host.isNull(), verdict("uncategorized", "invalid-url"))
        .when(lower_path.rlike(fv.AUTH_PATH), verdict("authentication", "auth-path"))
        .when(is_tracking_host(host), verdict("analytics", "analytics-host"))
        .when(lower_path.rlike(fv.ANALYTICS_PATH), verdict("analytics", "analytics-path"))
        .when(~home, verdict("third-party", "third-party"))
        .when(is_graphql, verdict("graphql", "graphql"))
        .when(~method.isin("GET", "HEAD", "OPTIONS"), verdict("mutations", "mutation-method"))
        .when(F.lower(F.coalesce(mime, F.lit(""))).contains("json"), verdict("data-fetching", "json-response"))
        .otherwise(verdict("uncategorized", "fallback"))
    )
