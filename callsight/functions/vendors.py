"""Host to vendor attribution."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.memo import reused


def _suffix_pattern(domains: list[str]) -> str:
    return r"(^|\.)(" + "|".join(re.escape(domain) for domain in domains) + r")$"


def host_suffixes(host: Column) -> Column:
    """``a.b.c`` -> ``[a.b.c, b.c, c]``."""
    labels = F.split(F.lower(host), r"\.")
    return F.transform(
        labels, lambda _, at: F.array_join(F.slice(labels, at + 1, F.size(labels)), ".")
    )


@reused
def vendor_of(host: Column | str) -> Column:
    """``struct(rank, name, category)`` of the vendor owning a host, null when unknown.

    The catalogue is a literal map looked up once per host suffix; the earliest
    catalogue entry wins. A port is part of the host, so ``x.com:8443`` is unknown.
    """
    host = F.col(host) if isinstance(host, str) else host
    catalogue = F.create_map(
        *[
            item
            for rank, (name, category, domains) in enumerate(fv.VENDORS)
            for domain in domains
            for item in (
                F.lit(domain),
                F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("name"), F.lit(category).alias("category")),
            )
        ]
    )
    return F.array_min(
        F.filter(
            F.transform(host_suffixes(host), lambda suffix: F.try_element_at(catalogue, suffix)),
            lambda vendor: vendor.isNotNull(),
        )
    )


@reused
def is_tracking_host(host: Column | str) -> Column:
    """One regular expression over the tracking vendors' host suffixes."""
    host = F.col(host) if isinstance(host, str) else host
    domains = [d for _, category, ds in fv.VENDORS if category in fv.TRACKING_CATEGORIES for d in ds]
    return F.lower(host).rlike(_suffix_pattern(domains))
