"""From captured calls to the tables of a report, many scans at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callsight.operators import endpoints as ep
from callsight.operators import graphql, shape
from callsight.operators.endpoints import KEY
from callsight.operators.findings import collect_findings
from callsight.operators.resources import group_resources
from callsight.operators.sizing import settle
from callsight.operators.web import detect_technologies
from callsight.plans.capture import Rules, captured
from callsight.sources.capture import api_only


def keyed(calls: DataFrame) -> DataFrame:
    """API calls with their endpoint key. Store this once and every operator below reads only the columns it needs."""
    return ep.keyed_calls(api_only(calls))


def success_flags(rows: DataFrame) -> DataFrame:
    """Per endpoint, whether a successful answer had a body."""
    ok_body = F.col("status").between(200, 299) & F.col("response_body").isNotNull()
    return rows.groupBy(*KEY).agg(F.bool_or(ok_body).alias("success_sampled"))


def shapes(rows: DataFrame, base: DataFrame | None = None) -> DataFrame:
    # Settled, the flags have a known size: bodies are not shuffled to the few endpoints that hold most of them.
    return shape.endpoint_schema_paths(rows, settle(success_flags(rows)) if base is None else base, KEY)


class Report:
    """The report tables of a capture, each computed when first asked for.

    Tables that others build on are settled, so a view over them does not compute them again.
    Give ``rules`` for calls as they were met: they say what is stored, and whether it is masked, and no table sees
    the originals. Without rules the calls are taken as stored and masked already. Either way the keyed calls are
    settled once: every table reads the few columns it needs of them, and no URL is parsed again.
    """

    TABLES = [
        "endpoints", "values", "params", "shapes", "errors", "vendors", "operations", "introspection", "resources", "findings"
    ]

    def __init__(self, calls: DataFrame, seeds: DataFrame, evidence: DataFrame | None = None, rules: Rules | None = None):
        self._given, self.rules = calls, rules
        self.seeds = seeds
        self.evidence = evidence

    @cached_property
    def calls(self) -> DataFrame:
        stored = self._given if self.rules is None else captured(self._given, self.rules).drop("secrets")
        return settle(keyed(stored))

    @cached_property
    def endpoints(self) -> DataFrame:
        return settle(ep.endpoints(self.calls, self.seeds))

    @cached_property
    def values(self) -> DataFrame:
        return settle(ep.endpoint_values(self.calls))

    @cached_property
    def params(self) -> DataFrame:
        return settle(ep.query_params(self.calls))

    @cached_property
    def shapes(self) -> DataFrame:
        return settle(shapes(self.calls, self.__dict__.get("endpoints")))  # else from the few columns it takes

    @cached_property
    def errors(self) -> DataFrame:
        return settle(ep.error_contracts(self.calls))

    @cached_property
    def vendors(self) -> DataFrame:
        keys = ep.vendor_payload_keys(self.params, self.shapes)
        return settle(ep.vendor_attribution(self.endpoints, self.values, keys))

    @cached_property
    def graphql(self) -> DataFrame:
        return settle(graphql.graphql_calls(self.calls))

    @cached_property
    def operations(self) -> DataFrame:
        return settle(graphql.graphql_operations(self.graphql))

    @cached_property
    def introspection(self) -> DataFrame:
        return settle(graphql.graphql_introspection(self.graphql))

    @cached_property
    def resources(self) -> DataFrame:
        return group_resources(self.endpoints)

    @cached_property
    def findings(self) -> DataFrame:
        return collect_findings(self.endpoints, self.shapes, self.errors)

    @cached_property
    def technologies(self) -> DataFrame | None:
        return None if self.evidence is None else detect_technologies(self.evidence)

    def tables(self, *names: str) -> dict[str, DataFrame]:
        """The named tables, or all of them."""
        chosen = {name: getattr(self, name) for name in names or self.TABLES}
        if not names and self.evidence is not None:
            chosen["technologies"] = self.technologies
        return chosen
