"""Recognising GraphQL requests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.memo import reused
from callsight.functions.text import json_container
from callsight.functions.urls import bind, query_entries

_LEADING = r"^(?:[\s,﻿]|#[^\n]*(?:\n|$))*"


def looks_like_graphql(text: Column) -> Column:
    """The first token is a selection set, an operation keyword or a fragment."""
    words = "|".join([*fv.GRAPHQL_OPERATIONS, "fragment"])
    return F.coalesce(text.rlike(rf"{_LEADING}(?:\{{|(?:{words})(?![_0-9A-Za-z]))"), F.lit(False))


def _json_text(container: Column, field: str) -> Column:
    """A non-empty string field of a JSON object, else null."""
    value = F.try_variant_get(container, f"$.{field}", "variant")
    text = F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(container, f"$.{field}", "string"))
    return F.when(text != "", text)


def _param(url: Column, name: str) -> Column:
    entries = query_entries(F.regexp_extract(url, r"(?s)\?(.*)$", 1))
    return F.get(F.transform(F.filter(entries, lambda e: e["name"] == name), lambda e: e["value"]), F.lit(0))


@reused
def graphql_request(
    url: Column | str = "url",
    path: Column | str = "path",
    headers: Column | str = "request_headers",
    body: Column | str = "request_body",
) -> Column:
    """``struct(query, operation_name)`` of a call that carries GraphQL, else null.

    Recognised: an ``application/graphql`` body, a JSON ``query`` document, the operation name
    of a persisted query, and ``query``/``operationName`` URL parameters.
    """
    url, path, headers, body = [F.col(c) if isinstance(c, str) else c for c in (url, path, headers, body)]
    no_text = F.lit(None).cast("string")
    on_path = F.coalesce(path.rlike(fv.GRAPHQL_PATH), F.lit(False))
    raw_document = F.lower(F.coalesce(F.try_element_at(headers, F.lit("content-type")), F.lit(""))).contains(
        "application/graphql"
    )

    def found(query: Column, name: Column) -> Column:
        return F.struct(query.cast("string").alias("query"), name.cast("string").alias("operation_name"))

    def from_json(container: Column) -> Column:
        def decide(fields: Column) -> Column:
            query, name = fields["query"], fields["name"]
            return F.when(looks_like_graphql(query), found(query, name)).when(
                name.isNotNull() & (fields["persisted"] | on_path), found(no_text, name)
            )

        persisted = F.schema_of_variant(F.try_variant_get(container, "$.extensions.persistedQuery", "variant"))
        return bind(
            F.struct(
                _json_text(container, "query").alias("query"),
                _json_text(container, "operationName").alias("name"),
                F.coalesce(persisted.rlike("^(OBJECT|ARRAY)"), F.lit(False)).alias("persisted"),
            ),
            decide,
        )

    def from_url() -> Column:
        query, name = _param(url, "query"), _param(url, "operationName")
        return F.when(looks_like_graphql(query), found(query, name)).when(
            on_path & (name != ""), found(no_text, name)
        )

    hinted = body.rlike(r"^\s*\{") & (body.contains("query") | body.contains("operationName"))
    document = F.trim(body)
    return (
        F.when(raw_document & (body != ""), F.when(looks_like_graphql(document), found(document, no_text)))
        .when(
            hinted | url.rlike(r"[?&](query|operationName)="),
            F.coalesce(F.when(hinted, bind(json_container(body), from_json)), from_url()),
        )
    )


@reused
def is_graphql_request() -> Column:
    return graphql_request().isNotNull()
