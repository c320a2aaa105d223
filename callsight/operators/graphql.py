"""GraphQL operations of captured calls, read with token rows and windows.

Every distinct document is split into tokens by one regular expression; bracket
depth is a running sum over a document's tokens, and operations, selections and
arguments are read off the tokens at the top levels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.graphql import graphql_request
from callsight.functions.urls import present
from callsight.operators.endpoints import KEY

# strings, comments, spread, names, single signs
_TOKEN = (
    r'"""(?s:.*?)(?:"""|\z)|"(?:\\(?s:.)|[^"\\])*(?:"|\z)|#[^\n]*|\.\.\.|[_A-Za-z][_0-9A-Za-z]*|[^\s,﻿]'
)
_NAME = r"^[_A-Za-z]"


def graphql_calls(keyed: DataFrame) -> DataFrame:
    """Calls that carry GraphQL with their document and operation name."""
    return (
        keyed.select(*KEY, "call_seq", present(graphql_request()).alias("_g"))
        .select(*KEY, "call_seq", F.col("_g.query").alias("query"), F.col("_g.operation_name").alias("operation_name"))
    )


def document_tokens(documents: DataFrame) -> DataFrame:
    """Tokens of distinct documents (``query``) with their neighbours and nesting."""
    order = Window.partitionBy("doc").orderBy("pos")
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.filter(F.regexp_extract_all("query", F.lit(_TOKEN), F.lit(0)), lambda t: ~t.startswith("#"))
    step = lambda opening, closing, where: F.coalesce(
        F.sum(F.when(where, opening.cast("int") - closing.cast("int")).otherwise(0)).over(upto), F.lit(0)
    )
    token = F.col("token")
    return (
        documents.select("query")
        .distinct()
        .select(F.sha2("query", 256).alias("doc"), F.posexplode(tokens).alias("pos", "token"))
        .withColumns({f"prev{n}": F.lag("token", n).over(order) for n in (1, 2, 3)})
        .withColumns({f"next{n}": F.lead("token", n).over(order) for n in (1, 2)})
        # Parentheses first: braces only nest selections outside of them.
        .withColumn("parens", step(token == "(", token == ")", F.lit(True)))
        .withColumn("braces", step(token == "{", token == "}", (F.col("parens") == 0)))
        .withColumn("inner", step(token.isin("{", "["), token.isin("}", "]"), F.col("parens") > 0))
        .withColumn(
            "opens", (token == "{") & (F.col("braces") == 0) & (F.col("parens") == 0)
        )
        # Number of the selection set a token is in, or in front of.
        .withColumn("set_no", F.coalesce(F.sum(F.col("opens").cast("int")).over(upto), F.lit(0)))
    )


def document_operations(documents: DataFrame) -> DataFrame:
    """Operations per document: type, name, top-level selections, argument names, introspection."""
    tokens = document_tokens(documents)
    token = F.col("token")
    name = token.rlike(_NAME)
    quoted = token.startswith('"')
    top = (F.col("braces") == 0) & (F.col("parens") == 0)
    starts = top & (F.col("prev1").isNull() | (F.col("prev1") == "}"))
    heads = (
        tokens.where(top & (F.col("opens") | starts))
        .groupBy("doc", "set_no")
        .agg(
            F.bool_or("opens").alias("has_set"),
            F.max(F.when(starts & token.isin(fv.GRAPHQL_OPERATIONS), token)).alias("keyword"),
            F.max(F.when(starts & token.isin(fv.GRAPHQL_OPERATIONS) & F.col("next1").rlike(_NAME), F.col("next1"))).alias(
                "name"
            ),
            F.bool_or(starts & (token == "fragment")).alias("is_fragment"),
        )
        .where(F.col("has_set") & ~F.col("is_fragment"))
    )
    before = lambda n, text: F.coalesce(F.col(f"prev{n}") == text, F.lit(False))
    alias = F.coalesce((F.col("next1") == ":") & F.col("next2").rlike(_NAME), F.lit(False))
    selected = (
        (F.col("braces") == 1)
        & (F.col("parens") == 0)
        & name
        & ~quoted
        & ~before(1, "@")
        & ~before(1, "...")
        & ~(before(1, "on") & before(2, "..."))
        & ~alias
    )
    # The parenthesis a token is in, to tell field arguments from those of directives.
    order = Window.partitionBy("doc").orderBy("pos")
    opened = F.when((token == "(") & (F.col("parens") == 0), before(2, "@"))
    inside = tokens.withColumn(
        "of_directive", F.last(opened, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    )
    argument = (
        (F.col("braces") == 1)
        & (F.col("parens") == 1)
        & (F.col("inner") == 0)
        & name
        & F.coalesce(F.col("next1") == ":", F.lit(False))
        & ~F.coalesce(F.col("of_directive"), F.lit(False))
    )
    # Tokens inside a set come after the brace that opened it.
    members = (
        inside.where(selected | argument)
        .withColumn("set_no", F.col("set_no") - 1)
        .groupBy("doc", "set_no")
        .agg(
            F.array_sort(F.collect_set(F.when(selected, token))).alias("selections"),
            F.array_sort(F.collect_set(F.when(argument, token))).alias("arguments"),
        )
    )
    introspects = tokens.groupBy("doc").agg(F.bool_or(token.isin(fv.GRAPHQL_INTROSPECTION_FIELDS)).alias("introspection"))
    empty = F.array().cast("array<string>")
    return (
        introspects.join(heads, "doc", "left")
        .join(members, ["doc", "set_no"], "left")
        .select(
            "doc",
            "introspection",
            F.when(F.col("has_set"), F.coalesce("keyword", F.lit("query"))).alias("type"),
            "name",
            F.coalesce("selections", empty).alias("selections"),
            F.coalesce("arguments", empty).alias("arguments"),
        )
    )


def graphql_operations(calls: DataFrame) -> DataFrame:
    """Operations per endpoint over its GraphQL calls (see :func:`graphql_calls`).

    Documents are parsed once however often they were sent. Selections and arguments are unioned
    per operation; an operation name the document does not declare counts as an unknown operation.
    """
    requests = (
        calls.withColumn("doc", F.when(F.col("query").isNotNull(), F.sha2("query", 256)))
        .groupBy(*KEY, "doc", "operation_name")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    parsed = document_operations(calls.where("query is not null").select("query"))
    joined = requests.join(parsed, "doc", "left")
    # An empty document name and no name are the same operation key.
    declared = joined.where("type is not null").select(*KEY, "type", "name", "selections", "arguments")
    empty = F.array().cast("array<string>")
    names = (
        joined.groupBy(*KEY, "doc", "operation_name")
        .agg(F.bool_or(F.coalesce(F.col("name") == F.col("operation_name"), F.lit(False))).alias("known"))
        .where(F.col("operation_name").isNotNull() & (F.col("operation_name") != "") & ~F.col("known"))
    )
    undeclared = names.select(
        *KEY, F.lit("unknown").alias("type"), F.col("operation_name").alias("name"), empty.alias("selections"), empty.alias("arguments")
    ).distinct()
    merged = declared.distinct().unionByName(undeclared).groupBy(*KEY, "type", "name").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("selections")))).alias("selections"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("arguments")))).alias("arguments"),
    )
    return merged


def graphql_introspection(calls: DataFrame) -> DataFrame:
    """Endpoints with GraphQL, and whether any request introspected the schema."""
    parsed = document_operations(calls.where("query is not null").select("query")).select("doc", "introspection").distinct()
    by_name = F.coalesce(F.col("operation_name") == fv.GRAPHQL_INTROSPECTION_OPERATION, F.lit(False)) & F.col("query").isNotNull()
    requests = calls.withColumn("doc", F.when(F.col("query").isNotNull(), F.sha2("query", 256)))
    return (
        requests.groupBy(*KEY, "doc")
        .agg(F.bool_or(by_name).alias("by_name"))
        .join(parsed, "doc", "left")
        .groupBy(*KEY)
        .agg(F.bool_or(F.col("by_name") | F.coalesce("introspection", F.lit(False))).alias("introspection"))
    )
