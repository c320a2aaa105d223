"""Which page triggered which request."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.text import mermaid_label
from callsight.functions.urls import page_label
from callsight.operators.endpoints import KEY, endpoint_id
from callsight.operators.sizing import settle


def request_graph(
    endpoints: DataFrame,
    values: DataFrame,
    seeds: DataFrame,
    max_pages: int = fv.GRAPH_MAX_PAGES,
    max_requests: int = fv.GRAPH_MAX_REQUESTS,
) -> dict[str, DataFrame]:
    """``pages``, ``requests``, ``edges`` and ``omitted`` of every scan's graph.

    The busiest pages are kept, then the most called requests over those pages. Both picks are
    row_number limits, which Spark applies before the shuffle. The picks and the links to kept pages are settled:
    nodes, edges and counts read them, and no page is labelled again for each.
    """
    triggered = (
        values.where(F.col("kind") == "page")
        .select(*KEY, "value")
        .join(endpoints.select(*KEY, F.col("count").alias("calls")), KEY)
        .select("scan_id", F.col("value").alias("url"), endpoint_id().alias("label"), "calls")
    )
    pages = (
        triggered.groupBy("scan_id", "url")
        .agg(F.count(F.lit(1)).alias("requests"))
        .join(seeds.select("scan_id", "seed_url"), "scan_id")
        .withColumn("label", page_label("url", "seed_url"))
        .drop("seed_url")
    )
    page_rank = Window.partitionBy("scan_id").orderBy(F.col("requests").desc(), "label", "url")
    kept_pages = settle(
        pages.withColumn("rank", F.row_number().over(page_rank))
        .where(F.col("rank") <= max_pages)
        .withColumn("node", F.concat(F.lit("p"), (F.col("rank") - 1).cast("string")))
    )
    numbered = lambda rows, key, name: rows.select("scan_id", key, F.col("node").alias(f"{name}_node"), F.col("rank").alias(f"{name}_rank"))
    on_kept = settle(triggered.join(numbered(kept_pages, "url", "page"), ["scan_id", "url"]))
    requests = on_kept.groupBy("scan_id", "label").agg(F.max("calls").alias("calls"))
    request_rank = Window.partitionBy("scan_id").orderBy(F.col("calls").desc(), "label")
    kept_requests = (
        requests.withColumn("rank", F.row_number().over(request_rank))
        .where(F.col("rank") <= max_requests)
        .withColumn("node", F.concat(F.lit("e"), (F.col("rank") - 1).cast("string")))
    )
    edges = on_kept.join(numbered(kept_requests, "label", "request"), ["scan_id", "label"]).select(
        "scan_id", "page_node", "request_node", "url", "label", "calls", "page_rank", "request_rank"
    )
    left_out = lambda rows, limit, name: rows.groupBy("scan_id").agg(
        F.greatest(F.count(F.lit(1)) - limit, F.lit(0)).alias(name)
    )
    omitted = left_out(pages, max_pages, "omitted_pages").join(
        left_out(requests, max_requests, "omitted_requests"), "scan_id", "left"
    )
    return {"pages": kept_pages, "requests": kept_requests, "edges": edges, "omitted": omitted}


def mermaid_lines(graph: dict[str, DataFrame]) -> DataFrame:
    """Flow-chart text of every graph as ordered lines; a graph is bounded by its node limits."""
    head = graph["pages"].select("scan_id").distinct().select(
        "scan_id", F.lit(0).alias("part"), F.lit(0).alias("rank"), F.lit(0).alias("rank2"), F.lit("flowchart LR").alias("line")
    )
    node = lambda rows, part: rows.select(
        "scan_id",
        F.lit(part).alias("part"),
        "rank",
        F.lit(0).alias("rank2"),
        F.concat(F.lit("  "), "node", F.lit('["'), mermaid_label("label"), F.lit('"]')).alias("line"),
    )
    edges = graph["edges"].select(
        "scan_id",
        F.lit(3).alias("part"),
        F.col("page_rank").alias("rank"),
        F.col("request_rank").alias("rank2"),
        F.concat(F.lit("  "), "page_node", F.lit(" --> "), "request_node").alias("line"),
    )
    return head.unionByName(node(graph["pages"], 1)).unionByName(node(graph["requests"], 2)).unionByName(edges)
