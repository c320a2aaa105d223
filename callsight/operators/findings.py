"""Review findings over the endpoint tables.

Every rule yields one row per affected endpoint; :func:`collect_findings` joins
them and :func:`finding_summary` folds them to one row per scan and kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.text import describe_statuses, has_header
from callsight.operators.shape import ELEMENT, path_text

COLUMNS = ["scan_id", "kind", "severity", "title", "endpoint", "detail"]

_RULES = [
    ("unauthenticated", "high", "Sensitive-looking endpoints answered without credentials"),
    ("pii", "medium", "PII-shaped fields appear in captured samples"),
    ("verbose-error", "medium", "Error bodies exposed internal detail"),
    ("missing-security-header", "low", "Security headers not observed on any response"),
    ("inconsistent-shape", "low", "Endpoint shapes were inconsistent within a single scan"),
]


def _finding(kind: str, endpoint: Column, detail: Column) -> list[Column]:
    _, severity, title = next(rule for rule in _RULES if rule[0] == kind)
    return [
        F.col("scan_id"),
        F.lit(kind).alias("kind"),
        F.lit(severity).alias("severity"),
        F.lit(title).alias("title"),
        endpoint.cast("string").alias("endpoint"),
        detail.alias("detail"),
    ]


def unauthenticated(endpoints: DataFrame) -> DataFrame:
    """Sensitive paths that answered without a credential on their latest call."""
    matches = endpoints.where(
        ~F.col("category").isin("analytics", "third-party", "authentication")
        & F.col("url_pattern").rlike(fv.SENSITIVE_PATH)
        & F.exists("status_codes", lambda s: s.between(200, 299))
        & ~has_header("request_headers", "authorization")
        & ~has_header("request_headers", "cookie")
    )
    detail = F.concat(
        F.col("id"), F.lit(" — no Authorization or Cookie header; observed "), describe_statuses("status_codes")
    )
    return matches.select(*_finding("unauthenticated", F.col("id"), detail))


def _dashed(identifier: Column | str, text: Column) -> Column:
    return F.concat_ws(" — ", identifier, text)


def pii_fields(shapes: DataFrame) -> DataFrame:
    """Field names that look like personal data, in any shape of an endpoint.

    The distinct field paths of one endpoint form the detail; their number is bounded by the shape.
    """
    leaf = F.try_element_at("path", F.lit(-1))
    fields = (
        shapes.where((leaf != ELEMENT) & leaf.rlike(fv.PII_FIELD))
        .select("scan_id", F.concat_ws(" ", "method", "url_pattern").alias("id"), path_text().alias("field"))
        .distinct()
    )
    listed = fields.groupBy("scan_id", "id").agg(F.array_join(F.array_sort(F.collect_list("field")), ", ").alias("f"))
    return listed.select(*_finding("pii", F.col("id"), _dashed("id", F.col("f"))))


def verbose_errors(errors: DataFrame) -> DataFrame:
    """Error bodies that show internals."""
    matched = F.regexp_extract("body_sample", fv.VERBOSE_ERROR, 0)
    rows = errors.withColumn("_m", matched).where(F.col("_m") != "")
    identifier = F.concat_ws(" ", "method", "url_pattern")
    detail = F.concat(
        identifier, F.lit(" — "), F.col("status").cast("string"), F.lit(' body exposed internals ("'), F.col("_m"), F.lit('")')
    )
    return rows.select(*_finding("verbose-error", identifier, detail))


def missing_security_headers(endpoints: DataFrame) -> DataFrame:
    """Security headers no endpoint of a scan sent; site-wide, so without an endpoint."""
    expected = F.array(*[F.lit(name) for name in fv.SECURITY_HEADERS])
    sent = (
        endpoints.select(
            "scan_id",
            F.explode_outer(F.transform(F.map_keys("response_headers"), lambda name: F.lower(name))).alias("name"),
        )
        .groupBy("scan_id")
        # Only the expected names are gathered, so the set stays small.
        .agg(F.collect_set(F.when(F.array_contains(expected, F.col("name")), F.col("name"))).alias("seen"))
    )
    missing = sent.select("scan_id", F.explode(F.array_except(expected, "seen")).alias("name"))
    detail = F.concat(F.col("name"), F.lit(" was not present on any captured response"))
    return missing.select(*_finding("missing-security-header", F.lit(None), detail))


def inconsistent_shapes(shapes: DataFrame) -> DataFrame:
    """Endpoints whose samples disagreed on the type at some path."""
    order = F.when(F.col("side") == "response", 0).when(F.col("side") == "request", 1).otherwise(2)
    label = (
        F.when(F.col("side") == "response", F.lit("response at "))
        .when(F.col("side") == "request", F.lit("request body at "))
        .otherwise(F.concat(F.replace("side", F.lit(":"), F.lit(" ")), F.lit(" at ")))
    )
    text = path_text()
    unions = shapes.where(F.size("types") > 1).select(
        "scan_id",
        F.concat_ws(" ", "method", "url_pattern").alias("id"),
        order.alias("ord"),
        label.alias("label"),
        F.when(text == "", F.lit("(root)")).otherwise(text).alias("at"),
    )
    per_side = unions.groupBy("scan_id", "id", "ord", "label").agg(
        F.array_join(F.array_sort(F.collect_set("at")), ", ").alias("ats")
    )
    parts = per_side.groupBy("scan_id", "id").agg(
        F.array_sort(F.collect_list(F.struct("ord", "label", F.concat("label", "ats").alias("text")))).alias("p")
    )
    detail = F.concat(
        F.col("id"),
        F.lit(" — shape varied across samples ("),
        F.array_join(F.transform("p", lambda p: p["text"]), "; "),
        F.lit(")"),
    )
    return parts.select(*_finding("inconsistent-shape", F.col("id"), detail))


def collect_findings(endpoints: DataFrame, shapes: DataFrame, errors: DataFrame) -> DataFrame:
    """All findings with their rank: most severe first, then in rule order."""
    rows = (
        unauthenticated(endpoints)
        .unionByName(pii_fields(shapes))
        .unionByName(verbose_errors(errors))
        .unionByName(missing_security_headers(endpoints))
        .unionByName(inconsistent_shapes(shapes))
    )
    severity = F.array_position(F.array(*[F.lit(s) for s in fv.SEVERITIES]), F.col("severity"))
    rule = F.array_position(F.array(*[F.lit(r[0]) for r in _RULES]), F.col("kind"))
    return rows.withColumns({"severity_rank": severity.cast("int"), "rule_rank": rule.cast("int")})


def finding_summary(findings: DataFrame) -> DataFrame:
    """One row per scan and kind: how many endpoints and details it has."""
    return findings.groupBy("scan_id", "kind", "severity", "title", "severity_rank", "rule_rank").agg(
        F.count_distinct("endpoint").alias("endpoints"), F.count(F.lit(1)).alias("details")
    )
