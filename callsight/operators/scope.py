"""Which hosts, paths and targets a scan may touch.

What a scope comes down to is settled, so its size is known: while it is small Spark broadcasts it, and the rows of
a scan are not shuffled to the one task of their scan or host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callsight.functions.urls import bare_host, is_private_host, url_host, url_parts
from callsight.operators.sizing import settle


def _plain(host: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(host)), r"\.$", "")


def scope_hosts(scope: DataFrame) -> DataFrame:
    """Allowed hosts per scan, without ``www.``: the seed's and the included ones."""
    included = F.transform(
        F.filter(F.coalesce("include_hosts", F.array().cast("array<string>")), lambda h: F.trim(h) != ""),
        lambda h: F.when(h.contains("://"), F.trim(h)).otherwise(F.concat(F.lit("http://"), F.trim(h))),
    )
    urls = F.concat(F.array("seed_url"), included)
    return (
        scope.select("scan_id", F.explode(urls).alias("_u"))
        .select("scan_id", bare_host(_plain(url_host("_u"))).alias("host"))
        .where(F.col("host").isNotNull())
        .distinct()
    )


def allowed_hosts(rows: DataFrame, scope: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose URL host (with port) is in the scan's scope.

    The semi join is on scan and host, so one large scan is spread over its hosts where the scope is too large to broadcast.
    """
    keyed = rows.withColumn("_host", bare_host(_plain(url_host(url))))
    hosts = settle(scope_hosts(scope)).select("scan_id", F.col("host").alias("_host"))
    return keyed.join(hosts, ["scan_id", "_host"], "left_semi").drop("_host")


def capture_scope(rows: DataFrame, scope: DataFrame, url: str = "url") -> DataFrame:
    """Rows to capture: everything of scans that include third parties, else only scope hosts."""
    flags = settle(scope.select("scan_id", F.coalesce("include_third_party", F.lit(False)).alias("_all")))
    hosts = settle(scope_hosts(scope)).select("scan_id", F.col("host").alias("_host"), F.lit(True).alias("_home"))
    keyed = rows.withColumn("_host", bare_host(_plain(url_host(url))))
    return (
        keyed.join(flags, "scan_id")
        .join(hosts, ["scan_id", "_host"], "left")
        .where(F.col("_all") | F.col("_home"))
        .drop("_all", "_home", "_host")
    )


def _path_regex(pattern: Column) -> Column:
    """Regular expression of one path rule: a prefix on a segment boundary, or an anchored ``*`` glob."""
    rooted = F.when(pattern.startswith("/"), pattern).otherwise(F.concat(F.lit("/"), pattern))
    literal = lambda text: F.regexp_replace(text, r"([\\.\[\]{}()^$|?+])", r"\\$1")
    glob = F.concat(F.lit("^"), F.replace(literal(rooted), F.lit("*"), F.lit(".*")), F.lit("$"))
    prefix = F.regexp_replace(rooted, r"/+$", "")
    return F.when(rooted.contains("*"), glob).when(
        prefix != "", F.concat(F.lit("^"), literal(prefix), F.lit("(/|$)"))
    )


def exclude_rules(scope: DataFrame) -> DataFrame:
    """One regular expression per scan for all its excluded paths."""
    trimmed = F.filter(
        F.transform(F.coalesce("exclude_paths", F.array().cast("array<string>")), lambda p: F.trim(p)), lambda p: p != ""
    )
    rules = F.filter(F.transform(trimmed, _path_regex), lambda r: r.isNotNull())
    return scope.select("scan_id", F.array_join(rules, "|").alias("_rule")).where(F.col("_rule") != "")


def exclude_paths(rows: DataFrame, scope: DataFrame, url: str = "url") -> DataFrame:
    """Rows whose path no rule of their scan excludes; rows without a valid URL stay."""
    path = url_parts(url)["path"]
    excluded = F.coalesce(F.rlike(path, F.col("_rule")), F.lit(False))
    return rows.join(settle(exclude_rules(scope)), "scan_id", "left").where(~excluded).drop("_rule")


def in_scope(rows: DataFrame, scope: DataFrame, url: str = "url") -> DataFrame:
    return exclude_paths(allowed_hosts(rows, scope, url), scope, url)


def redirect_guard(landings: DataFrame, scope: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split page landings (``url`` asked for, ``landed_url`` reached) into kept and refused ones."""
    kept = in_scope(landings, scope, "landed_url")
    refused = landings.join(kept.select("scan_id", "url", "landed_url"), ["scan_id", "url", "landed_url"], "left_anti")
    host_ok = allowed_hosts(refused, scope, "landed_url").select("scan_id", "url", "landed_url", F.lit(True).alias("_ok"))
    reason = F.when(F.col("_ok"), F.lit("path excluded")).otherwise(F.lit("host out of scope"))
    with_reason = refused.join(host_ok, ["scan_id", "url", "landed_url"], "left").withColumn("reason", reason)
    return kept, with_reason.drop("_ok")


def target_check(targets: DataFrame, url: str = "seed_url", allow_local: bool = False) -> DataFrame:
    """Add why a scan target is refused; null when it may be scanned."""
    parts = url_parts(url)
    valid = F.coalesce(parts.isNotNull(), F.lit(False))
    reason = (
        F.when(~valid & F.col(url).rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:[^/]"), F.lit("only http and https can be scanned"))
        .when(~valid, F.lit("invalid URL"))
        .when(~parts["scheme"].isin("http", "https"), F.lit("only http and https can be scanned"))
        .when(is_private_host(url) & F.lit(not allow_local), F.lit("private or local address"))
    )
    return targets.withColumn("refused", reason)
