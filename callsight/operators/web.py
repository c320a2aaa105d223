"""Stored pages: links, reachability, robots rules, technologies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callsight import fixed_values as fv
from callsight.functions.urls import link_targets, normalize_url, present, resolve_link, serialize_url, url_parts
from callsight.operators.scope import in_scope
from callsight.operators.sizing import settle


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per anchor: page URL, position on the page, absolute link."""
    return (
        pages.select("url", F.posexplode(link_targets("html")).alias("pos", "href"))
        .withColumn("_base", url_parts("url"))
        .withColumn("_link", resolve_link("href", "url", F.col("_base")))
        .select("url", "pos", "href", present(serialize_url("_link")).alias("link"))
    )


def link_table(pages: DataFrame) -> DataFrame:
    """Distinct normalised (source, target) links with the first position of the target on the page and the link there."""
    links = extract_links(pages).select(normalize_url("url").alias("source"), normalize_url("link").alias("target"), "link", "pos")
    first = links.groupBy("source", "target").agg(F.min(F.struct("pos", "link")).alias("first"))
    return first.select("source", "target", "first.pos", "first.link")


def reachable_pages(
    seeds: DataFrame,
    links: DataFrame,
    max_depth: int | None = None,
    max_pages: int | None = None,
    scope: DataFrame | None = None,
    robots: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Breadth-first walk of the link table from every scan's seed: (visited, blocked).

    ``seeds`` has ``scan_id, seed_url``. One join and one anti join per level, however many scans
    there are; each level is settled so the plan does not grow. ``order`` is the chain of link
    positions that reached a page, which sorts as the crawl queue does, so limiting a scan to
    its first ``max_pages`` keeps the pages a limited crawl would visit, and of the refused ones those
    before the last of them. Robots rules judge the link that came first, as it was written. Without
    limits the walk ends when a level brings nothing new.
    """
    links = settle(links)
    frontier = seeds.select(
        "scan_id",
        normalize_url("seed_url").alias("url"),
        F.lit(0).alias("depth"),
        F.array().cast("array<int>").alias("order"),
        F.col("seed_url").alias("link"),
    )
    visited, blocked, depth = None, None, 0
    while max_depth is None or depth <= max_depth:
        if depth:
            found = (
                frontier.drop("link")
                .join(links, F.col("url") == F.col("source"))
                .select("scan_id", F.col("target").alias("url"), F.array_append("order", F.col("pos")).alias("order"), "link")
                .groupBy("scan_id", "url")
                .agg(F.min(F.struct("order", "link")).alias("first"))
                .select("scan_id", "url", F.lit(depth).alias("depth"), "first.order", "first.link")
            )
            found = found.join(visited.select("scan_id", "url"), ["scan_id", "url"], "left_anti")
            if scope is not None:
                found = in_scope(found, scope)
        else:
            found = frontier
        if robots is not None:
            judged = settle(robots_filter(found, robots, url="link"))
            refused = judged.where(~F.col("allowed")).drop("allowed")
            blocked = refused if blocked is None else blocked.unionByName(refused)
            frontier = judged.where("allowed").drop("allowed")
        else:
            frontier = settle(found)
        visited = frontier if visited is None else visited.unionByName(frontier)
        depth += 1
        if max_depth is None and frontier.isEmpty():
            break
    if blocked is None:
        blocked = visited.limit(0)
    if max_pages is not None:
        place = ["depth", "order", "url"]
        queue = Window.partitionBy("scan_id").orderBy(*place)
        visited = visited.withColumn("_nth", F.row_number().over(queue)).where(F.col("_nth") <= max_pages)
        ends = visited.where(F.col("_nth") == max_pages).select("scan_id", F.struct(*place).alias("_end"))
        before_end = F.col("_end").isNull() | (F.struct(*place) < F.col("_end"))
        blocked = blocked.join(ends, "scan_id", "left").where(before_end)
        visited = visited.drop("_nth")
    return visited.drop("link"), blocked.select("scan_id", "url").distinct()


def unvisited(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links (``scan_id, url``) not visited yet."""
    return links.join(visited.select("scan_id", "url"), ["scan_id", "url"], "left_anti")


# --- robots.txt ----------------------------------------------------------------


def robots_lines(robots: DataFrame) -> DataFrame:
    """Fields of every robots.txt (``origin, raw``) in order, without comments and blank lines."""
    line = F.trim(F.regexp_replace("_line", r"(?s)#.*$", ""))
    return (
        robots.where("raw is not null and raw <> ''")
        .select("origin", F.posexplode(F.split("raw", r"\r?\n")).alias("pos", "_line"))
        .withColumn("_line", line)
        .where(F.col("_line").contains(":"))
        .select(
            "origin",
            "pos",
            F.lower(F.trim(F.substring_index("_line", ":", 1))).alias("field"),
            F.trim(F.regexp_extract("_line", r"(?s)^[^:]*:(.*)$", 1)).alias("value"),
        )
    )


def robots_rules(robots: DataFrame) -> DataFrame:
    """One row per agent group: its agents and its rules.

    A user-agent line opens a group when the lines before it were rules. Windows and lists are
    per origin, that is per robots.txt file.
    """
    is_agent = F.col("field") == "user-agent"
    order = Window.partitionBy("origin").orderBy("pos")
    lines = (
        robots_lines(robots)
        .where(is_agent | (F.col("field").isin("allow", "disallow") & (F.col("value") != "")))
        .withColumn("_before", F.lag("field").over(order))
        .withColumn("_opens", is_agent & (F.col("_before").isNull() | (F.col("_before") != "user-agent")))
        .withColumn("group_id", F.sum(F.col("_opens").cast("int")).over(order))
        .where(F.col("group_id") > 0)
    )
    return lines.groupBy("origin", "group_id").agg(
        F.array_compact(F.collect_list(F.when(is_agent, F.lower("value")))).alias("agents"),
        F.array_compact(
            F.collect_list(
                F.when(
                    ~is_agent,
                    F.struct(F.length("value").alias("length"), (F.col("field") == "allow").alias("allow"), F.col("value").alias("prefix")),
                )
            )
        ).alias("rules"),
    )


def robots_settings(robots: DataFrame) -> DataFrame:
    """Crawl delay (the longest declared, in seconds) and sitemaps per origin."""
    lines = robots_lines(robots)
    order = Window.partitionBy("origin").orderBy("pos")
    agents_before = F.sum((F.col("field") == "user-agent").cast("int")).over(order)
    delay = F.when((F.col("field") == "crawl-delay") & (F.col("_agents") > 0), F.when(F.col("value") == "", F.lit(0.0)).otherwise(F.col("value").try_cast("double")))
    return (
        lines.withColumn("_agents", agents_before)
        .groupBy("origin")
        .agg(
            F.max(F.when(F.abs(delay) < float("inf"), F.greatest(delay, F.lit(0.0)))).alias("crawl_delay_seconds"),
            F.transform(
                F.array_sort(F.collect_list(F.when(F.col("field") == "sitemap", F.struct("pos", "value")))),
                lambda s: s["value"],
            ).alias("sitemaps"),
        )
    )


def chosen_groups(rules: DataFrame, user_agent: str = "*") -> DataFrame:
    """The one group per origin that applies to an agent: the most specific name, then the first."""
    agent = user_agent.lower()
    score = F.array_max(
        F.transform(
            "agents",
            lambda a: F.when(a == "*", F.lit(1)).when(F.lit(agent).contains(a) & (F.length(a) > 1), F.length(a) + 10),
        )
    )
    best = Window.partitionBy("origin").orderBy(F.col("score").desc(), "group_id")
    return (
        rules.withColumn("score", score)
        .where(F.col("score").isNotNull())
        .withColumn("_nth", F.row_number().over(best))
        .where(F.col("_nth") == 1)
        .select("origin", "rules")
    )


def robots_filter(rows: DataFrame, robots: DataFrame, user_agent: str = "*", url: str = "url") -> DataFrame:
    """Add ``allowed``: the longest matching rule decides, Allow wins ties, no match allows.

    The rules of an origin travel as one array (its robots.txt), so an origin with many URLs
    produces no extra rows.
    """
    parts = url_parts(url)
    groups = chosen_groups(robots_rules(robots), user_agent).withColumnRenamed("origin", "_origin")
    matching = F.filter("rules", lambda r: F.startswith(F.col("_path"), r["prefix"]))
    verdict = F.array_max(F.transform(matching, lambda r: F.struct(r["length"], r["allow"])))
    return (
        rows.withColumn("_u", parts)
        .withColumns({"_origin": F.concat(F.col("_u.scheme"), F.lit("://"), F.col("_u.host")), "_path": F.col("_u.path")})
        .join(groups, "_origin", "left")
        .withColumn("allowed", F.coalesce(verdict["allow"], F.lit(True)))
        .drop("_u", "_origin", "_path", "rules")
    )


# --- technologies --------------------------------------------------------------

_GENERATOR_AT = 7


def _signature_test(kind: str, needle: str) -> Column:
    if kind.startswith("header:"):
        value = F.coalesce(F.try_element_at(F.col("headers"), F.lit(kind[7:-1])), F.lit(""))
        return value.rlike(needle) if kind.endswith("~") else value != ""
    if kind == "cookie=":
        return F.array_contains("cookies", needle)
    if kind == "cookie^":
        return F.exists("cookies", lambda c: c.startswith(needle))
    if kind == "html":
        return F.col("html").contains(needle)
    if kind == "html~":
        return F.col("html").rlike(needle)
    if kind == "script":
        return F.exists("scripts", lambda s: s.contains(needle))
    return F.exists("scripts", lambda s: s.rlike(needle))


def detect_technologies(evidence: DataFrame) -> DataFrame:
    """Technologies per scan with the evidence of the first page that shows them.

    The first evidence is the least (page position, evidence number) per (scan, name).
    """
    safe = evidence.withColumns(
        {
            "headers": F.coalesce("headers", F.create_map().cast("map<string,string>")),
            "html": F.coalesce("html", F.lit("")),
            "cookies": F.coalesce("cookies", F.array().cast("array<string>")),
            "scripts": F.coalesce("scripts", F.array().cast("array<string>")),
        }
    )
    matches = []
    for name, _, tests in fv.TECHNOLOGIES:
        chain = None
        for at, (kind, needle, _) in enumerate(tests):
            test = F.coalesce(_signature_test(kind, needle), F.lit(False))
            chain = F.when(test, F.lit(at)) if chain is None else chain.when(test, F.lit(at))
        matches.append(F.when(chain.isNotNull(), F.struct(F.lit(name).alias("name"), chain.alias("at"))))
    generator = F.regexp_extract("html", fv.META_GENERATOR, 1)
    matches.append(F.when(generator != "", F.struct(generator.alias("name"), F.lit(_GENERATOR_AT).alias("at"))))
    seen = (
        safe.select("scan_id", "page_seq", F.explode(F.array_compact(F.array(*matches))).alias("m"))
        .groupBy("scan_id", F.col("m.name").alias("name"))
        .agg(F.min(F.struct("page_seq", F.col("m.at").alias("at"))).alias("first"))
    )
    at = F.col("first.at")
    categories = F.create_map(*[F.lit(x) for name, category, _ in fv.TECHNOLOGIES for x in (name, category)])
    texts = F.create_map(
        *[x for name, _, tests in fv.TECHNOLOGIES for x in (F.lit(name), F.array(*[F.lit(t[2]) for t in tests]))]
    )
    is_generator = at == _GENERATOR_AT
    return seen.select(
        "scan_id",
        "name",
        F.when(is_generator, F.lit("generator")).otherwise(F.try_element_at(categories, F.col("name"))).alias("category"),
        F.when(is_generator, F.lit("meta: generator"))
        .otherwise(F.get(F.try_element_at(texts, F.col("name")), at))
        .alias("evidence"),
    )
