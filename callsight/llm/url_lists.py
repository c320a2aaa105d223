"""URL filters over time: a capture is judged by the list entries active when it was fetched.

Dated entries (added, removed) become intervals in which a host stands on a list. Captures meet them on
the host, or a parent domain of it, and a slice of time; an interval is copied to the slices it
covers, so a join of equal keys finds the entry as of the fetch. Only distinct pairs of host and time
are judged; the verdicts then go back to the captures, whose skewed hosts Spark may split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callsight.llm.common import table

#: Seconds of a slice.
SLICE = 7 * 86_400
FOREVER = 253_402_300_800  # the year 10000


def host_of(url: Column | str) -> Column:
    """The lower-case host of an absolute URL; null without one."""
    pattern = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
    found = F.regexp_extract(url, pattern, 1)
    return F.when(found != "", F.lower(found))


def intervals(entries: DataFrame) -> DataFrame:
    """list, domain, since, until from dated entries (list, domain, at in seconds, action).

    ``add`` puts a domain on a list, ``remove`` takes it off, until the next entry; an interval holds its
    first second and not its last. Of several entries at one second the removal counts. Entries with
    a null, or with another action, are left out; repeated ones count once.
    """
    clean = (
        entries.select("list", F.lower("domain").alias("domain"), F.col("at").cast("long").alias("at"), "action")
        .where(F.col("action").isin("add", "remove") & F.col("list").isNotNull() & F.col("domain").isNotNull() & F.col("at").isNotNull())
        .groupBy("list", "domain", "at")
        .agg(F.max("action").alias("action"))
    )
    following = F.lead("at").over(Window.partitionBy("list", "domain").orderBy("at"))
    return (
        clean.withColumn("until", F.coalesce(following, F.lit(FOREVER)))
        .where("action = 'add'")
        .select("list", "domain", F.col("at").alias("since"), "until")
    )


def judged(captures: DataFrame, entries: DataFrame, horizon: tuple[int, int]) -> DataFrame:
    """``captures`` (url, fetched_at in seconds) with the lists that held them then.

    Added are ``host``, ``lists`` (sorted, empty if none), ``since`` (when the earliest of the entries began)
    and ``allowed``. A list holds a capture if it holds the host or a parent domain of it. ``horizon`` bounds the times in which
    intervals are cut to slices; the first and the last slice also hold all times before and after it.
    Without a host or a time nothing holds a capture. Repeated captures are judged each for itself.
    """
    low, high = horizon

    def slice_of(at: str) -> Column:
        return F.floor((F.greatest(F.least(at, F.lit(high)), F.lit(low)) - low) / SLICE)

    labels = F.split("host", r"\.")
    parents = F.when(
        F.col("host").isNotNull(),
        F.transform(F.sequence(F.lit(1), F.size(labels)), lambda at: F.array_join(F.slice(labels, at, F.size(labels)), ".")),
    )
    rows = captures.withColumn("host", host_of("url")).withColumn("__at", F.col("fetched_at").cast("long"))
    asks = (
        rows.where("host is not null and __at is not null")
        .select("host", "__at")
        .distinct()
        .select("host", "__at", F.explode(parents).alias("domain"), slice_of("__at").alias("__slice"))
    )
    slices = F.explode(F.sequence(slice_of("since"), slice_of("until")))
    cut = intervals(entries).select("list", "domain", "since", "until", slices.alias("__slice"))
    hits = (
        asks.join(cut, ["domain", "__slice"])
        .where((F.col("since") <= F.col("__at")) & (F.col("__at") < F.col("until")))
        .groupBy("host", "__at")
        .agg(F.array_sort(F.collect_set("list")).alias("lists"), F.min("since").alias("since"))  # as many as lists
    )
    return (
        rows.join(hits, ["host", "__at"], "left")
        .withColumn("lists", F.coalesce("lists", F.array().cast("array<string>")))
        .withColumn("allowed", F.size("lists") == 0)
        .select(*captures.columns, "host", "lists", "since", "allowed")
    )


START, DAYS = 1_704_067_200, 60  # the sample's first second and number of days


def _mark(value: Column) -> Column:
    """A number spread over the values, the same in any engine."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, 7), 16, 10).cast("long")


def sample_captures(pages: DataFrame) -> DataFrame:
    """Pages with a time of fetching, spread over the days by their id; ``pages`` holds none."""
    at = F.lit(START) + F.pmod(_mark(F.col("page_id").cast("string")), F.lit(DAYS * 24)) * 3600
    return pages.select("page_id", "url", at.alias("fetched_at"))


def sample_entries(pages: DataFrame) -> DataFrame:
    """Dated entries for the hosts of ``pages``: put on a list, mostly taken off, some put on again."""
    hosts = pages.select(host_of("url").alias("domain")).where("domain is not null").distinct()
    mark = _mark(F.col("domain"))
    day = F.pmod(F.floor(mark / 7), F.lit(DAYS))
    stay = F.pmod(F.floor(mark / 11), F.lit(20)) + 1
    names = F.when(mark % 3 == 0, F.lit("spam")).when(mark % 3 == 1, F.lit("adult"))
    listed = hosts.select("domain", names.alias("list"), day.alias("day"), stay.alias("stay"), (mark % 5).alias("kind"))
    listed = listed.where("list is not null")
    actions = F.filter(
        F.array(
            F.struct(F.col("day").alias("d"), F.lit("add").alias("action")),
            F.struct((F.col("day") + F.col("stay")).alias("d"), F.when(F.col("kind") != 0, F.lit("remove")).alias("action")),
            F.struct((F.col("day") + 2 * F.col("stay")).alias("d"), F.when(F.col("kind") == 1, F.lit("add")).alias("action")),
        ),
        lambda entry: entry["action"].isNotNull(),
    )
    entry = listed.select("list", "domain", F.explode(actions).alias("e"))
    return entry.select("list", "domain", (F.lit(START) + F.col("e.d") * 86_400).alias("at"), F.col("e.action").alias("action"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    found = judged(sample_captures(pages), sample_entries(pages), (START, START + DAYS * 86_400))
    return found.select("page_id", "url", "fetched_at", F.array_join("lists", ",").alias("lists"), "since", "allowed")
