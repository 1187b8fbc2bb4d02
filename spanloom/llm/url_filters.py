"""URL filters: a temporal join of captures with dated list entries.

The events of an entry (listed, delisted) become validity intervals. Every capture is judged by the
entries in force when it was fetched, not by today's list: an as-of join finds, for each key and day that a capture asks for, the last
interval that begins by then, and the interval's end decides. Keys and days are asked for once each, so a host with very many
captures is as many questions as it has days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Host of a URL: after the scheme and user, before port, path, query and fragment; an IPv6 address in its brackets.
HOST_PATTERN = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#]*\]|[^/:?#]*)"
FAR = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-cased host without a dot at its end, or an empty string where there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), HOST_PATTERN, 1)), r"\.$", "")


def validity(events: DataFrame) -> DataFrame:
    """Intervals (kind, value, since, until) in which entries are in force, from events (kind, value, action, since).

    ``kind`` is url, host or domain (a host and all below it); ``action`` is add or remove. Of several events of
    one entry on one date, the last by action counts, so a removal wins. Events with a null go; repeated
    ones count once. An open interval ends in the year 9999.
    """
    rows = events.select("kind", F.when(F.col("kind") == "url", F.col("value")).otherwise(F.lower("value")).alias("value"), "action", F.col("since").cast("date").alias("since")).dropna().distinct()
    after = F.lead("since").over(Window.partitionBy("kind", "value").orderBy("since", "action"))
    rows = rows.withColumn("until", F.coalesce(after, F.lit(FAR).cast("date")))
    return rows.where((F.col("action") == "add") & (F.col("since") < F.col("until"))).select("kind", "value", "since", "until")


def as_of(asks: DataFrame, spans: DataFrame) -> DataFrame:
    """Of the distinct (kind, value, day) in ``asks`` those on which the entry is in force, with ``since`` of its interval.

    Questions and intervals of a key stand in one line by date, and each question takes the last interval before it.
    """
    listed = asks.distinct().join(spans.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    line = listed.select("kind", "value", "day", F.lit(1).alias("order"), F.lit(None).cast("struct<since:date,until:date>").alias("span"))
    line = line.unionByName(spans.select("kind", "value", F.col("since").alias("day"), F.lit(0).alias("order"), F.struct("since", "until").alias("span")))
    last = F.last("span", True).over(Window.partitionBy("kind", "value").orderBy("day", "order").rowsBetween(Window.unboundedPreceding, 0))
    return line.withColumn("span", last).where((F.col("order") == 1) & (F.col("day") < F.col("span.until"))).select("kind", "value", "day", F.col("span.since").alias("since"))


def filter_captures(captures: DataFrame, events: DataFrame, url: str = "url", fetched: str = "fetched") -> DataFrame:
    """The captures with ``host``, ``blocked`` and the entry that blocks (``blocked_kind``, ``blocked_value``, ``blocked_since``).

    Of several entries in force the most specific counts: url, then host, then the longest domain; of one entry the latest
    interval. Null or unparsable URLs have an empty host, which no entry matches, but may be listed themselves; a capture
    of null date is never blocked. Repeated captures are judged each, and all columns of ``captures`` are kept, whatever
    their names, but for those named like the new ones, which these replace. Entries are matched by equal keys only.
    """
    spans = validity(events)
    rows = captures.select(F.struct(*[F.col(f"`{c}`") for c in captures.columns]).alias("row"), F.col(f"`{url}`").cast("string").alias("link"), F.to_date(F.col(f"`{fetched}`")).alias("day"))
    rows = rows.withColumn("host", host_of(F.col("link"))).withColumn("site", F.nullif("host", F.lit("")))
    # hosts: each host and day that is asked for, with the keys that may list it
    sites = rows.where("site is not null and day is not null").select("site", "day").distinct()
    labels = F.split("site", r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    key = lambda kind, value: F.struct(F.lit(kind).alias("kind"), value.alias("value"))
    keys = sites.select("site", "day", F.explode(F.concat(F.array(key("host", F.col("site"))), F.transform(domains, lambda d: key("domain", d)))).alias("k")).select("site", "day", "k.*")
    keys = keys.join(spans.select("kind", "value").distinct(), ["kind", "value"], "left_semi")
    active = keys.join(as_of(keys.select("kind", "value", "day"), spans), ["kind", "value", "day"])
    best = F.min(F.struct(F.when(F.col("kind") == "host", 1).otherwise(2).alias("step"), (-F.length("value")).alias("size"), "kind", "value", "since"))
    by_site = active.groupBy("site", "day").agg(best.alias("_by_site"))
    # URLs that are listed themselves
    links = rows.where("link is not null and day is not null").select(F.lit("url").alias("kind"), F.col("link").alias("value"), "day")
    by_link = as_of(links, spans.where("kind = 'url'")).select(F.col("value").alias("link"), "day", F.struct("kind", "value", "since").alias("_by_link"))
    both = rows.join(by_site, ["site", "day"], "left").join(by_link, ["link", "day"], "left")
    hit = F.coalesce("_by_link", F.struct("_by_site.kind", "_by_site.value", "_by_site.since"))
    both = both.withColumn("hit", F.when(F.col("_by_link").isNotNull() | F.col("_by_site").isNotNull(), hit))
    new = ("host", "blocked", "blocked_kind", "blocked_value", "blocked_since")
    kept = [F.col(f"row.`{c}`") for c in captures.columns if c not in new]
    return both.select(*kept, "host", F.col("hit").isNotNull().alias("blocked"), F.col("hit.kind").alias("blocked_kind"), F.col("hit.value").alias("blocked_value"), F.col("hit.since").alias("blocked_since"))
