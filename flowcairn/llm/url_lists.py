"""URL filter lists as validity intervals, joined to captures as of their fetch day.

A list entry names a key and a date: a domain, which also covers the hosts below it, or a host with
leading path segments. Entries of one list and key become intervals: an ``add`` holds from its day until
the next ``remove``. A capture is looked up under every domain suffix of its host and every leading part
of its path, and sees the entries in force on the day it was fetched.

Captures shrink to distinct (key, day) before anything is joined, so a host with a third of all captures
is a few thousand rows; the join meets them on key and year. Everything is built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# User info ends at the last @; an address in brackets keeps its colons.
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?(\[[^\]/?#@]*\]|[^/:?#@\[\]]+)"
ADDRESS = r"^(\[.*\]|[0-9]+(\.[0-9]+){3})$"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def url_host(url: str = "url"):
    """Lower-case host without user, port and a final dot; empty when there is none."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), HOST, 1)), r"\.+$", "")


def url_keys(url: str = "url"):
    """Domain suffixes of the host with two labels or more (or the host), then host and leading path parts.

    The parts of an address are no domains: it has itself only.
    """
    host = url_host(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    suffixes = F.when((n <= 2) | F.regexp_like(host, F.lit(ADDRESS)), F.array(host)).otherwise(
        F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n - i + 1), "."))
    )
    parts = F.filter(F.split(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), PATH, 1), "/"), lambda x: x != "")
    leading = F.transform(
        F.filter(F.sequence(F.lit(0), F.size(parts)), lambda i: i > 0), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i), "/"))
    )
    return F.when(host != "", F.array_distinct(F.concat(suffixes, leading))).otherwise(F.array().cast("array<string>"))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(list, effect, key, since, until) from entries (list, effect, key, day, action).

    ``until`` is the first day it no longer holds, null while it holds. Of several entries of a list, key
    and day an ``add`` wins; repeated adds and removes change nothing. Entries with a null list, key or
    day, or another action, are ignored; a null effect blocks. One key has at most a row per day.
    """
    good = entries.where("list IS NOT NULL AND key IS NOT NULL AND day IS NOT NULL AND action IN ('add', 'remove')")
    daily = good.groupBy("list", "key", F.col("day").cast("date").alias("day")).agg(
        F.max((F.col("action") == "add").cast("int")).alias("on"), F.max(F.coalesce("effect", F.lit("block"))).alias("effect")
    )
    history = W.partitionBy("list", "key").orderBy("day")
    changes = daily.withColumn("was", F.coalesce(F.lag("on").over(history), F.lit(0))).where(F.col("on") != F.col("was"))
    spans = changes.withColumn("until", F.lead("day").over(history))
    return spans.where("on = 1").select("list", "effect", "key", F.col("day").alias("since"), "until")


def active_entries(captures: DataFrame, entries: DataFrame, url_col: str = "url", day_col: str = "fetched") -> DataFrame:
    """The captures with ``active``, ``n_active`` and ``blocked`` added.

    ``active`` holds (key, list, effect) of the entries in force on the capture's day, sorted. The entry
    with the longest key decides ``blocked``; of equally long ones, one that blocks. A null URL or day, or
    a URL without a host, sees no entries. Repeated captures keep a row each; empty captures give no
    rows, empty lists no entries. Columns of these names in the input are replaced, others stay.
    """
    rows = captures.drop("active", "n_active", "blocked").withColumn("_url", F.col(url_col).cast("string")).withColumn("_day", F.col(day_col).cast("date"))
    seen = rows.where("_url IS NOT NULL AND _day IS NOT NULL").select("_url", "_day").distinct()
    keyed = seen.select("_url", "_day", F.explode(url_keys("_url")).alias("key"))
    asked = keyed.select("key", "_day").distinct().withColumn("year", F.year("_day"))
    intervals = validity_intervals(entries)
    # Only the years that captures have, so an interval still open reaches the last of them.
    years = rows.where("_url IS NOT NULL AND _day IS NOT NULL").agg(F.collect_set(F.year("_day")).alias("_years"))
    met_years = F.expr("filter(_years, y -> y >= year(since) AND (until IS NULL OR y <= year(date_sub(until, 1))))")
    by_year = intervals.crossJoin(F.broadcast(years)).withColumn("year", F.explode(met_years)).drop("_years")
    in_force = asked.join(by_year, ["key", "year"]).where("since <= _day AND (until IS NULL OR _day < until)").select("key", "_day", "list", "effect")
    met = keyed.join(in_force, ["key", "_day"]).groupBy("_url", "_day").agg(F.array_sort(F.collect_set(F.struct("key", "list", "effect"))).alias("active"))
    joined = rows.join(met, ["_url", "_day"], "left")
    joined = joined.withColumn("active", F.coalesce("active", F.array().cast("array<struct<key:string,list:string,effect:string>>")))
    rank = F.transform("active", lambda x: F.struct(F.length(x["key"]).alias("n"), (x["effect"] == "block").alias("block")))
    return joined.withColumn("n_active", F.size("active").cast("long")).withColumn("blocked", F.coalesce(F.array_max(rank)["block"], F.lit(False))).drop("_url", "_day")
