"""URL filters: a temporal join of captures with a dated list, on DataFrame functions alone.

The list is a table of dated events: an entry is put on the list (``listed`` true)
or taken off.  Events of one entry become validity intervals [since, until).  Each
capture is joined, as of its fetch time, with the entries active then: entries
of kind ``host`` equal the capture's host, ``domain`` covers a host and what is
below it, ``prefix`` covers a host and path up to a path segment's end.  The most
specific active entry decides (prefix before host before domain, the longer
first); block wins over allow between equals.

URLs that are null or have no host, and captures without a fetch time, match no
entry and get the verdict ``none``.  Of events at one instant, putting on the list wins.
Events with a null field play no part.  Repeated captures get the same verdict,
and are joined once; extra columns pass through, whatever their names.  Whole URLs are read, however long.  An
empty list gives ``none`` to all; without captures the result is empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prefero.llm.common import ascii_lower, small_side, staged, unused

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
#: The kinds, from the least specific.
KINDS = ("domain", "host", "prefix")


def intervals(events: DataFrame) -> DataFrame:
    """entry, kind, action, since, until (null: still on the list) from entry, kind, action, at, listed."""
    host, rest = F.substring_index("entry", "/", 1), F.regexp_extract("entry", r"^[^/]*(/.*)$", 1)
    known = events.select(F.concat(ascii_lower(host), rest).alias("entry"), "kind", "action", "at", "listed").na.drop().groupBy("entry", "kind", "action", "at").agg(F.max("listed").alias("listed"))
    following = F.lead("at").over(W.partitionBy("entry", "kind", "action").orderBy("at"))
    return known.withColumn("until", following).where("listed").select("entry", "kind", "action", F.col("at").alias("since"), "until")


def host_of(url: Column) -> Column:
    """Host in lower case without a final dot; null if there is none."""
    host = F.rtrim(ascii_lower(F.regexp_extract(url, HOST, 1)), F.lit("."))
    return F.when(host != "", host)


def _depths(active: DataFrame) -> tuple[int, int]:
    """The most labels of a domain on the list, and the most segments of a prefix: no part of a URL beyond them can match."""
    labels, segments = F.size(F.split("entry", r"\.")), F.size(F.split("entry", "/")) - 1
    found = active.agg(F.max(F.when(F.col("kind") == "domain", labels)), F.max(F.when(F.col("kind") == "prefix", segments))).collect()[0]
    return found[0] or 0, found[1] or 0


def _covers(asked: DataFrame, depths: tuple[int, int]) -> DataFrame:
    """place, of: each place with the (kind, entry) pairs that would cover it and may be on the list.

    A URL of any length makes as many pairs as the list's longest entries have parts, not as many as it has itself.
    """
    host = F.col("place.host")
    labels = F.split(host, r"\.")
    split = asked.select("place", labels.alias("labels"), F.filter(F.split("place.path", "/"), lambda s: s != "").alias("segments"))
    last = F.least(F.size("labels"), F.lit(depths[0]))
    ends = F.slice("labels", F.size("labels") - last + 1, last)
    short = split.select("place", ends.alias("labels"), F.slice("segments", 1, depths[1]).alias("segments"))
    kind = lambda k: F.lit(k).alias("kind")
    places = F.when(F.size("labels") > 0, F.sequence(F.lit(1), F.size("labels"))).otherwise(F.array().cast("array<int>"))
    domains = F.transform(places, lambda i: F.struct(kind("domain"), F.array_join(F.slice("labels", i, F.size("labels")), ".").alias("entry")))
    begun = lambda i: F.when(i > 0, F.slice("segments", F.lit(1), i)).otherwise(F.array().cast("array<string>"))
    prefixes = F.transform(F.sequence(F.lit(0), F.size("segments")), lambda i: F.struct(kind("prefix"), F.concat_ws("/", F.array(host), begun(i)).alias("entry")))
    return short.select("place", F.explode(F.concat(domains, F.array(F.struct(kind("host"), host.alias("entry"))), prefixes)).alias("of"))


def with_verdicts(captures: DataFrame, events: DataFrame, out: str = "filter") -> DataFrame:
    """``captures`` (url, fetched) with a struct: verdict, entry, kind, since.

    Only distinct (host, path, fetched) meet the list.  The intervals, and then the
    verdicts found, are broadcast if their measured size is small; else they join by
    shuffle, where AQE splits what a hot host brings together.
    """
    active = staged(intervals(events), "intervals")
    depths = _depths(active)
    active = small_side(active)
    place = F.struct(host_of(F.col("url")).alias("host"), F.regexp_extract("url", PATH, 1).alias("path"), F.col("fetched").alias("fetched"))
    asked = captures.select(place.alias("place")).where("place.host IS NOT NULL AND place.fetched IS NOT NULL").distinct()
    asked = _covers(asked, depths)
    on = (asked["of.kind"] == active["kind"]) & (asked["of.entry"] == active["entry"]) & (active["since"] <= asked["place.fetched"]) & (active["until"].isNull() | (asked["place.fetched"] < active["until"]))
    order = F.struct(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.length("entry"), F.col("action") == "block", "action", "since")
    best = F.max_by(F.struct(F.col("action").alias("verdict"), "entry", "kind", "since"), order)
    found = small_side(staged(asked.join(active, on).groupBy("place").agg(best.alias("_found")).withColumnRenamed("place", "_found_place"), "verdicts"))
    none = F.struct(F.lit("none").alias("verdict"), F.lit(None).cast("string").alias("entry"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast(active.schema["since"].dataType).alias("since"))
    mine, theirs, verdict = (unused(n, captures) for n in ("_place", "_found_place", "_found"))
    kept = captures.drop(out).withColumn(mine, place)
    found = found.select(F.col("_found_place").alias(theirs), F.col("_found").alias(verdict))
    joined = kept.join(found, kept[mine] == found[theirs], "left")
    return joined.select(*[kept[c] for c in captures.columns if c != out], F.coalesce(verdict, none).alias(out))
