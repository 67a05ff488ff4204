"""URL filters by a temporal join with dated lists.

List entries (key, list, day, action) become validity intervals: an added entry
holds until its key is next removed or added again. A capture is evaluated
against the entries that were active on the day it was fetched, for its host, its parent domains
and its host with each prefix of its path, as deep as the list goes.

The join never compares a capture with a whole history: captures shrink to
different (key, day) pairs first, and time is cut into periods, so that the join
is on (key, period) and a key with very many captures or entries is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.llm.common import ready

PERIOD_DAYS = 64
_FOREVER = 1 << 40


def url_host(url: Column) -> Column:
    """Lower-case host of an absolute URL, without user, port or final dot; null if there is none."""
    host = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)", 1))
    host = F.regexp_replace(host, "\\.$", "")
    return F.when(host != "", host)


def url_keys(url: Column, host: Column, depth: int) -> Column:
    """List keys of a URL: its host, each parent domain of two labels or more, host with up to ``depth`` path segments."""
    labels = F.split(host, "\\.")
    n = F.size(labels)
    tails = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.array_join(F.slice(labels, i, n), "."))
    path = F.split(F.regexp_extract(url, "^[^:]+://[^/?#]*/([^?#]*)", 1), "/")
    segments = F.slice(F.filter(path, lambda x: x != ""), 1, depth)
    pages = F.transform(segments, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, 1, i + 1), "/")))
    return F.when(host.isNotNull(), F.concat(tails, pages)).otherwise(F.array().cast("array<string>"))


def list_key(key: Column) -> Column:
    """A list entry's key as ``url_keys`` writes it: no scheme, query, final dot or empty segment, a lower-case host; null if no host is left."""
    bare = F.regexp_replace(F.regexp_replace(key, "^[A-Za-z][A-Za-z0-9+.-]*://", ""), "(?s)[?#].*", "")
    parts = F.filter(F.split(bare, "/"), lambda x: x != "")
    host = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), "\\.$", "")
    return F.when(host != "", F.array_join(F.concat(F.array(host), F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))), "/"))


def validity(entries: DataFrame) -> DataFrame:
    """(key, list, since, until) of entries (key, list, day, action add or remove); until is exclusive.

    Of entries of one key, list and day, remove counts. An entry repeated while
    it holds renews it. Keys are brought into one form (``list_key``), lists and
    actions count in any case. Entries with a null field are void.
    """
    plain = lambda c: F.lower(F.trim(F.col(c))).alias(c)
    sound = entries.select(list_key(F.col("key")).alias("key"), plain("list"), F.col("day").cast("long").alias("day"), plain("action")).dropna()
    daily = sound.groupBy("key", "list", "day").agg(F.max("action").alias("action"))
    until = F.lead("day").over(W.partitionBy("key", "list").orderBy("day"))
    daily = daily.withColumn("until", F.coalesce(until, F.lit(_FOREVER)))
    return daily.where("action = 'add'").select("key", "list", F.col("day").alias("since"), "until")


def active_entries(moments: DataFrame, intervals: DataFrame, period: int = PERIOD_DAYS) -> DataFrame:
    """Intervals that hold at each different (key, day) of ``moments``."""
    moments = moments.select("key", "day").dropna().distinct()
    first, last = moments.agg(F.min("day"), F.max("day")).first()
    cell = lambda day: F.floor(day / F.lit(period))
    # Without captures no interval holds: the span is empty.
    first, last = (F.lit(0), F.lit(-1)) if first is None else (F.lit(first), F.lit(last))
    held = intervals.where((F.col("since") <= last) & (F.col("until") > first) & (first <= last))
    cells = F.sequence(cell(F.greatest("since", first)), cell(F.least(F.col("until") - 1, last)))
    held = held.select("key", "list", "since", "until", F.explode(cells).alias("cell"))
    moments = moments.withColumn("cell", cell(F.col("day")))
    found = moments.join(held, ["key", "cell"])
    return found.where((F.col("since") <= F.col("day")) & (F.col("day") < F.col("until"))).drop("cell", "until")


def filter_urls(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict per row of ``captures`` (page_id, url, day): the most specific active entry decides.

    Returns page_id, day, host, verdict (block, allow or none), matched_key,
    listed_since, kept. The longest key is the most specific; where both lists
    hold one key, allow wins. A null or relative URL, or a null day, matches
    nothing and is kept. Repeated captures give rows of their own. Other columns
    are not read. No rows give no rows; no entries keep everything.
    """
    ready(captures.sparkSession)
    host, intervals = url_host(F.col("url")), validity(entries)
    # No key is made that is deeper than any entry.
    depth = intervals.agg(F.max(F.size(F.split("key", "/")) - 1)).first()[0] or 0
    keys = url_keys(F.col("url"), host, depth)
    rows = captures.select(F.col("page_id").cast("long"), F.col("day").cast("long"), host.alias("host"), keys.alias("keys"))
    moments = rows.select(F.explode("keys").alias("key"), "day")
    active = active_entries(moments, intervals)
    # A capture's keys are a function of host and path: judge each different (keys, day) once.
    cases = rows.where("size(keys) > 0 and day is not null").select("keys", "day").distinct()
    spread = cases.select("keys", "day", F.explode("keys").alias("key")).join(active, ["key", "day"])
    order = F.struct(F.length("key").alias("n"), (F.col("list") == "allow").alias("allows"), F.col("key"), F.col("since"))
    judged = spread.groupBy("keys", "day").agg(F.max(order).alias("top"))
    judged = judged.select(F.col("keys").alias("k"), F.col("day").alias("d"), "top")
    out = rows.join(judged, (F.col("keys") == F.col("k")) & (F.col("day") == F.col("d")), "left")
    verdict = F.when(F.col("top").isNull(), "none").when(F.col("top.allows"), "allow").otherwise("block")
    return out.select(
        "page_id",
        "day",
        "host",
        verdict.alias("verdict"),
        F.col("top.key").alias("matched_key"),
        F.col("top.since").alias("listed_since"),
        (verdict != "block").alias("kept"),
    )


def own_captures(pages: DataFrame, days: int = 730) -> DataFrame:
    """``pages`` with a fetch day, which that table lacks: spread over two years by page_id."""
    return pages.select("page_id", "url", F.pmod(F.col("page_id") * 37, F.lit(days)).alias("day"))


def own_lists(pages: DataFrame, days: int = 730, depth: int = 2) -> DataFrame:
    """A dated list over the keys of up to ``depth`` path segments that occur in ``pages``, since no list table is given.

    md5 of the key decides: a third of the keys are blocked, removed later and
    blocked again; a fifth are allowed from some day on.
    """
    host = url_host(F.col("url"))
    keys = pages.select(F.explode(url_keys(F.col("url"), host, depth)).alias("key")).distinct()
    number = lambda at: F.conv(F.substring(F.md5("key"), at, 6), 16, 10).cast("long")
    first = F.pmod(number(7), F.lit(days))
    gone = first + 30 + F.pmod(number(13), F.lit(200))
    entry = lambda name, day, action: F.struct(F.lit(name).alias("list"), day.alias("day"), F.lit(action).alias("action"))
    block = F.array(entry("block", first, "add"), entry("block", gone, "remove"), entry("block", gone + 90, "add"))
    allow = F.array(entry("allow", F.pmod(number(19), F.lit(days)), "add"))
    none = F.array().cast("array<struct<list:string,day:bigint,action:string>>")
    both = F.concat(
        F.when(F.pmod(number(1), F.lit(3)) == 0, block).otherwise(none),
        F.when(F.pmod(number(1), F.lit(5)) == 0, allow).otherwise(none),
    )
    return keys.select("key", F.explode(both).alias("e")).select("key", "e.list", "e.day", "e.action")
