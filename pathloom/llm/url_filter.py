"""URL filters over time: which list entries were active when a page was fetched.

List entries are dated events (add, remove) on a pattern. The events of a pattern become
validity intervals [date, next date), and each capture is joined as of its fetch time. Patterns
are a host, a domain (with all hosts below it), a path prefix (host and path segments) or a whole
URL; letter case counts in paths. Captures carry one key for each pattern that could match them, so the
join is an equality on key and month with a range test on the time: intervals are cut by month,
which keeps a pattern that is listed again and again from meeting all its captures, and deals
a hot host over its months.

Defined cases: a null or malformed URL has no host, matches nothing and is kept; a null fetch
time matches nothing; host names are compared in lower case without port, user and final dot;
of a remove and an add on one date the remove holds; equal events are one; equal captures are judged each for itself; other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pathloom.llm.common import table

#: Segments that the SQL goes down to; its lists have prefixes of one.
SEGMENTS = 4


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without user, port and final dot; null if there is none."""
    raw = F.lower(F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\\]*@)?([^/?#:@\\\s]+)", 1))
    host = F.regexp_replace(raw, r"\.+$", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path of a URL without its first slash, query and fragment."""
    return F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)", 1)


def keys(url: str, host: str, deepest: str) -> Column:
    """All keys of patterns that could match a URL, with prefixes of up to `deepest` segments. The key "" stands for the capture itself."""
    labels, parts = F.split(host, r"\."), F.filter(F.split(path_of(F.col(url)), "/"), lambda x: x != "")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.lit("domain:"), F.array_join(F.slice(labels, i, F.size(labels)), ".")))
    n = F.least(F.size(parts), F.col(deepest))
    prefixes = F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.concat(F.lit("prefix:"), F.col(host), F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")))).otherwise(F.array().cast("array<string>"))
    some = F.concat(F.array(F.lit(""), F.concat(F.lit("host:"), F.col(host)), F.concat(F.lit("url:"), F.trim(F.col(url)))), domains, prefixes)
    return F.when(F.col(host).isNull(), F.array(F.lit(""))).otherwise(some)


def month(at: Column) -> Column:
    return (F.year(at) * 12 + F.month(at)).cast("int")


def _prefix() -> Column:
    """A prefix pattern with its host in lower case."""
    host = F.substring_index("pattern", "/", 1)
    return F.concat(F.lower(host), F.substr("pattern", F.length(host) + 1))


def intervals(entries: DataFrame) -> DataFrame:
    """list, key, since, until (null: still active) from events (list, kind, pattern, date, action)."""
    events = entries.select("list", F.concat_ws(":", F.lower("kind"), F.when(F.lower("kind") == "url", F.trim("pattern")).when(F.lower("kind") == "prefix", _prefix()).otherwise(F.lower("pattern"))).alias("key"), F.col("date").cast("timestamp").alias("date"), "action")
    events = events.where("list is not null and date is not null").groupBy("list", "key", "date").agg(F.max("action").alias("action"))  # 'remove' is the larger word
    events = events.withColumn("until", F.lead("date").over(Window.partitionBy("list", "key").orderBy("date")))
    return events.where("action = 'add'").select("list", "key", F.col("date").alias("since"), "until")


def evaluate(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """page_id, url, host, fetched, n_lists, lists and blocked for each capture (page_id, url, fetched)."""
    rows = captures.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("fetched").cast("timestamp").alias("fetched"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    # Prefixes end with the deepest entry; one row.
    deepest = entries.where(F.lower("kind") == "prefix").agg(F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0)).alias("deepest"))
    rows = rows.crossJoin(F.broadcast(deepest)).withColumn("key", F.explode(keys("url", "host", "deepest"))).drop("deepest")
    rows = rows.withColumn("month", month(F.col("fetched")))
    # Open intervals end with the last capture; one row.
    last = F.broadcast(captures.agg(F.max(F.col("fetched").cast("timestamp")).alias("last")))
    active = intervals(entries).join(last, F.col("since") <= F.col("last"))
    end = F.least(F.coalesce("until", "last"), "last")
    active = active.withColumn("month", F.explode(F.sequence(month(F.col("since")), month(end)))).select("list", "key", "since", "until", "month")
    joined = rows.join(active, ["key", "month"], "left")
    holds = (F.col("since") <= F.col("fetched")) & (F.col("until").isNull() | (F.col("fetched") < F.col("until")))
    # Events of several lists can multiply the capture's own row only for the key "", which no list has.
    met = joined.groupBy("page_id", "url", "host", "fetched").agg(F.collect_set(F.when(holds, F.col("list"))).alias("found"), F.sum((F.col("key") == "").cast("int")).alias("rows"))
    met = met.withColumn("found", F.array_sort("found"))
    return met.select("page_id", "url", "host", "fetched", F.size("found").cast("long").alias("n_lists"), F.array_join("found", ",").alias("lists"), (F.size("found") > 0).alias("blocked"), F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int"))).alias("_")).drop("_")


# The registered query: fetch times and list events are derived from the pages by rule.

FETCHED = "timestamp_seconds(1672531200 + pmod(page_id * 7919, 500) * 86400 + pmod(page_id * 104729, 86400))"
CODE = "(ascii(substring({h}, 1, 1)) * 31 + ascii(substring({h}, 2, 1)) * 7 + ascii(substring({h}, 3, 1)) * 3 + length({h}))"


def derived_captures(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.expr(FETCHED).alias("fetched"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """Events on a part of the hosts, on their parent domains and on first path segments."""
    seen = pages.select(host_of(F.col("url")).alias("host"), F.split(path_of(F.col("url")), "/")[0].alias("first")).where("host is not null").distinct()
    hosts = seen.select("host").distinct().withColumn("c", F.expr(CODE.format(h="host")))
    parents = hosts.select(F.expr("regexp_replace(host, '^[^.]+[.]', '')").alias("host")).where("length(host) - length(replace(host, '.', '')) >= 2").distinct().withColumn("c", F.expr(CODE.format(h="host")))
    paths = seen.where("first <> ''").select(F.concat_ws("/", "host", "first").alias("host")).withColumn("c", F.expr(CODE.format(h="host")))
    made = None
    for kind, source, name, every, events in (
        ("host", hosts, "malware", 4, (("add", 0), ("remove", 90), ("add", 200))),
        ("domain", parents, "spam", 3, (("add", 30), ("remove", 250))),
        ("prefix", paths, "adult", 5, (("add", 10), ("add", 60), ("remove", 300))),
    ):
        for action, days in events:
            part = source.where(f"c % {every} = 0").select(F.lit(name).alias("list"), F.lit(kind).alias("kind"), F.col("host").alias("pattern"), F.expr(f"timestamp_seconds(1672531200 + (c % 100 + {days}) * 86400)").alias("date"), F.lit(action).alias("action"))
            made = part if made is None else made.unionByName(part)
    return made


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    out = evaluate(derived_captures(pages), derived_entries(pages))
    return out.select("page_id", "url", "host", F.date_format("fetched", "yyyy-MM-dd HH:mm:ss").alias("fetched"), "n_lists", "lists", "blocked")


_H = r"nullif(regexp_replace(lower(regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@\\]*@)?([^/?#:@\\\s]+)', 1)), '\.+$', ''), '')"
_P = r"regexp_extract(url, '^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([^?#]*)', 1)"
_C = "(ascii(substr(host, 1, 1)) * 31 + ascii(substr(host, 2, 1)) * 7 + ascii(substr(host, 3, 1)) * 3 + length(host))"
OP6_SQL = rf"""
WITH c AS (SELECT page_id, url, {_H} AS host, {_P} AS path, CAST(1672531200 + (page_id * 7919 % 500) * 86400 + page_id * 104729 % 86400 AS BIGINT) AS t FROM pages),
seen AS (SELECT DISTINCT host, split_part(path, '/', 1) AS first FROM c WHERE host IS NOT NULL),
src AS (
  SELECT 'host' AS kind, host, 4 AS every FROM (SELECT DISTINCT host FROM seen)
  UNION ALL SELECT 'domain', host, 3 FROM (SELECT DISTINCT regexp_replace(host, '^[^.]+[.]', '') AS host FROM seen) WHERE length(host) - length(replace(host, '.', '')) >= 2
  UNION ALL SELECT 'prefix', host, 5 FROM (SELECT host || '/' || first AS host FROM seen WHERE first <> '')),
ev(kind, list, action, days) AS (VALUES ('host', 'malware', 'add', 0), ('host', 'malware', 'remove', 90), ('host', 'malware', 'add', 200), ('domain', 'spam', 'add', 30), ('domain', 'spam', 'remove', 250), ('prefix', 'adult', 'add', 10), ('prefix', 'adult', 'add', 60), ('prefix', 'adult', 'remove', 300)),
events AS (SELECT ev.list, src.kind || ':' || lower(host) AS key, 1672531200 + ({_C} % 100 + days) * 86400 AS since, max(action) AS action FROM src JOIN ev USING (kind) WHERE {_C} % every = 0 GROUP BY ALL),
spans AS (SELECT *, lead(since) OVER (PARTITION BY list, key ORDER BY since) AS until FROM events),
keys AS (
  SELECT page_id, t, 'host:' || host AS key FROM c WHERE host IS NOT NULL
  UNION ALL SELECT page_id, t, 'domain:' || array_to_string(string_split(host, '.')[i:], '.') FROM c, range(1, 200) r(i) WHERE i <= len(string_split(host, '.'))
  UNION ALL SELECT page_id, t, 'prefix:' || host || '/' || array_to_string(p[1:i], '/') FROM (SELECT *, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM c) c, range(1, {SEGMENTS + 1}) r(i) WHERE i <= len(p)),
hit AS (SELECT DISTINCT page_id, list FROM keys JOIN spans USING (key) WHERE action = 'add' AND since <= t AND (until IS NULL OR t < until)),
n AS (SELECT page_id, count(*) AS n, string_agg(list, ',' ORDER BY list) AS lists FROM hit GROUP BY page_id)
SELECT c.page_id, url, host, strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS fetched, CAST(coalesce(n, 0) AS BIGINT) AS n_lists, coalesce(lists, '') AS lists, n IS NOT NULL AS blocked
FROM c LEFT JOIN n ON c.page_id = n.page_id"""
