"""URL filters by a temporal list join.

Dated add/remove entries of block and allow lists become validity intervals
[since, until). A capture is evaluated against the entries that were active
when it was fetched; the most specific active entry (path prefix, then host,
then the longest parent domain) decides, and block wins a tie. Intervals and
captures are cut into months, so that the as-of join is an equi-join on
(pattern, month): a host with a third of all captures is spread over months,
and Spark may split what is left of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

OPEN_END = "9999-12-31"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL; null where there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1), F.lit("")))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """pattern, action, since, until from dated rows pattern, action, op (add|remove), day.

    Per (pattern, action) an interval runs from an "add" to the next "remove"
    (exclusive), or stays open; repeated adds extend nothing, removes without
    an add do nothing, of equal days the remove comes first. Rows with a null
    pattern or day are ignored.
    """
    w = W.partitionBy("pattern", "action").orderBy("day", F.desc("op"))
    seen = (
        entries.filter(F.col("pattern").isNotNull() & F.col("day").isNotNull())
        .select("pattern", "action", "op", "day")
        .withColumn("was", F.lag("op").over(w))
        .filter(F.coalesce(F.col("was"), F.lit("remove")) != F.col("op"))
        .withColumn("until", F.coalesce(F.lead("day").over(w), F.lit(OPEN_END).cast("date")))
    )
    return seen.filter("op = 'add'").select("pattern", "action", F.col("day").alias("since"), "until")


def capture_patterns(host: Column, url: Column) -> Column:
    """array<struct<rank, pattern>>: the path prefix, the host and its parent domains of two labels or more."""
    labels = F.split(host, r"\.")
    first = F.regexp_extract(url, r"^[^:]+://[^/]*(/[^/?#]*/)", 1)
    domains = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))),
        lambda i: F.struct(i.alias("rank"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern")),
    )
    return F.concat(F.array(F.struct(F.lit(0).alias("rank"), F.concat(host, F.nullif(first, F.lit(""))).alias("pattern"))), domains)


def filter_captures(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """Verdict on captures (page_id, url, fetched date): page_id, host, fetched, blocked, rule, since.

    rule and since are those of the deciding entry, null where none is active.
    Captures with a null or hostless URL or a null date match no entry and are
    not blocked. Repeated page_ids are decided row by row only if their url or
    date differ; identical rows come back once each. Intervals are only cut into
    months in which there are captures at all.
    """
    rows = captures.select("page_id", "url", F.col("fetched").cast("date").alias("fetched")).withColumn("host", host_of(F.col("url")))
    month = lambda c: F.year(c) * 12 + F.month(c)
    first, last = rows.agg(F.min(month("fetched")), F.max(month("fetched"))).first()
    low, high = F.greatest(month("since"), F.lit(first).cast("int")), F.least(month("until"), F.lit(last).cast("int"))
    cut = validity_intervals(entries).filter(low <= high).withColumn("m", F.explode(F.sequence(low, high)))
    wanted = (
        rows.filter(F.col("host").isNotNull() & F.col("fetched").isNotNull())
        .select("page_id", "url", "fetched", F.explode(capture_patterns(F.col("host"), F.col("url"))).alias("p"))
        .select("page_id", "url", "fetched", "p.rank", "p.pattern", month("fetched").alias("m"))
        .filter("pattern is not null")
    )
    active = wanted.join(cut, ["pattern", "m"]).filter("fetched >= since and fetched < until")
    order = F.struct("rank", F.when(F.col("action") == "block", 0).otherwise(1).alias("o"), "since", "pattern", "action")
    verdict = active.groupBy("page_id", "url", "fetched").agg(F.min(order).alias("v"))
    out = rows.alias("r").join(
        verdict.alias("v"),
        F.col("r.page_id").eqNullSafe(F.col("v.page_id")) & (F.col("r.url") == F.col("v.url")) & (F.col("r.fetched") == F.col("v.fetched")),
        "left",
    )
    return out.select(
        F.col("r.page_id").alias("page_id"), "host", F.col("r.fetched").alias("fetched"), F.coalesce(F.col("v.v.action") == "block", F.lit(False)).alias("blocked"),
        F.concat_ws(":", F.col("v.v.action"), F.col("v.v.pattern")).alias("rule_"), F.col("v.v.since").alias("since"),
    ).withColumn("rule", F.nullif("rule_", F.lit(""))).drop("rule_").select("page_id", "host", "fetched", "blocked", "rule", "since")


def pages_captures(pages: DataFrame) -> DataFrame:
    """The query's captures: every page, fetched on a day of 2024 fixed by its page_id."""
    return pages.select("page_id", "url", F.expr("date_add(date '2024-01-01', cast(pmod(page_id * 37, 366) as int))").alias("fetched"))


def pages_entries(pages: DataFrame) -> DataFrame:
    """The query's lists, fixed by an MD5 of each pattern met in pages.

    Half the hosts are blocked for a stretch, a quarter of them again later; a
    quarter of the two-label domains are blocked until further notice; a
    quarter of the path prefixes are allowed for half a year.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host"), "url").filter("host is not null")
    named = hosts.select("host", F.explode(capture_patterns(F.col("host"), F.col("url"))).alias("p"))
    patterns = named.select(
        F.col("p.pattern").alias("pattern"), F.when(F.col("p.rank") == 0, "prefix").when(F.col("p.pattern") == F.col("host"), "host").otherwise("domain").alias("kind")
    ).filter("pattern is not null").distinct()
    h = F.conv(F.substring(F.md5("pattern"), 1, 6), 16, 10).cast("int")
    entry = lambda action, op, day: F.struct(F.lit(action).alias("action"), F.lit(op).alias("op"), F.expr(f"date_add(date '2024-01-01', cast({day} as int))").alias("day"))
    none = F.array().cast("array<struct<action:string,op:string,day:date>>")
    rows = (
        F.when((F.col("kind") == "host") & (F.col("h") % 4 == 0), F.array(entry("block", "add", "h % 150"), entry("block", "remove", "h % 150 + 60"), entry("block", "add", "h % 150 + 150")))
        .when((F.col("kind") == "host") & (F.col("h") % 4 == 2), F.array(entry("block", "add", "h % 200"), entry("block", "remove", "h % 200 + 90")))
        .when((F.col("kind") == "domain") & (F.col("h") % 4 == 1), F.array(entry("block", "add", "h % 300")))
        .when((F.col("kind") == "prefix") & (F.col("h") % 4 == 3), F.array(entry("allow", "add", "h % 180"), entry("allow", "remove", "h % 180 + 183")))
        .otherwise(none)
    )
    return patterns.withColumn("h", h).select("pattern", F.explode(rows).alias("e")).select("pattern", "e.action", "e.op", "e.day")


URL_SQL = r"""
WITH hosts AS (SELECT page_id, url, nullif(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1)), '') AS host,
                      DATE '2024-01-01' + ((page_id * 37) % 366)::INTEGER AS fetched FROM pages),
pats AS (SELECT page_id, url, host, fetched, 0 AS rank, host || nullif(regexp_extract(url, '^[^:]+://[^/]*(/[^/?#]*/)', 1), '') AS pattern FROM hosts
         UNION ALL SELECT page_id, url, host, fetched, i::INTEGER, array_to_string(list_slice(string_split(host, '.'), i::INTEGER, len(string_split(host, '.'))), '.')
         FROM (SELECT *, unnest(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1)) AS i FROM hosts WHERE host IS NOT NULL)),
kinds AS (SELECT DISTINCT pattern, CASE WHEN rank = 0 THEN 'prefix' WHEN pattern = host THEN 'host' ELSE 'domain' END AS kind FROM pats WHERE pattern IS NOT NULL),
h AS (SELECT *, ('0x' || substr(md5(pattern), 1, 6))::BIGINT AS h FROM kinds),
iv AS (SELECT pattern, 'block' AS action, h % 150 AS a, h % 150 + 60 AS b FROM h WHERE kind = 'host' AND h % 4 = 0
       UNION ALL SELECT pattern, 'block', h % 150 + 150, 3000000 FROM h WHERE kind = 'host' AND h % 4 = 0
       UNION ALL SELECT pattern, 'block', h % 200, h % 200 + 90 FROM h WHERE kind = 'host' AND h % 4 = 2
       UNION ALL SELECT pattern, 'block', h % 300, 3000000 FROM h WHERE kind = 'domain' AND h % 4 = 1
       UNION ALL SELECT pattern, 'allow', h % 180, h % 180 + 183 FROM h WHERE kind = 'prefix' AND h % 4 = 3),
act AS (SELECT p.page_id, p.rank, iv.pattern, iv.action, DATE '2024-01-01' + iv.a::INTEGER AS since,
               row_number() OVER (PARTITION BY p.page_id ORDER BY p.rank, CASE WHEN action = 'block' THEN 0 ELSE 1 END, iv.a, iv.pattern) AS rn
        FROM pats p JOIN iv ON p.pattern = iv.pattern AND p.fetched >= DATE '2024-01-01' + iv.a::INTEGER AND date_diff('day', DATE '2024-01-01', p.fetched) < iv.b)
SELECT h.page_id, h.host, h.fetched, coalesce(a.action = 'block', false) AS blocked, a.action || ':' || a.pattern AS rule, a.since
FROM hosts h LEFT JOIN act a ON h.page_id = a.page_id AND a.rn = 1
"""
