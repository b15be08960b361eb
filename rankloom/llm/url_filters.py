"""URL filters by a temporal list join: each capture meets the list entries that were active when it was fetched."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: Patterns up to so many are broadcast (their number is checked first); more are joined by a shuffle with SALTS.
BROADCAST_PATTERNS, SALTS = 100_000, 16


def host_of(url: Column) -> Column:
    """The lower-cased host of an absolute URL, without user, port and last dot (an IPv6 address in its brackets); null if there is none."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)", 1))
    return F.nullif(F.regexp_replace(host, r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """The path of an absolute URL, from its first slash on, without query and fragment."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def validity(entries: DataFrame) -> DataFrame:
    """(list_name, pattern, valid_from, valid_to) from dated entries (list_name, pattern, action, at).

    An `add` holds until the next entry of the same list and pattern, a `remove` ends it; valid_to is null
    while nothing follows. Of entries at one time a remove counts last; repeated adds join up. Entries with
    a null in list, pattern or time, or another action, are left out. Patterns are lower-cased; an interval
    without length vanishes.
    """
    good = entries.where(F.col("action").isin("add", "remove") & F.col("list_name").isNotNull() & F.col("pattern").isNotNull() & F.col("at").isNotNull())
    good = good.select("list_name", F.lower("pattern").alias("pattern"), "action", "at").distinct()
    each = Window.partitionBy("list_name", "pattern").orderBy("at", "action")
    spans = good.withColumn("valid_to", F.lead("at").over(each)).where("action = 'add' and (valid_to is null or valid_to > at)")
    return spans.select("list_name", "pattern", F.col("at").alias("valid_from"), "valid_to")


def candidates(host: str, path: str, deepest: int) -> Column:
    """The patterns that can match a URL: its host and each parent domain, and its host with each whole path prefix up to deepest segments."""
    labels = f"split({host}, '[.]')"
    hosts = f"transform(sequence(1, size({labels})), i -> array_join(slice({labels}, i, size({labels}) - i + 1), '.'))"
    parts = f"filter(split({path}, '/'), x -> x <> '')"
    depth = f"least({deepest}, size({parts}))"
    paths = f"if({depth} < 1, cast(array() as array<string>), transform(sequence(1, greatest(1, {depth})), i -> {host} || '/' || array_join(slice({parts}, 1, i), '/')))"
    return F.expr(f"if({host} is null, cast(array() as array<string>), array_distinct(concat({hosts}, {paths})))")


def filter_captures(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", time_col: str = "fetched_at") -> DataFrame:
    """(page_id, url, fetched_at, host, lists, n_entries, blocked) for every row of captures.

    An entry's pattern is a host, which also covers its subdomains, or host/path without a last slash, which
    covers whole path segments below it. lists are the names, in order, of the lists with an entry active at
    the fetch: valid_from <= fetched_at < valid_to. A URL without a host, a null URL or a null time match
    nothing. Repeated rows stay repeated; empty tables are allowed on either side; other columns are ignored.

    Method: dated entries become validity intervals, gathered to one row for each pattern; captures explode
    to the patterns that can match them and meet the intervals by equality, the time as a residual. The
    patterns' number is checked: few are broadcast; otherwise patterns are repeated for each of SALTS shares
    of the captures, so that a host with a third of all captures is spread.
    """
    spans = validity(entries)
    patterns = stored(spans.groupBy("pattern").agg(F.collect_list(F.struct("list_name", "valid_from", "valid_to")).alias("spans")))
    n, deepest = patterns.agg(F.count("*"), F.coalesce(F.max(F.size(F.split("pattern", "/")) - 1), F.lit(0))).first()
    base = captures.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(time_col).alias("fetched_at"))
    base = base.withColumn("host", host_of(F.col("url")))
    open_ = base.where("host is not null and fetched_at is not null").select("page_id", "url", "fetched_at").distinct()
    open_ = open_.select("*", host_of(F.col("url")).alias("host"), F.lower(path_of(F.col("url"))).alias("path"))
    wide = open_.select("page_id", "url", "fetched_at", F.explode(candidates("host", "path", deepest)).alias("pattern"))
    if n <= BROADCAST_PATTERNS:
        met = wide.join(F.broadcast(patterns), "pattern")
    else:
        salted = patterns.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = wide.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(salted, ["pattern", "salt"])
    active = met.withColumn("hits", F.expr("filter(spans, x -> x.valid_from <= fetched_at and (x.valid_to is null or fetched_at < x.valid_to))")).where("size(hits) > 0")
    found = active.groupBy("page_id", "url", "fetched_at").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.expr("transform(hits, x -> x.list_name)"))))).alias("lists"), F.sum(F.size("hits")).alias("n_entries"))
    same = (F.col("b.page_id").eqNullSafe(F.col("f.page_id"))) & (F.col("b.url") == F.col("f.url")) & (F.col("b.fetched_at") == F.col("f.fetched_at"))
    out = base.alias("b").join(found.alias("f"), same, "left")
    none = F.expr("cast(array() as array<string>)")
    return out.select("b.page_id", "b.url", "b.fetched_at", "host", F.coalesce("lists", none).alias("lists"), F.coalesce("n_entries", F.lit(0)).cast("long").alias("n_entries"), F.col("lists").isNotNull().alias("blocked"))


#: The query's lists by a rule on each host's md5 (written alike for both engines): which hosts and paths
#: are entered, and when they come, go and come again.
ENTRIES = """
  select 'spam' as list_name, host as pattern, 'add' as action, date '2024-01-01' + cast(ascii(substr(h, 2, 1)) as int) as day_at from hosts where ascii(substr(h, 1, 1)) % 3 = 0
  union all select 'spam', host, 'remove', date '2024-01-01' + cast(ascii(substr(h, 2, 1)) + ascii(substr(h, 3, 1)) as int) from hosts where ascii(substr(h, 1, 1)) % 3 = 0 and ascii(substr(h, 4, 1)) % 2 = 0
  union all select 'spam', host, 'add', date '2024-01-01' + cast(ascii(substr(h, 2, 1)) + ascii(substr(h, 3, 1)) + 60 as int) from hosts where ascii(substr(h, 1, 1)) % 3 = 0 and ascii(substr(h, 4, 1)) % 4 = 0
  union all select 'paths', host || '/en', 'add', date '2024-01-01' + cast(2 * ascii(substr(h, 5, 1)) as int) from hosts where ascii(substr(h, 6, 1)) % 2 = 0
  union all select 'parents', substr(host, strpos_dot + 1), 'add', date '2024-06-01' from (select host, h, {dot} as strpos_dot from hosts) x where ascii(substr(h, 7, 1)) % 5 = 0 and host like '%.%.%.%'
"""


def op3_rows(pages: DataFrame) -> DataFrame:
    """Every page as a capture, fetched on a day of 2024 by its id, against lists made from the hosts by ENTRIES."""
    spark = pages.sparkSession
    captures = pages.select("page_id", "url", F.expr("date_add(date '2024-01-01', cast(page_id * 37 % 365 as int))").alias("fetched_at"))
    hosts = stored(captures.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct())
    entries = spark.sql(ENTRIES.format(dot="instr(host, '.')").replace("from hosts", "from {hosts}"), hosts=hosts.withColumn("h", F.md5("host")))
    out = filter_captures(captures, entries.withColumnRenamed("day_at", "at"))
    return out.select("page_id", "host", F.col("fetched_at").cast("string").alias("fetched_at"), F.array_join("lists", ",").alias("lists"), "n_entries", "blocked")


ORACLE = r"""
with captures as (
  select page_id, url, date '2024-01-01' + cast(page_id * 37 % 365 as int) as fetched_at,
    nullif(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^/?#\]]*\]|[^/?#:]*)', 1)), '[.]$', ''), '') as host,
    string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/')[2] as first_part
  from pages
), hosts as (select distinct host, md5(host) as h from captures where host is not null),
entries as (select distinct list_name, pattern, action, cast(day_at as date) as since from (""" + ENTRIES.format(dot="instr(host, '.')") + r""") e),
spans as (
  select list_name, pattern, since as valid_from, valid_to from (
    select *, lead(since) over (partition by list_name, pattern order by since, action) as valid_to from entries) s
  where action = 'add' and (valid_to is null or valid_to > since)
), hits as (
  select distinct c.page_id, s.list_name, s.pattern, s.valid_from from captures c join spans s
    on (c.host = s.pattern or ends_with(c.host, '.' || s.pattern) or c.host || '/' || lower(c.first_part) = s.pattern)
    and s.valid_from <= c.fetched_at and (s.valid_to is null or c.fetched_at < s.valid_to)
), found as (
  select page_id, string_agg(distinct list_name, ',' order by list_name) as lists, count(*) as n_entries from hits group by page_id
)
select page_id, host, cast(cast(fetched_at as date) as varchar) as fetched_at, coalesce(lists, '') as lists, coalesce(n_entries, 0)::bigint as n_entries, lists is not null as blocked
from captures left join found using (page_id)
"""
